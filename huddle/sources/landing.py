"""Landed JSON payloads -> canonical frames.

Layout under ``root`` (one small file per API response):

    league_id=<id>/league.json                 object   {"name": ...}
    league_id=<id>/users.json                  array    [{"user_id", "metadata"}]
    league_id=<id>/rosters.json                array    [{"roster_id", "owner_id"}]
    league_id=<id>/week=<n>/matchups.json      array    [{"roster_id", "matchup_id", "points",
                                                          "players", "players_points"}]
    league_id=<id>/drafts.json                 array    [{"draft_id"}]
    league_id=<id>/draft_id=<id>/picks.json    array    [{"pick_no", "player_id", "roster_id"}]
    players.json                               object   {player_id: {"full_name", "position", ...}}

Each payload is read whole (``wholetext``), parsed with an explicit schema
and exploded with its list position (``ord``), which decides "first" and
"last wins". Partition values come from the path. A file per response is
small, so ``compact`` writes the parsed frames once as parquet tables and
every report reads those.

A missing ``points`` counts as 0, an explicit null stays NULL. A payload that is not
a JSON list is *broken*: it is listed by ``broken_payloads``, it ends the weeks that
are read (as a failed fetch does), and it never counts as an empty week.
Documented deviation: a null ``players``/``players_points``/``metadata`` counts as
empty instead of failing the run.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from huddle.functions.names import map_get_or
from huddle.operators.common import slices
from huddle.sources import schemas as S

LEAGUE_NAME_DEFAULT = "N/A"
REGULAR_WEEKS = (1, 17)   # season script: weeks 1-17
PLAYOFF_WEEKS = (18, 21)  # season script: playoff weeks 18-21
REPORT_WEEKS = (1, 21)    # weekly report: weeks 1-21, up to the first empty week


def _payloads(spark: SparkSession, root: str, pattern: str, partitions: str) -> DataFrame:
    """Whole files matching ``pattern`` with their partition columns typed as
    ``partitions`` (e.g. ``"league_id string, week int"``)."""
    root = root.rstrip("/")
    schema = f"value string, {partitions}" if partitions else "value string"
    return (spark.read.schema(schema).option("basePath", root).option("wholetext", True)
            .text(f"{root}/{pattern}"))


def _elements(df: DataFrame, element, keep: list[str], outer: bool = False) -> DataFrame:
    """Explode a JSON array payload into one row per element with ``ord``.

    ``outer`` keeps one all-NULL row (``ord`` NULL) for an empty payload."""
    parsed = df.select(*keep, F.from_json("value", ArrayType(element)).alias("_arr"))
    gen = F.posexplode_outer("_arr") if outer else F.posexplode("_arr")
    return parsed.select(*keep, gen.alias("ord", "_e")).select(
        *keep, F.col("ord").cast("int").alias("ord"), "_e.*")


def league_info(spark: SparkSession, root: str) -> DataFrame:
    """(league_id, name); a missing name reads ``N/A``, an explicit null stays null."""
    return league_info_from(_payloads(spark, root, "league_id=*/league.json", "league_id string"))


def league_info_from(payloads: DataFrame) -> DataFrame:
    obj = F.from_json("value", "map<string,string>")
    return payloads.select("league_id", map_get_or(obj, "name", F.lit(LEAGUE_NAME_DEFAULT)).alias(
        "name"))


def _last_wins(df: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Keep the last element per (league, key), like building a dict."""
    latest = F.max_by(F.struct(*cols), "ord")
    return df.groupBy("league_id", key).agg(latest.alias("_v")).select("league_id", key, "_v.*")


def users(spark: SparkSession, root: str) -> DataFrame:
    """Users per league (last element wins on a repeated ``user_id``)."""
    return users_from(_payloads(spark, root, "league_id=*/users.json", "league_id string"))


def users_from(payloads: DataFrame) -> DataFrame:
    el = _elements(payloads, S.USER_ELEMENT, ["league_id"])
    return _last_wins(el, "user_id", ["metadata"]).select(*S.USERS_COLUMNS)


def rosters(spark: SparkSession, root: str) -> DataFrame:
    """Rosters per league (last element wins on a repeated ``roster_id``)."""
    return rosters_from(_payloads(spark, root, "league_id=*/rosters.json", "league_id string"))


def rosters_from(payloads: DataFrame) -> DataFrame:
    el = _elements(payloads, S.ROSTER_ELEMENT, ["league_id"])
    return _last_wins(el, "roster_id", ["owner_id"]).select(*S.ROSTERS_COLUMNS)


def _weekly_payloads(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    return _payloads(spark, root, pattern, "league_id string, week int")


def is_broken(value: Column) -> Column:
    """Whether a payload is anything but a JSON list."""
    return ~F.coalesce(F.startswith(F.schema_of_variant(F.try_parse_json(value)), F.lit("ARRAY")), F.lit(False))


def weekly_rows(payloads: DataFrame, extra: list[str] | None = None,
                keep_empty: bool = False) -> DataFrame:
    """Parse weekly payloads ``(league_id, week, value, *extra)`` into weekly
    rows. ``keep_empty`` leaves one marker row (``ord`` NULL) per empty payload
    and per broken one (``broken`` true)."""
    keep = ["league_id", "week", *(extra or [])]
    flagged = payloads.withColumn("broken", is_broken(F.col("value")))
    text = F.when(~F.col("broken"), F.col("value"))
    # the keys of each element tell a missing score from an explicit null
    both = F.arrays_zip(F.from_json(text, ArrayType(S.MATCHUP_ELEMENT)).alias("e"),
                        F.from_json(text, "array<map<string,string>>").alias("keys"))
    gen = F.posexplode_outer("_both") if keep_empty else F.posexplode("_both")
    el = flagged.select(*keep, "broken", both.alias("_both")).select(*keep, "broken", gen.alias("ord", "_x"))
    e = F.col("_x.e")
    given = F.map_contains_key(F.col("_x.keys"), "points")
    return el.select(
        *keep, F.col("ord").cast("int").alias("ord"), e["roster_id"].alias("roster_id"), e["matchup_id"].alias("matchup_id"),
        F.when(F.coalesce(given, F.lit(False)), e["points"]).otherwise(F.lit(0.0)).alias("points"),
        F.coalesce(e["players"], F.array().cast("array<string>")).alias("players"),
        F.coalesce(e["players_points"], F.create_map().cast("map<string,double>")).alias("players_points"),
        "broken",
    )


# kind of payload -> (path pattern, its partition columns)
LISTS = {
    "users": ("league_id=*/users.json", "league_id string"),
    "rosters": ("league_id=*/rosters.json", "league_id string"),
    "weekly": ("league_id=*/week=*/matchups*.json", "league_id string, week int"),
    "drafts": ("league_id=*/drafts.json", "league_id string"),
    "picks": ("league_id=*/draft_id=*/picks.json", "league_id string, draft_id string"),
}


def broken_payloads(spark: SparkSession, root: str, kinds=tuple(LISTS)) -> DataFrame:
    """(kind, league_id, path) of every landed payload that can't be read as a list."""
    out = spark.createDataFrame([], "kind string, league_id string, path string")
    for kind in kinds:
        pattern, partitions = LISTS[kind]
        try:
            files = _payloads(spark, root, pattern, partitions)
        except AnalysisException:  # nothing of this kind has landed
            continue
        out = out.unionByName(files.select("value", "league_id", F.col("_metadata.file_path").alias("path")).filter(
            is_broken(F.col("value"))).select(F.lit(kind).alias("kind"), "league_id", "path"))
    return out


def week_sizes(spark: SparkSession, root: str) -> DataFrame:
    """(league_id, week, entries): the length of each weekly payload, empty
    weeks included (the per-week status line of the fetch loop)."""
    return week_sizes_from(_weekly_payloads(spark, root, "league_id=*/week=*/matchups.json"))


def week_sizes_from(payloads: DataFrame) -> DataFrame:
    return payloads.select("league_id", "week",
                    F.size(F.from_json("value", ArrayType(S.MATCHUP_ELEMENT))).alias("entries"))


def merge_weeks(earlier: DataFrame, later: DataFrame) -> DataFrame:
    """Union of two week sources; a (league, week) present in ``later``
    replaces the one in ``earlier``."""
    keys = later.select("league_id", "week").distinct()
    return earlier.join(keys, ["league_id", "week"], "left_anti").unionByName(later)


def weekly_parsed(spark: SparkSession, root: str, weeks=REPORT_WEEKS) -> DataFrame:
    """Every landed weekly payload of weeks 1-21 parsed once; an empty payload
    (or one that is not a list) leaves one marker row with ``ord`` NULL.
    ``season_weeks`` and ``report_weeks`` derive both week rules from it."""
    p = _weekly_payloads(spark, root, "league_id=*/week=*/matchups.json").filter(
        F.col("week").between(*weeks))
    return weekly_rows(p, keep_empty=True)


def flagged_weeks(rows: DataFrame, regular=REGULAR_WEEKS, playoffs=PLAYOFF_WEEKS,
                  report=REPORT_WEEKS) -> DataFrame:
    """The rows of ``weekly_parsed`` without its markers, with two flags.

    ``in_season``: weeks 1-17 and playoff weeks 18-21, each range up to its first broken
    payload; an empty week adds no rows. ``in_report``: weeks 1-21 up to the
    league's first empty or broken payload. Both stops come from one window
    over the league, which also hash-partitions the rows by league for all that
    follows.
    """
    week, marker = F.col("week"), F.col("ord").isNull()
    broken = marker & F.coalesce(F.col("broken"), F.lit(False))
    rules = {"_regular": (regular, broken), "_playoffs": (playoffs, broken), "_report": (report, marker)}
    stops = {name: F.min(F.when(ends & week.between(*bounds), week)) for name, (bounds, ends) in rules.items()}
    if slices(rows):
        # a large league is in many places: its few markers are gathered, not its rows
        found = rows.filter(marker).groupBy("league_id").agg(*[s.alias(name) for name, s in stops.items()])
        flagged = rows.join(found, "league_id", "left")
    else:
        league = Window.partitionBy("league_id")
        flagged = rows.withColumns({name: s.over(league) for name, s in stops.items()})

    def upto(name):
        stop = F.col(name)
        return week.between(*rules[name][0]) & (stop.isNull() | (week < stop))
    flagged = flagged.withColumns({"in_season": upto("_regular") | upto("_playoffs"), "in_report": upto("_report")})
    return flagged.filter(F.col("ord").isNotNull()).drop("broken", *rules)


def season_weeks(rows: DataFrame, regular=REGULAR_WEEKS, playoffs=PLAYOFF_WEEKS) -> DataFrame:
    """The season script's rows of ``weekly_parsed``."""
    return flagged_weeks(rows, regular, playoffs).filter("in_season").drop("in_season", "in_report")


def report_weeks(rows: DataFrame, weeks=REPORT_WEEKS) -> DataFrame:
    """The weekly report's rows of ``weekly_parsed``."""
    return flagged_weeks(rows, report=weeks).filter("in_report").drop("in_season", "in_report")


def weekly_season(spark: SparkSession, root: str) -> DataFrame:
    """Weekly rows of the season script (weeks 1-17 and 18-21)."""
    return season_weeks(weekly_parsed(spark, root))


def weekly_report(spark: SparkSession, root: str) -> DataFrame:
    """Weekly rows of the report (weeks 1-21 up to the first empty week)."""
    return report_weeks(weekly_parsed(spark, root))


def drafts(spark: SparkSession, root: str) -> DataFrame:
    """Drafts of each league in list order."""
    return drafts_from(_payloads(spark, root, "league_id=*/drafts.json", "league_id string"))


def drafts_from(payloads: DataFrame) -> DataFrame:
    return _elements(payloads, S.DRAFT_ELEMENT, ["league_id"])


def picks(spark: SparkSession, root: str) -> DataFrame:
    """Picks of each league's first listed draft."""
    raw = _payloads(spark, root, "league_id=*/draft_id=*/picks.json",
                    "league_id string, draft_id string")
    return picks_from(raw, drafts(spark, root))


def picks_from(payloads: DataFrame, drafts: DataFrame) -> DataFrame:
    el = _elements(payloads, S.PICK_ELEMENT, ["league_id", "draft_id"])
    first = drafts.filter(F.col("ord") == 0).select("league_id", "draft_id")
    return el.join(first, ["league_id", "draft_id"], "left_semi").select(*S.PICKS_COLUMNS)


def players(spark: SparkSession, root: str, name: str = "players.json") -> DataFrame:
    """Player catalog ``(player_id, attrs)``. The catalog is a single JSON
    object (one API response), parsed by one task; write it once with
    ``compact`` and join the parquet dimension afterwards."""
    raw = spark.read.option("wholetext", True).text(f"{root.rstrip('/')}/{name}")
    return raw.select(F.explode(F.from_json("value", S.PLAYER_CATALOG)).alias(
        "player_id", "attrs"))


def player_display_names(df: DataFrame, catalog: DataFrame, id_col: str = "player_id") -> DataFrame:
    """Adds ``player_name``: the catalog's full name, or ``Player_<id>``."""
    cat = catalog.select(F.col("player_id").alias("_pid"), "attrs")
    j = df.join(cat, df[id_col] == cat["_pid"], "left")
    name = map_get_or(F.col("attrs"), "full_name",
                      F.concat(F.lit("Player_"), F.col(id_col).cast("string")))
    return j.select(*[df[c] for c in df.columns], name.alias("player_name"))


def compact(spark: SparkSession, root: str, out: str, weekly: bool = True) -> dict[str, str]:
    """Parse every landed payload once and write parquet tables under ``out``
    (``weekly`` keeps the empty-payload markers; derive the week rules with
    ``season_weeks`` / ``report_weeks``). Returns table -> path. Not
    partitioned by league on disk: one directory per league does not scale to
    millions of leagues. ``weekly=False`` leaves the weekly rows to the caller
    (the report pipeline writes them bucketed by league instead)."""
    out = out.rstrip("/")
    tables = {
        **({"weekly": weekly_parsed(spark, root)} if weekly else {}),
        "users": users(spark, root),
        "rosters": rosters(spark, root),
        "picks": picks(spark, root),
        "league": league_info(spark, root),
    }
    paths = {}
    for name, df in tables.items():
        path = f"{out}/{name}"
        df.write.mode("overwrite").parquet(path)
        paths[name] = path
    cat_path = f"{out}/players"
    players(spark, root).write.mode("overwrite").parquet(cat_path)
    paths["players"] = cat_path
    return paths
