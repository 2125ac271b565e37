"""Every user-level query over the driver tables: ``key -> f(spark, sf_dir)``.

Each callable reads the whole driver tables (mapped by ``sources.fixture``)
and returns a lazy DataFrame; nothing is collected. Keys follow the
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from huddle.functions.display import margin_sign, with_position
from huddle.functions.exact import average, summarise
from huddle.functions.jsontext import dumps_entries
from huddle.operators import draft as dr
from huddle.operators import headtohead as h2h
from huddle.operators import leaderboards as lb
from huddle.operators import luck as lk
from huddle.operators import scoreboard as sb
from huddle.plans.report import adhoc, run_report, run_season_stats
from huddle.plans.sorted_output import positions
from huddle.plans.versions import Build
from huddle.session import tuned
from huddle.sources import fixture as fx
from huddle.sources import landing, payloads

# The ad-hoc statement registered as x01 (the same text runs in the oracle).
ADHOC_SQL = (
    "SELECT league_id, week, COUNT(*) AS teams, CAST(SUM(won) AS BIGINT) AS wins, "
    "MAX(top_player_score) AS best_player_score "
    "FROM matchups GROUP BY league_id, week"
)


def scoreboard(spark: SparkSession, sf_dir: str, rule: str = "beats", coarse: bool = False,
               weeks: tuple[int, int] | None = None, eighths: bool = False) -> DataFrame:
    tuned(spark)
    raw = sb.matchups_raw(fx.weekly(spark, sf_dir, coarse, weeks, eighths), fx.rosters(spark, sf_dir),
                          fx.users(spark, sf_dir))
    return sb.matchups(raw, rule)


def _draft_inputs(spark: SparkSession, sf_dir: str):
    totals = dr.player_totals(fx.player_points(tuned(spark), sf_dir))
    return (fx.picks(spark, sf_dir), fx.players(spark, sf_dir), totals,
            fx.draft_rosters(spark, sf_dir), fx.users(spark, sf_dir))


def _s02(spark, d):
    u = landing.users_from(payloads.users(spark, d))
    return u.select("league_id", "user_id", F.try_element_at("metadata", F.lit("team_name")).alias("title"))


def _s03(spark, d):
    return landing.rosters_from(payloads.rosters(spark, d)).select("league_id", "roster_id", "owner_id")


def _s04(spark, d):
    w = landing.weekly_rows(payloads.weekly(spark, d))
    return w.select("league_id", "week", "ord", "roster_id", "matchup_id", "points", F.size("players").cast("bigint").alias("n_players"),
                    F.array_max(F.map_values("players_points")).alias("best"))


def _s05(spark, d):
    w = landing.flagged_weeks(landing.weekly_rows(payloads.weekly(spark, d), keep_empty=True))
    return w.groupBy("league_id").agg(*[F.count(F.when(F.col(c), 1)).alias(c) for c in ("in_season", "in_report")])


def _s08(spark, d):
    return landing.picks_from(payloads.picks(spark, d), payloads.drafts(spark, d)).select(
        "league_id", "ord", "pick_no", "player_id", "roster_id")


def _a15(spark, d):
    return landing.week_sizes_from(payloads.weekly(spark, d)).select(
        "league_id", "week", F.col("entries").cast("bigint").alias("entries"))


def _season(fn, coarse: bool = False):
    return lambda spark, d: fn(scoreboard(spark, d, "rank", coarse))


# The weekly report reads its weeks and no others.
COMPLETED_WEEKS = (1, 14)


def _weekly(fn):
    return lambda spark, d: fn(scoreboard(spark, d, "beats", weeks=COMPLETED_WEEKS))


def _season_global(fn):
    return lambda spark, d: fn(scoreboard(spark, d, "rank"), per_league=False)


def _b06(spark, d):
    m = scoreboard(spark, d, "beats", weeks=COMPLETED_WEEKS, eighths=True)
    s = summarise(sb.played(m), ["league_id", "team_name"], "points",
                  {"games": ("count", F.lit(1)), "least": ("min", F.col("points"))})
    return s.select("league_id", "team_name", "games", F.round(average(), 7).alias("avg_points"), "least")


def _a04(spark, d):
    """Sums and averages of scores as feeds have them: noise behind the decimals, tiny and large ones."""
    kind, value = F.col("event_id") % 3, F.col("value")
    score = F.when(kind == 0, value * 1e-6).when(kind == 1, value + 0.1 + 0.2).otherwise(value * 10000.0 / 3.0)
    s = summarise(fx.scores(spark, d), ["league_id", "roster_id"], score, {"largest": ("max", score)})
    return s.select("league_id", "roster_id", "n", F.col("total").alias("total_points"), average().alias("avg_points"), "largest")


def _a07(spark, d):
    """Spread of scores whose mean is a million times as large, unrounded."""
    score = F.lit(1e6) + F.floor("value").cast("double") / 1024.0
    s = summarise(fx.scores(spark, d), ["league_id", "roster_id"], score, spread=True)
    return s.select("league_id", "roster_id", "n", average().alias("avg_points"), F.col("std").alias("std_dev"))


def _o02(spark, d):
    """The standings as printed: each row with its place in its league."""
    return with_position(lb.standings(scoreboard(spark, d, "beats", weeks=COMPLETED_WEEKS)), "standings")


def _sorted(name, fn):
    """A report with its printed places, sorted by many tasks."""
    return lambda spark, d: positions(fn(spark, d), name)


def _s01(spark, d):
    return landing.league_info_from(payloads.leagues(spark, d))


def _s06(spark, d):
    return landing.player_display_names(fx.picks(spark, d).select("league_id", "player_id"), fx.players(spark, d))


def _s07(spark, d):
    return landing.drafts_from(payloads.draft_lists(spark, d))


def _s10(spark, d):
    """Season totals from the score maps of the weekly payloads."""
    return dr.player_totals(dr.player_points_from_weekly(landing.weekly_rows(payloads.weekly(spark, d))))


def _p05(spark, d):
    """Score objects with ids and numbers that need escapes, exponents and all digits."""
    kind = F.col("event_id") % 8
    ids = F.concat("event_type", F.element_at(F.array(*[F.lit(t) for t, _ in JSON_IDS]), (kind + 1).cast("int")))
    score = F.element_at(F.array(F.col("value"), *[F.lit(x) for x, _ in JSON_SCORES]), (F.col("event_id") % 7 + 1).cast("int"))
    ev = fx._read(spark, d, "events").select("event_id", F.array(F.struct(ids.alias("id"), score.alias("score"))).alias("entries"))
    return ev.select("event_id", dumps_entries("entries").alias("json"))


def _p19(spark, d):
    m = h2h.avg_margin(scoreboard(spark, d, "beats", weeks=COMPLETED_WEEKS))
    return m.withColumn("sign", margin_sign(F.col("avg_margin")))


# Text behind an id, and its JSON; a score, and its JSON.
JSON_IDS = [("", ""), ('"', '\\"'), ("\\", "\\\\"), ("\n", "\\n"), ("\x01", "\\u0001"), ("é", "\\u00e9"), ("日", "\\u65e5"), ("😀", "\\ud83d\\ude00")]
JSON_SCORES = [(1e7, "10000000.0"), (1e-4, "0.0001"), (1e16, "1e+16"), (1.5e-7, "1.5e-07"), (0.1 + 0.2, "0.30000000000000004"),
               (-12345678.9, "-12345678.9")]

# The column of each report that the whole runs show for a team.
SEASON_VALUES = {
    "most_high_weeks_list": "count_of_highest_scores", "top_scores_all": "points", "most_low_weeks_list": "count_of_lowest_scores",
    "low_scores_all": "points", "own_low_wins": "wins_with_lowest_score", "own_high_losses": "losses_with_highest_score",
    "win_points_profile": "avg_points_in_win", "loss_points_profile": "avg_points_in_loss"}
WEEKLY_VALUES = {
    "standings": "avg_pts", "top_scores": "points", "low_scores": "points", "consistency": "std_dev", "high_week_counts": "times_highest",
    "low_week_counts": "times_lowest", "wins_vs_low_opp": "avg_opp_score", "losses_vs_high_opp": "avg_opp_score",
    "avg_points_in_wins": "avg_pts_in_win", "avg_points_in_losses": "avg_pts_in_loss", "avg_margin": "avg_margin", "dominant_wins": "margin",
    "closest_matchups": "margin", "volatility": "avg_swing", "head_to_head": "wins", "luck": "luck"}


def _whole_run(run, values, rule, weeks=None):
    """All reports of a run, over one written scoreboard: (report, league_id, team_name, value)."""
    def query(spark, d):
        m = Build(spark).materialize(scoreboard(spark, d, rule, weeks=weeks), "scoreboard", "league_id")
        out = [df.select(F.lit(name).alias("report"), "league_id", "team_name", F.col(values[name]).cast("double").alias("value"))
               for name, df in run(m).items()]
        return functools.reduce(DataFrame.unionByName, out)
    return query


def _draft_full(fn):
    return lambda spark, d: fn(*_draft_inputs(spark, d))


def _draft_cat(fn):
    def run(spark, d):
        picks, players, totals, _, _ = _draft_inputs(spark, d)
        return fn(picks, players, totals)
    return run


def _b03(spark, d):
    t = dr.player_totals(fx.player_points(spark, d))
    return t.select("league_id", "player_id", "total_points")


def _b04(spark, d):
    w = sb.with_top_player(fx.weekly(spark, d))
    return w.select("league_id", "week", "roster_id", "top_player_id", "top_player_score",
                    "players_json")


def _b05(spark, d):
    return sb.opponent_names(fx.weekly(spark, d), fx.rosters(spark, d), fx.users(spark, d))


def _x01(spark, d):
    return adhoc(spark, ADHOC_SQL, scoreboard(spark, d, "beats"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "q01_most_high_weeks_list": _season(lb.most_high_weeks_list),
    "q02_top_scores_all": _season(lb.top_scores_all),
    "q03_most_low_weeks_list": _season(lb.most_low_weeks_list),
    "q04_low_scores_all": _season(lb.low_scores_all),
    "q05_own_low_wins": _season(lb.own_low_wins, coarse=True),
    "q06_own_high_losses": _season(lb.own_high_losses, coarse=True),
    "q07_win_points_profile": _season(lb.win_points_profile),
    "q08_loss_points_profile": _season(lb.loss_points_profile),
    "q09_standings": _weekly(lb.standings),
    "q10_top_scores": _weekly(lb.top_scores),
    "q11_low_scores": _weekly(lb.low_scores),
    "q12_consistency": _weekly(lb.consistency),
    "q13_high_week_counts": _weekly(lb.high_week_counts),
    "q14_low_week_counts": _weekly(lb.low_week_counts),
    "q15_wins_vs_low_opp": _weekly(h2h.wins_vs_low_opp),
    "q16_losses_vs_high_opp": _weekly(h2h.losses_vs_high_opp),
    "q17_avg_points_in_wins": _weekly(lb.avg_points_in_wins),
    "q18_avg_points_in_losses": _weekly(lb.avg_points_in_losses),
    "q19_avg_margin": _weekly(h2h.avg_margin),
    "q20_dominant_wins": _weekly(h2h.dominant_wins),
    "q21_closest_matchups": _weekly(h2h.closest_matchups),
    "q22_volatility": _weekly(h2h.volatility),
    "q23_head_to_head": _weekly(h2h.head_to_head),
    "q24_late_round_steals": _draft_full(dr.late_round_steals),
    "q25_bracket_averages": _draft_cat(dr.bracket_averages),
    "q26_positional_performance": _draft_cat(dr.positional_performance),
    "q27_worst_value_picks": _draft_full(dr.worst_value_picks),
    "q28_biggest_busts": _draft_full(dr.biggest_busts),
    "q29_skill_steals": _draft_full(dr.skill_steals),
    "b01_matchups_beats": lambda spark, d: scoreboard(spark, d, "beats", coarse=True),
    "b01_matchups_beats_exact": lambda spark, d: scoreboard(spark, d, "beats"),
    "b02_matchups_rank": lambda spark, d: scoreboard(spark, d, "rank", coarse=True),
    "b02_matchups_rank_exact": lambda spark, d: scoreboard(spark, d, "rank"),
    "b06_fine_scores": _b06,
    "a04_any_scores": _a04,
    "a07_far_spread": _a07,
    "q05_own_low_wins_exact": _season(lb.own_low_wins),
    "q06_own_high_losses_exact": _season(lb.own_high_losses),
    "o02_standings_order": _o02,
    "w04_global_top": _season_global(lb.top_scores_all),
    "w05_global_low": _season_global(lb.low_scores_all),
    "b03_player_totals": _b03,
    "b04_top_player": _b04,
    "b05_opponent_names": _b05,
    "s02_users_payload": _s02,
    "s03_rosters_payload": _s03,
    "s04_weekly_payload": _s04,
    "s05_week_rules": _s05,
    "s08_picks_payload": _s08,
    "a15_week_sizes": _a15,
    "s01_league_payload": _s01,
    "s06_player_names": _s06,
    "s07_drafts_payload": _s07,
    "s10_weekly_player_totals": _s10,
    "p05_score_json": _p05,
    "p19_margin_sign": _p19,
    "o03_head_to_head_order": _sorted("head_to_head", _weekly(h2h.head_to_head)),
    "o04_positional_order": _sorted("positional_performance", _draft_cat(dr.positional_performance)),
    "o05_bracket_order": _sorted("bracket_averages", _draft_cat(dr.bracket_averages)),
    "x01_adhoc_sql": _x01,
    "x02_season_stats": _whole_run(run_season_stats, SEASON_VALUES, "rank"),
    "x03_weekly_report": _whole_run(run_report, WEEKLY_VALUES, "beats", COMPLETED_WEEKS),
    "d01_luck": _weekly(lk.luck),
}
