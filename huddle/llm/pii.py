"""Personal data: patterns, and information-theoretic sanitisation of what is near them.

Patterns find emails, addresses, cards and phone numbers. Each different finding is a
protected entity. Words within a few words of one are read as terms; over the
corpus, a term t discloses an entity e by the share of e's information that t
gives, PMI(e; t) / IC(e) = 1 - log p(e | t) / log p(e), with p(e | t) the
occurrences of t near e over all occurrences of t, and p(e) those of e over all
words. A term seen with the entity in at least MIN_CONTEXTS different contexts (so
copies of one text don't count) is generalised beside that entity from
GENERALISE on, and removed from REMOVE on.

All is done with DataFrame functions. Positions come from texts that are split
at their matches: marks are set around each match, and lengths are added up.

Defined results: null text is an empty text without findings; repeated rows each
get the same spans; a null doc_id stays null; an empty table gives no rows;
other columns are not read (and kept as they are by ``sanitised``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from huddle.llm.common import release, written

# The contract's patterns, written so that a long text costs time in proportion:
# possessive repeats, and starts only where a leftmost match can begin.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
KINDS = list(PATTERNS)
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_MARK, _OTHER = "\x01", "\x02"

CONTEXT_CHARS, CONTEXT_WORDS = 80, 4
MIN_CONTEXTS = 3
GENERALISE, REMOVE = 0.8, 0.9
BROADCAST_ROWS = 20_000


def _marked(text: Column, pattern: str) -> Column:
    """A text split at its matches: text, match, text, ..., text."""
    return F.split(F.regexp_replace(text, pattern, f"{_MARK}$0{_MARK}"), _MARK, -1)


def _places(parts: Column) -> Column:
    """start, end (code points, end exclusive) and value of each match."""
    empty = F.array().cast("array<struct<start:int,end:int,value:string>>")
    walk = F.aggregate(
        parts, F.struct(F.lit(0).alias("at"), F.lit(False).alias("match"), empty.alias("found")),
        lambda acc, x: F.struct(
            (acc["at"] + F.char_length(x)).alias("at"), (~acc["match"]).alias("match"),
            F.when(acc["match"], F.concat(acc["found"], F.array(F.struct(
                acc["at"].alias("start"), (acc["at"] + F.char_length(x)).alias("end"), x.alias("value")))))
            .otherwise(acc["found"]).alias("found")))["found"]
    return F.when(F.size(parts) > 1, walk).otherwise(empty)


def _luhn(digits: Column) -> Column:
    n = F.char_length(digits)

    def add(acc, i):
        x = F.substr(digits, n - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return acc + F.when(x > 9, x - 9).otherwise(x)
    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^(?:{_PART}\.){{3}}{_PART}$")
    digits = F.regexp_replace(value, "[^0-9]", "")
    n = F.char_length(digits)
    if kind == "card":
        return F.when(n.between(13, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def with_findings(docs: DataFrame, key: Column | None = None) -> DataFrame:
    """``docs`` with ``_spans``: kind, start, end, value and the text before and after each finding."""
    t = F.coalesce(F.col("text"), F.lit(""))
    df = docs.withColumn("_t", F.when(F.contains(t, F.lit(_MARK)), F.translate(t, _MARK, _OTHER)).otherwise(t))
    need = {"email": F.contains("_t", F.lit("@")), "phone": F.contains("_t", F.lit("+"))}
    for kind, pattern in PATTERNS.items():
        parts = _marked(F.col("_t"), pattern)
        parts = F.when(need[kind], parts).otherwise(F.array("_t")) if kind in need else parts
        df = df.withColumn(f"_{kind}", parts)
    for kind in KINDS:
        df = df.withColumn(f"_{kind}_at", _places(F.col(f"_{kind}")))

    def full(kind):
        parts = F.col(f"_{kind}")
        with_context = F.transform(F.col(f"_{kind}_at"), lambda s, i: F.struct(
            F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"),
            F.right(F.get(parts, i * 2), F.lit(CONTEXT_CHARS + 1)).alias("before"),
            F.left(F.get(parts, i * 2 + 2), F.lit(CONTEXT_CHARS + 1)).alias("after")))
        return F.filter(with_context, lambda s: _valid(kind, s["value"]))
    df = df.withColumn("_spans", F.concat(*[full(k) for k in KINDS]))
    return df.select(*docs.columns, "_spans")


def _row_key() -> Column:
    """Equal rows have equal spans, so rows are told by their id and text."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")))


def found_in(docs: DataFrame) -> DataFrame:
    """__row_key, doc_id and _spans of every row, without the texts."""
    return with_findings(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _row_key().alias("__row_key"))).select(
        "__row_key", "doc_id", "_spans")


def _words(text: Column, side: str) -> Column:
    """The words of three letters or more next to a finding, the nearest CONTEXT_WORDS."""
    whole = F.filter(_places(_marked(text, r"[\p{L}]{3,}+")), lambda w: (
        (F.char_length(text) <= CONTEXT_CHARS) | (w["start"] > 0 if side == "before" else w["end"] <= CONTEXT_CHARS)))
    return F.slice(whole, F.greatest(F.size(whole) - CONTEXT_WORDS + 1, F.lit(1)), F.lit(CONTEXT_WORDS)) \
        if side == "before" else F.slice(whole, 1, CONTEXT_WORDS)


def _context_terms(found: DataFrame) -> DataFrame:
    """A row for each word near a finding: _key, entity, term, its place, and a hash of the context."""
    one = found.filter(F.size("_spans") > 0).select("__row_key", F.explode("_spans").alias("s"), F.col("_spans").alias("all"))
    one = one.select("__row_key", "all", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "s.before", "s.after",
                     F.concat("s.kind", F.lit(":"), F.when(F.col("s.kind").isin("card", "phone"), F.regexp_replace("s.value", "[^0-9]", ""))
                              .otherwise(F.lower("s.value"))).alias("entity"))
    near = F.concat(
        F.transform(_words(F.col("before"), "before"), lambda w: F.struct(
            (F.col("start") - F.char_length("before") + w["start"]).alias("a"),
            (F.col("start") - F.char_length("before") + w["end"]).alias("b"), F.lower(w["value"]).alias("term"))),
        F.transform(_words(F.col("after"), "after"), lambda w: F.struct(
            (F.col("end") + w["start"]).alias("a"), (F.col("end") + w["end"]).alias("b"), F.lower(w["value"]).alias("term"))))
    return one.withColumn("w", F.explode(near)).select(
        "__row_key", "entity", "w.term", "w.a", "w.b", F.xxhash64("before", "after").alias("context"),
        F.exists("all", lambda s: (s["start"] < F.col("w.b")) & (s["end"] > F.col("w.a"))).alias("inside")
    ).filter(~F.col("inside")).drop("inside")


def disclosing(docs: DataFrame, found: DataFrame, near: DataFrame) -> DataFrame:
    """entity, term, disclosure of the pairs that reach GENERALISE."""
    pairs = near.groupBy("entity", "term", "context").count().groupBy("entity", "term").agg(
        F.sum("count").alias("n_te"), F.count("*").alias("contexts")).filter(F.col("contexts") >= MIN_CONTEXTS)
    entities = found.select(F.explode("_spans").alias("s")).select(
        F.concat("s.kind", F.lit(":"), F.when(F.col("s.kind").isin("card", "phone"), F.regexp_replace("s.value", "[^0-9]", ""))
                 .otherwise(F.lower("s.value"))).alias("entity")).groupBy("entity").agg(F.count("*").alias("n_e"))
    word = docs.select(F.explode(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}]+")).alias("term"))
    words = written(word.filter("term <> ''").groupBy("term").agg(F.count("*").alias("n_t")), "words")
    total = words.agg(F.sum("n_t")).first()[0] or 1
    joined = pairs.join(words, "term", "left").join(entities, "entity")
    p_et = F.least(F.col("n_te") / F.greatest("n_te", F.coalesce("n_t", F.lit(0))), F.lit(1.0))
    p_e = F.least(F.col("n_e") / F.lit(float(max(total, 2))), F.lit(0.5))
    out = written(joined.select("entity", "term", (1 - F.log(p_et) / F.log(p_e)).alias("disclosure"))
                  .filter(F.col("disclosure") >= GENERALISE), "disclosing")
    release(words)
    return out


def _added(docs: DataFrame, found: DataFrame) -> DataFrame:
    """_key and the spans that the method adds, in order, none overlapping a finding."""
    near = written(_context_terms(found), "near")
    pairs = disclosing(docs, found, near)
    hit = near.join(pairs, ["entity", "term"]).groupBy("__row_key", "a", "b").agg(F.max("disclosure").alias("d"))
    return hit.groupBy("__row_key").agg(F.sort_array(F.collect_set(F.struct(
        F.when(F.col("d") >= REMOVE, "removed").otherwise("generalised").alias("kind"),
        F.col("a").alias("start"), F.col("b").alias("end")))).alias("_added"))


def _listed(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def _count(kind: str) -> Column:
    return F.size(F.filter("_spans", lambda s: s["kind"] == kind)).cast("long")


def spans(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, counts by kind, the digest of the findings, all spans."""
    found = written(found_in(docs), "findings")
    added = _added(docs, found)
    rows = found.join(added, "__row_key", "left").withColumn("base", _listed(F.col("_spans")))
    more = F.coalesce(_listed(F.col("_added")), F.lit(""))
    return rows.select(
        "doc_id", *[_count(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(F.encode("base", "utf-8"), 256).alias("base_sha256"),
        F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), F.when(more != "", more)).alias("spans"))


def sanitised(docs: DataFrame) -> DataFrame:
    """``docs`` with findings replaced by their kind, disclosing terms generalised or removed."""
    found = written(found_in(docs).filter(F.size("_spans") > 0), "findings")
    added = written(_added(docs, found), "added")
    cuts = F.struct
    rows = found.select("__row_key", F.transform("_spans", lambda s: cuts(
        s["start"].alias("start"), s["end"].alias("end"), F.upper(s["kind"]).alias("kind"))).alias("s")).dropDuplicates(["__row_key"])
    rows = rows.join(added, "__row_key", "left").select("__row_key", F.sort_array(F.concat("s", F.coalesce(
        F.transform("_added", lambda s: cuts(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))),
        F.array().cast("array<struct<start:int,end:int,kind:string>>")))).alias("__cuts"))
    rows = written(rows, "cuts")
    release(added, found)
    rows = F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows
    keyed = docs.withColumn("__row_key", _row_key()).join(rows, "__row_key", "left")
    label = lambda s, word: F.when(s["kind"] == "removed", "").when(
        s["kind"] == "generalised", F.when(word.rlike(r"^\p{Lu}"), "[NAME]").otherwise("[WORD]")).otherwise(
        F.concat(F.lit("["), s["kind"], F.lit("]")))
    text = F.col("text")
    # overlapping findings: what an earlier one took stays taken
    built = F.aggregate("__cuts", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), lambda acc, s: F.struct(
        F.greatest(acc["at"], s["end"]).alias("at"),
        F.when(s["start"] >= acc["at"], F.concat(
            acc["out"], F.substr(text, acc["at"] + 1, s["start"] - acc["at"]),
            label(s, F.substr(text, s["start"] + 1, F.lit(1))))).otherwise(acc["out"]).alias("out")))
    clean = keyed.withColumn("__built", F.when(F.size("__cuts") > 0, built)).withColumn("text", F.when(
        F.col("__built").isNotNull(), F.concat("__built.out", F.substr(text, F.col("__built.at") + 1, F.char_length(text)))).otherwise(text))
    return clean.select(*docs.columns)
