"""Exact sums, averages and variances of any doubles, as grouped aggregation.

A double is an integer times a power of two, so sums of doubles are exact in
integers. Each value is cut at fixed places of the binary scale, ``DIGIT`` bits
apart, into three whole numbers, and belongs to the bin of its size. Grouping by
key and bin adds the numbers of a bin as plain 64-bit integers: mergeable, free of
any order, and partially aggregated before a shuffle like every sum. A second
aggregation collects a key's bins (at most 76 cover all doubles; scores of one
league have one or two), carries, and rounds once, to the nearest double: the
result is that of ``math.fsum``, at any number of partitions.

Squares of a bin's numbers are whole numbers too, so a variance comes from exact
sums ``n * sum(x * x) - sum(x) ** 2``, rounded once, whatever the mean is.

Nulls are left out. Infinities and NaN are kept apart and give what adding them
gives. A sum beyond the doubles is infinite. A bin of one key takes 2^35 values;
beyond that Spark raises an overflow, it never wraps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIGIT = 28                      # bits; seven hexadecimal digits
MASK = (1 << DIGIT) - 1
PARTS = 3                       # a double has 53 bits: 28 above the point at most, 53 below
SQUARE_PARTS = 6

SUMS = [f"s{i}" for i in range(PARTS)]
SQUARES = [f"q{i}" for i in range(SQUARE_PARTS)]


_FINITE = "(_x is not null and not isnan(_x) and abs(_x) < double('Infinity'))"
# A finite value's size in digits, one off at a border at most; none for zero.
_BIN = f"if({_FINITE} and _x <> 0d, int(floor(log2(abs(_x)) / {DIGIT})), null)"
# x * 2^(-DIGIT * bin), in two steps that neither overflow nor lose bits
_SCALED = f"abs(_x * pow(2d, -{DIGIT // 2} * _bin) * pow(2d, -{DIGIT // 2} * _bin))"
_SHIFT = f"{float(1 << DIGIT)}D"


def _square_numbers() -> list[str]:
    """The digits of x * x from the numbers of x; ``DIGIT * (2 * bin + 1 - i)`` is the place of the i-th."""
    h, m, l = (f"abs(_s{i})" for i in range(PARTS))
    digits, carry = [], "0L"
    for c in (f"{l} * {l}", f"{m} * {l} * 2", f"{m} * {m} + {h} * {l} * 2", f"{h} * {m} * 2", f"{h} * {h}"):
        digits.append(f"({c} + {carry}) & {MASK}")
        carry = f"shiftright({c} + {carry}, {DIGIT})"
    return [carry, *digits[::-1]]


def _entries(rows: DataFrame, value: Column, squares: bool) -> DataFrame:
    """Adds _bin, the whole numbers of the value ``x = sum(_s[i] * 2^(DIGIT * (_bin - i)))``, with its
    sign, those of its square, and _odd (a value that isn't finite). Plain columns, so all is compiled."""
    rows = rows.withColumn("_x", value.cast("double")).selectExpr("*", f"{_BIN} as _bin")
    rows = rows.selectExpr("*", f"{_SCALED} as _a", f"if({_FINITE}, null, _x) as _odd")
    rows = rows.selectExpr("*", f"(_a - floor(_a)) * {_SHIFT} as _b")
    numbers = ("floor(_a)", "floor(_b)", f"floor((_b - floor(_b)) * {_SHIFT})")
    rows = rows.selectExpr("*", *[f"if(_x < 0d, -{x}, {x}) as _s{i}" for i, x in enumerate(numbers)])
    return rows.selectExpr("*", *[f"{q} as _q{i}" for i, q in enumerate(_square_numbers())]) if squares else rows


# The few expressions that bring a key's bins together are SQL text: one parse each, where
# nested column calls would cost more than the query. ``_let`` finds a value once.

def _let(value: str, name: str, then: str) -> str:
    return f"get(transform(array({value}), {name} -> {then}), 0)"


def _digits(names: list[str], step: int, top: int) -> str:
    """Sums of ``_entries`` by place: struct(low, digits), lowest place first. The i-th number
    of a bin has the place ``step * bin + top - i``."""
    n = len(names)
    ends = (f"named_struct('low', array_min(_entries.bin) * {step} + {top - n + 1}, "
            f"'high', array_max(_entries.bin) * {step} + {top})")
    i = f"x.bin * {step} + {top} - place"
    number = f"get(array({', '.join(f'x.{c}' for c in names)}), if({i} between 0 and {n - 1}, {i}, null))"
    sums = f"aggregate(_entries, 0L, (sum, x) -> sum + coalesce({number}, 0L))"
    return _let(ends, "e", f"named_struct('low', e.low, 'digits', transform(sequence(e.low, e.high), place -> {sums}))")


def _carried(digits: str) -> str:
    """struct(carry, text, digits): the number in proper digits; a negative carry for a negative number."""
    low = f"(d + a.carry) & {MASK}"
    return (f"aggregate({digits}, named_struct('carry', 0L, 'text', '', 'digits', cast(array() as array<bigint>)), "
            f"(a, d) -> named_struct('carry', shiftright(d + a.carry, {DIGIT}), "
            f"'text', concat(lpad(hex({low}), {DIGIT // 4}, '0'), a.text), 'digits', concat(a.digits, array({low}))))")


def _magnitude(digits: str) -> str:
    """struct(sign, of): the sign and the proper digits of the absolute value."""
    signed = _carried(f"transform({digits}, y -> y * s)")
    return f"get(filter(transform(array(1L, -1L), s -> named_struct('sign', s, 'of', {signed})), t -> t.of.carry >= 0), 0)"


def _rounded(number: str) -> str:
    """The double nearest to ``sum(digits[i] * 2^(DIGIT * (low + i)))``: a hexadecimal
    literal of all digits is rounded once."""
    literal = f"concat('0x', hex(m.of.carry), m.of.text, 'p', v.low * {DIGIT})"
    return _let(number, "v", _let(_magnitude("v.digits"), "m", f"m.sign * cast({literal} as double)"))


TOTAL = f"coalesce(_odd, if(size(_entries) > 0, {_rounded(_digits(SUMS, 1, 0))}, 0d))"


def _proper(carried: str) -> str:
    """All digits of a number that isn't negative; the carry may be wider than one."""
    return f"concat({carried}.digits, array({carried}.carry & {MASK}, shiftright({carried}.carry, {DIGIT})))"


# The digits (not carried) of the square of a number with the digits ``c``.
_SQUARE = ("transform(sequence(0, size(c) * 2 - 2), k -> aggregate(sequence(greatest(0, k - size(c) + 1), least(k, size(c) - 1)), "
           "0L, (sum, i) -> sum + get(c, i) * get(c, k - i)))")


def _at(number: str) -> str:
    """The digit of a number at ``place``; 0 outside."""
    return f"if(place < {number}.low, 0L, coalesce(get({number}.digits, place - {number}.low), 0L))"


def _spread_total() -> str:
    """``_n * sum(x * x) - sum(x) ** 2``, rounded once."""
    squares = _let(_digits(SQUARES, 2, 1), "f", _let(
        _carried("f.digits"), "g", f"named_struct('low', f.low, 'digits', {_proper('g')})"))
    product = _let(_digits(SUMS, 1, 0), "f", _let(
        _magnitude("f.digits"), "g", _let(_proper("g.of"), "c", f"named_struct('low', f.low * 2, 'digits', {_SQUARE})")))
    places = "sequence(least(q.low, r.low), greatest(q.low + size(q.digits), r.low + size(r.digits)))"
    difference = f"named_struct('low', least(q.low, r.low), 'digits', transform({places}, place -> {_at('q')} * _n - {_at('r')}))"
    return _rounded(_let(squares, "q", _let(product, "r", difference)))


STD = f"""if(_odd is not null, double('NaN'), if(size(_entries) > 0, sqrt({_spread_total()} / (double(_n) * double(_n))), 0d))"""


# How a plain aggregate is merged from its parts in bins.
_MERGE = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}
_PART = {"count": F.count, "sum": F.sum, "min": F.min, "max": F.max}


def summarise(df: DataFrame, keys: list[str], value: Column | str, plain: dict[str, tuple[str, Column]] | None = None,
              spread: bool = False, first: tuple[str, ...] = ()) -> DataFrame:
    """Columns ``first`` are more keys of the first aggregation only: rows partitioned by some of the
    keys and ``first`` are added up where they are, and only those sums are moved.

    Per key: ``n`` (values that aren't null), ``total`` (null if none), with ``spread``
    also ``std`` (population standard deviation), and the plain aggregates by name: (kind, column)
    with kind count, sum, min, max, or ``texts`` (the values in order, as ``"1, 4, 9"``)."""
    plain = plain or {}
    value = F.col(value) if isinstance(value, str) else value
    rows = df.select(*keys, *first, value.cast("double").alias("_v"), *[c.alias(f"_p_{name}") for name, (_, c) in plain.items()])
    rows = _entries(rows, F.col("_v"), spread)
    numbers = [F.sum(f"_{c}").alias(c) for c in (SUMS + SQUARES if spread else SUMS)]
    part = [(F.collect_list if kind == "texts" else _PART[kind])(f"_p_{name}").alias(f"_p_{name}")
            for name, (kind, _) in plain.items()]
    bins = rows.groupBy(*keys, *first, "_bin").agg(*numbers, F.count("_x").alias("_n"), F.sum("_odd").alias("_odd"), *part)
    entry = F.struct(F.col("_bin").alias("bin"), *SUMS, *(SQUARES if spread else []))
    whole = []
    for name, (kind, _) in plain.items():
        if kind == "texts":
            listed = F.array_sort(F.flatten(F.collect_list(f"_p_{name}")))
            whole.append(F.when(F.size(listed) > 0, F.array_join(listed.cast("array<string>"), ", ")).alias(name))
        else:
            whole.append(_MERGE[kind](f"_p_{name}").alias(name))
    merged = bins.groupBy(*keys).agg(
        F.collect_list(F.when(F.col("_bin").isNotNull(), entry)).alias("_entries"), F.sum("_n").alias("_n"),
        F.sum("_odd").alias("_odd"), *whole)
    out = [*keys, F.col("_n").alias("n"), F.expr(f"if(_n > 0, {TOTAL}, null)").alias("total")]
    if spread:
        out.append(F.expr(f"if(_n > 0, {STD}, null)").alias("std"))
    return merged.select(*out, *plain)


def average(total: str = "total", n: str = "n") -> Column:
    """The average of a summary (null without values)."""
    return F.when(F.col(n) > 0, F.col(total) / F.col(n))


def with_average(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Each row with the exact average of ``value`` over the rows of its keys.

    Two windows over partitions of the keys: the sums of each bin, then the few
    distinct bins of the group.
    """
    cols = df.columns
    rows = _entries(df, F.col(value), False)
    inner, outer = Window.partitionBy(*keys, "_bin"), Window.partitionBy(*keys)
    rows = rows.select(*cols, "_bin", "_x", "_odd", *[F.sum(f"_{c}").over(inner).alias(c) for c in SUMS])
    entry = F.when(F.col("_bin").isNotNull(), F.struct(F.col("_bin").alias("bin"), *SUMS))
    rows = rows.select(*cols, F.collect_set(entry).over(outer).alias("_entries"), F.sum("_odd").over(outer).alias("_odd"),
                       F.count("_x").over(outer).alias("_n"))
    return rows.select(*cols, F.expr(f"if(_n > 0, {TOTAL} / _n, null)").alias(name))
