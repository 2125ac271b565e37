"""JSON text in the layout of Python's ``json.dumps``, as column expressions.

A space after ``:`` and after ``,``; strings in ASCII, everything else escaped (two
escapes for a character beyond the first 65,536); numbers as their shortest
text that reads back as the same double, in scientific notation from 1e16 on and
below 1e-4. Scores are doubles, so a whole number prints as ``12.0``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters with an escape of their own, by code.
ESCAPES = {34: '\\"', 92: "\\\\", 8: "\\b", 12: "\\f", 10: "\\n", 13: "\\r", 9: "\\t"}
PLAIN = r"^[ !#-\[\]-~]*\z"    # strings that are printed as they are

# SQL text, parsed once: as nested column calls these cost more than a report.


def _let(value: str, name: str, then: str) -> str:
    return f"get(transform(array({value}), {name} -> {then}), 0)"


def _unit(code: str) -> str:
    return rf"concat(r'\u', lower(lpad(hex({code}), 4, '0')))"


def _string(text: str) -> str:
    own = " ".join(f"when {code} then r'{escape}'" for code, escape in ESCAPES.items())
    pair = f"concat({_unit('shiftright(code - 65536, 10) + 55296')}, {_unit('((code - 65536) & 1023) + 56320')})"
    character = (f"case code {own} else case when code between 32 and 126 then substring({text}, i, 1) "
                 f"when code < 65536 then {_unit('code')} else {pair} end end")
    letters = f"transform(sequence(1, char_length({text})), i -> {_let(f'ascii(substring({text}, i, 1))', 'code', character)})"
    body = f"if({text} rlike r'{PLAIN}', {text}, array_join({letters}, ''))"
    return f"""coalesce(concat('"', {body}, '"'), 'null')"""


def _decimal(t: str) -> str:
    """struct(digits, power): the digits of a number's text, and the power of ten of the first."""
    mantissa, whole = f"substring_index({t}, 'E', 1)", f"substring_index({t}, '.', 1)"
    fraction = f"substring_index({mantissa}, '.', -1)"
    power = (f"case when contains({t}, 'E') then int(substring_index({t}, 'E', -1)) when {whole} <> '0' then length({whole}) - 1 "
             f"else length(trim(leading '0' from {fraction})) - length({fraction}) - 1 end")
    return f"named_struct('digits', trim(both '0' from replace({mantissa}, '.', '')), 'power', {power})"


def _shortest(x: str, d: str) -> str:
    """The fewest digits that read back as ``x``; of two such numbers the nearer (whole numbers are at
    hand exactly, others go by the text's next digit). The text that Spark prints may have a digit too many."""
    def fits(n):
        return f"double(concat({n}, 'E', {d}.power - p + 1)) = {x}"
    unit = f"bigint(pow(10d, {d}.power - p + 1))"
    up = f"if({x} >= 1e16 and {x} < 9e18, (bigint({x}) - lo * {unit}) * 2 > {unit}, substring({d}.digits, p + 1, 1) >= '5')"
    n = f"case when {fits('lo')} and not ({fits('lo + 1')} and {up}) then lo when {fits('lo + 1')} then lo + 1 end"
    number = _let(n, "n", f"named_struct('digits', trim(trailing '0' from string(n)), 'power', {d}.power + if(length(string(n)) > p, 1, 0))")
    tried = f"transform(sequence(1, length({d}.digits)), p -> {_let(f'bigint(substring({d}.digits, 1, p))', 'lo', number)})"
    return f"get(filter({tried}, t -> t.digits is not null), 0)"


def _printed(s: str) -> str:
    """A positive number of given digits and power as Python prints it."""
    n, digits, power = f"length({s}.digits)", f"{s}.digits", f"{s}.power"
    large = f"concat(rpad({digits}, {power} + 1, '0'), '.', if({n} > {power} + 1, substring({digits}, {power} + 2), '0'))"
    small = f"concat('0.', repeat('0', -{power} - 1), {digits})"
    size = f"string(abs({power}))"
    mark = f"concat(if({power} < 0, 'e-', 'e+'), lpad({size}, greatest(length({size}), 2), '0'))"
    scientific = f"concat(substring({digits}, 1, 1), if({n} > 1, concat('.', substring({digits}, 2)), ''), {mark})"
    return f"case when {power} between 0 and 15 then {large} when {power} between -4 and -1 then {small} else {scientific} end"


def _number(x: str) -> str:
    """What Spark prints plainly and in few digits is already Python's text."""
    spelled = _let(f"abs({x})", "v", _let(_decimal("string(v)"), "d", _let(_shortest("v", "d"), "s", _printed("s"))))
    return (f"case when {x} is null then 'null' when isnan({x}) or contains(string({x}), 'Inf') "
            f"or not contains(string({x}), 'E') and length(string({x})) < 17 then string({x}) "
            f"else concat(if({x} < 0, '-', ''), {spelled}) end")


def dumps_string(column: str) -> Column:
    """A string column with its quotes; null is ``null``."""
    return F.expr(_string(column))


def dumps_number(column: str) -> Column:
    """A double column as Python prints it; null is ``null``."""
    return F.expr(_number(column))


def dumps_entries(column: str, key: str = "id", value: str = "score") -> Column:
    """An object of the entries of an array column of structs, in their order; ``null`` or empty gives ``{}``."""
    part = f"concat({_string(f'e.{key}')}, ': ', {_number(f'e.{value}')})"
    return F.expr(f"concat('{{', array_join(transform(coalesce({column}, array()), e -> {part}), ', '), '}}')")
