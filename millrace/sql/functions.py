"""Functions of the dialect that Spark has in another form: from argument texts to Spark's SQL.

A function returns None where Spark's own meaning holds.  All of them stay expressions that Catalyst sees through.
"""

from __future__ import annotations

import re
from collections.abc import Callable

#: Fixed names of types in the columnar format, by Spark's names in a schema.
ARROW = {"byte": "Int8", "short": "Int16", "integer": "Int32", "long": "Int64", "float": "Float32", "double": "Float64", "boolean": "Boolean", "string": "Utf8View", "binary": "Binary", "date": "Date32", "timestamp_ntz": "Timestamp(µs)", "timestamp": 'Timestamp(µs, "UTC")', "void": "Null"}
#: Fixed: SQL names where they differ from those above, and further names that a cast may give.
SQL_NAMES = {"byte": "tinyint", "short": "smallint", "integer": "int", "long": "bigint"}
CASTS = {"Utf8": "string", "LargeUtf8": "string", "LargeBinary": "binary", "UInt8": "smallint", "UInt16": "int", "UInt32": "bigint", "UInt64": "decimal(20,0)", "Date64": "date"}
#: Fixed: codes of a time's parts in patterns, and Spark's letters for them.
TIME_CODES = {"Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "p": "a", "j": "DDD", "b": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE", "F": "yyyy-MM-dd", "T": "HH:mm:ss", "D": "MM/dd/yy", "R": "HH:mm", "f": "SSSSSSSSS"}
NESTED = 5  # levels of arrays, maps and structs that a type's text may have


def _string(text: str) -> str | None:
    """The value of a plain string literal, else None."""
    m = re.fullmatch(r"\s*'((?:[^'\\]|'')*)'\s*", text)
    return m[1].replace("''", "'") if m else None


def _quoted(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _refuse(what: str):
    from .text import NotSupported

    raise NotSupported(what)


def arrow_typeof(x: str) -> str:
    """The type's text by replacement in Spark's text of it, leaves first, then containers from inside; it folds."""
    steps = [(rf"(^|[<:,]){SQL_NAMES.get(k, k)}(?=$|[,>])", f"$1{v}") for k, v in ARROW.items()]
    steps += [(r"decimal\((\d+),(\d+)\)", "Decimal128($1, $2)"), (r"([<,])([^<>:,]+):(?! )", '$1"$2": '), (',"', ', "')]
    steps += NESTED * [(r"array<([^<>]*)>", "List($1)"), (r"struct<([^<>]*)>", "Struct($1)"), (r"map<((?:[^<>,]|, )*),(?! )([^<>]*)>", 'Map("key_value": Struct("key": $1, "value": $2), unsorted)')]
    pairs = ", ".join(f"array({_quoted(a)}, {_quoted(b)})" for a, b in steps)
    return f"aggregate(array({pairs}), typeof({x}), (t, r) -> regexp_replace(t, element_at(r, 1), element_at(r, 2)))"


def arrow_cast(x: str, kind: str) -> str:
    """A cast to a type of the columnar format; unsigned ones become the next wider signed one."""
    name = _string(kind) or _refuse("arrow_cast to a type that is no literal")
    flat = {v: SQL_NAMES.get(k, k) for k, v in ARROW.items()} | CASTS
    if m := re.fullmatch(r"Decimal(?:128|256)\((\d+),\s*(\d+)\)", name):
        return f"cast({x} as decimal({m[1]},{m[2]}))"
    if m := re.fullmatch(r"Timestamp\(\w+(?:,\s*(None|Some\(.*\)|\".*\"))?\)", name):
        return f"cast({x} as {'timestamp_ntz' if m[1] in (None, 'None') else 'timestamp'})"
    return f"cast({x} as {flat[name]})" if name in flat else _refuse(f"arrow_cast to {name}")


def regexp_match(text: str, pattern: str, flags: str = "''") -> str:
    """The groups of the first match as an array, the whole match if there are none; null without a match."""
    own, f = _string(pattern), _string(flags)
    if own is None or f is None:
        _refuse("regexp_match with a pattern that is no plain literal")
    own = (f"(?{f})" if f else "") + own
    n = re.compile(own).groups
    groups = ", ".join(f"regexp_extract({text}, {_quoted(own)}, {k})" for k in (range(1, n + 1) if n else [0]))
    return f"(case when regexp_like({text}, {_quoted(own)}) then array({groups}) end)"


def to_char(x: str, pattern: str) -> str:
    """A time by a pattern of % codes."""
    own = _string(pattern)
    if own is None:
        _refuse("to_char with a pattern that is no plain literal")
    out = ""
    for m in re.finditer(r"%(.)|([A-Za-z]+)|(.)", own, re.S):
        if m[1] and m[1] != "%" and m[1] not in TIME_CODES:
            _refuse(f"the code %{m[1]} in to_char")
        out += ("%" if m[1] == "%" else TIME_CODES[m[1]]) if m[1] else f"'{m[2]}'" if m[2] else "''" if m[3] == "'" else f"'{m[3]}'" if m[3] in "#[]{}" else m[3]
    return f"date_format({x}, {_quoted(out)})"


def gcd(a: str, b: str) -> str:
    """Euclid's steps, of which 64-bit numbers need 92 at most."""
    return f"aggregate(sequence(1, 92), named_struct('a', cast({a} as bigint), 'b', cast({b} as bigint)), (s, i) -> if(s.b = 0, s, named_struct('a', s.b, 'b', s.a % s.b)), s -> abs(s.a))"


def lcm(a: str, b: str) -> str:
    return f"(case when {a} = 0 or {b} = 0 then 0L else abs(cast({a} as bigint)) div {gcd(a, b)} * abs(cast({b} as bigint)) end)"


def trunc(x: str, places: str = "0") -> str | None:
    """A number cut towards zero; Spark's own function cuts dates, by the name of a unit."""
    if not re.fullmatch(r"\s*-?\s*\d+\s*", places):
        return None
    whole = f"sign({x}) * floor(abs({x}) * pow(10, {places}))"
    return f"({whole} / pow(10, {places}))"


def encode(x: str, kind: str) -> str | None:
    return {"hex": f"lower(hex({x}))", "base64": f"rtrim('=', base64({x}))"}.get((_string(kind) or "").lower())


def decode(x: str, kind: str) -> str | None:
    return {"hex": f"unhex({x})", "base64": f"unbase64({x})"}.get((_string(kind) or "").lower())


#: Each function with the counts of arguments that it takes; calls with another count are left to Spark.
CALLS: dict[str, tuple[Callable[..., str | None], tuple[int, ...]]] = {
    "arrow_typeof": (arrow_typeof, (1,)),
    "arrow_cast": (arrow_cast, (2,)),
    "regexp_match": (regexp_match, (2, 3)),
    "to_char": (to_char, (2,)),
    "gcd": (gcd, (2,)),
    "lcm": (lcm, (2,)),
    "trunc": (trunc, (1, 2)),
    "encode": (encode, (2,)),
    "decode": (decode, (2,)),
}
