"""Functions of the dialect."""

import pytest

from millrace.sql.engine import Engine
from millrace.sql.text import NotSupported


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("gcd(12, 18)", 6),
        ("gcd(0, 7)", 7),
        ("gcd(null, 4)", None),
        ("gcd(-9223372036854775807, 7)", 7),
        ("lcm(4, 6)", 12),
        ("lcm(0, 3)", 0),
        ("lcm(-3, 5)", 15),
        ("trunc(-1.567)", -1.0),
        ("trunc(1.567, 2)", 1.56),
        ("cast(trunc(date'2024-03-05', 'MM') as string)", "2024-03-01"),
        ("regexp_match('foobar', '(o+)(b)')", ["oo", "b"]),
        ("regexp_match('foobar', 'o+')[1]", "oo"),
        ("regexp_match('x', 'o')", None),
        ("regexp_match('FOO', 'o+', 'i')", ["OO"]),
        ("to_char(timestamp'2024-03-05 13:04:05', '%Y-%m-%dT%H:%M:%S')", "2024-03-05T13:04:05"),
        ("to_char(date'2024-03-05', '%d of %B, %y%%')", "05 of March, 24%"),
        ("arrow_typeof(map('a', named_struct('int', 1, 'y', make_array(1.5))))", 'Map("key_value": Struct("key": Utf8View, "value": Struct("int": Int32, "y": List(Decimal128(2, 1)))), unsorted)'),
        ("arrow_typeof(arrow_cast('2024-01-01', 'Timestamp(Microsecond, None)'))", "Timestamp(µs)"),
        ("arrow_cast('7', 'Int32')", 7),
        ("encode('ab', 'base64')", "YWI"),
        ("cast(decode('6162', 'hex') as string)", "ab"),
        ("decode(encode('h', 'UTF-8'), 'UTF-8')", "h"),
    ],
)
def test_value(spark, text, want):
    assert Engine(spark).sql(f"select {text}").first()[0] == want


@pytest.mark.parametrize("text", ["regexp_match('a', concat('a', 'b'))", "to_char(current_date(), '%Q')", "arrow_cast(1, 'Nothing')"])
def test_refused(spark, text):
    with pytest.raises(NotSupported):
        Engine(spark).sql(f"select {text}")
