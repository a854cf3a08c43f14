"""Metastore type strings to Spark types."""

from __future__ import annotations

import re

from pyspark.sql import types as T

SIMPLE = {
    "tinyint": T.ByteType(), "smallint": T.ShortType(), "int": T.IntegerType(), "integer": T.IntegerType(), "bigint": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(),
    "boolean": T.BooleanType(), "string": T.StringType(), "binary": T.BinaryType(), "date": T.DateType(), "timestamp": T.TimestampNTZType(),
    "timestamp with local time zone": T.TimestampType(), "void": T.NullType(),
}


class TypeReader:
    def __init__(self, text: str) -> None:
        self.text, self.at = text, 0

    def fail(self, why: str):
        raise ValueError(f"type {self.text!r}: {why} at {self.at}")

    def take(self, pattern: str) -> str | None:
        m = re.compile(pattern, re.I).match(self.text, self.at)
        if m:
            self.at = m.end()
            return m[0]
        return None

    def want(self, pattern: str) -> str:
        got = self.take(pattern)
        return got if got is not None else self.fail(f"{pattern} is wanted")

    def read(self) -> T.DataType:
        name = self.want("timestamp with local time zone|[a-z]+").lower()
        if name in SIMPLE:
            return SIMPLE[name]
        if name in ("varchar", "char"):
            self.want(r"\(\d+\)")  # the length isn't enforced
            return T.StringType()
        if name == "decimal":
            p, s = 10, 0
            if given := self.take(r"\(\d+(,\d+)?\)"):
                p, _, s = given[1:-1].partition(",")
                p, s = int(p), int(s or 0)
            if not (1 <= p <= 38 and 0 <= s <= p):
                self.fail("precision or scale out of range")
            return T.DecimalType(p, s)
        if name == "array":
            return T.ArrayType(self._inside())
        if name == "map":
            self.want("<")
            key = self.read()
            self.want(",")
            value = self.read()
            self.want(">")
            return T.MapType(key, value)
        if name in ("struct", "uniontype"):
            self.want("<")
            fields = []
            while not self.take(">"):
                if fields:
                    self.want(",")
                if name == "struct":
                    field = self.want("[^:<>,]+")
                    self.want(":")
                else:
                    field = f"_union_{len(fields)}"  # no union type here: nullable members
                fields.append(T.StructField(field, self.read()))
            return T.StructType(fields)
        return self.fail(f"unknown type {name}")

    def _inside(self) -> T.DataType:
        self.want("<")
        out = self.read()
        self.want(">")
        return out


def parse_type(text: str) -> T.DataType:
    reader = TypeReader(text.strip())
    out = reader.read()
    if reader.at != len(reader.text):
        reader.fail("text is left over")
    return out


def table_schema(columns: list[tuple[str, str]], partitions: list[tuple[str, str]]) -> T.StructType:
    """Data columns, then partition columns, all nullable."""
    return T.StructType([T.StructField(n, parse_type(t), True) for n, t in [*columns, *partitions]])
