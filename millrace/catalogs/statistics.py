"""What a metastore tells of a table's size and columns; all of it is inexact, and None stands for what isn't known."""

from __future__ import annotations

import datetime as dt
import re
import time
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from decimal import Decimal
from typing import Any

from pyspark.sql import types as T

COLUMNS = 100  # columns that one request asks for
REQUESTS = 4  # requests at the same time
TTL = 3600.0  # seconds that statistics are kept
VARIABLE = 16  # bytes that a value without a fixed width is taken for
#: Fixed widths in bytes, and ranges of whole numbers by width.
WIDTHS = {"byte": 1, "short": 2, "integer": 4, "long": 8, "float": 4, "double": 8, "date": 4, "timestamp": 8, "timestamp_ntz": 8, "decimal": 16}
WHOLE = ("byte", "short", "integer", "long")


@dataclass(frozen=True)
class Column:
    nulls: int | None = None
    distinct: int | None = None
    low: Any = None
    high: Any = None


@dataclass(frozen=True)
class Statistics:
    rows: int | None = None
    size: int | None = None
    columns: dict[str, Column] = field(default_factory=dict)


def _count(value: Any) -> int | None:
    """A count of zero or more; text that is no such number tells nothing."""
    text = str(value).strip()
    return int(text) if re.fullmatch(r"\+?\d+", text) else None


def from_properties(properties: dict[str, str]) -> Statistics:
    """``numRows``, and ``rawDataSize`` if it is there, else ``totalSize``."""
    size = "rawDataSize" if "rawDataSize" in properties else "totalSize"
    return Statistics(_count(properties.get("numRows")), _count(properties.get(size)))


def row_width(schema: T.StructType) -> int:
    return max(1, sum(WIDTHS.get(f.dataType.typeName(), VARIABLE) for f in schema))


def estimated_rows(schema: T.StructType, size: int) -> int:
    """Bytes of the files by the width of a row; one at least if there are bytes."""
    return max(1, size // row_width(schema)) if size else 0


def from_files(known: Statistics, schema: T.StructType, sizes: Iterable[int], pruned: bool) -> Statistics:
    """What isn't known is taken from the files to read; after pruning the whole table's numbers don't hold."""
    total = sum(sizes)
    if pruned:
        known = replace(known, rows=None, size=None)
    return replace(known, rows=estimated_rows(schema, total) if known.rows is None else known.rows, size=total if known.size is None else known.size)


def _fitting(value: Any, kind: T.DataType) -> Any:
    """A bound as a value of the column's type; None if the type can't hold it."""
    name = kind.typeName()
    if name in WHOLE and isinstance(value, int) and not isinstance(value, bool):
        half = 1 << (8 * WIDTHS[name] - 1)
        return value if -half <= value < half else None
    if name in ("float", "double") and isinstance(value, int | float):
        return float(value) if name == "double" or not abs(value) > 3.4028234663852886e38 else None
    if isinstance(kind, T.DecimalType) and isinstance(value, Decimal | str):
        own = Decimal(value)
        scaled = own.scaleb(kind.scale)
        return own if scaled == scaled.to_integral_value() and abs(scaled) < 10**kind.precision else None
    if name == "date" and isinstance(value, dt.date):
        return value.date() if isinstance(value, dt.datetime) else value
    if name in ("timestamp", "timestamp_ntz") and isinstance(value, dt.datetime):
        return value
    return None


def column(told: dict[str, Any], kind: T.DataType) -> Column:
    """A metastore's entry ``{type, nulls, distinct, low, high, trues, falses}`` for a column of some type."""
    nulls, distinct, name = _count(told.get("nulls")), _count(told.get("distinct")), kind.typeName()
    match told.get("type"):
        case "BOOLEAN" if name == "boolean":
            there = [v for v, k in ((False, "falses"), (True, "trues")) if (_count(told.get(k)) or 0) > 0]
            if _count(told.get("falses")) is None or _count(told.get("trues")) is None:
                return Column(nulls)
            return Column(nulls, len(there), there[0] if there else None, there[-1] if there else None)
        case "LONG" | "DOUBLE" | "DECIMAL" | "DATE":
            return Column(nulls, distinct, _fitting(told.get("low"), kind), _fitting(told.get("high"), kind))
        case "STRING" if name == "string":
            return Column(nulls, distinct)
        case "BINARY" if name == "binary":
            return Column(nulls)
    return Column()


def columns(ask: Callable[[list[str]], dict[str, dict[str, Any]]], schema: T.StructType) -> tuple[dict[str, Column], bool]:
    """Columns by name, and whether every request was answered; one that fails leaves its columns out."""
    names = schema.names
    parts = [names[k : k + COLUMNS] for k in range(0, len(names), COLUMNS)]

    def one(part: list[str]) -> dict[str, dict[str, Any]] | None:
        try:
            return ask(part)
        except Exception:  # noqa: BLE001  statistics never stop a query
            return None

    with ThreadPoolExecutor(REQUESTS) as pool:
        answers = list(pool.map(one, parts))
    out = {n: column(told, schema[n].dataType) for a in answers if a for n, told in a.items() if n in names}
    return out, all(a is not None for a in answers)


class Cache:
    """Statistics by table for an hour; another schema of the table ends them, and incomplete ones aren't kept."""

    def __init__(self, ttl: float = TTL, clock: Callable[[], float] = time.monotonic) -> None:
        self.ttl, self.clock = ttl, clock
        self.kept: dict[Any, tuple[float, T.StructType, Statistics]] = {}

    def get(self, key: Any, schema: T.StructType, load: Callable[[], tuple[Statistics, bool]]) -> Statistics:
        if key in self.kept:
            end, own, found = self.kept[key]
            if self.clock() < end and own == schema:
                return found
            del self.kept[key]
        found, complete = load()
        if complete:
            self.kept[key] = (self.clock() + self.ttl, schema, found)
        return found
