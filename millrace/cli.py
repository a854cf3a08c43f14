"""The command line: ``python -m millrace --config FILE [--command SQL | --file FILE]``, or a prompt."""

from __future__ import annotations

import argparse
import csv
import io
import sys
import time
import unicodedata
from pathlib import Path
from typing import Any, TextIO

from pyspark.sql import DataFrame

from . import config
from .session import session
from .sql.engine import Engine
from .sql.text import split

PREVIEW = 1000  # rows that the prompt shows
CSV_ROWS = 10_000


def _cell(v: Any) -> str:
    if v is None:
        return ""
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, bytes | bytearray):
        return v.hex()
    return str(v)


def _width(text: str) -> int:
    """Columns on a terminal: wide characters take two, marks none."""
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def table(names: list[str], rows: list[tuple], box: bool = False) -> str:
    """An ASCII table, or one in box characters; nothing if there are no columns."""
    if not names:
        return ""
    lines = [[_cell(v) for v in row] for row in rows]
    wide = [max(map(_width, [n, *(r[k] for r in lines)])) for k, n in enumerate(names)]

    def rule(left: str, fill: str, middle: str, right: str) -> str:
        return left + middle.join(fill * (w + 2) for w in wide) + right

    def row(cells: list[str], bar: str) -> str:
        return bar + bar.join(f" {c}{' ' * (w - _width(c))} " for c, w in zip(cells, wide, strict=True)) + bar

    if not box:
        edge = rule("+", "-", "+", "+")
        return "\n".join([edge, row(names, "|"), edge, *(row(r, "|") for r in lines), *([edge] if lines else [])])
    out = [rule("╭", "─", "┬", "╮"), row(names, "│"), rule("╞", "═", "╪", "╡")]
    for k, r in enumerate(lines):
        out += ([rule("├", "─", "┼", "┤")] if k else []) + [row(r, "│")]
    return "\n".join([*out, rule("╰", "─", "┴", "╯")])


def to_csv(df: DataFrame, most: int = CSV_ROWS) -> str:
    """RFC 4180 text with a byte order mark, of at most ``most`` rows: for a viewer, not for data (``df.write.csv`` is)."""
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\r\n")
    writer.writerow(df.columns)
    writer.writerows([[_cell(v) for v in r] for r in df.limit(most).collect()])
    return "﻿" + out.getvalue()


def show(df: DataFrame, out: TextIO, began: float, box: bool = False) -> None:
    """The rows (at the prompt the first PREVIEW), their number and the time."""
    rows = [tuple(r) for r in (df.limit(PREVIEW + 1) if box else df).collect()] if df.columns else []
    if text := table(df.columns, rows[:PREVIEW] if box else rows, box):
        print(text, file=out)
    more = f" The first {PREVIEW} are shown." if box and len(rows) > PREVIEW else ""
    print(f"{min(len(rows), PREVIEW) if box else len(rows)} row(s) fetched.{more}\nElapsed {time.perf_counter() - began:.3f} seconds.\n", file=out)


def run(engine: Engine, text: str, out: TextIO, box: bool = False) -> None:
    for statement in split(text):
        began = time.perf_counter()
        show(engine.execute(statement), out, began, box)


def prompt(engine: Engine, lines: TextIO, out: TextIO) -> None:
    """Statements from lines until ``quit;`` or the end; an error ends its statement only."""
    text = ""
    print("Statements end with ';'; 'quit;' leaves.", file=out)
    for line in lines:
        text += line
        if not text.rstrip().endswith(";"):
            continue
        if text.strip().rstrip(";").strip().lower() in ("quit", "exit"):
            break
        try:
            run(engine, text, out, box=True)
        except Exception as e:  # noqa: BLE001  whatever a statement raises is shown
            print(f"Error: {e}", file=out)
        text = ""


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser("millrace")
    parser.add_argument("--config", required=True)
    what = parser.add_mutually_exclusive_group()
    what.add_argument("--command")
    what.add_argument("--file")
    args = parser.parse_args(argv)
    own = config.read(args.config)
    memory = {"spark.driver.memory": f"{max(own.memory_limit >> 20, 512)}m"} if own.memory_limit else {}
    spark = session(**{k.replace(".", "__"): v for k, v in memory.items()} | {f"spark.hadoop.{k}".replace(".", "__"): v for k, v in own.hadoop.items()})
    engine = Engine(spark, own.catalogs)
    text = args.command if args.command is not None else Path(args.file).read_text(encoding="utf-8") if args.file else None
    if text is None:
        prompt(engine, sys.stdin, sys.stdout)
        return 0
    try:
        run(engine, text, sys.stdout)
    except Exception as e:  # noqa: BLE001
        print(f"Error: {e}", file=sys.stderr)
        return 1
    return 0
