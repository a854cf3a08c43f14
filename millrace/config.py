"""Strict TOML configuration: the server's settings, and catalogs with their storage."""

from __future__ import annotations

import re
import tomllib
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from .catalogs.base import Catalog, FileCatalog
from .catalogs.generated import TpchCatalog
from .catalogs.keyed import KeyedCatalog
from .sql.text import NotSupported, SqlError

STORAGE = ("s3-storage", "oss-storage")
#: Fixed: the keys that each kind of catalog needs, and those it may have.
KINDS = {
    "tpch": ((), ()),
    "tpcds": ((), ()),
    "files": (("schemas",), STORAGE),  # our own: schema name to folder
    "paimon-fs": (("warehouse",), STORAGE),
    "hms": (("metastore-uri",), STORAGE),
    "glue": ((), ("aws-glue-region", "aws-glue-endpoint", "aws-glue-access-key", "aws-glue-secret-key", *STORAGE)),
    "iceberg-rest": (("uri",), ("warehouse", "token", *STORAGE)),
}
#: Fixed: storage keys and the Hadoop settings they stand for.
S3 = {"region": "endpoint.region", "endpoint": "endpoint", "access-key": "access.key", "secret-key": "secret.key", "session-token": "session.token", "path-style-access": "path.style.access"}
OSS = {"endpoint": "endpoint", "access-key": "accessKeyId", "secret-key": "accessKeySecret", "path-style-access": "path.style.access"}
UNITS = {"": 0, "b": 0, "k": 10, "kb": 10, "m": 20, "mb": 20, "g": 30, "gb": 30, "t": 40, "tb": 40}
PORT = 32010


class Remote(Catalog):
    """A catalog that is listed but can't be reached: its client isn't built in."""

    def __init__(self, kind: str) -> None:
        self.kind = kind.upper()

    def schemas(self) -> list[str]:
        raise NotSupported(f"{self.kind} catalogs need a client that isn't built in")

    def tables(self, schema: str) -> list[str]:
        return self.schemas()

    def load(self, spark: SparkSession, schema: str, table: str) -> DataFrame:
        self.schemas()
        raise AssertionError


@dataclass
class Config:
    """memory_limit in bytes (None: Spark's own), port, catalogs by name, Hadoop settings for their storage."""

    memory_limit: int | None = None
    port: int = PORT
    catalogs: dict[str, Catalog] = field(default_factory=dict)
    hadoop: dict[str, str] = field(default_factory=dict)


def memory(text: str) -> int:
    """Bytes of a size with an optional binary unit."""
    m = re.fullmatch(r"\s*(\d+)\s*([a-z]*)\s*", text, re.I)
    if not m or m[2].lower() not in UNITS or not int(m[1]):
        raise SqlError(f"not a size: {text!r}")
    return int(m[1]) << UNITS[m[2].lower()]


def _keys(where: str, given: dict, needed: tuple[str, ...], more: tuple[str, ...] = ()) -> None:
    if unknown := sorted(set(given) - set(needed) - set(more)):
        raise SqlError(f"unknown keys in {where}: {', '.join(unknown)}")
    if missing := sorted(set(needed) - set(given)):
        raise SqlError(f"{where} lacks {', '.join(missing)}")


def storage(block: dict, kind: str, bucket: str = "") -> dict[str, str]:
    """Hadoop settings of a storage block, of one bucket if that is known, so that catalogs don't share keys."""
    names, scheme = (S3, "fs.s3a") if kind == "s3-storage" else (OSS, "fs.oss")
    _keys(kind, block, () if names is S3 else ("endpoint",), tuple(names))
    prefix = f"{scheme}.bucket.{bucket}" if bucket and names is S3 else scheme
    return {f"{prefix}.{names[k]}": str(v).lower() if isinstance(v, bool) else v for k, v in block.items()}


def _catalog(kind: str, own: dict) -> Catalog:
    if kind == "tpch":
        return TpchCatalog()
    if kind == "files":
        return FileCatalog(dict(own["schemas"]))
    if kind == "paimon-fs":
        warehouse = own["warehouse"]
        return KeyedCatalog(warehouse) if re.match(r"file:|/", warehouse) else Remote(kind)
    return Remote(kind)


def load(text: str) -> Config:
    """The configuration; unknown tables and keys and repeated catalog names are refused."""
    try:
        given = tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        raise SqlError(f"configuration: {e}") from e
    _keys("the configuration", given, (), ("server", "catalog"))
    out, server = Config(), given.get("server", {})
    _keys("[server]", server, (), ("memory-limit", "server-port"))
    out.memory_limit = memory(server["memory-limit"]) if "memory-limit" in server else None
    out.port = server.get("server-port", PORT)
    if unknown := sorted(set(given.get("catalog", {})) - set(KINDS)):
        raise SqlError(f"unknown kinds of catalog: {', '.join(unknown)}")
    for kind, blocks in given.get("catalog", {}).items():
        for own in blocks:
            needed, more = KINDS[kind]
            _keys(f"[[catalog.{kind}]]", own, ("name", *needed), more)
            if own["name"] in out.catalogs or own["name"] == "internal":
                raise SqlError(f"two catalogs are named {own['name']!r}")
            out.catalogs[own["name"]] = _catalog(kind, own)
            for s in STORAGE:
                if s in own:
                    bucket = re.match(r"s3a?://([^/]+)", str(own.get("warehouse", "")))
                    out.hadoop |= storage(own[s], s, bucket[1] if bucket else "")
    return out


def read(path: str) -> Config:
    return load(Path(path).read_text(encoding="utf-8"))
