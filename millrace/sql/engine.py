"""The engine: statements in, DataFrames out, over several catalogs."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalogs.base import Catalog, InternalCatalog, TableInfo
from .functions import ARROW
from .resolve import replace_tables
from .text import NotSupported, SqlError, literal, rewrite, split, unquote, words


def _names(text: str) -> list[str]:
    """Parts of a possibly quoted, dotted name."""
    parts = re.findall(r"`(?:[^`]|``)*`|[^.\s]+", text.strip())
    return [unquote(p) if p.startswith("`") else p.lower() for p in parts]


NAME = r"((?:`(?:[^`]|``)*`|[\w$]+)(?:\s*\.\s*(?:`(?:[^`]|``)*`|[\w$]+))*)"


class Engine:
    """One session: a current catalog and schema, and the catalogs by name."""

    def __init__(self, spark: SparkSession, catalogs: dict[str, Catalog] | None = None) -> None:
        self.spark = spark
        self.catalogs: dict[str, Catalog] = {"internal": InternalCatalog(), **(catalogs or {})}
        self.catalog, self.schema = "internal", "information_schema"

    # -------------------------------------------------- entry
    def script(self, text: str) -> list[DataFrame]:
        """Run the statements of a script in order."""
        return [self.execute(s) for s in split(text)]

    def sql(self, text: str) -> DataFrame:
        """Run exactly one statement."""
        own = split(text)
        if len(own) != 1:
            raise SqlError(f"one statement is wanted, not {len(own)}")
        return self.execute(own[0])

    def execute(self, sql: str) -> DataFrame:
        head = [w.lower() for w in words(sql)[:3]]
        for start, run in (
            (("show", "catalogs"), self._show_catalogs), (("show", "schemas"), self._show_schemas), (("show", "databases"), self._show_schemas), (("show", "tables"), self._show_tables),
            (("show", "variables"), self._show_variables), (("show", "create"), self._show_create), (("use",), self._use), (("describe",), self._describe), (("desc",), self._describe),
            (("create", "schema"), self._create_schema), (("create", "database"), self._create_schema), (("drop", "schema"), self._drop_schema), (("drop", "database"), self._drop_schema),
            (("create", "table"), self._create_table), (("drop", "table"), self._drop_table), (("insert",), self._insert), (("call",), self._call), (("set",), self._set), (("explain",), self._explain),
        ):
            if tuple(head[: len(start)]) == start:
                return run(sql.strip())
        if head and head[0] in ("select", "with", "values", "(", "from", "table"):
            return self.query(sql)
        raise NotSupported(f"statement {' '.join(head)!r}")

    def query(self, sql: str) -> DataFrame:
        views: list[str] = []

        def view(parts: list[str]) -> str:
            views.append(self._view(parts))
            return views[-1]

        try:
            df = self.spark.sql(replace_tables(self.spark, rewrite(sql), view))
        finally:
            for v in views:  # the plan has their relations by now
                self.spark.catalog.dropTempView(v)
        if "count(1)" in df.columns and re.search(r"\bcount\s*\(\s*\*\s*\)", sql, re.I):
            df = df.toDF(*["count(*)" if c == "count(1)" else c for c in df.columns])
        return df

    # -------------------------------------------------- names
    def resolve(self, parts: list[str]) -> tuple[Catalog, str, str]:
        if not 1 <= len(parts) <= 3:
            raise SqlError(f"a table name has one to three parts: {'.'.join(parts)}")
        *scope, table = parts
        schema = scope[-1] if scope else self.schema
        name = scope[0] if len(scope) == 2 else self.catalog
        if name not in self.catalogs:
            raise SqlError(f"catalog {name!r} doesn't exist")
        return self.catalogs[name], schema, table

    def table(self, name: str) -> DataFrame:
        catalog, schema, table = self.resolve(_names(name))
        return catalog.load(self.spark, schema, table)

    def _view(self, parts: list[str]) -> str:
        catalog, schema, table = self.resolve([p.lower() for p in parts])
        view = f"millrace_{uuid.uuid4().hex}"
        catalog.load(self.spark, schema, table).createOrReplaceTempView(view)
        return view

    def _frame(self, rows: list[tuple], ddl: str) -> DataFrame:
        return self.spark.createDataFrame(rows, ddl)

    def _nothing(self) -> DataFrame:
        from pyspark.sql.types import StructType

        return self.spark.createDataFrame([], StructType())

    @staticmethod
    def _match(pattern: str, sql: str) -> re.Match:
        m = re.fullmatch(pattern, sql.strip(), re.I | re.S)
        if not m:
            raise SqlError(f"can't read: {sql}")
        return m

    # -------------------------------------------------- SHOW, USE, DESCRIBE
    def _listed(self, rows: list[tuple], ddl: str, like: str | None) -> DataFrame:
        df = self._frame(rows, ddl)
        first = df.columns[0]
        return (df.where(F.col(first).like(literal(like))) if like else df).orderBy(first)

    def _show_catalogs(self, sql: str) -> DataFrame:
        m = self._match(r"show\s+catalogs(?:\s+like\s+('.*'))?", sql)
        return self._listed([(n, c.kind) for n, c in self.catalogs.items()], "catalog_name string, catalog_type string", m[1])

    def _show_schemas(self, sql: str) -> DataFrame:
        m = self._match(r"show\s+(?:schemas|databases)(?:\s+(?:from|in)\s+([^\s']+))?(?:\s+like\s+('.*'))?", sql)
        catalog = self._catalog(unquote(m[1]) if m[1] else self.catalog)
        return self._listed([(s,) for s in catalog.schemas()], "schema_name string", m[2])

    def _catalog(self, name: str) -> Catalog:
        if name not in self.catalogs:
            raise SqlError(f"catalog {name!r} doesn't exist")
        return self.catalogs[name]

    def _show_tables(self, sql: str) -> DataFrame:
        m = self._match(rf"show\s+tables(?:\s+(?:from|in)\s+{NAME})?(?:\s+like\s+('.*'))?", sql)
        scope = [unquote(p) for p in re.findall(r"`[^`]*`|[^.\s]+", m[1])] if m[1] else []
        if len(scope) > 2:
            raise SqlError("a schema has a catalog at most before it")
        catalog, schema = self._catalog(scope[0] if len(scope) == 2 else self.catalog), scope[-1] if scope else self.schema
        catalog.require(schema)
        return self._listed([(t,) for t in catalog.tables(schema)], "table_name string", m[2])

    def _show_variables(self, sql: str) -> DataFrame:
        m = self._match(r"show\s+variables(?:\s+like\s+('.*'))?", sql)
        df = self.catalogs["internal"].load(self.spark, "information_schema", "variables")
        return (df.where(F.col("name").like(literal(m[1]))) if m[1] else df).orderBy("name")

    def _use(self, sql: str) -> DataFrame:
        m = self._match(rf"use\s+(catalog\s+)?{NAME}", sql)
        parts = [unquote(p) for p in re.findall(r"`[^`]*`|[^.\s]+", m[2])]
        if m[1]:
            if len(parts) != 1:
                raise SqlError("USE CATALOG takes one name")
            self._catalog(parts[0])
            self.catalog = parts[0]
            return self._nothing()
        if len(parts) > 2:
            raise SqlError("USE takes a schema, with a catalog before it at most")
        name = parts[0] if len(parts) == 2 else self.catalog
        self._catalog(name).require(parts[-1])  # both are checked before either changes
        self.catalog, self.schema = name, parts[-1]
        return self._nothing()

    def _describe(self, sql: str) -> DataFrame:
        m = self._match(rf"desc(?:ribe)?\s+(?:table\s+)?{NAME}", sql)
        rows = [(f.name, sql_type(f.dataType), arrow_type(f.dataType), "YES" if f.nullable else "NO") for f in self.table(m[1]).schema]
        return self._frame(rows, "column_name string, sql_type string, data_type string, is_nullable string")

    def _show_create(self, sql: str) -> DataFrame:
        m = re.fullmatch(rf"show\s+create\s+table\s+{NAME}", sql, re.I | re.S)
        if not m:
            raise NotSupported("only SHOW CREATE TABLE is supported")
        catalog, schema, table = self.resolve(_names(m[1]))
        name = next(n for n, c in self.catalogs.items() if c is catalog)
        return self._frame([(definition([name, schema, table], catalog.info(self.spark, schema, table)),)], "definition string")

    # -------------------------------------------------- DDL
    def _schema_target(self, name: str) -> tuple[Catalog, str]:
        parts = _names(name)
        if len(parts) > 2:
            raise SqlError("a schema has a catalog at most before it")
        return self._catalog(parts[0] if len(parts) == 2 else self.catalog), parts[-1]

    def _create_schema(self, sql: str) -> DataFrame:
        m = re.fullmatch(rf"create\s+(?:schema|database)\s+(if\s+not\s+exists\s+)?{NAME}", sql, re.I | re.S)
        if not m:
            raise NotSupported("CREATE SCHEMA takes a name and IF NOT EXISTS only")
        catalog, schema = self._schema_target(m[2])
        catalog.create_schema(schema, bool(m[1]))
        return self._nothing()

    def _drop_schema(self, sql: str) -> DataFrame:
        m = self._match(rf"drop\s+(?:schema|database)\s+(if\s+exists\s+)?{NAME}(?:\s+(cascade|restrict))?", sql)
        catalog, schema = self._schema_target(m[2])
        catalog.drop_schema(schema, bool(m[1]), (m[3] or "").lower() == "cascade")
        return self._nothing()

    def _drop_table(self, sql: str) -> DataFrame:
        m = re.fullmatch(rf"drop\s+table\s+(if\s+exists\s+)?{NAME}", sql, re.I | re.S)
        if not m:
            raise NotSupported("DROP TABLE takes a name and IF EXISTS only")
        catalog, schema, table = self.resolve(_names(m[2]))
        catalog.drop_table(schema, table, bool(m[1]))
        return self._nothing()

    def _create_table(self, sql: str) -> DataFrame:
        m = self._match(rf"create\s+table\s+(if\s+not\s+exists\s+)?{NAME}\s*(.*)", sql)
        catalog, schema, table = self.resolve(_names(m[2]))
        rest, rows = m[3].strip(), None
        info = TableInfo([])
        if like := re.fullmatch(rf"like\s+{NAME}", rest, re.I | re.S):
            info.columns = [(f.name, f.dataType.simpleString(), f.nullable) for f in self.table(like[1]).schema]
        else:
            if rest.startswith("("):
                inside, rest = bracketed(rest)
                info.columns, info.primary_key = columns(inside)
            while rest and not re.match(r"as\b", rest, re.I):
                if p := re.match(r"partitioned\s+by\s*(?=\()", rest, re.I):
                    inside, rest = bracketed(rest[p.end() :])
                    info.partitions = [unquote(x.strip()) for x in inside.split(",")]
                elif p := re.match(r"using\s+(\w+)", rest, re.I):
                    info.using, rest = p[1].lower(), rest[p.end() :].strip()
                    if info.using != "paimon":
                        raise NotSupported(f"USING {info.using}")
                elif p := re.match(r"(?:with|options|tblproperties)\s*(?=\()", rest, re.I):
                    inside, rest = bracketed(rest[p.end() :])
                    info.options = {unquote(k) if k[0] == "`" else k.strip("'\""): v for k, v in ((a, literal(b)) for a, b in re.findall(r"""('[^']*'|"[^"]*"|`[^`]*`|[\w.\-]+)\s*=\s*('[^']*'|"[^"]*")""", inside))}
                else:
                    raise NotSupported(f"in CREATE TABLE: {rest[:40]}")
            if rest:
                if info.columns:
                    raise NotSupported("CREATE TABLE AS takes no column list")
                rows = self.query(re.sub(r"^as\s+", "", rest, flags=re.I))  # analysed before the table is made
                info.columns = [(f.name, f.dataType.simpleString(), f.nullable) for f in rows.schema]
        if not info.columns:
            raise SqlError("a table needs columns")
        made = catalog.create_table(self.spark, schema, table, info, bool(m[1]))
        if made and rows is not None:  # if this fails the empty table stays
            catalog.insert(self.spark, schema, table, rows, False)
        return self._nothing()

    def _insert(self, sql: str) -> DataFrame:
        m = self._match(rf"insert\s+(into|overwrite)\s+(?:table\s+)?{NAME}\s*(\((?=[^()]*\)\s*(?:select|values|with|\())[^()]*\))?\s*(.*)", sql)
        catalog, schema, table = self.resolve(_names(m[2]))
        rows = self.query(m[4])
        if m[3]:
            given = [unquote(c.strip()).lower() for c in m[3][1:-1].split(",")]
            want = catalog.load(self.spark, schema, table).schema
            if len(given) != len(rows.columns) or not set(given) <= {f.name.lower() for f in want}:
                raise SqlError("the column list doesn't fit")
            rows = rows.toDF(*given).select(*[F.col(f.name) if f.name.lower() in given else F.lit(None).cast(f.dataType).alias(f.name) for f in want])
        return self._frame([(catalog.insert(self.spark, schema, table, rows, m[1].lower() == "overwrite"),)], "count long")

    def _call(self, sql: str) -> DataFrame:
        m = self._match(r"call\s+(\w+)\s*\.\s*(\w+)\s*\((.*)\)", sql)
        args = {k.lower(): v for k, v in re.findall(r"(\w+)\s*=>\s*('(?:[^']|'')*'|[\w.]+)", m[3])}
        if m[1].lower() != "paimon" or "table" not in args:
            raise NotSupported("CALL paimon.<procedure>(table => '...')")
        catalog, schema, table = self.resolve(_names(literal(args.pop("table"))))
        catalog.call(self.spark, m[2].lower(), schema, table, {k: literal(v) if v[0] == "'" else v for k, v in args.items()})
        return self._frame([("OK",)], "result string")

    #: Option names of the dialect that stand for a Spark setting.
    OPTIONS = {"datafusion.execution.target_partitions": "spark.sql.shuffle.partitions", "datafusion.execution.time_zone": "spark.sql.session.timeZone"}

    def _set(self, sql: str) -> DataFrame:
        m = self._match(r"set\s+([\w.]+)\s*(?:=|\bto\b)\s*(.+)", sql)
        self.spark.conf.set(self.OPTIONS.get(m[1], m[1]), m[2].strip().strip("'\""))
        return self._nothing()

    def _explain(self, sql: str) -> DataFrame:
        m = self._match(r"explain\s+(analyze\s+)?(?:format\s+\w+\s+)?(.*)", sql)
        df = self.query(m[2])
        if m[1]:
            df.write.format("noop").mode("overwrite").save()
        text = df._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        return self._frame([("plan", text)], "plan_type string, plan string")


def bracketed(text: str) -> tuple[str, str]:
    """What stands in the bracket at the begin, and the rest."""
    depth = 0
    for k, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if not depth:
            return text[1:k], text[k + 1 :].strip()
    raise SqlError("a bracket isn't closed")


def columns(text: str) -> tuple[list[tuple[str, str, bool]], list[str]]:
    """Columns (name, type, nullable) and primary key of a column list."""
    items, depth, own = [], 0, ""
    for c in text + ",":
        depth += (c in "(<") - (c in ")>")
        if c == "," and not depth:
            items.append(own.strip())
            own = ""
        else:
            own += c
    out, key = [], []
    for item in items:
        if m := re.fullmatch(r"primary\s+key\s*\((.*)\)(?:\s+not\s+enforced)?", item, re.I | re.S):
            key = [unquote(x.strip()) for x in m[1].split(",")]
            continue
        m = re.fullmatch(r"(`[^`]*`|\w+)\s+(.+?)(\s+not\s+null|\s+null)?(\s+primary\s+key)?(?:\s+comment\s+'.*')?", item, re.I | re.S)
        if not m:
            raise SqlError(f"can't read the column: {item}")
        kind = re.sub(r"\bint64\b", "bigint", m[2], flags=re.I)
        kind = re.sub(r"\b(?:timestamp(?:\(\d\))?)(?!\s*with)(?!_)", "timestamp_ntz", kind, flags=re.I)
        kind = re.sub(r"\bvarbinary\b|\bbinary\(\d+\)", "binary", kind, flags=re.I)
        name = unquote(m[1]) if m[1][0] == "`" else m[1].lower()
        out.append((name, kind.strip(), not (m[3] and "not" in m[3].lower())))
        key += [name] if m[4] else []
    return out, key


def sql_type(t) -> str:
    """The SQL display name of a type."""
    name = t.typeName()
    if name == "array":
        return f"ARRAY<{sql_type(t.elementType)}>"
    if name == "map":
        return f"MAP<{sql_type(t.keyType)}, {sql_type(t.valueType)}>"
    if name == "struct":
        return "STRUCT<" + ", ".join(f"`{f.name}` {sql_type(f.dataType)}" for f in t.fields) + ">"
    if name == "decimal":
        return f"DECIMAL({t.precision}, {t.scale})"
    fixed = {"byte": "TINYINT", "short": "SMALLINT", "integer": "INT", "long": "BIGINT", "timestamp_ntz": "TIMESTAMP(6)", "timestamp": "TIMESTAMP(6) WITH TIME ZONE", "void": "NULL"}
    return fixed.get(name, name.upper())


def arrow_type(t) -> str:
    """The name of a type in the columnar format."""
    name = t.typeName()
    if name == "array":
        return f"List({arrow_type(t.elementType)})"
    if name == "map":
        return f'Map("key_value": Struct("key": {arrow_type(t.keyType)}, "value": {arrow_type(t.valueType)}), unsorted)'
    if name == "struct":
        return "Struct(" + ", ".join(f'"{f.name}": {arrow_type(f.dataType)}' for f in t.fields) + ")"
    if name == "decimal":
        return f"Decimal128({t.precision}, {t.scale})"
    return ARROW.get(name, name)


def definition(name: list[str], info: TableInfo) -> str:
    """CREATE TABLE text: the full name, back-quoted names, a line for each column, sorted options."""
    from pyspark.sql.types import StructType

    def quoted(name: str) -> str:
        return "`" + name.replace("`", "``") + "`"

    def text(value: str) -> str:
        return "'" + value.replace("'", "''") + "'"

    kinds = StructType.fromDDL(", ".join(f"{quoted(c)} {k}" for c, k, _ in info.columns))
    lines = [f"{quoted(c)} {sql_type(f.dataType)}" + ("" if n else " NOT NULL") for (c, _, n), f in zip(info.columns, kinds, strict=True)]
    if info.primary_key:
        lines.append(f"PRIMARY KEY ({', '.join(map(quoted, info.primary_key))})")
    out = f"CREATE TABLE {'.'.join(map(quoted, name))}\n(\n" + ",\n".join(lines) + "\n)"
    if info.partitions:
        out += f"\nPARTITIONED BY ({', '.join(map(quoted, info.partitions))})"
    if info.using:
        out += f"\nUSING {info.using.upper()}"
    if info.location:
        out += f"\nLOCATION {text(info.location)}"
    if info.options:
        out += "\nWITH (\n" + ",\n".join(f"{text(k)} = {text(v)}" for k, v in sorted(info.options.items())) + "\n)"
    return out
