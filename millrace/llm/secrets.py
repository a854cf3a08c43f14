"""Secret scan with corpus-wide ownership frequency, in built-in functions only.

Candidates are the three base kinds (assignments, access keys, hex strings) and long mixed tokens.
Each candidate's value is hashed, whatever its kind; hashes are aggregated by distinct repositories
and owners.  A value that many owners or many repositories hold is a widely copied example; one that
a single owner holds in few repositories looks live, and mixed tokens of that sort are added as spans
of kind ``live``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialize

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}+"
# 24 or more token characters with a small letter, a capital and a digit, at a run's begin
MIXED = r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z0-9_+/-]*[a-z])(?=[A-Za-z0-9_+/-]*[A-Z])(?=[A-Za-z0-9_+/-]*[0-9])[A-Za-z0-9_+/-]{24,}+"
ANY = f"(?i:password|passwd|secret|token|api_?key)|AKIA[A-Z0-9]{{14}}|[0-9a-f]{{16}}|[A-Za-z0-9_+/-]{{24}}"
KINDS = ("assign", "access", "hex", "live")
LEAST = (12, 18, 16, 24)  # characters of a value of each kind


def _matches(text: Column, kind: int, pattern: str, value_group: int) -> Column:
    """Array of (kind, gap before, size, length and hash of the value) of the leftmost matches, in order.

    The pieces between matches and the matches alternate, so running sums of gaps and sizes are the
    positions, in code points.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)) if value_group else whole
    rows = F.arrays_zip(F.slice(F.split(text, pattern, -1), 1, F.size(whole)).alias("gap"), whole.alias("whole"), values.alias("value"))
    return F.transform(rows, lambda x: F.struct(F.lit(kind).alias("kind"), F.length(x["gap"]).alias("gap"), F.length(x["whole"]).alias("size"), F.length(x["value"]).alias("length"), F.xxhash64(x["value"]).alias("value")))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "lang") -> DataFrame:
    """(rid, doc_id, owner, repo, found): a row for each document with the matches of each kind in its whole text."""
    kinds = ((ASSIGN, 2), (ACCESS, 0), (HEX, 0), (MIXED, 0))
    found = F.concat(*[_matches(F.col("text"), k, pattern, group) for k, (pattern, group) in enumerate(kinds)])
    none = F.array().cast("array<struct<kind:int,gap:int,size:int,length:int,value:bigint>>")
    owner, repo = F.col(owner_col).cast("string"), F.col(repo_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), owner.alias("owner"), F.concat_ws("/", owner, repo).alias("repo"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.select("doc_id", "owner", "repo", F.when(F.col("text").rlike(ANY), found).otherwise(none).alias("found")).withColumn("rid", F.monotonically_increasing_id())


def spans(found: DataFrame) -> DataFrame:
    """(rid, owner, repo, kind, start, end, value) of the matches whose value is long enough for its kind."""
    rows = found.select("rid", "owner", "repo", F.posexplode("found").alias("at", "x")).select("rid", "owner", "repo", "at", "x.*")
    before = Window.partitionBy("rid", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(before).cast("int")).withColumn("start", F.col("end") - F.col("size"))
    least = F.element_at(F.array(*[F.lit(n) for n in LEAST]), F.col("kind") + 1)
    return rows.where(F.col("length") >= least).select("rid", "owner", "repo", "kind", "start", "end", "value")


def ownership(rows: DataFrame) -> DataFrame:
    """(value, owners, repos, rows): distinct owners and repositories of each candidate hash.

    The first grouping is by (value, owner, repo), so a value in very many rows is reduced before
    the shuffle and then spread over its owners; null owners count as one owner.
    """
    rows = rows.select("value", F.coalesce("owner", F.lit("")).alias("owner"), "repo")
    return rows.groupBy("value", "owner", "repo").agg(F.count("*").alias("n")).groupBy("value", "owner").agg(F.count("*").alias("repos"), F.sum("n").alias("n")).groupBy("value").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"), F.sum("n").alias("rows"))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(x) for x in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def secret_scan(docs: DataFrame, example_owners: int = 3, example_repos: int = 6, live_repos: int = 2, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "lang") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example, most_owners, most_repos.

    A null text counts as empty.  Spans are kind:start:end in code points, end exclusive, by start
    and then kind.  A candidate whose value ``example_owners`` owners or ``example_repos``
    repositories hold is an example; one that a single owner holds in ``live_repos`` repositories at
    most is live-looking.  Base spans always stay; mixed tokens are added (``live``) when they look
    live.  A repository is an owner with ``repo_col``; null owners count as one.  Rows that repeat a
    doc_id are rows of their own; columns other than the four named aren't read.
    """
    found = materialize(candidates(docs, id_col, text_col, owner_col, repo_col), "candidates")
    each = spans(found)
    rows = each.join(ownership(each).select("value", "owners", "repos"), "value")
    live = (F.col("owners") == 1) & (F.col("repos") <= live_repos)
    marked = rows.where((F.col("kind") < 3) | live).groupBy("rid").agg(
        F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("spans"),
        F.count_if(live).alias("n_live"),
        F.count_if((F.col("owners") >= example_owners) | (F.col("repos") >= example_repos)).alias("n_example"),
        F.max("owners").alias("most_owners"),
        F.max("repos").alias("most_repos"),
    )
    out = found.drop("found").join(marked, "rid", "left")
    own = F.coalesce("spans", F.array().cast("array<struct<start:int,kind:int,end:int>>"))

    def count(kind: int) -> Column:
        return F.size(F.filter(own, lambda x: x["kind"] == kind)).cast("long")

    return out.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_joined(F.filter(own, lambda x: x["kind"] < 3)).cast("binary"), 256).alias("base_sha256"),
        _joined(own).alias("spans"),
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_live", "n_example", "most_owners", "most_repos")],
    )
