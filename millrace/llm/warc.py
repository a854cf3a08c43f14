"""WARC archives with a two-level capture index.

Records are written by Spark's text writer (each row a record, the line separator its closing
blank lines), so archives can stand in any store that Spark writes to.  The index has a line for
each capture, sorted by reversed-host URL key, in gzip blocks of BLOCK_LINES lines; a sparse
directory keeps the first key, place and size of each block.  A lookup finds its parts of the index by
their first keys and its blocks by binary search in their directory, reads the blocks' ranges, searches
their lines, and reads the records' ranges.  All of this runs on the executors, for any number of keys.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import bounded_batches, materialize, new_folder

ARCHIVE_BYTES = 8 << 20  # about so many bytes of payload in an archive; a task holds a few archives
BROADCAST_ROWS = 500_000  # repeated payloads, or captures to read back; beyond it these joins shuffle
BLOCK_LINES = 3000
STRETCH = 32 << 20  # bytes of an archive whose records one task reads
DATE = "1970-01-01T00:00:00Z"  # pages have no capture time
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"  # fixed value of the WARC format


def one_line(url: Column) -> Column:
    """A URL as it stands in a record: null is empty, spaces and line ends are escaped."""
    out = F.coalesce(url.cast("string"), F.lit(""))
    for c in " \r\n":
        out = F.replace(out, F.lit(c), F.lit(f"%{ord(c):02X}"))
    return out


def url_key(url: Column) -> Column:
    """Reversed-host key: ``http://a.b.com:80/x?y#z`` gives ``com,b,a)/x?y``; null and other texts stand for themselves."""
    url = one_line(url)
    at = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)(?::[0-9]*)?([^#]*)"
    host, rest = F.lower(F.regexp_extract(url, at, 1)), F.regexp_extract(url, at, 2)
    rest = F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))
    return F.when(url.rlike(at), F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest)).otherwise(url)


def base32_sha1(data: Column) -> Column:
    """The bare upper-case base32 SHA-1 of binary data."""
    letters, code = F.sha1(data), F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    out = []
    for k in range(8):  # 5 hex digits are 4 letters
        v = F.conv(F.substring(letters, 5 * k + 1, 5), 16, 10).cast("int")
        out += [F.substr(code, F.shiftright(v, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def records(pages: DataFrame, least: int = 0, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> tuple[DataFrame, int]:
    """A row for each page: page_id, url, payload, digest, size, refers_to; and the mean size.

    Of pages with equal payloads of ``least`` bytes or more, that with the largest id is a response
    (refers_to null) and the others revisit it.  Rows that repeat that id with the same payload are
    responses too; a null id revisits, if its payload has another id.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), F.coalesce(F.col(body_col).cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", base32_sha1(F.col("payload").cast("binary"))).withColumn("size", F.octet_length("payload").cast("long"))
    # a partial aggregate reduces frequent payloads before the shuffle
    each = materialize(rows.groupBy("digest", "size").agg(F.max("page_id").alias("last"), F.count("*").alias("n")), "payloads")
    mean = each.agg(F.coalesce((F.sum(F.col("size") * F.col("n")) / F.sum("n")).cast("long"), F.lit(0))).first()[0]
    same = each.where(f"n > 1 and size >= {least} and last is not null").select(F.col("digest").alias("digest0"), F.col("size").alias("size0"), "last")
    if same.count() <= BROADCAST_ROWS:
        same = F.broadcast(same)
    rows = rows.join(same, (F.col("digest") == F.col("digest0")) & (F.col("size") == F.col("size0")), "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("last")), F.col("last"))
    return rows.select("page_id", "url", "payload", "digest", "size", refers.alias("refers_to")), mean


def _record_head() -> Column:
    """The text of a record up to its payload."""
    revisit = F.col("refers_to").isNotNull()
    uri = one_line(F.col("url"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit("\r\n\r\n"))
    h = F.md5(F.concat_ws("|", F.col("page_id").cast("string"), "url", "digest"))
    uuid = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))
    length = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("size"))
    kind = F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), kind,
        F.lit("\r\nWARC-Record-ID: <urn:uuid:"), uuid,
        F.lit(f">\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: "), uri,
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
        F.when(revisit, F.concat(F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nRefers-To-Page-ID: "), F.col("refers_to").cast("string"))).otherwise(F.lit("")),
        F.when(F.col("page_id").isNotNull(), F.concat(F.lit("\r\nPage-ID: "), F.col("page_id").cast("string"))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), length.cast("string"), F.lit("\r\n\r\n"), http,
    )


def write_archives(rows: DataFrame, mean: int, folder: str) -> None:
    """Write the records below ``folder``/archives, each task its own rows: texts are not shuffled."""
    body = F.when(F.col("refers_to").isNull(), F.col("payload")).otherwise(F.lit(""))
    rows.select(F.concat(_record_head(), body).alias("value")).write.option("maxRecordsPerFile", max(1, ARCHIVE_BYTES // max(1, mean))).option("lineSep", "\r\n\r\n").text(f"{folder}/archives")


def _opened(uri: str):
    """A file of the shared folder for reading at any place; stores other than file: are opened through pyarrow."""
    if uri.startswith("file:") or uri.startswith("/"):
        return open("/" + uri.removeprefix("file:").lstrip("/"), "rb", buffering=1 << 18)
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    return store.open_input_file(path)


def _read_range(f, start: int, length: int) -> bytes:
    f.seek(start)
    data = f.read(length)
    if len(data) != length:
        raise ValueError(f"a range of {length} bytes at {start} that the file doesn't hold")
    return data


def _scan_map(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, length) of archives to a row for each record, found by walking from header to header: payloads are skipped."""
    kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
    for batch in batches:
        for path, whole in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            rows, at, name = [], 0, path.rsplit("/", 1)[1]
            with _opened(path) as f:
                while at < whole:
                    size = 1 << 10
                    while (end := (head := _read_range(f, at, min(size, whole - at))).find(b"\r\n\r\n")) < 0:
                        size *= 4
                    fields = header_fields(head[:end])
                    length = end + 4 + int(fields["content-length"]) + 4
                    page = fields.get("page-id")
                    rows.append((fields.get("warc-target-uri", ""), int(page) if page else None, fields["warc-payload-digest"].removeprefix("sha1:"), at, length))
                    at += length
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.string()), *[pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds)]], names=["archive", "url", "page_id", "digest", "start", "length"])


def scan_archives(spark: SparkSession, folder: str) -> DataFrame:
    """The captures in the archives: key, page_id, digest, archive, start, length."""
    files = spark.read.format("binaryFile").load(f"{folder}/archives").where("length > 0").select("path", "length")
    return files.mapInArrow(_scan_map, "archive string, url string, page_id long, digest string, start long, length long").withColumn("key", url_key(F.col("url"))).drop("url")


def _block_map(folder: str):
    """Sorted captures of a partition to a file of gzip blocks, and a row for each block.

    The file's name is its task attempt's own; only files named in the rows of attempts that Spark
    commits are part of the index.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        name, at, lines, first = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.gz", 0, [], None
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
        store, path = fs.FileSystem.from_uri(f"{folder}/index")
        store.create_dir(path, recursive=True)
        with store.open_output_stream(f"{path}/{name}", compression=None) as f:

            def block() -> pa.RecordBatch:
                nonlocal at, lines, first
                data = gzip.compress("".join(lines).encode("utf-8"), 6, mtime=0)
                f.write(data)
                row = [name, at, len(data), first, len(lines)]
                at, lines, first = at + len(data), [], None
                return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names=["file", "start", "length", "first_key", "lines"])

            for batch in batches:
                for r in batch.to_pylist():
                    first = r["key"] if first is None else first
                    lines.append(f"{r['key']} {DATE} " + json.dumps({"page_id": r["page_id"], "digest": r["digest"], "archive": r["archive"], "start": r["start"], "length": r["length"]}) + "\n")
                    if len(lines) == BLOCK_LINES:
                        yield block()
            if lines:
                yield block()

    return run


def write_index(captures: DataFrame, folder: str) -> None:
    """Sorted, blocked and compressed index below ``folder``/index, and its sparse directory below ``folder``/directory."""
    rows = captures.repartitionByRange("key", "page_id", "archive", "start").sortWithinPartitions("key", "page_id", "archive", "start")
    rows.mapInArrow(_block_map(folder), "file string, start long, length long, first_key string, lines long").write.parquet(f"{folder}/directory")


def _part_map(tops: list[tuple[str, str]]):
    """key to (file, key): the parts of the index that may hold it.  ``tops`` are their first keys in order, one for each task that wrote."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts = [k for k, _ in tops]
        for batch in batches:
            out = []
            for key in batch.column(0).to_pylist():
                a, z = bisect.bisect_left(firsts, key) - 1, bisect.bisect_right(firsts, key)
                out += [(tops[x][1], key) for x in range(max(0, a), z)]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.string()), pa.array([y for _, y in out], pa.string())], names=["file", "key"])

    return run


def _blocks_of(name: tuple, keys: pa.Table, directory: pa.Table) -> pa.Table:
    """The blocks of one part that may hold each key, by binary search in the part's directory."""
    rows = sorted(directory.select(["first_key", "start", "length"]).to_pylist(), key=lambda r: r["start"])
    firsts, out = [r["first_key"] for r in rows], []
    for key in keys.column("key").to_pylist():
        a, z = bisect.bisect_left(firsts, key) - 1, bisect.bisect_right(firsts, key)
        out += [(rows[x]["start"], rows[x]["length"], key) for x in range(max(0, a), z)]
    columns = [pa.array([r[c] for r in out], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.string()))]
    return pa.table([pa.array([directory.column("file")[0].as_py() if out else None] * len(out), pa.string()), *columns], names=["file", "start", "length", "key"])


def _line_map(folder: str):
    """(file, start, length, keys) of blocks to the captures of the keys, by binary search in the lines of the range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("archive", "start", "length")
        for batch in batches:
            for r in batch.to_pylist():
                with _opened(f"{folder}/index/{r['file']}") as f:
                    lines = gzip.decompress(_read_range(f, r["start"], r["length"])).decode("utf-8").split("\n")[:-1]
                own, rows = [x.split(" ", 1)[0] for x in lines], []
                for key in r["keys"]:
                    found = [json.loads(x.split(" ", 2)[2]) for x in lines[bisect.bisect_left(own, key) : bisect.bisect_right(own, key)]]
                    rows += [(key, *[x[n] for n in names]) for x in found]
                yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in rows], t) for c, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["key", *names])

    return run


def lookup(spark: SparkSession, folder: str, keys: DataFrame) -> DataFrame:
    """(key, archive, start, length) of every capture whose URL key is in ``keys`` (one column; repeated ones count once).

    A key with very many captures has many blocks, each read by the task of that block.  The driver
    holds the first key of each part of the index, as many as tasks wrote it.
    """
    directory = spark.read.parquet(f"{folder}/directory")
    tops = sorted((r["k"], r["file"]) for r in directory.groupBy("file").agg(F.min("first_key").alias("k")).collect())
    asked = keys.toDF("key").where("key is not null").distinct().mapInArrow(_part_map(tops), "file string, key string")
    blocks = asked.groupBy("file").cogroup(directory.groupBy("file")).applyInArrow(_blocks_of, "file string, start long, length long, key string")
    listed = blocks.groupBy("file", "start", "length").agg(F.collect_list("key").alias("keys"))
    return listed.mapInArrow(_line_map(folder), "key string, archive string, start long, length long")


def header_fields(head: bytes) -> dict[str, str]:
    """The fields of a WARC header, names in lower case."""
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return {n.strip().lower(): v.strip(" ") for n, _, v in (x.partition(":") for x in lines[1:])}


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields of a WARC record, and its block."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = header_fields(head)
    size = int(fields["content-length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("a record that doesn't end where its length says")
    return fields, rest[:size]


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _capture_of(data: bytes) -> tuple[int | None, int, str, str, int | None]:
    fields, block = parse_record(data)
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(http.rsplit(b"Content-Length: ", 1)[1])
    digest, kind = fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"]
    if kind == "response" and (len(payload) != size or digest_of(payload) != digest):
        raise ValueError(f"a payload that doesn't have its digest: {fields.get('warc-target-uri')}")
    page, refers = fields.get("page-id"), fields.get("refers-to-page-id")
    return int(page) if page else None, size, digest, kind, int(refers) if refers else None


def _fetch_map(folder: str, told):
    """(archive, start, length) in order to what ``told`` gives of the records, one batch for some MiB."""
    names, kinds, row_of = told

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, f, rows, held = None, None, [], 0
        try:
            for batch in batches:
                for archive, start, length in zip(*(c.to_pylist() for c in batch.columns[:3]), strict=True):
                    if archive != name:
                        if f is not None:
                            f.close()
                        name, f = archive, _opened(f"{folder}/archives/{archive}")
                    rows.append(row_of(_read_range(f, start, length)))
                    held += length
                    if held > 4 << 20:
                        yield table(rows)
                        rows, held = [], 0
            yield table(rows)
        finally:
            if f is not None:
                f.close()

    return run


_CAPTURE = (["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"], [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()], _capture_of)


def fetch(spark: SparkSession, folder: str, captures: DataFrame, told, schema: str) -> DataFrame:
    """Records of ``captures`` (archive, start, length), read by their ranges; tasks take stretches of archives."""
    rows = captures.select("archive", "start", "length").repartition("archive", F.floor(F.col("start") / STRETCH)).sortWithinPartitions("archive", "start")
    return rows.mapInArrow(_fetch_map(folder, told), schema)


def read_captures(spark: SparkSession, folder: str, keys: DataFrame) -> DataFrame:
    """Every capture of the URL ``keys``, read from its record: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A response's payload is held against its digest.
    """
    return fetch(spark, folder, lookup(spark, folder, keys), _CAPTURE, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def read_records(spark: SparkSession, folder: str, urls: list[str]) -> list[tuple[dict[str, str], bytes]]:
    """Header fields and blocks of the records of some URLs."""
    keys = spark.createDataFrame([(u,) for u in urls], "url string").select(url_key(F.col("url")))
    rows = fetch(spark, folder, lookup(spark, folder, keys), (["data"], [pa.binary()], lambda data: (data,)), "data binary")
    return [parse_record(bytes(r["data"])) for r in rows.collect()]


def archive_pages(pages: DataFrame, least: int = 0, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> str:
    """Write archives and index of all ``pages`` into the shared folder; returns their folder.

    Null urls and bodies count as empty.  An empty table gives an index without blocks.  Other
    columns are not read.
    """
    spark = pages.sparkSession
    bounded_batches(spark)
    folder = new_folder(spark, "warc")
    write_archives(*records(pages, least, id_col, url_col, body_col), folder)
    write_index(materialize(scan_archives(spark, folder), "captures"), folder)
    return folder
