"""WARC files and their fixity audit by Merkle trees over records and offset ranges.

``write_warc`` lays pages down as WARC/1.1 files of a bounded number of records
and bytes, each input partition its own files, without a shuffle; long pages get
files of their own, so a file is never larger than 256 MB and headers, or one page.  ``tree`` parses the
files of a replica and hashes them upwards: record, offset range of 64 KB, of
1 MB, file, group of files, archive.  A node's hash covers its children's
offsets and hashes in order.  ``audit`` compares the roots of two replicas and,
level by level, reads only the children of nodes that differ, down to records.

Ranges are multiples of a fixed size and a record belongs to the range in which
it begins, so a damaged, cut off or additional record changes only the branches
above it as long as later records keep their offsets.  A record whose header is
damaged is skipped up to the next record's first line; its bytes are hashed as
one unreadable record.

Defined cases: null texts are empty blocks; null urls and ids leave out their
header; line ends in urls become blanks; repeated rows are records of their own;
an empty table gives an empty archive, equal to any other; a file that one
replica lacks has all its records missing; further columns are dropped.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_path

#: Records of a file at most, and bytes of a page that shares its file with others at most.
FILE_RECORDS = 1_000
LONG_PAGE = 1 << 18
#: Bytes of the offset ranges of levels 1 and 2.
RANGES = (1 << 16, 1 << 20)
RECORD, FILE, GROUP, ROOT = 0, len(RANGES) + 1, len(RANGES) + 2, len(RANGES) + 3
GROUPS = 4_096
DATE = "2024-01-01T00:00:00Z"

_START = b"WARC/1.1\r\n"
_LENGTH = re.compile(rb"\r\nContent-Length: ([0-9]+)(?=\r\n|$)")
_ROW = re.compile(rb"\r\nX-Row-Id: (-?[0-9]+)(?=\r\n|$)")


def record(row_id: Column, url: Column, text: Column, date: str = DATE) -> Column:
    """One resource record; the line feed that ends its last line is left to the writer of lines."""
    clean = F.regexp_replace(url, "[\\r\\n]", " ")
    h = F.md5(F.concat_ws("|", row_id.cast("string"), url))
    uuid = F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    block = F.coalesce(text, F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:"), uuid, F.lit(f">\r\nWARC-Date: {date}\r\n"),
        F.coalesce(F.concat(F.lit("WARC-Target-URI: "), clean, F.lit("\r\n")), F.lit("")),
        F.coalesce(F.concat(F.lit("X-Row-Id: "), row_id.cast("string"), F.lit("\r\n")), F.lit("")),
        F.lit("Content-Type: text/html\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"), block, F.lit("\r\n\r"),
    )


def write_warc(pages: DataFrame, path: str, row_id: str = "page_id", url: str = "url", text: str = "html", file_records: int = FILE_RECORDS, long_page: int = LONG_PAGE) -> None:
    """Write pages as WARC files under path; those over long_page bytes (url and text) go one to a file."""
    long = F.coalesce(F.octet_length(text), F.lit(0)) + F.coalesce(F.octet_length(url), F.lit(0)) > long_page
    for chosen, most in ((~long, file_records), (long, 1)):
        lines = pages.where(chosen).select(record(F.col(row_id), F.col(url), F.col(text)).alias("value"))
        lines.write.mode("append").option("maxRecordsPerFile", most).option("lineSep", "\n").text(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, content) of the WARC files under path."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return found.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")


def records(content: bytes) -> Iterator[tuple[int, int, int, int | None]]:
    """(begin, end, block's begin, row id) of each record; a record that cannot be read has a block's begin of -1."""
    at = 0
    while at < len(content):
        head = content.find(b"\r\n\r\n", at)
        length = _LENGTH.search(content, at, head) if head >= 0 and content.startswith(_START, at) else None
        end = head + 8 + int(length[1]) if length else -1
        if length and end <= len(content):
            row = _ROW.search(content, at, head)
            yield at, end, head + 4, int(row[1]) if row else None
        else:
            after = content.find(b"\r\n\r\n" + _START, at)
            end = after + 4 if after >= 0 else len(content)
            yield at, end, -1, None
        at = end


NODE = "file string, level int, idx long, up long, begin long, end long, hash binary, row_id long"


def file_nodes(file: str, content: bytes) -> Iterator[tuple]:
    """The nodes of one file, records first."""
    level = [(begin, end, hashlib.sha256(memoryview(content)[begin:end]).digest(), row) for begin, end, _, row in records(content)]
    sizes = (1, *RANGES)
    for k, size in enumerate(sizes):
        above: dict[int, list[tuple]] = {}
        for begin, end, h, row in level:
            up = begin // RANGES[k] if k < len(RANGES) else 0
            yield file, k, begin // size, up, begin, end, h, row
            above.setdefault(up, []).append((begin, end, h))
        level = [(p[0][0], p[-1][1], _combined(p), None) for p in above.values()]
    for begin, end, h, _ in level:
        yield file, FILE, 0, 0, begin, end, h, None


def _combined(children: list[tuple[int, int, bytes]]) -> bytes:
    return hashlib.sha256(b"".join(b.to_bytes(8, "big") + e.to_bytes(8, "big") + h for b, e, h in children)).digest()


def tree(files: DataFrame) -> DataFrame:
    """The nodes of a replica (file, content), as a table by level in the shared folder; groups of files and the root included."""
    spark, path = files.sparkSession, shared_path(files.sparkSession)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
        names = [x.split()[0] for x in NODE.split(", ")]
        for batch in batches:
            for i in range(batch.num_rows):
                if columns := list(zip(*file_nodes(batch.column(0)[i].as_py(), batch.column(1)[i].as_py() or b""), strict=True)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    files.mapInArrow(parse, NODE).write.partitionBy("level").parquet(path)
    nodes = spark.read.schema(NODE).parquet(path)
    over = F.lit(GROUPS)
    groups = nodes.where(F.col("level") == FILE).groupBy(F.pmod(F.xxhash64("file"), over).alias("idx")).agg(F.sort_array(F.collect_list(F.struct("file", "hash"))).alias("files"))
    digest = lambda parts: F.unhex(F.sha2(F.concat_ws(",", parts), 256))
    name = lambda x: F.concat(x["file"], F.lit(":"), F.hex(x["hash"]))
    hashed = groups.select("idx", digest(F.transform("files", name)).alias("hash"))
    inner = hashed.select(F.lit("").alias("file"), F.lit(GROUP).alias("level"), "idx", F.lit(0).cast("long").alias("up"), "hash")
    inner.write.mode("append").partitionBy("level").parquet(path)
    # GROUPS hashes at most
    parts = spark.read.schema(NODE).parquet(path).where(F.col("level") == GROUP).agg(F.sort_array(F.collect_list(F.struct("idx", "hash"))).alias("all"))
    root = parts.select(F.lit("").alias("file"), F.lit(ROOT).alias("level"), F.lit(0).cast("long").alias("idx"), digest(F.transform("all", lambda x: F.concat(x["idx"].cast("string"), F.lit(":"), F.hex(x["hash"])))).alias("hash"))
    root.write.mode("append").partitionBy("level").parquet(path)
    return spark.read.schema(NODE).parquet(path)


def audit(left: DataFrame, right: DataFrame) -> DataFrame:
    """(file, begin, end, row_id, status): records of two trees that differ: corrupt, missing (only left) or extra (only right)."""
    root = lambda nodes: [r["hash"] for r in nodes.where(F.col("level") == ROOT).select("hash").collect()]  # noqa: E731  one row
    both = left.withColumn("side", F.lit(0)).unionByName(right.withColumn("side", F.lit(1)))
    same = root(left) == root(right)

    def differing(level: int, wanted: DataFrame | None, keys: list[str]) -> DataFrame:
        nodes = both.where(F.col("level") == level)
        if level == FILE:
            nodes = nodes.withColumn("up", F.pmod(F.xxhash64("file"), F.lit(GROUPS)))
        if wanted is not None:
            nodes = nodes.join(wanted.withColumnRenamed("idx", "up"), ["up"] if level >= FILE else ["file", "up"], "left_semi")
        one = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c)))
        met = nodes.groupBy(*keys).agg(one(0, "hash").alias("h0"), one(1, "hash").alias("h1"), one(0, "end").alias("e0"), one(1, "end").alias("e1"), one(0, "row_id").alias("r0"), one(1, "row_id").alias("r1"))
        return met.where(~F.col("h0").eqNullSafe(F.col("h1")) | ~F.col("e0").eqNullSafe(F.col("e1")))

    wanted = None
    for level in range(GROUP, RECORD, -1):
        found = differing(level, wanted, ["idx"] if level == GROUP else ["file", "idx"])
        wanted = found.select("idx") if level == GROUP else found.select("file", "idx")
    found = differing(RECORD, wanted, ["file", "idx"])
    status = F.when(F.col("h1").isNull(), "missing").when(F.col("h0").isNull(), "extra").otherwise("corrupt")
    out = found.select("file", F.col("idx").alias("begin"), F.coalesce("e0", "e1").alias("end"), F.coalesce("r0", "r1").alias("row_id"), status.alias("status"))
    return out.where("false") if same else out


def fixity(left: DataFrame, right: DataFrame) -> DataFrame:
    """Each record of the tree left with its status against the tree right: ok, corrupt or missing."""
    found = audit(left, right).where("status <> 'extra'").select("file", "begin", "status")
    own = left.where(F.col("level") == RECORD).select("file", "begin", "end", "row_id", "hash")
    return own.join(found, ["file", "begin"], "left").withColumn("status", F.coalesce("status", F.lit("ok")))


def damaged(files: DataFrame, change: Callable[[int | None, bytearray, int, int, int], None]) -> DataFrame:
    """files with change(row id, content, begin, block's begin, end) applied to each record; for drills and tests."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                content = bytearray(batch.column(1)[i].as_py() or b"")
                for begin, end, block, row in list(records(bytes(content))):
                    change(row, content, begin, block, end)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([bytes(content)], pa.binary())], names=["file", "content"])

    return files.mapInArrow(apply, "file string, content binary")
