"""Binary map files: nodes and ways read by splits at blob borders, and written by tasks.

A file is a row of blobs, each behind a short header with its size and each decoded on
its own.  The driver reads the headers only; a split is some consecutive blobs.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from . import wire

#: Field numbers of the map format, as far as they are read.
BLOB_HEADER = {1: ("type", "string"), 3: ("datasize", "int")}
BLOB = {1: ("raw", "bytes"), 2: ("raw_size", "int"), 3: ("zlib", "bytes"), 4: ("lzma", "bytes"), 6: ("lz4", "bytes"), 7: ("zstd", "bytes")}
NODE = {1: ("id", "long"), 8: ("lat", "long"), 9: ("lon", "long")}
DENSE = {1: ("id", "bytes"), 8: ("lat", "bytes"), 9: ("lon", "bytes")}
WAY = {1: ("id", "long"), 2: ("keys", "bytes"), 3: ("vals", "bytes"), 8: ("refs", "bytes")}
PLACES = {17: ("granularity", "int"), 19: ("lat_offset", "long"), 20: ("lon_offset", "long")}
BLOCKS = {
    "nodes": {2: ("group", [{1: ("nodes", [NODE]), 2: ("dense", DENSE)}]), **PLACES},
    "ways": {1: ("strings", {1: ("s", ["bytes"])}), 2: ("group", [{3: ("ways", [WAY])}])},
}
#: Features that a reader must know, and the largest sizes of a header and of a block.
FEATURES = ("OsmSchema-V0.6", "DenseNodes")
HEADER_BYTES, BLOCK_BYTES = 65_536, 33_554_432
#: Nanodegrees of a step where a block names none, and entities of a block that is written.
STEP = 100
BLOCK_ROWS = 8_000

SCHEMAS = {"nodes": "node long, lat double, lon double", "ways": "way_id long, tags map<string,string>, refs array<long>"}
_TAGS = pa.map_(pa.string(), pa.string())
_ARROW = {
    "nodes": pa.schema([("node", pa.int64()), ("lat", pa.float64()), ("lon", pa.float64())]),
    "ways": pa.schema([("way_id", pa.int64()), ("tags", _TAGS), ("refs", pa.list_(pa.int64()))]),
}


def _header(f: pa.NativeFile, at: int) -> tuple[str, int, int] | None:
    """Type, start and size of the blob whose header begins at a place; None at the end."""
    f.seek(at)
    size = f.read(4)
    if not size:
        return None
    if len(size) < 4:
        raise ValueError(f"a header ends early at {at}")
    (n,) = struct.unpack(">I", size)
    if n > HEADER_BYTES:
        raise ValueError(f"a header of {n} bytes at {at}")
    raw = f.read(n)
    if len(raw) < n:
        raise ValueError(f"a header ends early at {at}")
    head = wire.decode(raw, BLOB_HEADER)
    if head["datasize"] is None or not 0 <= head["datasize"] <= BLOCK_BYTES:
        raise ValueError(f"a blob of {head['datasize']} bytes at {at}")
    return head["type"], at + 4 + n, head["datasize"]


def _content(raw: bytes) -> bytes:
    blob = wire.decode(raw, BLOB)
    if blob["raw"] is not None:
        return blob["raw"]
    if blob["zlib"] is None:
        used = [k for k in ("lzma", "lz4", "zstd") if blob[k] is not None]
        raise ValueError(f"blobs packed with {used[0] if used else 'nothing known'} are not read")
    return zlib.decompress(blob["zlib"], bufsize=max(blob["raw_size"] or 0, 1))


def _signed(value: int | None) -> int:
    """A number whose sign is its lowest bit."""
    u = (value or 0) & (1 << 64) - 1
    return (u >> 1) ^ -(u & 1)


def _nodes(block: dict) -> Iterator[pa.RecordBatch]:
    step = STEP if block["granularity"] is None else block["granularity"]

    def degrees(values: np.ndarray, offset: int | None) -> pa.Array:
        return pa.array((values * step + (offset or 0)) / 1e9)

    for group in block["group"]:
        plain = np.array([[_signed(n[k]) for k in ("id", "lat", "lon")] for n in group["nodes"]], np.int64).reshape(-1, 3).T
        parts = [plain]
        if group["dense"] is not None:
            parts.append(np.stack([np.cumsum(wire.packed_signed(group["dense"][k] or b"")) for k in ("id", "lat", "lon")]))
        for node, lat, lon in parts:
            if len(node):
                yield pa.RecordBatch.from_arrays([pa.array(node), degrees(lat, block["lat_offset"]), degrees(lon, block["lon_offset"])], schema=_ARROW["nodes"])


def _ways(block: dict) -> Iterator[pa.RecordBatch]:
    strings = [s.decode("utf-8", "replace") for s in (block["strings"] or {"s": []})["s"]]
    for group in block["group"]:
        ways = group["ways"]
        if not ways:
            continue
        tags = [list({strings[k]: strings[v] for k, v in zip(wire.packed(w["keys"] or b""), wire.packed(w["vals"] or b""))}.items()) for w in ways]
        refs = [np.cumsum(wire.packed_signed(w["refs"] or b"")) for w in ways]
        yield pa.RecordBatch.from_arrays([pa.array([w["id"] for w in ways], pa.int64()), pa.array(tags, _TAGS), pa.array(refs, pa.list_(pa.int64()))], schema=_ARROW["ways"])


class _Blobs(InputPartition):
    def __init__(self, path: str, start: int, end: int) -> None:
        self.path, self.start, self.end = path, start, end


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.uri, self.kind = options["path"], options.get("kind", "nodes")
        self.split_bytes = int(options.get("splitbytes", options.get("splitBytes", 64 << 20)))

    def partitions(self) -> list[InputPartition]:
        files, path = _located(self.uri)
        info = files.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.uri)
        paths = [path] if info.is_file else sorted(i.path for i in files.get_file_info(fs.FileSelector(path, recursive=True)) if i.is_file and i.path.endswith(".pbf"))
        out = []
        for p in paths:
            with files.open_input_file(p) as f:
                start = at = 0
                while (head := _header(f, at)) is not None:
                    at = head[1] + head[2]
                    if at - start >= self.split_bytes:
                        out.append(_Blobs(p, start, at))
                        start = at
                if at > f.size():
                    raise ValueError(f"{p} ends early")
                if at > start:
                    out.append(_Blobs(p, start, at))
        return out or [_Blobs("", 0, 0)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if not partition.end:
            return
        files, _ = _located(self.uri)
        decoded = _nodes if self.kind == "nodes" else _ways
        with files.open_input_file(partition.path) as f:
            at = partition.start
            while at < partition.end:
                kind, start, size = _header(f, at)
                at = start + size
                if kind == "OSMData":
                    f.seek(start)
                    yield from decoded(wire.decode(_content(f.read(size)), BLOCKS[self.kind]))


class _Written(WriterCommitMessage):
    def __init__(self, path: str | None) -> None:
        self.path = path


class _Writer(DataSourceArrowWriter):
    """A file for each task, under another name until the job commits."""

    def __init__(self, options: dict[str, str], kind: str, overwrite: bool) -> None:
        self.uri, self.kind, self.overwrite, self.job = options["path"], kind, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        files, folder = _located(self.uri)
        path = f"{folder}/_{self.job}-{uuid.uuid4().hex}"
        encoded = _node_block if self.kind == "nodes" else _way_block
        f = None
        try:
            for batch in iterator:
                for lo in range(0, batch.num_rows, BLOCK_ROWS):
                    if f is None:
                        files.create_dir(folder, recursive=True)
                        f = files.open_output_stream(path)
                        f.write(_blob("OSMHeader", b"".join(wire.field(4, x.encode()) for x in FEATURES)))
                    f.write(_blob("OSMData", encoded(batch.slice(lo, BLOCK_ROWS))))
        finally:
            if f is not None:
                f.close()
        return _Written(path if f is not None else None)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        files, folder = _located(self.uri)
        files.create_dir(folder, recursive=True)
        if self.overwrite:
            for old in files.get_file_info(fs.FileSelector(folder)):
                if old.is_file and old.path.endswith(".pbf"):
                    files.delete_file(old.path)
        for i, m in enumerate(m for m in messages if m is not None and m.path):
            files.move(m.path, f"{folder}/part-{i:05d}-{self.job}.osm.pbf")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        files, _ = _located(self.uri)
        for m in messages:
            if m is not None and m.path:
                files.delete_file(m.path)


def _blob(kind: str, content: bytes) -> bytes:
    blob = wire.field(2, len(content)) + wire.field(3, zlib.compress(content))
    head = wire.field(1, kind.encode()) + wire.field(3, len(blob))
    return struct.pack(">I", len(head)) + head + blob


def _steps(values: np.ndarray) -> np.ndarray:
    return np.diff(values, prepend=np.int64(0))


def _node_block(batch: pa.RecordBatch) -> bytes:
    place = lambda c: np.round(batch.column(c).to_numpy(zero_copy_only=False) * (1e9 / STEP)).astype(np.int64)
    columns = {1: batch.column("node").to_numpy(zero_copy_only=False).astype(np.int64), 8: place("lat"), 9: place("lon")}
    dense = b"".join(wire.field(number, wire.pack_signed(_steps(v))) for number, v in columns.items())
    return wire.field(1, wire.field(1, b"")) + wire.field(2, wire.field(2, dense))


def _way_block(batch: pa.RecordBatch) -> bytes:
    numbers: dict[str, int] = {"": 0}  # string 0 is a mark and no string
    ways = []
    for way_id, tags, refs in zip(*(batch.column(c).to_pylist() for c in ("way_id", "tags", "refs"))):
        own = [(k, v) for k, v in tags or [] if v is not None]
        keys, vals = ([numbers.setdefault(x, len(numbers)) for x in part] for part in zip(*own)) if own else ([], [])
        ways.append(wire.field(3, wire.field(1, way_id) + wire.field(2, wire.pack(keys)) + wire.field(3, wire.pack(vals)) + wire.field(8, wire.pack_signed(_steps(np.array(refs or [], np.int64))))))
    return wire.field(1, b"".join(wire.field(1, s.encode()) for s in numbers)) + wire.field(2, b"".join(ways))


def _located(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of an address, or of a plain path."""
    files, path = fs.FileSystem.from_uri(uri)
    return files, path.rstrip("/")


class OsmPbf(DataSource):
    """``format("osm_pbf")``: nodes (node, lat, lon) or ways (way_id, tags, refs) of binary map files.

    Options: ``path`` (a file, or a folder whose ``.pbf`` files are read), ``kind``
    (``nodes`` or ``ways``), ``splitBytes`` (64 MB).  Of tags with the same key the last
    counts, relations and tags of nodes are not read.  Blobs must be plain or zlib; other
    packings, files that end early and broken messages are errors.  Writing takes the
    columns of either kind, leaves out tags without a value and adds files, or replaces
    them with mode ``overwrite``; coordinates keep seven decimals.
    """

    @classmethod
    def name(cls) -> str:
        return "osm_pbf"

    def schema(self) -> str:
        kind = self.options.get("kind", "nodes")
        if kind not in SCHEMAS:
            raise ValueError(f"kind is nodes or ways, not {kind}")
        return SCHEMAS[kind]

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        names = set(schema.names)
        kind = next((k for k, s in _ARROW.items() if set(s.names) <= names), None)
        if kind is None:
            raise ValueError("columns node, lat, lon or way_id, tags, refs are needed")
        return _Writer(self.options, kind, overwrite)


def read(spark: SparkSession, path: str, kind: str, split_bytes: int = 64 << 20) -> DataFrame:
    """Nodes or ways of binary map files."""
    spark.dataSource.register(OsmPbf)
    return spark.read.format("osm_pbf").option("kind", kind).option("splitBytes", split_bytes).load(path)


def write(df: DataFrame, path: str) -> None:
    """Nodes (node, lat, lon) or ways (way_id, tags, refs) added to a folder of binary map files."""
    df.sparkSession.dataSource.register(OsmPbf)
    df.write.format("osm_pbf").mode("append").save(path)


def within(nodes: DataFrame, least_lat: float, least_lon: float, most_lat: float, most_lon: float) -> DataFrame:
    """Nodes in a box, its edges included."""
    return nodes.where(nodes["lat"].between(least_lat, most_lat) & nodes["lon"].between(least_lon, most_lon))
