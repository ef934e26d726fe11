"""Members of ZIP archives as rows, batch or stream, read by byte range.

``index_archives`` stores next to every archive the list of its members with
their offsets. The source cuts archives into ranges of bytes; a task opens one
range, reads the members that begin in it and nothing else. A member that can't
be read, and an archive without a directory, gives a row with the reason, so one
broken file doesn't stop a scan.
"""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

OFFSETS = ".offsets"
RANGE_BYTES = 32 << 20
SCHEMA = "archive string, member string, offset long, size long, raw binary, error string"
_LIST = pa.schema([("member", pa.string()), ("offset", pa.int64()), ("packed", pa.int64()), ("size", pa.int64()), ("method", pa.int32()), ("crc", pa.int64()), ("error", pa.string())])


def archives(folder: str) -> list[tuple[str, int]]:
    """(uri, bytes) of the archives of a folder, by name."""
    fs, root = pafs.FileSystem.from_uri(folder)
    scheme = folder[: len(folder) - len(root)] if folder.endswith(root) else ""
    return sorted((scheme + i.path, i.size) for i in fs.get_file_info(pafs.FileSelector(root)) if i.path.endswith(".zip"))


def _open(uri: str) -> pa.NativeFile:
    fs, path = pafs.FileSystem.from_uri(uri)
    return fs.open_input_file(path)


def _write_offsets(uri: str) -> int:
    """Store the member list of one archive; its directory is read, its data isn't."""
    rows: list[dict] = []
    try:
        with _open(uri) as f, zipfile.ZipFile(f) as z:
            for m in z.infolist():
                if not m.is_dir():
                    rows.append({"member": m.filename, "offset": m.header_offset, "packed": m.compress_size, "size": m.file_size, "method": m.compress_type, "crc": m.CRC,
                                 "error": "encrypted" if m.flag_bits & 1 else None})
    except (zipfile.BadZipFile, OSError, ValueError) as error:
        rows = [{"member": None, "offset": 0, "packed": 0, "size": 0, "method": 0, "crc": 0, "error": f"archive: {error}"}]
    out = io.BytesIO()
    pq.write_table(pa.Table.from_pylist(sorted(rows, key=lambda r: r["offset"]), schema=_LIST), out, row_group_size=4096)
    fs, path = pafs.FileSystem.from_uri(uri + OFFSETS)
    with fs.open_output_stream(f"{path}.part", compression=None) as f:
        f.write(out.getvalue())
    fs.move(f"{path}.part", path)
    return len(rows)


def index_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Store the offset list of every archive that has none yet; (archive, n_members) of those."""
    fs, _ = pafs.FileSystem.from_uri(folder)
    new = [(u,) for u, _ in archives(folder) if fs.get_file_info(pafs.FileSystem.from_uri(u + OFFSETS)[1]).type == pafs.FileType.NotFound]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("archive").to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([_write_offsets(u) for u in names], pa.int64())], names=["archive", "n_members"])

    schema = "archive string, n_members long"
    done = spark.createDataFrame(new, "archive string").repartition(max(1, min(len(new), spark.sparkContext.defaultParallelism * 4))).mapInArrow(run, schema).collect()
    return spark.createDataFrame(done, schema)


def _member(f: pa.NativeFile, row: dict) -> bytes:
    """Bytes of one member, checked; raises with the reason."""
    f.seek(row["offset"])
    header = f.read(30)
    if len(header) < 30 or header[:4] != b"PK\x03\x04":
        raise ValueError("no member header at this offset")
    name, extra = struct.unpack("<HH", header[26:30])
    f.seek(row["offset"] + 30 + name + extra)
    data = f.read(row["packed"])
    if len(data) < row["packed"]:
        raise ValueError("archive ends inside the member")
    if row["method"] == zipfile.ZIP_DEFLATED:
        data = zlib.decompress(data, -15)
    elif row["method"] != zipfile.ZIP_STORED:
        raise ValueError(f"compression method {row['method']}")
    if len(data) != row["size"] or zlib.crc32(data) != row["crc"]:
        raise ValueError("checksum differs")
    return data


class ByteRange(InputPartition):
    def __init__(self, uri: str, low: int, high: int) -> None:
        self.uri, self.low, self.high = uri, low, high


def _ranges(found: list[tuple[str, int]], width: int) -> list[ByteRange]:
    return [ByteRange(u, low, low + width) for u, size in found for low in range(0, max(size, 1), width)]


def _read(part: ByteRange) -> Iterator[tuple]:
    with _open(part.uri + OFFSETS) as f:
        rows = pq.read_table(f, filters=[("offset", ">=", part.low), ("offset", "<", part.high)]).to_pylist()
    if not rows:
        return
    with _open(part.uri) as f:
        for row in rows:
            raw, error = None, row["error"]
            if error is None:
                try:
                    raw = _member(f, row)
                except (ValueError, OSError, zlib.error) as problem:
                    error = str(problem)
            yield part.uri, row["member"], row["offset"], row["size"], raw, error


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return _ranges(archives(self.options["path"]), int(self.options.get("rangebytes", RANGE_BYTES)))

    def read(self, partition: ByteRange) -> Iterator[tuple]:
        yield from _read(partition)


class _StreamReader(DataSourceStreamReader):
    """Archives are taken in by name: one that arrives must sort behind those read before."""

    def __init__(self, options: dict) -> None:
        self.options = options

    def initialOffset(self) -> dict:  # noqa: N802
        return {"after": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        found = archives(self.options["path"])
        return {"after": found[-1][0] if found else ""}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return _ranges([(u, n) for u, n in archives(self.options["path"]) if start["after"] < u <= end["after"]], int(self.options.get("rangebytes", RANGE_BYTES)))

    def read(self, partition: ByteRange) -> Iterator[tuple]:
        yield from _read(partition)

    def commit(self, end: dict) -> None:
        pass


class ArchiveSource(DataSource):
    """Format ``archive_members``: options ``path`` (folder of indexed archives) and ``rangeBytes``."""

    @classmethod
    def name(cls) -> str:
        return "archive_members"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader({k.lower(): v for k, v in self.options.items()})

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _StreamReader({k.lower(): v for k, v in self.options.items()})


def read_archives(spark: SparkSession, folder: str, range_bytes: int = RANGE_BYTES, stream: bool = False) -> DataFrame:
    """(archive, member, offset, size, raw, error) of all members of the indexed archives of ``folder``."""
    spark.dataSource.register(ArchiveSource)
    reader = spark.readStream if stream else spark.read
    return reader.format("archive_members").option("path", folder).option("rangeBytes", str(range_bytes)).load()


def write_archives(rows: DataFrame, folder: str, member: str, raw: str) -> DataFrame:
    """One archive per task from (member, bytes) rows: (archive, n_members)."""
    fs, path = pafs.FileSystem.from_uri(folder)
    fs.create_dir(path, recursive=True)
    src = rows.select(F.col(member).alias("member"), F.col(raw).alias("raw"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tempfile

        from pyspark import TaskContext

        n, name = 0, f"{folder.rstrip('/')}/part-{TaskContext.get().partitionId():05d}.zip"
        # ZIP needs a seekable file while it is written; the finished one is moved into place in pieces.
        with tempfile.TemporaryFile() as local:
            with zipfile.ZipFile(local, "w", zipfile.ZIP_DEFLATED) as z:
                for batch in batches:
                    for m, data in zip(batch.column("member").to_pylist(), batch.column("raw").to_pylist(), strict=True):
                        z.writestr(m, data or b"")
                        n += 1
            if not n:
                return
            target, place = pafs.FileSystem.from_uri(name)
            attempt = f"{place}.{TaskContext.get().attemptNumber()}.part"
            local.seek(0)
            with target.open_output_stream(attempt, compression=None) as out:
                while chunk := local.read(1 << 20):
                    out.write(chunk)
            target.move(attempt, place)
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], names=["archive", "n_members"])

    return src.mapInArrow(run, "archive string, n_members long")
