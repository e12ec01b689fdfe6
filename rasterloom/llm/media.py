"""Media columns: byte archives written by tasks and read back by a custom data source.

Payloads become grayscale PNG images of ``ROW`` samples a row, stored in ZIP archives.
The data source lists archives, plans byte ranges over them, reads each archive's own
member directory inside the tasks and streams batches of payloads through Arrow.  A member
that fails to read is fetched again alone, by its offset.
"""

from __future__ import annotations

import hashlib
import io
import struct
import time
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .workspace import Scratch

#: Samples of 8 bits in a row of an image; payloads are padded with spaces to a multiple of it.
ROW = 192
#: An archive is closed once it holds so many bytes.
ARCHIVE_BYTES = 32 << 20
#: Bytes of an archive that one read task covers, and the number of ranges beyond which they grow.
RANGE_BYTES, MAX_RANGES = 8 << 20, 100_000
#: Payload bytes in one Arrow batch of the reader.
BATCH_BYTES = 8 << 20
#: Reads of a member before its failure is raised.
ATTEMPTS = 4

PNG_MAGIC = b"\x89PNG\r\n\x1a\n"


def padded(data: bytes) -> bytes:
    """``data`` with spaces up to a positive multiple of ``ROW``."""
    size = max(ROW, -(-len(data) // ROW) * ROW)
    return data + b" " * (size - len(data))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(payload: bytes, n_bytes: int, level: int = 6) -> bytes:
    """Lossless 8-bit grayscale image of ``payload``; the unpadded length is kept as text."""
    height = len(payload) // ROW
    rows = b"".join(b"\x00" + payload[i:i + ROW] for i in range(0, len(payload), ROW))
    return (
        PNG_MAGIC + _chunk(b"IHDR", struct.pack(">IIBBBBB", ROW, height, 8, 0, 0, 0, 0))
        + _chunk(b"tEXt", b"length\x00" + str(n_bytes).encode()) + _chunk(b"IDAT", zlib.compress(rows, level)) + _chunk(b"IEND", b""))


def decode_png(data: bytes) -> tuple[bytes, int, int]:
    """Payload, unpadded length and height of an image that ``encode_png`` made."""
    if data[:8] != PNG_MAGIC:
        raise ValueError("not a PNG image")
    at, body, height, width, n_bytes = 8, [], 0, 0, -1
    while at < len(data):
        if len(data) < at + 12:
            raise ValueError("truncated PNG image")
        size, kind = struct.unpack(">I4s", data[at:at + 8])
        part = data[at + 8:at + 8 + size]
        if struct.pack(">I", zlib.crc32(kind + part)) != data[at + 8 + size:at + 12 + size]:
            raise ValueError("damaged PNG chunk")
        if kind == b"IHDR":
            width, height = struct.unpack(">II", part[:8])
        elif kind == b"tEXt" and part.startswith(b"length\x00"):
            n_bytes = int(part[7:])
        elif kind == b"IDAT":
            body.append(part)
        at += 12 + size
    rows = zlib.decompress(b"".join(body))
    if len(rows) != height * (width + 1):
        raise ValueError("truncated PNG image")
    return b"".join(rows[i + 1:i + 1 + width] for i in range(0, len(rows), width + 1)), n_bytes, height


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


class ArchiveWriter:
    """ZIP archive of stored members, kept in memory up to ``ARCHIVE_BYTES`` and then written at once."""

    def __init__(self):
        self.body, self.directory, self.n = io.BytesIO(), io.BytesIO(), 0

    def add(self, name: bytes, data: bytes) -> None:
        crc, at = zlib.crc32(data), self.body.tell()
        common = struct.pack("<HHHHHIIIHH", 20, 0x800, 0, 0, 0x21, crc, len(data), len(data), len(name), 0)
        self.body.write(b"PK\x03\x04" + common + name + data)
        self.directory.write(b"PK\x01\x02" + struct.pack("<H", 20) + common + struct.pack("<HHHII", 0, 0, 0, 0, at) + name)
        self.n += 1

    def finish(self) -> bytes:
        at, listing = self.body.tell(), self.directory.getvalue()
        zip64 = b"PK\x06\x06" + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, self.n, self.n, len(listing), at)
        locator = b"PK\x06\x07" + struct.pack("<IQI", 0, at + len(listing), 1)
        end = b"PK\x05\x06" + struct.pack("<HHHHIIH", 0, 0, min(self.n, 0xFFFF), min(self.n, 0xFFFF), len(listing), at, 0)
        return self.body.getvalue() + listing + zip64 + locator + end


def read_directory(source: pa.NativeFile, size: int) -> list[tuple[bytes, int, int, int]]:
    """``(name, offset, length, crc)`` of an archive's members from its own directory."""
    source.seek(max(0, size - 22))
    end = source.read(22)
    if len(end) < 22:
        raise OSError("archive is cut off")
    if end[:4] != b"PK\x05\x06":
        raise ValueError("archive without directory")
    length, at = struct.unpack("<II", end[12:20])
    source.seek(at)
    listing, members, i = source.read(length), [], 0
    if len(listing) < length:
        raise OSError("archive's directory is cut off")
    while i < len(listing):
        crc, stored, _, name_len, extra, comment = struct.unpack("<IIIHHH", listing[i + 16:i + 34])
        offset = struct.unpack("<I", listing[i + 42:i + 46])[0]
        members.append((listing[i + 46:i + 46 + name_len], offset, stored, crc))
        i += 46 + name_len + extra + comment
    return members


def read_member(source: pa.NativeFile, offset: int, length: int, crc: int) -> bytes:
    source.seek(offset)
    head = source.read(30)
    if len(head) < 30:
        raise OSError(f"member at offset {offset} is cut off")
    name_len, extra = struct.unpack("<HH", head[26:30])
    source.seek(offset + 30 + name_len + extra)
    data = source.read(length)
    if len(data) != length or zlib.crc32(data) != crc:
        raise OSError(f"member at offset {offset} is damaged")
    return data


class ByteRange(InputPartition):
    """Members of an archive whose offset lies in [start, stop)."""

    def __init__(self, uri: str, size: int, start: int, stop: int):
        super().__init__((uri, start))
        self.uri, self.size, self.start, self.stop = uri, size, start, stop


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.manifest = options["path"], options.get("manifest")
        self.range_bytes = int(options.get("range_bytes", RANGE_BYTES))
        self.batch_bytes = int(options.get("batch_bytes", BATCH_BYTES))
        self.attempts = int(options.get("attempts", ATTEMPTS))

    def partitions(self) -> list[InputPartition]:
        """Only names and sizes of archives reach the planner; directories are read by tasks.

        Ranges grow where there would be more than ``MAX_RANGES``.  With a ``manifest`` only the
        archives that it lists count, so what a failed attempt left is not read.
        """
        fs, path = filesystem(self.root)
        base = self.root.rstrip("/")
        there = fs.get_file_info(pafs.FileSelector(path, allow_not_found=True))
        listed = self._listed()
        archives = sorted((x for x in there if x.is_file and x.base_name.endswith(".zip") and (listed is None or x.base_name in listed)), key=lambda x: x.path)
        if listed is not None and len(archives) < len(listed):
            raise OSError(f"{len(listed) - len(archives)} archives of the manifest are missing")
        step = max(self.range_bytes, sum(x.size for x in archives) // MAX_RANGES)
        out: list[InputPartition] = [
            ByteRange(f"{base}/{x.base_name}", x.size, start, start + step) for x in archives for start in range(0, x.size, step)]
        return out or [ByteRange("", 0, 0, 0)]

    def _listed(self) -> set[str] | None:
        if not self.manifest:
            return None
        fs, path = filesystem(self.manifest)
        names: set[str] = set()
        for info in fs.get_file_info(pafs.FileSelector(path)):
            if info.is_file and info.base_name.endswith(".parquet"):
                with fs.open_input_file(info.path) as source:
                    names.update(pq.read_table(source, columns=["archive"]).column(0).to_pylist())
        return names

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.uri:
            return
        fs, path = filesystem(partition.uri)
        source = self._retry(lambda: fs.open_input_file(path))
        members = self._retry(lambda: read_directory(source, partition.size))
        rows, held = [], 0
        for name, offset, length, crc in members:
            if not partition.start <= offset < partition.stop:
                continue
            try:
                data = read_member(source, offset, length, crc)
            except OSError:
                source, data = self._again(fs, path, offset, length, crc)
            rows.append((name.decode(), partition.uri, offset, data))
            held += length
            if held >= self.batch_bytes:
                yield self._batch(rows)
                rows, held = [], 0
        if rows:
            yield self._batch(rows)

    def _again(self, fs, path: str, offset: int, length: int, crc: int):
        """One member from a newly opened file; members read before it stay as they are."""
        def once():
            source = fs.open_input_file(path)
            return source, read_member(source, offset, length, crc)
        return self._retry(once)

    def _retry(self, call):
        for tried in range(1, self.attempts + 1):
            try:
                return call()
            except OSError:
                if tried == self.attempts:
                    raise
                time.sleep(0.05 * 2 ** tried)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.string(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays(
            [pa.array(col, kind) for col, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names=["member", "archive", "offset", "content"])


class ArchiveSource(DataSource):
    """``spark.read.format("media_archive").load(folder)`` -> ``member, archive, offset, content``."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return "member string, archive string, offset long, content binary"

    def reader(self, schema) -> DataSourceReader:
        return ArchiveReader(self.options)


def read_archives(spark: SparkSession, folder: str, **options) -> DataFrame:
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("media_archive").options(**{k: str(v) for k, v in options.items()}).load(folder)


def write_archives(docs: DataFrame, folder: str, manifest: str, id_col: str = "doc_id", text_col: str = "text", archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Stores every text as an image in archives under ``folder``.

    Every attempt of a task writes archives of its own.  The Parquet table ``manifest``
    lists those of the attempts that counted; readers take no others.  Members carry ids,
    string ids after an apostrophe, and ``null`` for a missing one.
    """
    kind = dict(docs.dtypes)[id_col]
    quote = "'" if kind == "string" else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        part, k, archive = context.partitionId(), 0, ArchiveWriter()

        def close():
            nonlocal archive, k
            data, n, name = archive.finish(), archive.n, f"part-{part:06d}-{context.taskAttemptId()}-{k:05d}.zip"
            with fs.open_output_stream(f"{root}/{name}") as out:
                out.write(data)
            archive, k = ArchiveWriter(), k + 1
            return pa.RecordBatch.from_pydict({"archive": [name], "members": pa.array([n], pa.int64()), "bytes": pa.array([len(data)], pa.int64())})

        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                data = (text.as_py() or "").encode()
                name = b"null" if not doc.is_valid else f"{quote}{doc.as_py()}".encode()
                archive.add(name, encode_png(padded(data), len(data)))
                if archive.body.tell() >= archive_bytes:
                    yield close()
        if archive.n:
            yield close()

    if kind not in ("bigint", "int", "string"):
        raise TypeError(f"ids of type {kind} can't name members")
    docs.select(id_col, text_col).mapInArrow(run, "archive string, members long, bytes long").write.parquet(manifest)


def payload_features(archives: DataFrame, id_col: str = "doc_id", id_type: str = "long") -> DataFrame:
    """Decodes stored images and describes their payloads.

    ``n_bytes``, ``payload_bytes``, ``payload_sha256``, ``tail_crc32`` (last 16 bytes),
    ``media_bytes``, ``media_sha256`` and ``feature``: height, mean, standard deviation and
    entropy of the samples.  All follow from the stored bytes alone.
    """
    import numpy as np

    def describe(media: bytes) -> tuple:
        payload, n_bytes, height = decode_png(media)
        hist = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
        n, levels = len(payload), np.arange(256)
        mean = int((hist * levels).sum()) / n
        var = int((hist * levels * levels).sum()) / n - mean * mean
        p = hist[hist > 0] / n
        entropy = float(-(p * np.log2(p)).sum())
        return (
            n_bytes, n, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(),
            f"height={height};mean={mean:.4f};std={max(var, 0.0) ** 0.5:.4f};entropy={abs(entropy):.4f}")

    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = list(zip(*(describe(x.as_py()) for x in batch.column("content")), strict=True)) or [[] for _ in names]
            yield pa.RecordBatch.from_arrays(
                [batch.column("member"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["member", *names])

    described = archives.select("member", "content").mapInArrow(
        run, "member string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    named = F.expr("nullif(member, 'null')")
    own = F.expr("substring(nullif(member, 'null'), 2)") if id_type == "string" else named.try_cast(id_type)
    return described.select(own.alias(id_col), *names)


def media_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts stored as media, read back through the data source and described.

    Null text counts as empty (one row of spaces); a null id comes back null; repeated rows
    are stored each; an empty table gives an empty result; a text is held whole by one task.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "media")
    folder, manifest = scratch.path("archives"), scratch.path("manifest")
    write_archives(docs, folder, manifest, id_col, text_col)
    return payload_features(read_archives(spark, folder, manifest=manifest), id_col, dict(docs.dtypes)[id_col])
