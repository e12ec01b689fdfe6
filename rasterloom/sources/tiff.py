"""Tiled TIFF files as rows of tiles: windows, bands and overviews are filters on the scan, and only the tiles they leave are read.

A row is one stored tile of one band: ``name, overview, band, height, width`` of its image,
``ty, tx`` its place, ``y0, y1, x0, x1`` the pixels that it covers, ``values`` its numbers by
row, ``tile_width`` a row.  Numbers that stand for missing ones, and places beyond the image, are NaN, as in
:mod:`..operators.tiles`.  Files may be classic or big, of either byte order, tiled or in
strips, with bands side by side or apart, plain, deflated or in LZW codes, with or without
horizontal differences; other compressions are refused by name.  Indexed colours are read as
bands 0 to 2, of 8 bits.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from ..operators.durable import durable

SCHEMA = "name string, overview int, band int, height int, width int, ty int, tx int, y0 int, y1 int, x0 int, x1 int, tile_width int, values array<double>"
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]

#: Bytes of files that one task plans to read.
SPLIT_BYTES = 128 << 20
#: Neighbouring tiles are read at once up to this many bytes.
READ_BYTES = 8 << 20
#: Numbers beyond which a tile is refused, against files that claim too much.
MAX_TILE = 1 << 27
#: Tile numbers of a batch handed to Spark.
BATCH_VALUES = 1 << 20

#: Tags of the format.
SUBFILE, WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 254, 256, 257, 258, 259, 262
STRIPS, SAMPLES, ROWS, STRIP_BYTES, PLANAR, PREDICTOR = 273, 277, 278, 279, 284, 317
PALETTE, TILE_WIDTH, TILE_HEIGHT, TILES, TILE_BYTES, FORMAT, NODATA = 320, 322, 323, 324, 325, 339, 42113
#: Codes of field types.
TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 7: "B", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q", 17: "q", 18: "Q"}
#: Sample formats by NumPy kind.
FORMATS = {"u": 1, "i": 2, "f": 3}


# files -------------------------------------------------------------------------------


def from_lzw(raw: bytes, limit: int) -> bytes:
    """Bytes of LZW codes of 9 to 12 bits, high bits first, widened one code early; at most ``limit`` are taken."""
    known = [bytes([i]) for i in range(256)] + [b"", b""]
    out, size, width, bits, held, before = [], 0, 9, 0, 0, None
    for byte in raw:
        bits, held = bits << 8 | byte, held + 8
        if held < width:
            continue
        held -= width
        code, bits = bits >> held, bits & ((1 << held) - 1)
        if code == 257 or size >= limit:
            break
        if code == 256:
            del known[258:]
            width, before = 9, None
            continue
        if code > len(known) or (code == len(known) and before is None):
            raise ValueError("damaged LZW codes")
        if before is None:
            piece = known[code]
        else:
            piece = known[code] if code < len(known) else before + before[:1]
            known.append(before + piece[:1])
        out.append(piece)
        size, before = size + len(piece), piece
        if len(known) >= (1 << width) - 1 and width < 12:
            width += 1
    return b"".join(out)[:limit]


@dataclass
class Directory:
    """One image of a file: its size and where its tiles are stored."""

    order: str
    tags: dict[int, tuple]

    def one(self, tag: int, default=None):
        return self.tags.get(tag, (default,))[0]

    def __post_init__(self):
        self.height, self.width = self.one(HEIGHT, 0), self.one(WIDTH, 0)
        self.tile_height = self.one(TILE_HEIGHT) or min(self.one(ROWS, self.height), self.height)
        self.tile_width = self.one(TILE_WIDTH) or self.width
        self.offsets, self.lengths = (self.tags.get(a) or self.tags.get(b) for a, b in ((TILES, STRIPS), (TILE_BYTES, STRIP_BYTES)))
        self.samples, self.apart = self.one(SAMPLES, 1), self.one(PLANAR, 1) == 2
        if min(self.height, self.width, self.tile_height, self.tile_width, self.samples) < 1 or not self.offsets or len(self.offsets) != len(self.lengths or ()):
            raise ValueError("a directory lacks sizes or places")
        if self.tile_height * self.tile_width * self.samples > MAX_TILE:
            raise ValueError(f"tiles of more than {MAX_TILE} numbers are not read")
        self.palette = np.array(self.tags[PALETTE]).reshape(3, -1).T >> 8 if self.one(PHOTOMETRIC) == 3 and PALETTE in self.tags else None
        self.down, self.across = -(-self.height // self.tile_height), -(-self.width // self.tile_width)
        kind = {v: k for k, v in FORMATS.items()}.get(self.one(FORMAT, 1))
        if kind is None or self.one(BITS, 1) % 8:
            raise ValueError(f"samples of format {self.one(FORMAT, 1)} with {self.one(BITS, 1)} bits are not read")
        self.dtype = np.dtype(f"{self.order}{kind}{self.one(BITS, 1) // 8}")
        text = self.tags.get(NODATA)
        self.nodata = float(text[0].split(b"\0")[0]) if text else None

    def place(self, index: int) -> tuple[list[int], int, int]:
        """Bands, row and column of the stored tile ``index``."""
        each = self.down * self.across
        bands = [0, 1, 2] if self.palette is not None else [index // each] if self.apart else list(range(self.samples))
        return bands, index % each // self.across, index % self.across

    def decode(self, raw: bytes) -> np.ndarray:
        """``(rows, columns, bands)`` of a stored tile."""
        how = self.one(COMPRESSION, 1)
        most = self.tile_height * self.tile_width * (1 if self.apart else self.samples) * self.dtype.itemsize
        if how in (8, 32946):
            raw = zlib.decompressobj().decompress(raw, most)
        elif how == 5:
            raw = from_lzw(raw, most)
        elif how != 1:
            raise ValueError(f"compression {how} is not read")
        a = np.frombuffer(raw, dtype=self.dtype).reshape(-1, self.tile_width, 1 if self.apart else self.samples)
        if self.one(PREDICTOR, 1) == 2:
            a = np.cumsum(a, axis=1, dtype=self.dtype)
        elif self.one(PREDICTOR, 1) != 1:
            raise ValueError(f"predictor {self.one(PREDICTOR)} is not read")
        return a if self.palette is None else self.palette[a[:, :, 0]]

    def numbers(self, a: np.ndarray, ty: int, tx: int, missing: bool) -> np.ndarray:
        """Doubles of a whole tile of one band, NaN beyond the image and where ``missing`` values stand."""
        out = np.full((self.tile_height, self.tile_width), np.nan)
        rows, columns = min(len(a), self.height - ty * self.tile_height), min(self.tile_width, self.width - tx * self.tile_width)
        out[:rows, :columns] = a[:rows, :columns]
        if missing and self.nodata is not None:
            out[out == self.nodata] = np.nan
        return out


def read_directories(source, size: int) -> Iterator[Directory]:
    """Directories of a file, first the image itself, then its overviews; only their bytes are read."""
    def take(at: int, n: int) -> bytes:
        if not 0 <= at <= at + n <= size:
            raise ValueError("the file ends within its directories")
        source.seek(at)
        return source.read(n)

    head = take(0, min(16, size))
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    version = struct.unpack(f"{order}H", head[2:4])[0] if order and len(head) >= 8 else None
    if version not in (42, 43):
        raise ValueError("not a TIFF file")
    word, counter, entry = ("I", "H", 12) if version == 42 else ("Q", "Q", 20)
    wide, narrow = struct.calcsize(f"={word}"), struct.calcsize(f"={counter}")
    at = struct.unpack(f"{order}{word}", head[4:8] if version == 42 else head[8:16])[0]
    seen = set()
    while at and at not in seen:
        seen.add(at)
        n = struct.unpack(f"{order}{counter}", take(at, narrow))[0]
        body, tags = take(at + narrow, n * entry + wide), {}
        for i in range(n):
            tag, kind, count = struct.unpack(f"{order}HH{word}", body[i * entry:i * entry + 4 + wide])
            code = TYPES.get(kind)
            if code is None:
                continue
            layout = f"{order}{count}s" if code == "s" else f"{order}{count * len(code)}{code[0]}"
            held = body[i * entry + 4 + wide:(i + 1) * entry]
            length = struct.calcsize(layout)
            tags[tag] = struct.unpack(layout, held[:length] if length <= wide else take(struct.unpack(f"{order}{word}", held)[0], length))
        yield Directory(order, tags)
        at = struct.unpack(f"{order}{word}", body[n * entry:])[0]


def header(images: Sequence[dict], big: bool | None = None) -> bytes:
    """Bytes of a file up to its first tile; ``images`` hold ``height, width, bands, tile, dtype, nodata, lengths``.

    All directories come first, so readers find any tile with one read from the start; tiles
    follow in the order of ``lengths``, those of length 0 are not stored.  A file of 4 GB or
    more is a big TIFF, unless ``big`` says which.
    """
    total = sum(sum(i["lengths"]) for i in images)
    if big is None:
        big = total + sum(16 * len(i["lengths"]) + 1024 for i in images) >= 1 << 32
    word, code, entry = ("Q", 16, 20) if big else ("I", 4, 12)
    wide = struct.calcsize(f"<{word}")

    def built(start: int) -> bytes:
        out = struct.pack("<2sHHHQ", b"II", 43, 8, 0, 16) if big else struct.pack("<2sHI", b"II", 42, 8)
        at = start
        for k, image in enumerate(images):
            dtype, bands, lengths = np.dtype(image["dtype"]), image["bands"], image["lengths"]
            ends = np.concatenate([[0], np.cumsum(lengths)]).tolist()
            places = [at + e if n else 0 for e, n in zip(ends, lengths)]
            at += ends[-1]
            fields = [
                (SUBFILE, 4, [int(k > 0)]), (WIDTH, 4, [image["width"]]), (HEIGHT, 4, [image["height"]]), (BITS, 3, [dtype.itemsize * 8] * bands),
                (COMPRESSION, 3, [8]), (PHOTOMETRIC, 3, [1]), (SAMPLES, 3, [bands]), (PLANAR, 3, [2 if bands > 1 else 1]), (TILE_WIDTH, 4, [image["tile"]]),
                (TILE_HEIGHT, 4, [image["tile"]]), (TILES, code, places), (TILE_BYTES, code, lengths), (FORMAT, 3, [FORMATS[dtype.kind]] * bands)]
            if image["nodata"] is not None:
                fields.append((NODATA, 2, repr(float(image["nodata"])).encode() + b"\0"))
            n = len(fields)
            body, extra = struct.pack("<Q" if big else "<H", n), b""
            base = len(out) + len(body) + n * entry + wide
            for tag, kind, values in fields:
                packed = bytes(values) if kind == 2 else struct.pack(f"<{len(values)}{TYPES[kind]}", *values)
                body += struct.pack(f"<HH{word}", tag, kind, len(values))
                if len(packed) > wide:
                    body, extra = body + struct.pack(f"<{word}", base + len(extra)), extra + packed + b"\0" * (-len(packed) % 8)
                else:
                    body += packed.ljust(wide, b"\0")
            end = base + len(extra)
            out += body + struct.pack(f"<{word}", end if k + 1 < len(images) else 0) + extra
        return out

    return built(len(built(0)))


# scan --------------------------------------------------------------------------------


@dataclass
class Bytes(InputPartition):
    """Byte ranges ``(path, start, stop)``; a task reads the tiles that start in them."""

    ranges: list[tuple[str, int, int]] = field(default_factory=list)


#: Filters that a scan decides by itself, on whole numbers and names.
COMPARED = {
    EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b,
    LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, In: lambda a, b: a in b}


class TiffReader(DataSourceReader):
    """Plans byte ranges from the files' sizes alone; headers are read in tasks."""

    def __init__(self, options):
        self.folder = options["path"]
        self.split = int(options.get("split_bytes", SPLIT_BYTES))
        self.missing = str(options.get("nodata", "nan")).lower() == "nan"
        self.tests: list[tuple[str, type, object]] = []
        #: Bytes that this copy of the reader has fetched.
        self.fetched = 0

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if type(f) in COMPARED and len(f.attribute) == 1 and f.attribute[0] in COLUMNS[:-1]:
                self.tests.append((f.attribute[0], type(f), f.value))
            else:
                yield f

    def passes(self, **row) -> bool:
        """Whether a tile of which these columns are known may pass the filters."""
        return all(c not in row or COMPARED[kind](row[c], value) for c, kind, value in self.tests)

    def partitions(self) -> list[InputPartition]:
        fs, root = pafs.FileSystem.from_uri(self.folder)
        out, held = [], 0
        for info in sorted(fs.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True)), key=lambda i: i.path):
            base = info.base_name
            if info.type != pafs.FileType.File or base[0] in "._" or not base.lower().endswith((".tif", ".tiff")) or not self.passes(name=named(base)):
                continue
            for start in range(0, info.size, self.split):
                stop = min(start + self.split, info.size)
                if not out or held + stop - start > self.split:
                    out.append(Bytes())
                    held = 0
                out[-1].ranges.append((info.path, start, stop))
                held += stop - start
        return out or [Bytes()]

    def wanted(self, directory: Directory, name: str, overview: int, start: int, stop: int) -> list[tuple[int, int, int, list[dict]]]:
        """``(offset, length, index, rows)`` of the tiles to read, by place in the file."""
        out = []
        whole = {"name": name, "overview": overview, "height": directory.height, "width": directory.width, "tile_width": directory.tile_width}
        if not self.passes(**whole):
            return out
        for index, (offset, length) in enumerate(zip(directory.offsets, directory.lengths, strict=True)):
            if not length or not start <= offset < stop:
                continue
            bands, ty, tx = directory.place(index)
            y0, x0 = ty * directory.tile_height, tx * directory.tile_width
            place = {**whole, "ty": ty, "tx": tx, "y0": y0, "y1": min(y0 + directory.tile_height, directory.height), "x0": x0, "x1": min(x0 + directory.tile_width, directory.width)}
            rows = [{**place, "band": b} for b in bands if self.passes(**place, band=b)]
            if rows:
                out.append((offset, length, index, rows))
        return sorted(out, key=lambda t: t[0])

    def read(self, partition: Bytes) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(self.folder)
        rows, values, held = [], [], 0
        for path, start, stop in partition.ranges:
            with fs.open_input_file(path) as source:
                counted = Counted(source, self)
                for overview, directory in enumerate(read_directories(counted, source.size())):
                    for raw, index, wanted in fetched(counted, self.wanted(directory, named(path.rsplit("/", 1)[-1]), overview, start, stop)):
                        a = directory.decode(raw)
                        for row in wanted:
                            made = directory.numbers(a[:, :, row["band"] if a.shape[2] > 1 else 0], row["ty"], row["tx"], self.missing)
                            rows.append(row)
                            values.append(made.ravel())
                            held += made.size
                        if held >= BATCH_VALUES:
                            yield batch(rows, values)
                            rows, values, held = [], [], 0
        if rows:
            yield batch(rows, values)


class Counted:
    """A file whose reads are added up."""

    def __init__(self, source, reader: TiffReader):
        self.source, self.reader, self.seek = source, reader, source.seek

    def read(self, n: int) -> bytes:
        self.reader.fetched += n
        out = self.source.read(n)
        if len(out) != n:
            raise OSError(f"{n} bytes expected, {len(out)} read")
        return out


def fetched(source, tiles: list[tuple[int, int, int, list[dict]]]) -> Iterator[tuple[bytes, int, list[dict]]]:
    """Bytes of the tiles; those that lie end to end are read at once."""
    run: list[tuple[int, int, int, list[dict]]] = []
    for tile in [*tiles, None]:
        if run and (tile is None or tile[0] != run[-1][0] + run[-1][1] or tile[0] + tile[1] - run[0][0] > READ_BYTES):
            source.seek(run[0][0])
            raw = source.read(run[-1][0] + run[-1][1] - run[0][0])
            for offset, length, index, rows in run:
                yield raw[offset - run[0][0]:offset - run[0][0] + length], index, rows
            run = []
        if tile is not None:
            run.append(tile)


def batch(rows: list[dict], values: list[np.ndarray]) -> pa.RecordBatch:
    ends = np.concatenate([[0], np.cumsum([len(v) for v in values])])
    columns = [pa.array([r[c] for r in rows], pa.string() if c == "name" else pa.int32()) for c in COLUMNS[:-1]]
    return pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(values)))], names=COLUMNS)


def named(base: str) -> str:
    """Name of the image that a file holds."""
    return unquote(base.rsplit(".", 1)[0])


class TiffSource(DataSource):
    """``spark.read.format("tiff_tiles").load(folder)``."""

    @classmethod
    def name(cls) -> str:
        return "tiff_tiles"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return TiffReader(self.options)


def read_tiles(spark: SparkSession, folder: str, **options) -> DataFrame:
    """Tiles of every TIFF file below ``folder`` (any Arrow filesystem URI); an empty or absent folder has none.

    Filters on any column but ``values`` are decided by the scan, before tiles are read.  Spark
    hands filters to Python sources only where ``spark.sql.python.filterPushdown.enabled`` is
    on, so it is switched on here.  ``nodata="keep"`` returns stored numbers as they are;
    ``split_bytes`` is the size of a task's share.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TiffSource)
    return spark.read.format("tiff_tiles").options(**{k: str(v) for k, v in options.items()}).load(folder)


def window(tiles: DataFrame, y0: int, y1: int, x0: int, x1: int, overview: int = 0) -> DataFrame:
    """Pixels ``(name, band, y, x, v)`` of rows ``y0`` to ``y1`` and columns ``x0`` to ``x1`` (ends excluded) that are not missing.

    Places count in pixels of the overview.  Parts beyond an image give nothing.
    """
    met = tiles.where((F.col("overview") == overview) & (F.col("y1") > y0) & (F.col("y0") < y1) & (F.col("x1") > x0) & (F.col("x0") < x1))
    flat = met.select("name", "band", "y0", "x0", "tile_width", F.posexplode("values").alias("_i", "v"))
    y, x = F.col("y0") + F.floor(F.col("_i") / F.col("tile_width")), F.col("x0") + F.col("_i") % F.col("tile_width")
    placed = flat.select("name", "band", y.cast("int").alias("y"), x.cast("int").alias("x"), "v")
    return placed.where((F.col("y") >= y0) & (F.col("y") < y1) & (F.col("x") >= x0) & (F.col("x") < x1) & ~F.isnan("v"))


# writing -----------------------------------------------------------------------------


def quarters(batches: Iterator[pa.RecordBatch], tile: int, how: str) -> Iterator[pa.RecordBatch]:
    """Tiles of half the side, from every second number or the mean of those of each two by two that are not missing."""
    for b in batches:
        a = b.column(b.num_columns - 1).flatten().to_numpy().reshape(-1, tile, tile)
        if how == "nearest":
            small = a[:, ::2, ::2]
        else:
            four = a.reshape(-1, tile // 2, 2, tile // 2, 2)
            there = ~np.isnan(four)
            n = there.sum(axis=(2, 4))
            small = np.where(n > 0, np.where(there, four, 0.0).sum(axis=(2, 4)) / np.maximum(n, 1), np.nan)
        ends = np.arange(len(small) + 1) * (tile // 2) ** 2
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.ascontiguousarray(small).ravel()))], names=b.schema.names)


def joined(batches: Iterator[pa.RecordBatch], tile: int) -> Iterator[pa.RecordBatch]:
    """Whole tiles from up to four quarters ``(q, values)`` each, ``q`` = 2 * lower half + right half."""
    half = tile // 2
    for b in batches:
        out = np.full((len(b), tile, tile), np.nan)
        for i, parts in enumerate(b.column(b.num_columns - 1)):
            for part in parts:
                lower, right = divmod(part["q"].as_py(), 2)
                out[i, lower * half:(lower + 1) * half, right * half:(right + 1) * half] = part["values"].values.to_numpy().reshape(half, half)
        ends = np.arange(len(b) + 1) * tile * tile
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(out.ravel()))], names=b.schema.names)


_TILE = "name string, band int, height int, width int, ty int, tx int, values array<double>"


def overview(tiles: DataFrame, tile: int, how: str = "nearest") -> DataFrame:
    """Tiles ``name, band, height, width, ty, tx, values`` of images of half the size, rounded up; a tile comes from at most four."""
    small = tiles.mapInArrow(lambda bs: quarters(bs, tile, how), _TILE)
    half = lambda c: F.floor(F.col(c) / 2).cast("int")
    part = F.struct((F.col("ty") % 2 * 2 + F.col("tx") % 2).alias("q"), "values")
    size = lambda c: F.ceil(F.col(c) / 2).cast("int").alias(c)
    grouped = small.groupBy("name", "band", size("height"), size("width"), half("ty").alias("ty"), half("tx").alias("tx")).agg(F.collect_list(part).alias("values"))
    return grouped.mapInArrow(lambda bs: joined(bs, tile), _TILE)


def deflated(batches: Iterator[pa.RecordBatch], tile: int, dtype: str, nodata: float | None) -> Iterator[pa.RecordBatch]:
    """``level, band, height, width, ty, tx, n, payload``: tiles as they are stored; whole numbers are rounded half even and clipped to their type."""
    kind = np.dtype(dtype).newbyteorder("<")
    for b in batches:
        payloads = []
        for values in b.column("values"):
            a = values.values.to_numpy(zero_copy_only=False)
            a = np.where(np.isnan(a), nodata if nodata is not None else np.nan if kind.kind == "f" else 0, a)
            if kind.kind in "ui":
                a = np.clip(np.rint(a), np.iinfo(kind).min, np.iinfo(kind).max)
            payloads.append(zlib.compress(a.astype(kind).tobytes()))
        yield pa.RecordBatch.from_arrays(
            [*[b.column(c) for c in ("name", "level", "band", "height", "width", "ty", "tx")], pa.array(map(len, payloads), pa.int64()), pa.array(payloads, pa.binary())],
            names=["name", "level", "band", "height", "width", "ty", "tx", "n", "payload"])


def stored(batches: Iterator[pa.RecordBatch], folder: str, tile: int, dtype: str, nodata: float | None) -> Iterator[pa.RecordBatch]:
    """Writes files from rows sorted by name: first the image's layout, then its tiles in the order of the file.

    A file appears under its name when it is whole, so an attempt that is lost leaves only a
    hidden one behind and the next writes the same bytes.
    """
    import uuid

    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    sink = hidden = name = None
    size = 0

    def closed() -> pa.RecordBatch:
        sink.close()
        fs.move(hidden, f"{root}/{quote(name, safe='')}.tif")
        return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([size], pa.int64())], names=["name", "bytes"])

    for b in batches:
        for row in b.to_pylist():
            if row["layout"] is not None:
                if sink is not None:
                    yield closed()
                name, hidden = row["name"], f"{root}/_{uuid.uuid4().hex}"
                sink = fs.open_output_stream(hidden)
                images = []
                for at in row["layout"]:
                    down, across = -(-at["height"] // tile), -(-at["width"] // tile)
                    lengths = [0] * (down * across * row["bands"])
                    for t in at["tiles"]:
                        lengths[(t["band"] * down + t["ty"]) * across + t["tx"]] = t["n"]
                    images.append({"height": at["height"], "width": at["width"], "bands": row["bands"], "tile": tile, "dtype": dtype, "nodata": nodata, "lengths": lengths})
                data = header(images)
            else:
                data = row["payload"]
            sink.write(data)
            size = len(data) + (0 if row["layout"] is not None else size)
    if sink is not None:
        yield closed()


def write_tiles(tiles: DataFrame, folder: str, tile: int, dtype: str = "float32", nodata: float | None = None, overviews: int = 0, how: str = "nearest") -> DataFrame:
    """Writes ``name, band, height, width, ty, tx, values`` as one tiled, deflated TIFF a name; returns ``name, bytes`` of each, already written.

    ``tile`` is a multiple of 16.  NaN becomes ``nodata``, or 0 in whole numbers where that is
    unset; tiles without a row are not stored and read back as no row.  A null name or band, a
    band below 0, tiles that lie beyond their image and tiles given twice are refused.  Tables
    without rows write nothing.

    Tiles are deflated where they are; what is shuffled after that is stored bytes.  One task
    streams a file, tile after tile, and holds the lengths of its tiles (8 bytes each) but
    never an image.  Each of the ``overviews`` halves the one before, by ``how``: nearest or
    average.
    """
    if tile % 16 or tile <= 0:
        raise ValueError("the side of tiles must be a multiple of 16")
    if how not in ("nearest", "average"):
        raise ValueError(f"unknown resampling {how}")
    faults = "name is null or band is null or band < 0 or ty < 0 or tx < 0 or ty * {t} >= height or tx * {t} >= width or size(values) <> {t} * {t}".format(t=tile)
    fault = F.raise_error(F.concat(F.lit("not a tile of an image: "), F.coalesce(F.col("name"), F.lit("null")))).cast("string")
    level = tiles.select(
        F.when(F.coalesce(F.expr(faults), F.lit(True)), fault).otherwise(F.col("name")).alias("name"), *[F.col(c).cast("int").alias(c) for c in ("band", "height", "width", "ty", "tx")],
        F.transform("values", lambda v: F.coalesce(v.cast("double"), F.lit(float("nan")))).alias("values"))
    levels = [level]
    for _ in range(overviews):
        levels.append(overview(levels[-1], tile, how))
    every = levels[0].withColumn("level", F.lit(0))
    for k, made in enumerate(levels[1:], 1):
        every = every.unionByName(made.withColumn("level", F.lit(k)))
    kinds = "name string, level int, band int, height int, width int, ty int, tx int, n long, payload binary"
    packed = durable(every.mapInArrow(lambda bs: deflated(bs, tile, dtype, nodata), kinds))
    listed = packed.groupBy("name", "level", "height", "width").agg(F.sort_array(F.collect_list(F.struct("band", "ty", "tx", "n"))).alias("tiles"), F.max("band").alias("band"))
    once = F.size("tiles") == F.size(F.array_distinct(F.transform("tiles", lambda t: F.struct(t["band"], t["ty"], t["tx"]))))
    listed = listed.withColumn("tiles", F.when(once, F.col("tiles")).otherwise(F.raise_error(F.concat(F.lit("a tile is given twice: "), F.col("name"))).cast(listed.schema["tiles"].dataType)))
    layouts = listed.groupBy("name").agg(
        F.sort_array(F.collect_list(F.struct("level", "height", "width", "tiles"))).alias("layout"), (F.max("band") + 1).alias("bands"), F.count_if(F.col("level") == 0).alias("_sizes"))
    layouts = layouts.withColumn("layout", F.when(F.col("_sizes") == 1, F.col("layout")).otherwise(F.raise_error(F.concat(F.lit("tiles differ in the size of their image: "), F.col("name"))).cast(layouts.schema["layout"].dataType)))
    rows = layouts.select("name", "bands", "layout").unionByName(packed.select("name", "level", "band", "ty", "tx", "payload"), allowMissingColumns=True)
    order = [F.col("name"), F.col("layout").isNull(), *[F.col(c) for c in ("level", "band", "ty", "tx")]]
    placed = rows.repartition("name").sortWithinPartitions(*order)
    return durable(placed.mapInArrow(lambda bs: stored(bs, folder, tile, dtype, nodata), "name string, bytes long"))
