"""Image files: headers, decoding and encoding of PNG, PNM, NPY and BMP in NumPy, JPEG through Spark's own reader.

Rasters are packed structs ``height, width, channels, dtype, data``; ``data`` is row-major,
channels last.
"""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RASTER = T.StructType([
    T.StructField("height", T.IntegerType()), T.StructField("width", T.IntegerType()), T.StructField("channels", T.IntegerType()),
    T.StructField("dtype", T.StringType()), T.StructField("data", T.BinaryType())])

#: Pixels above which decoding refuses an image, against decompression bombs.
MAX_PIXELS = 1 << 30

NUMPY_TO_SPARK = {"uint8": "smallint", "int8": "tinyint", "int16": "smallint", "uint16": "int", "int32": "int", "uint32": "bigint", "int64": "bigint", "float16": "float", "float32": "float", "float64": "double", "bool": "boolean"}


def to_struct(a: np.ndarray) -> dict:
    a = a if a.ndim == 3 else a[:, :, None]
    return {"height": a.shape[0], "width": a.shape[1], "channels": a.shape[2], "dtype": str(a.dtype), "data": np.ascontiguousarray(a).tobytes()}


def to_array(r) -> np.ndarray:
    return np.frombuffer(r["data"], dtype=r["dtype"]).reshape(r["height"], r["width"], r["channels"])


def image_shape(content: Column) -> Column:
    """``struct<height,width,channels>`` from the header bytes alone, for PNG, PNM, BMP and GIF; null for others."""
    head = F.hex(F.substring(content, 1, 64))
    number = lambda at, n: F.conv(F.substring(head, at * 2 + 1, n * 2), 16, 10).cast("int")
    little = lambda at, n: F.conv(F.concat(*[F.substring(head, (at + i) * 2 + 1, 2) for i in reversed(range(n))]), 16, 10).cast("int")
    kind = number(25, 1)
    png = F.struct(number(20, 4).alias("height"), number(16, 4).alias("width"), F.when(kind == 0, 1).when(kind == 2, 3).when(kind == 3, 3).when(kind == 4, 2).otherwise(4).alias("channels"))
    text = F.decode(F.substring(content, 1, 64), "ISO-8859-1")
    pnm = r"^P([56])\s+(?:#[^\n]*\n\s*)*(\d+)\s+(\d+)"
    pnm_shape = F.struct(F.regexp_extract(text, pnm, 3).try_cast("int").alias("height"), F.regexp_extract(text, pnm, 2).try_cast("int").alias("width"), F.when(F.regexp_extract(text, pnm, 1) == "6", 3).otherwise(1).alias("channels"))
    bmp = F.struct(little(22, 4).alias("height"), little(18, 4).alias("width"), (little(28, 2) / 8).cast("int").alias("channels"))
    gif = F.struct(little(8, 2).alias("height"), little(6, 2).alias("width"), F.lit(3).alias("channels"))
    return F.when(head.startswith("89504E47"), png).when(text.rlike(pnm), pnm_shape).when(head.startswith("424D"), bmp).when(head.startswith("47494638"), gif)


def decode(data: bytes) -> np.ndarray:
    """Array of a PNG, PNM, NPY or 24/32-bit BMP file."""
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return decode_png(data)
    if data[:2] in (b"P5", b"P6"):
        return _decode_pnm(data)
    if data[:6] == b"\x93NUMPY":
        a = np.load(io.BytesIO(data), allow_pickle=False)
        return a if a.ndim == 3 else a[:, :, None]
    if data[:2] == b"BM":
        return _decode_bmp(data)
    raise ValueError("unknown image format")


def decode_png(data: bytes) -> np.ndarray:
    """8- and 16-bit PNG without interlace, palettes expanded."""
    at, body, palette = 8, [], None
    width = height = depth = kind = 0
    while at < len(data):
        size, name = struct.unpack(">I4s", data[at:at + 8])
        part = data[at + 8:at + 8 + size]
        if name == b"IHDR":
            width, height, depth, kind, _, _, interlace = struct.unpack(">IIBBBBB", part)
            if interlace or depth not in (8, 16):
                raise ValueError("interlaced or packed PNG")
            if width * height > MAX_PIXELS:
                raise ValueError("too many pixels")
        elif name == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif name == b"IDAT":
            body.append(part)
        at += 12 + size
    channels, wide = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[kind], depth // 8
    step = channels * wide
    raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, 1 + width * step)
    out = np.zeros((height, width * step), np.uint8)
    before = np.zeros(width * step, np.uint8)
    for y in range(height):
        line, how = raw[y, 1:], raw[y, 0]
        if how == 0:
            now = line
        elif how == 1:
            now = np.cumsum(line.reshape(-1, step), axis=0, dtype=np.uint8).ravel()
        elif how == 2:
            now = line + before
        else:
            now = np.zeros_like(line)
            for i in range(len(line)):
                a = int(now[i - step]) if i >= step else 0
                b = int(before[i])
                if how == 3:
                    now[i] = (int(line[i]) + (a + b) // 2) & 255
                else:
                    c = int(before[i - step]) if i >= step else 0
                    p = a + b - c
                    near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))
                    now[i] = (int(line[i]) + near[2]) & 255
        out[y], before = now, now
    pixels = out.view(">u2").astype(np.uint16) if wide == 2 else out
    pixels = pixels.reshape(height, width, channels)
    return palette[pixels[:, :, 0]] if kind == 3 and palette is not None else pixels


def encode_png(a: np.ndarray, level: int = 6) -> bytes:
    a = a if a.ndim == 3 else a[:, :, None]
    if a.dtype not in (np.uint8, np.uint16):
        raise TypeError(f"PNG holds 8- or 16-bit samples, not {a.dtype}")
    h, w, c = a.shape
    kind = {1: 0, 2: 4, 3: 2, 4: 6}[c]
    lines = np.ascontiguousarray(a.astype(">u2") if a.dtype == np.uint16 else a).view(np.uint8).reshape(h, -1)
    body = np.concatenate([np.zeros((h, 1), np.uint8), lines], axis=1).tobytes()
    chunk = lambda n, b: struct.pack(">I", len(b)) + n + b + struct.pack(">I", zlib.crc32(n + b))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, a.dtype.itemsize * 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(body, level)) + chunk(b"IEND", b"")


def _decode_pnm(data: bytes) -> np.ndarray:
    import re

    m = re.match(rb"P([56])\s+(?:#[^\n]*\n\s*)*(\d+)\s+(\d+)\s+(\d+)\s", data)
    w, h, top = int(m[2]), int(m[3]), int(m[4])
    kind = np.dtype(">u2") if top > 255 else np.dtype(np.uint8)
    c = 3 if m[1] == b"6" else 1
    a = np.frombuffer(data, kind, w * h * c, m.end()).reshape(h, w, c)
    return a.astype(np.uint16) if top > 255 else a


def encode_pnm(a: np.ndarray) -> bytes:
    a = a if a.ndim == 3 else a[:, :, None]
    return b"P%d\n%d %d\n255\n" % (6 if a.shape[2] == 3 else 5, a.shape[1], a.shape[0]) + np.ascontiguousarray(a.astype(np.uint8)).tobytes()


def _decode_bmp(data: bytes) -> np.ndarray:
    start, = struct.unpack("<I", data[10:14])
    w, h, _, bits = struct.unpack("<iiHH", data[18:30])
    if bits not in (24, 32):
        raise ValueError("BMP with a palette")
    row = -(-w * bits // 32) * 4
    a = np.frombuffer(data, np.uint8, row * abs(h), start).reshape(abs(h), row)[:, :w * bits // 8].reshape(abs(h), w, bits // 8)
    a = a[::-1] if h > 0 else a
    return a[:, :, [2, 1, 0, *range(3, a.shape[2])]]


@F.pandas_udf(RASTER)
def decode_udf(contents: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([to_struct(decode(bytes(c))) for c in contents], columns=["height", "width", "channels", "dtype", "data"])


def read_images(spark: SparkSession, path: str, glob: str = "*.{png,ppm,pgm,npy,bmp}") -> DataFrame:
    """``path, shape, raster`` of every file; plans without ``raster`` never decode a pixel."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select("path", image_shape(F.col("content")).alias("shape"), decode_udf("content").alias("raster"))


def read_spark_images(spark: SparkSession, path: str) -> DataFrame:
    """``path, raster`` of JPEG and other files that the JVM decodes; its BGR bytes are kept, ``dtype`` says so."""
    d = spark.read.format("image").load(path).where("image.nChannels > 0")
    return d.select("image.origin", F.struct(F.col("image.height").alias("height"), F.col("image.width").alias("width"), F.col("image.nChannels").alias("channels"), F.lit("uint8").alias("dtype"), F.col("image.data").alias("data")).alias("raster"))


def to_pixels(images: DataFrame, by: list[str], raster: str = "raster") -> DataFrame:
    """``by, y, x, c, v`` of packed rasters; batches of pixels stream out of each task."""
    kinds = dict(images.dtypes)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for i in range(len(f)):
                a = to_array(f[raster].iloc[i])
                y, x, c = np.indices(a.shape)
                out = pd.DataFrame({"y": y.ravel(), "x": x.ravel(), "c": c.ravel(), "v": a.ravel().astype(float)})
                for k in by:
                    out[k] = f[k].iloc[i]
                yield out[[*by, "y", "x", "c", "v"]]

    return images.select(*by, raster).mapInPandas(run, ", ".join([*(f"{k} {kinds[k]}" for k in by), "y int, x int, c int, v double"]))


def from_pixels(pixels: DataFrame, by: list[str], dtype: str = "uint8") -> DataFrame:
    """Packed rasters of pixel rows; each image is assembled in one task, missing cells are 0."""
    kinds = dict(pixels.dtypes)

    def run(f):
        a = np.zeros((f["y"].max() + 1, f["x"].max() + 1, f["c"].max() + 1), dtype=dtype)
        a[f["y"], f["x"], f["c"]] = f["v"]
        return pd.DataFrame([{**{k: f[k].iloc[0] for k in by}, **to_struct(a)}])

    return pixels.groupBy(*by).applyInPandas(run, ", ".join([*(f"{k} {kinds[k]}" for k in by), "height int, width int, channels int, dtype string, data binary"]))


def write_images(images: DataFrame, folder: str, name: str, raster: str = "raster") -> DataFrame:
    """Encodes rasters as PNG files under ``folder`` (any Arrow filesystem URI); returns ``name, bytes`` once run."""
    import pyarrow.fs as pafs

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        for f in frames:
            out = []
            for key, r in zip(f[name], f[raster], strict=True):
                data = encode_png(to_array(r))
                with fs.open_output_stream(f"{root}/{key}.png") as sink:
                    sink.write(data)
                out.append((str(key), len(data)))
            yield pd.DataFrame(out, columns=["name", "bytes"])

    return images.select(name, raster).mapInPandas(run, "name string, bytes long")


def demo_image(spark: SparkSession, height: int = 64, width: int = 64, seed: int = 0) -> DataFrame:
    """Seeded smooth RGB test image as pixels ``y, x, c, v``."""
    n = spark.range(height * width * 3)
    y, x, c = F.floor(F.col("id") / (width * 3)), F.floor(F.col("id") / 3) % width, F.col("id") % 3
    wave = F.sin((y + seed) / 7.0 + c) + F.cos(x / 5.0 - c * seed)
    return n.select(y.cast("int").alias("y"), x.cast("int").alias("x"), c.cast("int").alias("c"), F.floor((wave + 2) / 4 * 255).cast("double").alias("v"))


#: Common EXIF tags.
EXIF_TAGS = {271: "Make", 272: "Model", 274: "Orientation", 282: "XResolution", 283: "YResolution", 305: "Software", 306: "DateTime", 33432: "Copyright", 33434: "ExposureTime", 33437: "FNumber", 34855: "ISOSpeedRatings", 36867: "DateTimeOriginal", 37386: "FocalLength", 40962: "PixelXDimension", 40963: "PixelYDimension"}


def exif(data: bytes) -> dict[str, str]:
    """Tags of the first directory of a JPEG's or TIFF's EXIF block, by name."""
    at = data.find(b"Exif\x00\x00")
    tiff = data[at + 6:] if at >= 0 else data
    if tiff[:2] not in (b"II", b"MM"):
        return {}
    e = "<" if tiff[:2] == b"II" else ">"
    start, = struct.unpack(e + "I", tiff[4:8])
    n, = struct.unpack(e + "H", tiff[start:start + 2])
    out = {}
    for i in range(n):
        tag, kind, count, raw = struct.unpack(e + "HHI4s", tiff[start + 2 + 12 * i:start + 14 + 12 * i])
        size = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}.get(kind, 1) * count
        value = raw[:size] if size <= 4 else tiff[struct.unpack(e + "I", raw)[0]:][:size]
        if kind == 2:
            shown = value.split(b"\0")[0].decode("latin-1")
        elif kind in (3, 4, 9):
            shown = ",".join(map(str, struct.unpack(e + {3: "H", 4: "I", 9: "i"}[kind] * count, value)))
        elif kind in (5, 10):
            pairs = struct.unpack(e + {5: "II", 10: "ii"}[kind] * count, value)
            shown = ",".join(f"{a}/{b}" for a, b in zip(pairs[::2], pairs[1::2], strict=True))
        else:
            shown = value.hex()
        out[EXIF_TAGS.get(tag, str(tag))] = shown
    return out


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def exif_udf(contents: pd.Series) -> pd.Series:
    return contents.map(lambda c: exif(bytes(c)))
