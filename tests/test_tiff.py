"""Tiled TIFF files: round trips, what a window reads, and files shared with the JVM's own reader and writer."""

import io
import struct
import zlib

import numpy as np
import pyarrow.fs as pafs
import pytest
from pyspark.sql.datasource import EqualTo, GreaterThan, LessThan

from rasterloom.sources import tiff

SCHEMA = "name string, band int, height int, width int, ty int, tx int, values array<double>, extra int"


def tile_rows(name, a, tile=16, skip=()):
    """Tiles of ``(bands, height, width)``, NaN beyond the image."""
    bands, height, width = a.shape
    for b in range(bands):
        for ty in range(-(-height // tile)):
            for tx in range(-(-width // tile)):
                if (b, ty, tx) not in skip:
                    part = a[b, ty * tile:(ty + 1) * tile, tx * tile:(tx + 1) * tile]
                    whole = np.full((tile, tile), np.nan)
                    whole[:part.shape[0], :part.shape[1]] = part
                    yield (name, b, height, width, ty, tx, [float(v) for v in whole.ravel()], 1)


def read_back(df):
    """Arrays by ``(name, overview)`` from tiles; NaN where nothing is stored."""
    out = {}
    for r in df.collect():
        a = out.setdefault((r["name"], r["overview"]), {}).setdefault(r["band"], np.full((r["height"], r["width"]), np.nan))
        values = np.array(r["values"]).reshape(-1, r["tile_width"])
        a[r["y0"]:r["y1"], r["x0"]:r["x1"]] = values[:r["y1"] - r["y0"], :r["x1"] - r["x0"]]
    return {k: np.stack([v[b] for b in sorted(v)]) for k, v in out.items()}


@pytest.mark.parametrize("dtype", ["uint8", "int16", "uint16", "int32", "float32", "float64"])
def test_round_trip(spark, tmp_path, dtype):
    rng = np.random.default_rng(3)
    kind = np.dtype(dtype)
    make = lambda *s: rng.normal(0, 50, s).astype(kind) if kind.kind == "f" else rng.integers(np.iinfo(kind).min, np.iinfo(kind).max, s, dtype=kind, endpoint=True)
    images = {"a/b ?": make(2, 37, 50), "dot.x": make(1, 1, 1), "long": make(1, 3, 200)}
    df = spark.createDataFrame([r for n, a in images.items() for r in tile_rows(n, a)], SCHEMA).repartition(5)
    sizes = {r["name"]: r["bytes"] for r in tiff.write_tiles(df, f"file://{tmp_path}", 16, dtype).collect()}
    assert sizes.keys() == images.keys() and len(list(tmp_path.iterdir())) == 3
    got = read_back(tiff.read_tiles(spark, f"file://{tmp_path}", split_bytes=700))
    assert {k[0] for k in got} == images.keys()
    for n, a in images.items():
        assert np.array_equal(got[(n, 0)], a.astype(float))


def test_missing_and_clipped(spark, tmp_path):
    a = np.full((1, 20, 40), 7.5)
    a[0, 3, 4], a[0, 5, 5], a[0, 6, 6], a[0, 0, 0] = np.nan, -4, 999, 8.5
    rows = list(tile_rows("x", a, skip={(0, 1, 1)}))
    rows[0][6][1] = None
    df = spark.createDataFrame(rows, SCHEMA)
    tiff.write_tiles(df, f"file://{tmp_path}", 16, "uint8", nodata=200)
    want = np.clip(np.rint(a), 0, 255)
    want[0, 0, 1] = want[0, 16:, 16:32] = np.nan
    tiles = tiff.read_tiles(spark, f"file://{tmp_path}")
    assert tiles.count() == 5
    assert np.array_equal(read_back(tiles)[("x", 0)], want, equal_nan=True)
    kept = read_back(tiff.read_tiles(spark, f"file://{tmp_path}", nodata="keep"))[("x", 0)]
    assert kept[0, 3, 4] == kept[0, 0, 1] == 200
    pixels = {(r["y"], r["x"]): r["v"] for r in tiff.window(tiles, 2, 7, 3, 9).collect()}
    assert pixels == {(y, x): want[0, y, x] for y in range(2, 7) for x in range(3, 9) if (y, x) != (3, 4)}


@pytest.mark.parametrize("how", ["nearest", "average"])
def test_overviews(spark, tmp_path, how):
    a = np.random.default_rng(5).uniform(0, 1, (1, 37, 70))
    a[0, 10:14, 20:22] = np.nan
    tiff.write_tiles(spark.createDataFrame(list(tile_rows("x", a)), SCHEMA), f"file://{tmp_path}", 16, "float64", nodata=-1, overviews=3, how=how)
    got = read_back(tiff.read_tiles(spark, f"file://{tmp_path}"))
    level = a[0]
    for k in range(4):
        assert np.allclose(got[("x", k)][0], level, equal_nan=True)
        if how == "nearest":
            level = level[::2, ::2]
        else:
            level = np.array([[np.nan if np.isnan(p).all() else np.nanmean(p) for p in (level[y:y + 2, x:x + 2] for x in range(0, level.shape[1], 2))] for y in range(0, level.shape[0], 2)])


def read_locally(folder, filters, split=1 << 20):
    reader = tiff.TiffReader({"path": folder, "split_bytes": str(split)})
    assert list(reader.pushFilters(filters)) == []
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    return rows, reader.fetched


def test_window_reads_only_its_tiles(spark, tmp_path):
    a = np.random.default_rng(8).uniform(0, 1, (2, 320, 320))
    folder = f"file://{tmp_path}"
    tiff.write_tiles(spark.createDataFrame(list(tile_rows("big", a)), SCHEMA), folder, 16, "float64")
    source = pafs.LocalFileSystem().open_input_file(str(tmp_path / "big.tif"))
    directory, = tiff.read_directories(source, source.size())
    # of 800 tiles the window meets 3 x 3, in one band
    window = [GreaterThan(("y1",), 40), LessThan(("y0",), 70), GreaterThan(("x1",), 100), LessThan(("x0",), 140), EqualTo(("band",), 1)]
    wanted = [i for i in range(800) if i >= 400 and i % 400 // 20 in (2, 3, 4) and i % 20 in (6, 7, 8)]
    rows, fetched = read_locally(folder, window)
    assert sorted((r["ty"], r["tx"]) for r in rows) == [(y, x) for y in (2, 3, 4) for x in (6, 7, 8)]
    _, headers = read_locally(folder, [EqualTo(("band",), 9)])
    assert fetched - headers == sum(directory.lengths[i] for i in wanted) < source.size() / 50
    assert read_locally(folder, [EqualTo(("name",), "other")]) == ([], 0)
    # ranges cut anywhere give every tile once
    rows, _ = read_locally(folder, [], split=30011)
    assert len(rows) == len({(r["band"], r["ty"], r["tx"]) for r in rows}) == 800
    # Spark hands the window to the scan: what is left of the filter isn't evaluated again
    df = tiff.window(tiff.read_tiles(spark, folder).where("band = 1"), 40, 70, 100, 140)
    assert df.count() == 30 * 40
    plan = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    assert "PushedFilters: [EqualTo(band,1), EqualTo(overview,0), GreaterThan(y1,40), LessThan(y0,70), GreaterThan(x1,100), LessThan(x0,140)]" in plan


def test_jvm_reads_what_is_written(spark, tmp_path):
    a = np.random.default_rng(1).integers(0, 256, (1, 45, 70)).astype(float)
    tiff.write_tiles(spark.createDataFrame(list(tile_rows("x", a)), SCHEMA), f"file://{tmp_path}", 16, "uint8")
    raster = spark._jvm.javax.imageio.ImageIO.read(spark._jvm.java.io.File(str(tmp_path / "x.tif"))).getRaster()
    assert (raster.getHeight(), raster.getWidth()) == (45, 70)
    assert all(raster.getSample(x, y, 0) == a[0, y, x] for y in range(0, 45, 4) for x in range(0, 70, 3))


def test_reads_what_the_jvm_writes(spark, tmp_path):
    jvm = spark._jvm
    image = jvm.java.awt.image.BufferedImage(23, 11, jvm.java.awt.image.BufferedImage.TYPE_INT_RGB)
    for y in range(11):
        for x in range(23):
            image.setRGB(x, y, (y * 20 << 16) + (x * 10 << 8) + x * y % 256)
    assert jvm.javax.imageio.ImageIO.write(image, "tiff", jvm.java.io.File(str(tmp_path / "x.tiff")))
    got = read_back(tiff.read_tiles(spark, f"file://{tmp_path}"))[("x", 0)]
    y, x = np.mgrid[:11, :23]
    assert np.array_equal(got, np.stack([y * 20, x * 10, x * y % 256]))


def jvm_written(jvm, image, path, how=None):
    """Writes ``image`` with the JVM's own coder and the compression named."""
    writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName("tiff").next()
    out = jvm.javax.imageio.ImageIO.createImageOutputStream(jvm.java.io.File(str(path)))
    writer.setOutput(out)
    param = writer.getDefaultWriteParam()
    if how:
        param.setCompressionMode(jvm.javax.imageio.ImageWriteParam.MODE_EXPLICIT)
        param.setCompressionType(how)
    writer.write(None, jvm.javax.imageio.IIOImage(image, None, None), param)
    out.close()
    writer.dispose()


@pytest.mark.parametrize("how", ["LZW", "Deflate", "ZLib", None])
def test_compressions_of_the_jvm(spark, tmp_path, how):
    jvm = spark._jvm
    a = np.random.default_rng(7).integers(0, 256, (90, 120))
    a[20:60, 10:100] = 77
    image = jvm.java.awt.image.BufferedImage(120, 90, jvm.java.awt.image.BufferedImage.TYPE_BYTE_GRAY)
    pixels = spark.sparkContext._gateway.new_array(jvm.int, a.size)
    for i, v in enumerate(a.ravel().tolist()):
        pixels[i] = v
    image.getRaster().setSamples(0, 0, 120, 90, 0, pixels)
    jvm_written(jvm, image, tmp_path / "x.tif", how)
    assert np.array_equal(read_back(tiff.read_tiles(spark, f"file://{tmp_path}"))[("x", 0)][0], a)


def test_indexed_colours(spark, tmp_path):
    jvm = spark._jvm
    image = jvm.java.awt.image.BufferedImage(16, 16, jvm.java.awt.image.BufferedImage.TYPE_BYTE_INDEXED)
    for y in range(16):
        for x in range(16):
            image.getRaster().setSample(x, y, 0, (y * 16 + x) % 216)
    jvm_written(jvm, image, tmp_path / "x.tif")
    want = np.array([[[image.getRGB(x, y) >> s & 255 for x in range(16)] for y in range(16)] for s in (16, 8, 0)])
    got = read_back(tiff.read_tiles(spark, f"file://{tmp_path}"))[("x", 0)]
    assert np.array_equal(got, want)
    green = tiff.window(tiff.read_tiles(spark, f"file://{tmp_path}").where("band = 1"), 3, 5, 2, 9)
    assert {(r["y"], r["x"]): r["v"] for r in green.collect()} == {(y, x): want[1, y, x] for y in (3, 4) for x in range(2, 9)}


def test_claims_are_bounded(tmp_path):
    a = np.zeros((4, 4, 1), np.int16)
    good = by_hand("<", False, 4, 1, a)
    bomb = zlib.compress(bytes(50 << 20))
    directory, = tiff.read_directories(io.BytesIO(good), len(good))
    assert directory.decode(bomb).shape == (4, 4, 1)
    for old, new in ((struct.pack("<HHII", 256, 4, 1, 4), struct.pack("<HHII", 256, 4, 1, 1 << 30)), (struct.pack("<HHII", 256, 4, 1, 4), struct.pack("<HHII", 256, 4, 1, 0)), (struct.pack("<HHI", 273, 4, 1), struct.pack("<HHI", 999, 4, 1))):
        assert old in good
        (tmp_path / "x.tif").write_bytes(good.replace(old, new))
        with pytest.raises(ValueError):
            read_locally(f"file://{tmp_path}", [])
    for raw in (b"\xff\xff\xff", bytes([0x80, 0x40, 0x00, 0x81])):
        try:
            assert len(tiff.from_lzw(raw, 10)) <= 10
        except ValueError:
            pass


def by_hand(order, big, rows_each, predictor, a):
    """A deflated file in strips, bands side by side."""
    height, width, bands = a.shape
    word, entry = ("Q", "HHQ") if big else ("I", "HHI")
    parts = []
    for y in range(0, height, rows_each):
        p = a[y:y + rows_each]
        p = np.diff(p, axis=1, prepend=np.zeros((len(p), 1, bands), a.dtype)) if predictor == 2 else p
        parts.append(zlib.compress(p.astype(a.dtype.newbyteorder(order)).tobytes()))
    start = 16 if big else 8
    at = np.concatenate([[0], np.cumsum([len(p) for p in parts])]) + start
    fields = [(256, 4, [width]), (257, 4, [height]), (258, 3, [16] * bands), (259, 3, [8]), (273, 4, at[:-1].tolist()), (277, 3, [bands]), (278, 4, [rows_each]),
              (279, 4, [len(p) for p in parts]), (284, 3, [1]), (317, 3, [predictor]), (339, 3, [2] * bands)]
    extra, body = b"", struct.pack(order + ("Q" if big else "H"), len(fields))
    wide = struct.calcsize("=" + word)
    base = int(at[-1]) + len(body) + len(fields) * (4 + 2 * wide) + wide
    for tag, kind, values in fields:
        packed = struct.pack(f"{order}{len(values)}{'HI'[kind == 4]}", *values)
        body += struct.pack(order + entry, tag, kind, len(values))
        if len(packed) <= wide:
            body += packed.ljust(wide, b"\0")
        else:
            body, extra = body + struct.pack(order + word, base + len(extra)), extra + packed
    mark = b"II" if order == "<" else b"MM"
    head = mark + (struct.pack(order + "HHHQ", 43, 8, 0, at[-1]) if big else struct.pack(order + "HI", 42, at[-1]))
    return head + b"".join(parts) + body + struct.pack(order + word, 0) + extra


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("big", [False, True])
@pytest.mark.parametrize("predictor", [1, 2])
def test_byte_orders_strips_and_differences(tmp_path, order, big, predictor):
    a = np.random.default_rng(2).integers(-3000, 3000, (13, 9, 3)).astype(np.int16)
    (tmp_path / "x.tif").write_bytes(by_hand(order, big, 5, predictor, a))
    rows, _ = read_locally(f"file://{tmp_path}", [EqualTo(("band",), 2)])
    got = np.full((13, 9), np.nan)
    for r in rows:
        got[r["y0"]:r["y1"]] = np.array(r["values"]).reshape(-1, 9)[:r["y1"] - r["y0"]]
    assert np.array_equal(got, a[:, :, 2])


def test_big_header_is_read_back():
    image = {"height": 40, "width": 20, "bands": 2, "tile": 16, "dtype": "float32", "nodata": -1.5, "lengths": [5, 0, 7, 9, 0, 1] + [3] * 6}
    for big in (False, True):
        data = tiff.header([image, {**image, "height": 20, "width": 10, "lengths": [4, 4, 2, 2]}], big)
        full = data + b"x" * 64
        first, second = tiff.read_directories(io.BytesIO(full), len(full))
        assert first.nodata == -1.5 and (first.height, second.height, first.dtype) == (40, 20, np.dtype("<f4"))
        assert list(first.lengths) == image["lengths"] and first.offsets[0] == len(data) and second.offsets[0] == len(data) + sum(image["lengths"])


def test_refusals_and_empty_tables(spark, tmp_path):
    good = list(tile_rows("x", np.zeros((1, 20, 20))))
    folder = f"file://{tmp_path}/out"
    write = lambda rows: tiff.write_tiles(spark.createDataFrame(rows, SCHEMA), folder, 16)
    for bad in ([(None, *good[0][1:])], [("x", -1, *good[0][2:])], [("x", 0, 20, 20, 2, *good[0][5:])], [(*good[0][:6], [0.0], 1)], [(*good[0][:6], None, 1)], [good[0], good[0]], [good[0], (*good[1][:3], 40, *good[1][4:])]):
        with pytest.raises(Exception, match="not a tile of an image|given twice|differ in the size"):
            write(bad)
    assert write([]).count() == 0 and tiff.read_tiles(spark, folder).count() == 0
    with pytest.raises(ValueError):
        tiff.write_tiles(spark.createDataFrame(good, SCHEMA), folder, 20)
    for data in (b"", b"II", b"not a tiff at all", b"II\x2a\x00\xff\xff\x00\x00"):
        (tmp_path / "x.tif").write_bytes(data)
        if data:
            with pytest.raises(ValueError):
                read_locally(f"file://{tmp_path}", [])
        else:
            assert read_locally(f"file://{tmp_path}", [])[0] == []
