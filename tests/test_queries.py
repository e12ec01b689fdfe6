"""Every query with SQL gives DuckDB's rows on the tables of the correctness gate."""

import math

import duckdb
import pytest

from rasterloom.plans import queries

SF, SMALL = "/root/testdata/sf0.01", "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    out = {}
    for at in (SF, SMALL):
        out[at] = duckdb.connect()
        for t in TABLES:
            out[at].sql(f"create view {t} as select * from '{at}/{t}.parquet'")
    return out


def scale(name):
    """Overlays and tiled warps run many joins a query: the gate runs them on the larger tables, these tests on the smaller."""
    return SMALL if queries.QUERIES[name].__module__.rpartition(".")[2] in ("overlay_queries", "tile_queries") else SF


def rows(frame):
    plain = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) else v if isinstance(v, (str, bool)) else float(v) + 0.0
    return sorted((tuple(plain(v) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_matches_sql(spark, duck, name):
    at = scale(name)
    ours, theirs = queries.QUERIES[name](spark, at).toPandas(), duck[at].sql(queries.ORACLE[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name, key", [("heatmap_rasterize_all", "image_id"), ("draw_boxes_all", "image_id")])
def test_drawing_reaches_every_image(spark, name, key):
    got = queries.QUERIES[name](spark, SF).select(key).distinct().count()
    assert got == queries.fixtures.boxes(spark, SF).select(key).distinct().count()
    assert "image_id < 40" not in queries.ORACLE[name]
