"""Every registered query that has SQL, against DuckDB on the same tables."""

import datetime
import decimal

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def test_entry(spark):
    assert len(entry.entry(spark).columns) == 5


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n in ORACLES))
def test_query_equals_sql(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    cursor = duck.execute(ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(repr(tuple(plain(v) for v in row)) for row in cursor.fetchall())
    got = sorted(repr(tuple(plain(row[c]) for c in columns)) for row in df.collect())
    assert got == want


def test_whole_tables_are_read(spark, sf_dir):
    import pyspark.sql.functions as F

    events, clips = spark.read.parquet(f"{sf_dir}/events.parquet"), spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    for name in ("forward_fill_all", "ema_all", "match_streaks_all"):
        assert QUERIES[name](spark, sf_dir).count() == events.count()
    nearest = QUERIES["nearest_clip_scores_all"](spark, sf_dir)
    assert nearest.select("ref_sign").distinct().count() == clips.select("label").distinct().count()
    assert nearest.agg(F.countDistinct("clip")).first()[0] == clips.count()


def test_box_scores_round_as_in_sql(spark, tmp_path):
    """1.0249365 is not exact: SQL rounds the double down, so both boxes of frame 1 have one score and the first comes first."""
    price = [(1, 2, 102493.65), (1, 1, 102493.60), (2, 1, 50000.0), (2, 2, 14999.95), (3, 1, 13343.65), (3, 2, 13343.70)]
    rows = ", ".join(f"({f}, {b}, 7, {10.0 + b}, {p}, 0.02, 0.02)" for f, b, p in price)
    con = duckdb.connect()
    con.execute(f"CREATE TABLE lineitem AS SELECT l_orderkey::BIGINT AS l_orderkey, l_linenumber::INTEGER AS l_linenumber, l_suppkey::BIGINT AS l_suppkey, l_quantity::DOUBLE AS l_quantity, l_extendedprice::DOUBLE AS l_extendedprice, l_discount::DOUBLE AS l_discount, l_tax::DOUBLE AS l_tax FROM (VALUES {rows}) v(l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax)")
    con.execute(f"COPY lineitem TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
    for name in ("filter_detections", "largest_box"):
        df = QUERIES[name](spark, str(tmp_path))
        assert sorted(map(tuple, df.collect())) == sorted(con.execute(f"SELECT {', '.join(df.columns)} FROM ({ORACLES[name]})").fetchall())


def test_filter_detections_of_tied_boxes_agree(spark):
    from lernspur.operators import boxes

    tied = [(f, 1, 5.0, 5.0, *size, 0.5) for f in range(40) for size in ((20.0, 20.0), (2.0, 30.0), (40.0, 3.0))]
    columns = "frame long, box long, x0 double, y0 double, w double, h double, score double"
    runs = [sorted(map(tuple, boxes.filter_detections(spark.createDataFrame(rows, columns).repartition(n)).collect())) for rows, n in ((tied, 1), (tied[::-1], 3))]
    assert runs[0] == runs[1] and {r[4:6] for r in runs[0]} == {(2.0, 30.0), (20.0, 20.0)}


def test_crop_records_moves_lines_once(spark, sf_dir):
    plan = QUERIES["crop_records"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
