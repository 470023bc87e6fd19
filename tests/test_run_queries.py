"""Registered queries on runs, trails and helpers against their SQL."""

import glob
import math
import os

import duckdb
import pytest

from annotrail import run_queries
from annotrail.queries import ORACLE, QUERIES
from annotrail.sources.backends import images

DATA = "/root/testdata/sf0.001"
NAMES = [n for n, f in QUERIES.items() if f.__module__ == run_queries.__name__]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return ""
    return str(v) if isinstance(v, (str, bool)) else f"{float(v):.6g}"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the given tables")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    found = duck.execute(ORACLE[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    rows = [dict(zip(names, r, strict=True)) for r in found.fetchall()]
    assert sorted(tuple(plain(r[c]) for c in columns) for r in df.collect()) == sorted(tuple(plain(r[c]) for c in columns) for r in rows)


def test_units_of_tables_in_parts(spark, tmp_path):
    """A table of several files, in folders of its partitions too, is one unit; so is a table of one file."""
    for name in ("labels.parquet/part-0.parquet", "labels.parquet/part-1.parquet", "labels.parquet/toxic=1/part-0.parquet", "labels.parquet/_SUCCESS", "nation.parquet", "region.parquet"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    wanted = sorted(duckdb.sql(ORACLE["image_units"]).fetchall())
    for path in (str(tmp_path), f"{tmp_path}/", f"file:{tmp_path}", os.path.relpath(tmp_path)):
        assert sorted(tuple(r) for r in QUERIES["image_units"](spark, path).collect()) == wanted


def test_units_of_folders(spark, tmp_path):
    for name in ("one/a.png", "one/b/c.png", "two/a.png", "three.png"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    found = {r.unit_id: r.content for r in images(spark, f"{tmp_path}/*", folders=True).collect()}
    assert found == {n: f"file:{tmp_path}/{n}" for n in ("one", "two", "three.png")}
    assert [r.unit_id for r in images(spark, str(tmp_path), folders=True).collect()] == [tmp_path.name]
    with pytest.raises(ValueError):
        images(spark, f"{tmp_path}/{{one/a,two}}*", folders=True)
