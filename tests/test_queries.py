"""Every registered engine query against its SQL in DuckDB, as the driver compares them."""

import os

import duckdb
import pytest

from tessera.plans import catalog


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.execute(f"create view {name.split('.')[0]} as select * from '{sf_dir}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, duck, sf_dir, name):
    frame = catalog.queries()[name](spark, sf_dir)
    columns = sorted(frame.columns)
    got = sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=str)
    told = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in told.description]
    assert sorted(names) == columns
    want = sorted((tuple(r[names.index(c)] for c in columns) for r in told.fetchall()), key=str)
    assert got == want


def test_flagship_and_damage(spark, sf_dir):
    assert catalog.flagship(spark, sf_dir).count() > 0
    found = {r.status for r in catalog.queries()["d02_pages_of_documents"](spark, sf_dir).collect()}
    assert found <= {"malformed", "unsupported", "refused"}


def test_probe_runs_once_in_filter_and_projection(spark, sf_dir):
    from tessera.operators import pixels as px
    from tessera.sources import images
    from pyspark.sql import functions as F

    files = images.encode_images(px.tiles(spark, sf_dir), "bmp").withColumn("info", images.probe_column(F.col("content")))
    plan = files.where("info.width = 8").select("img_id", "info.height")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("run(content") <= 2  # one node, named with its output


def test_crop_outside_is_an_error(spark, sf_dir):
    from tessera.operators import pixels as px

    with pytest.raises(ValueError):
        px.crop(px.tiles(spark, sf_dir), 5, 0, 4, 4, 8, 8)
    with pytest.raises(ValueError):
        px.downscale(px.tiles(spark, sf_dir), 8, 8, 9, 1)
