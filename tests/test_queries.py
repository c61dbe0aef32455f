"""Every registered query of the core against its SQL in DuckDB, on the smallest tables."""

import math

import duckdb
import pytest

from threadloom.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, float):
        return int(v) if math.isfinite(v) and v == int(v) else round(v, 9)
    return [plain(x) for x in v] if isinstance(v, list | tuple) else str(v) if not isinstance(v, int | str | bool) else v


def compare(spark, duck, f, sql):
    df = f(spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    rel = duck.execute(sql)
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    compare(spark, duck, QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_without_sql(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["author", "formatted_comment"]
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_stream_matches_batch(spark, tmp_path):
    from threadloom.plans import adapters
    from threadloom.streaming.activity import windowed_counts

    rows = adapters.activity(spark, SF).select("author", "ts")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = windowed_counts(stream).writeStream.outputMode("complete").format("memory").queryName("hourly").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("hourly").exceptAll(windowed_counts(rows)).count() == 0
