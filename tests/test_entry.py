import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from tessera.plans import catalogue
from tessera.streaming import changes

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else round(v, 6)
    return v


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_against_sql(spark, sql, name):
    df = catalogue.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    want = sql.execute(catalogue.SQL[name])
    columns = [d[0] for d in want.description]
    assert names == sorted(columns)
    expected = [tuple(plain(r[columns.index(n)]) for n in names) for r in want.fetchall()]
    if not name.startswith("udf_"):
        assert "Python" not in df._jdf.queryExecution().toString(), "only registered functions run in Python"
    assert sorted(map(repr, expected)) == sorted(repr(tuple(plain(r[n]) for n in names)) for r in df.collect())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_the_optional_part(tmp_path):
    """With the llm folders and the corpus pipeline gone, the other queries are still there."""
    root = os.path.dirname(os.path.abspath(entry.__file__))
    for name in os.listdir(root):
        if name not in ("corpus_pipeline.py", "tessera", ".git"):
            os.symlink(f"{root}/{name}", tmp_path / name)
    os.mkdir(tmp_path / "tessera")
    for name in os.listdir(f"{root}/tessera"):
        if name != "llm":
            os.symlink(f"{root}/tessera/{name}", tmp_path / "tessera" / name)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pricing_summary' in q and not any(n.startswith('op') or n == 'pipeline' for n in q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})


def test_change_stream(spark, tmp_path):
    before = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (3, "c", 3)], "_id int, s string, n int")
    after = spark.createDataFrame([(1, "a", 1), (2, "b", 20), (4, "d", 4)], "_id int, s string, n int")
    events = changes.change_events(before, after, "_id", "db", "t")
    events.write.parquet(str(tmp_path / "log"))
    rows = {r["documentKey"]["_id"]: r for r in events.collect()}
    assert {k: r["operationType"] for k, r in rows.items()} == {2: "update", 3: "delete", 4: "insert"}
    assert rows[2]["updateDescription"]["updatedFields"] == ["n"] and rows[3]["fullDocument"] is None and rows[4]["fullDocumentBeforeChange"] is None
    assert sorted(r["_id"]["_seq"] for r in rows.values()) == [1, 2, 3]
    stream = changes.watch(spark, str(tmp_path / "log"), events.schema, [{"$match": {"operationType": {"$in": ["insert", "delete"]}}}], resume_after=2, db="db", coll="t")
    assert [r["operationType"] for r in changes.run_to_end(stream, str(tmp_path / "run")).collect()] == ["insert"]


def test_sessions(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:30:00"), (1, "2024-01-01 05:00:00"), (2, "2024-01-03 00:00:00")], "user_id int, ts string").selectExpr("user_id", "cast(ts as timestamp) as ts")
    rows.write.parquet(str(tmp_path / "in"))
    shape = lambda events: changes.sessions(events, "ts", "1 hour", "1 hour", "user_id")
    read = lambda: spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    out = changes.run_to_end(shape(read()), str(tmp_path / "run"))
    assert sorted(r["n"] for r in out.collect()) == [1, 2], "a stream that goes on keeps its last session open"
    out = changes.run_bounded(read(), shape, "ts", str(tmp_path / "bounded"))
    assert sorted((r["user_id"], r["n"]) for r in out.collect()) == [(1, 1), (1, 2), (2, 1)], "one that has an end doesn't"
