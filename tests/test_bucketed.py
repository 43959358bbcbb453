from pathlib import Path

import pytest
from pyspark.sql import functions as F

from skywait.errors import DataError
from skywait.sources import tables
from skywait.sources.bucketed import BucketedTable
from skywait.streaming import ingest


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def files(table):
    return {str(p): p.stat().st_mtime_ns for p in Path(table.root).rglob("*.parquet")}


def make(spark, low, high, value):
    return spark.range(low, high).select(F.col("id").alias("k"), F.lit(value).alias("v"), F.col("id").cast("int").alias("t"))


def test_an_upsert_rewrites_its_buckets_alone(spark, tmp_path):
    table = BucketedTable(spark, str(tmp_path / "t"), ["k"], buckets=8)
    assert not table.exists()
    with pytest.raises(DataError):
        table.read()
    table.upsert(make(spark, 0, 200, "a"))
    before = files(table)
    touched = table.upsert(make(spark, 5, 6, "b").unionByName(make(spark, 1000, 1001, "c")), keep_first=("t",))
    assert 1 <= len(touched) <= 2
    held = table.state()["parts"]
    same = [f for f in before if f in files(table)]
    new = [f for f in files(table) if f not in before]
    assert len(new) == len(touched) and len(same) == len(before)  # those of the state before stay until the next change
    assert {p.split("/")[0] for b, p in held.items() if int(b) not in touched} == {Path(f).parts[-3] for f in same}
    assert rows_of(table.read()) == rows_of(make(spark, 0, 200, "a").withColumn("v", F.when(F.col("k") == 5, "b").otherwise("a")).unionByName(make(spark, 1000, 1001, "c")))
    assert {r[0] for r in table.read(touched).select(table.bucket()).distinct().collect()} == set(touched)
    table.upsert(make(spark, 5, 6, "d"))
    assert not set(files(table)) & {f for f in before if any(f"_bucket={b}/" in f for b in touched)}
    table.rebucket(3)
    assert len(table.state()["parts"]) == 3 and table.read().count() == 201 and table.read().where("k = 5").first().v == "d"


def test_buckets_grow_in_number(spark, tmp_path):
    table = BucketedTable(spark, str(tmp_path / "t"), ["k"], 2, bucket_rows=50)
    table.upsert(make(spark, 0, 60, "a"))
    assert table.state()["buckets"] == 2
    table.upsert(make(spark, 60, 400, "b"))
    assert table.state()["buckets"] >= 8 and rows_of(table.read()) == rows_of(make(spark, 0, 60, "a").unionByName(make(spark, 60, 400, "b")))
    table.replace(make(spark, 0, 3000, "c"))
    assert table.state()["buckets"] >= 60 and table.read().count() == 3000
    assert len(table.upsert(make(spark, 7, 8, "d"))) == 1 and table.read().where("v = 'd'").count() == 1


def test_last_of_key_and_keep_first(spark, tmp_path):
    table = BucketedTable(spark, str(tmp_path / "t"), ["k"], 4)
    table.upsert(make(spark, 0, 3, "a"))
    twice = spark.createDataFrame([(1, "x", 7), (1, "y", 9), (1, "z", 8), (9, "n", 1)], "k long, v string, t int").repartition(3)
    table.upsert(twice, order="t")
    assert rows_of(table.read()) == [(0, "a", 0), (1, "y", 9), (2, "a", 2), (9, "n", 1)]
    table.upsert(twice.where("t = 7"), keep_first=("t",))
    assert rows_of(table.read().where("k = 1")) == [(1, "x", 9)]
    assert table.upsert(twice.limit(0)) == [] and table.read().count() == 4


@pytest.mark.parametrize("step", ["write", "rename", "sweep"])
def test_a_crash_at_any_step_leaves_a_readable_table(spark, tmp_path, monkeypatch, step):
    table = BucketedTable(spark, str(tmp_path / "t"), ["k"], 4)
    table.upsert(make(spark, 0, 20, "a"))
    old = rows_of(table.read())

    def broken(*args, **kw):
        raise OSError("gone")

    with monkeypatch.context() as m:
        m.setattr(*{"write": (BucketedTable, "_publish"), "rename": (BucketedTable, "_publish"), "sweep": (BucketedTable, "_sweep")}[step], broken)
        if step == "write":
            m.setattr("skywait.sources.bucketed._children", broken)
        with pytest.raises(OSError):
            table.upsert(make(spark, 0, 10, "b"))
    now = rows_of(table.read())
    assert now == old if step != "sweep" else [r[1] for r in now] == ["b"] * 10 + ["a"] * 10
    for value in "cd":
        table.upsert(make(spark, 0, 10, value))
    assert [r[1] for r in rows_of(table.read())] == ["d"] * 10 + ["a"] * 10
    named = {p.split("/")[0] for m in (table.state(),) for p in m["parts"].values()}
    left = {p.name for p in Path(table.root).iterdir() if p.name.startswith("data-")}
    assert named <= left and len(left) <= len(named) + 1, "what broke off is swept"


def test_batches_and_other_writers(spark, tmp_path):
    table = BucketedTable(spark, str(tmp_path / "t"), ["k"], 4)
    assert table.upsert(make(spark, 0, 4, "a"), batch=("s", 0)) and table.upsert(make(spark, 0, 4, "b"), batch=("s", 0)) == []
    assert {r.v for r in table.read().collect()} == {"a"} and table.upsert(make(spark, 0, 4, "b"), batch=("other", 0))
    stale = table.state()
    table.upsert(make(spark, 0, 4, "c"))
    with pytest.raises(DataError, match="another writer"):
        table._commit(stale, make(spark, 0, 4, "x"))
    assert {r.v for r in table.read().collect()} == {"c"}


def test_stream_of_small_batches(spark, tmp_path):
    out, shape = str(tmp_path / "out"), "scene_id string, superseded_by string"
    tables.write_table(spark.createDataFrame([(f"old{k}", "x") for k in range(500)], shape), out, "scenes_superseded")
    for n in range(3):
        spark.createDataFrame([(f"s{n}", f"w{n}"), ("s0", f"w{n}")][: 1 + bool(n)], shape).coalesce(1).write.parquet(str(tmp_path / "in" / str(n)))
        feed = spark.readStream.schema(shape).parquet(f"{tmp_path}/in/*")
        ingest.upsert_stream(feed, out, "scenes_superseded", str(tmp_path / "cp")).awaitTermination(120)
        if n == 1:
            sizes = {p: p.stat().st_size for p in (tmp_path / "out").rglob("*.parquet")}
    got = dict(map(tuple, tables.read_or_empty(spark, out, "scenes_superseded").collect()))
    assert len(got) == 503 and got["s0"] == "w2" and got["s2"] == "w2" and got["old7"] == "x"
    new = [p for p in (tmp_path / "out").rglob("*.parquet") if p not in sizes]
    assert 1 <= len(new) <= 2 and not list((tmp_path / "out").glob("scenes_superseded.parquet*"))
    assert "scenes_superseded" in tables.register_views(spark, out)
    tables.write_table(spark.createDataFrame([("only", "one")], shape), out, "scenes_superseded")
    assert rows_of(tables.read_or_empty(spark, out, "scenes_superseded")) == [("only", "one")]
