from concurrent.futures import ThreadPoolExecutor
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quern.llm.sharding import Conflict, Shard, ShardStore, plan, tier


def shard(size, arrival=0, name=None):
    return Shard(name or f"p{size}-{arrival}", size, arrival)


def test_plan_merges_similar_sizes():
    assert tier(1, 10, 4) == tier(39, 10, 4) == 0 and tier(40, 10, 4) == 1 and tier(160, 10, 4) == 2
    small, large = [shard(10, i) for i in range(9)], [shard(90, i) for i in range(3)]
    groups = plan(small + large, 100, 10, 4)
    assert [len(g) for g in groups] == [9] and all(s.bytes == 10 for g in groups for s in g)
    assert [[s.bytes for s in g] for g in plan([shard(30, i) for i in range(7)], 100, 10, 4)] == [[30] * 3, [30] * 3]
    assert plan([shard(10, i) for i in range(3)], 100, 10, 4) == [] and plan([], 100, 10, 4) == []
    assert sum(len(g) for g in plan([shard(74, i) for i in range(9)], 100, 10, 4)) == 0


def rows(spark, low, high):
    return spark.range(low, high).select(F.col("id").alias("doc_id"), F.repeat(F.md5(F.col("id").cast("string")), 20).alias("text"), F.lit("x").alias("quern_arrival"))


def ids(df):
    return sorted(r["doc_id"] for r in df.collect())


def test_append_compact_read(spark, tmp_path):
    store = ShardStore(spark, str(tmp_path), target=200_000, base=4_000, fanout=3)
    for i in range(6):
        assert store.append(rows(spark, 50 * i, 50 * i + 50).coalesce(2)) == i + 1
    before = store.manifest()[1]
    version = store.compact()
    after = store.manifest()[1]
    assert len(after) < len(before) and ids(store.read()) == list(range(300)) and store.read().columns == ["doc_id", "text", "quern_arrival"]
    assert ids(store.read(2)) == list(range(100)), "an older version stays as it was"
    assert max(s.bytes for s in after) <= 1.1 * 200_000
    assert plan(after, 200_000, 4_000, 3) == []
    assert store.vacuum() == 0, "files may belong to a change that isn't committed yet"
    assert store.vacuum(grace=0) > 0 and store.versions() == [version] and ids(store.read()) == list(range(300)) and store.vacuum(grace=0) == 0


def test_arrivals_in_one_pass(spark, tmp_path):
    store = ShardStore(spark, str(tmp_path))
    docs = rows(spark, 0, 90).withColumn("k", F.when(F.col("doc_id") < 60, (F.col("doc_id") / 20).cast("int")))
    assert store.append(docs, "k") == 4  # rows without an arrival are the first
    assert [ids(store.read(v)) for v in (1, 2)] == [list(range(60, 90)), [*range(20), *range(60, 90)]]
    assert "k" not in store.read().columns


def test_commits_are_atomic(spark, tmp_path):
    store = ShardStore(spark, str(tmp_path))
    store.append(rows(spark, 0, 5))
    with pytest.raises(Conflict):
        store.commit(1, [], None)
    assert ids(store.read()) == list(range(5))
    (tmp_path / "data" / "stray.parquet").write_bytes(b"left by a task that failed")
    assert ids(store.read()) == list(range(5)) and store.vacuum(grace=0) == 1


def test_an_append_under_way_survives_a_vacuum(spark, tmp_path, monkeypatch):
    store = ShardStore(spark, str(tmp_path))
    store.append(rows(spark, 0, 5))
    written = store._written

    def meanwhile(folder):
        monkeypatch.setattr(store, "_written", written)
        ShardStore(spark, str(tmp_path)).vacuum()
        return written(folder)

    monkeypatch.setattr(store, "_written", meanwhile)
    store.append(rows(spark, 5, 9))
    assert ids(store.read()) == list(range(9))


def test_writers_at_a_time(spark, tmp_path):
    """Three threads append, two compact: every row is there once."""
    stores = [ShardStore(spark, str(tmp_path), target=200_000, base=4_000, fanout=2) for _ in range(5)]
    stores[0].append(rows(spark, 0, 20))

    def work(k):
        for i in range(3):
            if k < 3:
                at = 20 + 20 * (3 * k + i)
                stores[k].append(rows(spark, at, at + 20).coalesce(1))
            else:
                stores[k].compact()

    with ThreadPoolExecutor(5) as pool:
        list(pool.map(work, range(5)))
    assert ids(stores[0].read()) == list(range(200))
    stores[0].compact()
    assert ids(stores[0].read()) == list(range(200))


def test_of_two_compactions_of_the_same_shards_one_counts(spark, tmp_path, monkeypatch):
    one, other = (ShardStore(spark, str(tmp_path), target=200_000, base=4_000, fanout=2) for _ in range(2))
    for i in range(4):
        one.append(rows(spark, 50 * i, 50 * i + 50).coalesce(1))
    change = one._change

    def late(f):
        monkeypatch.setattr(one, "_change", change)
        other.compact()
        return change(f)

    monkeypatch.setattr(one, "_change", late)
    one.compact()
    assert ids(one.read()) == list(range(200))


def test_columns_come_and_go(spark, tmp_path):
    """Added and dropped columns survive reading and compaction; another type is refused before anything is written."""
    store = ShardStore(spark, str(tmp_path), target=1 << 20, base=1 << 10, fanout=2)
    store.append(spark.createDataFrame([(1, "a", datetime(2024, 1, 2, 3, 4, 5, 678901))], "doc_id long, text string, at timestamp").coalesce(1))
    store.append(spark.createDataFrame([(2, "b", [1.5])], "doc_id long, TEXT string, scores array<double>").coalesce(1))
    store.append(spark.createDataFrame([(3,)], "doc_id long").coalesce(1))
    with pytest.raises(ValueError, match="text is string"):
        store.append(spark.createDataFrame([(4, 4)], "doc_id long, text long"))
    want = [(1, "a", datetime(2024, 1, 2, 3, 4, 5, 678901), None), (2, "b", None, [1.5]), (3, None, None, None)]
    assert sorted(map(tuple, store.read().collect())) == want and store.read().columns == ["doc_id", "text", "at", "scores"]
    store.compact()
    assert len(store.manifest()[1]) == 1 and sorted(map(tuple, store.read().collect())) == want
    store.append(spark.createDataFrame([(5, "e")], "doc_id long, text string").coalesce(1))
    store.compact()
    assert sorted(map(tuple, store.read().collect())) == [*want, (5, "e", None, None)]


def test_odd_tables(spark, tmp_path):
    store = ShardStore(spark, str(tmp_path / "e"))
    store.append(rows(spark, 0, 0))
    store.compact()
    assert store.read().count() == 0
    odd = ShardStore(spark, str(tmp_path / "o"), target=1 << 20, base=1 << 10, fanout=2)
    docs = spark.createDataFrame([(None, None), (1, ""), (1, ""), (2, "y" * 500_000)], "doc_id long, text string")
    odd.append(docs)
    odd.append(docs)
    odd.compact()
    key = lambda r: (str(r["doc_id"]), str(r["text"]))
    assert sorted(map(key, odd.read().collect())) == sorted(map(key, docs.union(docs).collect()))
