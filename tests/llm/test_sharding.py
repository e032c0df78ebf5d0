import collections
import hashlib
import math
import zlib

from pyspark.sql import functions as F

from tessella.llm import sharding as sh
from tests.conftest import SF
from tests.llm.helpers import hard_documents, no_documents


def test_documents(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = sh.shard(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    assert {r.doc_id for r in rows} == set(docs) and {r.law for r in rows} == {"key"}
    slots = collections.defaultdict(list)
    for r in rows:
        raw = docs[r.doc_id].encode()
        assert r.size == len(raw) + 1 and r.text_crc32 == zlib.crc32(raw)
        assert r.grown_shard in (r.shard, 8)
        slots[r.shard].append(r.slot)
    assert sorted(slots) == list(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert 60 < sum(r.grown_shard == 8 for r in rows) < 160


def placed(spark, shards, n=20_000):
    keys = spark.range(n).withColumn("k", F.col("id").cast("string"))
    return {r.id: r.s for r in sh.place(keys, F.col("k"), shards, "s").collect()}


def test_weights_are_met_and_movement_is_confined(spark):
    tree = sh.tree(8)
    before = placed(spark, tree)
    share = collections.Counter(before.values())
    assert all(abs(share[s] - 2500) < 250 for s in range(8))
    heavier = [sh.Shard(s.region, s.rack, s.shard, 3.0 if s.shard == 5 else 1.0) for s in tree]
    after = placed(spark, heavier)
    moved = collections.Counter((before[k], after[k]) for k in before if before[k] != after[k])
    # rows enter the subtree whose weight grew, or move within its region and rack toward the shard
    assert all(b in (4, 5, 6, 7) for _, b in moved)
    assert all(b == 5 for a, b in moved if a in (4, 5))
    assert abs(collections.Counter(after.values())[5] - 20_000 * 3 / 10) < 500


def test_growth_only_fills_the_new_shard(spark):
    tree = sh.tree(8)
    last = placed(spark, tree)
    for n in (9, 10, 11):
        tree = sh.grown(tree)
        now = placed(spark, tree)
        assert all(now[k] in (last[k], n - 1) for k in now)
        assert abs(sum(v == n - 1 for v in now.values()) - 20_000 / n) < 300
        last = now


def plain_shard(key, shards):
    """The shard that a key descends to, by plain draws at each level."""

    def draw(path, weight):
        number = int(hashlib.md5(f"{path}|{key}".encode()).hexdigest()[:13], 16)
        return math.log((number + 1) / 2**52) / weight

    at, path = shards, ""
    for level in ("region", "rack", "shard"):
        children = sorted({getattr(s, level) for s in at})
        full = lambda c: f"{path}/{c}" if path else f"{c}"  # noqa: B023, E731
        if len(children) > 1:
            best = max((draw(full(c), sum(s.weight for s in at if getattr(s, level) == c)), c) for c in children)[1]
        else:
            best = children[0]
        at, path = [s for s in at if getattr(s, level) == best], full(best)
    return at[0].shard


def test_draws_equal_plain_python(spark):
    even = sh.tree(8)
    uneven = [sh.Shard(s.region, s.rack, s.shard, 1 + s.shard / 3) for s in sh.grown(sh.tree(5))]
    for shards in (even, sh.grown(even), uneven):
        got = placed(spark, shards, 3000)
        assert got == {k: plain_shard(str(k), shards) for k in range(3000)}
    rows = sh.shard(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    assert all((r.shard, r.grown_shard) == (plain_shard(str(r.doc_id), even), plain_shard(str(r.doc_id), sh.grown(even))) for r in rows)


def test_tree_shapes():
    for n in range(1, 20):
        tree = sh.tree(n)
        assert [s.shard for s in tree] == list(range(n))
        assert len({(s.region, s.rack) for s in tree}) == min(n, 4)


def test_hard_rows(spark):
    rows = sh.shard(hard_documents(spark)).collect()
    assert len(rows) == 15
    by_id = collections.defaultdict(set)
    for r in rows:
        by_id[r.doc_id].add(r.shard)
    assert all(len(s) == 1 for s in by_id.values())
    one = next(r for r in rows if r.doc_id == 1)
    assert one.size == 1 and one.text_crc32 == 0
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_empty_table(spark):
    assert sh.shard(no_documents(spark)).collect() == []


def test_more_buckets_than_rows_keep_slots_gapless(spark, monkeypatch):
    monkeypatch.setattr(sh, "BUCKET_ROWS", 1)
    slots = collections.defaultdict(list)
    for r in sh.shard(spark.read.parquet(f"{SF}/documents.parquet")).collect():
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
