import math
import zlib

import pytest
import xxhash

from plumbline.llm import hash_tree
from plumbline.llm.hash_tree import Shard


def draw(level, node, key, weight):
    seed = 42
    for part in (level.to_bytes(4, "little"), node.to_bytes(4, "little"), key.to_bytes(8, "little", signed=True)):
        seed = xxhash.xxh64(part, seed).intdigest()
    return -math.log(((seed >> 11) + 0.5) / 2**53) / weight if weight > 0 else math.inf


def brute(tree, key):
    """Region, rack and shard, each by its own draws among the nodes below the one before."""
    left = tree
    for level, of in enumerate(("region", "rack", "number"), 1):
        nodes = sorted({getattr(s, of) for s in left})
        weight = {n: sum(s.weight for s in left if getattr(s, of) == n) for n in nodes}
        at = min(nodes, key=lambda n: (draw(level, n, key, weight[n]), n)) if len(nodes) > 1 else nodes[0]
        left = [s for s in left if getattr(s, of) == at]
    return left[0].number


def test_descent_equals_draws_level_by_level(spark):
    rows = spark.range(-500, 3500).withColumnRenamed("id", "k")
    tree = [Shard(s.number, s.rack, s.region, 1.0 + s.number % 3) for s in hash_tree.layout(14, 2, 3, founded=13)]
    found = hash_tree.descend(rows, "k", tree, "a").toPandas()
    assert list(found.a) == [brute(tree, int(k)) for k in found.k]
    flat = [min(tree, key=lambda s: draw(3, s.number, int(k), s.weight)).number for k in found.k]
    assert (found.a != flat).mean() > 0.5


def test_rows_slots_and_growth(corpus, odd):
    pairs = odd + [(i, f"text {i}") for i in range(100, 3000)]
    found = hash_tree.assign(corpus(pairs)).toPandas()
    assert len(found) == len(pairs) and set(found.law) == {"key"}
    assert found.shard.between(0, 23).all()
    assert ((found.grown_shard == found.shard) | (found.grown_shard == 24)).all()
    assert 60 < (found.grown_shard == 24).sum() < 180
    for _, own in found.groupby("shard"):
        assert sorted(own.slot) == list(range(len(own)))
        assert 70 < len(own) < 180
    assert (found.groupby("doc_id").shard.nunique() == 1).all()
    expected = sorted((repr(i), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in pairs)
    rows = found.astype(object).where(found.notna(), None)
    got = [(repr(None if i is None else int(i)), s, c) for i, s, c in zip(rows["doc_id"], rows["size"], rows["text_crc32"], strict=True)]
    assert sorted(got) == expected


@pytest.mark.parametrize(("before", "after"), [(1.0, 3.0), (3.0, 1.0), (1.0, 0.0)])
def test_a_changed_weight_moves_rows_only_along_its_path(spark, before, after):
    rows = spark.range(20000).withColumnRenamed("id", "k")
    plain = hash_tree.layout(9, per_rack=2, racks_per_region=2)
    old, new = ([Shard(s.number, s.rack, s.region, w if s.number == 4 else 1.0) for s in plain] for w in (before, after))
    both = hash_tree.descend(hash_tree.descend(rows, "k", old, "a"), "k", new, "b").toPandas()
    if before > after:
        both = both.rename(columns={"a": "b", "b": "a"})  # a fallen weight is a grown one read backwards
    at = {s.number: s for s in plain}
    moved = both[both.a != both.b]
    assert len(moved)
    for a, b in zip(moved.a, moved.b, strict=True):
        if at[a].region != at[b].region:
            assert at[b].region == at[4].region
        elif at[a].rack != at[b].rack:
            assert at[b].rack == at[4].rack
        else:
            assert b == 4
    for part, weight in ((both.a, min(before, after)), (both.b, max(before, after))):
        assert abs((part == 4).mean() - weight / (8 + weight)) < 0.02


def test_a_new_shard_takes_rows_only_into_itself(spark):
    rows = spark.range(20000).withColumnRenamed("id", "k")
    for n in (24, 25, 31):
        old, new = hash_tree.layout(n), hash_tree.layout(n + 1)
        assert new[:n] == old
        both = hash_tree.descend(hash_tree.descend(rows, "k", old, "a"), "k", new, "b").toPandas()
        moved = both[both.a != both.b]
        assert (moved.b == n).all() and abs(len(moved) / 20000 - 1 / (n + 1)) < 0.006


def test_fewer_shards_and_one_more(corpus):
    docs = corpus([(i, "t") for i in range(2000)])
    small = hash_tree.assign(docs, shards=5).toPandas()
    grown = hash_tree.assign(docs, shards=6, founded=5).toPandas()
    assert set(small.shard) == set(range(5)) and set(grown.shard) == set(range(6))
    assert dict(zip(small.doc_id, small.grown_shard)) == dict(zip(grown.doc_id, grown.shard))


def test_slots_without_gaps_over_many_chunks(spark):
    rows = spark.range(5000).selectExpr("CAST(id % 3 AS INT) AS shard", "xxhash64(id % 700) AS mark", "id")
    found = hash_tree.slots(rows, rows_per_chunk=50).toPandas()
    for _, own in found.groupby("shard"):
        assert sorted(own.slot) == list(range(len(own)))


def test_empty_table(corpus):
    assert hash_tree.assign(corpus([])).count() == 0
