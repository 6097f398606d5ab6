"""Candidates are held against each other by a few bits for each shingle before whole sets are read."""

import random
from pathlib import Path

import numpy as np
import pyarrow as pa

from plumbline.llm import simhash


def held(pairs, similarity=0.8):
    columns = {
        "node": range(len(pairs)),
        "hub": range(len(pairs)),
        "times": [1] * len(pairs),
        "n": [len(x) for x, _ in pairs],
        "hub_n": [len(y) for _, y in pairs],
        "bits": [simhash._odd_bits(x) for x, _ in pairs],
        "hub_bits": [simhash._odd_bits(y) for _, y in pairs],
    }
    batch = pa.RecordBatch.from_pydict({k: list(v) for k, v in columns.items()})
    return set(next(simhash._close(similarity)([batch])).column("node").to_pylist())


def test_no_similar_pair_is_lost_and_few_others_stay():
    rng = np.random.default_rng(3)
    pairs, reach = [], []
    for _ in range(1500):
        x = np.unique(rng.integers(0, 1 << 64, rng.integers(1, 700), dtype=np.uint64))
        fresh = rng.integers(0, 1 << 64, rng.integers(0, len(x) // 3 + 2), dtype=np.uint64)
        y = np.unique(np.concatenate([x[rng.integers(0, len(x) // 3 + 1) :], fresh]))
        both = len(np.intersect1d(x, y))
        pairs.append((x, y))
        reach.append(both / (len(x) + len(y) - both))
    kept = held(pairs)
    assert {i for i, share in enumerate(reach) if share >= 0.8} <= kept
    far = {i for i, share in enumerate(reach) if share < 0.65}
    assert len(far) > 200 and len(far & kept) < len(far) / 20
    assert not held([(x, y) for x, _ in pairs[:40] for _, y in pairs[60:90] if len(x) > 50])


def test_sets_are_read_only_for_pairs_that_can_be_similar(corpus, monkeypatch):
    asked = []
    verified = simhash._verified

    def watched(pairs, *more):
        asked.extend((r.a, r.b) for r in pairs.collect())
        return verified(pairs, *more)

    monkeypatch.setattr(simhash, "_verified", watched)
    rng = random.Random(4)
    fresh = lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]
    passage = fresh(60)
    texts = [fresh(100) + passage + fresh(100) for _ in range(60)]
    texts.append([*texts[0][:-1], "changed"])
    docs = corpus([(i, " ".join(t)) for i, t in enumerate(texts)])
    assert sorted(r.doc_id for r in simhash.one_of_each(docs).collect()) == list(range(60))
    assert len(set(asked)) == 1


def test_a_bucket_of_the_index_is_one_file(spark, corpus, monkeypatch):
    files = []
    settle = simhash.settle_bucketed

    def watched(*args, **options):
        table = settle(*args, **options)
        files.extend(Path(f.removeprefix("file:")).name for f in table.inputFiles())
        return table

    monkeypatch.setattr(simhash, "settle_bucketed", watched)
    rng = random.Random(6)
    texts = [" ".join(f"u{rng.randrange(10**9)}" for _ in range(50)) for _ in range(80)]
    assert simhash.one_of_each(corpus(list(enumerate(texts)), partitions=7)).count() == 80
    assert 1 < len(files) <= int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_a_null_text_and_an_empty_one_of_one_id_are_one_row(corpus):
    docs = corpus([(1, None), (1, ""), (1, ""), (None, ""), (None, None), (2, "other words stand here now")])
    assert sorted(repr(r.doc_id) for r in simhash.one_of_each(docs).collect()) == ["2", "None"]
    assert simhash.one_of_each(docs).columns == docs.columns
