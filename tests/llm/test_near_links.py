"""Near copies are looked for among the links of the fingerprints first."""

import random

from plumbline.llm import simhash


def test_fingerprint_pairs_match_all_pairs(spark):
    rng = random.Random(5)
    fps = [rng.getrandbits(64) - (1 << 63) for _ in range(40)]
    for fp in fps[:30]:
        changed = fp
        for bit in rng.sample(range(63), rng.randint(0, 3)):
            changed ^= 1 << bit
        fps.append(changed)
    nodes = list(enumerate(fps, 100))
    least = {fp: min(n for n, f in nodes if f == fp) for fp in fps}
    mask = (1 << 64) - 1
    expected = {(n, least[g]) for n, f in nodes for g in least if ((f ^ g) & mask).bit_count() <= 2 and n != least[g]}
    found = simhash._fingerprint_pairs(spark.createDataFrame(nodes, "node long, fp long")).collect()
    assert len(expected) > 20 and {(r.node, r.hub) for r in found} == expected and len(found) == len(expected)


def test_near_copies_come_through_the_links(corpus, monkeypatch):
    asked = []
    links = simhash.links

    def watched(fps, *more):
        asked.append({r.fp for r in fps.collect()})
        return links(fps, *more)

    monkeypatch.setattr(simhash, "links", watched)
    text = " ".join(f"w{i}" for i in range(300))
    docs = corpus([(1, text), (2, text + " more"), (3, "quite another text of some words")])
    assert sorted(r.doc_id for r in simhash.one_of_each(docs).collect()) == [1, 3]
    assert len(asked) == 1 and len(asked[0]) >= 2
