import random

import pytest
import xxhash

from plumbline.llm import simhash
from plumbline.llm.components import components


def fingerprint(text, k=3):
    words = (text or "").encode().lower().split()
    runs = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(run, 42) for run in runs]
    return sum(1 << bit for bit in range(64) if sum(h >> bit & 1 for h in hashes) * 2 > len(hashes))


def classes(nodes, linked):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def some_texts(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    base = [[rng.choice(words) for _ in range(rng.randint(0, 60))] for _ in range(n)]
    out = []
    for text in base:
        out.append(" ".join(text))
        for _ in range(rng.randint(0, 3)):
            copy = list(text)
            for _ in range(rng.randint(0, 2)):
                if copy:
                    copy[rng.randrange(len(copy))] = rng.choice(words)
            out.append(" ".join(copy))
    return out


def test_near_duplicates_match_all_pairs(corpus, odd):
    pairs = odd + [(i, t) for i, t in enumerate(some_texts(3, 60), 10)]
    found = simhash.near_duplicates(corpus(pairs)).collect()
    prints = {fingerprint(t) for _, t in pairs}
    roots = classes(prints, lambda a, b: (a ^ b).bit_count() <= 2)
    least = {}
    for i, t in pairs:
        root = roots[fingerprint(t)]
        if i is not None:
            least[root] = min(least.get(root, i), i)
    expected = sorted((repr(i), f"{fingerprint(t):016x}", least.get(roots[fingerprint(t)])) for i, t in pairs)
    assert sorted((repr(r.doc_id), r.fingerprint, r.component_id) for r in found) == expected


@pytest.mark.parametrize("limit", [0, 3, 256])
def test_links_reach_the_same_classes_at_any_cell_limit(spark, limit):
    rng = random.Random(5)
    values = set()
    for _ in range(25):
        value = rng.getrandbits(64)
        for _ in range(rng.randint(1, 9)):
            values.add(value)
            value ^= 1 << rng.randrange(64)
            if rng.random() < 0.7:
                value ^= 1 << rng.randrange(64)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    edges = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), limit)
    found = {r.node: r.root for r in components(edges).collect()}
    by_root = {}
    for v in signed:
        by_root.setdefault(found.get(v, v), set()).add(v % (1 << 64))
    expected = {}
    for v, root in classes(values, lambda a, b: (a ^ b).bit_count() <= 2).items():
        expected.setdefault(root, set()).add(v)
    assert sorted(map(sorted, by_root.values())) == sorted(map(sorted, expected.values()))


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7)], "a long, b long")
    found = {r.node: r.root for r in components(edges).collect()}
    assert found == {**{i: 0 for i in range(201)}, 500: 500, 501: 500}


def shingles(text, k=5):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)} or ({b" ".join(words)} if words else set())


def test_one_of_each_class_of_similar_texts_stays(corpus, odd):
    rng = random.Random(11)
    texts = []
    for family in range(20):
        base = [f"f{family}w{rng.randrange(500)}" for _ in range(rng.randint(20, 120))]
        for copy in range(rng.randint(1, 6)):
            other = list(base)
            if copy % 2:
                other[rng.randrange(len(other))] = f"changed{rng.randrange(10**6)}"
            texts.append(" ".join(other))
    pairs = [(i, t) for i, t in odd if i != 4] + [(i, t) for i, t in enumerate(texts, 20)]
    docs = corpus(pairs)
    kept = {r.doc_id for r in simhash.one_of_each(docs).collect()}
    sets = {i: shingles(t) for i, t in pairs if i is not None}

    def alike(a, b):
        x, y = sets[a], sets[b]
        return (not x and not y) or len(x & y) >= 0.8 * len(x | y) > 0

    roots = classes(sets, alike)
    # Texts without a word form one class; the row without an id comes first in it and stays.
    assert kept - {None} == {i for i in set(roots.values()) if sets[i]}
    assert None in kept


def test_repeated_rows_and_empty_tables(corpus):
    docs = corpus([(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (3, "other words stand here now")])
    assert sorted(r.doc_id for r in simhash.one_of_each(docs).collect()) == [1, 3]
    assert simhash.near_duplicates(corpus([])).count() == 0
    assert simhash.one_of_each(corpus([])).columns == docs.columns


def test_twins_in_a_family_of_one_template_are_found(corpus):
    rng = random.Random(5)
    fresh = lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]
    template = fresh(300)
    texts = []
    for _ in range(250):
        both = fresh(20)
        texts += [template + both + fresh(30), template + both + fresh(30)]
    texts += [template + fresh(50) for _ in range(500)]
    order = list(range(len(texts)))
    rng.shuffle(order)
    sets = [shingles(" ".join(t)) for t in texts]
    assert len(sets[0] & sets[1]) >= 0.8 * len(sets[0] | sets[1])
    assert len(sets[0] & sets[2]) < 0.8 * len(sets[0] | sets[2])
    kept = {r.doc_id for r in simhash.one_of_each(corpus([(order[i], " ".join(t)) for i, t in enumerate(texts)])).collect()}
    assert kept == {min(order[i], order[i + 1]) for i in range(0, 500, 2)} | set(order[500:])
