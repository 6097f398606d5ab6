import hashlib
import random
import re

import numpy as np

from plumbline.llm import suffix_match


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute(docs, items, window=10):
    out = []
    for doc_id, text in docs:
        doc, hit, names = words(text), set(), set()
        for name, body in items:
            item = words(body)
            size = min(window, len(item))
            for i in range(len(item) - size + 1 if item else 0):
                for j in range(len(doc) - size + 1):
                    if doc[j : j + size] == item[i : i + size]:
                        hit |= set(range(j, j + size))
                        names.add("" if name is None else str(name))
        joined = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        out.append((repr(doc_id), len(doc), len(hit), len(names), joined, bool(hit)))
    return sorted(out)


def cases(odd):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(6)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 4, 10, 12, 30])))) for i in range(14)]
    items += [(100, None), (None, "an Item, without-an id; that has just more than ten words in it"), (101, "two words")]
    items += [(102, items[5][1]), (103, "漢字 ünï two")]
    docs = list(odd)
    for i in range(20, 60):
        text = [rng.choice(vocabulary + ["x", "y"]) for _ in range(rng.randint(0, 80))]
        if rng.random() < 0.6:
            at = rng.randint(0, len(text))
            text[at:at] = (rng.choice(items)[1] or "").upper().split()
        docs.append((i, ", ".join(text)))
    docs.append((60, "Has an item without an id that has just more than ten words in it, and 漢字 Ünï two"))
    return docs, items


def test_matches_equal_all_windows(spark, corpus, odd):
    docs, items = cases(odd)
    table = spark.createDataFrame(items, "item_id long, text string")
    for block_bytes in (1 << 20, 60):  # the benchmark in one block, and in many
        found = suffix_match.digest(suffix_match.matches(corpus(docs), table, block_bytes=block_bytes)).collect()
        assert sorted((repr(r[0]), *r[1:]) for r in found) == brute(docs, items)


def test_spans_are_the_longest_matches(spark, corpus):
    item = " ".join(f"w{i}" for i in range(30))
    docs = corpus([(1, f"before {item} after"), (2, " ".join(f"w{i}" for i in range(5, 20)))])
    found = {r.doc_id: r.spans for r in suffix_match.matches(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()}
    assert [tuple(s) for s in found[1]] == [("7", 0, 1, 30)] and [tuple(s) for s in found[2]] == [("7", 5, 0, 15)]


def test_decontaminate_keeps_clean_rows(spark, corpus, odd):
    docs, items = cases(odd)
    table = corpus(docs)
    kept = suffix_match.decontaminate(table, spark.createDataFrame(items, "item_id long, text string"))
    clean = [repr(i) for i, t in docs if not brute([(i, t)], items)[0][-1]]
    assert sorted(repr(r.doc_id) for r in kept.collect()) == sorted(clean) and kept.columns == table.columns


def test_empty_sides(spark, corpus, odd):
    none = spark.createDataFrame([], "item_id long, text string")
    assert suffix_match.digest(suffix_match.matches(corpus(odd), none)).filter("contaminated").count() == 0
    assert suffix_match.matches(corpus([]), none).count() == 0
    assert suffix_match.decontaminate(corpus(odd), none).count() == len(odd)


def test_suffix_array_orders_prefixes():
    rng = np.random.default_rng(0)
    text = np.append(rng.integers(0, 3, 300), -1).astype(np.int32)
    order = suffix_match.suffix_array(text, 10)
    prefixes = [text[i : i + 10].tolist() for i in order]
    assert prefixes == sorted(prefixes)
