import random

import pytest

import corpus_pipeline
from plumbline.llm import line_join
from plumbline.llm.queries import QUERIES


def words_of(line):
    for c in "\t\r\f\x0b":
        line = line.replace(c, " ")
    return [w for w in line.lower().split(" ") if w]


def brute(docs, percent, least=5):
    """Texts with every line removed that matches an earlier one; equal rows are one row."""
    lines = []
    unique = list(dict.fromkeys((i, t or "") for i, t in docs))
    for i, t in unique:
        for pos, line in enumerate(t.split("\n")):
            found = words_of(line)
            if len(found) >= least:
                lines.append(((i is not None, i or 0), t, pos, frozenset(found), (i, t)))
    gone = {}
    for a in lines:
        for b in lines:
            earlier = b[0] < a[0] or (b[4] == a[4] and b[2] < a[2])
            both = len(a[3] & b[3])
            if earlier and both * 100 >= percent * (len(a[3]) + len(b[3]) - both):
                gone.setdefault(a[4], set()).add(a[2])
                break
    out = []
    for i, t in docs:
        cut = gone.get((i, t or ""), set())
        text = t if t is None or not cut else "\n".join(x for p, x in enumerate(t.split("\n")) if p not in cut)
        out.append((repr(i), text, len(cut)))
    return sorted(out, key=repr)


def family(seed):
    rng = random.Random(seed)
    common = [f"c{i}" for i in range(15)]
    lines = []
    for i in range(40):
        base = [rng.choice(common) if rng.random() < 0.5 else f"r{i}x{rng.randrange(30)}" for _ in range(rng.randint(1, 25))]
        lines.append(base)
        for _ in range(rng.randint(0, 5)):
            other = [w for w in base if rng.random() > 0.08] + ([f"n{rng.randrange(99)}"] if rng.random() < 0.5 else [])
            lines.append(other)
    texts = [" ".join(x) for x in lines]
    rng.shuffle(texts)
    return [(i + 10, "\n".join(texts[3 * i : 3 * i + 3])) for i in range(len(texts) // 3)]


@pytest.mark.parametrize(("seed", "percent"), [(1, 80), (2, 60)])
def test_equal_to_all_pairs(corpus, odd, seed, percent):
    docs = [(i, t) for i, t in odd if i != 4] + family(seed)
    docs += [(900, docs[12][1]), (900, docs[12][1]), (901, "Licensed under the\tPublic LICENSE text.\nLICENSED UNDER the public license  text.")]
    found = line_join.remove_lines(corpus(docs), percent)
    assert sorted(((repr(r.doc_id), r.text, r.lines_removed) for r in found.collect()), key=repr) == brute(docs, percent)


def test_many_variants_of_one_line(corpus):
    base = [f"w{i}" for i in range(30)]
    docs = [(i, " ".join(base[:k] + [f"z{i}"] + base[k + 1 :])) for i in range(400) for k in [i % 30]]
    docs.append((-1, "unrelated first words that stand before all others"))
    found = line_join.remove_lines(corpus(docs))
    assert [r.doc_id for r in found.filter("lines_removed = 0").orderBy("doc_id").collect()] == [-1, 0]


def test_only_dataframe_operations(corpus, odd):
    plan = line_join.remove_lines(corpus(odd))._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "CartesianProduct", "BroadcastNestedLoop"))


def test_empty_table(corpus):
    docs = corpus([])
    assert line_join.remove_lines(docs).columns == [*docs.columns, "lines_removed", "lines_total"]
    assert line_join.remove_lines(docs).count() == 0


SHORT = [
    (1, "Read more\n\nHome\na b c d\nc b a"),
    (2, "read  MORE\n\n \nhome\na b c d e\na b c\na b"),
    (3, "Home\n\nd c b\na b c d f\nb a\nmore read"),
    (4, "Home\nread more"),
    (5, "\n\n"),
]


def test_short_lines_take_part_and_blank_lines_stay(spark, corpus, tmp_path):
    expected = brute(SHORT, 80, least=1)
    found = line_join.remove_lines(corpus(SHORT), min_words=1)
    assert sorted(((repr(r.doc_id), r.text, r.lines_removed) for r in found.collect()), key=repr) == expected
    corpus(SHORT).write.parquet(str(tmp_path / "documents.parquet"))
    rows = QUERIES["op9_line_join"](spark, str(tmp_path)).collect()
    assert sorted((repr(r.doc_id), r.lines_removed, r.kept_bytes) for r in rows) == [(i, n, len(t)) for i, t, n in expected]
    kept = corpus_pipeline.line_dedup(spark, corpus(SHORT), str(tmp_path)).collect()
    assert sorted((repr(r.doc_id), r.text) for r in kept) == [(i, t) for i, t, n in expected if not n or t.strip()]


@pytest.mark.parametrize(("seed", "percent"), [(3, 80), (4, 60), (5, 100)])
def test_lines_of_any_length_equal_to_all_pairs(corpus, seed, percent):
    rng = random.Random(seed)
    lines = [" ".join(rng.choice("abcdefg") for _ in range(rng.randint(0, 6))) for _ in range(240)]
    docs = family(seed) + [(500 + i, "\n".join(lines[4 * i : 4 * i + 4])) for i in range(60)]
    found = line_join.remove_lines(corpus(docs), percent, min_words=1)
    assert sorted(((repr(r.doc_id), r.text, r.lines_removed) for r in found.collect()), key=repr) == brute(docs, percent, 1)
