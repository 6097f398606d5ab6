import random

import pytest

from plumbline.llm import line_join
from tests.llm.test_line_join import brute


def families(seed, lines):
    """Variants of one line; the earliest is far from most of the others."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(40)]
    out = [(0, " ".join(base[:36] + ["a1", "a2", "a3", "a4"]))]
    for i in range(1, lines):
        line = list(base)
        for at in rng.sample(range(40), rng.randint(1, 4)):
            line[at] = f"x{i}y{at}"
        out.append((i, " ".join(line)))
    return out


def counted(monkeypatch):
    found, matched = [], line_join._matched

    def counts(pairs, *args):
        found.append(pairs.count())
        return matched(pairs, *args)

    monkeypatch.setattr(line_join, "_matched", counts)
    return found


def test_family_is_settled_without_its_pairs(corpus, monkeypatch):
    """Most lines do not match the earliest line of their groups, but one of those before them."""
    pairs, docs = counted(monkeypatch), families(1, 300)
    found = line_join.remove_lines(corpus(docs))
    assert sorted((repr(r.doc_id), r.text, r.lines_removed) for r in found.collect()) == brute(docs, 80)
    assert sum(pairs) < 5 * len(docs)


@pytest.mark.parametrize(("group", "before"), [(1, 1), (4, 2), (1000, 1)])
def test_group_limits_leave_the_result(corpus, monkeypatch, group, before):
    monkeypatch.setattr(line_join, "GROUP", group)
    monkeypatch.setattr(line_join, "BEFORE", before)
    docs = families(2, 60) + [(100 + i, t) for i, t in families(3, 20)] + [(None, "w1 w2 w3 w4 w5 w6"), (7, "w1 w2 w3 w4 w5 w6 w7")]
    found = line_join.remove_lines(corpus(docs))
    assert sorted(((repr(r.doc_id), r.text, r.lines_removed) for r in found.collect()), key=repr) == brute(docs, 80)
