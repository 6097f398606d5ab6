import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from plumbline.llm import katz

END = "<end>"


def tokens(text):
    return [w.decode("latin-1") for w in (text or "").encode().lower().split()] + [END]


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def good_turing(of_counts):
    """Katz' factors from smoothed counts of counts, written out."""
    k, d = 5, {0: 0.0, 6: 1 - 1e-6}
    seen = [c for c in range(1, k + 2) if of_counts.get(c)]
    slope = -2.0
    if len(seen) > 1:
        z = []
        for i, c in enumerate(seen):
            before = seen[i - 1] if i else 0
            after = seen[i + 1] if i + 1 < len(seen) else 2 * c - before
            z.append(of_counts[c] / (0.5 * (after - before)))
        weights = [math.sqrt(of_counts[c]) for c in seen]
        slope = min(np.polyfit(np.log(seen), np.log(z), 1, w=weights)[0], -1.1)
    s = {c: float(c) ** slope for c in range(1, k + 2)}
    tail = (k + 1) * s[k + 1] / s[1]
    for c in range(1, k + 1):
        d[c] = ((c + 1) * s[c + 1] / s[c] / c - tail) / (1 - tail)
    return [d[c] for c in range(k + 2)]


class Brute:
    """The same model from plain dictionaries, by recursion."""

    def __init__(self, docs, order):
        self.train = [tokens(t) for i, t in docs if not held(i)]
        self.counts = {}
        for n in range(1, order + 1):
            self.counts[n] = Counter(
                tuple(((["<s>"] * (n - 1)) + doc)[i : i + n]) for doc in self.train for i in range(len(doc))
            )
        self.d = {}
        for n, counts in self.counts.items():
            of_counts = Counter(min(c, katz.GT_MAX + 2) for c in counts.values())
            self.d[n] = good_turing(of_counts)
        self.total = sum(self.counts[1].values())
        self.words = {k[0] for k in self.counts[1]}
        self.memo = {}

    def discounted(self, n, c):
        return self.d[n][min(c, katz.GT_MAX + 1)] * c

    def p(self, n, context, word):
        """``word`` None is the class of unknown words."""
        key = (n, context, word)
        if key not in self.memo:
            self.memo[key] = self._p(n, context, word)
        return self.memo[key]

    def _p(self, n, context, word):
        if n == 1:
            if not self.total:
                return 1.0
            if word is None:
                return 1 - sum(self.discounted(1, c) for c in self.counts[1].values()) / self.total
            return self.discounted(1, self.counts[1][word,]) / self.total
        seen = {k[-1]: c for k, c in self.counts[n].items() if k[:-1] == context}
        if not seen:
            return self.p(n - 1, context[1:], word)
        total = sum(seen.values())
        if word in seen:
            return self.discounted(n, seen[word]) / total
        left = 1 - sum(self.discounted(n, c) for c in seen.values()) / total
        rest = 1 - sum(self.p(n - 1, context[1:], w) for w in seen)
        return left / rest * self.p(n - 1, context[1:], word)

    def score(self, order, text):
        doc, out = tokens(text), 0.0
        padded = ["<s>"] * (order - 1) + doc
        for i, w in enumerate(doc):
            out += math.log10(self.p(order, tuple(padded[i : i + order - 1]), w if w in self.words else None))
        return out


def some_docs(odd):
    rng = random.Random(4)
    vocabulary = [f"v{min(int(rng.expovariate(0.12)), 60)}" for _ in range(400)]
    docs = [(i, t) for i, t in odd if i != 6]
    return docs + [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 40)))) for i in range(50, 130)]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_equal_the_recursion(corpus, odd, order, monkeypatch):
    monkeypatch.setattr(katz, "KEYS_PER_PART", 200)
    docs = some_docs(odd)
    found = katz.score(corpus(docs), order).collect()
    brute = Brute(docs, order)
    expected = {}
    for i, t in docs:
        known = sum(w in brute.words for w in tokens(t))
        n = len(tokens(t))
        base = sum(
            math.log10((brute.counts[1][w,] + 1) / (brute.total + len(brute.words) + 1)) for w in tokens(t)
        )
        expected.setdefault(repr(i), []).append((held(i), n, known, brute.total, base, brute.score(order, t)))
    assert len(found) == len(docs)
    for r in found:
        options = expected[repr(r.doc_id)]
        assert any(
            tuple(r[1:5]) == e[:4] and abs(r.base_score - e[4]) < 1e-6 * n_ and abs(r.score - e[5]) < 1e-6 * n_
            for e in options
            for n_ in [e[1] + 1]
        ), (r, options)


def test_uneven_counts_of_counts_keep_good_turing():
    cases = [
        [0, 193655, 25105, 6496, 2179, 2497, 618, 9000],  # more n-grams with count five than four
        [0, 10, 400, 3, 900, 0, 5, 7],  # most occur twice or four times
        [0, 5, 0, 0, 0, 0, 0, 0],
        [0, 0, 0, 0, 0, 0, 0, 12],
        [0, 7, 6, 5, 4, 3, 2, 1],
        [0, 0, 0, 3, 0, 1, 0, 0],
    ]
    rng = random.Random(1)
    cases += [[0, *(rng.choice([0, rng.randint(1, 10 ** rng.randint(1, 6))]) for _ in range(7))] for _ in range(500)]
    for n in cases:
        d = katz.discounts(n)
        assert np.all(d[1:6] > 0) and np.all(np.diff(d) > 0) and d[6] < 1, n
        assert np.allclose(d, good_turing(dict(enumerate(n)))), n
    assert katz.discounts(cases[0])[1] < 0.4  # near 2 * n2 / n1, not a half


def test_contexts_sum_to_one(odd):
    brute = Brute(some_docs(odd), 3)
    contexts = {k[:-1] for k in brute.counts[3]} | {("v1", "never"), ("never", "v1"), ("<s>", "<s>")}
    for context in list(contexts)[:60]:
        assert abs(sum(brute.p(3, context, w) for w in [*brute.words, None]) - 1) < 1e-9


def test_no_rows_and_no_training_rows(corpus):
    assert katz.score(corpus([])).count() == 0
    out = next(i for i in range(100) if held(i))
    (row,) = katz.score(corpus([(out, "some words")])).collect()
    assert (row.train_tokens, row.n_known, row.base_score, row.score) == (0, 0, 0.0, 0.0)
