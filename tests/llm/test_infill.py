import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import infill


def test_wavelet_matrix_ranks_and_selects():
    draw = np.random.default_rng(2)
    for size in (0, 1, 63, 64, 65, 1000):
        symbols = draw.integers(0, 4, size).astype(np.uint8)
        tree = infill.WaveletMatrix(symbols)
        at = np.arange(size + 1)
        for symbol in range(4):
            before = np.concatenate(([0], np.cumsum(symbols == symbol)))
            assert (tree.rank(symbol, at) == before).all()
            numbers = np.arange(1, before[-1] + 1)
            found = tree.select(symbol, numbers, np.zeros_like(numbers), np.full_like(numbers, size))
            assert (found == np.flatnonzero(symbols == symbol) + 1).all()


def units_of(text, unit):
    return re.findall(r"[^\n]*\n|[^\n]+", text) if unit == "line" else list(text)


def brute(doc_id, text, unit="line", rate=100, spm_rate=50, seed=7):
    text = text or ""
    units = units_of(text, unit)
    name = "null" if doc_id is None else doc_id
    digest = hashlib.sha256(f"{seed}:{name}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:low], units[low:high], units[high:]))
    if not text or any(mark in text for mark in infill.MARKS) or h[2] % 100 >= rate:
        return doc_id, n, "plain", None, None, text
    if h[3] % 100 < spm_rate:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def texts():
    draw = random.Random(4)
    pieces = ["a", "é", "漢", "\U0001f600", " ", "\n", "\n\n", "\r", "<", ">", "<P", "S>", "\0", " "]
    out = [(i, "".join(draw.choices(pieces, k=draw.randint(0, 60)))) for i in range(100, 500)]
    return out + [(11, "has <P> in it"), (12, "x\n<S>"), (13, "<M>"), (14, "\n"), (15, "no end"), (16, "line\n" * 70000 + "end")]


@pytest.mark.parametrize("options", [{}, {"unit": "char"}, {"rate": 40, "spm_rate": 20, "seed": 3}])
def test_transform_equals_brute_force_and_comes_back(corpus, odd, options):
    pairs = odd + texts()
    rows = infill.transform(corpus(pairs), **options)
    back = infill.restored(F.col("output"), F.col("form")).alias("back")
    found = [tuple(r) for r in rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", back).collect()]
    expected = [(*brute(i, t, **options), t or "") for i, t in pairs]
    assert sorted(map(repr, found)) == sorted(map(repr, expected))


def test_digest_and_empty_table(corpus):
    rows = infill.digest(infill.transform(corpus([(1, "a\nb\n"), (2, None)]))).collect()
    for row, text in zip(sorted(rows, key=lambda r: r.doc_id), ("a\nb\n", ""), strict=True):
        assert row.restored_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert row.output_sha256 == hashlib.sha256(brute(row.doc_id, text)[5].encode()).hexdigest()
    assert infill.transform(corpus([])).count() == 0
    with pytest.raises(ValueError):
        infill.transform(corpus([]), unit="page")
