import tracemalloc

import numpy as np
import pyarrow as pa

from plumbline.llm import encode, noisy_channel, packing
from plumbline.llm.noisy_channel import SYMBOLS, symbols

TEXTS = ["", " ", "a", "Ünï ÇA İstanbul\nΣΣ ς", "one two three", "漢字 \U0001f600 x", "z" * 3000, "ab" * 9]


def test_characters_are_counted_a_slice_at_a_time():
    texts = TEXTS * 3 + [f"{i} some words of an ordinary text, " * 60 for i in range(16_000)]
    batch = pa.RecordBatch.from_arrays([pa.array([t.encode() for t in texts])], names=["body"])
    tracemalloc.start()
    (found,) = noisy_channel._count(iter([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert batch.nbytes > 32 << 20 and peak < 24 << 20
    assert found.num_rows > 50


def test_no_character_trigram_spans_two_documents():
    expected = np.zeros(SYMBOLS**3, np.int64)
    for text in TEXTS:
        s = symbols(f" {text.lower()} ")
        for u, v, w in zip(s, s[1:], s[2:]):
            expected[(u * SYMBOLS + v) * SYMBOLS + w] += 1
    batch = pa.RecordBatch.from_arrays([pa.array([t.encode() for t in TEXTS])], names=["body"])
    (found,) = noisy_channel._count(iter([batch, batch.slice(0, 0), batch.slice(0, 1)]))
    assert dict(zip(*(found.column(c).to_pylist() for c in ("gram", "n")))) == {i: expected[i] for i in np.flatnonzero(expected)}


def test_idle_workers_hold_no_memo(spark, corpus):
    assert packing.pack(corpus([(i, f"word{i} and words") for i in range(60)])).count() >= 60

    def held(batches):
        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sum(len(e.young) + len(e.old) for e in encode._WORKER.values())])], names=["n"])

    assert {r.n for r in spark.range(0, 64, 1, 16).mapInArrow(held, "n long").collect()} == {0}
