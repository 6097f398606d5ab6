import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from plumbline.llm import best_two_fit
from plumbline.llm.best_two_fit import plan, plan_rows


def one_by_one(sizes, window):
    """Best-two-fit on the list itself, a sequence at a time, trying every pair."""
    left, out = Counter(sizes), []

    def known():
        return sorted(s for s in left if left[s] > 0)

    while known():
        filled, gap = [], window
        while fitting := [s for s in known() if s <= gap]:
            filled.append(fitting[-1])
            left[fitting[-1]] -= 1
            gap -= fitting[-1]
        while gap:
            least = min(filled)
            pairs = [
                (a + b, a, b)
                for a in known()
                for b in known()
                if b <= a and (a != b or left[a] > 1) and least < a + b <= least + gap
            ]
            if not pairs:
                break
            total, a, b = max(pairs)
            filled.remove(least)
            left[least] += 1
            for size in (a, b):
                filled.append(size)
                left[size] -= 1
            gap += least - total
        out.append(tuple(sorted(filled, reverse=True)))
    return out


@settings(max_examples=150, deadline=None)
@given(st.integers(2, 40).flatmap(lambda w: st.tuples(st.just(w), st.lists(st.integers(1, w), max_size=80))))
def test_plan_equals_packing_one_by_one(case):
    window, sizes = case
    found = plan(Counter(sizes), window)
    assert one_by_one(sizes, window) == [f.sizes for f in found for _ in range(f.times)]


def test_pairs_beat_greedy():
    # Greedy: 6 then 3, a gap of 1; the pair 2 + 2 fills the place of 3 and the gap.
    assert plan({6: 1, 3: 1, 2: 2}, 10)[0].sizes == (6, 2, 2)


def test_plan_rows_place_every_rank_once():
    draw = random.Random(1)
    counts = Counter(min(64, 1 + int(draw.expovariate(0.1))) for _ in range(5000))
    taken, ranks = {}, Counter()
    for size, first, last, base, places in plan_rows(plan(counts, 64)):
        assert first == ranks[size]
        ranks[size] = last
        for rank in range(first, last):
            at = rank - first
            taken.setdefault(base + at // len(places), []).append((places[at % len(places)], size))
    assert ranks == counts
    assert sorted(taken) == list(range(len(taken)))
    for own in taken.values():
        end = 0
        for offset, size in sorted(own):
            assert offset == end
            end += size
        assert end <= 64


def test_many_equal_lengths_need_a_short_plan():
    found = plan({700: 10**9, 300: 10**9, 48: 5}, 2048)
    assert len(found) < 20 and sum(f.times * sum(f.sizes) for f in found) == 10**12 + 240


@pytest.mark.parametrize("window", [16, 2048])
def test_pack_equals_the_plan_of_all_documents(corpus, odd, window):
    draw = random.Random(7)
    pairs = odd + [(i, f"document number {i} " * draw.randint(0, 12)) for i in range(10, 150)] + [(900, "copy of it")] * 90
    packed = best_two_fit.pack(corpus(pairs, 5), window=window)
    found = packed.toPandas().sort_values(["sequence_id", "offset"])
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    whole = sorted(tokenizer.encode(t or "", add_special_tokens=False).ids + [0] for _, t in pairs)
    sizes = [w for ids in whole for w in ([len(ids) % window] if len(ids) % window else []) + [window] * (len(ids) // window)]
    expected = one_by_one(sizes, window)
    groups = [tuple(sorted(own.length, reverse=True)) for _, own in found.groupby("sequence_id")]
    assert sorted(groups) == sorted(expected)
    for _, own in found.groupby("sequence_id"):
        assert (own.offset == np.concatenate(([0], np.cumsum(own.length)[:-1]))).all()
    assert (found.ids_crc32 == found.ids.map(zlib.crc32)).all() and (found.ids.map(len) == 4 * found.length).all()
    # Only the first piece of a document is shorter than a window if it has several.
    assert (found[found.piece > 0].length == window).all()
    known = found[found.doc_id >= 10].query("doc_id < 900").sort_values(["doc_id", "piece"])
    for doc_id, own in known.groupby("doc_id"):
        assert own.start.tolist() == [0, *np.cumsum(own.length).tolist()[:-1]] and own.piece.tolist() == list(range(len(own)))
        ids = np.frombuffer(b"".join(own.ids), "<u4").tolist()
        assert ids == tokenizer.encode(dict(pairs)[doc_id], add_special_tokens=False).ids + [0]
    rows = best_two_fit.sequences(packed).toPandas()
    assert rows.n.sum() == sum(sizes) and (rows.ids.map(len) == 4 * rows.n).all()


def test_empty_table(corpus):
    assert best_two_fit.pack(corpus([])).count() == 0
