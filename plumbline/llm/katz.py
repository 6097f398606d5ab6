"""Katz backoff language model, counted and evaluated in blocks of documents.

Documents are cut into blocks (one Parquet row each) that hold their tokens as indexes
into the block's own sorted list of words. A word, and every n-gram, is identified by a
64-bit hash. Whatever a block must know about its n-grams from the whole corpus goes
through an exchange: the block sends each different n-gram once, with what it adds, to the
partition of the n-gram's hash; that partition merges equal n-grams of all blocks and
sends the sums back in the block's own order. Frequent words need no care, because a block
sends a word once however often it holds it, and no table of words or n-grams is ever
broadcast or collected: the partitioned tables are the exchange's partitions, and their
size follows the corpus. Blocks are bucketed by their number, so what comes back is joined
without moving them again.

Counts up to ``GT_MAX`` are discounted by Good-Turing on smoothed counts of counts (Simple
Good-Turing) with the usual renormalisation, larger counts by ``TOP_DISCOUNT``, so that no context is left without mass for unseen words. For
order n the probability of a token is the discounted relative frequency where the n-gram
was seen in training, else the backoff weight of its context times the probability for
order n - 1. The backoff weight is what the discounts leave of the context divided by what
order n - 1 gives to words not seen in the context, so each context's distribution sums to
one exactly over the training words and the class of unknown words.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import id_text, packed
from plumbline.session import settle, settle_bucketed

GT_MAX = 5
TOP_DISCOUNT = 1 - 1e-6
ZIPF_SLOPE, FLATTEST = -2.0, -1.1
BLOCK_TOKENS = 1_000_000
KEYS_PER_PART = 1_500_000
END, BEGIN = np.uint64(0), np.uint64(1)
FOLDS, HELD_OUT = 7, 2

_BLOCK = "block long, docs binary, known binary, held binary, lengths binary, words binary, tokens binary"
_SENT = "part int, block long, keys binary, a binary, b binary, want binary"
_MERGED = "part int, block long, a binary, b binary, own binary, histogram array<long>"


def is_held_out(doc_id: int | None) -> bool:
    """Whether a document is kept out of training; a null id never is."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % FOLDS == HELD_OUT


# Blocks -----------------------------------------------------------------------------------


def _to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, number = TaskContext.get().partitionId(), 0
    docs: list[int | None] = []
    lengths: list[int] = []
    hashes: list[np.ndarray] = []
    size = 0

    def block() -> pa.RecordBatch:
        words, tokens = np.unique(np.concatenate(hashes), return_inverse=True)
        columns = {
            "docs": np.array([d or 0 for d in docs], np.int64),
            "known": np.array([d is not None for d in docs], bool),
            "held": np.array([is_held_out(d) for d in docs], bool),
            "lengths": np.array(lengths, np.int64),
            "words": words,
            "tokens": tokens.astype(np.uint32),
        }
        return pa.RecordBatch.from_arrays(
            [pa.array([(part << 32) + number]), *(pa.array([packed(v)], pa.binary()) for v in columns.values())],
            names=["block", *columns],
        )

    for batch in batches:
        for doc_id, body in zip(batch.column("doc_id").to_pylist(), batch.column("body").to_pylist(), strict=True):
            found = body.lower().split()
            own = np.empty(len(found) + 1, np.uint64)
            own[:-1] = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))
            own[-1] = END
            docs.append(doc_id)
            lengths.append(len(own))
            hashes.append(own)
            size += len(own)
            if size >= BLOCK_TOKENS:
                yield block()
                docs, lengths, hashes, size, number = [], [], [], 0, number + 1
    if docs:
        yield block()


class Block:
    """A block's arrays; ``grams(n)`` are the n-grams that end at each token."""

    def __init__(self, row: dict) -> None:
        self.block = row["block"]
        self.docs = np.frombuffer(row["docs"], np.int64)
        self.known = np.frombuffer(row["known"], bool)
        self.held = np.frombuffer(row["held"], bool)
        self.lengths = np.frombuffer(row["lengths"], np.int64)
        self.words = np.frombuffer(row["words"], np.uint64)
        self.tokens = np.frombuffer(row["tokens"], np.uint32).astype(np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.doc = np.repeat(np.arange(len(self.lengths)), self.lengths)
        self.train = ~self.held[self.doc]

    def context(self, n: int) -> np.ndarray:
        """The hash of the n - 1 tokens before each token (BEGIN where the text begins)."""
        mixed = np.full(len(self.tokens), np.uint64(n))
        for back in range(n - 1, 0, -1):
            at = np.arange(len(self.tokens)) - back
            inside = at >= self.starts[self.doc]
            word = np.where(inside, self.words[self.tokens[np.maximum(at, 0)]], BEGIN)
            mixed = _mix(mixed, word)
        return mixed

    def grams(self, n: int) -> np.ndarray:
        word = self.words[self.tokens]
        return word if n == 1 else _mix(self.context(n), word)


def _mix(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """One 64-bit hash of two, the same for the same pair everywhere."""
    with np.errstate(over="ignore"):
        x = left * np.uint64(0x9E3779B97F4A7C15) + right
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


# Exchange -----------------------------------------------------------------------------------


def _planes(keys: np.ndarray) -> bytes:
    """Sorted keys as differences, byte by byte: the high bytes are mostly zero and compress."""
    return packed(np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T)


def _keys(planes: bytes) -> np.ndarray:
    octets = np.frombuffer(planes, np.uint8).reshape(8, -1).T
    return np.cumsum(np.ascontiguousarray(octets).view(np.uint64).ravel(), dtype=np.uint64)


def _sent(
    block: int, keys: np.ndarray, a: np.ndarray, b: np.ndarray, want: np.ndarray, parts: int
) -> Iterator[pa.RecordBatch]:
    """Sorted different keys and two values each, cut into the partitions of the keys' upper bits.

    ``want`` marks the keys whose sums the block wants back; others come back as zero.
    """
    owner = ((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    edges = np.searchsorted(owner, np.arange(parts + 1, dtype=np.uint64))
    filled = np.flatnonzero(edges[1:] > edges[:-1])
    slices = list(zip(edges[filled], edges[filled + 1], strict=True))
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(filled.astype(np.int32)),
            pa.array(np.full(len(filled), block, np.int64)),
            pa.array([_planes(keys[i:j]) for i, j in slices], pa.binary()),
            *(pa.array([packed(x[i:j]) for i, j in slices], pa.binary()) for x in (a, b)),
            pa.array([packed(np.packbits(want[i:j])) for i, j in slices], pa.binary()),
        ],
        names=["part", "block", "keys", "a", "b", "want"],
    )


def _merge(kind_a: str, kind_b: str):
    """Sums of both values over equal keys, back in every block's order. ``own`` marks the keys
    of which this block is the first to add to the first value."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("block", ignore_index=True)
        each = [_keys(x) for x in group["keys"]]
        cuts = np.cumsum([len(x) for x in each])[:-1]
        keys = np.concatenate(each)
        del each
        a = np.concatenate([np.frombuffer(x, kind_a) for x in group["a"]])
        b = np.concatenate([np.frombuffer(x, kind_b) for x in group["b"]])
        order = np.argsort(keys, kind="stable")
        new = np.empty(len(keys), bool)
        new[:1] = True
        new[1:] = keys[order[1:]] != keys[order[:-1]]
        index = np.empty(len(keys), np.int64)
        index[order] = np.cumsum(new) - 1
        n = int(new.sum())
        sum_a, sum_b = np.bincount(index, a, n), np.bincount(index, b, n)
        adds = np.flatnonzero(a)[::-1]
        first = np.full(n, -1)
        first[index[adds]] = adds
        own = np.zeros(len(keys), bool)
        own[first[first >= 0]] = True
        histogram = np.bincount(np.minimum(sum_a, GT_MAX + 2).astype(np.int64), minlength=GT_MAX + 3)
        blank = [[0] * (GT_MAX + 3)] * (len(group) - 1)
        back: dict[str, list[bytes]] = {"a": [], "b": [], "own": []}
        for at, want, mine in zip(np.split(index, cuts), group["want"], np.split(own, cuts), strict=True):
            wanted = np.unpackbits(np.frombuffer(want, np.uint8), count=len(at)).astype(bool)
            back["a"].append(packed(np.where(wanted, sum_a[at], 0).astype(kind_a)))
            back["b"].append(packed(np.where(wanted, sum_b[at], 0).astype(kind_b)))
            back["own"].append(packed(np.packbits(mine)))
        return pd.DataFrame(
            {"part": group["part"], "block": group["block"], **back, "histogram": [histogram.tolist(), *blank]}
        )

    return run


def _exchange(sent: DataFrame, name: str, kind_a: str, kind_b: str) -> DataFrame:
    """The merged values of every block's keys, one row for each block and partition."""
    return settle(sent.groupBy("part").applyInPandas(_merge(kind_a, kind_b), _MERGED), name, compression="zstd")


def _gathered(merged: DataFrame, name: str) -> DataFrame:
    """The slices of each block as an array in the order of partitions (at most one for each)."""
    slices = F.array_sort(F.collect_list(F.struct("part", "a", "b", "own")))
    return merged.groupBy("block").agg(slices.alias(name))


def _joined(slices: list[dict], field: str, kind: str) -> np.ndarray:
    return np.concatenate([np.frombuffer(s[field], kind) for s in slices])


def _own(slices: list[dict], kind: str) -> np.ndarray:
    sizes = [len(s["a"]) // np.dtype(kind).itemsize for s in slices]
    bits = [np.unpackbits(np.frombuffer(s["own"], np.uint8), count=n) for s, n in zip(slices, sizes, strict=True)]
    return np.concatenate(bits).astype(bool)


# Discounts ----------------------------------------------------------------------------------


def slope(of_counts: list[int]) -> float:
    """Slope of log n_c over log c, fitted to the counts 1..GT_MAX + 1 (Simple Good-Turing).

    Empty counts are filled as Gale and Sampson do: the n-grams of a count stand for half the way to its
    neighbours that occur. Each count weighs as many as it has n-grams. A fit needs two counts; with
    fewer it is -2 (Zipf's law). It is kept below -1, where discounts begin.
    """
    seen = [c for c in range(1, GT_MAX + 2) if of_counts[c] > 0]
    if len(seen) < 2:
        return ZIPF_SLOPE
    around = [0, *seen, 2 * seen[-1] - seen[-2]]
    n = np.array([of_counts[c] for c in seen], np.float64)
    spread = np.array([(high - low) / 2 for low, high in zip(around, around[2:], strict=False)])
    x, y = np.log(seen), np.log(n / spread)
    x_mean, y_mean = np.average(x, weights=n), np.average(y, weights=n)
    found = np.sum(n * (x - x_mean) * (y - y_mean)) / np.sum(n * (x - x_mean) ** 2)
    return float(min(found, FLATTEST))


def discounts(of_counts: list[int]) -> np.ndarray:
    """Good-Turing factors for the counts 0..GT_MAX + 1 (the last stands for all larger).

    ``of_counts[c]`` is the number of different n-grams with count c. Copies and chance make these
    numbers uneven, so the smooth line n_c ~ c^slope stands for them: with it the
    adjusted count over c is (1 + 1/c)^(slope + 1), and Katz' formula for counts up to GT_MAX gives
    factors that lie between 0 and 1 for every corpus and grow with c.
    """
    d = np.full(GT_MAX + 2, TOP_DISCOUNT)
    d[0] = 0.0
    c = np.arange(1, GT_MAX + 1)
    power = slope(of_counts) + 1
    tail = float(GT_MAX + 1) ** power
    d[1 : GT_MAX + 1] = ((1 + 1 / c) ** power - tail) / (1 - tail)
    return d


def _histogram(merged: DataFrame) -> list[int]:
    """Counts of counts: at most GT_MAX + 3 numbers."""
    sums = merged.agg(*(F.sum(F.col("histogram")[i]).alias(str(i)) for i in range(GT_MAX + 3))).first()
    return [int(x or 0) for x in sums]


# Model --------------------------------------------------------------------------------------


class Unigram:
    """Discounted word probabilities; ``left`` is the probability of the class of unknown words."""

    def __init__(self, d: np.ndarray, of_counts: list[int], kept: float, total: int) -> None:
        self.d, self.total, self.types = d, total, sum(of_counts[1:])
        self.left = 1.0 - kept / total if total else 1.0

    def log(self, count: np.ndarray) -> np.ndarray:
        seen = _share(self.d, count, np.full(len(count), float(self.total)))
        return np.log10(np.where(count > 0, seen, self.left))


def _share(d: np.ndarray, count: np.ndarray, total: np.ndarray) -> np.ndarray:
    return d[np.minimum(count, GT_MAX + 1).astype(np.int64)] * count / np.maximum(total, 1)


class Level:
    """The different n-grams and contexts of a block, and where its tokens find theirs."""

    def __init__(self, block: Block, n: int) -> None:
        self.keys, self.first, self.index = np.unique(block.grams(n), return_index=True, return_inverse=True)
        self.contexts, self.context = np.unique(block.context(n), return_inverse=True)
        self.local = np.bincount(self.index, block.train, len(self.keys)).astype(np.uint32)


class Evaluation:
    """Log probabilities of a block's tokens, order by order (the recursion of the model)."""

    def __init__(self, block: Block, row: dict, model: Model) -> None:
        self.block, self.row, self.model = block, row, model
        self.count = _joined(row["g1"], "a", "u4").astype(np.float64)[block.tokens]
        self.known = self.count > 0
        self.logs = model.unigram.log(self.count)

    def open(self, n: int) -> None:
        """Counts of the n-grams, and of their contexts: the (n-1)-grams one token before."""
        self.total = np.empty(len(self.count))
        self.total[1:] = self.count[:-1]
        self.total[self.block.starts] = self.model.train_docs
        self.level = Level(self.block, n)
        self.count = _joined(self.row[f"g{n}"], "a", "u4").astype(np.float64)[self.level.index]

    def close(self, n: int) -> None:
        mass = _joined(self.row[f"c{n}"], "a", "f8")[self.level.context]
        lower = _joined(self.row[f"c{n}"], "b", "f8")[self.level.context]
        seen = self.count > 0
        share = _share(self.model.d[n], self.count, self.total)
        with np.errstate(divide="ignore", invalid="ignore"):
            weight = np.where(self.total > 0, np.log10(1 - mass / self.total) - np.log10(1 - lower), 0.0)
            self.logs = np.where(seen, np.log10(np.where(seen, share, 1.0)), weight + self.logs)


class Model:
    """What the whole corpus gives every task: a handful of numbers for each order."""

    def __init__(self, train_docs: int) -> None:
        self.train_docs = train_docs
        self.d: dict[int, np.ndarray] = {}
        self.unigram: Unigram


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Block, dict]]:
    for batch in batches:
        for at in range(batch.num_rows):
            row = {name: batch.column(name)[at].as_py() for name in batch.schema.names}
            yield Block(row), row


def _send_grams(n: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _ in _rows(batches):
            level = Level(block, n)
            every = np.ones(len(level.keys), bool)
            yield from _sent(block.block, level.keys, level.local, np.zeros(len(every), np.uint8), every, parts)

    return run


def _send_contexts(n: int, model: Model, parts: int):
    """For every context, the discounted counts and the lower-order probabilities of the words
    seen there; each n-gram is added by the block that owns it. Wanted back for contexts of
    tokens not seen in training."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, row in _rows(batches):
            found = Evaluation(block, row, model)
            for m in range(2, n + 1):
                found.open(m)
                if m < n:
                    found.close(m)
            level, size = found.level, len(found.level.contexts)
            mine = level.first[_own(row[f"g{n}"], "u4")]
            of, count = level.context[mine], found.count[mine]
            kept = model.d[n][np.minimum(count, GT_MAX + 1).astype(np.int64)] * count
            want = np.bincount(level.context, found.count == 0, size) > 0
            mass, lower = np.bincount(of, kept, size), np.bincount(of, 10.0 ** found.logs[mine], size)
            yield from _sent(block.block, level.contexts, mass, lower, want, parts)

    return run


_SCORES = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
)


def _scores(model: Model, order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, types = model.unigram.total, model.unigram.types
        for block, row in _rows(batches):
            found = Evaluation(block, row, model)
            base = np.log10((found.count + 1) / (total + types + 1))
            for n in range(2, order + 1):
                found.open(n)
                found.close(n)
            docs = len(block.docs)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(block.docs, pa.int64(), mask=~block.known),
                    pa.array(block.held),
                    pa.array(block.lengths),
                    pa.array(np.bincount(block.doc, found.known, docs).astype(np.int64)),
                    pa.array(np.full(docs, total, np.int64)),
                    pa.array(np.bincount(block.doc, base, docs)),
                    pa.array(np.bincount(block.doc, found.logs, docs)),
                ],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return run


def _kept(words: DataFrame, d: np.ndarray) -> tuple[float, int]:
    """Sum of the discounted and of the plain training counts of all words, each from its owner."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, total = 0.0, 0
        for batch in batches:
            for part in batch.to_pylist():
                count = np.frombuffer(part["a"], "u4")[_own([part], "u4")].astype(np.float64)
                kept += float((d[np.minimum(count, GT_MAX + 1).astype(np.int64)] * count).sum())
                total += int(count.sum())
        yield pa.RecordBatch.from_arrays([pa.array([kept]), pa.array([total])], names=["kept", "total"])

    sums = words.select("a", "own").mapInArrow(run, "kept double, total long").agg(F.sum("kept"), F.sum("total"))
    kept, total = sums.first()
    return kept or 0.0, total or 0


def score(docs: DataFrame, order: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base-10 log probability of every row's text under a Katz model of the training rows.

    Returns ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``. Tokens
    are the words between ASCII white space with A-Z lower-cased, and one end token. A null
    or empty text is an end token alone. Rows whose id falls into the held-out fold do not
    train; a null id trains. Repeated rows are counted and scored each. An empty table gives
    no rows. If no row trains, every token is unknown with probability one in both scores.
    """
    if order < 1:
        raise ValueError("order must be 1 or more")
    blocks = id_text(docs, id_col, text_col).mapInArrow(_to_blocks, _BLOCK)
    blocks = settle_bucketed(blocks, "blocks", "block", compression="zstd")
    words, tokens, train_docs, count = blocks.agg(
        F.sum(F.length("words") / 8).cast("long"),
        F.sum(F.length("tokens") / 4).cast("long"),
        F.sum(F.length(F.replace(F.hex("held"), F.lit("01"), F.lit(""))) / 2).cast("long"),
        F.count("*"),
    ).first()
    if not count:
        return docs.sparkSession.createDataFrame([], _SCORES)
    model = Model(train_docs)
    known = blocks
    for n in range(1, order + 1):
        parts = max(1, -(-(words if n == 1 else tokens) // KEYS_PER_PART))
        grams = _exchange(blocks.mapInArrow(_send_grams(n, parts), _SENT), f"grams{n}", "u4", "u1")
        of_counts = _histogram(grams)
        model.d[n] = discounts(of_counts)
        if n == 1:
            model.unigram = Unigram(model.d[1], of_counts, *_kept(grams, model.d[1]))
        known = known.join(_gathered(grams, f"g{n}"), "block")
        if n > 1:
            sent = known.mapInArrow(_send_contexts(n, model, parts), _SENT)
            known = known.join(_gathered(_exchange(sent, f"contexts{n}", "f8", "f8"), f"c{n}"), "block")
    return known.mapInArrow(_scores(model, order), _SCORES)
