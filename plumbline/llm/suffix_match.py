"""Benchmark decontamination with suffix arrays of the training text.

A task turns its documents into word ids and builds suffix arrays over shards of them.
Every suffix of every benchmark item is binary-searched in every shard: the search gives
the range of training suffixes that share its first ten words (its first words, all of
them, for shorter items), and the matches found at neighbouring suffixes join into the
longest verbatim matches with their places.

Only words of the benchmark can match, so only maximal runs of such words that are as
long as the shortest window enter the suffix arrays; this loses no match. The suffixes are
ranked by prefix doubling up to the window's length, which is all the order the searches
need. Training documents never leave their task. The benchmark travels to every task in
blocks of items with a bounded number of bytes; a benchmark of several blocks is searched
block by block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import id_text
from plumbline.session import settle

WINDOW = 10
BLOCK_BYTES = 16 << 20
SHARD_WORDS = 1 << 20
SPANS = "array<struct<item_id: string, item_word: int, doc_word: int, words: int>>"
MATCHES = f"doc_id long, row long, n_words long, n_hit long, spans {SPANS}"

# Fixed by the definition of a word: ASCII digits and letters (A-Z as a-z) and every byte from 0x80.
_WORD_BYTES = bytes(
    ord(chr(c).lower()) if c < 0x80 and chr(c).isalnum() else c if c >= 0x80 else 0x20 for c in range(256)
)


def words_of(body: bytes) -> list[bytes]:
    return body.translate(_WORD_BYTES).split()


@dataclass
class Windows:
    """The windows of a block of items: word ids ``w`` (one row a window, -1 beyond its end)."""

    vocabulary: dict[bytes, int]
    w: np.ndarray
    length: np.ndarray
    item: np.ndarray
    at: np.ndarray
    names: list[str]
    shortest: int


def windows_of(items: list[tuple[str, bytes]], window: int) -> Windows:
    vocabulary: dict[bytes, int] = {}
    rows, item, at = [], [], []
    names = [name for name, _ in items]
    for k, (_, body) in enumerate(items):
        ids = [vocabulary.setdefault(w, len(vocabulary)) for w in words_of(body)]
        size = min(window, len(ids))
        for i in range(len(ids) - size + 1 if ids else 0):
            rows.append(ids[i : i + size] + [-1] * (window - size))
            item.append(k)
            at.append(i)
    w = np.array(rows, np.int32).reshape(-1, window)
    length = (w >= 0).sum(axis=1).astype(np.int64)
    return Windows(
        vocabulary, w, length, np.array(item, np.int64), np.array(at, np.int64), names, int(length.min(initial=window))
    )


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes of ``text`` in the order of their first ``depth`` ids (prefix doubling)."""
    rank, span = text.astype(np.int64) + 2, 1
    order = np.argsort(rank, kind="stable")
    while span < depth:
        step = min(span, depth - span)
        later = np.zeros_like(rank)
        later[: len(rank) - step] = rank[step:]
        both = rank * (int(rank.max(initial=0)) + 2) + later
        order = np.argsort(both, kind="stable")
        ordered = both[order]
        rank = np.empty_like(rank)
        rank[order] = 1 + np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
        span += step
    return order


def _bound(text: np.ndarray, order: np.ndarray, windows: Windows, right: bool) -> np.ndarray:
    """For every window, the first suffix not below it (``right``: the first above it)."""
    low = np.zeros(len(windows.w), np.int64)
    high = np.full(len(windows.w), len(order), np.int64)
    while True:
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            return low
        middle = (low[open_] + high[open_]) // 2
        start = order[middle]
        less = np.zeros(len(open_), bool)
        equal = np.ones(len(open_), bool)
        for i in range(windows.w.shape[1]):
            want = windows.w[open_, i]
            equal_here = equal & (want >= 0)
            have = text[np.minimum(start + i, len(text) - 1)]
            less |= equal_here & (have < want)
            equal = np.where(want >= 0, equal & (have == want), equal)
        down = less | equal if right else less
        low[open_[down]] = middle[down] + 1
        high[open_[~down]] = middle[~down]


def occurrences(text: np.ndarray, windows: Windows) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (window, place in ``text``) at which the window occurs.

    ``text`` must end with an id of -1; runs are separated by -1, which no window holds.
    """
    if len(text) < 2 or not len(windows.w):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    order = suffix_array(text, windows.w.shape[1])
    low, high = _bound(text, order, windows, False), _bound(text, order, windows, True)
    sizes = high - low
    which = np.repeat(np.arange(len(sizes)), sizes)
    place = order[np.repeat(low - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(which))]
    return which, place


class _Shard:
    """Documents of one task until they have enough words for a suffix array."""

    def __init__(self, windows: Windows) -> None:
        self.windows = windows
        self.docs: list[tuple[int | None, int, int]] = []
        self.runs: list[np.ndarray] = []
        self.run_doc: list[int] = []
        self.run_word: list[int] = []
        self.words = 0

    def add(self, doc_id: int | None, row: int, body: bytes) -> None:
        found = words_of(body)
        self.docs.append((doc_id, row, len(found)))
        self.words += len(found) // 16 + 1  # rows of the output count as well
        get, shortest = self.windows.vocabulary.get, self.windows.shortest
        if len(found) < shortest or not len(self.windows.w):
            return
        ids = np.array([get(w, -1) for w in found], np.int32)
        edges = np.flatnonzero(np.diff(np.concatenate(([False], ids >= 0, [False])).astype(np.int8)))
        for begin, end in edges.reshape(-1, 2).tolist():
            if end - begin >= shortest:
                self.runs.append(np.append(ids[begin:end], -1))
                self.run_doc.append(len(self.docs) - 1)
                self.run_word.append(begin)
                self.words += end - begin

    def matches(self) -> pa.RecordBatch:
        spans: list[list[dict]] = [[] for _ in self.docs]
        hit = [0] * len(self.docs)
        if self.runs:
            text = np.concatenate(self.runs).astype(np.int32)
            starts = np.cumsum([0, *map(len, self.runs)])[:-1]
            which, place = occurrences(text, self.windows)
            run = np.searchsorted(starts, place, "right") - 1
            doc = np.array(self.run_doc, np.int64)[run]
            word = np.array(self.run_word, np.int64)[run] + place - starts[run]
            item, at, length = self.windows.item[which], self.windows.at[which], self.windows.length[which]
            hit = _covered(doc, word, length, len(self.docs))
            self._join(spans, doc, item, word, at, length)
        ids, rows, sizes = zip(*self.docs, strict=True)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()),
                pa.array(rows, pa.int64()),
                pa.array(sizes, pa.int64()),
                pa.array(hit, pa.int64()),
                pa.array(spans, _SPAN_TYPE),
            ],
            names=["doc_id", "row", "n_words", "n_hit", "spans"],
        )

    def _join(self, spans: list, doc, item, word, at, length) -> None:
        """Windows that follow each other on one diagonal are one longest match."""
        order = np.lexsort((word, word - at, item, doc))
        last = None
        for d, k, w, a, n in zip(*(x[order].tolist() for x in (doc, item, word, at, length)), strict=True):
            if last and last[:3] == (d, k, w - a) and w <= last[3]["doc_word"] + last[3]["words"]:
                last[3]["words"] = w + n - last[3]["doc_word"]
            else:
                span = {"item_id": self.windows.names[k], "item_word": a, "doc_word": w, "words": n}
                spans[d].append(span)
                last = (d, k, w - a, span)


_SPAN_TYPE = pa.list_(
    pa.struct([("item_id", pa.string()), ("item_word", pa.int32()), ("doc_word", pa.int32()), ("words", pa.int32())])
)


def _covered(doc: np.ndarray, word: np.ndarray, length: np.ndarray, docs: int) -> list[int]:
    """The number of words of each document that lie in any of its intervals."""
    total = np.zeros(docs, np.int64)
    order = np.lexsort((word, doc))
    at, reached = -1, 0
    for d, w, n in zip(doc[order].tolist(), word[order].tolist(), length[order].tolist(), strict=True):
        if d != at:
            at, reached = d, 0
        total[d] += max(0, w + n - max(w, reached))
        reached = max(reached, w + n)
    return total.tolist()


def _search(items: list[tuple[str, bytes]], window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = windows_of(items, window)
        shard = _Shard(windows)
        for batch in batches:
            for doc_id, row, body in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                shard.add(doc_id, row, body)
                if shard.words >= SHARD_WORDS:
                    yield shard.matches()
                    shard = _Shard(windows)
        if shard.docs:
            yield shard.matches()

    return run


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[str, bytes]]]:
    """The items in blocks of at most ``block_bytes`` (a longer item is a block of its own).

    They come to the driver one partition at a time, so one block is held at once.
    """
    items = benchmark.select(
        F.coalesce(benchmark[id_col].cast("string"), F.lit("")).alias("name"),
        F.coalesce(benchmark[text_col].cast("string"), F.lit("")).cast("binary").alias("body"),
    )
    block: list[tuple[str, bytes]] = []
    size = 0
    for name, body in items.toLocalIterator():
        body = bytes(body)
        if block and size + len(body) > block_bytes:
            yield block
            block, size = [], 0
        block.append((name, body))
        size += len(body)
    yield block


def matches(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``doc_id, n_words, n_hit, spans``: each document's verbatim matches with the benchmark.

    A span is a longest match of ``window`` words or more (or of a whole shorter item):
    the item, its first word there and in the document, and its words. ``n_hit`` counts the
    document's words inside any span. Null and empty texts have no words; an item without
    words matches nothing; a null item id is the empty string. Rows that repeat stay, each
    with its own result. An empty benchmark gives no spans, an empty table no rows.
    """
    rows = id_text(docs, id_col, text_col).select("doc_id", F.lit(0).cast("long").alias("row"), "body")
    blocks = _blocks(benchmark, item_id_col, item_text_col, block_bytes)
    first = next(blocks)
    second = next(blocks, None)
    if second is None:
        return rows.mapInArrow(_search(first, window), MATCHES).drop("row")
    # Several blocks: number the rows once, search block by block, and merge by row.
    rows = settle(rows.withColumn("row", F.monotonically_increasing_id()), "numbered")
    found = settle(rows.mapInArrow(_search(first, window), MATCHES), "matches")
    block: list[tuple[str, bytes]] | None = second
    while block is not None:
        more = settle(rows.mapInArrow(_search(block, window), MATCHES), "matches")
        found = found.unionByName(more)
        block = next(blocks, None)
    merged = found.groupBy("doc_id", "row", "n_words").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    marked = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["doc_word"], s["doc_word"] + s["words"] - 1))))
    return merged.select("doc_id", "n_words", F.size(marked).cast("long").alias("n_hit"), "spans")


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The rows of ``docs`` without a word inside a benchmark window, with all their columns.

    Rows are told apart by id and text, so rows that share an id (or have none) stand for themselves.
    """
    body = F.coalesce(docs[text_col].cast("string"), F.lit("")).cast("binary")
    rows = id_text(docs, id_col, text_col).select("doc_id", F.xxhash64("body").alias("row"), "body")
    hit = None
    for block in _blocks(benchmark, "item_id", "text", BLOCK_BYTES):
        found = rows.mapInArrow(_search(block, window), MATCHES).filter("n_hit > 0").select("doc_id", "row")
        found = settle(found.distinct(), "contaminated")
        hit = found if hit is None else hit.unionByName(found)
    same = docs[id_col].cast("long").eqNullSafe(hit["doc_id"]) & (F.xxhash64(body) == hit["row"])
    return docs.join(hit, same, "left_anti")


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from ``matches``."""
    names = F.array_sort(F.array_distinct(F.transform("spans", lambda s: s["item_id"])))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size(names).cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )

