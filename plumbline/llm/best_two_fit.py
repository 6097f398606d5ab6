"""Best-two-fit packing of whole documents into sequences of one length.

A document of up to ``window`` ids stays whole; a longer one is cut into pieces of ``window``
ids, of which the first takes what is left over. Best-two-fit fills a sequence greedily with
the largest unpacked piece that still fits. If a gap is left, it looks whether two unpacked
pieces together fill the place of the sequence's smallest piece and the gap more tightly than
that piece does, takes the two that fill it most, and repeats this while it helps.

Which piece of a length goes where makes no difference, so the plan is made from the number
of pieces of each length alone: ``window`` numbers, however many documents there are. The
next sequence is filled like the last one as long as no length that took part runs out, so the
plan is a short list of fillings with their numbers of sequences: the very ones that packing
sequence by sequence gives. Every piece then finds its place by its rank among the pieces of
its length, which comes from prefix sums over partitions. No piece's ids are shuffled.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import id_text
from plumbline.llm.encode import encoder, forgetting, slices, strings
from plumbline.session import settle

WINDOW = 2048
MAX_PLAN_ROWS = 1_000_000
_CUT = "part int, doc_id long, piece int, start long, length long, ids_crc32 long, rank long, ids binary"
_PLAN = T.StructType(
    [
        T.StructField("size", T.LongType()),
        T.StructField("first", T.LongType()),
        T.StructField("last", T.LongType()),
        T.StructField("base", T.LongType()),
        T.StructField("places", T.ArrayType(T.LongType())),
    ]
)


@dataclass(frozen=True)
class Filling:
    """Pieces of these lengths, longest first, fill ``times`` sequences."""

    sizes: tuple[int, ...]
    times: int


def _two(left: np.ndarray, more_than: int, at_most: int) -> tuple[int, int] | None:
    """The two available lengths with the largest sum in (more_than, at_most]; the longest piece decides ties."""
    known = np.flatnonzero(left)
    a = known[known < at_most]
    if not len(a):
        return None
    # The longest partner of each a that is no longer than a itself; a twin needs a second piece.
    partner = np.searchsorted(known, np.minimum(a, at_most - a), "right") - 1
    twin = (partner >= 0) & (known[partner] == a) & (left[a] < 2)
    partner = partner - twin
    total = np.where(partner >= 0, a + known[partner], 0)
    best = len(total) - 1 - int(np.argmax(total[::-1]))
    if total[best] <= more_than:
        return None
    return int(a[best]), int(known[partner[best]])


def _fill(left: np.ndarray, window: int) -> tuple[list[int], Counter]:
    """One sequence by best-two-fit, taken from ``left``; with it every length it took, even if put back."""
    sizes: list[int] = []
    taken: Counter = Counter()
    gap = window

    def take(size: int) -> None:
        left[size] -= 1
        taken[size] += 1
        sizes.append(size)

    while gap:
        fitting = np.flatnonzero(left[: gap + 1])
        if not len(fitting):
            break
        take(int(fitting[-1]))
        gap -= sizes[-1]
    while gap and sizes:
        smallest = min(sizes)
        pair = _two(left, smallest, smallest + gap)
        if pair is None:
            break
        sizes.remove(smallest)
        left[smallest] += 1
        for size in pair:
            take(size)
        gap += smallest - sum(pair)
    return sizes, taken


def plan(counts: dict[int, int], window: int = WINDOW) -> list[Filling]:
    """The fillings for ``counts`` pieces of each length from 1 to ``window``."""
    left = np.zeros(window + 1, np.int64)
    for size, n in counts.items():
        left[size] = n
    found = []
    while left.any():
        before = left.copy()
        sizes, taken = _fill(left, window)
        used = Counter(sizes)
        # A repetition takes the same way while every length it takes from has that many pieces.
        times = min([max(1, (int(before[s]) - taken[s]) // used[s] + 1) for s in used])
        for size, n in used.items():
            left[size] = before[size] - times * n
        found.append(Filling(tuple(sorted(sizes, reverse=True)), times))
    return found


def plan_rows(fillings: list[Filling]) -> list[tuple[int, int, int, int, list[int]]]:
    """``size, first, last, base, places``: the pieces of a length with ranks from ``first`` to before ``last``
    lie in the sequences from ``base`` on, at ``places`` one after the other in each."""
    rows, base, ranks = [], 0, Counter()
    for filling in fillings:
        offsets = np.cumsum((0, *filling.sizes[:-1])).tolist()
        for size in sorted(set(filling.sizes)):
            places = [o for o, s in zip(offsets, filling.sizes, strict=True) if s == size]
            first = ranks[size]
            ranks[size] += filling.times * len(places)
            rows.append((size, first, ranks[size], base, places))
        base += filling.times
    return rows


def pieces(
    docs: DataFrame, vocabulary: str, end_id: int, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The pieces of all documents with their ids, written to the shared folder.

    ``rank`` is a piece's number among the pieces of its length in its partition ``part``.
    """
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(window + 1, np.int64)
        encode = encoder(vocabulary).ids
        for some in slices(batches):
            ids = encode(strings(some.column("body")), end)
            n = pc.binary_length(ids).to_numpy(zero_copy_only=False).astype(np.int64) // 4
            number = -(-n // window)
            row = np.repeat(np.arange(len(n)), number)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number)
            first = n - (number - 1) * window
            length = np.where(piece == 0, first[row], window)
            start = np.where(piece == 0, 0, first[row] + (piece - 1) * window)
            order = np.argsort(length, kind="stable")
            run_of = length[order]
            rank = np.empty(len(row), np.int64)
            rank[order] = seen[run_of] + np.arange(len(row)) - np.searchsorted(run_of, run_of)
            seen += np.bincount(length, minlength=window + 1)
            whole = ids.to_pylist()
            cut = [
                whole[r] if m == 1 else whole[r][4 * a : 4 * (a + size)]
                for r, m, a, size in zip(row.tolist(), number[row].tolist(), start.tolist(), length.tolist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(row), part, np.int32)),
                    some.column("doc_id").take(pa.array(row)),
                    pa.array(piece.astype(np.int32)),
                    pa.array(start),
                    pa.array(length),
                    pa.array([zlib.crc32(x) for x in cut], pa.int64()),
                    pa.array(rank),
                    pa.array(cut, pa.binary()),
                ],
                names=["part", "doc_id", "piece", "start", "length", "ids_crc32", "rank", "ids"],
            )

    return settle(id_text(docs, id_col, text_col).mapInArrow(forgetting(run), _CUT), "pieces", compression="zstd")


def place(cut: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset, ids`` of cut pieces.

    The counts of the lengths, at most ``window`` rows, come to the driver for the plan; the
    plan's rows are broadcast if they are at most ``MAX_PLAN_ROWS``, else Spark chooses the join.
    """
    spark = cut.sparkSession
    per_part = settle(cut.groupBy("part", "length").agg(F.count("*").alias("n")), "lengths")
    counts = {r["length"]: r["n"] for r in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    rows = plan_rows(plan(counts, window))
    planned = spark.createDataFrame(rows, _PLAN)
    if len(rows) <= MAX_PLAN_ROWS:
        planned = F.broadcast(planned)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_part.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = cut.join(settle(bases, "bases"), ["part", "length"]).withColumn("rank", F.col("before") + F.col("rank"))
    at = F.col("rank") - F.col("first")
    of_length = (F.col("length") == F.col("size")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("last"))
    return ranked.join(planned, of_length).select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.col("base") + F.floor(at / F.size("places"))).cast("long").alias("sequence_id"),
        F.get("places", (at % F.size("places")).cast("int")).alias("offset"),
        "ids",
    )


def pack(
    docs: DataFrame,
    vocabulary: str = "byte_bpe_50k.json",
    end_id: int = 0,
    window: int = WINDOW,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """All documents packed into sequences of at most ``window`` ids, as pieces with their ids.

    Null and empty texts are the end id alone. Repeated rows are packed as often as they
    occur, rows with a null id like others. Equal lengths are placed in the order of their
    partitions. Sequences are numbered without gaps from 0, the fullest first; offsets in a
    sequence have no gaps. An empty table gives no pieces. Other columns are not looked at.
    """
    return place(pieces(docs, vocabulary, end_id, window, id_col, text_col), window)


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, n, ids``: the sequences themselves. A group holds at most ``window`` pieces."""
    parts = F.array_sort(F.collect_list(F.struct("offset", F.hex("ids").alias("digits"))))
    whole = packed.groupBy("sequence_id").agg(
        F.sum("length").alias("n"), F.array_join(F.transform(parts, lambda p: p["digits"]), "").alias("digits")
    )
    return whole.select("sequence_id", "n", F.unhex("digits").alias("ids"))
