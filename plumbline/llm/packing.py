"""Concatenate and cut: documents end to end, cut into windows of one length.

Pass one encodes every document once and writes its ids to the shared folder with its
place within its own partition. The partitions' totals, one row each, give every
partition's base by a prefix sum; base plus place is a document's position in the one
long sequence of all ids. Pass two cuts at the multiples of the window length. Only the
last window can be short, so padding is less than one window whatever the input.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import id_text, tidy
from plumbline.llm.encode import encoder, forgetting, slices, strings
from plumbline.session import settle

WINDOW = 2048
MAX_BROADCAST_ROWS = 1_000_000
_ENCODED = "doc_id long, part int, place long, n long, ids binary"
_PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long, closes boolean, ids binary"
)


def encoded(
    docs: DataFrame, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: its ids (unsigned 32-bit, the end id last), its partition ``part`` and its
    ``place``, the number of ids before it in that partition. Written to the shared folder."""
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place = TaskContext.get().partitionId(), 0
        encode = encoder(vocabulary).ids
        for some in slices(batches):
            ids = encode(strings(some.column("body")), end)
            n = pc.binary_length(ids).to_numpy(zero_copy_only=False).astype(np.int64) // 4
            places = place + np.cumsum(n) - n
            place += int(n.sum())
            yield pa.RecordBatch.from_arrays(
                [
                    some.column("doc_id"),
                    pa.array(np.full(len(ids), part, np.int32)),
                    pa.array(places),
                    pa.array(n),
                    ids,
                ],
                names=["doc_id", "part", "place", "n", "ids"],
            )

    rows = id_text(docs, id_col, text_col).mapInArrow(forgetting(run), _ENCODED)
    return settle(rows, "encoded", compression="zstd")


def bases(rows: DataFrame) -> DataFrame:
    """``part, base``: the ids in all earlier partitions; one row for each partition that wrote rows."""
    totals = rows.groupBy("part").agg(F.sum("n").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))


def cut(rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """The pieces of encoded documents: one row for each document and window that share ids.

    ``start`` counts the document's ids before the piece, ``offset`` the window's.
    ``closes`` marks the boundary records: pieces that fill their window.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {name: [] for name in names}
            size = 0
            for doc_id, base, place, n, ids in zip(
                *(batch.column(c).to_pylist() for c in ("doc_id", "base", "place", "n", "ids")), strict=True
            ):
                first = base + place
                for sequence in range(first // window, (first + n - 1) // window + 1):
                    low, high = max(first, sequence * window), min(first + n, (sequence + 1) * window)
                    piece = ids[(low - first) * 4 : (high - first) * 4]
                    values = (
                        doc_id, low - first, high - low, zlib.crc32(piece), n,
                        sequence, low - sequence * window, high == (sequence + 1) * window, piece,
                    )
                    for name, value in zip(names, values, strict=True):
                        out[name].append(value)
                    size += len(piece)
                if size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in fields], names=names)
                    out, size = {name: [] for name in names}, 0
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in fields], names=names)

    long = pa.int64()
    fields = [
        *(pa.field(c, long) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")),
        pa.field("closes", pa.bool_()),
        pa.field("ids", pa.binary()),
    ]
    names = [f.name for f in fields]
    first = settle(bases(rows), "bases")
    # One row of two numbers for each partition of the input; beyond a million of them Spark chooses the join.
    first = F.broadcast(first) if first.count() <= MAX_BROADCAST_ROWS else first
    placed = rows.join(first, "part").select("doc_id", "base", "place", "n", "ids")
    return placed.mapInArrow(tidy(run), _PIECES)


def pack(
    docs: DataFrame,
    vocabulary: str = "byte_bpe_50k.json",
    end_id: int = 1,
    window: int = WINDOW,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """All documents packed into windows of ``window`` ids, as pieces with their ids.

    Every id lies in exactly one piece; null and empty texts are one end id. Windows and
    offsets are without gaps. Repeated rows are packed as often as they occur and rows with
    a null id are packed like others. An empty table gives no pieces. The order of
    documents is that of the input's partitions.
    """
    return cut(encoded(docs, vocabulary, end_id, id_col, text_col), window)


def sequences(pieces: DataFrame, window: int = WINDOW, pad_id: int = 0) -> DataFrame:
    """``sequence_id, n, ids``: the windows themselves, padded with ``pad_id`` to ``window`` ids.

    A short window whose length is a power of two is left at that length. A group holds at
    most ``window`` pieces.
    """
    whole = pieces.groupBy("sequence_id").agg(
        F.sum("length").alias("n"),
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("offset", F.hex("ids").alias("digits")))), lambda p: p["digits"]), ""
        ).alias("digits"),
    )
    power = F.bit_count("n") == 1
    missing = F.when(power, 0).otherwise(F.lit(window) - F.col("n")).cast("int")
    padding = F.repeat(F.lit(int(pad_id).to_bytes(4, "little").hex()), missing)
    return whole.select("sequence_id", "n", F.unhex(F.concat("digits", padding)).alias("ids"))
