"""Flat token files: unsigned integers end to end, with 64-bit document offsets.

A data set of token files is a folder with

* ``data/kind=ids/part=*``: the ids of the documents in ascending id order, as little-endian
  unsigned 16-bit integers (32-bit when the vocabulary needs them), nothing else;
* ``offsets/part=*``: for each document, in the same order, the number of ids before it in
  the whole data set, as little-endian unsigned 64-bit integers;
* ``index`` (Parquet): the same per document with its id, for Spark.

The parts are ranges of document ids, so they stand in the order of their numbers; a part
is one file, written by one task. Documents are encoded once, before the only shuffle.
Spark's own text writer writes the flat files, so task retries and lost executors leave no
half-written file: a row is a document's ids without the end id, and the end id is the line
separator. The same writer keeps each document's id and size (``data/kind=sizes``), from
which prefix sums over the parts' totals give every part's base and so the offsets. The
upper two bytes of an offset are its line separator; totals stay below 2**48 ids.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.common import id_text
from plumbline.llm.encode import encoder, forgetting, slices, strings
from plumbline.llm.packing import bases
from plumbline.session import scratch_path, settle

_ENCODED = "part int, doc_id long, n long, crc long, ids binary"
_RECORDS = "kind string, part int, rank long, value binary"
_SIZES = "part int, at long, doc_id long, n long, place long"


@dataclass(frozen=True)
class TokenFiles:
    """Where the files of one data set are, and the bytes of an id."""

    path: str
    width: int = 2

    @property
    def ids(self) -> str:
        return f"{self.path}/data/kind=ids"

    @property
    def sizes(self) -> str:
        return f"{self.path}/data/kind=sizes"

    @property
    def offsets(self) -> str:
        return f"{self.path}/offsets"

    @property
    def index(self) -> str:
        return f"{self.path}/index"


def _encode(vocabulary: str, bounds: list[int], width: int):
    """Every document's ids (without the end id, compressed) and its range of document ids."""
    upper = np.array(bounds, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, squeeze = encoder(vocabulary).ids, zstandard.ZstdCompressor(level=1).compress
        for some in slices(batches):
            ids = encode(strings(some.column("body"))).to_pylist()
            rows = []
            for one in ids:
                values = np.frombuffer(one, "<u4")
                if len(values) and values.max() >= 1 << (8 * width):
                    raise ValueError("an id does not fit the width of the token files")
                rows.append(squeeze(values.astype(f"<u{width}").tobytes()))
            doc_ids = some.column("doc_id").to_numpy(zero_copy_only=False)
            known = ~np.array(some.column("doc_id").is_null())
            part = np.zeros(len(rows), np.int32)
            part[known] = np.searchsorted(upper, doc_ids[known].astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(part),
                    some.column("doc_id"),
                    pa.array([len(one) // 4 + 1 for one in ids], pa.int64()),
                    pa.array([zlib.crc32(one) for one in ids], pa.int64()),
                    pa.array(rows, pa.binary()),
                ],
                names=["part", "doc_id", "n", "crc", "ids"],
            )

    return run


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For every document in order, the row of the ids' file and the row of the sizes' file."""
    expand, rank = zstandard.ZstdDecompressor().decompress, 0
    for batch in batches:
        parts, ids = batch.column("part").to_pylist(), [expand(x) for x in batch.column("ids").to_pylist()]
        sizes = [
            (0 if doc_id is None else doc_id).to_bytes(8, "little", signed=True)
            + bytes([doc_id is not None])
            + n.to_bytes(5, "little")
            for doc_id, n in zip(batch.column("doc_id").to_pylist(), batch.column("n").to_pylist(), strict=True)
        ]
        ranks = pa.array(range(rank, rank + len(ids)), pa.int64())
        rank += len(ids)
        for kind, rows in (("ids", ids), ("sizes", sizes)):
            yield pa.RecordBatch.from_arrays(
                [pa.array([kind] * len(rows)), pa.array(parts, pa.int32()), ranks, pa.array(rows, pa.binary())],
                names=["kind", "part", "rank", "value"],
            )


def _flat(rows: DataFrame, path: str, separator: bytes, *folders: str) -> None:
    """One binary column written as it is, every row followed by the separator."""
    rows = rows.select(*folders, F.col("value").cast("string"))
    rows.write.partitionBy(*folders).option("lineSep", separator.decode("latin-1")).text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    """The files below ``path`` with the numbers of their parts."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path)
    return files.withColumn("number", F.regexp_extract("path", "/part=([0-9]+)/", 1).cast("int"))


def _sizes(width: int):
    size = 14 + width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, content in zip(batch.column("number").to_pylist(), batch.column("content").to_pylist(), strict=True):
                raw = np.frombuffer(content, np.uint8).reshape(-1, size)
                doc_ids = np.ascontiguousarray(raw[:, :8]).view("<i8").ravel()
                n = np.zeros((len(raw), 8), np.uint8)
                n[:, :5] = raw[:, 9:14]
                n = n.view("<i8").ravel()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(raw), number, np.int32)),
                        pa.array(np.arange(len(raw))),
                        pa.array(doc_ids, pa.int64(), mask=raw[:, 8] == 0),
                        pa.array(n),
                        pa.array(np.cumsum(n) - n),
                    ],
                    names=["part", "at", "doc_id", "n", "place"],
                )

    return run


def _low_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        starts = batch.column("start").to_pylist()
        if starts and max(starts) >= 1 << 48:
            raise ValueError("offsets of 2**48 and more are not supported")
        rows = pa.array([start.to_bytes(8, "little")[:6] for start in starts], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("at"), rows], names=["part", "at", "value"])


def write(
    docs: DataFrame,
    path: str,
    vocabulary: str = "word_bpe_49k.json",
    end_id: int = 2,
    width: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> TokenFiles:
    """Encode every document, append ``end_id`` and write the files below ``path``.

    Documents stand in ascending id order (null ids first); rows that share an id are
    ordered by their number of ids and check sum, and repeated rows are all written. Null
    and empty texts are the end id alone. An empty table gives files without ids. The end
    id must be below 128, because it is written as the separator of Spark's text files.
    """
    if not 0 <= end_id < 128 or width not in (2, 4):
        raise ValueError("end_id must be below 128, width 2 or 4")
    files = TokenFiles(path, width)
    spark = docs.sparkSession
    rows = id_text(docs, id_col, text_col)
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # The upper ends of the ranges: at most one number a part comes to the driver.
    ranges = rows.select("doc_id").filter("doc_id IS NOT NULL").repartitionByRange(parts, "doc_id")
    upper = ranges.groupBy(F.spark_partition_id()).agg(F.max("doc_id").alias("upper")).select("upper")
    bounds = sorted(row["upper"] for row in upper.collect())[:-1]
    encoded = rows.mapInArrow(forgetting(_encode(vocabulary, bounds, width)), _ENCODED)
    ordered = encoded.repartition(parts, "part").sortWithinPartitions("part", "doc_id", "n", "crc")
    records = ordered.mapInArrow(_records, _RECORDS).sortWithinPartitions("kind", "part", "rank")
    _flat(records, f"{path}/data", end_id.to_bytes(width, "little"), "kind", "part")
    if not bounds and rows.isEmpty():
        settled = spark.createDataFrame([], "part int, at long, doc_id long, n long, start long")
    else:
        sizes = _files(spark, files.sizes).select("number", "content").mapInArrow(_sizes(width), _SIZES)
        sizes = settle(sizes, "sizes")
        settled = sizes.join(bases(sizes), "part").selectExpr("part", "at", "doc_id", "n", "base + place AS start")
    settled.write.parquet(files.index)
    index = spark.read.schema(settled.schema).parquet(files.index)
    offsets = index.select("part", "at", "start").mapInArrow(_low_bytes, "part int, at long, value binary")
    offsets = offsets.repartition(parts, "part").sortWithinPartitions("part", "at")
    _flat(offsets, files.offsets, bytes(2), "part")
    return files


def shards(spark: SparkSession, files: TokenFiles) -> DataFrame:
    """``number, file, base, ids`` of every file with ids, in the order of the data set.

    A shard's base is the sum of the ids of the shards before it. One row per file.
    """
    sizes = _files(spark, files.ids).select(
        "number", F.col("path").alias("file"), (F.col("length") / files.width).cast("long").alias("ids")
    )
    before = Window.orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    base = F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base")
    return sizes.filter("ids > 0").select("number", "file", base, "ids")


def mapped(uri: str, width: int) -> np.ndarray:
    """The ids of one file, memory-mapped where the storage is mounted, else read."""
    dtype = np.dtype(f"<u{width}")
    if uri.startswith("file:"):
        from urllib.parse import unquote, urlparse

        return np.memmap(unquote(urlparse(uri).path), dtype, "r")
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    with store.open_input_file(path) as source:
        return np.frombuffer(source.read_buffer(), dtype)


def read(spark: SparkSession, files: TokenFiles) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of every document, read back from the files.

    Each document is looked up at its 64-bit offset in the memory-mapped shard that holds
    it; ``ids`` are unsigned 32-bit integers. The tasks follow the index, which is in the
    order of the shards, so each maps one or a few of them. Only the shards' names and
    bases go through the driver: at most one row for each part.
    """
    index = spark.read.parquet(files.index).select("doc_id", "start", "n")
    if index.isEmpty():
        places: list[tuple[int, str]] = []
    else:
        places = [(row["base"], row["file"]) for row in shards(spark, files).orderBy("base").collect()]
    return index.mapInArrow(_slices(places, files.width), "doc_id long, start long, n_tokens long, ids binary")


def _slices(places: list[tuple[int, str]], width: int):
    starts = np.array([base for base, _ in places], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids = -1, np.empty(0)
        for batch in batches:
            start, n = (np.asarray(batch.column(c).to_numpy(zero_copy_only=False), np.int64) for c in ("start", "n"))
            shard = np.searchsorted(starts, start, "right") - 1
            out = []
            for k, first, size in zip(shard.tolist(), start.tolist(), n.tolist(), strict=True):
                if k != at:
                    at, ids = k, mapped(places[k][1], width)
                first -= places[k][0]
                piece = ids[first : first + size]
                if len(piece) != size:
                    raise ValueError(f"{places[k][1]} is shorter than its index says")
                out.append(piece.astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("start"), batch.column("n"), pa.array(out, pa.binary())],
                names=["doc_id", "start", "n_tokens", "ids"],
            )

    return run


def new_path(spark: SparkSession) -> str:
    return scratch_path(spark, "token-files")


def digest(rows: DataFrame) -> DataFrame:
    """``ids_crc32`` in place of the ids."""
    return rows.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
