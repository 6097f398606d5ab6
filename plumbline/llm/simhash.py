"""SimHash near-duplicates found through a table of distances to reference fingerprints.

A fingerprint has 64 bits. The reference fingerprints are zero and, for each of the four
16-bit blocks, ten fingerprints that are zero outside the block. The distance to such a
reference less the distance to zero depends on the block alone, so the ten differences
of a block are equal for two fingerprints that agree there. Two fingerprints with two or
fewer differing bits agree in at least two of the four blocks: they meet in one of six
cells keyed by the differences of two blocks. Inside a cell a pair is discarded when any
coordinate of the distance table differs by more than the allowed bits (the triangle
inequality), and survivors are verified bit by bit.

A cell with more members than ``cell_limit`` is not paired. There every member names the
fingerprints one bit away in the blocks that may differ: two members are two or fewer
bits apart exactly if they name a common fingerprint, so a star through that fingerprint
gives the same components with 33 rows a member.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import hex16, id_text, rows_of
from plumbline.llm.components import components
from plumbline.session import collect_garbage, discard, settle, settle_bucketed

SEED = 42
BLOCKS, BLOCK_BITS, PER_BLOCK = 4, 16, 10
MAX_BITS = 2
PAIRS = list(combinations(range(BLOCKS), 2))
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_SLOT = (np.arange(8, dtype=np.int64) * 256)[None, :]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def block_references(block: int) -> list[int]:
    """Ten masks of eight bits in a block, from a linear congruential sequence."""
    masks: list[int] = []
    state = 1 + block
    while len(masks) < PER_BLOCK:
        state = (state * 6364136223846793005 + 1442695040888963407) % (1 << 64)
        mask = (state >> 40) & 0xFFFF
        if mask.bit_count() == BLOCK_BITS // 2 and mask not in masks:
            masks.append(mask)
    return [mask << (BLOCK_BITS * block) for mask in masks]


REFERENCES = [block_references(block) for block in range(BLOCKS)]


def shingle_hashes(body: bytes, words: int) -> np.ndarray:
    """XXH64 (seed 42) of every word shingle of a text, repeats included.

    Only A-Z are lower-cased and only ASCII white space separates words. A text with
    fewer words is one shingle; a text without words has none.
    """
    found = body.lower().split()
    if not found:
        return np.empty(0, np.uint64)
    if len(found) < words:
        shingles = [b" ".join(found)]
    else:
        shingles = map(b" ".join, zip(*(found[i:] for i in range(words)), strict=False))
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64)


def simhash(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes, as a signed long."""
    if not len(hashes):
        return 0
    counts = np.zeros(2048, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        octets = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        counts += np.bincount((octets + _SLOT).ravel(), minlength=2048)
    ones = (counts.reshape(8, 256) @ _BYTE_BITS).ravel()
    set_bits = np.packbits(ones * 2 > len(hashes), bitorder="little")
    return int(set_bits.view(np.int64)[0])


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp`` for every row; ``fp`` is the 64-bit fingerprint as a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [simhash(shingle_hashes(body.as_py(), words)) for body in batch.column("body")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(values, pa.int64())], names=["doc_id", "fp"]
            )

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


def distance_table(fps: DataFrame) -> DataFrame:
    """``fp``, its distances ``d`` to all references, and the six ``cells`` it lies in."""
    masks = [0, *(mask for block in REFERENCES for mask in block)]
    distances = ", ".join(f"CAST(bit_count(fp ^ {_signed(mask)}L) AS TINYINT)" for mask in masks)
    differences = [
        ", ".join(f"d[{1 + block * PER_BLOCK + i}] - d[0]" for i in range(PER_BLOCK)) for block in range(BLOCKS)
    ]
    cells = ", ".join(f"xxhash64({i}, {differences[p]}, {differences[q]})" for i, (p, q) in enumerate(PAIRS))
    return fps.selectExpr("fp", f"array({distances}) AS d").selectExpr("fp", "d", f"array({cells}) AS cells")


def _flips() -> str:
    """For each pair of blocks, zero and the single bits of the two other blocks."""
    rows = []
    for pair in PAIRS:
        free = [1 << i for i in range(64) if i // BLOCK_BITS not in pair]
        rows.append("array(" + ", ".join(f"{_signed(bit)}L" for bit in (0, *free)) + ")")
    return f"array({', '.join(rows)})"


def links(fps: DataFrame, cell_limit: int = 256) -> DataFrame:
    """Edges ``a, b`` whose components are those of all pairs at most two bits apart.

    ``fps`` has one row for each different ``fp``. In cells up to ``cell_limit`` members the
    edges are the verified pairs; in larger cells they go through common neighbours, which
    may be fingerprints that no document has.
    """
    table = settle(distance_table(fps), "distances")
    members = table.select("fp", "d", F.posexplode("cells").alias("pair", "cell"))
    sizes = members.groupBy("pair", "cell").agg(F.count("*").alias("size")).filter("size > 1")
    sizes = settle(sizes, "cells")
    small = members.join(sizes.filter(F.col("size") <= cell_limit), ["pair", "cell"])
    left = small.select("pair", "cell", F.col("fp").alias("a"), F.col("d").alias("da"))
    right = small.select("pair", "cell", F.col("fp").alias("b"), F.col("d").alias("db"))
    apart = F.array_max(F.zip_with("da", "db", lambda x, y: F.abs(x - y)))
    pairs = left.join(
        right,
        (left["pair"] == right["pair"])
        & (left["cell"] == right["cell"])
        & (F.col("a") < F.col("b"))
        & (apart <= MAX_BITS)
        & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS),
    ).select("a", "b")
    large = members.join(sizes.filter(F.col("size") > cell_limit), ["pair", "cell"]).select("pair", "cell", "fp")
    stars = (
        large.withColumn("flip", F.explode(F.expr(f"{_flips()}[pair]")))
        .select("pair", "cell", "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("middle"))
        .groupBy("pair", "cell", "middle")
        .agg(F.min("fp").alias("a"), F.collect_set("fp").alias("all"))
        .filter(F.size("all") > 1)
        .select("a", F.explode("all").alias("b"))
        .filter("a <> b")
    )
    return pairs.unionByName(stars)


def near_duplicates(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs``.

    Rows whose fingerprints differ in at most two bits are linked; ``component_id`` is the
    smallest id reachable over links. Equal fingerprints (copies, and all texts without a
    word, whose fingerprint is zero) are one node, so copies are never paired. Null texts
    are empty texts; rows with a null id are linked but cannot name a component, which is
    null if it has no other row. Repeated rows stay. An empty table gives no rows.
    """
    marked = settle(fingerprints(docs, words, id_col, text_col), "fingerprints")
    different = settle(marked.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "different")
    roots = components(links(different), "fingerprint-stars")
    named = different.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp")
    )
    named = settle(named, "rooted")
    least = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    classes = named.join(least, "root").select("fp", "component_id")
    return marked.join(classes, "fp").select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")


# Near copies at a similarity --------------------------------------------------------------

SAMPLES, SAMPLE = 16, 4
WIDE = 24
CLASSES, SLICES = 1 << 18, 64
_CLASS_SHIFT = np.uint64(64 - CLASSES.bit_length() + 1)
FLUSH = 1 << 20
TILE = 512
_MULTIPLIERS = [(0x9E3779B97F4A7C15 * (2 * i + 1)) % (1 << 64) | 1 for i in range(SAMPLES)]
_SKETCH = "doc_id long, key long, node long, fp long, samples array<long>, n int, bits binary"


def _sample_fingerprints(hashes: np.ndarray) -> list[int]:
    """SimHash fingerprints of samples of a set of shingles: its lowest hashes under each multiplier."""
    out = []
    for multiplier in _MULTIPLIERS:
        with np.errstate(over="ignore"):
            mixed = hashes * np.uint64(multiplier)
            mixed ^= mixed >> np.uint64(29)
            mixed *= np.uint64(0xBF58476D1CE4E5B9)
        lowest = np.argpartition(mixed, SAMPLE - 1)[:SAMPLE] if len(hashes) > SAMPLE else slice(None)
        out.append(simhash(np.sort(hashes[lowest])))
    return out


def _odd_bits(hashes: np.ndarray) -> bytes:
    """Which of a power of two of bits, two to four for each hash, an odd number of the set's hashes falls on.

    Two sets differ in at least as many hashes as the bits of their exclusive or. The upper half
    of the bits folds onto the lower one by exclusive or, so any two lengths can be compared.
    """
    size = max(64, 1 << (2 * len(hashes) - 1).bit_length()) if len(hashes) else 64
    counts = np.bincount((hashes & np.uint64(size - 1)).astype(np.int64), minlength=size)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


def _sketches(rows: DataFrame, words: int) -> DataFrame:
    """For every row, its set of shingles as ``node``, the set's fingerprint, its samples' fingerprints, size and odd bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(shingle_hashes(body.as_py(), words)) for body in batch.column("body")]
            nodes = [xxhash.xxh64_intdigest(s.tobytes(), SEED) - (1 << 63) for s in found]
            columns = [
                batch.column("doc_id"),
                batch.column("key"),
                pa.array(nodes, pa.int64()),
                pa.array([simhash(s) for s in found], pa.int64()),
                pa.array([_sample_fingerprints(s) if len(s) else [] for s in found], pa.list_(pa.int64())),
                pa.array([len(s) for s in found], pa.int32()),
                pa.array([_odd_bits(s) for s in found], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "key", "node", "fp", "samples", "n", "bits"])

    return rows.mapInArrow(run, _SKETCH)


def _sets(rows: DataFrame, words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(shingle_hashes(body.as_py(), words)).tobytes() for body in batch.column("body")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), pa.array(found, pa.binary())], names=["node", "shingles"]
            )

    return rows.mapInArrow(run, "node long, shingles binary")


def _similar(similarity: float):
    """The pairs whose whole sets of shingles reach the Jaccard similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for left, right in zip(batch.column("left").to_pylist(), batch.column("right").to_pylist(), strict=True):
                x, y = np.frombuffer(left, np.uint64), np.frombuffer(right, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _close(similarity: float):
    """The pairs whose sizes and odd bits allow the Jaccard similarity; none that reaches it is lost."""
    share = (1 - similarity) / (1 + similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for n, m, left, right in rows_of([batch], "n", "hub_n", "bits", "hub_bits"):
                x, y = np.frombuffer(left, np.uint64), np.frombuffer(right, np.uint64)
                while len(x) != len(y):
                    x, y = (x, y) if len(x) > len(y) else (y, x)
                    x = x[: len(x) // 2] ^ x[len(x) // 2 :]
                apart = int(np.bitwise_count(x ^ y).sum())
                keep.append(min(n, m) >= similarity * max(n, m) - 1e-6 and apart <= share * (n + m) + 1e-6)
            yield batch.select(["node", "hub", "times"]).filter(pa.array(keep, pa.bool_()))

    return run


def _possible(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """The pairs ``node, hub, times`` that can reach the similarity, by a few bits for each shingle instead of the sets."""
    own = nodes.select("node", "n", "bits")
    hubs = nodes.select(F.col("node").alias("hub"), F.col("n").alias("hub_n"), F.col("bits").alias("hub_bits"))
    joined = pairs.join(own, "node").join(hubs, "hub").select("node", "hub", "times", "n", "hub_n", "bits", "hub_bits")
    return joined.mapInArrow(_close(similarity), "node long, hub long, times long")


def _verified(pairs: DataFrame, rows: DataFrame, places: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs ``a, b`` of nodes that reach the similarity; sets are read again only for nodes in pairs."""
    wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = settle(places.join(wanted, "node"), "wanted")
    same = rows["doc_id"].eqNullSafe(wanted["doc_id"]) & (rows["key"] == wanted["key"])
    bodies = rows.join(wanted, same).select("node", "body").dropDuplicates(["node"])
    sets = settle(_sets(bodies, words), "shingle-sets")
    joined = (
        pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("left")), "a")
        .join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("right")), "b")
        .select("a", "b", "left", "right")
    )
    similar = settle(joined.mapInArrow(_similar(similarity), "a long, b long"), "similar")
    discard(wanted, sets)
    return similar


def _joining(
    pairs: DataFrame, edges: DataFrame | None, rows: DataFrame, nodes: DataFrame, words: int, similarity: float
) -> DataFrame:
    """``edges`` and those of the pairs ``node, hub, times`` that reach the similarity.

    Sets are read for pairs alone whose odd bits allow it. Of these, each node is verified with its
    most frequent partner first; of the others, those that the edges found so far do not put into one class.
    """
    places = nodes.select("node", "place.*")
    pairs = settle(_possible(pairs, nodes, similarity), "possible")
    ordered = (F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"))
    first = pairs.groupBy("node").agg(F.max_by("hub", F.struct("times", "hub")).alias("hub"))
    first = settle(first.select(*ordered).distinct(), "pairs")
    found = _verified(first, rows, places, words, similarity)
    edges = found if edges is None else edges.unionByName(found)
    roots = settle(components(edges, "similar-stars"), "roots")
    rest = pairs.select(*ordered).distinct().join(first, ["a", "b"], "left_anti")
    rest = rest.join(roots.selectExpr("node AS a", "root AS ra"), "a", "left").join(
        roots.selectExpr("node AS b", "root AS rb"), "b", "left"
    )
    rest = settle(rest.filter("coalesce(ra, a) <> coalesce(rb, b)").select("a", "b"), "pairs")
    edges = edges.unionByName(_verified(rest, rows, places, words, similarity))
    discard(pairs, first, roots, rest)
    return edges


def _fingerprint_pairs(nodes: DataFrame) -> DataFrame:
    """``node, hub, times``: every node with the least node of each fingerprint at most two bits from its own.

    The links are those of ``near_duplicates``: cells of the table of distances, coordinate discard,
    verification by bits. They count more than any number of shared samples.
    """
    hubs = settle(nodes.groupBy("fp").agg(F.min("node").alias("hub")), "fingerprint-hubs")
    edges = settle(links(hubs.select("fp")), "fingerprint-links")
    near = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = near.selectExpr("a AS fp", "b AS other").unionByName(hubs.selectExpr("fp", "fp AS other")).distinct()
    hub_of = hubs.select(F.col("fp").alias("other"), "hub")
    pairs = nodes.select("node", "fp").join(near, "fp").join(hub_of, "other").filter("node <> hub")
    return pairs.select("node", "hub", F.lit(SAMPLES + 1).cast("long").alias("times"))


def _sample_pairs(nodes: DataFrame) -> DataFrame:
    """``node, hub, times``: every node with the two ends of its groups of one sample fingerprint."""
    spread = nodes.select("node", F.posexplode("samples").alias("sample", "value"))
    ends = spread.groupBy("sample", "value").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high")
    tied = spread.join(ends, ["sample", "value"]).select("node", F.explode(F.array("low", "high")).alias("hub"))
    pairs = tied.filter("node <> hub").groupBy("node", "hub").agg(F.count("*").alias("times"))
    table = distance_table(nodes.select("fp").distinct()).select("fp", "d")
    near = nodes.select("node", "fp").join(table, "fp").select("node", "d")
    apart = F.array_max(F.zip_with("d", "hub_d", lambda x, y: F.abs(x - y)))
    pairs = pairs.join(near, "node").join(near.select(F.col("node").alias("hub"), F.col("d").alias("hub_d")), "hub")
    return settle(pairs.filter(apart <= WIDE).select("node", "hub", "times"), "partners")


def _ranks(rows: DataFrame, words: int) -> np.ndarray:
    """For each class of shingle hashes, four times the binary logarithm of its occurrences."""
    width = CLASSES // SLICES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(CLASSES, np.int64)
        waiting, size = [], 0
        for batch in batches:
            for body in batch.column("body"):
                waiting.append(np.unique(shingle_hashes(body.as_py(), words)) >> _CLASS_SHIFT)
                size += len(waiting[-1])
                if size > FLUSH:
                    counts += np.bincount(np.concatenate(waiting).astype(np.int64), minlength=CLASSES)
                    waiting, size = [], 0
        if waiting:
            counts += np.bincount(np.concatenate(waiting).astype(np.int64), minlength=CLASSES)
        parts = [part.tobytes() for part in counts.reshape(SLICES, width)]
        yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array(parts, pa.binary())], names=["slice", "counts"])

    def total(part: pa.Table) -> pa.Table:
        counts = np.zeros(width, np.int64)
        for one in part.column("counts"):
            counts += np.frombuffer(one.as_py(), np.int64)
        ranks = np.minimum(127, np.floor(4 * np.log2(counts + 1))).astype(np.uint8)
        return pa.table({"slice": part.column("slice").slice(0, 1), "ranks": pa.array([ranks.tobytes()], pa.binary())})

    counted = rows.select("body").mapInArrow(count, "slice int, counts binary")
    ranks = np.zeros((SLICES, width), np.uint8)
    for number, found in counted.groupBy("slice").applyInArrow(total, "slice int, ranks binary").collect():
        ranks[number] = np.frombuffer(found, np.uint8)
    return ranks.ravel()


def _least(share: float, n: int) -> int:
    """The least whole number that is not below ``share * n``; rounding never makes it larger."""
    return math.ceil(share * n - 1e-6)


def _prefixes(rows: DataFrame, ranks: np.ndarray, words: int, similarity: float) -> DataFrame:
    """``word, node, n, at, indexed``: the rarest shingles of every set of ``n``, and their places from 0.

    A set that reaches the similarity with one of its size or smaller shares one of its
    first ``n - similarity * n + 1`` shingles with it, among those that the other one has
    ``indexed``, which are fewer.
    """
    both = 2 * similarity / (1 + similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def rows_held() -> pa.RecordBatch:
            lengths = [len(found) for _, _, found, _ in held]
            at = np.concatenate([np.arange(k, dtype=np.int32) for k in lengths])
            indexed = at < np.repeat(np.array([k for *_, k in held]), lengths)
            columns = [
                pa.array(np.concatenate([found for _, _, found, _ in held]).view(np.int64)),
                pa.array(np.repeat(np.array([node for node, *_ in held], np.int64), lengths)),
                pa.array(np.repeat(np.array([n for _, n, *_ in held], np.int32), lengths)),
                pa.array(at),
                pa.array(indexed),
            ]
            return pa.RecordBatch.from_arrays(columns, names=["word", "node", "n", "at", "indexed"])

        for batch in batches:
            for body in batch.column("body"):
                found = np.unique(shingle_hashes(body.as_py(), words))
                if not (n := len(found)):
                    continue
                node = xxhash.xxh64_intdigest(found.tobytes(), SEED) - (1 << 63)
                order = np.lexsort((found, ranks[found >> _CLASS_SHIFT]))
                held.append((node, n, found[order[: n - _least(similarity, n) + 1]], n - _least(both, n) + 1))
                size += len(held[-1][2])
                if size > FLUSH // 4:
                    yield rows_held()
                    held, size = [], 0
        if held:
            yield rows_held()

    return rows.select("body").mapInArrow(run, "word long, node long, n int, at int, indexed boolean")


def _prefix_pairs(index: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """``node, hub, times``: all pairs of nodes of different classes that can reach the similarity.

    A group of one shingle is left out when its nodes are of one class already. Large groups
    are paired in tiles of ``TILE`` nodes. Each table is deleted when the next one is written.
    """
    groups = index.groupBy("word").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.max("indexed").alias("some"))
    shared = index.join(groups.filter("low < high AND some").select("word"), "word").distinct()
    shared = settle(shared, "shared-shingles", compression="zstd")
    named = shared.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = settle(named, "shared-shingles", compression="zstd")
    discard(shared)
    mixed = named.groupBy("word").agg(F.count("*").alias("size"), F.min("root").alias("low"), F.max("root").alias("high"))
    mixed = mixed.filter("low < high").selectExpr("word", f"cast((size + {TILE - 1}) div {TILE} as int) AS tiles")
    mixed = settle(named.join(mixed, "word"), "mixed-groups", compression="zstd")
    discard(named)
    a = mixed.selectExpr(
        "word", "cast(pmod(xxhash64(node), tiles) as int) AS tile", "node AS a", "root AS a_root", "n AS a_n", "at AS a_at"
    )
    b = mixed.filter("indexed").selectExpr(
        "word", "explode(sequence(0, tiles - 1)) AS tile", "node AS b", "root AS b_root", "n AS b_n", "at AS b_at"
    )
    need = f"(a_n + b_n) * {similarity / (1 + similarity)}D - 1e-6D"
    pairs = a.join(b, ["word", "tile"]).filter(
        "a_root <> b_root AND (a_n > b_n OR (a_n = b_n AND a < b)) "
        f"AND b_n >= a_n * {similarity}D - 1e-6D "
        f"AND least(a_at, b_at) + least(a_n - a_at, b_n - b_at) >= {need}"
    )
    # If any prefix shingle is common to both sets, so is their first common one: nothing before it counts.
    pairs = pairs.groupBy("a", "b", "a_n", "b_n").agg(
        F.min("a_at").alias("a_at"), F.min("b_at").alias("b_at"), F.count("*").alias("times")
    )
    pairs = pairs.filter(f"least(a_n - a_at, b_n - b_at) >= {need}")
    pairs = settle(pairs.selectExpr("a AS node", "b AS hub", "times"), "partners", compression="zstd")
    discard(mixed)
    return pairs


def similar_classes(
    docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, key, class_id, first``: classes of rows whose shingle sets are similar.

    The first candidates are the links of ``near_duplicates`` between the fingerprints of the
    sets: pairs at most two bits apart, found through the table of distances. Fingerprints are
    far apart in many bits long before the Jaccard similarity of their sets falls below 0.8, so
    those of samples add to them: the four lowest shingles under each of sixteen hashes. In a
    group with one sample fingerprint every set is held against the group's least and greatest
    set, and the distance table of the whole fingerprints discards pairs that differ by more than
    ``WIDE`` bits in any coordinate. That joins most of a large class at little cost, but not
    all of it. An exact prefix filter on the shingles, rarest first, then names all pairs of
    different classes that can reach the similarity, so the classes are those of all pairs.
    Pairs are verified on their whole sets, first each set with its most frequent partner,
    then what still joins different classes.

    Equal sets are one node and are never paired. ``class_id`` is the smallest document id of
    the class and ``first`` marks the one row of the class that stays: the one with the
    smallest id, then the least key (the hash of the text). Of rows equal in both, all are
    marked. Rows without a word are one class; null texts are empty, and a null id comes
    first.
    """
    rows = id_text(docs, id_col, text_col).select("doc_id", F.xxhash64("body").alias("key"), "body")
    marked = settle(_sketches(rows, words), "sketches")
    nodes = marked.groupBy("node").agg(
        F.min(F.struct("doc_id", "key")).alias("place"), *(F.first(c).alias(c) for c in ("fp", "samples", "n", "bits"))
    )
    nodes = settle(nodes, "nodes")
    places = nodes.select("node", "place.*")
    likely = _fingerprint_pairs(nodes).unionByName(_sample_pairs(nodes))
    likely = settle(likely.groupBy("node", "hub").agg(F.sum("times").alias("times")), "likely")
    edges = _joining(likely, None, rows, nodes, words, similarity)
    discard(likely)
    index = _prefixes(rows, _ranks(rows, words), words, similarity)
    # A bucket is written by one task: else there were as many files as buckets times tasks.
    buckets = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    index = settle_bucketed(index.repartition(buckets, "word"), "shingle-prefixes", "word", compression="zstd")
    collect_garbage(docs.sparkSession)
    roots = settle(components(edges, "similar-stars"), "roots")
    pairs = _prefix_pairs(index, roots, similarity)
    discard(index)
    if not pairs.isEmpty():
        edges = _joining(pairs, edges, rows, nodes, words, similarity)
        roots = components(edges, "similar-stars")
    named = settle(places.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
    classes = named.groupBy("root").agg(F.min(F.struct("doc_id", "key")).alias("least"), F.min("doc_id").alias("class_id"))
    of_node = named.select("node", "root").join(classes, "root").select("node", "class_id", "least")
    # A node's place is its least row, so the class's least place is the row that stays.
    return marked.select("doc_id", "key", "node").join(of_node, "node").select(
        "doc_id",
        "key",
        "class_id",
        (F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("key") == F.col("least.key"))).alias("first"),
    )


def one_of_each(
    docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The rows of ``docs`` that stay when of each class of near copies one row is kept.

    Rows with equal id and text are one row here, and one of them stays.
    """
    classes = settle(similar_classes(docs, words, similarity, id_col, text_col), "classes")
    gone = classes.filter("NOT first").select("doc_id", "key").distinct()
    body = F.coalesce(docs[text_col].cast("string"), F.lit("")).cast("binary")
    same = docs[id_col].cast("long").eqNullSafe(gone["doc_id"]) & (F.xxhash64(body) == gone["key"])
    kept = docs.join(gone, same, "left_anti")
    repeated = classes.filter("first").groupBy("doc_id", "key").count().filter("count > 1")
    if repeated.isEmpty():
        return kept
    whole = f"_{max(docs.columns, key=len)}"  # no column has this name; a null text is an empty one
    return kept.withColumn(whole, F.coalesce(kept[text_col].cast("string"), F.lit(""))).dropDuplicates([id_col, whole]).drop(whole)
