"""Fill-in-the-middle by a wavelet matrix over character classes.

The UTF-8 bytes of a batch of texts are one sequence over four classes: continuation byte,
newline, other white space, any other first byte of a character. A wavelet matrix of two bit
levels answers rank queries (how many bytes of a class stand before a position). Ranks
combine into the number of units up to a position: a line ends after a newline, a character
starts at every byte that continues none, a word starts where a first byte follows white
space. A cut after the k-th unit is located by select, which bisects on ranks; all texts of a
batch descend together.

A text's units are cut in two places drawn from a hash of its id. The pieces are written in
the order prefix-suffix-middle or suffix-prefix-middle with marks in front, or the text stays
as it is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import id_text
from plumbline.llm.encode import slices

CONTINUATION, NEWLINE, BLANK, OTHER = range(4)
MARKS = ("<P>", "<S>", "<M>")
UNITS = ("line", "char")

_CLASS = np.full(256, OTHER, np.uint8)
_CLASS[0x80:0xC0] = CONTINUATION
_CLASS[[0x09, 0x0B, 0x0C, 0x0D, 0x20]] = BLANK
_CLASS[0x0A] = NEWLINE


class Bits:
    """A bit sequence with the number of ones before each 64-bit word."""

    def __init__(self, bits: np.ndarray) -> None:
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word, inside = at >> 6, (at & 63).astype(np.uint64)
        below = self.words[word] & ((np.uint64(1) << inside) - np.uint64(1))
        return self.before[word] + np.bitwise_count(below)


class WaveletMatrix:
    """Rank and select over a sequence of symbols below ``2 ** levels``.

    Level by level, from the highest bit, the symbols are parted into those with a zero and
    those with a one, each in their order.
    """

    def __init__(self, symbols: np.ndarray, levels: int = 2) -> None:
        self.size, self.levels = len(symbols), []
        for bit in range(levels - 1, -1, -1):
            ones = ((symbols >> bit) & 1).astype(np.uint8)
            self.levels.append((bit, Bits(ones), len(ones) - int(ones.sum())))
            symbols = np.concatenate((symbols[ones == 0], symbols[ones == 1]))

    def rank(self, symbol: int, at: np.ndarray) -> np.ndarray:
        """How many of ``symbol`` stand before each position."""
        first, last = np.zeros_like(at), at
        for bit, bits, zeros in self.levels:
            if symbol >> bit & 1:
                first, last = zeros + bits.rank(first), zeros + bits.rank(last)
            else:
                first, last = first - bits.rank(first), last - bits.rank(last)
        return last - first

    def select(self, symbol: int, number: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The least position in [low, high] before which ``number`` of ``symbol`` stand, by bisection."""
        return bisect(lambda at: self.rank(symbol, at), number, low, high)


def bisect(rank, number: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The least position in [low, high] whose rank (never falling) is ``number``; ``high`` if none is."""
    low, high = low.copy(), high.copy()
    while (low < high).any():
        middle = (low + high) >> 1
        enough = rank(middle) >= number
        high = np.where(enough, middle, high)
        low = np.where(enough | (low >= high), low, middle + 1)
    return high


@dataclass(frozen=True)
class Boundaries:
    """Boundary counts of the texts that lie end to end in ``data`` between ``starts`` and ``ends``."""

    tree: WaveletMatrix
    starts: np.ndarray
    ends: np.ndarray

    @classmethod
    def of(cls, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Boundaries:
        return cls(WaveletMatrix(_CLASS[data]), starts, ends)

    def chars(self, at: np.ndarray) -> np.ndarray:
        """Characters that start before each position: all bytes but continuations."""
        return at - self.tree.rank(CONTINUATION, at)

    def count(self, unit: str) -> np.ndarray:
        """Units of each text. What follows the last newline is a line if it is not empty."""
        if unit == "char":
            return self.chars(self.ends) - self.chars(self.starts)
        lines = self.tree.rank(NEWLINE, self.ends) - self.tree.rank(NEWLINE, self.starts)
        last = np.maximum(self.ends - 1, self.starts)
        ended = self.tree.rank(NEWLINE, self.ends) - self.tree.rank(NEWLINE, last)
        return lines + ((self.ends > self.starts) & (ended == 0))

    def after(self, unit: str, k: np.ndarray) -> np.ndarray:
        """The position after the first ``k`` units of each text."""
        if unit == "char":
            # The start of character k, or the end: one step past k - 1 starts and all that continues them.
            target = self.chars(self.starts) + k + 1
            found = bisect(self.chars, target, self.starts, self.ends)
            return np.where(self.chars(found) >= target, found - 1, self.ends)
        found = self.tree.select(NEWLINE, self.tree.rank(NEWLINE, self.starts) + k, self.starts, self.ends)
        return np.where(k == 0, self.starts, found)


def _draws(seed: int, ids: list[int | None]) -> np.ndarray:
    """Four unsigned 32-bit numbers of each id; rows with a null id draw as the text ``null``."""
    texts = (f"{seed}:{'null' if i is None else i}".encode() for i in ids)
    return np.frombuffer(b"".join(hashlib.sha256(t).digest()[:16] for t in texts), ">u4").reshape(-1, 4).astype(np.int64)


def _utf8(body: pa.Array) -> pa.Array:
    """The bytes themselves, or with replacement characters where they are no UTF-8."""
    try:
        body.cast(pa.string())
        return body
    except pa.ArrowInvalid:
        return pa.array([x.decode("utf-8", "replace").encode() for x in body.to_pylist()], pa.binary())


def _spans(body: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    offsets = np.frombuffer(body.buffers()[1], np.int32)[body.offset : body.offset + len(body) + 1].astype(np.int64)
    data = np.frombuffer(body.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets[:-1] - offsets[0], offsets[1:] - offsets[0]


_OUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def transform(
    docs: DataFrame,
    unit: str = "line",
    rate: int = 100,
    spm_rate: int = 50,
    seed: int = 7,
    marks: tuple[str, str, str] = MARKS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` of every row.

    ``n`` counts the text's units (lines with their newline, or characters). The four
    numbers h1 to h4 come from SHA-256 of ``seed:id``; the prefix ends after the smaller of
    ``h1 % (n + 1)`` and ``h2 % (n + 1)`` units, the middle after the larger. Texts that are
    null, empty or contain a mark, and those with ``h3 % 100 >= rate``, keep their form
    (``plain``, sizes null); null becomes empty. Others are ``spm`` if ``h4 % 100 <
    spm_rate``, else ``psm``. Repeated rows are each transformed, alike if their id is the same;
    rows with a null id draw alike. Very long texts need memory for one text. Other columns
    are not looked at. An empty table gives no rows. No row leaves its partition.
    """
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {UNITS}")
    p, s, m = (mark.encode() for mark in marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, body = batch.column("doc_id").to_pylist(), _utf8(batch.column("body"))
            data, starts, ends = _spans(body)
            edges = Boundaries.of(data, starts, ends)
            n, h = edges.count(unit), _draws(seed, ids)
            cuts = np.sort(h[:, :2] % (n + 1)[:, None], axis=1)
            low, high = edges.after(unit, cuts[:, 0]), edges.after(unit, cuts[:, 1])
            chars = [edges.chars(at) for at in (starts, low, high)]
            spm = h[:, 3] % 100 < spm_rate
            texts = body.to_pylist()
            plain = np.array([not t or p in t or s in t or m in t for t in texts], bool) | (h[:, 2] % 100 >= rate)
            out = []
            for t, a, b, is_plain, is_spm in zip(
                texts, (low - starts).tolist(), (high - starts).tolist(), plain.tolist(), spm.tolist(), strict=True
            ):
                if is_plain:
                    out.append(t)
                elif is_spm:
                    out.append(b"".join((s, t[b:], p, t[:a], m, t[a:b])))
                else:
                    out.append(b"".join((p, t[:a], s, t[b:], m, t[a:b])))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(n),
                    pa.array(np.where(plain, "plain", np.where(spm, "spm", "psm")).tolist(), pa.string()),
                    pa.array(chars[1] - chars[0], mask=plain),
                    pa.array(chars[2] - chars[1], mask=plain),
                    pa.array(out, pa.binary()).cast(pa.string()),
                ],
                names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    return id_text(docs, id_col, text_col).mapInArrow(run, _OUT)


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text, rebuilt from a transformed text and its form alone.

    The marks occur once each, as texts that contain one are left plain; they must begin
    with a character that does not occur in them again.
    """
    p, s, m = (F.lit(mark) for mark in marks)
    middle = F.split_part(output, m, F.lit(2))
    front = F.split_part(output, m, F.lit(1))
    psm = F.concat(
        F.split_part(F.split_part(front, s, F.lit(1)), p, F.lit(2)), middle, F.split_part(front, s, F.lit(2))
    )
    spm = F.concat(
        F.split_part(front, p, F.lit(2)), middle, F.split_part(F.split_part(front, p, F.lit(1)), s, F.lit(2))
    )
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digest(rows: DataFrame) -> DataFrame:
    """SHA-256 of the output and of the text rebuilt from it, in place of the output."""
    back = restored(F.col("output"), F.col("form"))
    return rows.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(back.cast("binary"), 256).alias("restored_sha256"),
    )
