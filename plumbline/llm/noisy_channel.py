"""Toxicity of disguised text: noisy-channel restoration, then a learned score.

A writer's letters pass a channel that replaces them by look-alikes (leetspeak), puts
spaces or signs between them, and repeats them. For a token that shows such signs, every
character opens a lattice of letters it may stand for, and a Viterbi search finds the most
likely letters under a character trigram model of all documents times the channel's costs.

The score is learned from labelled documents. Evidence of a word is the lower confidence
bound of the share of toxic documents among the labelled documents that hold the word, or
one of its beginnings (inflected words share a stem); a word takes the strongest. A logistic
model weighs a text's strongest words and their number. At most ``FIT_ROWS`` labelled rows,
those with the lowest hash of the id, are used, so the lexicon is bounded and travels with
the tasks. Near copies among them count once, and a row's own label is left out of its
evidence while the weights are fitted. The character model counts every document.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import id_text, tidy
from plumbline.llm.encode import slices

FIT_ROWS = 200_000
FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.3
LEAST_TOXIC = 4
BEGINNINGS = (3, 4, 5, 6)
CONFIDENCE = 2.0
MEMO = 400_000
COUNT_BYTES = 1 << 18

# The character model's symbols: 0 is a boundary, then a-z, then the letters from U+00E0 to
# U+00FF, then any other letter.
LETTERS = "".join(map(chr, [*range(ord("a"), ord("z") + 1), *range(0xE0, 0x100)]))
SYMBOLS = len(LETTERS) + 2
OTHER = SYMBOLS - 1
_NUMBER = {c: i + 1 for i, c in enumerate(LETTERS)}

# Fixed values of the channel: what a character may stand for besides itself.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "*": "aeiou", "#": "h", "¡": "i", "€": "e", "£": "l",
}
# Costs in log10 units: a look-alike, a character between letters, a repetition, a missing letter.
SUBSTITUTE, BETWEEN, REPEAT, BOUNDARY = 0.6, 0.3, 0.3, 0.5

_EDGES = ".,;:?!\"'()[]{}<>|%&*#~^_-+=/\\…«»“”‘’"
_DISGUISED = re.compile(r"[^\W\d_][\W\d_]+[^\W\d_]|\d[^\W\d_]|[^\W\d_][\d@$]|[@$][^\W\d_]|([^\W\d_])\1\1")
_LETTER = re.compile(r"[^\W\d_]")
_SPACED = re.compile(r"(?<!\S)(?:[^\s][ .\-_*]+){2,}[^\s](?!\S)")


def symbols(text: str) -> np.ndarray:
    """A lower-cased text as numbers of the character model's symbols."""
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    return _TABLE[np.minimum(codes, len(_TABLE) - 1)]


def _table() -> np.ndarray:
    table = np.zeros(0x3000, np.int64)
    for code in range(len(table)):
        c = chr(code)
        table[code] = _NUMBER.get(c, OTHER if c.isalpha() else 0)
    table[-1] = OTHER
    return table


_TABLE = _table()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SYMBOLS**3, np.int64)
    for some in slices(batches, COUNT_BYTES):
        texts = [f" {body.decode('utf-8', 'replace').lower()} " for body in some.column("body").to_pylist()]
        s = symbols("".join(texts))
        grams = (s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:]
        ends = np.cumsum([len(text) for text in texts])[:-1]
        total += np.bincount(np.delete(grams, np.concatenate((ends - 2, ends - 1))), minlength=SYMBOLS**3)
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["gram", "n"])


class CharacterModel:
    """Interpolated trigrams: ``cost[(u, v, w)]`` is minus log10 of w after u, v."""

    def __init__(self, counts: np.ndarray) -> None:
        three = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(np.float64)
        two, one = three.sum(axis=0), three.sum(axis=(0, 1))
        p1 = (one + 1) / (one.sum() + SYMBOLS)
        p2 = (two + 5 * p1) / (two.sum(axis=1, keepdims=True) + 5)
        p3 = (three + 5 * p2) / (three.sum(axis=2, keepdims=True) + 5)
        self.cost = (-np.log10(p3)).ravel().tolist()

    @classmethod
    def of(cls, rows: DataFrame) -> CharacterModel:
        """Counted over all ``rows (doc_id, body)``; at most ``SYMBOLS ** 3`` sums come back."""
        counts = np.zeros(SYMBOLS**3, np.int64)
        grams = rows.mapInArrow(tidy(_count), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
        for gram, n in grams.collect():
            counts[gram] = n
        return cls(counts)


def restore(token: str, model: CharacterModel, spaced: bool = False) -> str:
    """The most likely letters behind a token (``spaced``: words may end inside it).

    States are the last two symbols; a step reads one character of the token and emits a
    letter, or nothing where the character stands between letters or repeats one.
    """
    cost = model.cost
    states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    for c in token:
        own = _NUMBER.get(c) or (OTHER if c.isalpha() else 0)
        options = [(own, c, 0.0)] if own else []
        options += [(_NUMBER[x], x, SUBSTITUTE) for x in LOOKALIKES.get(c, "")]
        step: dict[tuple[int, int], tuple[float, tuple | None]] = {}

        def offer(state, value, path, step=step):
            if state not in step or value < step[state][0]:
                step[state] = (value, path)

        for (u, v), (value, path) in states.items():
            for number, letter, price in options:
                offer((v, number), value + price + cost[(u * SYMBOLS + v) * SYMBOLS + number], (letter, path))
                if spaced and v:
                    ends = cost[(u * SYMBOLS + v) * SYMBOLS] + BOUNDARY
                    offer((0, number), value + price + ends + cost[v * SYMBOLS * SYMBOLS + number], (letter, (" ", path)))
            if not own:
                offer((u, v), value + BETWEEN, path)
            elif own == v:
                offer((u, v), value + REPEAT, path)
        states = dict(sorted(step.items(), key=lambda x: x[1][0])[:24])
    if not states:
        return token
    last = min(states.items(), key=lambda x: x[1][0] + cost[(x[0][0] * SYMBOLS + x[0][1]) * SYMBOLS])
    letters, path = [], last[1][1]
    while path is not None:
        letters.append(path[0])
        path = path[1]
    return "".join(reversed(letters))


class Restorer:
    """The words of texts, restored where they look disguised; remembers tokens within a worker."""

    def __init__(self, model: CharacterModel) -> None:
        self.model = model
        self.memo: dict[str, str] = {}

    def word(self, token: str) -> str:
        found = self.memo.get(token)
        if found is None:
            if len(self.memo) > MEMO:
                self.memo = {}
            bare = token.strip(_EDGES)
            if len(bare) > 2 and bare[-1] == bare[-2] and bare[-1] in "$@":
                bare = bare.rstrip("$@" + _EDGES)
            found = bare
            if _DISGUISED.search(bare):
                found = restore(bare, self.model)
            self.memo[token] = found
        return found

    def words(self, text: str) -> set[str]:
        """The different words of a text: tokens as restored, and runs of single letters joined."""
        text = text.lower()
        words = {self.word(token) for token in set(text.split())}
        for run in _SPACED.finditer(text):
            words.update(restore(run.group().replace(" ", ""), self.model, spaced=True).split(" "))
        words.discard("")
        return words


def features(word: str) -> list[str]:
    """A word, and its beginnings marked as such."""
    return [word, *(word[:n] + "*" for n in BEGINNINGS if n <= len(word))]


def evidence(toxic, clean, base: float):
    """Log odds over the base rate of the lower bound of the share of toxic documents."""
    n = np.maximum(toxic + clean, 1e-9)
    p, z2 = toxic / n, CONFIDENCE**2
    low = (p + z2 / (2 * n) - CONFIDENCE * np.sqrt(p * (1 - p) / n + z2 / (4 * n * n))) / (1 + z2 / n)
    low = np.clip(low, 1e-6, 1 - 1e-6)
    return np.log(low / (1 - low)) - math.log(base / (1 - base))


@dataclass
class Model:
    """Everything a task needs to score texts."""

    characters: CharacterModel
    prior: float
    lexicon: dict[str, tuple[int, int]] = field(default_factory=dict)
    weights: np.ndarray | None = None

    def texts(self) -> Scorer:
        return Scorer(self)


class Scorer:
    """Scores texts within one task."""

    def __init__(self, model: Model) -> None:
        self.model, self.restorer = model, Restorer(model.characters)
        self.strength: dict[tuple[str, int], float] = {}
        self.known: dict[tuple[int, int], float] = {}

    def _evidence(self, toxic: int, clean: int) -> float:
        if (toxic, clean) not in self.known:
            self.known[toxic, clean] = float(evidence(float(toxic), float(clean), self.model.prior))
        return self.known[toxic, clean]

    def _of(self, word: str, label: int) -> float:
        """A word's strongest evidence; ``label`` 0 or 1 takes this document's own label out."""
        found = self.strength.get((word, label))
        if found is None:
            if len(self.strength) > MEMO:
                self.strength = {}
            counts = [c for c in map(self.model.lexicon.get, features(word)) if c]
            found = max((self._evidence(t - (label == 1), c - (label == 0)) for t, c in counts), default=0.0)
            self.strength[word, label] = found
        return found

    def row(self, text: str, label: int = -1) -> list[float]:
        values = sorted((v for w in self.restorer.words(text) if (v := self._of(w, label)) > 0), reverse=True)
        top = (values + [0.0, 0.0, 0.0])[:3]
        return [1.0, *top, math.log1p(sum(v > 1.0 for v in values))]

    def score(self, text: str) -> float:
        if self.model.weights is None:
            return self.model.prior
        z = float(np.dot(self.row(text), self.model.weights))
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))


def fitted(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Ridge logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    penalty = np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def is_held_out(doc_id: int | None) -> bool:
    """Whether a document's label is not learned from; a null id has no label."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % FOLDS == HELD_OUT


def _sketch(body: bytes) -> list[int]:
    """Least hashes of the three-word runs of a text under four seeds: near copies share some."""
    words = body.lower().split()
    runs = {b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))}
    return [min(xxhash.xxh64_intdigest(run, seed) for run in runs) >> 1 for seed in range(4)]


def _training_rows(labels: DataFrame, fit_rows: int) -> dict[int, int]:
    """The labels learned from: at most ``fit_rows``, by lowest hash of the id. An id with several labels
    is toxic if one of them says so."""
    known = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).filter("doc_id IS NOT NULL AND toxic IN (0, 1)")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD_OUT
    known = known.filter(~held).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return {i: y for i, y in known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows).collect()}


def _each_labelled(labels: dict[int, int], make, names: list[str], types: list[pa.DataType]):
    """Rows that ``make(rows)`` yields from the labelled documents of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                ids = batch.column("doc_id").to_pylist()
                for at, doc_id in enumerate(ids):
                    if doc_id in labels:
                        yield doc_id, labels[doc_id], batch.column("body")[at].as_py()

        out: list[list] = [[] for _ in names]
        for row in make(rows()):
            for column, value in zip(out, row, strict=True):
                column.append(value)
            if len(out[0]) >= 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=names)
                out = [[] for _ in names]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=names)

    return run


def _different(rows: DataFrame, labels: dict[int, int]) -> dict[int, int]:
    """The labels without near copies: a document stays if it has the least id under each of its sketches."""

    def sketches(found):
        for doc_id, _, body in found:
            yield doc_id, *_sketch(body)

    names = ["doc_id", "a", "b", "c", "d"]
    run = _each_labelled(labels, sketches, names, [pa.int64()] * 5)
    found = rows.mapInArrow(tidy(run), ", ".join(f"{n} long" for n in names)).distinct().collect()
    least: list[dict[int, int]] = [{} for _ in range(4)]
    for row in found:
        for known, value in zip(least, row[1:], strict=True):
            known[value] = min(known.get(value, row[0]), row[0])
    return {
        row[0]: labels[row[0]]
        for row in found
        if all(known[value] == row[0] for known, value in zip(least, row[1:], strict=True))
    }


def _counts(rows: DataFrame, labels: dict[int, int], characters: CharacterModel, label: int, among: set[str] | None) -> DataFrame:
    """``feature, n``: the documents of one label that hold each feature."""
    chosen = {i: y for i, y in labels.items() if y == label}

    def counts(found):
        restorer, total = Restorer(characters), Counter()
        for _, _, body in found:
            own = {f for w in restorer.words(body.decode("utf-8", "replace")) for f in features(w)}
            total.update(own if among is None else own & among)
            if len(total) > 1_000_000:
                yield from total.items()
                total.clear()
        yield from total.items()

    run = _each_labelled(chosen, counts, ["feature", "n"], [pa.string(), pa.int64()])
    return rows.mapInArrow(tidy(run), "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Learn the character model from all ``docs`` and the score from the labelled ones.

    Without a toxic or without a clean labelled document the score is the smoothed share of
    toxic labels for every text.
    """
    rows = id_text(docs, id_col, text_col)
    characters = CharacterModel.of(rows)
    kept = _different(rows, _training_rows(labels, fit_rows))
    toxic_rows = sum(kept.values())
    model = Model(characters, (toxic_rows + 1) / (len(kept) + 2))
    if not toxic_rows or toxic_rows == len(kept):
        return model
    toxic = _counts(rows, kept, characters, 1, None).filter(F.col("n") >= LEAST_TOXIC)
    toxic_counts = dict(toxic.collect())
    clean = dict(_counts(rows, kept, characters, 0, set(toxic_counts)).collect())
    for name, n in toxic_counts.items():
        if evidence(float(n), float(clean.get(name, 0)), model.prior) > 0.5:
            model.lexicon[name] = (n, clean.get(name, 0))

    def vectors(found):
        scorer = model.texts()
        for _, label, body in found:
            yield label, *scorer.row(body.decode("utf-8", "replace"), label)

    names = ["label", "one", "first", "second", "third", "number"]
    run = _each_labelled(kept, vectors, names, [pa.float64()] * 6)
    data = np.array(rows.mapInArrow(tidy(run), ", ".join(f"{n} double" for n in names)).collect())
    model.weights = fitted(data[:, 1:], data[:, 0])
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted, row`` for every row; ``row`` is a hash of the text.

    Null and empty texts are scored as texts without words. Repeated rows get equal rows; a
    null id is never held out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.texts()
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            scores = [scorer.score(body.as_py().decode("utf-8", "replace")) for body in batch.column("body")]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([is_held_out(i) for i in ids], pa.bool_()),
                    pa.array(scores, pa.float64()),
                    pa.array([int(s >= THRESHOLD) for s in scores], pa.int32()),
                    batch.column("row"),
                ],
                names=["doc_id", "held_out", "score", "predicted", "row"],
            )

    rows = id_text(docs, id_col, text_col).withColumn("row", F.xxhash64("body"))
    return rows.mapInArrow(tidy(run), "doc_id long, held_out boolean, score double, predicted int, row long")


def clean(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns."""
    toxic = score(docs, model, id_col, text_col).filter("predicted = 1").select("doc_id", "row").distinct()
    body = F.coalesce(docs[text_col].cast("string"), F.lit("")).cast("binary")
    same = docs[id_col].cast("long").eqNullSafe(toxic["doc_id"]) & (F.xxhash64(body) == toxic["row"])
    return docs.join(toxic, same, "left_anti")
