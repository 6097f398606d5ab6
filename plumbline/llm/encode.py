"""Token ids of whole texts with a public tokenizer, remembered piece by piece.

Both public vocabularies split a text at white space before anything is merged, so the
ids of a text in which single blanks and newlines stand between words are the ids of its
pieces one after the other. A batch of texts is split and its pieces are numbered by
Arrow; only different pieces come to Python, where a task remembers the ids of those
it has met. All other texts (other white space, two such characters side by side or one
at an end, the strings of added tokens) go to the tokenizers library as a whole. The ids
are those of ``Tokenizer.from_file(path).encode(text, add_special_tokens=False)``.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from plumbline.llm.common import tidy

MEMO = 800_000
JOINED = 2000
SLICE_BYTES = 8 << 20
_WORKER: dict[str, TextEncoder] = {}

# White space other than single blanks and newlines between words, by any definition of white
# space that Python or the tokenizers library has, and the marks used below.
_OTHER_SPACE = (
    r"^[ \n]|[ \n][ \n]|[ \n]$|"
    r"[\x00-\x09\x0b-\x1f\x{85}\x{a0}\x{180e}\x{1680}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{2060}\x{3000}\x{feff}]"
)
# Letters that stay single letters when they are composed and lower-cased.
_WORD = re.compile("[A-Za-zÀ-ÖØ-öø-įı-ňŊ-ž]+")


class TextEncoder:
    """Ids of texts as little-endian unsigned 32-bit bytes.

    ``spaced`` says that a piece's ids depend on a space before it (byte-level
    vocabularies); otherwise white space leaves no ids.
    """

    def __init__(self, vocabulary: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(vocabulary))
        self.added = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        newline = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.spaced = len(newline) > 0
        self.newline = newline[0] if newline else -1
        ids = self.tokenizer.get_vocab()
        mark = "Ġ" if self.spaced else "</w>"  # the space before a word, or its end
        self.edge = np.zeros(max(ids.values()) + 1, bool)
        self.edge[[i for t, i in ids.items() if (t.startswith(mark) if self.spaced else t.endswith(mark))]] = True
        self.signs = {sign: self._ids([sign])[0] for sign in ",."}
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _ids(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(one.ids, "<u4").tobytes() for one in found]

    def _joined(self, pieces: list[str], glue: str) -> list[bytes]:
        """Ids of pieces that are encoded together and cut where they begin or end."""
        out: list[bytes] = []
        for at in range(0, len(pieces), JOINED):
            some = pieces[at : at + JOINED]
            lead = glue if glue == "\n" or self.spaced else ""
            ids = np.array(self.tokenizer.encode(lead + glue.join(some), add_special_tokens=False).ids, "<u4")
            edges = np.flatnonzero(ids == self.newline if glue == "\n" else self.edge[ids])
            if not self.spaced:  # the last token of each word
                starts, ends = np.concatenate(([0], edges[:-1] + 1)), edges + 1
                sound = len(edges) == len(some) and ends[-1] == len(ids)
            else:  # the first token of each word, or the newline before it
                starts, ends = edges + (glue == "\n"), np.append(edges[1:], len(ids))
                sound = len(edges) == len(some) and edges[0] == 0
            if sound:
                whole = ids.tobytes()
                out += [whole[4 * i : 4 * j] for i, j in zip(starts.tolist(), ends.tolist(), strict=True)]
            else:
                out += self._ids([(glue if glue == " " and self.spaced else "") + piece for piece in some])
        return out

    def _learn(self, pieces: list[str]) -> None:
        """Remember new pieces. A comma or full stop after a word is a piece of its own to the tokenizer."""
        young, known, whole = self.young, self._known, _WORD.fullmatch
        words: dict[str, None] = {}
        stems, others = [], []
        for piece in pieces:
            if whole(piece):
                words[piece] = None
            elif piece[-1] in ",." and whole(piece, 0, len(piece) - 1):
                stems.append(piece)
            else:
                others.append(piece)
        words.update((stem, None) for piece in stems if (stem := piece[:-1]) not in words and known(stem) is None)
        ordered = list(words)
        young.update(zip(ordered, self._joined(ordered, " "), strict=True))
        if self.spaced:  # "\0x" is x at the start of the text or a line, "x" is x after a space
            bare = [p for p in others if p[0] == "\0"]
            after = [p for p in others if p[0] != "\0" and p != "\n"]
            young.update(zip(bare, self._joined([p[1:] for p in bare], "\n"), strict=True))
            young.update(zip(after, self._joined(after, " "), strict=True))
            young["\n"] = np.array([self.newline], "<u4").tobytes()
        else:
            young.update(zip(others, self._ids(others), strict=True))
        signs = self.signs
        for piece in stems:
            young[piece] = young[piece[:-1]] + signs[piece[-1]]

    def _known(self, piece: str) -> bytes | None:
        """A remembered piece; what is asked for again stays when half the memo is dropped."""
        found = self.young.get(piece)
        if found is None:
            found = self.old.get(piece)
            if found is not None:
                self.young[piece] = found
        return found

    def _pieces(self, texts: pa.Array) -> pa.Array:
        if self.spaced:
            lines = pc.replace_substring(texts, "\n", " \n \0")
            return pc.split_pattern(pc.binary_join_element_wise("\0", lines, ""), " ")
        return pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")

    def _plain(self, texts: pa.Array, end: bytes) -> pa.Array:
        """Ids of texts that can be split, each followed by ``end``."""
        if len(self.young) > MEMO // 2:
            self.young, self.old = {}, self.young
        pieces = self._pieces(texts)
        coded = pieces.flatten().dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        young = self.young
        new = [word for word in words if word not in young]
        if new and self.old:
            new = [word for word in new if self._known(word) is None]
        if new:
            self._learn(new)
        values = pa.array([*map(young.__getitem__, words), end], pa.binary())
        ends = np.asarray(pieces.offsets)[1:] - np.asarray(pieces.offsets)[0]
        numbers = np.insert(np.asarray(coded.indices), ends, len(words))
        taken = values.take(pa.array(numbers))
        cuts = np.asarray(pa.Array.from_buffers(pa.int32(), len(taken) + 1, [None, taken.buffers()[1]]))
        at = np.concatenate((cuts[:1], cuts[ends + np.arange(1, len(ends) + 1)])).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(at), taken.buffers()[2]])

    def ids(self, texts: pa.Array, end: bytes = b"") -> pa.Array:
        """The ids of every text (none null), then ``end``, as one binary value each."""
        odd = pc.match_substring_regex(texts, _OTHER_SPACE)
        odd = pc.or_(odd, pc.equal(pc.binary_length(texts), 0))
        for content in self.added:
            odd = pc.or_(odd, pc.match_substring(texts, content))
        odd = np.asarray(odd.to_numpy(zero_copy_only=False), bool)
        if not odd.any():
            return self._plain(texts, end) if len(texts) else pa.array([], pa.binary())
        whole = pa.array([one + end for one in self._ids(texts.filter(pa.array(odd)).to_pylist())], pa.binary())
        if odd.all():
            return whole
        found = pa.concat_arrays([self._plain(texts.filter(pa.array(~odd)), end), whole])
        place = np.empty(len(odd), np.int64)
        place[np.concatenate((np.flatnonzero(~odd), np.flatnonzero(odd)))] = np.arange(len(odd))
        return found.take(pa.array(place))

    def encode(self, texts: list[str]) -> list[bytes]:
        return self.ids(pa.array(texts, pa.string())).to_pylist()


def encoder(vocabulary: str) -> TextEncoder:
    """The worker's own encoder of a vocabulary file."""
    if vocabulary not in _WORKER:
        _WORKER[vocabulary] = TextEncoder(vocabulary)
    return _WORKER[vocabulary]


def _forget() -> None:
    for one in _WORKER.values():
        one.young, one.old = {}, {}


def forgetting(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``tidy(run)`` for tasks that encode; the memo goes with the task, so that idle workers hold none."""

    def forgot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _forget()

    return tidy(forgot)


def strings(bodies: pa.Array) -> pa.Array:
    """UTF-8 bytes as strings; bytes that are no UTF-8 become replacement characters."""
    try:
        return bodies.cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([body.decode("utf-8", "replace") for body in bodies.to_pylist()], pa.string())


def slices(batches: Iterator[pa.RecordBatch], size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches with a column ``body``, cut to about ``size`` bytes of it (one row at least)."""
    for batch in batches:
        total = np.cumsum(pc.binary_length(batch.column("body")).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = total[at - 1] if at else 0
            upto = max(at + 1, int(np.searchsorted(total, before + size, "right")))
            yield batch.slice(at, upto - at)
            at = upto
            pa.default_memory_pool().release_unused()
