import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from plumbline.llm import packing, token_files
from plumbline.llm.encode import encoder


def whole(vocabulary, text):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(vocabulary))
    return tokenizer.encode(text or "", add_special_tokens=False).ids


TEXTS = [
    "",
    "Plain words here.",
    " leading",
    "trailing ",
    "two  spaces",
    "a\nb\n\nc",
    "tab\tand\rreturn",
    "don't we'll I'd 's",
    "x\x00y",
    "ünïcode ÄÖ ñ 漢字     \u0085 \x1c \U0001f600",
    "<|endoftext|> 123 45.6 $$$ %%% of%%% ...",
    "end_, here), now.), then, so. It. Is,\nover.\nagain._ x",
    "Commas, stops. And, lines.\nNext, line.",
    "Word\nNext line\nword word\nword",
]


@pytest.mark.parametrize("vocabulary", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_give_the_ids_of_whole_texts(vocabulary):
    own = encoder(vocabulary)
    for text, ids in zip(TEXTS * 2, own.encode(TEXTS * 2), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == whole(vocabulary, text), text


ALPHABET = [*"abcdeABC  \n\n\t,.'-1\x00\x01\x1c\x85\xa0\u200bİǅßſΣσς\u0301\u0307漢_%$", "<|endoftext|>", "<|startoftext|>"] + [
    " the ", " word.\n", "'s", "é", "e\u0301", "a\tb ", "\n\xa0\xa0", "İ, ǅ. ", "Word, word. "
]


@pytest.mark.parametrize("vocabulary", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_random_texts_have_the_ids_of_the_plain_call(vocabulary):
    draw = random.Random(5)
    texts = ["".join(draw.choices(ALPHABET, k=draw.randint(0, 30))) for _ in range(20000)]
    plain, own = Tokenizer.from_file(public_tokenizers.path(vocabulary)), encoder(vocabulary)
    for at in range(0, len(texts), 1000):
        some = texts[at : at + 1000]
        for text, ids in zip(some, own.encode(some), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, text


def test_the_memo_keeps_giving_the_same_ids(monkeypatch):
    from plumbline.llm import encode

    monkeypatch.setattr(encode, "MEMO", 40)
    own = encode.TextEncoder("word_bpe_49k.json")
    texts = [" ".join(f"w{chr(97 + i % 26)}{chr(97 + i % 23)}, x." for i in range(k, k + 9)) for k in range(90)]
    for at in range(0, 90, 7):
        some = texts[at : at + 7]
        assert own.encode(some) == [np.array(whole("word_bpe_49k.json", t), "<u4").tobytes() for t in some]


def test_packing_cuts_every_id_once(corpus, odd):
    pairs = odd + [(i, f"document number {i} " * (i % 90)) for i in range(10, 120)]
    found = packing.pack(corpus(pairs), window=128).toPandas()
    found = found.sort_values(["sequence_id", "offset"])
    for _, own in found.groupby("sequence_id"):
        assert (own.offset == np.concatenate(([0], np.cumsum(own.length)[:-1]))).all()
    sizes = found.groupby("sequence_id").length.sum()
    assert sizes.index.tolist() == list(range(len(sizes))) and (sizes.iloc[:-1] == 128).all() and 0 < sizes.iloc[-1] <= 128
    assert (found.ids_crc32 == found.ids.map(zlib.crc32)).all() and (found.ids.map(len) == 4 * found.length).all()
    # Pieces of one document, in the order of their starts, are its ids and the end id.
    place = found.sequence_id * 128 + found.offset - found.start
    texts = sorted(np.frombuffer(b"".join(own.ids), "<u4").tolist() for _, own in found.groupby(place))
    assert texts == sorted(whole("byte_bpe_50k.json", t) + [1] for _, t in pairs)
    padded = packing.sequences(packing.pack(corpus(pairs), window=128), window=128).toPandas()
    n = padded.n.to_numpy()
    assert (padded.ids.map(len) // 4 == np.where((n & (n - 1)) == 0, n, 128)).all()


def test_token_files_round_trip(spark, corpus, odd):
    pairs = odd + [(i, f"Some text {i}\nsecond line " * (i % 7)) for i in range(200, 100, -1)]
    files = token_files.write(corpus(pairs), token_files.new_path(spark))
    found = token_files.read(spark, files).toPandas().sort_values("start")
    assert found.start.tolist() == np.concatenate(([0], np.cumsum(found.n_tokens)[:-1])).tolist()
    ids = found.doc_id.fillna(-1).tolist()
    assert ids == sorted(ids)
    assert sorted(np.frombuffer(x, "<u4").tolist() for x in found.ids) == sorted(
        whole("word_bpe_49k.json", t) + [2] for _, t in pairs
    )
    shards = token_files.shards(spark, files).orderBy("base").collect()
    flat = np.concatenate([token_files.mapped(s.file, files.width) for s in shards])
    assert flat.tolist() == [i for x in found.ids for i in np.frombuffer(x, "<u4").tolist()]
    parts = token_files._files(spark, files.offsets).orderBy("number").collect()
    offsets = np.frombuffer(b"".join(bytes(r.content) for r in parts), "<u8")
    assert offsets.tolist() == found.start.tolist()


def test_empty_tables(spark, corpus):
    assert packing.pack(corpus([])).count() == 0
    files = token_files.write(corpus([]), token_files.new_path(spark))
    assert token_files.read(spark, files).count() == 0
