import pyarrow as pa
import pytest

from plumbline.llm.encode import TextEncoder


@pytest.mark.parametrize("vocabulary", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_new_pieces_are_not_looked_up_one_by_one(vocabulary, monkeypatch):
    """While nothing was dropped from the memo, only words before a sign are asked for again."""
    encoder, asked = TextEncoder(vocabulary), []
    known = TextEncoder._known
    monkeypatch.setattr(TextEncoder, "_known", lambda self, piece: asked.append(piece) or known(self, piece))
    texts = ["red green, blue. x1 y2\nred, Blue #", "green blue, (grey) white.\nx1, old white"]
    plain = [encoder.tokenizer.encode(text, add_special_tokens=False).ids for text in texts]
    assert [list(memoryview(one).cast("I")) for one in encoder.encode(texts)] == plain
    assert set(asked) <= {"blue", "green"} and len(asked) <= 2

    encoder.young, encoder.old = {}, encoder.young
    assert [list(memoryview(one).cast("I")) for one in encoder.encode([texts[1], texts[0]])] == plain[::-1]
    assert encoder.ids(pa.array(["white, red."])).to_pylist() == [
        b"".join(i.to_bytes(4, "little") for i in encoder.tokenizer.encode("white, red.", add_special_tokens=False).ids)
    ]
