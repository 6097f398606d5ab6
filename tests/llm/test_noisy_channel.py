import random

import numpy as np
import pytest

from plumbline.llm import noisy_channel as nc

CLEAN = "the and then there with over under house river stone green light water paper window garden train summer".split()
BAD = ["zorgle", "mumfrak", "grottish"]


def text(rng, bad=()):
    words = [rng.choice(CLEAN) for _ in range(rng.randint(8, 40))]
    for word in bad:
        words.insert(rng.randrange(len(words)), word)
    return " ".join(words) + "."


@pytest.fixture(scope="module")
def labelled(spark, corpus):
    rng = random.Random(8)
    docs, labels = [], []
    for i in range(600):
        toxic = i % 5 == 0
        docs.append((i, text(rng, rng.sample(BAD, 2) if toxic else ())))
        if i % 10 != 9:
            labels.append((i, int(toxic)))
    hard = [("z0rgle", "mumfr4k"), ("g.r.o.t.t.i.s.h", "zorgle"), ("zzzorgleee", "gr0ttish"), ("m u m f r a k", "zorgle!!")]
    docs += [(1000 + k, text(rng, pair)) for k, pair in enumerate(hard)]
    docs += [(1100 + k, text(rng)) for k in range(4)] + [(None, None), (1200, ""), (1201, "z" * 5000), (1202, None)]
    table = corpus(docs)
    labels = spark.createDataFrame([(i, 1, y) for i, y in labels] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    return table, labels, nc.fit(table, labels)


def test_held_out_rows_and_disguised_words(labelled):
    table, _, model = labelled
    found = {r.doc_id: r for r in nc.score(table, model).collect()}
    assert all(found[i].predicted == int(i % 5 == 0) for i in range(600) if found[i].held_out)
    assert [found[i].predicted for i in range(1000, 1004)] == [1] * 4
    assert [found[i].predicted for i in (*range(1100, 1104), 1200, 1201, 1202, None)] == [0] * 8
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in found.values())
    kept = nc.clean(table, model)
    assert kept.columns == table.columns and kept.count() == table.count() - sum(r.predicted for r in found.values())


def test_restored_words(labelled):
    model = labelled[2].characters
    assert nc.restore("z0rgl3", model) == "zorgle"
    assert nc.restore("mummmfrak", model) == "mumfrak"
    assert nc.restore("g-r-o-t-t-i-s-h", model) == "grottish"
    words = nc.Restorer(model).words("the r i v e r and w4ter, 2024 #12 ok")
    assert {"river", "water", "the", "2024"} <= words


def test_nothing_to_learn_from(spark, corpus, odd):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = nc.fit(corpus(odd), empty)
    assert {r.score for r in nc.score(corpus(odd), model).collect()} == {0.5}
    assert nc.score(corpus([]), nc.fit(corpus([]), empty)).count() == 0


def test_labels_of_held_out_rows_are_not_read(labelled, spark):
    table, labels, model = labelled
    held = [i for i in range(600) if nc.is_held_out(i)]
    flipped = labels.selectExpr("doc_id", "quality", f"IF(doc_id IN ({','.join(map(str, held))}), 1 - toxic, toxic) AS toxic")
    again = nc.fit(table, flipped)
    assert np.allclose(again.weights, model.weights) and again.lexicon == model.lexicon
