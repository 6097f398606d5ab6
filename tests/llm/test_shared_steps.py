import random

from plumbline.llm import line_join


def test_lines_that_share_single_rare_words_are_not_indexed(corpus, monkeypatch):
    """Every line has rare words of many other lines, but hardly two that follow each other."""
    written, settle = [], line_join.settle_bucketed

    def counted(*args, **options):
        table = settle(*args, **options)
        written.append(table.count())
        return table

    monkeypatch.setattr(line_join, "settle_bucketed", counted)
    rng = random.Random(4)
    lines = [" ".join(rng.sample([f"w{i}" for i in range(400)], 10)) for _ in range(300)]
    docs = corpus([(i, line) for i, line in enumerate(lines)] + [(1000, lines[7] + " more"), (1001, lines[8].upper())])
    found = line_join.remove_lines(docs, min_words=1)
    assert sorted(r.doc_id for r in found.filter("lines_removed = 1").collect()) == [1000, 1001]
    assert len(written) == line_join.SLICES and sum(written) < 150
