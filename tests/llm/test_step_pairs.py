from plumbline.llm import line_join


def test_small_groups_are_paired_where_they_are_grouped(corpus, monkeypatch):
    """Lines that share one step and little else are grouped, but no row of them is written, and lines are cut once."""
    written, settle, cut, words = [], line_join.settle_bucketed, [], line_join._words

    def counted(*args, **options):
        table = settle(*args, **options)
        written.append(table.filter("NOT large").selectExpr("line AS a", "other AS b").distinct().collect())
        return table

    def cutting(text):
        cut.append(text)
        return words(text)

    monkeypatch.setattr(line_join, "settle_bucketed", counted)
    monkeypatch.setattr(line_join, "_words", cutting)
    lines = [" ".join(["a1", "a2", *(f"w{i}x{k}" for k in range(20))]) for i in range(20)]
    docs = corpus([(i, line) for i, line in enumerate(lines)] + [(100, lines[3] + " more"), (101, lines[4].upper())])
    found = line_join.remove_lines(docs, min_words=1)
    assert sorted(r.doc_id for r in found.filter("lines_removed = 1").collect()) == [100, 101]
    assert len({(r.a, r.b) for part in written for r in part}) == 1
    assert "line" in cut and not any("text" in x for x in cut)
