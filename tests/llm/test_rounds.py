from pathlib import Path

import pytest

from plumbline.llm import components as stars
from plumbline.session import shared_dir


def brute(edges):
    root = {n: n for e in edges for n in e if e[0] != e[1]}
    for _ in root:
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    return sorted(root.items())


@pytest.mark.parametrize(
    ("edges", "rounds"),
    [
        ([(5, 1), (6, 1), (9, 7), (1, 1)], 1),
        ([(1, 2), (3, 2), (2, 1), (8, 8)], 1),
        ([(i, i + 1) for i in range(40)], None),
        ([(1, 5), (5, 9), (9, 2), (20, 30), (30, 25)], None),
    ],
)
def test_rounds_end_with_stars_and_leave_one_table(spark, monkeypatch, edges, rounds):
    """No round only to see that nothing changes, and no tables of earlier rounds."""
    name, made, settle = f"test-rounds-of-{sum(a for a, _ in edges)}", [], stars.settle
    monkeypatch.setattr(stars, "settle", lambda *args: made.append(args[1]) or settle(*args))
    found = stars.components(spark.createDataFrame(edges, "a long, b long"), name)
    assert sorted((r.node, r.root) for r in found.collect()) == brute(edges)
    if rounds:
        assert len(made) == rounds + 1
    folder = Path(shared_dir(spark).removeprefix("file://"))
    assert {p.as_posix().removeprefix("file:") for p in folder.glob(f"{name}-*")} == {
        f.removeprefix("file://").rpartition("/")[0] for f in found.inputFiles()
    }


def test_no_edges(spark):
    assert stars.components(spark.createDataFrame([], "a long, b long")).count() == 0
