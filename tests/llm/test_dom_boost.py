import pytest

from plumbline.llm import dom_boost

PAGES = [
    (0, "u", "<html><body><nav><ul><li><a href='/'>Home</a></li></ul></nav><article><h1>T &amp; x</h1><p>One\n two.&nbsp;Three, four and more of it."
     "<p><b>Second <i>one</i> is longer.<br>Same block.</article><footer>&copy; me</footer></body></html>", "T & x\nOne two. Three, four and more of it.\nSecond one is longer. Same block."),
    (1, None, "<main><p>Only paragraph here, with a few words in it.</p><script>var t='</p>';</script><style>p{}</style><!-- no --></main>", "Only paragraph here, with a few words in it."),
    (2, "u", None, ""),
    (None, "u", "", ""),
    (3, "u", "<div class='cookie-notice'>We use cookies. Accept them.</div><article><p>Article text stands here, it is long enough to matter.</p>"
     "</article><section id='comments'><h2>Comments</h2><ol><li><p>First! I agree with it.</p></li></ol></section>"
     "<aside class='sidebar'><p>Read more of this here.</p></aside><form><label>Search</label><input></form>", "Article text stands here, it is long enough to matter."),
]


@pytest.fixture(scope="module")
def trees(spark):
    return dom_boost.fit(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"))


def frame(spark, rows):
    return spark.createDataFrame([(*r[:3], "x", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")


def test_pages(spark, trees):
    found = dom_boost.extract(frame(spark, PAGES), trees).collect()
    got = {(r.page_id, r.url): (r.text, r.n_chars) for r in found}
    assert got == {(i, u): (t, len(t)) for i, u, _, t in PAGES}


def test_layouts_that_were_not_fitted(trees):
    right = total = 0
    for seed in range(5000, 5060):
        nodes = dom_boost.layout_nodes(seed)
        kept = dom_boost.decode(nodes, trees.margin(dom_boost.features(nodes)))
        for node, keep in zip(nodes, kept, strict=True):
            if any(isinstance(c, str) and c.strip() for c in node.children) and node.tag not in dom_boost.SILENT:
                right += keep == (node.truth == 1)
                total += 1
    assert right / total > 0.93


def test_nothing_kept_below_a_dropped_element(trees):
    for seed in range(6000, 6030):
        nodes = dom_boost.layout_nodes(seed)
        kept = dom_boost.decode(nodes, trees.margin(dom_boost.features(nodes)))
        chosen = {id(n) for n, k in zip(nodes, kept, strict=True) if k}
        assert all(n.parent is None or id(n.parent) in chosen for n, k in zip(nodes, kept, strict=True) if k)


def test_exported_trees_equal_the_model(spark, trees):
    assert trees.leaf.shape == (dom_boost.TREES, 1 << dom_boost.DEPTH)


def test_long_and_broken_pages(spark, trees):
    long = "<article>" + "<p>words of a very long page, again and again.</p>" * 5000 + "</article>"
    broken = "<article><p>unclosed <b>words &am <ul><li>a<li>b, which is longer</ul></div></p> tail &lt;x&gt;"
    found = {r.page_id: r.text for r in dom_boost.extract(frame(spark, [(1, "u", long), (2, "u", broken)]), trees).collect()}
    assert found[1].count("\n") == 4999
    assert found[2] == "unclosed words &am\na\nb, which is longer\ntail <x>"


def test_no_rows(spark, trees):
    assert dom_boost.extract(frame(spark, []), trees).count() == 0
