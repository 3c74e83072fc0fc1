"""Main text of pages: structure, differences to the nearest page, awkward pages."""

from __future__ import annotations

import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from kernspan.llm import pagetext


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def article(body: str) -> str:
    return (
        "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head>"
        "<body><nav><ul><li><a href='/'>Home</a></li></ul></nav><div class=\"ad\">Buy!</div>"
        f"<article>{body}</article><footer>&copy; host</footer></body></html>"
    )


def test_structure():
    lines = lambda s: [t for t, inside in pagetext.page_lines(s)]
    inside = lambda s: [t for t, inside in pagetext.page_lines(s) if inside]
    assert inside(article("<h1>A  &amp;\nB</h1><p><b>one<br>two<p>three</p>")) == ["A & B", "one two", "three"]
    assert inside("<article><p>cut off in the mid") == ["cut off in the mid"]
    assert inside(article("x<div class='comments'><article class='comment'>no</article></div>")) == ["x"]
    assert inside("<main><header><h1>H</h1></header><p>b</p></main><p>c") == ["H", "b"]
    assert lines("<p class=ad>no<p>yes") == ["yes"]
    assert lines("<div id=cookie-notice>no</div><form>no</form><aside>no<div>no</div></aside>ok") == ["ok"]
    assert lines("<p hidden>no</p><p style='display:none'>no</p><p>a&nbsp;b&#233;</p>") == ["a bé"]
    assert lines("<div class='pageSidebar'>no</div><p class='addition'>yes</p>") == ["yes"]
    assert lines("a < b <p title='x>y'>c</p><!-- no --><!-- no") == ["a < b", "c"]
    assert lines(None) == lines("") == lines("<script>x</script><style>") == []
    assert lines("<p>" * 50_000 + "deep" + "'" * 50_000)[0].startswith("deep")


def longest(a, b) -> int:
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_common_lines_are_a_longest_common_subsequence():
    rng = random.Random(1)
    for _ in range(1_500):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(12))] for _ in range(2))
        found = sorted(pagetext.common_lines(a, b))
        rest = iter(b)
        assert len(found) == longest(a, b) and all(x in rest for x in [a[k] for k in found])


def plain(lead: str, *body: str) -> str:
    return "<html><body>" + "".join(f"<p>{x}</p>" for x in (lead, *body, "All rights kept")) + "</body></html>"


def test_many_equal_lines_are_aligned_in_little_memory(monkeypatch):
    rng = random.Random(4)
    for _ in range(150):
        a, b = ([rng.randrange(3) for _ in range(rng.randint(0, 14))] for _ in range(2))
        walked = pagetext.common_lines(a, b)
        with monkeypatch.context() as patch:
            patch.setattr(pagetext, "MANY_PAIRS", -1)
            halved = sorted(pagetext.common_lines(a, b))
        assert len(halved) == len(walked)
        rest = iter(b)
        assert all(a[i] in rest for i in halved)
    started = time.monotonic()
    found = pagetext.common_lines([1, *[5] * 20_000, 2], [3, *[5] * 19_000, 4])
    assert len(found) == 19_000 and time.monotonic() - started < 60


@pytest.mark.parametrize(
    "wrapper",
    ["div class='layout has-sidebar'", "div class='comments-off'", "article class='search-result'", "main class='with-sidebar'"],
)
def test_wrappers_named_after_what_stands_beside_them_keep_their_text(wrapper):
    name = wrapper.split()[0]
    page = f"<body><nav>Menu</nav><{wrapper}><p>The story.</p><div class='sidebar'>Aside</div></{name}></body>"
    assert [line for line, _ in pagetext.page_lines(page)] == ["The story."]
    comment = "<main><p>Story.</p><article class='comment'>Said.</article><div class='comments'>More.</div></main>"
    assert [line for line, _ in pagetext.page_lines(comment)] == ["Story."]


def test_shared_lines_go_where_there_is_no_container(spark):
    rows = [
        (1, "http://a.org/x/1", plain("Site A", "first text of its own", "and more of it")),
        (2, "http://a.org/x/2?q=1", plain("Site A", "second text of its own", "and still more of it")),
        (3, "http://a.org/zz", plain("Site A", "third text of its own that stands alone")),
        (4, "http://b.org/x/1", plain("Site A", "first text of its own")),
        (5, "http://A.org/x/2", plain("Site A", "second text of its own", "and still more of it")),
        (6, "http://a.org/y", article("<p>Site A</p><p>Its text</p>")),
    ]
    got = {r["page_id"]: r["text"] for r in pagetext.main_text(pages(spark, rows)).collect()}
    assert got[1] == "first text of its own\nand more of it"
    assert got[3] == "third text of its own that stands alone"
    assert got[4] == "Site A\nfirst text of its own\nAll rights kept"  # no page beside it
    assert got[5] == "Site A\nsecond text of its own\nand still more of it\nAll rights kept"  # copies stay
    assert got[6] == "Site A\nIts text"


def test_neighbours_do_not_depend_on_ranges(spark):
    """One host of very many pages over many ranges, against a sort in Python."""
    rng = random.Random(6)
    rows = []
    for i in range(400):
        host = "big" if i % 3 else f"h{i % 40}"
        rows.append((host, "/" + "/".join(rng.choices("abc", k=rng.randrange(1, 5))), i, i, [i], [5]))
    slim = spark.createDataFrame(
        rows, "host string, path string, key_a long, key_b long, hashes array<long>, sizes array<long>"
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r["key_a"]: r["other"] for r in pagetext.neighbours(slim.repartition(13)).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    ordered = sorted(rows, key=lambda r: r[:4])

    def start(a, b) -> int:
        if a[0] != b[0]:
            return -1
        n = 0
        while n < min(len(a[1]), len(b[1])) and a[1][n] == b[1][n]:
            n += 1
        return n

    for i, r in enumerate(ordered):
        before = start(r, ordered[i - 1]) if i else -1
        after = start(r, ordered[i + 1]) if i + 1 < len(ordered) else -1
        want = None
        if max(before, after) >= 0:
            want = ordered[i - 1][4] if before >= after else ordered[i + 1][4]
        assert got[r[2]] == want


def test_awkward_pages(spark):
    rows = [(None, None, None), (1, None, ""), (2, "", article("<p>x</p>")), (2, "", article("<p>x</p>"))]
    rows += [(3, "not a url", plain("x")), (None, "http://h/p", plain("y")), (4, "http://h/p", plain("y"))]
    docs = pages(spark, rows).withColumn("lines", F.lit(1)).withColumn("open", F.lit(2)).withColumn("part", F.lit(3))
    got = pagetext.main_text(docs)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    have = Counter((r["page_id"], r["text"], r["n_chars"]) for r in got.collect())
    y = "y\nAll rights kept"
    assert have == Counter(
        [(None, "", 0), (1, "", 0), (2, "x", 1), (2, "x", 1), (3, "x\nAll rights kept", 17), (None, y, 17), (4, y, 17)]
    )
    assert pagetext.main_text(pages(spark, [])).count() == 0


def texts(spark, rows):
    return {r["page_id"]: r["text"] for r in pagetext.main_text(pages(spark, rows)).collect()}


def test_lines_outside_a_container_are_compared(spark):
    page = lambda lead, body: f"<p>Menu of all</p><div>{lead}</div><article><p>{body}</p></article>"
    got = texts(
        spark,
        [
            (1, "http://a.org/1", page("lead one", "Menu of all")),
            (2, "http://a.org/2", page("lead two", "body two")),
            (3, "http://b.org/2", page("lead", "alone")),
        ],
    )
    assert got == {1: "lead one\nMenu of all", 2: "lead two\nbody two", 3: "alone"}


def test_a_page_without_container_is_compared_with_pages_that_have_one(spark):
    menu = "<p>Menu of all</p><p>Rights</p>"
    rows = [(i, f"http://a.org/{i}", f"{menu}<article><p>body {i}</p></article>") for i in range(5)]
    rows[2] = (2, "http://a.org/2", f"{menu}<p>a page of longer text without any container</p>")
    got = texts(spark, rows)
    assert got[2] == "a page of longer text without any container"
    assert got[1] == "body 1"


def test_short_texts_lose_a_long_template(spark):
    menu = "<p>A long notice that every page of the host shows in the same words</p>"
    rows = [(i, f"http://a.org/{i}", f"{menu}<p>note {i}</p>") for i in (1, 2, 3)]
    rows += [(i, f"http://b.org/x/{i}", f"{menu}<p>the same story under two addresses</p>") for i in (4, 5)]
    got = texts(spark, rows)
    assert got[2] == "note 2"
    assert got[4] == got[5] and "the same story" in got[4]
