"""Main text of pages: hand-made markup, alignment and pairing against brute force."""

import random
import re

import duckdb
import pytest
from harness import DATA

from sextant.llm import page_text as pages


def text_of(page: str) -> str:
    lines, marks = pages.lines_of(page)
    if pages.MAIN in marks:
        return "\n".join(x for x, m in zip(lines, marks, strict=True) if m == pages.MAIN)
    return "\n".join(x for x, m in zip(lines, marks, strict=True) if m == pages.OPEN)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""),
        ("plain &lt;text&gt; &amp;  more\n", "plain <text> & more"),
        ("<p>one<p>two <b>bold</b> x<br>three", "one\ntwo bold x\nthree"),
        ("<title>no</title><script>var t='</p><article>';</script><p>yes", "yes"),
        ('<script>a = "<!--";</script><p>yes', "yes"),
        ("<!-- <p>no --><p>yes<!-- cut", "yes"),
        ("<p>1 < 2 and 3 > 2 &eacute;&#233;&#xe9; &am", "1 < 2 and 3 > 2 ééé &am"),
        ("<p title='a>b'>x</p><p class=\"ad\">buy<p>y", "x\ny"),
        ("<nav><a>m</a></nav><article><h1>T</h1><p>a<div class='ad'>b</div><p>c</article><footer>f", "T\na\nc"),
        ("<nav><ul><li>open menu<article>a</article>", "a"),
        ("<article>a<section class='article-comments'><article>c</article></section>b</article><article class='comment'>d</article>", "a\nb"),
        ("<div class='comments'><article>c</article></div><p>a", "a"),
        ("<main><header><h1>T</h1><p>by</p></header>a<aside>s</aside><form>f<input></form></main>", "T\na"),
        ("<div class='post-header'>a</div><div class='main no-sidebar'>b</div><div id='cookie-notice'>c</div><div role='navigation'>d</div><p hidden>e</p>f", "a\nb\nf"),
        ("<ul><li><a href=x>menu</a><li><a>more</a></ul><p>see <a>this</a>", "see this"),
        ("<article>a</p></div></article></article><p>b", "a"),
        ("<p>a<p unfinished", "a"),
        ("<ARTICLE><P CLASS=x>A</ARTICLE>", "A"),
    ],
)
def test_markup(page, text):
    assert text_of(page) == text


def test_deep_and_long_pages():
    assert text_of("<div>" * 50_000 + "x" + "</section>" * 50_000) == "x"
    assert text_of("<p>" + "word " * 200_000) == "word " * 199_999 + "word"
    assert text_of('<p a="' * 20_000) == ""


def longest(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last, row = row, [0]
        for j, y in enumerate(b, 1):
            row.append(max(last[j], row[-1], last[j - 1] + (x == y)))
    return row[-1]


def is_within(part, whole):
    at = iter(whole)
    return all(x in at for x in part)


def test_common_lines_are_a_longest_common_subsequence():
    pick = random.Random(5)
    for _ in range(300):
        a, b = ([pick.randint(0, pick.choice([2, 6, 40])) for _ in range(pick.randint(0, 30))] for _ in "ab")
        kept = [x for x, k in zip(a, pages.common_lines(a, b), strict=True) if k]
        assert len(kept) == longest(a, b) and is_within(kept, b)
    many = list(range(20_000))
    assert all(pages.common_lines(many, many[:7] + [-1] + many[7:])) and sum(pages.common_lines([1] * 9_000, [1, 2] * 5_000)) == 5_000


def brute(rows):
    """The result by pairing within each host in memory."""
    def address(url):
        m = re.match(r"\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)(?::\d*)?([^?#]*)", url or "")
        return (m.group(1).lower(), m.group(2).rstrip("/")) if m else (None, None)

    hosts: dict = {}
    for _, url, page in rows:
        host, path = address(url)
        if host is not None:
            lines = tuple(pages.lines_of(page or "")[0])
            found = hosts.setdefault(host, {})
            found[lines] = min(path, found.get(lines, path))
    out = []
    for page_id, url, page in rows:
        host, _ = address(url)
        lines, marks = pages.lines_of(page or "")
        shared = [False] * len(lines)
        if host is not None:
            order = sorted(hosts[host].items(), key=lambda x: (x[1], pages.xxh3_128_digest(pages._digests(x[0]))))
            i = next(k for k, (ls, _) in enumerate(order) if ls == tuple(lines))
            near = [order[k] for k in (i - 1, i + 1) if 0 <= k < len(order)]
            shared = pages.shared_with(order[i][1], lines, [(p, list(ls)) for ls, p in near])
        main = pages.MAIN in marks
        text = "\n".join(x for x, m, s in zip(lines, marks, shared, strict=True) if (m == pages.MAIN if main else m == pages.OPEN and not s))
        out.append((page_id, url, text, len(text), len(lines), sum(shared)))
    return sorted(out, key=str)


def site(pages_of_host: int):
    """Pages without any named region: only their neighbours tell what is template."""
    rows = []
    for i in range(pages_of_host):
        body = "".join(f"<div>story {i} part {k}</div>" for k in range(i % 4 + 2))
        rows.append((i, f"http://news.example/{'ab'[i % 2]}/{i:03d}?page={i}", f"<div>The Daily Example</div><div>Today</div>{body}<div>All rights kept</div>"))
    return rows


def test_template_lines_go_where_neighbours_share_them(spark):
    rows = site(12) + [(90, "http://news.example/a/000/", site(12)[0][2]), (91, "http://alone.example/x", "<div>The Daily Example</div>"), (92, None, "<div>Today</div>"), (93, "no address", None), (94, "http://u@h.example:80", "")]
    out = pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4))
    got = sorted(map(tuple, out.collect()), key=str)
    assert got == brute(rows)
    texts = {r[0]: r[2] for r in got}
    assert all(texts[i] == "\n".join(f"story {i} part {k}" for k in range(i % 4 + 2)) for i in range(12)) and texts[90] == texts[0]
    assert texts[91] == "The Daily Example" and texts[92] == "Today" and texts[93] == texts[94] == ""


def test_one_host_with_copies_over_many_tasks(spark):
    pick = random.Random(9)
    rows = [(i, f"https://h.example/{pick.randint(0, 30)}/{pick.randint(0, 9)}", "".join(f"<p>{x}" for x in ["top", *[pick.randint(0, 50) for _ in range(pick.randint(0, 8))], "end"])) for i in range(300)]
    rows += [(1000 + i, "https://h.example/copy", "<p>top<p>same<p>end") for i in range(150)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    assert sorted(map(tuple, pages.main_text(df).collect()), key=str) == brute(rows)


def test_articles_are_whole_whatever_neighbours_share(spark):
    out = {r.page_id: r for r in pages.op11_html_extraction(spark, DATA).collect()}
    rows = duckdb.connect().execute(f"SELECT page_id, url, html FROM '{DATA}/pages.parquet'").fetchall()
    assert len(out) == len(rows)
    for page_id, url, page in rows:
        article = re.search(r"<article>(.*?)(</article>|$)", page, re.S).group(1)
        blocks = [" ".join(pages.html.unescape(re.sub(r"<[^>]*(>|$)", "", x)).split()) for x in re.split(r"</?(?:p|h\d|br)>", article)]
        text = "\n".join(b for b in blocks if b)
        assert (out[page_id].url, out[page_id].text, out[page_id].n_chars) == (url, text, len(text))


def test_odd_tables(spark, odd, empty):
    out = pages.main_text(odd, page="text", url="source")
    assert out.count() == odd.count() and out.columns[-4:] == ["text", "n_chars_", "n_lines_", "n_shared"]
    assert pages.main_text(empty, page="text", url="source").count() == 0
