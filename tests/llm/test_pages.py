"""Page differencing against a plain alignment and hand-made pages."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from panelkit.llm import pages


def longest(a, b):
    rows = [[0] * (len(b) + 1)]
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(rows[-1][j] + 1 if x == y else max(rows[-1][j + 1], row[-1]))
        rows.append(row)
    return rows[-1][-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=14), st.lists(st.integers(0, 3), max_size=14),
       st.sampled_from([4, 1 << 27]))
def test_alignment_is_longest(a, b, cells):
    before, pages.CELLS = pages.CELLS, cells
    try:
        kept = [x for x, m in zip(a, pages.matched(a, b), strict=True) if m]
    finally:
        pages.CELLS = before
    rest = iter(b)
    assert len(kept) == longest(a, b) and all(x in rest for x in kept)


def test_blocks():
    page = ("<title>T</title><nav>menu</nav><div class='side-bar sidebar'>s<p>t</div>"
            "<article><h1>A &amp; B</h1><p>one<br>two\n <b>x</b>y<p>three"
            "<form>f</form><div class=comments><p>rude</div><p hidden>h</p>"
            "<script>var a='</p>'</script><style>p{}</style>four</article>"
            "<footer>&copy; f</footer><!-- c -->")
    assert pages.main_text(page, None) == "A & B\n\none two xy\n\nthree\n\nfour"
    assert pages.main_text(None, None) == "" == pages.main_text("", None)
    assert pages.main_text("<p>a<p>b", None) == "a\n\nb"
    assert pages.main_text("plain & simple <", None) == "plain & simple <"
    assert pages.main_text("<div id=content>x <i hidden>no</i> y</div>tail", None) == "x\n\ny"
    long = "<p>w " * 20000
    assert len(pages.main_text(long, None)) == 3 * 20000 - 2


def test_article_lifts_class_names():
    for around in ('id="content" class="with-sidebar"', 'class="sidebar"', 'id="search"',
                   'class="content share"', 'role="main" class="header"', 'class="alert-free"'):
        page = f"<div {around}><article>Text</article></div><div class='side-bar'>no</div>"
        assert pages.main_text(page, None) == "Text", around
        assert pages.main_text(page.replace("article", "main"), None) == "Text", around
    assert pages.main_text("<div class='content sidebar'>Text</div>", None) == "Text"
    assert pages.main_text("<div class='form-free'>Text</div>", None) == "Text"
    for inner in ("<nav><article>no</article></nav>", "<p hidden><article>no</article>",
                  "<div class=menu><p>no</div>",
                  "<article>Text<div class=related><article>no</article></div></article>",
                  "<div class=comments><article class=comment>no</article></div>"):
        assert pages.main_text(f"{inner}", None).replace("Text", "") == "", inner


def test_alignment_decides_articles_too(spark):
    def page(i, extra=""):
        return (f"<div>Site</div><nav>Menu</nav><article><p>Own {i}{extra}<p>Subscribe to us."
                f"</article>")

    quote = "<p>A passage that two articles quote."
    enclosed = "<p>Words that all articles have in their midst.<p>Last of {}"
    rows = [(f"https://many.example/{i:02}", page(i, quote if i in (3, 4) else ""))
            for i in range(11)]
    rows += [(f"https://few.example/{i:02}", page(i)) for i in range(2)]
    rows += [(f"https://midst.example/{i:02}", page(i, enclosed.format(i))) for i in range(9)]
    rows += [(f"https://card.example/{i}", f"<div>Site</div><article>Card {i}</article>"
              f"<div>Main text {i}</div><footer>f {i}</footer>") for i in range(2)]
    rows += [("https://alone.example/", "<article>Mine</article><div>tail</div>")]
    rows = [(i, *r) for i, r in enumerate(rows)]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r["page_id"]: r["text"] for r in pages.extract(docs).collect()}
    for i in range(11):
        quoted = "\n\nA passage that two articles quote." if i in (3, 4) else ""
        assert got[i] == f"Own {i}{quoted}", "boilerplate of the host goes, a quote stays"
    assert all(got[11 + i] == f"Own {i}\n\nSubscribe to us." for i in range(2)), "few pages"
    for i in range(9):
        assert got[13 + i] == (f"Own {i}\n\nWords that all articles have in their midst.\n\n"
                               f"Last of {i}"), "enclosed by own blocks"
    assert all(got[22 + i] == f"Card {i}\n\nMain text {i}" for i in range(2))
    assert got[24] == "Mine", "without a neighbour markup decides"


def test_the_share_of_a_host_decides_and_not_its_size(spark):
    """A stock sentence at the end of one article in ten stays on hosts of any size."""
    rows = []
    for host, n in (("small", 10), ("large", 120)):
        for i in range(n):
            tail = "<p>A stock sentence." if i % 10 < 2 else ""
            rows.append((f"https://{host}.example/{i:03}", f"<article><p>Own {host} {i}{tail}"
                         f"<p>All rights.</article>"))
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)],
                                 "page_id long, url string, html string")
    for r in pages.extract(docs).collect():
        assert ("A stock sentence." in r["text"]) == (
            "stock" in rows[r["page_id"]][1]) and "All rights" not in r["text"]


def plain_extract(rows):
    """Pairing, alignment and rescue by plain loops over all pages of a host."""
    parsed = [(pages.place_of(u), pages.blocks(h)) for u, h in rows]
    hosts = {}
    for (host, path), have in parsed:
        texts = tuple(t for t, _ in have)
        if host:
            first, inside = hosts.setdefault(host, {}).get(texts, (path, set()))
            inside |= {t for t, k in have if k == pages.ARTICLE}
            hosts[host][texts] = (min(path, first), inside)
    out = []
    for (host, _), have in parsed:
        texts = tuple(t for t, _ in have)
        order = sorted(((p, x) for x, (p, _) in hosts.get(host, {}).items()),
                       key=lambda r: (r[0], pages.xxhash.xxh128_hexdigest(
                           repr([pages.fingerprint(t) for t in r[1]]))))
        at = next((k for k, (_, x) in enumerate(order) if x == texts), None)
        beside = [] if at is None else [order[k] for k in (at - 1, at + 1) if 0 <= k < len(order)]
        if not beside:
            level = max((k for _, k in have), default=0)
            out.append("\n\n".join(t for t, k in have if k == level >= 0))
            continue

        def agree(other):
            mine, theirs = order[at][0].split("/"), other[0].split("/")
            return next((k for k, (a, b) in enumerate(zip(mine, theirs)) if a != b),  # noqa: B905
                        min(len(mine), len(theirs)) if len(mine) != len(theirs) else len(mine))

        near = max(beside, key=agree)[1]
        both = pages.matched(list(texts), list(near))
        own = [k for k, (_, kind) in enumerate(have) if kind == pages.ARTICLE and not both[k]]
        kept = []
        for k, (text, kind) in enumerate(have):
            holders = sum(text in inside for _, inside in hosts[host].values())
            site = holders >= 3 and 3 * holders >= len(hosts[host])
            inner = own and own[0] < k < own[-1]
            if kind >= 0 and not (both[k] and (kind < pages.ARTICLE or not inner and site)):
                kept.append(text)
        out.append("\n\n".join(kept))
    return out


def test_whole_extraction_against_plain_loops(spark):
    random_ = random.Random(6)
    stock = [f"Stock {k}" for k in range(6)]
    rows = []
    for i in range(160):
        host = random_.choice(["a", "b", "c", "d"]) + ".example"
        path = "/".join(random_.choice(["x", "y", "z"]) for _ in range(random_.randint(0, 3)))
        inner = "".join(f"<p>{random_.choice([*stock, f'Own {i} {k}'])}"
                        for k in range(random_.randint(0, 5)))
        outer = "".join(f"<{t}>{random_.choice([*stock, f'Out {i}'])}</{t}>"
                        for t in random_.choices(["div", "nav", "footer", "main"], k=3))
        body = random_.choice([f"<article>{inner}</article>", f"<div id=content>{inner}</div>"])
        rows.append((f"https://{host}/{path}", outer + body + "<div>Foot</div>"))
    rows += rows[:5] + [(None, "<p>x"), ("https://e.example/", None)]
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)],
                                 "page_id long, url string, html string").repartition(4)
    got = {r["page_id"]: r["text"] for r in pages.extract(docs).collect()}
    assert [got[i] for i in range(len(rows))] == plain_extract(rows)


def site(host, n):
    out = []
    for i in range(n):
        html = (f"<div>Welcome to {host}</div><div>Own text {host} {i}.</div>"
                f"<div>More of {i}</div><div>All rights of {host}</div>")
        out.append((f"https://{host}/dir{i // 3}/page{i}?q=1#x", html))
    return out


def test_differencing(spark):
    rows = [*site("a.example", 30), *site("b.example", 2), ("https://c.example/x", "<p>alone"),
            ("http://a.example/dir0/page0", site("a.example", 1)[0][1]), (None, "<p>no url"),
            ("https://a.example/null", None), ("http://[bad", "<p>bad"),
            ("https://b.example/art", "<div>Welcome to b.example</div><article>Mine</article>")]
    rows = [(i, u, h, "x", "y", 1) for i, (u, h) in enumerate([*rows, rows[0], rows[0]])]
    rows = [(*r, 2, "old") for r in rows]
    schema = ("page_id long, url string, html string, near string, host string, n int, h1 int, "
              "text string")
    out = pages.extract(spark.createDataFrame(rows, schema).repartition(4))
    assert out.columns == ["page_id", "url", "near", "host", "n", "h1", "text"]
    got = {r["page_id"]: r["text"] for r in out.collect()}
    assert len(got) == len(rows)
    for i in range(30):
        assert got[i] == f"Own text a.example {i}.\n\nMore of {i}"
    assert got[32] == "alone" and got[34] == "no url" and got[36] == "bad" and got[35] == ""
    assert got[33] == got[0] == got[38] == got[39], "copies are passed over"
    assert got[37] == "Mine"
    assert pages.extract(spark.createDataFrame([], schema)).count() == 0
