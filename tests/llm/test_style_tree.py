import pytest

from tridelta.llm import style_tree as st

SCHEMA = "page_id bigint, url string, html string, text string, row int, paths int, host int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "t", 1, 2, 3) for r in rows], SCHEMA)


@pytest.mark.parametrize("source,lines", [
    ("", []),
    ("plain &amp; simple", ["plain & simple"]),
    ("<p>a<p>b <b>c</b>\n  d<br>e</p>f", ["a", "b c d e", "f"]),
    ("<nav>x</nav><article><h1>T &lt;1&gt;</h1><p><b>A.<br><p>B</p></article><footer>y", ["T <1>", "A.", "B"]),
    ("<script>var t='</p>';</script><p>a</p><style>p{}</style><!-- <p>no</p> --><p>b", ["a", "b"]),
    ("<div class='ad'>buy</div><p>x</p><div id=\"side-bar sidebar\">s</div><form>f<input></form>", ["x"]),
    ("<article><p>x</p><div class=comments><article><p>c</p></article></div><p>y</p></article><p>z", ["x", "y"]),
    ("<article><p title='a > b'>x</p><aside>no</aside><ul><li>1<li>2</ul></article>", ["x", "1", "2"]),
    ("<header>h</header><main><header><h1>t</h1></header><p>x</p></main>", ["t", "x"]),
    ("<p hidden>no</p><p style='display: none'>no</p><p>yes</p><div aria-hidden=true>no</div>", ["yes"]),
    ("<table><tr><td>a<td>b<tr><td>c</table>", ["a", "b", "c"]),
    ("<p>x</p><!-- never closed <p>y", ["x"]), ("<p>x <", ["x <"]), ("a < b and c > d", ["a < b and c > d"]),
    ("<p>x</p></div></p><p>y</p>", ["x", "y"]), ("<P>Up</P><SCRIPT>no</sCript ><P>per", ["Up", "per"]),
])
def test_blocks(source, lines):
    assert st.Page(source).lines() == lines


def site(n, host="h"):
    return [(k, f"http://{host}/p{k}", f"<html><body><div class=top>Welcome to our site</div><div class=text><p>text {k} of its own</p><p>more {k * 7}</p></div>"
             f"<div class=legal><p>All rights reserved</p></div></body></html>") for k in range(n)]


def test_template_branches_go(spark):
    rows = site(12) + [(100, "http://other/x", "<body><div class=legal><p>All rights reserved</p></div></body>")]
    got = {r.row.page_id: r.text for r in st.extract(frame(spark, rows)).collect()}
    assert all(got[k] == f"text {k} of its own\nmore {k * 7}" for k in range(12))
    assert got[100] == "All rights reserved"  # one page tells nothing of its site


def test_copies_count_once(spark):
    page = "<body><div class=text><p>only text</p></div></body>"
    rows = [(k, "http://h/x", page) for k in range(50)]
    assert {r.text for r in st.extract(frame(spark, rows)).collect()} == {"only text"}


def plain_importance(features, gamma=0.9):
    """The tree built and walked from the definition, in plain Python: {(host, path): (importance, highest)}."""
    from collections import defaultdict
    from math import log

    seen, kids, has = defaultdict(set), {}, defaultdict(set)
    for host, path, kind, feature, children, page in features:
        if kind == 2:
            has[host, path].add(page)
        else:
            seen[host, path, feature].add(page)
            if kind == 0:
                kids[host, path, feature] = children

    def walk(host, path):
        m = len(has[host, path])
        counts = {f: len(p) for (h, q, f), p in seen.items() if (h, q) == (host, path)}
        total = sum(counts.values())
        if path.endswith(st.LEAF):
            score = 1.0 if m == 1 else 1 - sum(n * log(n) / log(m) for n in counts.values()) / total
            return score, score
        look = 1.0 if m == 1 else min(1.0, -sum(n / total * log(n / total) for n in counts.values()) / log(m))
        below, top = 0.0, 0.0
        for f, n in counts.items():
            scores = [walk(host, f"{path}>{c}") for c in kids[host, path, f]]
            below += n / total * sum(x for x, _ in scores) / len(scores)
            top = max([top, *(t for _, t in scores)])
        score = (1 - gamma ** len(counts)) * look + gamma ** len(counts) * below
        return score, max(score, top)

    return {key: walk(*key) for key in has}


def template(k, host="h"):
    """No name in the list: a menu, a notice and a footer under names of no meaning, worded a little otherwise on each page."""
    menu = "".join(f"<li><a href='/{w}'>{w} of the whole site</a></li>" for w in ("home", "news", "shop", "about"))
    return (f"<body><div class=zq><ul class=k>{menu}<li><a href='/u{k}'>hello user{k}</a></li></ul></div>"
            f"<div class=xx>We use small files to make this place work well for all who visit, number {k}</div>"
            f"<section class=yy><h1>Title {k}</h1><p class=aa>first{k} part of own{k} text{k} here{k} and{k} more{k}</p>"
            f"<p class=aa>second{k} part{k * 3} with{k} other{k} words{k} in{k} it{k}</p></section>"
            f"<div class=ww>All rights of this place are reserved by its owners since the year {1990 + k}</div></body>")


def test_importance_is_that_of_the_definition(spark):
    rows = [(k, f"http://h/{k}", template(k)) for k in range(9)] + [(50 + k, f"http://g/{k}", BODY.replace("many", f"m{k}")) for k in range(3)]
    rows += site(7, "s") + [(90, "http://s/x", "<div class=top>other <p>nested</p> text</div>"), (90, "http://s/x", "<div class=top>other <p>nested</p> text</div>")]
    features = st.tree_features(frame(spark, rows), "url", "html", names=False)
    want = plain_importance([tuple(r) for r in features.collect()])
    got = {(r.host, r.path): (r.importance, r.highest) for r in st.importance(features).collect()}
    assert got.keys() == want.keys() and len(got) > 20
    assert all(abs(x - y) < 1e-9 for k in want for x, y in zip(got[k], want[k]))


@pytest.mark.parametrize("names", [True, False])
def test_templates_under_any_name_go(spark, names):
    rows = [(k, f"http://h/{k}", template(k)) for k in range(20)]
    for r in st.extract(frame(spark, rows), names=names).collect():
        k = r.row.page_id
        assert "whole site" not in r.text and "small files" not in r.text and "reserved" not in r.text
        assert f"Title {k}" in r.text and f"first{k}" in r.text and f"second{k}" in r.text and r.n_template >= 6


def test_own_text_beside_templates_stays(spark):
    """A container of many template parts and one of its own is not taken out whole."""
    parts = "".join(f"<div class=t{c}>the same words on all pages {c}</div>" for c in "abcdefghij")
    rows = [(k, f"http://h/{k}", f"<div class=box>{parts}<div class=mine>own{k} words{k} only{k}</div></div>"
             f"<div class=big><p>{' '.join(f'w{k}x{j}' for j in range(120))}</p></div>") for k in range(12)]
    for r in st.extract(frame(spark, rows), names=False).collect():
        k = r.row.page_id
        assert f"own{k} words{k} only{k}" in r.text and "the same words" not in r.text and f"w{k}x119" in r.text


def test_edge_cases(spark):
    rows = [(1, None, "<p>a"), (2, "nonsense", "<p>b"), (3, "http://h/", None), (4, "http://h/", ""), (None, "http://h/", "<p>c"),
            (5, "http://h/", "<p>d"), (5, "http://h/", "<p>d"), (6, "http://h/", "<p>" + "long &amp; " * 50_000)]
    out = st.extract(frame(spark, rows))
    got = sorted((r.row.page_id or 0, r.text, r.n_chars) for r in out.collect())
    long = " ".join(["long &"] * 50_000)
    assert got == [(0, "c", 1), (1, "a", 1), (2, "b", 1), (3, "", 0), (4, "", 0), (5, "d", 1), (5, "d", 1), (6, long, len(long))]
    assert st.extract(frame(spark, [])).count() == 0


@pytest.mark.parametrize("source", [
    "<div class='elementor-widget elementor-widget-text-editor'><p>x</p><p>y</p></div>",
    "<body class='page no-sidebar'><p>x</p><p>y</p></body>", "<html class=modal><body id=search><p>x<p>y",
    "<div id=content class='comments-open has-toc share-enabled'><p>x</p><p>y</p></div>",
    "<main class='widget'><p>x</p><p>y</p></main>", "<article class='post promo'><p>x</p><p>y</p></article>",
    "<div class='modal'><main><p>x</p><p>y</p></main></div><p>z",
    "<div class=widget><div class=related><article><p>x</p><p>y</p></article></div></div>",
    "<div id=header><article><p>x</p><p>y</p></article></div>",
])
def test_names_that_only_hold_a_word(source):
    assert st.Page(source).lines() == ["x", "y"]


@pytest.mark.parametrize("source,lines", [
    ("<div class=text><p>the main text</p></div><div class=sidebar><article><p>teaser</p></article></div>", ["the main text"]),
    ("<p>x</p><ol class='comment-list'><li><article class=comment><p>a longer comment</p></article></ol>", ["x"]),
    ("<p>x</p><div class=site-footer>f</div><div class='box ad-slot-3'>a</div><div id=comments2>c</div>", ["x"]),
    ("<article><p>x</p><article class=related><p>r</p></article></article>", ["x"]),
])
def test_names_that_say_so(source, lines):
    assert st.Page(source).lines() == lines


BODY = "<h2>A title</h2><p>A text that many pages of this host repeat word by word.</p><ul><li>one point</li></ul>"


@pytest.mark.parametrize("form", [
    "<html><script>track({k})</script><body><article><div class='entry-content'>BODY</div></article></body></html>",
    "<body><!-- {k} --><div class=page><div class=text>BODY</div><div class=views>seen {k} times</div></div></body>",
    "<body><div class=text>BODY</div><p class=date>day {k}</p></body>",
    "<article><section class=one><p>first half, as long</p></section><section class=two><p>other half, as long</p></section></article><p>{k}</p>",
])
def test_near_copies_keep_their_text(spark, form):
    rows = [(k, f"http://h/p{k}", form.replace("BODY", BODY).replace("{k}", str(k))) for k in range(12)]
    other = [(100 + k, f"http://h/o{k}", form.replace("BODY", f"<p>own text {k} of a page</p>").replace("{k}", "0")) for k in range(3)]
    for r in st.extract(frame(spark, rows + other)).collect():
        want = st.Page((rows + other)[r.row.page_id if r.row.page_id < 100 else r.row.page_id - 88][2]).lines()
        # what no page shares may go or stay, but the main text is whole
        assert [x for x in want if not x.startswith(("seen", "day"))] == [x for x in r.text.split("\n") if not x.startswith(("seen", "day"))]
