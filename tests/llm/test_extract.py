import random

from seriesmill.llm import extract

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";x()</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav><!-- <p>no</p> -->
<div class="ad">Buy this now please do.</div><article><h1>A   title</h1><p><b>First</b> para&amp;graph &lt;x&gt;
goes on for a while so that it counts.<br>Next line.<p>Second paragraph without an end, with <a href="x">a link</a> in it and more words.
<div class="share-buttons">Share this page</div><ul><li>Point one of the list</li><li>Point two</li></ul>
<form><p>Your mail please</p></form><p>Last words of the text here.</p><section id="comments"><p>I disagree with all of this.</p></section></article>
<aside><p>Side words that are many and long and of no use.</p></aside><footer>&copy; 2024 me</footer></body></html>"""
TEXT = "A title\n\nFirst para&graph <x> goes on for a while so that it counts. Next line.\n\nSecond paragraph without an end, with a link in it and more words.\n\nPoint one of the list\n\nPoint two\n\nLast words of the text here."


def frame(spark, pages):
    return spark.createDataFrame([(i, "u%s" % i, h, "x", 1) for i, h in pages], "page_id long, url string, html string, text string, n_chars long")


def test_main_text():
    assert extract.main_text(PAGE) == TEXT
    w = extract.fitted(dict(sum((extract.counts(PAGE.replace("Buy", "Buy %d" % k)) for k in range(20)), extract.counts(PAGE))))
    assert extract.main_text(PAGE, w) == TEXT


def test_broken_and_odd_pages():
    assert extract.main_text("<article><p>cut off in the midd") == "cut off in the midd"
    assert extract.main_text("<article><p>a < b and c > d &am &#233;&eacute; &nbsp;x</p></article>") == "a < b and c > d &am éé x"
    for bad in ("", None, "<script>only()", "<!-- open", "<<<<", "<p" + " a" * 1000, "<nav>menu</nav>"):
        assert extract.main_text(bad) == ("" if bad != "<<<<" else "<<<<")
    assert extract.main_text("<article><p>" + "word " * 100_000 + "</p></article>").count("word") == 100_000


def test_best_region_against_brute_force():
    import itertools
    import random

    rng = random.Random(2)
    for _ in range(200):
        s = [rng.choice((-2, -1, 0, 1, 2)) for _ in range(rng.randint(0, 9))]
        best = max([0, *(sum(s[i:j]) for i, j in itertools.combinations(range(len(s) + 1), 2))])
        a, b = extract.best_region(s)
        assert sum(s[a:b]) == best


def test_operator(spark):
    pages = [(1, PAGE), (1, PAGE), (2, None), (3, ""), (None, PAGE), (4, "plain words without any tag")]
    out = extract.extract(frame(spark, pages))
    rows = out.collect()
    assert out.columns == ["page_id", "url", "text", "n_chars"] and len(rows) == 6
    assert [r.text for r in rows if r.page_id in (1, None)] == [TEXT] * 3
    assert all(r.n_chars == len(r.text) for r in rows) and {r.text for r in rows if r.page_id in (2, 3)} == {""}
    assert extract.extract(frame(spark, [])).count() == 0


LONG = "<p>Words of the article that go on for a while.</p>" * 3
READ = "\n\n".join(["Words of the article that go on for a while."] * 3)


def test_wrappers_of_the_main_element():
    for open_, close in (("<form>", "</form>"), ('<div class="layout has-sidebar">', "</div>"), ('<div id="no-nav"><form class="with-header">', "</form></div>")):
        for tag in ("article", "main"):
            page = f"<body>{open_}<nav><a href=x>Home</a></nav><{tag}>{LONG}<form><p>Mail</p></form></{tag}><aside>Side</aside>{close}</body>"
            assert extract.main_text(page) == READ
            assert extract.main_text(page, extract.fitted(dict(extract.counts(page)))) == READ
    assert extract.main_text(f'<main><div class="row has-sidebar"><article>{LONG}</article><div class="sidebar">No</div></div></main>') == READ
    # Articles in boilerplate beside the main text stay out.
    teasers = '<div class="related"><article><p>Teaser</p></article><article><p>Another</p></article></div>'
    comments = '<section id="comments">' + "<article><p>I disagree with that</p></article>" * 5 + "</section>"
    assert extract.main_text(f"<article>{LONG}</article>{teasers}<aside><article><p>Aside</p></article></aside>") == READ
    assert extract.main_text(f"<form><main>{LONG}{comments}</main></form>") == READ
    assert extract.main_text(f"<div>{LONG}{teasers}</div>") == READ


def test_headline_in_marked_header():
    assert extract.main_text(f'<article><header class="entry-header"><h1>The headline</h1></header>{LONG}</article>') == "The headline\n\n" + READ
    assert extract.main_text(f'<header class="site">Site</header><article>{LONG}</article>') == READ


def test_elements_without_an_end_tag():
    lists = "<datalist><option value=a>A<option value=b>B</datalist>"
    assert extract.main_text(f"<article>{lists}{LONG}</article>") == READ
    assert extract.main_text(f"<article>{lists}{LONG}<select><option>x</option></select></article>") == READ
    assert extract.main_text(f"<article><div><button>Press</div>{LONG}</article>") == READ
    assert extract.main_text(f"<article><svg><g><path d=x></g><title>Icon</title></svg>{LONG}<template><p>No</p></template></article>") == READ


P = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua ut enim ad minim"


def test_marked_parts_of_an_article_stay_if_they_hold_prose():
    page = f"<article><h1>T</h1><p>{P}</p><div class='related work'><p>{P} one</p></div><section class='search-header'><p>{P} two</p></section>%s</article>"
    inner = f"<div class=related><ul><li><a href=q>{P}</a></ul></div><div class='newsletter header'><p>{P} three</p></div>"
    assert extract.main_text(page % inner) == f"T\n\n{P}\n\n{P} one\n\n{P} two"


def test_unquoted_attributes_and_open_elements():
    assert extract.main_text(f"<article><p>{P}</p><p><a href=x title=don't>yes</a> and it's</p><p title='a > b'>{P}</p></article>") == f"{P}\n\nyes and it's\n\n{P}"
    assert extract.main_text(f"<article><p>{P}</p><datalist><option>a<option>b</datalist><p>{P} after</p></article>") == f"{P}\n\n{P} after"
    assert extract.main_text(f"<article><p>{P}</p><button>go<p>{P} next</p></article>") == f"{P}\n\n{P} next"
    assert extract.main_text(f"<article><p>{P}</p><button>go<p>{P} in</p></button><p>{P}</p></article>") == f"{P}\n\n{P}"


def test_against_generated_pages():
    """Pages built from parts whose place in the main text is known."""
    rng = random.Random(12)
    words = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n))
    for _ in range(150):
        want, body = [], []
        for _ in range(rng.randint(3, 9)):
            t, kind = words(rng.randint(25, 60)), rng.randrange(8)
            if kind < 3:
                body.append(f"<p>{t}</p>" if kind else f"<p class=x id='y'>{t}")
                want.append(t)
            elif kind == 3:
                body.append(f"<h2>{t[:30].strip()}</h2><ul><li>{t}<li><b>{t[::-1].strip()}</b></ul>")
                want += [t[:30].strip(), t, t[::-1].strip()]
            elif kind == 4:
                body.append(f"<blockquote>{t} &amp; <em>x</em></blockquote>")
                want.append(t + " & x")
            else:
                body.append([f"<aside><p>{t}</p></aside>", f"<div class='ad'>{t}</div>", f"<script>var a='<p>{t}</p>'</script><section class=comments><article><p>{t}</p></article></section>"][kind - 5])
        want_text, around = "\n\n".join(want), f"<nav><ul><li><a href=a>{words(3)}</a></ul></nav>"
        page = f"<!doctype html><html><head><title>{words(3)}</title></head><body>{around}<article>{''.join(body)}<p>{P}</p></article><footer>{words(20)}</footer></body></html>"
        assert extract.main_text(page) == (want_text + "\n\n" if want else "") + P
