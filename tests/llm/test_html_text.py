import html
import random
import re

from annoscope.llm.html_text import Page, host_paths, main_text


def own(page):
    return Page(page).main_text([])


def test_blocks_white_space_references_and_broken_markup():
    page = """<!DOCTYPE html><title>no &lt;title&gt;</title><style>p{x:"</p>"}</style><script>var a = "<p>no</p>"; if (a < b) x();</script>
    <body><!-- <p>no</p> --><div class=content><h2>A &amp; B&nbsp;&#x43;</h2><p>one\n\t two<br>three <b>bo<i>ld</b> x</i><p>four < five &lt;b&gt; <a href='x>y'>link</a>
    <ul><li>six<li>seven <em title="a>b">e</em></ul><table><tr><td>c1<td>c2<tr><td>c3</table><pre> p  q </pre>tail</div></div><p>last"""
    assert own(page) == "\n\n".join(["A & B C", "one two three bold x", "four < five <b> link", "six", "seven e", "c1", "c2", "c3", "p q", "tail"])
    assert own("<p>a<p>b") == "a\n\nb"
    assert own("plain &amp text") == "plain & text"
    assert own("<p>kept</p><!-- open <p>gone</p>") == "kept"
    assert own("<p>kept</p><script>gone <p>gone</p>") == "kept"
    assert own("<p>kept</p><a href=\"gone <p>gone</p>") == "kept"
    assert [own(x) for x in ("", " \n ", "<p> </p>", "<nav>x</nav>")] == ["", "", "", ""]


def test_boilerplate_goes_and_the_article_stays():
    body = "<p>%s</p>" % ("A long enough sentence of the article, with commas. " * 6).strip()
    text = re.sub("<[^>]+>", "", body)
    noise = [
        "<header><a>Logo</a> Site header</header>", "<nav><ul><li><a>menu</a></li></ul></nav>", "<aside><p>side %s</p></aside>" % text, "<footer>foot</footer>",
        "<div class='cookie-notice'><p>We use cookies</p></div>", "<div id='sidebar-left'><p>side</p></div>", "<form><input><label>Name</label><p>form</p></form>",
        "<section class='comments'><article class='comment'><p>first! %s</p></article></section>" % text, "<div class='ad'>buy %s</div>" % text,
        "<div role='dialog'><p>sign in</p></div>", "<noscript>no js</noscript>", "<div hidden><p>hidden</p></div>", "<ul class='share-buttons'><li>tweet</li></ul>",
    ]
    rnd = random.Random(2)
    for _ in range(40):
        rnd.shuffle(noise)
        k = rnd.randrange(len(noise))
        inner = "".join(rnd.sample(noise, 4))
        page = f"<html><body class='no-sidebar'>{''.join(noise[:k])}<div class='wrap'><article class='post has-comments'><h1>Title</h1>{body}{inner.replace('<header>', '<aside>').replace('</header>', '</aside>')}{body}</article></div>{''.join(noise[k:])}</body></html>"
        assert own(page) == f"Title\n\n{text}\n\n{text}"
    assert own(f"<form id=aspnet><div class=menu>m</div><article><header><h1>T</h1><p>by me</p></header>{body}</article></form>") == f"T\n\n{text}"


def test_votes_override_a_misleading_page(spark):
    long, short = "Many words of text, more and more of them. " * 20, "A short but real text."
    page = "<body><div class='box n{0}'><p>{1}</p></div><div class='body-part p{0}'><p>{2}</p></div></body>"
    rows = [(i, f"http://Host.example/{i}", page.format(i, "Legal words. ", long + str(i))) for i in range(9)]
    rows += [(9, "https://host.example", page.format(9, long, short)), (10, None, page.format(3, long, short)), (11, "no host", page.format(3, long, short)),
             (12, "http://other.example/", page.format(1, long, short)), (13, "http://host.example/x", None), (13, "http://host.example/x", ""),
             (14, "http://host.example/y", "<article><p>another template</p></article>")]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, text string, host int").repartition(4)
    paths = host_paths(pages).where("host = 'host.example' AND rank = 1").collect()
    assert [(r["path"], r["votes"]) for r in paths] == [("div.body-part.p0", 9)]
    got = sorted((r["page_id"], r["url"], r["text"], r["n_chars"]) for r in main_text(pages).collect() if r["url"] is not None)
    texts = {i: t for i, _, t, _ in got}
    assert all(n == len(t) for _, _, t, n in got) and len(got) == len(rows) - 1
    assert [texts[i] for i in range(9)] == [(long + str(i)) for i in range(9)]
    assert texts[9] == short and texts[11] == texts[12] == long.strip() and texts[13] == "" and texts[14] == "another template"
    assert [t for i, _, t, _ in got if i == 13] == ["", ""]


def test_empty_tables_and_extreme_pages(spark):
    assert main_text(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
    deep = "<div>" * 20_000 + "<p>down here</p>" + "<b>" * 20_000 + "x" + "</q>" * 20_000
    wide = "<p>é &amp; ü " * 50_000
    marks = "<a \"" * 20_000 + "<!--" * 20_000
    got = {r["page_id"]: r["text"] for r in main_text(spark.createDataFrame([(1, "u://h", deep), (2, "u://h", wide), (3, "u://h", marks)], "page_id long, url string, html string")).collect()}
    assert got[1] == "down here\n\nx" and got[2] == "\n\n".join(["é & ü"] * 50_000) and got[3] == ""


def test_given_pages_hold_their_article(spark):
    """The article of the test pages, read by a pattern that knows their layout."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r["text"] for r in main_text(pages).collect()}
    for r in pages.collect():
        inner = re.search("<article>(.*?)</article>", r["html"], re.S).group(1)
        blocks = [" ".join(html.unescape(re.sub("<br>", " ", re.sub("</?b>", "", b))).split()) for b in re.split("</?(?:p|h1)>", inner)]
        assert got[r["page_id"]] == "\n\n".join(b for b in blocks if b)
