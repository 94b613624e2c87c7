import html
import re

from riskloom.llm import pagetext, queries

LONG = "The dog and the cat sat by the fire for all of the day, and it was warm, so they had no wish to go out. " * 3


def text_of(page):
    return pagetext.main_text(page)[0]


def test_parts_beside_the_article_go():
    page = f"""<html><head><title>t</title><style>p{{}}</style><script>x("</p>")</script></head><body>
      <header>Top of the page</header><nav><a href=/>Home</a></nav><div class="cookie-notice">We use the cookies of it</div>
      <aside>{LONG}</aside><form>Search <input></form>
      <article><header><h1>Head &amp; line</h1></header><p>{LONG}</p><p>Yes.</p>
      <div id="share">tell all of it</div><section class="comments"><p>{LONG}</p></section></article>
      <div class=ad>{LONG}</div><!-- {LONG} --><footer>&copy; us</footer></body></html>"""
    assert text_of(page) == "\n\n".join(["Head & line", " ".join(LONG.split()), "Yes."])


def test_rules_decide_where_there_is_no_article():
    links = "".join(f"<li><a href='/{i}'>Link number {i} of the many links</a></li>" for i in range(9))
    page = f"<div><ul>{links}</ul></div><div><p>{LONG}</p><p>Short.</p><p>{LONG}</p></div><div>{'Zqx ' * 40}</div><div>x</div>"
    assert text_of(page) == "\n\n".join([" ".join(LONG.split()), "Short.", " ".join(LONG.split())])


def test_white_space_breaks_and_references():
    page = "<article><p>a&nbsp;&#98;\n\t c<br>d<b>e</b>f</p><p>g<br><br>h</p>1 &lt; 2 < 3</article>"
    assert text_of(page) == "a b c def\n\ng\n\nh\n\n1 < 2 < 3"


def test_broken_pages():
    assert text_of("") == text_of("<") .replace("<", "") == ""
    assert text_of("<article><p>a <b>b<p>c") == "a b\n\nc"
    assert text_of("<nav>a<article><p>b</article>") == ""
    assert text_of("<script>a") == text_of("<!-- a") == ""
    assert text_of('<article><p title="a > b">c</p></article>') == "c"


def test_marked_inline_elements_end_at_their_own_tag():
    assert text_of('<article><img class="banner" src=x><p>A</p><p>B</p></article>') == "A\n\nB"
    assert text_of('<article><p>One <img class="ad" src=x> two</p><p>B</p></article>') == "One two\n\nB"
    assert text_of('<head><link id="search-css"><body><article><p>A <link class=ad> b</p></article>') == "A b"
    assert text_of('<article><p>One <span class="ad">buy</span> two</p><p>B</p></article>') == "One\n\ntwo\n\nB"
    assert text_of('<article><span class="ad">buy <span>now</span> or never</span><p>A</p></article>') == "A"
    assert text_of('<article><span class="ad"><div>buy</span> now</div></span><p>A</p></article>') == "A"
    assert text_of('<article><span class="ad"><p>buy</span><p>A</p></article>') == "A"
    assert text_of('<article><p>One <i class="ad">buy<p>A</p><div>B</div></article>') == "One\n\nA\n\nB"
    assert text_of('<article><video class="promo">no video</video><p>A</p><label class=social>x</label>B</article>') == "A\n\nB"


POLISH = "Wczoraj wieczorem mieszkańcy miasta zebrali się przed ratuszem, żeby posłuchać koncertu orkiestry dętej. " * 3
CHINESE = "昨天晚上市民们聚集在市政厅前聆听管乐队的演奏，广场上灯火通明，孩子们跑来跑去。" * 4


def test_names_that_only_hold_a_hint():
    body = f"<p>{LONG}</p><p>Yes.</p>"
    want = "\n\n".join([" ".join(LONG.split()), "Yes."])
    for name in ("content has-sidebar", "post no-comments", "research-and-search", "adsorption", "unrelated"):
        assert text_of(f'<div class="{name}"><article>{body}</article></div>') == want
        assert text_of(f'<div class="{name}">{body}</div>') == want
        assert text_of(f'<article><div class="{name}">{body}</div></article>') == want


def test_hints_that_would_hide_the_page():
    body, want = f"<p>{LONG}</p>", " ".join(LONG.split())
    assert text_of(f'<div class="widget"><article>{body}</article></div>') == want
    assert text_of(f'<div class="widget">{body}</div><div class="ad">Buy it now</div>') == want
    # Comments are articles of their own, and longer; the one outside is the page's.
    assert text_of(f'<article>{body}</article><div id="comments"><article>{LONG * 5}</article></div>') == want
    assert text_of(f'<article>{body}<div id="post-comments"><p>{LONG * 5}</p></div></article>') == want


def test_other_languages():
    links = "<ul>" + "".join(f"<li><a href=/{i}>odnośnik {i}</a>" for i in range(9)) + "</ul>"
    for long in (POLISH, CHINESE):
        page = f"<div>{links}</div><div><p>{long}</p><p>Aż.</p><p>{long}</p></div><div>{links}</div><footer>© x</footer>"
        assert text_of(page) == "\n\n".join([long.strip(), "Aż.", long.strip()])


def test_links_and_signs_inside_an_article():
    page = f"<article><p>{LONG}</p><p><a href=/x>the whole of this paragraph is one link to another page of it</a></p><p>© means copyright</p></article>"
    assert text_of(page).split("\n\n")[1:] == ["the whole of this paragraph is one link to another page of it", "© means copyright"]


def test_broken_markup_takes_linear_time():
    import time
    for part in ("<a ", "<!x", '<a "', "<p title='", "<div>", '<span class="ad">', "</b></i>", "<p <p", "<b><div class=ad>"):
        page = (part * (1_000_000 // len(part)))[:1_000_000]
        start = time.perf_counter()
        pagetext.main_text(page)
        assert time.perf_counter() - start < 10, part


def test_clashing_names(spark):
    rows = spark.createDataFrame([(1, "<article>a b</article>", "x", "y", 2)], "page_id long, html string, _page string, Text string, N_GOOD int")
    got = pagetext.extract(rows)
    assert got.columns == ["page_id", "_page", "text", "n_blocks", "n_good"] and tuple(got.first()) == (1, "x", "a b", 1, 1)


def test_pages_give_their_articles(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.page_id: r for r in queries.op5_html(spark, sf).collect()}
    pages = queries.table(spark, sf, "pages").collect()
    assert len(got) == len(pages)
    for page in pages:
        inner = re.search(r"<article>(.*?)</article>", page.html, re.S)[1].replace("<br>", " ")
        parts = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", p)).split()) for p in re.split(r"</?(?:p|h1)>", inner))
        want = "\n\n".join(p for p in parts if p)
        assert (got[page.page_id].url, got[page.page_id].text, got[page.page_id].n_chars) == (page.url, want, len(want))


def test_odd_rows(spark):
    pages = spark.createDataFrame([(1, None, "x", 1), (1, "", "y", 1), (None, "<p>a", None, 1), (2, "<article>" + LONG * 999, "z", 1)],
                                  "page_id long, html string, text string, n_good int")
    rows = pagetext.extract(pages).orderBy("page_id", "n_blocks").collect()
    assert [(r.page_id, len(r.text)) for r in rows] == [(None, 0), (1, 0), (1, 0), (2, len(" ".join((LONG * 999).split())))]
    assert pagetext.extract(pages.limit(0)).count() == 0
