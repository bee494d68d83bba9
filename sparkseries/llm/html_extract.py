"""Main text of web pages: flat text blocks classified by a decision tree.

A page is cut into flat blocks at block-level tags.  Each block is described by
its number of words and link density, those of the block before and after it, and
where it stands (inside an article, inside an element for menus, footers, forms and
the like, or inside a container that names itself so).  A decision tree (CART, Gini
impurity) trained on the labelled blocks of ``LABELLED_PAGES`` says which blocks
are article text.

One streaming pass, no shuffle; a page is all that is held at once, and reading it
takes time in proportion to its length, however deep its elements are nested.

Defined cases: null or empty html gives empty text; elements that the attributes
hidden, aria-hidden or style hide are dropped; a head, and hidden paragraphs, items
and cells, may lack their end tag as HTML allows; other unclosed tags, comments and
truncated pages end with the page; character references are decoded as browsers
do, also without semicolon; repeated rows each get a row; null ids and urls stay
null; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import ship_package

# Names of HTML elements by their role.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
DROPPED_TAGS = frozenset("script style noscript template head title iframe object svg canvas select button textarea audio video".split())
RAW_TAGS = frozenset("script style textarea title".split())
BOILER_TAGS = frozenset("nav footer header aside form menu dialog".split())
ARTICLE_TAGS = frozenset("article main".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Words in class, id and role attributes that name what a container holds.
BOILER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion menu nav navbar navigation breadcrumb breadcrumbs sidebar side widget comment comments reply replies respond discussion disqus cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations footer header masthead toolbar pagination pager copyright disclaimer legal search form contentinfo complementary dialog skip".split()
)
#: Of those, the ones that say so at the beginning of a name as well ("ad-slot", but not "social-issue").
FIRST_WORDS = BOILER_WORDS - frozenset("banner side widget discussion notice notices alert social share sharing legal search form header skip promo promotion signup login discuss reply replies respond dialog disclaimer copyright".split())
#: Words that name the kind of container only; they say nothing at the end of a name ("comment-body").
CONTAINER_WORDS = frozenset("area bar block body bottom box button buttons center col column container content footer grid group header holder inner item items left links list main menu outer panel right row section slot text top unit wrap wrapper zone".split())
ARTICLE_WORDS = frozenset("article articlebody content post entry story main".split())

# What may stand in a head, and whose end tag may be left out before which start tag.
HEAD_TAGS = frozenset("base basefont bgsound link meta noframes noscript script style template title html head".split())
TABLE_PARTS = frozenset("table thead tbody tfoot tr td th caption".split())
_CELLS, _ROWS = frozenset(["td", "th"]), frozenset("thead tbody tfoot tr td th".split())
IMPLIED_ENDS = {"li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "td": _CELLS, "th": _CELLS, "tr": _CELLS | {"tr"}, "thead": _ROWS, "tbody": _ROWS, "tfoot": _ROWS}

_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)", re.S)
_LOOSE = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HEAD_GAP = re.compile(r"(?:\s+|<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z))*+", re.S)
_ANY_ATTR = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_MAY_HIDE = re.compile(r"hidden|style", re.I)
_NO_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
_WORD = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+")
_VALUE_SLASH = re.compile(r"=\s*[^\s\"']+\Z")
_SPACE = re.compile(r"\s+")


def _names_boilerplate(name: str) -> bool:
    """Whether a class or id says that its element holds no article: by its first word or its last telling one."""
    words = [w.lower() for w in _WORD.findall(name)]
    words = [w for w in words if not w.isdigit()]
    last = next((w for w in reversed(words) if w not in CONTAINER_WORDS), words[-1] if words else "")
    return last in BOILER_WORDS or (words[:1] and words[0] in FIRST_WORDS)


#: What an element says of the blocks in it.
NOTHING, BOILER, ARTICLE, NAMED, HEADER = range(5)


def _role(tag: str, attrs: str) -> int:
    """BOILER by its tag, NAMED boilerplate by its names, ARTICLE, HEADER, or NOTHING."""
    if tag in ("html", "body"):
        return NOTHING
    names = [n for _, a, b, c in _ATTR.findall(attrs) for n in (a or b or c).split()] if "=" in attrs else []
    article = tag in ARTICLE_TAGS or any(w.lower() in ARTICLE_WORDS for n in names for w in _WORD.findall(n))
    if any(map(_names_boilerplate, names)) and not (tag == "header" and all(_WORD.findall(n.lower()) == ["header"] or not _names_boilerplate(n) for n in names)):
        return NAMED
    if tag == "header":
        return HEADER
    return BOILER if tag in BOILER_TAGS else ARTICLE if article else NOTHING


def _empty(name: str, attrs: str) -> bool:
    """Whether a start tag ends its element as well; a slash may belong to a value, and some elements ignore it."""
    return attrs.endswith("/") and name not in RAW_TAGS and not _VALUE_SLASH.search(attrs)


def _hides(attrs: str) -> bool:
    """Whether the attributes hidden, aria-hidden or style hide an element; of a repeated one the first counts."""
    if not _MAY_HIDE.search(attrs):
        return False
    found: dict[str, str] = {}
    for name, a, b, c in _ANY_ATTR.findall(attrs):
        found.setdefault(name.lower(), html_lib.unescape(a or b or c))
    return "hidden" in found or found.get("aria-hidden", "").strip().lower() == "true" or bool(_NO_DISPLAY.search(found.get("style", "")))


def blocks(page: str) -> list[dict]:
    """The flat text blocks of a page, in order: text, words, linked words, tag, where it stands."""
    out: list[dict] = []
    text: list[str] = []
    linked: list[str] = []
    # Open block-level elements: tag, where a block in it stands, whether some article is around it.
    stack: list[tuple[str, int, bool]] = []
    open_ = Counter()
    state = {"a": 0, "tag": "body"}

    def push(tag: str, role: int) -> None:
        _, place, article = stack[-1] if stack else ("", NOTHING, False)
        if role == HEADER:  # a header counts unless it heads an article
            role = NOTHING if article else BOILER
        stack.append((tag, role or place, article or role == ARTICLE))
        open_[tag] += 1

    def pop() -> str:
        tag = stack.pop()[0]
        open_[tag] -= 1
        return tag

    def flush() -> None:
        if text:
            t = _SPACE.sub(" ", html_lib.unescape("".join(text))).strip()
            if t:
                n_linked = len(html_lib.unescape(" ".join(linked)).split())
                n = len(t.split(" "))
                out.append({"text": t, "words": n, "density": min(1.0, n_linked / n), "tag": state["tag"], "place": stack[-1][1] if stack else NOTHING})
        text.clear()
        linked.clear()

    at, size = 0, len(page)
    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            lt = size
        if lt > at:
            text.append(page[at:lt])
            if state["a"]:
                linked.append(page[at:lt])
        if lt == size:
            break
        m = _MARKUP.match(page, lt) or _LOOSE.match(page, lt)
        if not m:  # a lone "<" is text
            text.append("<")
            at = lt + 1
            continue
        at = m.end()
        name = (m.group(2) or "").lower()
        if not name:
            continue
        closing, attrs = bool(m.group(1)), m.group(3) or ""
        if name in DROPPED_TAGS:
            if not closing and not _empty(name, attrs):
                flush()
                at = _end_of_head(page, at) if name == "head" else _end_of(page, name, at)
            continue
        if not closing and name not in VOID_TAGS and _hides(attrs):
            if not _empty(name, attrs):
                flush()
                while name in BLOCK_TAGS and stack and _implied(stack[-1][0], name):
                    pop()
                    state["a"] = 0
                state["tag"] = stack[-1][0] if stack else "body"
                at = _end_of_hidden(page, name, at, open_, stack[-1][0] if stack else "")
            continue
        if name == "a":
            state["a"] = 0 if closing else 1
        if name == "br":
            text.append(" ")
        if name not in BLOCK_TAGS:
            continue
        flush()
        state["a"] = 0
        if closing:
            if open_[name]:
                while pop() != name:
                    pass
            state["tag"] = stack[-1][0] if stack else "body"
        elif name not in VOID_TAGS:
            if name in ("p", "li", "dt", "dd", "tr", "td", "th") and stack and stack[-1][0] == name:
                pop()  # its end tag was left out
            elif stack and stack[-1][0] == "p":
                pop()  # no block stands inside a paragraph
            push(name, _role(name, attrs))
            state["tag"] = name
    flush()
    return out


def _end_of(page: str, name: str, at: int) -> int:
    """Where a dropped element ends; nested ones of the same name count."""
    depth = 1
    for m in re.compile(rf"<(/?){re.escape(name)}\b[^>]*(?:>|\Z)", re.I).finditer(page, at):
        if name in ("script", "style", "textarea", "title") and not m.group(1):
            continue
        depth += -1 if m.group(1) else (0 if m.group(0).endswith("/>") else 1)
        if depth == 0:
            return m.end()
    return len(page)


def _implied(open_: str, name: str) -> bool:
    """Whether the start of a block-level element ends an open one whose end tag was left out."""
    return open_ == "p" or open_ in IMPLIED_ENDS.get(name, ())


def _tags(page: str, at: int):
    """(start, end, closing, name, attributes) of the tags from ``at``; dropped elements count as one tag, heads and comments as none."""
    while (lt := page.find("<", at)) >= 0:
        m = _MARKUP.match(page, lt) or _LOOSE.match(page, lt)
        at = m.end() if m else lt + 1
        name = ((m and m.group(2)) or "").lower()
        if not name:
            continue
        closing, attrs = bool(m.group(1)), m.group(3) or ""
        if name in DROPPED_TAGS and name != "head" and not closing and not _empty(name, attrs):
            at = _end_of(page, name, at)
        yield lt, at, closing, name, attrs


def _end_of_head(page: str, at: int) -> int:
    """Where a head ends: at its end tag, or where the first thing stands that no head holds."""
    for start, end, closing, name, _ in _tags(page, at):
        text = _HEAD_GAP.match(page, at, start).end()
        if text < start:
            return text
        if closing and name == "head":
            return end
        if (name in ("body", "html", "br")) if closing else (name not in HEAD_TAGS):
            return start
        at = end
    return _HEAD_GAP.match(page, at).end()


def _end_of_hidden(page: str, name: str, at: int, around: Counter, parent: str) -> int:
    """Where a hidden element ends: at its end tag, or where one that was left out is implied.

    ``around`` counts the block-level elements around it, of which ``parent`` is the
    innermost; the end of one of them ends it too.
    """
    stack, inside = [name], Counter([name])
    n_blocks = int(name in BLOCK_TAGS)  # of the stack

    def pop() -> str:
        nonlocal n_blocks
        top = stack.pop()
        inside[top] -= 1
        n_blocks -= top in BLOCK_TAGS
        return top

    for start, end, closing, tag, attrs in _tags(page, at):
        if tag != name and tag not in BLOCK_TAGS:
            continue
        if closing:
            if inside[tag]:
                while pop() != tag:
                    pass
                if not stack:
                    return end
            elif around[tag]:
                fence = {"table"} if tag in TABLE_PARTS else TABLE_PARTS | {"ul", "ol"} if tag == "li" else TABLE_PARTS
                if not any(inside[t] for t in fence):
                    return start
            continue
        if tag in BLOCK_TAGS:
            if not n_blocks and parent and _implied(parent, tag):
                return start
            while stack and stack[-1] in BLOCK_TAGS and _implied(stack[-1], tag):
                pop()
            if not stack:
                return start
        if tag not in VOID_TAGS and not _empty(tag, attrs):
            stack.append(tag)
            inside[tag] += 1
            n_blocks += tag in BLOCK_TAGS
    return len(page)


FEATURES = ("words", "density", "words_before", "density_before", "words_after", "density_after", "boiler", "named", "article", "heading", "item")


def describe(found: list[dict]) -> list[tuple]:
    """Feature vectors of a page's blocks, in the order of FEATURES."""
    out = []
    for i, b in enumerate(found):
        before = found[i - 1] if i else {"words": 0, "density": 0.0}
        after = found[i + 1] if i + 1 < len(found) else {"words": 0, "density": 0.0}
        out.append(
            (
                b["words"], b["density"], before["words"], before["density"], after["words"], after["density"],
                int(b["place"] == BOILER), int(b["place"] == NAMED), int(b["place"] == ARTICLE), int(b["tag"][0] == "h" and b["tag"][1:].isdigit()), int(b["tag"] in ("li", "td", "th", "dt", "dd")),
            )
        )
    return out


#: The labelled table, written as pages: a block that begins with [1] is article text, one with [0] is not.
LABELLED_PAGES = (
    """<nav><ul><li><a href=#>[0] Home</a></li><li><a href=#>[0] World news</a></li></ul></nav><div class="ad">[0] Buy the new phone today and save ten</div>
    <article><h1>[1] Rain floods the valley</h1><p>[1] After three days of rain the river left its bed and reached the first houses of the town.</p><p>[1] Nobody was hurt.</p>
    <p>[1] The mayor thanked <a href=#>the volunteers</a> who carried sand until late at night.</p></article><footer>[0] &copy; The Valley Post, all rights reserved</footer>""",
    """<header><div>[0] The Daily Example</div><a href=#>[0] Sign in</a></header><main><h1>[1] How bread rises</h1><p>[1] Yeast eats sugar and gives off gas.</p>
    <ul><li>[1] Flour</li><li>[1] Water, warm but not hot</li></ul><p>[1] Leave the dough alone for two hours, in a warm place without a draught, until it has doubled.</p></main>
    <aside><h3>[0] Most read</h3><ul><li><a href=#>[0] Ten ways to slice an onion</a></li></ul></aside><section id="comments"><h2>[0] Comments</h2><p>[0] I tried this and my bread was as flat as a board, what did I do wrong there?</p><p>[0] Great!</p></section>""",
    """<div id="cookie-notice"><p>[0] We use cookies to make this site better for everyone who visits it. By going on you agree.</p></div><div><div><p>[1] The old bridge was built in the year of the great fire, of oak from the hills.</p>
    <p>[1] It stood.</p><p>[1] Two hundred years later the town council voted to replace it with one of steel and stone.</p></div></div><div><a href=#>[0] About us</a> <a href=#>Contact</a> <a href=#>Terms of use</a></div>""",
    """<div class="sidebar"><p>[0] Our writer has lived in the mountains for thirty years and keeps bees, goats and a diary.</p></div><div class="entry-content"><h2>[1] Spring</h2><p>[1] The snow goes first from the south side of the roof.</p>
    <blockquote>[1] It never lasts</blockquote><p>[1] Then the bees come out.</p></div><form><p>[0] Subscribe to our letter and get one story a week for free</p><label>[0] Your address</label></form>""",
    """<div>[0] <a href=#>Home</a> | <a href=#>Shop</a> | <a href=#>Help</a></div><h1>[1] Notes on tides</h1><p>[1] The moon pulls the sea, and the sea follows it around the world a little late, held back by land.</p><p>[1] Twice a day it comes back to where it was.</p><div>[0] <a href=#>Earlier</a> <a href=#>Later</a></div><p>[0] Copyright notice</p>""",
    """<table><tr><td class="menu"><a href=#>[0] Index</a></td><td><p>[1] Long before there were maps of this coast, sailors kept its rocks in verse and taught them to their sons.</p><p>[1] Some of the verses are still sung in the harbour on feast days, to the tune of a hymn.</p></td></tr></table><div class="footer"><p>[0] Printed from our archive with kind permission of the heirs and the library.</p></div>""",
    """<article><header><h1>[1] A short walk</h1></header><p>[1] We went up.</p><aside class="related">[0] Read also: <a href=#>a long walk in the rain</a></aside><p>[1] We came down again before dark, tired, wet and very pleased with ourselves and the dog.</p><div class="share">[0] Share this with friends</div><footer><p>[0] Filed under walks</p></footer></article>""",
    """<div role="navigation"><p>[0] You are here: news</p></div><div role="alert">[0] Our site will be closed for repairs on Sunday from two until four in the morning</div><section class="post"><h1>[1] Opening hours of the sky</h1><p>[1] Stars are best seen away from the town, an hour after the sun has set, with your back to the moon.</p><h3>[1] In winter</h3><p>[1] Dress warmly.</p></section>""",
    """<p>[1] Short note.</p><p>[1] It will rain tomorrow, they say.</p><ul><li>[1] Apples</li><li>[1] Pears, if there are any</li></ul><p>[1] Bring the big basket.</p><div>[0] <a href=#>Home</a> <a href=#>Archive</a> <a href=#>Feed</a></div>""",
    """<div>[0] <a href=#>News</a> <a href=#>Sport</a> <a href=#>Weather</a></div><h1>[1] A mill for sale</h1><div>[1] The mill by the lower ford has stood empty since its last owner moved to the coast.</div><div>[1] Its wheel still turns.</div><div>[1] Whoever buys it must keep <a href=#>the fish ladder</a> in order and leave the weir as it is.</div><div>[0] <a href=#>Previous post</a></div><div>[0] <a href=#>Next post: a barn for rent</a></div><p>[0] <a href=#>Back to the top of this page</a></p>""",
    """<div id="top-menu"><span>[0] Welcome, guest of the house</span></div><div class="page"><p>[1] Clay is dug in autumn and left in heaps all winter, so that frost breaks it up.</p><p>[1] In spring it is trodden.</p><p>[1] Then it rests.</p></div><div id="footer-wrap"><p>[0] This paper is read in forty towns and has been printed every week since the war.</p><p>[0] Write to us.</p></div>""",
    """<header><p>[0] The paper for people who like to read slowly and to the end</p></header><article><h2>[1] Snow</h2><p>[1] <a href=#>The weather office</a> warns of drifts.</p><ul><li><a href=#>[1] Road closures</a></li><li><a href=#>[1] School bus times in the upper valley</a></li></ul><figure><figcaption>[1] The pass on Monday</figcaption></figure><form><label>[0] Your mail address</label><p>[0] Get this by mail every morning before you leave the house</p></form><p>[1] More snow falls tonight, first above the trees and later in the villages as well.</p></article>""",
    """<article><h1>[1] Chess for two</h1><p>[1] Move.</p><p>[1] Wait.</p><p>[1] Move again, and do not look at the clock while your friend is thinking about the answer.</p></article><div class="comments-area"><h3>[0] Two replies</h3><article class="comment"><p>[0] My father taught me this game in a railway station when our train was six hours late.</p></article><article class="comment"><p>[0] Nice.</p></article></div>""",
    """<main><h1>[1] Prices</h1><p>[1] All prices are those of the weekly market and hold until the next one.</p><table><tr><th>[1] Ware</th><th>[1] Price</th></tr><tr><td>[1] Eggs, a dozen</td><td>[1] 4</td></tr><tr><td>[1] Butter</td><td>[1] 7</td></tr></table></main><div class="social-links"><p>[0] Follow the market wherever you happen to be</p></div><div class="ad-slot"><p>[0] Try our new honey, gathered on the hills and sold by the spoon</p><p>[0] Now.</p></div>""",
    """<div><p>[1] Nobody knows who planted the seven limes on the hill, or when, or why there are seven of them.</p><p>[1] They are old.</p></div><div><ul><li><a href=#>[0] Limes and lindens of the whole north</a></li><li><a href=#>[0] Trees you can climb</a></li><li><a href=#>[0] Contact</a></li></ul></div><div>[0] <a href=#>Log in</a></div>""",
    """<div class="breadcrumbs">[0] You are in: gardens</div><section><h2>[1] Beans</h2><p>[1] Sow them when the soil is warm to the hand.</p><p>[1] Water twice a day in the first week and only once after that.</p><h3>[1] Poles</h3><p>[1] Two metres.</p></section><section class="newsletter"><h2>[0] Letters from the garden</h2><p>[0] Leave your address and we will send you a letter on the first of the month.</p></section><div class="cookie-banner"><p>[0] This site keeps a cookie so that it knows you.</p><button>OK</button></div>""",
    """<div class="article-body"><p>[1] <a href=#>The council</a> <a href=#>met</a> on Tuesday.</p><p>[1] It was over in ten minutes because nobody had brought the papers for the second point.</p><p>[1] <a href=#>See the minutes</a></p></div><div class="widget"><p>[0] About me: I write about this town and the people who run it, mostly at night.</p></div><div class="related-posts"><p>[0] What the council did last year, and what it did not do at all</p></div><aside><p>[0] In this place we print what readers send us, without any change and without pay.</p></aside>""",
    """<div>[0] Tuesday edition</div><div>[0] Two coins</div><div>[0] <a href=#>Home</a> <a href=#>Town</a></div><div>[1] The clock on the market tower stopped at ten past four and nobody has dared to climb up to it since.</div><div>[1] It was made by a smith.</div><div>[1] He used the wheels of an old pump, three bells and the weight of a fishing boat.</div><div>[0] <a href=#>More from this town</a></div><div>[0] Page 3</div><div>[0] Printed here</div>""",
    """<div>[0] Search</div><div>[0] Contact</div><div>[0] <a href=#>Shop</a></div><div>[1] Wool from the first shearing is soft and short, and most of it goes to the spinners in the next valley.</div><div>[1] What is left is felted.</div><div>[1] Felt keeps out the wind better than cloth does, and a coat of it lasts for as long as its owner.</div><div>[0] <a href=#>Prices of wool</a></div><div>[0] Call us</div><div>[0] Open daily</div>""",
    """<div>[0] <a href=#>Forum</a></div><div>[0] Guest</div><div>[0] Page 2</div><div>[1] Has anyone here ever tried to keep ducks and geese in the same yard without a fence between the two of them?</div><div>[1] Mine fight.</div><div>[1] They begin at dawn, when the first of them finds the gate shut, and go on until it is opened.</div><div>[0] <a href=#>Answer this question</a> <a href=#>Quote</a></div><div>[0] Members online</div><div>[0] Imprint</div>""",
    """<p>[1] Closed today.</p>""",
    """<div>[1] We have moved to the new house.</div>""",
    """<p>[1] This page has no frame at all, only two paragraphs that somebody wrote down one evening and put on a server.</p><p>[1] This is the second, and it is a little longer than the first one so that there is something to read here.</p>""",
    """<ul><li><a href=#>[0] One</a></li><li><a href=#>[0] Two words</a></li><li><a href=#>[0] Three words here</a></li></ul><div class="promo"><p>[0] Members save a quarter on every order placed before the end of the month, so join today.</p></div><article><p>[1] No.</p><p>[1] That was the whole answer that the minister gave when asked by this paper.</p><ul><li><a href=#>[1] The question in full</a></li></ul></article>""",
)


def _gini(ones: int, n: int) -> float:
    p = ones / n
    return 2 * p * (1 - p)


def grow(rows: list[tuple[tuple, int]], depth: int = 8, least: int = 3):
    """A decision tree: an answer (0 or 1) or (feature, cut, tree for <= cut, tree for > cut)."""
    ones, n = sum(y for _, y in rows), len(rows)
    if depth == 0 or ones in (0, n):
        return int(2 * ones >= n)
    best = None
    for f in range(len(FEATURES)):
        values = sorted({x[f] for x, _ in rows})
        for a, b in zip(values, values[1:]):
            cut = (a + b) / 2
            left = [y for x, y in rows if x[f] <= cut]
            m = len(left)
            if min(m, n - m) < least:
                continue
            k = sum(left)
            cost = m * _gini(k, m) + (n - m) * _gini(ones - k, n - m)
            if best is None or cost < best[0] - 1e-9:
                best = (cost, f, cut)
    if best is None:
        return int(2 * ones >= n)
    _, f, cut = best
    return f, cut, grow([r for r in rows if r[0][f] <= cut], depth - 1, least), grow([r for r in rows if r[0][f] > cut], depth - 1, least)


def answer(tree, x: tuple) -> int:
    while not isinstance(tree, int):
        f, cut, low, high = tree
        tree = low if x[f] <= cut else high
    return tree


def labelled_rows(pages: tuple[str, ...] = LABELLED_PAGES) -> list[tuple[tuple, int]]:
    rows = []
    for page in pages:
        found = blocks(page)
        labels = [int(b["text"][1]) for b in found]
        for b in found:  # the mark is one word
            b["words"] -= 1
        rows += list(zip(describe(found), labels))
    return rows


_tree: list = []


def main_text(page: str | None) -> str:
    """The article text of one page; blocks are separated by an empty line."""
    if not page:
        return ""
    if not _tree:
        _tree.append(grow(labelled_rows()))
    found = blocks(page)
    return "\n\n".join(b["text"] for b, x in zip(found, describe(found)) if answer(_tree[0], x))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(h.as_py()) for h in batch.column("html")]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract_main_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: page_id, url, text and n_chars (its code points)."""
    ship_package(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(_extract, "page_id long, url string, text string, n_chars long").withColumnRenamed("page_id", id_col)
