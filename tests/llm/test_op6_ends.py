import pytest

import sparkseries.llm.html_extract as m

REAL = "Real text that stands in the page and is long enough to be read as a paragraph of it."


def texts(page):
    return " ".join(b["text"] for b in m.blocks(page))


@pytest.mark.parametrize("attrs", ['title="a hidden gem"', 'class="x hidden y"', "title='aria-hidden=true'", 'data-x="display: none"', 'data-hidden="1"', 'style="color:red" title=";display:none"', 'aria-hidden="false"', 'alt="truehidden"'])
def test_hidden_as_a_word_drops_nothing(attrs):
    assert texts(f"<div {attrs}><p>{REAL}</p></div>") == REAL


@pytest.mark.parametrize("attrs", ["hidden", 'HIDDEN=""', "class=a hidden", "aria-hidden=true", "aria-hidden = 'TRUE'", 'style="color:red; DISPLAY : none"', 'hidden="until-found"'])
def test_hidden_elements_go(attrs):
    assert texts(f"<div {attrs}><p>x</p><div>y</div></div><p>{REAL}</p>") == REAL


@pytest.mark.parametrize(
    "page",
    [
        "<html><head><title>T</title><meta charset=utf-8><body><p>{}</p></body></html>",
        "<html><head><script>x('<p>no</p>')</script><style>p > a {{}}</style><!-- <p>no</p> --><p>{}</p>",
        "<head><title>T</title>{}",
        "<head><title>T</title></head><p>{}",
        "<p hidden>x<p>{}</p>",
        "<p hidden>x<div>{}</div>",
        "<div><p hidden>x</div><p>{}</p>",
        "<ul><li hidden>x<ul><li>y</ul>z<li>{}</ul>",
        "<ul><li hidden><p>x<li>{}</ul>",
        "<table><tr><td hidden>x<td>{}</table>",
        "<table><tr><td hidden>x<tr><td>{}</table>",
        "<table><tr hidden><td>x<td>y<tr><td>{}</table>",
        "<dl><dt hidden>x<dd>{}</dl>",
        "<p><span hidden>x<p>{}</p>",
        "<p><span hidden>x<span>y</span>z</span>{}</p>",
        "<div hidden><p>x<script>'</div>'</script><div>y</div>z</div>{}",
        "<table><tr><td><table hidden><tr><td>x</td></tr></table>{}</td></tr></table>",
        "<ul><li><ul hidden><li>x</li></li></ul>{}</ul>",
    ],
)
def test_left_out_end_tags(page):
    assert texts(page.format(REAL)) == REAL


def test_many_open_elements():
    assert texts("<span hidden>" * 20_000 + "<p>x" * 20_000) == ""
    assert texts("<p hidden>x" * 20_000 + f"<p>{REAL}") == REAL
