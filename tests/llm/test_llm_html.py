import numpy as np
import pytest

from loci.llm import html_extract as h
from loci.llm.common import prepare

PROSE = "The quick brown fox jumps over the lazy dog near the river. It was a fine day for all of them."


def page(i, body_tag="article"):
    menu = "".join(f"<li><a href='/{k}'>Link {k}</a></li>" for k in range(4 + i % 3))
    return (
        f"<!DOCTYPE html><html><head><title>T{i}</title><style>p{{}}</style><script>var x='</p>{i}';</script></head><body><nav><ul>{menu}</ul></nav>"
        f"<div class='ad'>Buy this now. It is cheap.</div><{body_tag}><h1>Title {i} &amp; more</h1><p>First {i}: {PROSE}<br>line\n  two&nbsp;x</p><p>{PROSE} <b>bold</b></{body_tag}>"
        f"<footer>© site {i} · all rights</footer></body></html>"
    )


def wanted(i):
    return f"Title {i} & more\n\nFirst {i}: {PROSE} line two x\n\n{PROSE} bold"


@pytest.fixture(scope="module")
def chain():
    sample = []
    for i in range(40):
        found = h.blocks(page(i))
        sample.append((found, h.labels_of(found)))
    return h.train(sample)


def test_extract(chain):
    for i in (3, 77):
        assert h.extract(page(i), chain) == wanted(i)
        assert h.extract(page(i, "div"), chain) == wanted(i)


def test_boilerplate_of_many_kinds(chain):
    html = (
        f"<body><header class='site'><p>Welcome. {PROSE}</p></header><div id='cookie-notice'><p>We use cookies. {PROSE}</p></div><div><h1>Story</h1><p>{PROSE}</p><p>{PROSE} Again.</p></div>"
        f"<aside><p>Related: {PROSE}</p></aside><form><p>Your mail? {PROSE}</p></form><div class='comments'><p>I like it. {PROSE}</p></div><footer><p>{PROSE}</p></footer></body>"
    )
    assert h.extract(html, chain) == f"Story\n\n{PROSE}\n\n{PROSE} Again."


@pytest.mark.parametrize(("html", "texts"), [
    (None, []), ("", []), ("plain", ["plain"]), ("<div", []), ("a < b <p>c", ["a < b", "c"]), ("<p>a<script>x<p></script>b<!-- <p> --> c", ["ab c"]),
    ("<style>x", []), ("<p title='>'>q&lt;b&gt;&#233;&amp;amp;</p>", ["q<b>é&amp;"]), ("<ul><li>a<li>b</ul>c", ["a", "b", "c"]), ("<p hidden>no</p><p style='display:none'>no</p>yes", ["yes"]),
    ("</div>x</p>y", ["x", "y"]), ("<b>" * 500 + "deep", ["deep"]), ("<p>" + "long " * 50_000, [("long " * 50_000).strip()]), ("<table><tr><td>a<td>b<tr><td>c</table>", ["a", "b", "c"]),
])
def test_blocks(html, texts):
    assert [b.text for b in h.blocks(html)] == texts


def test_decoding_and_gradient_match_enumeration():
    draw = np.random.default_rng(0)
    chain = h.Chain(draw.normal(size=(h.WIDTH, 2)), draw.normal(size=(2, 2)))
    page_features = [draw.integers(0, 50, 4) for _ in range(5)]
    own = chain.scores(page_features)
    paths = [[(k >> t) & 1 for t in range(5)] for k in range(32)]
    scores = np.array([sum(own[t, y] for t, y in enumerate(p)) + sum(chain.moves[a, b] for a, b in zip(p, p[1:])) for p in paths])
    assert chain.decode(page_features).tolist() == paths[int(scores.argmax())]
    truth = np.array([0, 1, 1, 0, 1])
    chance = np.exp(scores - np.logaddexp.reduce(scores))
    blocks_off, moves_off = chain.gradient(page_features, truth)
    for t in range(5):
        assert blocks_off[t, 1] == pytest.approx(truth[t] - sum(c for c, p in zip(chance, paths, strict=True) if p[t] == 1))
    expected = sum(c * sum((a, b) == (1, 0) for a, b in zip(p, p[1:])) for c, p in zip(chance, paths, strict=True))
    assert moves_off[1, 0] == pytest.approx(1 - expected)


def test_table(spark):
    prepare(spark)
    rows = [(i, f"http://x/{i}", page(i)) for i in range(30)] + [(100, None, None), (101, "u", ""), (None, "u", page(3)), (3, "u", page(3)), (102, "u", page(5, "div"))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS text", "2 AS n_chars")
    got = h.extracted(pages).collect()
    assert len(got) == len(rows) and got[0].__fields__ == ["page_id", "url", "text", "n_chars"]
    by = {r["page_id"]: r for r in got}
    assert by[7]["text"] == wanted(7) and by[102]["text"] == wanted(5) and by[7]["n_chars"] == len(wanted(7))
    assert by[100]["text"] == by[101]["text"] == "" and by[100]["n_chars"] == 0
    assert h.extracted(pages.limit(0)).count() == 0
    bare = pages.where("page_id = 102")
    assert h.extracted(bare).first()["text"] == wanted(5)
