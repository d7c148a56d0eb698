"""Page extraction: hand-made pages, gradients, training, edge cases."""

import numpy as np

from corvane.llm import html_lstm as H

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{a:b}</style><script>var t="</p><p>no";</script></head><body>
<header><p>Site name</p></header><nav><ul><li><a href="/a">Home</a><li><a href='/b>'>News</a></ul></nav><!-- <p>no</p> --><div class="cookie-notice"><p>We use cookies.</p></div>
<article><h1>A &amp; B</h1><p>First   para&eacute;graph,
with <b>bold <i>text</b>.<br><p>Second one is here. It goes on.</p><div class="ad">Buy this now.</div><ul><li>point one<li>point two</ul><p hidden>secret</p></article>
<section id="comments"><div class="comment"><p>Great post!</p></div></section><aside><p>Related things</p></aside><form><label>Mail</label><input><button>Go</button></form><footer>&copy; 2024</footer></body></html>"""


def text(page):
    found = H.blocks(page)
    return "\n".join(b[1] for b, m in zip(found, H.label(H.load(), [found])[0], strict=True) if m)


def test_page():
    assert text(PAGE) == "A & B\nFirst paraégraph, with bold text.\nSecond one is here. It goes on.\npoint one\npoint two"


def test_odd_pages():
    assert text(None) == text("") == text("<html></html>") == text("<script>x") == ""
    assert text("<p>unclosed <") is not None and text("<!-- open") == "" and H.blocks("a < b")[0][1] == "a < b"


def test_gradients():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in H.start_weights().items()}
    p["v"] = rng.normal(size=p["v"].shape) * 0.1
    x, mask = rng.normal(size=(4, 3, H.INPUT)), np.array([[1, 1, 1], [1, 1, 1], [1, 1, 0], [1, 0, 0]], float)
    y = rng.integers(0, 2, (4, 3)).astype(float)
    _, g = H.gradients(p, x, mask, y)
    for k in p:
        i = tuple(rng.integers(0, n) for n in p[k].shape)
        e = 1e-3
        old = p[k][i]
        p[k][i] = old + e
        up = H.gradients(p, x, mask, y)[0]
        p[k][i] = old - e
        down = H.gradients(p, x, mask, y)[0]
        p[k][i] = old
        assert abs((up - down) / (2 * e) - g[k][i]) < 2e-4


def test_training_and_accuracy():
    _, losses = H.train(steps=12, batch=6)
    assert np.mean(losses[-3:]) < 0.7 * losses[0]
    p, rng, wrong, total = H.load(), np.random.default_rng(77), 0, 0
    for _ in range(40):
        x, y = H.made_sample(rng)
        a, m = H._pad([x])
        wrong += int(((H.forward(p, a, m)[:, 0] > 0) != y).sum())
        total += len(y)
    assert wrong < 0.02 * total


def test_batches_agree(spark):
    pages = [(i, f"u{i}", p, "x") for i, p in enumerate([PAGE, None, "", PAGE, "<article><p>" + "long words " * 20_000 + "</p></article>", "<p>x</p>" * 3])]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, text string")
    got = {r["page_id"]: r for r in H.extract(df).collect()}
    assert len(got) == 6 and got[0]["text"] == got[3]["text"] == text(PAGE) and got[1]["text"] == "" and got[1]["n_chars"] == 0
    assert got[4]["n_chars"] == len(("long words " * 20_000).strip()) and H.extract(df.limit(0)).count() == 0


def test_markup_inside_scripts():
    words = lambda page: [b[1] for b in H.blocks(page)]
    assert words("<script>for(i=0;i<n;i++){x();}</script><p>ARTICLE</p>") == ["ARTICLE"]
    assert words("<p>a</p><SCRIPT>if(a<b&&c=='\"')<!--x</Script ><p>b</p><style>a<b{}</style><p>c</p><textarea><i title='</textarea><p>d") == ["a", "b", "c", "d"]
    assert words("<template><script>a<b</script><p>x</p></template><p>e</p>") == ["e"]
    assert words("<p>f</p><script>var s='</scripts>';a<b</script><p>g</p>") == ["f", "g"] and words("<p>h</p><script>a<b <p>i</p>") == ["h"]
    assert words("<svg><!-- </svg> --><text>x</text></svg><p>j</p>") == ["j"]


def test_hidden_is_an_attribute():
    kept = ['class="post overflow-hidden"', 'style="overflow:hidden"', "data-hidden", 'aria-hidden="false"', 'data-x="a hidden b"', "class=hidden", "title='display:none'", 'style="--display:none"', 'data-aria-hidden="true"']
    for a in kept:
        assert [b[1] for b in H.blocks(f"<article {a}><p>x</p></article>")] == ["x"], a
    for a in ["hidden", "HIDDEN=''", 'class="a"hidden', "hidden=hidden", 'aria-hidden="true"', "aria-hidden=TRUE", 'style="color:red; DISPLAY : none"', "style=display:none", "hidden/"]:
        assert H.blocks(f"<article {a}><p>x</p></article>") == [], a
