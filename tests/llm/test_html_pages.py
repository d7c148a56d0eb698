"""Pages written and labelled by hand: odd markup, and how many blocks of thirty pages are labelled right."""

from corvane.llm import html_lstm as H


def text(page):
    found = H.blocks(page)
    return "\n".join(b[1] for b, m in zip(found, H.label(H.load(), [found])[0], strict=True) if m)


def leaf(page):
    return [b[1] for b in H.blocks(page)]


def test_scripts_and_raw_text():
    assert leaf("<script>for(i=0;i<n;i++){x('</p>')}</script><p>A</p>") == ["A"]
    assert leaf("<SCRIPT>var a = \"it's <b\"; // '</SCRIPT ><p>A</p>") == ["A"]
    assert leaf("<style>p::before{content:'<div>'}</style><p>A<!-- <script> -->B</p>") == ["AB"]
    assert leaf("<p>A</p><script>x<y") == ["A"] and leaf("<p>A</p><style>x{") == ["A"]
    assert leaf("<script><!-- if (a<b) document.write('<p>no</p>') --></script><p>A</p>") == ["A"]
    assert leaf("<noscript><p>enable</p></noscript><iframe><p>x</p></iframe><textarea><p>t</textarea><p>A</p>") == ["A"]
    assert leaf("<title>t<p>A</p>") == ["t", "A"] and leaf("<script src='a.js'/><p>A</p>") == ["A"]


def test_unclosed_elements():
    assert leaf("<div><button>Go</div><p>A</p>") == ["A"] and leaf("<div><object><p>x</div><p>A</p>") == ["A"]
    assert leaf("<div><select><option>x<option>y<p>A</p></div>") == ["A"] and leaf("<p>A <svg><path d='M0'></svg>B</p>") == ["A B"]
    assert leaf("<p>A <button><div>no</div></button>B</p><p>C</p>") == ["A B", "C"] and leaf("<div><svg><g>x<p>A</p></div>") == ["A"]
    assert leaf("<ul><li>one<li>two</ul><p>A<p>B") == ["one", "two", "A", "B"] and leaf("</div></p><p>A") == ["A"]


def test_attributes():
    assert leaf('<div class="overflow-hidden" style="overflow:hidden" data-hidden="1" aria-hidden="false"><p>A</p></div>') == ["A"]
    assert leaf("<p hidden>x</p><p style='color:red; display : none'>x</p><p aria-hidden=true>x</p><div hidden><p>x</p></div><p>A</p>") == ["A"]
    assert leaf("<p title=it's>A</p><p title='a>b' data-x=\"<p>\">B</p><a href=x?a=\"1>C</a>") == ["A", "B", "C"]
    assert leaf("a < b <c") == ["a < b"] or leaf("a < b <c")[0].startswith("a < b")
    assert leaf("<!DOCTYPE html><?xml version='1.0'?><![CDATA[x]]><p>A &lt;b&gt; &amp;amp; &#233;&nbsp;x</p>")[-1] == "A <b> &amp; é x"


NAV = '<nav><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li><li><a href="/a">About us</a></li></ul></nav>'
FOOT = "<footer><p>&copy; 2024 Example Media. All rights reserved.</p></footer>"
P = [
    "The council approved the new bridge on Tuesday after a debate of four hours.", "Engineers expect that work will begin in the spring, once the river is low enough.", "Several residents had asked for a tunnel instead.",
    "Le conseil a voté le budget hier soir, sans surprise.", "Die Brücke wird im nächsten Jahr gebaut, sagte der Sprecher.", "Short line.", "Preheat the oven to 180 degrees and butter a large dish.", "In 1897 the museum moved to its present building, which had been a mill.",
]
#: (page, blocks that are main text)
PAGES = [
    (f"<html><body>{NAV}<article><h1>Bridge approved</h1><p>{P[0]}</p><p>{P[1]}</p></article>{FOOT}</body></html>", ["Bridge approved", P[0], P[1]]),
    (f"<body>{NAV}<main><h1>Bridge</h1><p>{P[0]}</p><p>{P[2]}</p></main><aside><h3>Related</h3><ul><li><a href=x>Old bridge</a></li></ul></aside>{FOOT}</body>", ["Bridge", P[0], P[2]]),
    (f"<body><div id=menu>{NAV}</div><div class=content><h2>Budget</h2><p>{P[3]}</p><p>{P[3]}</p></div><div id=footer><p>Contact</p></div></body>", ["Budget", P[3], P[3]]),
    (f"<body><header><h1>Daily Post</h1></header><article><h2>Brücke</h2><p>{P[4]}</p></article><div class=comments><p>Great news!</p><p>I do not agree.</p></div></body>", ["Brücke", P[4]]),
    (f"<body>{NAV}<article><p>{P[5]}</p></article></body>", [P[5]]),
    (f"<body><div class=cookie-notice><p>We use cookies to improve this site.</p></div><article><h1>Cake</h1><ul><li>200 g flour</li><li>3 eggs</li></ul><p>{P[6]}</p></article>{FOOT}</body>", ["Cake", "200 g flour", "3 eggs", P[6]]),
    (f"<body>{NAV}<article><h1>Museum</h1><p>{P[7]}</p><div class=ad><p>Buy two, pay one! Offer ends today.</p></div><p>{P[0]}</p></article></body>", ["Museum", P[7], P[0]]),
    (f"<body><form><label>Search</label><input></form><main><p>{P[1]}</p><blockquote><p>{P[2]}</p></blockquote></main></body>", [P[1], P[2]]),
    (f"<body>{NAV}<div class=post><h1>Table</h1><table><tr><th>Year</th><th>Visitors</th></tr><tr><td>1990</td><td>1200</td></tr></table><p>{P[7]}</p></div>{FOOT}</body>", ["Table", "Year", "Visitors", "1990", "1200", P[7]]),
    (f"<body><nav>{NAV}</nav><article><header><h1>Nested header</h1></header><p>{P[0]}</p><p>{P[1]}</p></article></body>", ["Nested header", P[0], P[1]]),
    (f"<body><article><h1>No frame</h1><p>{P[0]}</p></article></body>", ["No frame", P[0]]),
    (f"<body>{NAV}<article><h1>Code</h1><pre>for x in y: print(x)</pre><p>{P[1]}</p></article><section id=comments><div class=comment><p>Thanks, that helped me.</p></div></section></body>", ["Code", "for x in y: print(x)", P[1]]),
    (f"<body><div class=banner><p>Subscribe now and save.</p></div><div class=article><p>{P[0]}</p><p>{P[1]}</p><p>{P[2]}</p></div></body>", [P[0], P[1], P[2]]),
    (f"<body>{NAV}<div class=sidebar><p>About the author</p></div><div class=entry><h1>Mill</h1><p>{P[7]}</p></div></body>", ["Mill", P[7]]),
    (f"<body><article><h1>Many</h1>{''.join(f'<p>{x}</p>' for x in P)}</article>{FOOT}</body>", ["Many", *P]),
    (f"<body><main><article><h1>Deep</h1><div><div><p>{P[0]}</p></div></div><section><h2>Later</h2><p>{P[1]}</p></section></article></main></body>", ["Deep", P[0], "Later", P[1]]),
    (f"<body>{NAV}<article><h1>Open tags<p>{P[0]}<p>{P[1]}<ul><li>one thing<li>another thing</ul></article>{FOOT}", ["Open tags", P[0], P[1], "one thing", "another thing"]),
    (f"<body>{NAV}<article class='post overflow-hidden'><h1>Classes</h1><p class=lead>{P[2]}</p><p>{P[0]}</p></article></body>", ["Classes", P[2], P[0]]),
    (f"<body><script>if(a<b){{c()}}</script>{NAV}<article><h1>Scripts</h1><p>{P[0]}</p><script>x='<p>'</script><p>{P[1]}</p></article></body>", ["Scripts", P[0], P[1]]),
    (f"<body>{NAV}{FOOT}</body>", []),
    ("<body><form><p>Log in to read on.</p><label>Name</label><input></form></body>", []),
    (f"<body><article><h1>Links inside</h1><p>As <a href=x>reported before</a>, {P[0]}</p><p>{P[1]}</p></article><aside class=related><ul><li><a href=1>More on bridges</a></li><li><a href=2>More on rivers</a></li></ul></aside></body>", ["Links inside", f"As reported before, {P[0]}", P[1]]),
    (f"<body><div class=notice><p>This site will be down on Sunday.</p></div><main><h1>Down</h1><p>{P[1]}</p></main></body>", ["Down", P[1]]),
    (f"<body>{NAV}<article><h1>Figures</h1><figure><img src=x></figure><p>{P[7]}</p></article><div class=newsletter><form><p>Get our letter</p></form></div></body>", ["Figures", P[7]]),
    (f"<body><header>{NAV}</header><article><h1>Quotes</h1><p>{P[0]}</p><blockquote>{P[2]}</blockquote></article>{FOOT}</body>", ["Quotes", P[0], P[2]]),
    (f"<body>{NAV}<article><h1>Entities &amp; signs</h1><p>Caf&eacute; &lt;b&gt; &quot;x&quot;. {P[0]}</p></article></body>", ["Entities & signs", f'Café <b> "x". {P[0]}']),
    (f"<body><div class=share><p>Share this</p></div><div class=story><h1>Story</h1><p>{P[4]}</p><p>{P[3]}</p></div><div class=share><p>Share this</p></div></body>", ["Story", P[4], P[3]]),
    (f"<body>{NAV}<article><h1>Long</h1><p>{' '.join(P * 20)}</p></article>{FOOT}</body>", ["Long", " ".join(P * 20)]),
    (f"<body><article><h1>Short ones</h1><p>Yes.</p><p>No.</p><p>{P[0]}</p></article><div id=comments><h3>2 comments</h3><div class=comment><p>{P[1]}</p></div></div></body>", ["Short ones", "Yes.", "No.", P[0]]),
    (f"<body><div class=adverts><p>{P[6]}</p></div><article><h1>Not the advert</h1><p>{P[7]}</p></article></body>", ["Not the advert", P[7]]),
]


def test_thirty_pages():
    right = wrong = missed = 0
    whole = 0
    for page, want in PAGES:
        got = text(page).split("\n") if text(page) else []
        rest = list(want)
        for b in got:
            if b in rest:
                rest.remove(b)
                right += 1
            else:
                wrong += 1
        missed += len(rest)
        whole += got == want
    assert len(PAGES) == 30
    assert right / (right + wrong) >= 0.95 and right / (right + missed) >= 0.95 and whole >= 26, (right, wrong, missed, whole)
