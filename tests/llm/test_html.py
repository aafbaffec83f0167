import pytest

from specmill.llm.htmltext import extracted, main_text

BODY = "<p>{}</p>".format("Plain words stand here, one after the other, and they end. So do these, in turn. ")

PAGES = {
    "menus": (f"<body><nav><a href=/>Home</a></nav><article><h1>Title</h1>{BODY}</article><footer>&copy; us</footer></body>", f"Title {BODY[3:-5]}"),
    "no article": (
        '<body><div id="cookie-notice">We use cookies, all of them. Yes.</div><div id=main><h1>Title</h1><div class=text>'
        f"{BODY}{BODY}<ul><li>one<li>two</ul></div></div><section class='comments'><p>Nice one, thanks. Really, a lot.</p></section></body>",
        f"Title {BODY[3:-5]} {BODY[3:-5]} one two",
    ),
    "unclosed": ("<article><p><b>One, two.<br><p>Three</b> four.", "One, two. Three four."),
    "references": ("<article><p>a &amp; b &lt;c&gt; &#233;&nbsp;x &unknown; &quot</article>", 'a & b <c> é x &unknown; "'),
    "white space": ("<article><p> a\n\t b </p>\n<p>\n</p><div>c</div></article>", "a b c"),
    "inline": ("<article><p>foo<b>bar</b><i> x</i><a href=y>z</a></p></article>", "foobar xz"),
    "raw": ("<article><script>var a = '<p>no</p>';</script><style>p{}</style><!-- <p>no</p> --><p>yes</p></article>", "yes"),
    "hidden": ('<article><p>yes</p><p hidden>no</p><div style="display: none">no</div><form><p>no</p></form></article>', "yes"),
    "quotes": ("<article><p title='a > b' class=\"x\">yes</p></article>", "yes"),
    "script never closed": ("<article><p>yes</p></article><script>var x = 1; <p>no", "yes"),
    "only text": ("just words", "just words"),
    "less than": ("<p>1 < 2 & 3</p>", "1 < 2 & 3"),
    "nothing": ("<nav><a>x</a></nav>", ""),
    "empty": ("", ""),
    "header of the article": (f"<header>Site</header><article><header><h1>Title</h1></header>{BODY}</article>", f"Title {BODY[3:-5]}"),
}


LONG = "Plain words stand here, one after the other, and they end. So do these, in turn. " * 12
LEAD = "A lead of some words says what follows, and why. "
LAST = "An end of some words says what was said, and goes. "
WIDE = {
    "beside the main element": (
        f"<body><nav><a href=/>Home</a></nav><h1>Title</h1><p>{LEAD}</p><div>{LONG}</div><p>{LAST}</p><p>&copy; 2020 us, and all.</p></body>",
        f"Title {LEAD}{LONG}{LAST}",
    ),
    "paragraphs inside": (
        f"<body><h1>Title</h1><p>{LEAD}</p><div>" + f"<p>{LONG}</p>" * 4 + f"</div><p>{LAST}</p><div><h3>More</h3><ul><li><a href=x>one</a><li><a href=y>two</a></ul></div></body>",
        f"Title {LEAD}{LONG * 4}{LAST}",
    ),
    "name around an article": (f"<body><div class='content no-sidebar'><article><p>{LONG}</p></article></div><p>Us.</p></body>", LONG),
    "names around names": (
        f"<body><div class=search-page><div id=share-box><article><p>{LONG}</p></article><div class=comments><p>{LAST}</p></div></div></div></body>",
        LONG,
    ),
    "name around most of the content": (f"<body><div class='post with-sidebar'><p>{LONG}</p><p>{LAST}</p></div><div class=sidebar>Other, short.</div></body>", LONG + LAST),
    "long comments": (f"<body><div class=post><p>{LEAD * 4}</p></div><div class=comments><p>{LONG}</p></div></body>", LEAD * 4),
    "longer than the article": (f"<body><div class=ad>{LONG}</div><article><h1>Title</h1><p>{LAST}</p></article></body>", f"Title {LAST}"),
    "form around an article": (f"<body><form method=post><nav><a href=/>Home</a></nav><article><p>{LONG}</p></article><footer>Us.</footer></form></body>", LONG),
    "form around a main element": (f"<body><form><main><h1>Title</h1><p>{LAST}</p></main><input value=x></form></body>", f"Title {LAST}"),
    "form around the page": (f"<body><form><div id=top>Us</div><div class=text><p>{LONG}</p><p>{LONG}</p></div></form></body>", LONG * 2),
    "form alone": ("<body><form><p>Name: <input></p><p>Word, please: <input></p><button>Go</button></form></body>", ""),
    "form in an article": (f"<body><article><p>{LAST}</p><form><p>{LONG}</p></form></article></body>", LAST),
    "names that say more": (
        f"<body><article><p>{LONG}</p><section class=social-history><p>{LAST}</p></section><div id=search-results><p>{LEAD}</p></div></article></body>",
        LONG + LAST + LEAD,
    ),
    "names of the subject": (
        f"<body><article><p>{LONG}</p><section class=promotion><p>{LONG}</p></section><section class=notice><p>{LONG}</p></section></article></body>",
        LONG * 3,
    ),
    "names of something else": (
        f"<body><article><p>{LONG}</p><div class='share share-buttons'>Share this: one, two.</div><div class=social-links><a href=x>one</a></div>"
        f"<div class=ad-slot><p>{LONG}</p></div><p>{LAST}</p><div class='comment-list'><p>{LONG}</p></div></article></body>",
        LONG + LAST,
    ),
    "references are links": (
        f"<body><article><p>{LONG}</p><h2>References</h2><ol><li><a href=x>A title</a><li><a href=y>Another one</a></ol></article></body>",
        f"{LONG} References A title Another one",
    ),
    "longer in lower case": (f"<body><article><p>\u0130 {LAST}</p><SCRIPT>var a = '</scripts>';</SCRIPT ><p>{LAST}</p></article></body>", f"\u0130 {LAST} {LAST}"),
    "articles as comments": (f"<body><article><p>{LONG}</p></article><div class=comments><article><p>{LAST}</p></article></div></body>", LONG),
}


@pytest.mark.parametrize("name", WIDE)
def test_wide_page(name):
    source, want = WIDE[name]
    assert main_text(source) == " ".join(want.split())


@pytest.mark.parametrize("name", PAGES)
def test_page(name):
    source, want = PAGES[name]
    assert main_text(source) == " ".join(want.split())


def test_deep_and_long_pages():
    assert main_text("<div>" * 5000 + "x") == "x"
    assert main_text("<article>" + "<p>word, and more.</p>" * 5000 + "</article>") == " ".join(["word, and more."] * 5000)


def test_table(spark):
    rows = [(i, f"u{i}", source, 1) for i, (source, _) in enumerate(PAGES.values())]
    rows += [rows[0], (99, None, None, 1), (None, "u", "<p>x</p>", 1)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, n_chars int")
    got = sorted((tuple(r) for r in extracted(pages).collect()), key=repr)
    want = [(i, u, main_text(s), len(main_text(s))) for i, u, s, _ in rows]
    assert got == sorted(want, key=repr)
    assert extracted(pages.where("false")).collect() == []
