from tideworks.llm.tagpaths import extract, main_text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><a href="/">Site</a></header><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News, all</a></li></ul></nav>
<!-- ad --><div class="ad">Buy this, now. It is good, and cheap, and long enough to be text.</div>
<aside class="sidebar"><p>Beside, the point.</p></aside><div id="cookie-notice">We use cookies, as all do.</div>
<article><h1>A &amp; B</h1><p>First, with <b>bold</b>&nbsp;text.<br>And more.<p>Second
  over   lines.</p><form><p>Search, here.</p></form><ul><li>one, <li>two</ul></article>
<section class="comments"><p>Nice, I say.</p></section><footer>&copy; 2024, us.</footer>"""


def test_article_without_the_rest():
    assert main_text(PAGE) == "A & B\nFirst, with bold text. And more.\nSecond over lines.\none,\ntwo"


def test_odd_pages():
    assert [main_text(x) for x in (None, "", "  ", "<script>1", "<a href=x>only</a>", "plain &lt;text&gt;", "<p>One, two.<p>Three")] == ["", "", "", "", "", "plain <text>", "One, two.\nThree"]
    assert main_text("<div class=menu><a href=x>Home</a></div><div><h1>T</h1><p>Long, long text. And more, here.</p></div>") == "T\nLong, long text. And more, here."
    assert main_text("<article>" + "<div>" * 3000 + "deep, text." + "</div>" * 3000) == "deep, text."
    assert main_text("<p>" + "word, " * 100_000 + "</p>") == ("word, " * 100_000).strip()


def test_rows(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (None, None, None, None)], "page_id bigint, url string, html string, n_chars string")
    out = extract(pages).collect()
    assert len(out) == 3 and out[0].text == main_text(PAGE) and out[0].n_chars == len(out[0].text) and out[2].text == "" and out[2].n_chars == 0
    assert extract(pages.limit(0)).count() == 0


def test_all_content_parts_stay():
    from tideworks.llm.tagpaths import main_text

    said = lambda k, n: " ".join(f"Sentence {k} {i}, with some words of it." for i in range(n))
    one, two = said("a", 13), said("b", 7)
    assert main_text(f"<body><div id=content><section><p>{one}</p></section><section><p>{two}</p></section></div></body>") == f"{one}\n{two}"
    assert main_text(f"<body><div><div><p>{one}</p></div><p>{two}</p></div></body>") == f"{one}\n{two}"
    assert main_text(f"<body><div><article><p>{one}</p></article><article><p>{two}</p></article></div></body>") == f"{one}\n{two}"
    linked = "<ul><li><a href=x>Reference one</a></li><li><a href=y>Reference two</a></li></ul>"
    assert main_text(f"<body><article><h2><a href=z>Linked title</a></h2><p>{one}</p>{linked}</article></body>") == f"Linked title\n{one}\nReference one\nReference two"
    assert main_text(f"<body><div>{linked}<h2><a href=z>Linked title</a></h2><p>{one}</p></div></body>") == f"Linked title\n{one}"


def test_broken_pages_take_one_pass():
    import time

    for unit in ("<a ", "<", "</", "<!--", "<a \"", "<p class='", "<script ", "<a><b>", "<a>\"'<", "<p x=\">", "&lt;<"):
        began = time.time()
        main_text(unit * (1_000_000 // len(unit)) if unit != "<a><b>" else unit * 2000)
        assert time.time() - began < 4, unit
    assert main_text('<p>One, two.</p><a title="never closed><p>Three, four, five.</p>') == "One, two.\nThree, four, five."


def test_parts_of_an_article_whose_names_leave_doubt():
    one = "Sentence one, which is long enough, and two, which is too. " * 3
    page = f"""<article><p>{one}</p><p class="related">{one}</p><div class="social-history"><p>{one}</p></div>
<p>Let <math><mi>x</mi></math> be 3, and so on.</p><div class="related-posts"><h3>Related</h3><ul><li><a href=x>Other</a></li></ul></div>
<div class="notice">Read this.</div><div class="ad-box"><p>{one}</p></div></article>"""
    said = one.strip()
    assert main_text(page) == f"{said}\n{said}\n{said}\nLet x be 3, and so on."
