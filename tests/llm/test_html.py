"""Main text extraction."""

import re

from agora.llm import html_extract, queries
from agora.llm.html_extract import main_text


def test_odd_pages():
    assert main_text(None) == main_text("") == main_text("<html></html>") == ""
    assert main_text("plain a &lt; b  < c") == "plain a < b < c"
    assert main_text("<p>a<p>b\n c<div class=sidebar><p>no no no</div>") == "a\nb c"
    assert main_text("<article><p>x &amp; y&nbsp;z</p></article><p>trail") == "x & y z"
    assert main_text("<a<b>c</a> d <!-- never closed") == "c d"
    assert main_text("<p>x<script>var t='</p><p>no';</script>y</p><style>p{}</style>") == "xy"
    assert main_text("<p>" * 3000 + "deep" + "</div>" * 50) == "deep"
    assert main_text("<article><p>" + "word, " * 20000 + "</p></article>").count("word,") == 20000


def test_boilerplate_goes_and_article_stays():
    text = "A long paragraph of text, with commas, that is clearly the article's own."
    page = f"""<body><header><h1>Site</h1></header><nav><a href=/>Home</a></nav>
      <div class="cookie-notice">We use cookies, many cookies, a great number of cookies.</div>
      <div id="main"><article><header><h1>Title</h1></header><p>{text}</p><div class="ad">Buy, buy, buy, buy</div>
      <form><p>Name, address, and so on</p></form><ul><li>one<li>two</ul><p>{text}</p>
      <section id="comments"><p>I, as a reader, say that, well, this, is, wrong.</p></section></article>
      <aside>See, also, this, that, and, other, things.</aside></div><footer>Copyright, all, rights.</footer>"""
    assert main_text(page) == f"Title\n{text}\none\ntwo\n{text}"


TEXT = "A long paragraph of text, with commas, that is clearly the article's own."
SIDE = "<div class='sidebar'><p>Latest, posts, of, this, site</p></div>"


def test_wrappers_with_noise_words_keep_their_article():
    article = f"<article><p>{TEXT}</p><p>{TEXT}</p></article>"
    want = f"{TEXT}\n{TEXT}"
    for wrapper in ("layout has-sidebar", "content-sidebar-wrap", "elementor-widget-container", "no-sidebar widget"):
        assert main_text(f"<body><div class='{wrapper}'>{article}{SIDE}</div></body>") == want
    assert main_text(f"<form id=f action=/><div id='main'><p>{TEXT}</p><p>{TEXT}</p></div>{SIDE}</form>") == want
    assert main_text(f"<form><main><p>{TEXT}</p></main></form><p>x</p>") == TEXT
    assert main_text(f"<article><p class='story-related-text'>{TEXT}</p></article>") == TEXT
    assert main_text(f"<div class='promo'><p>{TEXT}</p></div>") == TEXT  # nothing else is there
    assert main_text(f"<div class='comments'><p>{TEXT}</p></div>") == TEXT


def test_small_noise_still_goes():
    article = f"<article><p>{TEXT}</p><p>{TEXT}</p><div class='related-post'><p>See, also, that</p></div></article>"
    talk = "".join(f"<article class='comment'><p>{TEXT} {i}</p></article>" for i in range(9))
    page = f"<body>{SIDE}{article}<form><p>Your, name</p></form><section id='comments'>{talk}</section></body>"
    assert main_text(page) == f"{TEXT}\n{TEXT}"


def test_sections_of_an_article_are_read_whole():
    long = f"<section><h2>Results</h2><p>{TEXT}</p><p>{TEXT}</p><p>{TEXT}</p></section>"
    page = f"<article>{long}<h2>Discussion</h2><section id='discussion-of-results'><p>{TEXT}</p></section><section><p>The end.</p></section></article>"
    assert main_text(page) == "\n".join(["Results", TEXT, TEXT, TEXT, "Discussion", TEXT, "The end."])


def slow_best(root):
    """Scores of all containers, each summed over its own blocks (no passing up); noise is left out."""
    from agora.llm.html_extract import _COMMA, Node

    def blocks(node, depth=0):
        for child in node.children:
            if not isinstance(child, Node):
                yield child, depth
            elif not child.noise:
                yield from blocks(child, depth + 1)

    def containers(node):
        yield node
        for child in node.children:
            if isinstance(child, Node) and not child.noise:
                yield from containers(child)

    best = None
    for i, node in enumerate(containers(root)):
        score, chars, linked = node.score, 0, 0
        for (text, inside_links), depth in blocks(node):
            share = 1.0 if depth == 0 else 0.5 if depth == 1 else 1.0 / (3 * depth)
            score += share * (min(len(text) / 50.0, 6.0) + len(_COMMA.findall(text)) + (len(text) >= 25))
            chars, linked = chars + len(text), linked + inside_links
        if chars and (best is None or score * (1 - linked / chars) > best[0] + 1e-9):
            best = (score * (1 - linked / chars), node)
    return best


def test_best_container_equals_a_slow_scorer():
    import random

    from agora.llm.html_extract import best_containers, parse
    rng = random.Random(5)

    def piece(depth):
        kind = rng.choice(["p", "p", "div", "section", "ul", "a"] if depth < 5 else ["p"])
        if kind == "p":
            return "<p>" + ", ".join(rng.choices(["one two", "three", "x"], k=rng.randint(1, 30))) + "</p>"
        if kind == "a":
            return "<p><a href=/>" + "link, " * rng.randint(1, 9) + "</a></p>"
        name = rng.choice(["", " class=content", " class=sidebar", " id=story"])
        return f"<{kind}{name}>" + "".join(piece(depth + 1) for _ in range(rng.randint(1, 5))) + f"</{kind}>"

    for _ in range(60):
        page = "".join(piece(0) for _ in range(4))
        want = slow_best(parse(page))
        got = best_containers(parse(page))
        if want is None:
            assert got == []
            continue
        texts = lambda nodes: [t for k in nodes for t in (html_extract.walk(k) if isinstance(k, html_extract.Node) else [k[0]])]
        chosen = texts([want[1]])
        have = texts(got)
        assert any(have[i:i + len(chosen)] == chosen for i in range(len(have) - len(chosen) + 1))


def test_equal_containers_and_very_wide_pages():
    same = f"<div><p>{TEXT}</p></div>"
    assert main_text(same + same) == f"{TEXT}\n{TEXT}"
    assert main_text("<div>" + f"<section><p>{TEXT}</p></section>" * 5000 + "</div>").count(TEXT) == 5000


def test_link_lists_lose_to_prose():
    links = "".join(f"<li><a href=/{i}>Some, other, story, number {i}, with commas</a></li>" for i in range(30))
    prose = "<p>" + "Prose, with a few commas, and words. " * 6 + "</p>"
    out = main_text(f"<div><ul>{links}</ul></div><div>{prose * 3}</div>")
    assert "story" not in out and out.count("Prose") == 18


def test_table_pages_are_their_articles(spark):
    import html
    rows = queries.table(spark, "/root/testdata/sf0.001", "pages").collect()
    got = {r.page_id: r for r in queries.op1_html_extract(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(rows)
    for r in rows:
        inner = r.html[r.html.index("<article>") + 9:r.html.index("</article>")]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))).split())
                  for b in re.split("</?(?:p|h1)>", inner)]
        assert got[r.page_id].text == "\n".join(b for b in blocks if b) and got[r.page_id].n_chars == len(got[r.page_id].text)


def test_nulls_repeats_and_empty(spark):
    from pyspark.sql import functions as F
    rows = [(1, "u", "<p>a"), (1, "u", "<p>a"), (None, None, None), (2, None, "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    out = html_extract.extract(df).collect()
    assert sorted(map(str, ((r.page_id, r.url, r.text, r.n_chars) for r in out))) == sorted(map(str, [
        (1, "u", "a", 1), (1, "u", "a", 1), (None, None, "", 0), (2, None, "", 0)]))
    assert html_extract.extract(df.where("false")).count() == 0
