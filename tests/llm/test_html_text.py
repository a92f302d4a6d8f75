import time

from tallyspark.llm import html_text
from tallyspark.llm.html_text import main_text

PROSE = "A paragraph of some length, with a comma or two, that reads like text."


def test_the_article_without_what_surrounds_it():
    page = f"""<!DOCTYPE html><html><head><title>No</title><style>p{{}}</style><script>var a="</p>";</script></head><body>
    <header><h1>Site</h1><p>slogan, of, the site that is long enough to count</p></header><nav><ul><li><a href=/>Home</a></li></ul></nav>
    <div class="cookie-notice"><p>{PROSE} We use cookies.</p></div><div id="topAd"><p>{PROSE} Buy.</p></div>
    <div class="layout"><div class="post-content"><h2>Title &amp; more</h2><p>{PROSE}</p><p>Two&nbsp;&nbsp;words<br>and
      a&#8230; third.<ul><li>one <i>item</i></li><li>two</li></ul><table><tr><td>cell<td>next</table></div>
    <div class="sidebar"><p>{PROSE} Side.</p></div><section id="comments"><p>{PROSE} Great post.</p></section></div>
    <form><p>{PROSE} Search.</p><input></form><footer>&copy; {PROSE}</footer></body></html>"""
    assert main_text(page).split("\n\n") == ["Title & more", PROSE, "Two words and a… third.", "one item", "two", "cell", "next"]


def test_scores_choose_without_semantic_names():
    page = f"<body><div><p>Short.</p></div><div><p>{PROSE}</p><p>{PROSE} More.</p></div><div><a href=1>{PROSE}</a> <a href=2>{PROSE}</a></div>"
    assert main_text(page) == f"{PROSE}\n\n{PROSE} More."


def test_parts_of_one_article_and_siblings():
    page = f"<main><article><header><h1>Head</h1></header><section><p>{PROSE}</p></section><section><p>Next, {PROSE}</p></section></article></main><aside>x</aside>"
    assert main_text(page) == f"Head\n\n{PROSE}\n\nNext, {PROSE}"


def test_unclosed_and_misnested_markup():
    page = f"<article><h1>T</h1><p><b>{PROSE}<br><p>Second one.</p></i></article><footer>foot"
    assert main_text(page) == f"T\n\n{PROSE}\n\nSecond one."
    assert main_text("<p>a</p><script>never closed") == "a"
    assert main_text("<p>a</p><!-- never closed") == "a"


def test_empty_plain_and_tiny_pages():
    assert [main_text(x) for x in (None, "", "  ", "<html></html>", "<nav>menu</nav>")] == [""] * 5
    assert main_text("just  some\ttext") == "just some text"
    assert main_text("<p>Only one.</p>") == "Only one."


def test_long_and_deep_pages_take_linear_time():
    start = time.process_time()
    text = main_text("<body><article>" + f"<p>{PROSE}</p>" * 20_000 + "</article>")
    assert text.count(PROSE) == 20_000
    assert main_text("<div>" * 20_000 + f"<p>{PROSE}</p>") == PROSE
    assert time.process_time() - start < 30


def test_columns(spark):
    rows = [(1, "u", None, "old"), (2, None, f"<p>{PROSE}</p>", "old"), (2, None, f"<p>{PROSE}</p>", "old"), (None, "u", "é ü", None)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    got = html_text.extract(pages)
    assert got.columns == ["page_id", "url", "html", "text", "n_chars"]
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in got.collect()) == [
        (0, "é ü", 3), (1, "", 0), (2, PROSE, len(PROSE)), (2, PROSE, len(PROSE))]
    assert html_text.extract(pages.limit(0)).collect() == []


def test_a_form_around_the_page_keeps_the_article():
    page = f"""<body><form id="aspnetForm"><input type="hidden" name="__VIEWSTATE"><div><input name="q"><button>Go</button></div>
    <div id="body"><p>{PROSE}</p><p>{PROSE} More.</p><p>Sum <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math>
    here.</p><noscript>Turn scripts on.</noscript></div><select><option>One</select></form>"""
    assert main_text(page) == f"{PROSE}\n\n{PROSE} More.\n\nSum x=2 here."
    page = f"<body><article><p>{PROSE}</p><p>{PROSE} More.</p><form><label>Mail</label><input><p>Join us.</p></form></article><form><p>{PROSE}</p><input></form>"
    assert main_text(page) == f"{PROSE}\n\n{PROSE} More."


def test_layout_names_do_not_drop_the_article():
    prose = f"<p>{PROSE}</p><p>{PROSE} More.</p>"
    side = f'<div class="sidebar"><p>{PROSE} Side.</p></div><div class="post-comments"><p>{PROSE} Nice.</p></div>'
    for names in ('id="content" class="has-sidebar"', 'class="main-content no-sidebar"', 'class="post no-comments"', 'class="entry share"', 'class="widget"'):
        assert main_text(f"<body><div><div {names}>{prose}</div>{side}</div>") == f"{PROSE}\n\n{PROSE} More."


def test_link_lists_stay_inside_the_article_only():
    links = "<ul><li><a href=1>First thing</a></li><li><a href=2>Second</a></li></ul>"
    page = f"<body>{links}<article><p>{PROSE}</p><p>{PROSE} More.</p>{links}<ul class=menu><li><a href=3>Menu</a></li></ul></article>{links}"
    assert main_text(page) == f"{PROSE}\n\n{PROSE} More.\n\nFirst thing\n\nSecond"
    assert main_text(f"<body>{links}<p>{PROSE}</p><p>{PROSE} More.</p>") == f"{PROSE}\n\n{PROSE} More."


TWO = f"<p>{PROSE}</p><p>{PROSE} More.</p>"
BOTH = f"{PROSE}\n\n{PROSE} More."


def test_names_weigh_and_do_not_drop_the_article():
    for page in (
        f'<div id="top"><div class="article">{TWO}</div></div>',
        f'<div id="header-wrap"><div class="text">{TWO}</div></div>',
        f'<div class="popular-science">{TWO}</div>', f'<div class="hidden-gems">{TWO}</div>',
        f'<article id="search-engines">{TWO}</article>', f'<article class="alert">{TWO}</article>',
        f'<body style="display:none">{TWO}</body>', f'<body class="x" hidden><div>{TWO}</div></body>',
        f'<script>var s="<!--";</script><article>{TWO}</article>',
        f"<article>{TWO}</article><!-- the end",
    ):
        assert main_text(page) == BOTH, page


def test_sections_of_a_paper_keep_their_names():
    page = f"""<div class="paper"><h1>T</h1><section id="intro">{TWO}</section><section id="related-work"><h2 id="related-work">Related</h2>
    <p>{PROSE}</p></section><section id="discussion"><h2><span id="Discussion">Discussion</span></h2><p>{PROSE}</p></section>
    <blockquote class="author"><p>{PROSE}</p></blockquote><p class="side">Aside, in the text.</p></div>"""
    assert main_text(page).split("\n\n") == ["T", PROSE, f"{PROSE} More.", "Related", PROSE, "Discussion", PROSE, PROSE, "Aside, in the text."]


def test_short_parts_between_and_titles_before():
    page = f"<div><div>{TWO}</div><div><p>The end, my friend of long.</p></div><div>{TWO}</div></div>"
    assert main_text(page) == f"{BOTH}\n\nThe end, my friend of long.\n\n{BOTH}"
    assert main_text(f'<body><div><h1>Title</h1></div><div class="content">{TWO}</div></body>') == f"Title\n\n{BOTH}"
    assert main_text(f'<body><header><h1>Site</h1></header><div class="article"><header><h1>Title</h1></header>{TWO}</div></body>') == f"Title\n\n{BOTH}"


def test_comments_and_related_lists_go():
    more = f'<div class="related-posts"><p>{PROSE}</p></div><section class="comment-list">' + f'<article class="comment"><p>{PROSE} Nice.</p></article>' * 9 + "</section>"
    assert main_text(f"<body><article>{TWO}{more}</article></body>") == BOTH
    assert main_text(f"<body><div class=story>{TWO}</div>{more}</body>") == BOTH
    assert main_text(f'<div class="comments"><p>{PROSE}</p></div>') == PROSE


def test_generated_pages_give_their_articles():
    """Pages of random layout, wrapper names and parts around an article that is known."""
    import random

    rnd = random.Random(3)
    word = lambda: rnd.choice("alpha beta gamma delta river stone cloud paper winter music".split())

    def sentence(n):
        return " ".join(word() for _ in range(n)).capitalize() + ", " + word() + "."

    for _ in range(300):
        want, inner = [], ""
        if rnd.random() < 0.7:
            title = sentence(3)
            want.append(title)
            inner += rnd.choice(["<h1>{}</h1>", "<header><h1>{}</h1></header>"]).format(title)
        for _ in range(rnd.randrange(3, 9)):
            text = sentence(rnd.randrange(15, 60))
            want.append(text)
            inner += rnd.choice(["<p>{}</p>", "<p id=discussion>{}</p>", "<section id=related-work><p>{}</p></section>", "<blockquote class=author><p>{}</p></blockquote>", "<p>{}"]).format(text)
            if rnd.random() < 0.3:
                inner += rnd.choice(["<div class=ad>{}</div>", "<div class='share-bar'><p>{}</p></div>", "<form><p>{}</p><input></form>", "<script>'{}'</script>", "<nav><a href=x>{}</a></nav>"]).format(sentence(4))
        page = rnd.choice(["<article>{}</article>", "<main><article>{}</article></main>", "<div class=post-content>{}</div>", "<div id=top><div class=story>{}</div></div>", "<article class=notice>{}</article>"]).format(inner)
        around = ["<nav><ul><li><a href=1>{}</a></li></ul></nav>", "<div class=sidebar><p>{}</p></div>", "<footer>{}</footer>", "<div class='cookie-notice'><p>{}</p></div>", "<div id=comments><p>{}</p></div>", "<aside><p>{}</p></aside>"]
        parts = [p.format(sentence(rnd.randrange(5, 30))) for p in rnd.sample(around, 3)]
        got = main_text(f"<html><body>{parts[0]}{page}{parts[1]}{parts[2]}</body></html>")
        assert got.split("\n\n") == want, (page, got)
