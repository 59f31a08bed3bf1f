"""Operator 1: landmarks, chrome, and host-wide repeats."""

import html
import random
import re

from basketry.llm import html_extract
from basketry.llm.queries import op1_html_extraction
from tests.conftest import SF_SMALL

SCHEMA = "page_id bigint, url string, html string"


def test_query_equals_article_markup(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF_SMALL}/pages.parquet").collect()}
    rows = op1_html_extraction(spark, SF_SMALL).collect()
    assert len(rows) == len(pages)
    for r in rows:
        article = re.search(r"<article>(.*?)</article>", pages[r.page_id].html, re.S).group(1)
        parts = [" ".join(html.unescape(re.sub("<[^<>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>|<br>", article)]
        assert r.text == "\n".join(p for p in parts if p)
        assert r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def texts(page):
    return [b for zone, b in html_extract.blocks(page) if zone == "article"]


def test_markup_cases():
    assert texts("<article><h1>A &lt; b</h1><p>one\n two<br>three <b>bold</b>face &amp&copy;</p>") == ["A < b", "one two three boldface &©"]
    assert texts("<nav>menu<article><p>kept</p></article><p>after") == ["kept"]  # an unclosed menu
    assert texts("<main><div class='post comments'>no<div>no</div></div><p>yes</p><aside>no</aside><form>no</form><!-- no <p>no</p> -->end</main>") == ["yes", "end"]
    assert texts("<article><script>var a='<p>no</p>';</script><style>p{}</style><p title='a>b'>yes</p><header>no</header><div role=navigation>no</div></article><footer>no") == ["yes"]
    assert texts("<article><p>x < y and 3 > 2</p><ul><li>a</li><li>b</li></ul>") == ["x < y and 3 > 2", "a", "b"]
    assert texts("<ARTICLE><P>Case</P></ARTICLE><p>out</p>") == ["Case"]
    assert texts("") == [] and texts("plain") == []


def test_articles_inside_closed_chrome_go():
    main = "<nav>menu</nav><article><p>main</p></article>"
    assert texts(main + "<section class='comments'><article>reader comment</article><article>another</article></section>") == ["main"]
    assert texts(main + "<aside><article>teaser</article></aside><footer><article>x</article></footer>") == ["main"]
    assert texts("<aside><div><article>teaser</article></div></aside>" + main + "<ul><li class=related><article>t</article></li></ul>") == ["main"]
    assert texts("<header><article>teaser</article></header>" + main) == ["main"]
    assert texts("<div class=comments><div><main>no</main></div></div>" + main) == ["main"]
    assert texts("<header>title<main><p>kept</p></main></header>") == ["kept"]
    assert texts("<nav>menu<nav>inner</nav><article><header>no</header>kept</article><nav>foot</nav>") == ["kept"]
    assert texts("<p class=ad>buy<article><p>kept</p></article><p>after</p></p>") == ["kept"]
    assert texts("<div class=menu><script>'</div>'</script><!-- </div> -->menu<article>kept</article></body></div>") == ["kept"]


def test_names_of_several_parts_and_hidden_elements():
    keep = "<article><p>kept</p>{}</article>"
    for name in ("cookie-banner", "site-nav", "main-menu", "sidebar-left", "ad-slot", "ad_container", "comment-section", "comments-area", "user-comments", "related-posts", "newsletter-signup", "social-share"):
        assert texts(keep.format(f"<div class='x {name}'><p>no</p></div>")) == ["kept"], name
    for attributes in ("class='x' hidden", "hidden", "style='color:red; display: none'", "aria-hidden=true"):
        assert texts(keep.format(f"<div {attributes}>no</div>")) == ["kept"], attributes
    for part in ("<div class=no-sidebar>yes</div>", "<h2 id=comments>yes</h2>", "<h2 id='header'>yes</h2>", "<p id=menu>yes</p>", "<div class=adventure>yes</div>",
                 "<div data-x='hidden'>yes</div>", "<div class=entry-header><h1>yes</h1></div>"):
        assert texts(keep.format(part)) == ["kept", "yes"], part
    assert texts("<body class='has-sidebar nav-open'><article class='post category-social'>kept</article></body>") == ["kept"]


def test_malformed_pages_take_linear_time():
    import time
    n = 250_000
    for piece in ("<a ", '<a b="', "<a b='", "<a<", "<!", "<!-", "</script", "<script ", "<aside><article></article>", "<x y=\"'", "<nav>", "'>\""):
        began = time.process_time()
        html_extract.blocks(piece * (n // len(piece)))
        assert time.process_time() - began < 4, piece


def test_markup_ends_where_a_pattern_says():
    pattern = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>\"']*)((?:\"[^\"]*\"|'[^']*'|[^\"'>])*)>|<[!?][^>]*>", re.S)
    pick = random.Random(9)
    parts = ["<", ">", "/", "a", "b ", '"', "'", "=", "<!--", "-->", "<!", " text ", "<p>", "</p>", "é", "\n"]
    for _ in range(4000):
        page = "".join(pick.choice(parts) for _ in range(pick.randint(0, 14)))
        want = [(m.start(), m.end(), m.group(1) == "/", (m.group(2) or "").lower(), m.group(3) or "") for m in pattern.finditer(page)]
        if any('"' in t or "'" in t for *_, t, _ in html_extract.tokens(page)):
            continue  # a quote within a name: taken as part of it
        assert html_extract.tokens(page) == want, repr(page)


def test_pages_without_landmark_lose_what_their_host_repeats(spark):
    common = "<div>Welcome to our very own site and enjoy</div>"
    pages = [(i, "http://host.example/p", f"<body>{common}<p>story{i} number{i} told by writer{i} alone{i}</p></body>") for i in range(5)]
    pages.append((9, "http://other.example/", f"<body>{common}<p>lone page</p></body>"))
    rows = {r.page_id: r for r in html_extract.extract(spark.createDataFrame(pages, SCHEMA)).collect()}
    assert rows[3].text == "story3 number3 told by writer3 alone3"
    assert rows[3].n_boilerplate == 8
    assert rows[9].text == "Welcome to our very own site and enjoy\nlone page"


def test_one_hot_host_is_one_group_for_no_task(spark):
    pages = [(i, "http://hot.example/", f"<body><div>same long menu of the hot host here</div><p>own{i} text{i} of{i} page{i}</p>") for i in range(400)]
    rows = html_extract.extract(spark.createDataFrame(pages, SCHEMA).repartition(8)).collect()
    assert {r.text for r in rows} == {f"own{i} text{i} of{i} page{i}" for i in range(400)}


WORDS = "the report of the city council says that in the year of the flood many people had to leave their homes and that the water was high for more than a week before it went back".split()


def prose(pick, n):
    return " ".join(pick.choice(WORDS) for _ in range(n)).capitalize() + "."


def test_natural_text_keeps_its_phrases(spark):
    pick = random.Random(1)
    menu = "<div>Home</div><div>About us and our readers</div>"
    story = [[prose(pick, 60), "At the end of the day it was one of the best. " + prose(pick, 10)] for _ in range(40)]
    page = lambda i: f"<body>{menu}<p>{story[i][0]}</p><p>{story[i][1]}</p></body>"
    pages = [(i, "http://big.example/p", page(i)) for i in range(40)]
    pages += [(100 + i, "http://big.example/copy", page(7)) for i in range(3)]
    rows = {r.page_id: r for r in html_extract.extract(spark.createDataFrame(pages, SCHEMA)).collect()}
    assert all(rows[i].text == "\n".join(story[i]) and rows[i].n_boilerplate == 6 for i in range(40))
    assert all(rows[100 + i].text == "\n".join(story[7]) for i in range(3))


def test_long_runs_cut_into_other_blocks_go_whole(spark):
    pick = random.Random(3)
    legal = prose(pick, 60).split(" ")
    cut = lambda at: f"<p>{' '.join(legal[:at])}</p><p>{' '.join(legal[at:])}</p>"
    pages = [(i, "http://h.example/", f"<p>own words number {i} and then some more</p>{cut(8 + 3 * i)}") for i in range(8)]
    rows = html_extract.extract(spark.createDataFrame(pages, SCHEMA)).collect()
    assert {r.text for r in rows} == {f"own words number {i} and then some more" for i in range(8)}


def test_short_repeated_blocks_within_landmarks_go_and_paragraphs_stay(spark):
    pick = random.Random(2)
    shared = prose(pick, 40)
    pages = [(i, "http://h.example/", f"<article><p>Story {i} of ours.</p><p>{shared}</p><p>Share this story with a friend</p></article>") for i in range(6)]
    pages += [(i, "http://copies.example/", "<article><p>All the same.</p></article>") for i in range(10, 16)]
    pages += [(i, "http://few.example/", f"<article><p>Story {i}.</p><p>Read more</p></article>") for i in range(20, 23)]
    rows = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(pages, SCHEMA)).collect()}
    assert all(rows[i] == f"Story {i} of ours.\n{shared}" for i in range(6))
    assert all(rows[i] == "All the same." for i in range(10, 16))
    assert all(rows[i] == f"Story {i}.\nRead more" for i in range(20, 23))


def test_pages_without_host_and_repeated_rows_strip_nothing(spark):
    page = "<p>a short line that all of these have</p><p>own {}</p>"
    pages = [(i, None if i % 2 else "/relative", page.format(i)) for i in range(10)]
    pages += [(50, "http://twice.example/", page.format(50))] * 8
    rows = html_extract.extract(spark.createDataFrame(pages, SCHEMA)).collect()
    assert len(rows) == 18 and all(r.text == f"a short line that all of these have\nown {r.page_id}" for r in rows)


def test_odd_rows(spark):
    long = "<article>" + "<p>word &amp; word</p>" * 20_000
    rows = [(0, None, None), (1, "u", ""), (2, "http://[bad", "<p>t"), (3, "u", long), (4, "u", "<article></article>"), (5, "u", "<article><p>twice</p>"), (5, "u", "<article><p>twice</p>"), (None, None, "<p>no id")]
    table = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS row", "1 AS text", "2 AS article", "3 AS suffix")
    got = sorted(((r.page_id, r.text) for r in html_extract.extract(table).collect()), key=repr)
    assert got == sorted([(0, ""), (1, ""), (2, "t"), (3, "\n".join(["word & word"] * 20_000)), (4, ""), (5, "twice"), (5, "twice"), (None, "no id")], key=repr)
    assert html_extract.extract(spark.createDataFrame([], SCHEMA)).count() == 0
