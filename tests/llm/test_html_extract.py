import html
import re

from gleanery.llm import html_extract as H

PAGE = """<html><head><title>T</title><script>var a="<p>x</p>"</script></head><body><header class="site"><h2>Site</h2></header>
<nav><a href=/a>Home</a> <a href=/b>News</a></nav><aside>About us and our long history of writing things down</aside>
<article><h1>Title &amp; more</h1><p>First <b>bo</b>ld para<!-- no --> with <a href='x>y'>a link</a>.<p>Second&nbsp;para<br>next
<div class="ad-slot">Buy now</div><form>Name <input></form><section id="comments"><p>I disagree strongly with all of this.</p></section></article>
<div class="cookie-notice">We use cookies on this site to make it better</div><footer>&copy; me</footer></body></html>"""


def test_page():
    assert H.main_text(PAGE) == "Title & more First bold para with a link. Second para next"


def test_broken_pages():
    assert H.main_text(None) == H.main_text("") == H.main_text("<!-- open") == H.main_text("<script>x") == ""
    assert H.main_text("<article><p>cut off te") == "cut off te"
    assert H.main_text("<article><p>a < b &am") == "a < b &am"
    assert H.main_text("<article>&lt;b&gt; x</article><p class='un>closed") == "<b> x"


def test_tree_on_held_out_blocks():
    rows = H.labelled_rows()
    right = 0
    for part in range(5):
        tree = H.grow([r for i, r in enumerate(rows) if i % 5 != part])
        right += sum(H.is_content(tree, x) == y for i, (x, y) in enumerate(rows) if i % 5 == part)
    assert right / len(rows) > 0.93


def test_pages_table(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r["page_id"]: r for r in H.extract_pages(pages).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for r in rows:
        inside = re.search(r"<article>(.*?)(</article>|$)", r["html"], re.S)
        want = " ".join(html.unescape(re.sub(r"<[^>]*>", "\x00", inside[1]).replace("\x00", " ")).split())
        assert got[r["page_id"]]["text"] == want and got[r["page_id"]]["n_chars"] == len(want)


def test_odd_tables(spark):
    pages = spark.createDataFrame([(1, None, None, "x"), (1, None, None, "x"), (None, "u", "<main>hi</main>", "y")], "page_id bigint, url string, html string, text string")
    got = sorted((r["page_id"] or 0, r["text"]) for r in H.extract_pages(pages).collect())
    assert got == [(0, "hi"), (1, ""), (1, "")]
    assert H.extract_pages(pages.limit(0)).count() == 0


#: Pages without a container that is rightly named as main, and an article with a list of links.
HELD_OUT = (
    """<body><div class="nav"><a href=/>Home</a><p><a href=/x>All news</a></div><div class="cookie-bar">We use cookies and similar tools on this site so that
it works as it should, and by reading on you agree to their use here</div><h1>A walk along the river</h1><p>The path begins at the old mill and follows the water
for about four miles before it climbs into the woods above the town.</p><p>Bring water.</p><p>Beyond the second bridge the ground is wet in spring, and good boots
are needed until the path turns away from the bank.</p><div class="newsletter">Get our letters every week with walks, maps and offers from shops nearby</div>
<footer>Written and kept by volunteers since 1990</footer></body>""",
    """<div class="topbar"><a href=/>Start</a></div><article class="post has-sidebar"><h2>Bread at home</h2><p>Flour, water and salt are mixed in the evening and left alone
until the dough has doubled, which takes about twelve hours in a cool room.</p><p>Wait.</p><p>In the morning it is folded, shaped and baked in a hot pot.</p></article>
<div class="comments"><p>I tried this twice with rye flour and it never rose at all, so what did I do wrong with the yeast here?</p></div>""",
    """<nav><a href=/>Start</a></nav><div class="sidebar-layout"><h1>The clock tower</h1><p>It was built from local stone over three summers and paid for by the guild of
weavers, whose sign is still above the door.</p><p>The bell came later and was cast in the town across the valley by two brothers.</p>
<p>Visitors may climb to the top on the first day of each month if the weather is fair.</p></div><div class="footer"><a href=/i>Imprint</a></div>""",
    """<main><h1>Tides</h1><p>The sea rises and falls twice a day because the moon pulls at the water on the side that faces it.</p><div><a href=/1>Five boats to buy</a></div>
<div><a href=/2>Cheap sails</a></div><div><a href=/3>Win a trip</a></div><p>See <a href=/m>moon</a> for more.</p><p>Short days.</p></main>""",
    """<h1>Snow</h1><p>Snow fell through the night and by dawn the lane was closed.</p><p>The plough came at noon, and two hours later the first cars went down the
hill again, one behind the other, slowly and with their lamps lit.</p>""",
)


def test_held_out_pages():
    kept = [[b.text.split()[0] for b, row in zip(blocks, H.features(blocks)) if H.is_content(H.trained_tree(), row)] for blocks in map(H.blocks_of, HELD_OUT)]
    assert kept == [["A", "The", "Bring", "Beyond"], ["Bread", "Flour,", "Wait.", "In"], ["The", "It", "The", "Visitors"], ["Tides", "The", "See", "Short"], ["Snow", "Snow", "The"]]


def test_features_in_use():
    def used(tree):
        # A split counts only if it decides something.
        return set() if isinstance(tree, bool) or {*answers(tree)} != {True, False} else {H.FEATURES[tree[0]]} | used(tree[2]) | used(tree[3])

    def answers(tree):
        return [tree] if isinstance(tree, bool) else answers(tree[2]) + answers(tree[3])

    assert {"boiler", "density", "words", "words_after", "paragraph", "heading"} <= used(H.trained_tree())
    assert H.FEATURES[H.trained_tree()[0]] not in H.HINTS


def verdicts(page, hints=True):
    blocks = H.blocks_of(page)
    return blocks, [H.is_content(H.trained_tree(), row) for row in H.features(blocks, hints)]


def test_text_features_decide(spark, sf):
    """On pages without any container's name the same blocks are kept, and with names they hardly matter."""
    kept = other = same = 0
    kept_of = other_of = 0
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        truth = H.blocks_of(r["html"])
        stripped = re.sub(r"<(/?)(article|nav|footer)>", r"<\1div>", r["html"]).replace(' class="ad"', "")
        blocks, plain = verdicts(stripped)
        assert [b.text for b in blocks] == [b.text for b in truth]
        for b, keep, named in zip(truth, plain, verdicts(r["html"])[1]):
            same += keep == named
            kept, kept_of, other, other_of = kept + (b.main and keep), kept_of + b.main, other + (not b.main and keep), other_of + (not b.main)
    assert kept >= 0.9 * kept_of and other <= 0.1 * other_of and same >= 0.9 * (kept_of + other_of)
    decided = total = 0
    for page in HELD_OUT:
        with_names, without = verdicts(page)[1], verdicts(page, hints=False)[1]
        decided += sum(a == b for a, b in zip(with_names, without))
        total += len(without)
    assert decided >= 0.75 * total


def test_plain_containers():
    long_ = "A long paragraph of text that goes on for quite some words so that it is part of an article."
    page = f"""<div class="cookie-notice"><p>We use cookies on this site to make it better for you and all who come here</p></div><h1>Title here</h1><p>{long_}</p>
<p>One.</p><p>{long_}</p><p>End.</p><aside>About us and our long history of writing things down</aside><div id="comments"><p>I disagree strongly with all of this</p><p>me too</p></div>"""
    assert H.main_text(page) == f"Title here {long_} One. {long_} End."
    menu = f'<div class="content-block"><ul><li><a href=/>menu</a></li></ul></div><h1>Walk</h1><p>{long_}</p><p>Bring water.</p>'
    assert H.main_text(menu) == f"Walk {long_} Bring water."


def test_blocks_inside_articles():
    page = """<article><h1>T</h1><p>Real text of the article with many words in it.</p><p class="advert">Buy now</p><p hidden>secret</p><div style="display: none">gone</div>
<p>More <math><mi>x</mi></math> and <object>thing</object>, <noscript>plain</noscript> <span hidden>un<span>se</span>en</span>words.</p><p><a href=/p>Read the paper</a></p></article>"""
    assert H.main_text(page) == "T Real text of the article with many words in it. More x and thing, plain words. Read the paper"


def test_unclosed_elements():
    for tag in ("button", "svg", "object", "canvas", "select"):
        page = f"<article><p>The first paragraph of the article stands here.</p><section><{tag}>inside</section><p>The second one is not lost.</p></article>"
        assert H.main_text(page).endswith("The second one is not lost."), tag
    assert H.main_text("<ul><li>one<li>two</ul><table><tr><td>a<td>b<tr><td>c</table>" * 2) is not None


def test_very_long_page():
    words = "word " * 400_000
    page = f"<nav><a href=/>x</a></nav><article><h1>Long</h1><p>{words}</p>" + "<p>One more paragraph of a few words.</p>" * 20_000 + "</article>"
    got = H.main_text(page)
    assert got.startswith("Long word word") and got.count("One more") == 20_000 and len(got) == 4 + len(words) + 20_000 * 35
    deep = "<div>" * 20_000 + "<p>A paragraph that lies very deep inside of other containers.</p>" + "</b></div>" * 20_000
    assert H.main_text(deep) == "A paragraph that lies very deep inside of other containers."
