"""Main text of pages, simple tree matching, and wrappers of hosts."""

import random

from helpers import table
from pyspark.sql import functions as F

import pytest

from sightline.llm import dom, spread, wrapper

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<header><h2>Site</h2></header><nav><ul><li><a href=x>Home</a><li><a href=y>{0}</a></ul></nav><!-- <p>no</p> -->
<div class="ad">buy {0}</div><article><h1>Title &amp; {0}</h1><p class=byline>Share this text</p><p><b>One{0}.<br>two&nbsp;&nbsp;three<p>four <i>fi</i>ve
</p><ul><li>a<li>b</ul><div id="comments"><p>first!</p></div><form><p>mail</p></form><aside>see also</aside><div class="cookie-notice">ok?</div></article>
<footer>&copy; {0}</footer>"""


def blocks(html, template=()):
    root = dom.parse(html)
    return dom.blocks(root, dom.layout(root)[1], set(template))


def page(x):
    return PAGE.format(x)


def test_blocks():
    assert blocks(page("K")) == ["Title & K", "Share this text", "OneK. two three", "four five", "a", "b"]


def test_without_article_links_are_no_text():
    html = "<body><div><a href=1>one</a> <a href=2>two</a></div><p>Some text with <a href=3>a link</a> in it</p><div hidden>no</div><p>x &lt;b&gt; y"
    assert blocks(html) == ["Some text with a link in it", "x <b> y"]


def test_attributes_have_whole_names():
    for a in ('data-title="The hidden cost"', 'data-hidden="false"', 'data-role="search"', "title='role=menu class=ad'", "x:hidden=1", 'alt="a" data-id=ad', "data-aria-hidden=true"):
        assert blocks(f"<article {a}><p>kept</p></article>") == ["kept"], a
    for a in ("hidden", 'data-x="1" HIDDEN', "role = 'search'", 'aria-hidden=true', "class=ad", "title=\"it's\" id='popup'", 'style="display: none"'):
        assert blocks(f"<div {a}>gone</div><p>kept") == ["kept"], a


def test_links_count_in_their_own_block():
    long = "<a href=1>a link that is much longer than the sentence</a>"
    html = f"<body>A plain sentence.<p>x</p><div>Another one.<p>y</p>{long}</div>Last."
    assert blocks(html) == ["A plain sentence.", "x", "Another one.", "y", "Last."]
    assert blocks(f"<body><p>{long}</p><p>See {long}.</p>") == ["a link that is much longer than the sentence", "See a link that is much longer than the sentence."]
    assert blocks("<body><ul><li><a>Home</a><li><a>News</a> (3)</ul><p><a>one</a> | <a>two</a></p>") == []


def test_broken_markup():
    for html in ("", "<", "text", "<p", "<p>a</div>b", "<!--", "<script>x", "<a href='>q", "a < b", "</p>x", "<p title=\"a>b\">c</p>", "<article>" * 50 + "x"):
        blocks(html)
    assert blocks('<p title="a>b">c</p>d') == ["c", "d"]
    assert blocks("a < b") == ["a < b"]


def leaves(r, depth=0):
    return (r.choice("abc"), tuple(leaves(r, depth + 1) for _ in range(r.randrange(0, 4 - depth)))) if depth < 3 else ("z", ())


def written(tree, depth=0):
    return "\n".join([f"{depth} {tree[0]}", *(written(c, depth + 1) for c in tree[1])])


def size_of_best(a, b):
    """Largest matching, by trying every order-keeping choice of children."""
    if a[0] != b[0]:
        return 0
    def best(i, j):
        if i == len(a[1]) or j == len(b[1]):
            return 0
        return max(best(i + 1, j), best(i, j + 1), size_of_best(a[1][i], b[1][j]) + best(i + 1, j + 1))
    return 1 + best(0, 0)


def test_tree_matching():
    r = random.Random(5)
    for _ in range(300):
        a, b = ("r", leaves(r)[1]), ("r", leaves(r)[1])
        pairs = dom.match(written(a), written(b))
        assert size_of_best(a, b) == len(pairs) == len({x for x, _ in pairs}) == len({y for _, y in pairs})
        assert pairs == sorted(pairs) and [y for _, y in pairs] == sorted(y for _, y in pairs)


def test_matching_of_many_children(monkeypatch):
    a, b = ("r", tuple(("ab"[i % 2], ()) for i in range(40))), ("r", tuple(("ab"[i % 3 > 0], ()) for i in range(40)))
    best = dom.match(written(a), written(b))
    monkeypatch.setattr(dom, "PAIRS", 10)
    dom._match.cache_clear()
    quick = dom.match(written(a), written(b))
    dom._match.cache_clear()
    assert 20 < len(quick) <= len(best) and quick == sorted(quick) and [y for _, y in quick] == sorted(y for _, y in quick)


def flat(labels):
    return "\n".join(["0 r", *(f"1 {x}" for x in labels)])


def test_matching_is_the_same_at_any_size(monkeypatch):
    """Rows, bands and rows made again give the pairs of the plain loop; these are the largest matching."""
    r = random.Random(7)
    trees = [(("r", leaves(r)[1] + leaves(r)[1]), ("r", leaves(r)[1] + leaves(r)[1])) for _ in range(60)]
    wide = [r.choice("abcd") for _ in range(300)]
    near = [x for x in wide if r.random() < 0.97]
    outlines = [(written(a), written(b)) for a, b in trees] + [(flat(wide), flat(near)), (flat(near), flat([r.choice("abcd") for _ in range(200)]))]
    monkeypatch.setattr(dom, "PAIRS", 10**9)
    plain = [dom._match.__wrapped__(a, b) for a, b in outlines]
    assert [len(p) for p in plain[:60]] == [size_of_best(a, b) for a, b in trees]
    for pairs, cells in ((-1, 4_000_000), (-1, 50), (10, 500)):
        monkeypatch.setattr(dom, "PAIRS", pairs)
        monkeypatch.setattr(dom, "CELLS", cells)
        assert [dom._match.__wrapped__(a, b) for a, b in outlines] == plain


def test_more_than_a_million_pairs_of_children():
    r = random.Random(9)
    a, b = [r.choice("abcd") for _ in range(1100)], [r.choice("abcd") for _ in range(1000)]
    best = [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for y, z in enumerate(b):
            row.append(max(best[y + 1], row[y], best[y] + (x == z)))
        best = row
    pairs = dom.match(flat(a), flat(b))
    assert len(pairs) == 1 + best[-1] and all(([*"r", *a][i] == [*"r", *b][j]) for i, j in pairs)
    assert pairs == sorted(pairs) and all(i < k and j < m for (i, j), (k, m) in zip(pairs, pairs[1:]))


@pytest.mark.parametrize("n", [100, 510])
def test_template_of_pages_with_many_blocks(spark, n):
    """One page has its last block first; it is of the same template all the same, be there 200 blocks or 1,020."""
    body = lambda i: "".join(f"<h3>Item {i}-{k}</h3><p>Fixed {k}.</p>" for k in range(n))
    rows = [(i, "https://blocks.example/", f"<body>{body(i)}<h6>end</h6>") for i in range(12)] + [(12, "https://blocks.example/", f"<body><h6>end</h6>{body(12)}")]
    got = {r.page_id: r.text for r in wrapper.extract_text(table(spark, rows, "page_id long, url string, html string")).collect()}
    items = lambda i: "\n".join(f"Item {i}-{k}" for k in range(n))
    assert got == {**{i: items(i) for i in range(12)}, 12: "end\n" + items(12)}


def test_deep_and_long_pages(spark):
    deep = "<div>" * 100_000 + "text" + "</div>" * 100_000
    wide = "<body><article>" + "".join(f"<p>word {i} &amp; more</p><div><h2>x{i}</h2></div>" for i in range(150_000)) + "</article>"
    centred = "<center>" * 30_000 + "<p>in"
    pages = table(spark, [(i, "https://deep.example/", h) for i, h in enumerate([deep] * 6 + [wide, centred])], "page_id long, url string, html string")
    got = {r.page_id: (len(r.text), r.n_chars, r.text[:4]) for r in wrapper.extract_text(pages).collect()}
    long = "\n".join(f"word {i} & more\nx{i}" for i in range(150_000))
    assert got == {**{i: (4, 4, "text") for i in range(6)}, 6: (len(long), len(long), "word"), 7: (2, 2, "in")}


def test_two_templates_of_one_host(spark, monkeypatch):
    monkeypatch.setattr(spread, "ROWS", 4)
    monkeypatch.setattr(wrapper, "HOST_PAGES", 4)  # the host is dealt over several tasks
    news = "<main><h1>{0}</h1><p class=tag>From our newsroom</p><p>{0} happened.</p><div class=call>Call us any time.</div></main>"
    shop = "<body><table class=item><tr><th>Item {0}<td>Ships free.</table><section><div class=desc>{0} is fine.</div><div class=law>All rights reserved.</div></section>"
    rows = [(i, "https://two.example/", news.format(f"N{i}")) for i in range(12)] + [(100 + i, "https://two.example/", shop.format(f"S{i}")) for i in range(9)]
    pages = table(spark, rows, "page_id long, url string, html string")
    (found,) = wrapper.induce_wrappers(pages).collect()
    assert found.pages == 21 and len(found.wrappers) == 2 and all(w.template for w in found.wrappers)
    got = {r.page_id: r.text for r in wrapper.extract_text(pages).collect()}
    assert got == {**{i: f"N{i}\nN{i} happened." for i in range(12)}, **{100 + i: f"Item S{i}\nS{i} is fine." for i in range(9)}}


def test_references_without_a_cap(spark, monkeypatch):
    """A host of ten layouts, looked at two outlines at a time, equals one reference after the other."""
    monkeypatch.setattr(wrapper, "WAVE", 2)
    monkeypatch.setattr(wrapper, "WIDEST", 4)
    names = [3 * chr(ord("a") + j) for j in range(10)]
    body = "<body><section class=c{0}><div class=k{0}><p class=n{0}>Note {0} of all.</p><h2 class=h{0}>T{{0}}</h2><p class=t{0}>Text {{0}} of {0}.</p></div></section>"
    layouts = [body.format(x) for x in names]
    rows = [(100 * j + i, "https://many.example/", html.format(f"{j}-{i}")) for j, html in enumerate(layouts) for i in range(5 + j % 3)]
    rows += [(5000 + i, "https://many.example/", f"<body><pre class={x}><table class={x}><tr class={x}><td class={x}>alone {i}") for i, x in enumerate(("one", "two", "three"))]
    pages = table(spark, rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in wrapper.extract_text(pages).collect()}
    want = {100 * j + i: f"T{j}-{i}\nText {j}-{i} of {names[j]}." for j in range(10) for i in range(5 + j % 3)}
    assert got == {**want, **{5000 + i: f"alone {i}" for i in range(3)}}
    (found,) = wrapper.induce_wrappers(pages).collect()
    # plain loop over the host's outlines
    outlines = {}
    for _, _, html in rows:
        tree = dom.layout(dom.parse(html))[0]
        outlines[tree] = outlines.get(tree, 0) + 1
    references = []
    while sum(outlines.values()) >= wrapper.LEAST:
        best = max(outlines, key=lambda o: (outlines[o], o))
        references.append(best)
        outlines = {o: n for o, n in outlines.items() if wrapper.aligned(o, best) is None}
    assert [w.reference for w in found.wrappers][: len(references)] == references


def test_shared_lines_bound_every_matching():
    r = random.Random(5)
    for _ in range(300):
        trees = []
        for _ in "ab":
            lines, depth = ["0 r"], 0
            for _ in range(r.randrange(1, 12)):
                depth = 1 + r.randrange(min(depth + 1, 3))
                lines.append(f"{depth} {r.choice('abc')}")
            trees.append("\n".join(lines))
        pairs = dom.match(*trees)
        assert len(pairs) <= wrapper._common(*trees)


def with_template(pages):
    return [r.host for r in wrapper.induce_wrappers(pages).collect() if any(w.template for w in r.wrappers or ())]


def test_constant_slots_become_template(spark):
    rows = [(i, f"http://user@Host.example:80/{i}", page(f"K{i}")) for i in range(8)]
    rows += [(20 + i, f"https://few.example/{i}", page("same")) for i in range(3)]
    rows += [(30 + i, "https://copies.example/", page("copy")) for i in range(6)]
    rows += [(40, None, None), (41, None, ""), (42, "nonsense", "<p>alone"), (0, "http://host.example/0", page("K0"))]
    pages = table(spark, rows, "page_id long, url string, html string")
    assert {r.host for r in pages.select(wrapper.host_of(F.col("url")).alias("host")).distinct().collect()} == {"host.example", "few.example", "copies.example", ""}
    assert with_template(pages) == ["host.example"]
    got = {}
    for r in wrapper.extract_text(pages).collect():
        got.setdefault(r.page_id, []).append(r.text)
        assert r.n_chars == len(r.text)
    # the byline and the list are the same on every page of this host
    assert got[3] == ["Title & K3\nOneK3. two three\nfour five"]
    assert len(got[0]) == 2 and len(set(got[0])) == 1
    assert got[21] == ["Title & same\nShare this text\nOnesame. two three\nfour five\na\nb"]
    assert got[31] == ["Title & copy\nShare this text\nOnecopy. two three\nfour five\na\nb"]
    assert got[40] == got[41] == [""] and got[42] == ["alone"]


def test_copied_articles_are_kept(spark):
    """Copies whose menus, adverts, comments and footers vary are no template; nor are other texts in a template's place."""
    copied = "<nav><p>menu {0}</p></nav><div class=ad>buy {0}</div><article><h1>Same</h1><p>Copied text.</p><div id=comments><p>{0}</p></div></article><footer>{0}</footer>"
    shop = "<article><h1>Item {0}</h1><p class=note>{1}</p></article>"
    rows = [(i, "https://copied.example/", copied.format(i)) for i in range(10)] + [(10, "https://copied.example/", copied.format("x").replace("Copied", "Another"))]
    rows += [(20 + i, "https://shop.example/", shop.format(i, "A real finding." if i == 3 else "Ships free.")) for i in range(12)]
    pages = table(spark, rows, "page_id long, url string, html string")
    assert with_template(pages) == ["shop.example"]
    got = {r.page_id: r.text for r in wrapper.extract_text(pages).collect()}
    assert {got[i] for i in range(10)} == {"Same\nCopied text."} and got[10] == "Same\nAnother text."
    assert got[23] == "Item 3\nA real finding." and {got[20 + i] for i in range(12) if i != 3} == {f"Item {i}" for i in range(12) if i != 3}


def test_no_pages(spark):
    assert wrapper.extract_text(table(spark, [], "page_id long, url string, html string").where("false")).count() == 0


@pytest.mark.parametrize("broken", ["<a", "<p ", '<p x="', "<p x='\">", "<!--", "<", "</", "<p x=\"'", "<b>", "<!"])
def test_ten_million_characters_of_broken_tags(broken):
    import time

    begun = time.time()
    html = broken * (10_000_000 // len(broken))
    dom.parse(html)
    dom.parse(html[:5_000_000] + ">")
    assert time.time() - begun < 30  # seconds on a busy machine


def test_broken_tags_are_read_as_far_as_they_go():
    text = lambda h: [w for _, w in dom.segments(dom.parse(h))]
    assert text("<p>a</p>b < c <p>d <q x") == ["a", "b < c", "d <q x"]
    assert text('<p title="a > b">c</p><p title="d>e</p>') == ["c", "e"]
    assert text("<p>x<!-- > --> y</p><!-- z") == ["x y"]
    assert text("<script>if (a<b) '\"</script><p>after</p>") == ["after"]


def test_names_that_are_no_marks():
    text = lambda c: [w for _, w in dom.segments(dom.parse(f'<body><div {c}><p>Main text of it.</p></div></body>'))]
    for c in ("content has-sidebar", "post notice-board", "story social-science", "has-comments", "shared", "adverse"):
        assert text(f'class="{c}"') == ["Main text of it."], c
    assert text('id="no-comments"') == ["Main text of it."]
    for c in ("sidebar", "post sidebar", "site-footer", "main-nav", "ad-slot", "cookie-banner", "comment-list", "ad"):
        assert text(f'class="{c}"') == [], c


def test_hidden_inline_elements():
    text = lambda h: [w for _, w in dom.segments(dom.parse(h))]
    assert text('<p>One <span style="display:none">hid <span>den</span></span> two <b hidden>three</b> four.</p>') == ["One two four."]
    assert text('<p>Five <span class="advert">six</p><p>seven <i>eight</i></p>') == ["Five", "seven eight"]


def test_open_quotes_are_followed_however_many():
    """Where a tag ends doesn't depend on how much has been read before it."""
    for n in (1, 20, 1000):
        html = '<a y="> "' * n + "' " + '<p title="a > b">c</p>'
        assert [w for _, w in dom.segments(dom.parse(html))][-1] == "c", n

    def ends(html):
        """The first > outside quotes for each tag, by looking at every character."""
        for start, end, name, *_ in dom._tags(html, [0]):
            if name is not None:
                at = start + 1 + (html[start + 1] == "/") + len(name)
                first, quote = html.index(">", at), None
                for k in range(at, len(html)):
                    c = html[k]
                    if quote is None and c == ">":
                        break
                    quote = (c if c in "'\"" else None) if quote is None else None if c == quote else quote
                else:
                    k = first
                yield end == k + 1

    r = random.Random(11)
    for _ in range(2000):
        html = "".join(r.choice(["<a", "</b", "<p ", ">", '"', "'", " ", "x="]) for _ in range(r.randrange(1, 60)))
        assert all(ends(html)), html
