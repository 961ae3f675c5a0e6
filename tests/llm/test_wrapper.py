import random
import time
from collections import Counter

import pytest

from quiverlake.llm import wrapper as w


def text(source):
    page = w.Page(source)
    return w.main_text(page, page.fold()[0])


@pytest.mark.parametrize(("source", "want"), [
    ("", ""),
    ("plain &amp; <b>bold</b>", "plain & bold"),
    ("<p>a <p>b<br>c\n d</p>e", "a\nb c d\ne"),
    ('<nav>menu</nav><article><h1>T</h1><p><b>x<br><p>y&nbsp;z</p></article><footer>f</footer>', "T\nx\ny z"),
    ('<article><header><h1>T</h1></header><p>x</p><form>f</form><script>var t="</p>";</script><div class="ad">buy</div></article><header>h</header>', "T\nx"),
    ('<body class="has-sidebar"><div id="content"><p>one</p><p>two</p></div><div class="side-bar">s</div><div class="sidebar">s</div>', "one\ntwo"),
    ('<main><p>x</p><section id="comments"><article>hi</article></section></main>', "x"),
    ('<div class="cookie-notice"><p>ok?</p></div><p>text</p><ul><li><a href=1>m</a><li><a href=2>n</a></ul>', "text"),
    ("<article><ul><li>a<li>b</ul><table><tr><td>1<td>2</table></article>", "a\nb\n1\n2"),
    ("<article><p>cut off <em>he", "cut off he"),
    ('<article><p>cut tag</p><a href="x', "cut tag"),
    ("<article><p>a &lt;b&gt; &#233; &eacute &am</p></article>", "a <b> é é &am"),
    ("<article><!-- x > y --><p>1 < 2 and 3 > 2</p><!-- open", "1 < 2 and 3 > 2"),
    ('<article><p title="a>b">q</p><p hidden>h</p><p style="display: none">h</p></article>', "q"),
    ("<textarea><p>t</textarea><article>x</b></i>y</article>", "xy"),
])
def test_main_text(source, want):
    assert text(source) == want


@pytest.mark.parametrize(("source", "want"), [
    ("<h1 class='entry-title'>T</h1><div class='entry-content'><p>x</p></div><p>no</p>", "T\nx"),
    ("<div class='story'><p>a</p></div><p>no</p><div class='story'><p>longer</p></div>", "a\nlonger"),
    ("<main><h1>T</h1><article><p>x</p></article><p>y</p></main><p>no</p>", "T\nx\ny"),
    ("<main><p>x</p></main><article><p>y</p></article><p>no</p>", "x\ny"),
])
def test_whole_region(source, want):
    assert text(source) == want


def tree(s):
    nodes = []
    for depth, tag in s:
        parent = -1 if depth == 0 else max(i for i, (d, _) in enumerate(s[: len(nodes)]) if d == depth - 1)
        nodes.append((parent, tag, ""))
    return w.Tree(nodes, [1] * len(nodes))


def test_simple_tree_matching_keeps_order():
    a = tree([(0, "#root"), (1, "div"), (2, "h1"), (2, "p"), (1, "div"), (2, "ul")])
    b = tree([(0, "#root"), (1, "div"), (2, "ul"), (1, "span")])
    assert w.simple_tree_matching(a, b) == {0: 0, 1: 4, 2: 5}
    a = w.absorb(a, b)
    assert a.nodes[6] == (0, "span", "") and a.children[0] == [1, 4, 6] and a.support == [2, 1, 1, 1, 2, 2, 1]
    assert len(w.simple_tree_matching(a, b)) == len(b.nodes)


def textbook(a, b):
    """The number of matched nodes by the full table over all pairs of children."""

    def weight(i, j):
        (_, tag, css), (_, other, name) = a.nodes[i], b.nodes[j]
        if tag != other or (css and name and css != name):
            return 0
        x, y = a.children[i], b.children[j]
        t = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for p in range(len(x)):
            for q in range(len(y)):
                t[p + 1][q + 1] = max(t[p][q + 1], t[p + 1][q], t[p][q] + weight(x[p], y[q]))
        return 1 + t[-1][-1]

    return weight(0, 0)


@pytest.mark.parametrize("seed", range(60))
def test_matching_is_as_large_as_by_the_full_table(seed):
    pick = random.Random(seed)

    def grown():
        nodes = [(-1, "#root", "")]
        for _ in range(pick.randrange(1, 25)):
            nodes.append((pick.randrange(len(nodes)), pick.choice("abc"), pick.choice(["", "", "x", "y"])))
        return w.Tree(nodes, [1] * len(nodes)).ordered()

    a = grown()
    for _ in range(4):
        b = grown()
        found = w.simple_tree_matching(a, b)
        assert len(found) == textbook(a, b) and len(set(found.values())) == len(found)
        for j, i in found.items():
            assert j == 0 or found[b.nodes[j][0]] == a.nodes[i][0]
            assert a.nodes[i][1] == b.nodes[j][1]
        for kids in b.children:
            places = [a.children[a.nodes[found[c]][0]].index(found[c]) for c in kids if c in found]
            assert places == sorted(set(places))
        a = w.absorb(a, b)
        assert len(w.simple_tree_matching(a, b)) == len(b.nodes)


def site(i, extra=""):
    return f"<body><div class=x><h1>Title {i}</h1><p>text {i}</p><div class=box>Follow us!</div><p><i>Note:</i> same end</p>{extra}</div></body>"


def rows():
    out = [(i, f"http://a.example/{i}", site(i, "<hr>" if i % 2 else "")) for i in range(10)]
    out += [(20 + i, "http://b.example/", site(1)) for i in range(5)]  # one page over and over: no template
    return [*out, (40, None, None), (41, "no url", "<p>x"), (None, "http://c.example", "<p>y"), (42, "HTTP://A.example:80/z", site(42))]


def test_constant_nodes_go(spark):
    pages = spark.createDataFrame([(*r, "h", 1) for r in rows()], "page_id long, url string, html string, host string, templates int").repartition(3)
    got = {r.page_id: r for r in w.extract(pages).collect()}
    assert got[3].text == "Title 3\ntext 3\nNote: same end" and got[42].text == "Title 42\ntext 42\nNote: same end"
    assert got[20].text == "Title 1\ntext 1\nFollow us!\nNote: same end"
    assert got[40].text == "" and got[40].n_chars == 0 and got[41].text == "x" and got[None].text == "y" and got[None].url == "http://c.example"
    assert len(got) == len(rows()) - 0
    assert w.extract(pages.limit(0)).count() == 0


def texts_of(spark, sources, host="d.example"):
    pages = spark.createDataFrame([(i, f"http://{host}/{i}", s) for i, s in enumerate(sources)], "page_id long, url string, html string").repartition(3)
    return {r.page_id: r.text for r in w.extract(pages).collect()}


def test_constant_nodes_of_several_texts_go(spark):
    boxes = "<div class=box><p>First words</p><p>Second words</p></div><ul><li><a href=1>one</a><li><a href=2>two</a></ul><div class=k>Follow <b>us</b><br>now</div>"
    more = "<div class=more>{}</div>"
    got = texts_of(spark, [f"<article><div class=x><p>text {i}</p><p>shared</p></div>{boxes}{more.format('<q>again</q>' * (1 + i % 2))}</article>" for i in range(6)])
    assert got == {i: f"text {i}\nshared" for i in range(6)}


def test_equal_texts_among_siblings_go(spark):
    pick = random.Random(2)
    letter = "<p>Subscribe to our weekly letter today</p>"
    own = [[sentence(pick, 80) for _ in range(3)] for _ in range(6)]
    pages = [f"<main><div>{''.join(f'<p>{p}</p>' for p in ps)}{letter}</div></main>" for ps in own]
    assert texts_of(spark, pages) == {i: "\n".join(ps) for i, ps in enumerate(own)}
    some = texts_of(spark, [*pages[:5], pages[5].replace(letter, "")])  # not on all pages
    assert some[0] == "\n".join([*own[0], "Subscribe to our weekly letter today"]) and some[5] == "\n".join(own[5])


def test_near_copies_keep_what_they_share(spark):
    pick = random.Random(4)
    story = [sentence(pick, 80) for _ in range(10)]
    versions = [[sentence(pick, 80) if (k + i) % 4 == 0 and k else p for k, p in enumerate(story)] for i in range(8)]  # the first paragraph is on all
    got = texts_of(spark, [f"<article>{''.join(f'<p>{p}</p>' for p in ps)}</article>" for ps in versions])
    assert got == {i: "\n".join(ps) for i, ps in enumerate(versions)}


def test_copies_count_as_one_page(spark):
    def page(i, extra=""):
        return f"<article>{extra}<h1>T{i}</h1><p>text {i}</p>{'<blockquote>own</blockquote>' if i == 0 else ''}{'' if i == 0 else '<div class=box>Follow!</div>'}</article>"

    copies = [page(0, "<hr>" * (k % 2)) for k in range(20)]
    got = texts_of(spark, [*copies, *(page(i) for i in range(1, 4))])
    assert {got[i] for i in range(20)} == {"T0\ntext 0\nown"}
    assert [got[20 + i] for i in range(3)] == [f"T{i}\ntext {i}" for i in range(1, 4)]
    few = texts_of(spark, [page(1)] * 5 + [page(2)] * 5)  # two different pages have no template
    assert set(few.values()) == {"T1\ntext 1\nFollow!", "T2\ntext 2\nFollow!"}


def test_links_go_by_the_wrapper(spark):
    menu = "<ul><li><a href=1>one</a><li><a href=2>two</a></ul>"
    got = texts_of(spark, [f"<p>text {i}</p>{menu}<div><a href=x>Source number {i}</a>, <a href=y>another</a></div>" for i in range(4)])
    assert got == {i: f"text {i}\nSource number {i}, another" for i in range(4)}


def test_deep_and_wide_pages():
    begun = time.process_time()
    deep = "<div>" * 50_000 + "<b>" * 50_000 + "deep" + "</i>" * 50_000 + "</div>" * 50_000
    assert text(deep) == "deep"
    page = w.Page(deep)
    a, b = (w.Tree(w.Page(x).fold()[1], [1] * (10 + x.count("<"))) for x in (deep, deep.replace("deep", "<p>x")))
    assert len(w.simple_tree_matching(a, b)) == len(a.nodes) == len(page.tags)
    wide = ["".join(f"<p class=x{''.join(chr(97 + int(c)) for c in str(i * k))}>y" for i in range(12_000)) for k in (1, 7)]
    a, b = (w.Tree(nodes := w.Page(x).fold()[1], [1] * len(nodes)) for x in wide)
    assert len(w.simple_tree_matching(a, b)) >= 1 + 12_000 // 7
    assert time.process_time() - begun < 30


def test_long_pages(spark):
    pages = [f"<body><div class=q>{'<p>' + f'word{i} ' * 400_000}</div><div class=z>the same</div></body>" for i in range(4)]
    got = texts_of(spark, pages)
    assert all(got[i] == " ".join([f"word{i}"] * 400_000) for i in range(4))


def test_wrappers_keep_their_order():
    a = w.Tree([(-1, "#root", ""), (0, "div", ""), (0, "ul", "")], [3, 3, 1])
    a = w.absorb(a, w.Tree([(-1, "#root", ""), (0, "div", ""), (0, "p", "x"), (0, "ul", "")], [2] * 4)).ordered()
    assert w.signature(a.nodes) == "-1|#root|;0|div|;0|p|x;0|ul|" and a.support == [5, 5, 2, 3]
    assert w.Tree.read(w.signature(a.nodes), a.support).children == a.children
    assert [x[1:] for x in a.ordered(3).nodes] == [("#root", ""), ("div", ""), ("ul", "")]


WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()


def generated(seed, pages=12):
    """A site without any name that tells a part: (html, main text) of its pages."""
    pick = random.Random(seed)
    prose = lambda n: " ".join(pick.choices(WORDS, k=n)) + f" {pick.randrange(10**9)}"
    names = [f"x{''.join(pick.choices('abcdefgh', k=5))}" for _ in range(8)]
    menu = "".join(f"<li><a href=/{k}>{prose(1)}</a>" for k in range(5))
    top = f"<div class={names[0]}><p>{prose(2)}</p><p>{prose(2)}</p><p>{prose(2)}</p></div><ul class={names[1]}>{menu}</ul>"
    end = f"<div class={names[2]}><div><b>{prose(3)}</b> {prose(4)}</div><div>{prose(5)}</div></div>"
    box = f"<div class={names[3]}>{prose(6)}</div>"
    out = []
    for i in range(pages):
        title, body = prose(4), [prose(pick.randrange(30, 90)) for _ in range(pick.randrange(1, 6))]
        date = f"<div class={names[4]}>{prose(1)}</div>" if seed % 2 else ""
        inner = f"<h1>{title}</h1>" + "".join(f"<p>{p}</p>{box if k == 0 else ''}" for k, p in enumerate(body))
        side = f"<div class={names[6]}><ul>{''.join(f'<li><a href=/{k}>{prose(3)}</a>' for k in range(i % 4))}</ul></div>"
        extra = f"<div class='social-history share-prices {names[7]}'><p>{(own := prose(40))}</p></div>" if i % 3 == 0 else ""
        out.append((f"<html><head><title>{title}</title></head><body>{top}<div class={names[5]}>{inner}{extra}</div>{date}{side}{end}</body></html>", "\n".join([title, *body, *([own] if extra else [])])))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_generated_sites(spark, seed, monkeypatch):
    pages = generated(seed)
    assert texts_of(spark, [p for p, _ in pages], f"s{seed}.example") == {i: t for i, (_, t) in enumerate(pages)}
    if not seed:  # it is the wrapper that does it
        monkeypatch.setattr(w, "LEAST_PAGES", 1000)
        off = texts_of(spark, [p for p, _ in pages])
        assert not any(off[i] == t for i, (_, t) in enumerate(pages))


def sentence(pick, size):
    """Words of about so many characters, and a number that occurs once."""
    out = f"{pick.randrange(10**9)}"
    while len(out) < size:
        out += " " + pick.choice(WORDS)
    return out


def pieces(seed, pages=6):
    """A site whose articles have parts beside the element that holds the story: (html, main text). Sizes are from some to hundreds of characters."""
    pick = random.Random(seed)
    foot = sentence(pick, 60)
    out = []
    for _ in range(pages):
        title, stand, by, close = (sentence(pick, n) for n in (30, pick.randrange(10, 400), 15, pick.randrange(10, 250)))
        lead, story = sentence(pick, pick.choice([10, 50, 190, 210, 400])), [sentence(pick, pick.randrange(200, 500)) for _ in range(4)]
        body = "".join(f"<p>{p}</p>" for p in story)
        links = "<ul>" + "".join(f"<li><a href=/{k}>{sentence(pick, 20)}</a>" for k in range(5)) + "</ul>"
        made, parts = {
            0: (f"<main><section>{lead}</section><div>{body}</div>{links}</main>", [lead, *story]),
            1: (f"<article><header><h1>{title}</h1><p>{stand}</p></header><div>{body}</div><p>{close}</p></article>", [title, stand, *story, close]),
            2: (f"<div><article><h1>{title}</h1><div>{by}</div><div class=q>{body}</div><div>{close}</div></article></div>{links}", [title, by, *story, close]),
            3: (f"<main><article>{lead}<div>{body}</div></article></main>", [lead, *story]),
            4: (f"<div class=l><h2>{title}</h2><p>{lead}</p></div><div class=s>{body}</div><p>{close}</p>{links}<div class=b>{by}</div>", [title, lead, *story, close]),
            5: (f"<header><p>{by}</p><h1>{title}</h1></header><main><p>{stand}</p><div><div>{body}</div><footer>{by}</footer></div><aside>{close}</aside></main>", [title, stand, *story]),
        }[seed % 6]
        out.append((f"<html><body><nav>{links}</nav>{made}<div>{foot}</div></body></html>", "\n".join(parts)))
    return out


@pytest.mark.parametrize("seed", range(12))
def test_parts_beside_the_story_stay(spark, seed):
    pages = pieces(seed)
    assert texts_of(spark, [p for p, _ in pages], f"p{seed}.example") == {i: t for i, (_, t) in enumerate(pages)}


def plain_extract(sources):
    """Main texts of one host's pages: one wrapper from all trees, all facts in plain dicts."""
    parsed = [(p := w.Page(s), *p.fold()) for s in sources]
    first = {}
    for p, of, nodes in parsed:
        whole, facts = w.page_profile(p, of)
        x = (w.digest(w.signature(nodes)), nodes, facts)
        first[whole] = min(first.get(whole, x), x, key=lambda y: (y[0], [tuple(z) for z in y[2]]))
    if len(first) < w.LEAST_PAGES:
        return [w.main_text(p, of) for p, of, _ in parsed]
    wrapper = w.Tree([(-1, "#root", "")], [0])
    for _, nodes in sorted({(d, tuple(nodes)) for d, nodes, _ in first.values()}):
        wrapper = w.absorb(wrapper, w.Tree(list(nodes), [1] * len(nodes)))
    seen, each = {}, {}
    lists = {w.page_profile(p, of)[0]: [] for p, of, _ in parsed}
    for p, of, nodes in parsed:
        whole, facts = w.page_profile(p, of)
        lists[whole].append((w.digest(w.signature(nodes)), facts, w.page_texts(p, of)))
    for whole, (_, nodes, facts) in first.items():
        to = w.simple_tree_matching(wrapper, w.Tree(nodes, [1] * len(nodes)))
        for node, text, size, many in facts:
            seen.setdefault(to[node], []).append((text, size, many))
        for node, texts in min(lists[whole], key=lambda x: (x[0], [tuple(y) for y in x[1]]))[2].items():
            each.setdefault(to[node], []).append(texts)
    shared = {}
    for v, pages in each.items():
        count = Counter(t for texts in pages for t in texts)
        every = sorted(t for t, k in count.items() if k == len(pages))
        others = [k for t, k in count.items() if k < len(pages)]
        if len(pages) >= 5 and 2 * len(pages) >= len(first) and every and 10 * sum(k for k in others if k > 1) <= others.count(1) and len(every) * len(pages) < sum(others):
            shared[v] = every
    known = {}
    for v, x in seen.items():
        texts = [t for t, n, _ in x if n]
        known[v] = (len(texts), min(texts, default=None), max(texts, default=None), sum(n for _, n, _ in x), sum(m for *_, m in x))
    out = []
    for p, of, nodes in parsed:
        tree = w.Tree(nodes, [1] * len(nodes))
        to = w.simple_tree_matching(wrapper, tree)
        out.append(w.main_text(p, of, w.judge(tree, [to.get(j, -1) for j in range(len(nodes))], known, len(first), shared)))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_plans_equal_the_plain_version(spark, seed, monkeypatch):
    pick = random.Random(seed)
    hosts = {"a": [p for p, _ in generated(seed, 9)], "b": [p for p, _ in generated(seed + 1, 6)] * 3, "c": [site(i, "<hr>" * pick.randrange(2)) for i in range(7)], "d": ["", "", "x"], "e": ["<p>", "<p> ", "<hr>"], "f": [""]}
    tags = ["div", "p", "ul", "li", "b", "a", "h1", "form", "nav", "section class=x", "div class=comments", "div class=ad"]
    for h in "ghi":
        hosts[h] = ["".join(pick.choice([f"<{pick.choice(tags)}>", f"</{pick.choice(tags).split()[0]}>", pick.choice(WORDS) * pick.choice([1, 1, 60])]) for _ in range(pick.randrange(40))) for _ in range(12)]
    if seed == 2:
        monkeypatch.setattr(w, "BROADCAST_ROWS", 0)
    rows = [(h, i, s) for h, sources in hosts.items() for i, s in enumerate(sources)]
    pages = spark.createDataFrame([(k, f"http://{h}.example/{i}", s) for k, (h, i, s) in enumerate(rows)], "page_id long, url string, html string").repartition(4)
    got = {r.page_id: r.text for r in w.extract(pages).collect()}
    want = [t for sources in hosts.values() for t in plain_extract(sources)]
    assert [got[k] for k in range(len(rows))] == want


def test_many_trees_are_aligned_in_groups(spark, monkeypatch):
    monkeypatch.setattr(w, "GROUP", 3)
    monkeypatch.setattr(w, "MOST_NODES", 12)
    pages = [f"<div class=m>Menu</div><div class=q{chr(97 + i)}><p>own text {i} {'word ' * i}</p><p>more {i}</p></div><div class=m>End</div>" for i in range(20)]
    assert texts_of(spark, pages) == {i: f"own text {i} {'word ' * i}".strip() + f"\nmore {i}" for i in range(20)}


def test_absorb_leaves_no_node_out(monkeypatch):
    monkeypatch.setattr(w, "MOST_NODES", 12)
    wrapper = w.Tree([(-1, "#root", "")], [0])
    for i in range(100):
        wrapper = w.absorb(wrapper, w.Tree([(-1, "#root", ""), (0, "div", f"c{i}")], [1, 1]))
    assert len(wrapper.nodes) == 101 and wrapper.support[0] == 100 and wrapper.support[1:] == [1] * 100


def test_parts_inside_an_article():
    inside = "<article><p>x</p><div class='social-history'>a</div><div class='share-prices'>b</div><div class=share>c</div><div id=comments>d</div></article>"
    assert text(inside) == "x\na\nb"


def test_comments_and_adverts_by_name_and_wrapper(spark):
    def page(i):
        return f"<div class=k><h1>T{i}</h1><p>{f'text{i} ' * 80}</p><div class=ad>Buy {i}!</div><p>{f'end{i} ' * 80}</p><div class=comments><p>I agree with {i}</p><p>So do I, {i}</p></div></div>"

    got = texts_of(spark, [page(i) for i in range(5)])
    assert got == {i: "\n".join([f"T{i}", " ".join([f"text{i}"] * 80), " ".join([f"end{i}"] * 80)]) for i in range(5)}
