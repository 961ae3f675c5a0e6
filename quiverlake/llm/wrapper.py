"""Main text of web pages by wrapper induction.

Pages of one host come from a few templates. A page's DOM tree is folded: siblings of one
kind (tag and class) become one node that stands for a list. Then, by host:

1. Each page gives a profile: a hash of all its text, and for each folded node a hash of
   the whole list of its own texts (of a single one if they are all equal, so that their
   number may differ), their length, and whether the node stands for several siblings.
   Of pages with the same text one counts, whatever their trees: only different pages do.
2. The different folded trees are aligned with the host's growing wrapper by simple tree
   matching: children of two matched nodes are matched in order so that the number of
   matched nodes is largest; what doesn't match is added to the wrapper. GROUP trees make
   a wrapper, GROUP wrappers the next, until one is left. Nodes on very few pages are
   cut from a large wrapper; a node on half of all pages is on half of some part's pages,
   so it stays.
3. Every tree is aligned with the host's wrapper, which gives the numbers of each wrapper
   node over all pages. A node whose text is the same on all its pages, on at least half
   of the host's pages and on three at least is template; where texts differ it is a slot.
   Of a list whose texts differ, a text that is on all its pages, five at least, is template
   too, unless the pages are like copies of each other: then it is their own.
4. The content region of a tree follows from the slots: from the root, as long as one
   child that is no list and no paragraph holds most of the varying text outside links (by the
   mean length over the host's pages), that child is gone into. Inside an article or main
   element all its siblings with such text belong to the region, however short they are;
   outside of one those that hold it in paragraphs or headings do, and of others the top
   headings that vary.

A page's main text is the text in its region without blocks that are all template and
without elements that are menus, forms, scripts and so on by tag or role. Names (class and
id) only tell parts of the region that the wrapper finds marginal: adverts and the like
where a node holds little of the region's text, reader comments where nothing of the
region follows them.

A host of fewer than three different pages has no wrapper, and a page without varying text
no region. Only there do names decide: the region is the page's articles and main
elements, else all elements named as content, else the body, without elements that are
page parts by tag, role or name (inside an article only by a whole class or id, not by a
word of one), and without lists of nothing but links outside of articles.

Blocks end at block-level tags; a line break inside a block is white space.

Defined results: null html is empty and gives the empty text; a null URL or one without a
host shares the host of the empty name; equal pages get equal texts but count as one page
for the template; a broken page is read as far as it goes, a tag cut off by its end is
dropped; an empty table gives no rows; other columns are ignored. A page is held whole.
"""

from __future__ import annotations

import hashlib
import html
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import as_text, materialise, run_folder

LEAST_PAGES, LEAST_SHARED = 3, 5  # different pages that make a node template, and one text among a list's others
GROUP = 256  # trees that one task aligns into a wrapper
MOST_NODES = 20_000  # a size of wrappers that tests set; nothing is cut at it
MOST_OF, LITTLE_OF = 0.6, 0.1  # shares of varying text: to go into a child, and at most of a part that its name can drop
BROADCAST_ROWS, BROADCAST_NODES = 20_000, 1_000_000

# HTML element kinds, and the names by which page parts are told.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("td th tr tbody thead tfoot caption option optgroup head body html legend".split())
P_FENCE = {"button", "table", "td", "th", "caption", "object"}
IMPLIED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}, "body": {"head"}}
FENCE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}, "tbody": {"table"}, "tfoot": {"table"}, "body": set()}
DROPPED_TAGS = frozenset("head nav footer aside form button select datalist input label menu script style noscript template iframe object embed svg canvas audio video map dialog textarea title frameset".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
DROPPED_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adsbygoogle sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe subscription signup sidebar widget widgets menu nav navbar navigation breadcrumb breadcrumbs footer copyright comment comments commentlist respond disqus replies share sharing social related recommended recommendations pagination pager login search toolbar skip".split()
)
DROPPED_OUTSIDE = frozenset("header masthead top".split())  # inside an article they hold its title
COMMENT_NAMES = frozenset("comment comments commentlist respond disqus replies related recommended".split())
CONTENT_NAMES = frozenset("content article post entry story main maincontent articlebody".split())

ARTICLES = frozenset("article main".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
CONTAINERS = frozenset("#root html body main article section div center form table tbody tr td".split())
TOKEN = re.compile(r"""<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<[/!?][^>]*(?:>|\Z)|<[a-zA-Z][^>]*(>|\Z)""", re.DOTALL)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'=<>`]+))?""")
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


class Page:
    """A page's elements in document order and its texts.

    tags, names (words of class and id), labels (whole classes and ids), roles, parents and ends (of the subtree) are
    by element; texts are (element, block, raw text). Open elements are kept by tag, so closing one takes no search.
    """

    __slots__ = ("tags", "classes", "names", "labels", "roles", "hidden", "parents", "ends", "texts", "_stack", "_open_at", "_blocks")

    def __init__(self, source: str):
        self.tags, self.classes, self.names, self.labels, self.roles, self.hidden = ["#root"], [""], [frozenset()], [frozenset()], [""], [False]
        self.parents, self.ends, self.texts = [-1], [0], []
        self._stack: list[int] = [0]
        self._open_at: dict[str, list[int]] = {}  # depths of the open elements of a tag
        self._blocks: list[int] = []  # depths of the open block elements
        at, block, size = 0, 0, len(source)
        tags, stack = self.tags, self._stack
        while at < size:
            m = TOKEN.search(source, at)
            if m is None:
                self.texts.append((stack[-1], block, source[at:]))
                break
            if m.start() > at:
                self.texts.append((stack[-1], block, source[at : m.start()]))
            at = m.end()
            closing, tag, rest = m[1], m[2], m[3]
            if tag is None:
                if m[4] != ">":
                    continue  # a comment, a declaration, or a tag cut off by the end
                closing, tag, rest = "", re.match(r"<([a-zA-Z][^\s/>]*)", m[0])[1], ""
            tag = tag.lower()
            if tag in BLOCK:
                block += 1
            if closing:
                self._close(tag)
                continue
            if tag in CLOSES_P:
                self._imply({"p"}, P_FENCE)
            if tag in IMPLIED:
                self._imply(IMPLIED[tag], FENCE[tag])
            self._open(tag, rest)
            if tag in VOID:
                if tag == "br":
                    self.texts.append((stack[-2], block, " "))
                self._pop_to(len(stack) - 1)
            elif tag in RAW:
                end = re.compile(f"</{re.escape(tag)}[\\s/>]", re.IGNORECASE).search(source, at)
                self._pop_to(len(stack) - 1)
                at = size if end is None else source.find(">", end.start()) + 1 or size
                if tag in BLOCK:
                    block += 1
        self._pop_to(0)

    def _open(self, tag: str, rest: str) -> None:
        css, names, labels, role, hidden = "", frozenset(), frozenset(), "", False
        if rest and rest != "/":
            found = {k.lower(): (v or "").strip("\"'") for k, v in ATTRIBUTE.findall(rest)}
            css = found.get("class", "")
            if css or "id" in found:
                both = f"{css} {found.get('id', '')}"
                names, labels = frozenset(w.lower() for w in WORDS.findall(both)), frozenset(both.lower().split())
            role = found.get("role", "").lower()
            hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or bool(HIDDEN.search(found.get("style", "")))
        self.tags.append(tag)
        self.classes.append(re.sub(r"[\d|;]+", "", css))
        self.names.append(names)
        self.labels.append(labels)
        self.roles.append(role)
        self.hidden.append(hidden)
        self.parents.append(self._stack[-1])
        self.ends.append(0)
        self._open_at.setdefault(tag, []).append(len(self._stack))
        if tag in BLOCK:
            self._blocks.append(len(self._stack))
        self._stack.append(len(self.tags) - 1)

    def _pop_to(self, depth: int) -> None:
        while len(self._stack) > depth:
            i = self._stack.pop()
            self.ends[i] = len(self.tags)
            if i:
                self._open_at[self.tags[i]].pop()
                if self.tags[i] in BLOCK:
                    self._blocks.pop()

    def _imply(self, closed: set[str], fence: set[str]) -> None:
        """Close the outermost open element of these kinds inside the nearest fence."""
        inner = max((at[-1] for t in fence if (at := self._open_at.get(t))), default=0)
        found = [at[k] for t in closed if (at := self._open_at.get(t)) and (k := bisect_right(at, inner)) < len(at)]
        if found:
            self._pop_to(min(found))

    def _close(self, tag: str) -> None:
        at = self._open_at.get(tag)
        if at and (tag in BLOCK or not self._blocks or self._blocks[-1] < at[-1]):  # else a stray end tag
            self._pop_to(at[-1])

    def fold(self) -> tuple[list[int], list[tuple[int, str, str]]]:
        """For each element its node in the folded tree; and those nodes: (parent, tag, class)."""
        nodes, known, of = [(-1, "#root", "")], {}, [0]
        for i in range(1, len(self.tags)):
            key = (of[self.parents[i]], self.tags[i], self.classes[i])
            node = known.get(key)
            if node is None:
                node = known[key] = len(nodes)
                nodes.append(key)
            of.append(node)
        return of, nodes


def squeeze(text: str) -> str:
    return " ".join(text.split())


def digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big") >> 1


def signature(nodes: list[tuple[int, str, str]]) -> str:
    return ";".join(f"{p}|{tag}|{css}" for p, tag, css in nodes)


def page_profile(page: Page, of: list[int]) -> tuple[int, list[tuple[int, int, int, bool]]]:
    """A hash of all the page's text; and (node, hash of its texts, their length, whether it is several elements) of folded nodes with texts or several elements."""
    texts: dict[int, list[str]] = {}
    everything = []
    for element, _, raw in page.texts:
        text = squeeze(raw)
        if text:
            texts.setdefault(of[element], []).append(text)
            everything.append(text)
    number = Counter(of)
    out = []
    for node in sorted({*texts, *(v for v, n in number.items() if n > 1)}):
        x = texts.get(node, [])
        out.append((node, digest("\n".join(x if len(set(x)) > 1 else x[:1])) if x else 0, sum(map(len, x)), number[node] > 1))
    return digest("\n".join(everything)), out


def page_texts(page: Page, of: list[int]) -> dict[int, list[int]]:
    """Hashes of the different texts of each folded node that has some."""
    out: dict[int, dict[int, None]] = {}
    for element, _, raw in page.texts:
        text = squeeze(raw)
        if text:
            out.setdefault(of[element], {})[digest(text)] = None
    return {v: list(x) for v, x in out.items()}


class Tree:
    """A folded tree or a wrapper: nodes (parent, tag, class), and on how many pages each occurs. Parents come before their children."""

    def __init__(self, nodes: list[tuple[int, str, str]], support: list[int]):
        self.nodes, self.support = nodes, support
        self.children: list[list[int]] = [[] for _ in nodes]
        for i, (p, *_) in enumerate(nodes):
            if p >= 0:
                self.children[p].append(i)

    @classmethod
    def read(cls, text: str, support: list[int] | int) -> Tree:
        nodes = [(int(p), tag, css) for p, tag, css in (x.split("|") for x in text.split(";"))]
        return cls(nodes, [support] * len(nodes) if isinstance(support, int) else list(support))

    def ordered(self, least: int = 0) -> Tree:
        """This tree with its nodes in document order, those with less support left out (a child never has more than its parent)."""
        order, todo = [], [0]
        while todo:
            v = todo.pop()
            if self.support[v] >= least or not v:
                order.append(v)
                todo += reversed(self.children[v])
        to = {v: i for i, v in enumerate(order)}
        return Tree([(to.get(self.nodes[v][0], -1), *self.nodes[v][1:]) for v in order], [self.support[v] for v in order])

    def shapes(self, known: dict[tuple, int]) -> list[int]:
        """A number for each subtree; equal subtrees have equal numbers. known keeps them over several trees."""
        out = [0] * len(self.nodes)
        for v in range(len(self.nodes) - 1, -1, -1):
            out[v] = known.setdefault((*self.nodes[v][1:], *(out[c] for c in self.children[v])), len(known))
        return out

    def sizes(self) -> list[int]:
        out = [1] * len(self.nodes)
        for v in range(len(self.nodes) - 1, 0, -1):
            out[self.nodes[v][0]] += out[v]
        return out


def heaviest_in_order(pairs: list[tuple[int, int, int]]) -> tuple[int, list[tuple[int, int]]]:
    """Of (p, q, weight), the pairs of the largest sum that rise in both p and q, and that sum."""
    places = sorted({q for _, q, _ in pairs})
    rank = {q: i + 1 for i, q in enumerate(places)}
    best: list[tuple[int, int]] = [(0, -1)] * (len(places) + 1)  # a Fenwick tree of the largest sum up to a place and its last pair
    sums, before = [0] * len(pairs), [-1] * len(pairs)
    for k in sorted(range(len(pairs)), key=lambda k: (pairs[k][0], -pairs[k][1])):
        _, q, weight = pairs[k]
        at, top = rank[q] - 1, (0, -1)
        while at:
            top = max(top, best[at], key=lambda x: x[0])
            at &= at - 1
        sums[k], before[k] = top[0] + weight, top[1]
        at = rank[q]
        while at < len(best):
            if sums[k] > best[at][0]:
                best[at] = (sums[k], k)
            at += at & -at
    k = max(range(len(pairs)), key=lambda k: sums[k], default=-1)
    total, out = sums[k] if pairs else 0, []
    while k >= 0:
        out.append(pairs[k][:2])
        k = before[k]
    return total, out[::-1]


def simple_tree_matching(a: Tree, b: Tree) -> dict[int, int]:
    """Nodes of b to the nodes of a that they are matched with.

    Equal subtrees are matched whole. Else only children of one kind can be matched, and the best such pairs in order
    are found among those, so the work grows with the pairs of one kind and not with all pairs.
    """
    known: dict[tuple, int] = {}
    of_a, of_b, size = a.shapes(known), b.shapes(known), b.sizes()
    todo, seen, children = [(0, 0)], {(0, 0)}, {}
    for i, j in todo:  # grows as pairs are found; the pairs of children come after their parents'
        if of_a[i] == of_b[j]:
            continue
        by_tag: dict[str, list[int]] = {}
        for x in a.children[i]:
            by_tag.setdefault(a.nodes[x][1], []).append(x)
        named: dict[tuple[str, str], list[int]] = {}
        for x in a.children[i]:
            named.setdefault(a.nodes[x][1:], []).append(x)
        pairs = []
        for y in b.children[j]:
            tag, css = b.nodes[y][1:]
            pairs += [(x, y) for x in (by_tag.get(tag, ()) if not css else [*named.get((tag, css), ()), *named.get((tag, ""), ())])]
        children[i, j] = pairs
        fresh = [p for p in pairs if p not in seen]
        seen.update(fresh)
        todo += fresh
    weights: dict[tuple[int, int], int] = {}
    chosen: dict[tuple[int, int], list[tuple[int, int]]] = {}
    place_a = {x: p for kids in a.children for p, x in enumerate(kids)}
    place_b = {y: q for kids in b.children for q, y in enumerate(kids)}
    for i, j in reversed(todo):
        if (i, j) not in children:
            weights[i, j] = size[j]
            continue
        total, best = heaviest_in_order([(place_a[x], place_b[y], weights[x, y]) for x, y in children[i, j]])
        weights[i, j] = 1 + total
        chosen[i, j] = [(a.children[i][p], b.children[j][q]) for p, q in best]
    found, todo = {0: 0}, [(0, 0)]
    while todo:
        i, j = todo.pop()
        for x, y in chosen.get((i, j), zip(a.children[i], b.children[j], strict=False)):
            found[y] = x
            todo.append((x, y))
    return found


def absorb(wrapper: Tree, tree: Tree) -> Tree:
    """The wrapper with what is new in tree added in its place, and with tree's pages."""
    found = simple_tree_matching(wrapper, tree)
    for j in range(len(tree.nodes)):  # parents come before their children
        last = None
        for c in tree.children[j]:
            if c not in found:
                found[c] = len(wrapper.nodes)
                wrapper.nodes.append((found[j], *tree.nodes[c][1:]))
                wrapper.support.append(0)
                wrapper.children.append([])
                siblings = wrapper.children[found[j]]
                siblings.insert(siblings.index(last) + 1 if last is not None else 0, found[c])
            last = found[c]
        wrapper.support[found[j]] += tree.support[j]
    return wrapper


class Verdict:
    """What the host's wrapper says of a folded tree: node numbers."""

    __slots__ = ("constant", "region", "path", "little", "last", "shared")

    def __init__(self, constant, region, path, little, last, shared_nodes=(), shared_texts=()):
        self.constant, self.region, self.path, self.little, self.last = (frozenset(x) for x in (constant, region, path, little, last))
        self.shared = frozenset(zip(shared_nodes, shared_texts, strict=True))


def judge(tree: Tree, to: list[int], facts: dict[int, tuple[int, int, int, int, int]], pages: int, shared: dict[int, list[int]] | None = None) -> Verdict:
    """From the wrapper's node for each of the tree's, and (pages with text, lowest hash, highest hash, length, pages with several) of wrapper nodes,
    and the texts that are template among the others of a node."""
    pairs = [(v, t) for v, x in enumerate(to) for t in (shared or {}).get(x, ())]
    texts = [v for v, _ in pairs], [t for _, t in pairs]
    n = len(tree.nodes)
    none = (0, 0, 0, 0, 0)
    known = [facts.get(v, none) for v in to]
    constant = [k >= LEAST_PAGES and 2 * k >= pages and low == high for k, low, high, _, _ in known]
    barred, linked, prose = [False] * n, [False] * n, [False] * n
    own, total, written = [0.0] * n, [0.0] * n, [False] * n
    for v in range(n):
        p, tag, _ = tree.nodes[v]
        barred[v] = p >= 0 and (barred[p] or (tag in DROPPED_TAGS and tag != "form"))
        linked[v] = p >= 0 and (linked[p] or tag == "a")
        prose[v] = p >= 0 and (prose[p] or tag in PROSE)
        if known[v][0] and not (constant[v] or barred[v] or linked[v]):
            own[v] = total[v] = known[v][3] / known[v][0]
            written[v] = prose[v]
    for v in range(n - 1, 0, -1):
        total[tree.nodes[v][0]] += total[v]
        written[tree.nodes[v][0]] |= written[v]
    if not total[0]:
        return Verdict((v for v in range(n) if constant[v]), (), (), (), (), *texts)
    at, path, region, article = 0, [0], [], False

    def holder(v: int) -> int | None:
        """The child of v that is a container and holds most of its text; one that stands for several elements only if a single one inside it does."""
        most, first, x = MOST_OF * total[v], None, v
        while True:
            x = max(tree.children[x], key=lambda c: (total[c], -c), default=None)
            if x is None or total[x] < most or tree.nodes[x][1] not in CONTAINERS and "-" not in tree.nodes[x][1]:
                return None
            first = x if first is None else first
            if 4 * known[x][4] < pages:
                return first

    while True:
        child = holder(at)
        if child is None or (article and own[at]):
            break
        for v in tree.children[at]:
            if v != child and (total[v] if article else written[v] and tree.nodes[v][1] != "header"):
                region.append(v)
            elif v != child:
                todo = [v]
                while todo:  # top headings
                    x = todo.pop()
                    if tree.nodes[x][1] == "h1" and total[x]:
                        region.append(x)
                    elif not barred[x] or tree.nodes[x][1] == "header":
                        todo += tree.children[x]
        path.append(child)
        at, article = child, article or tree.nodes[child][1] in ARTICLES
    region.append(at)
    little = [v for v in range(n) if total[v] <= LITTLE_OF * total[at]]
    end = max(v for v in range(n) if own[v])  # nodes are in document order, so what follows a subtree has larger numbers
    sizes = tree.sizes()
    return Verdict((v for v in range(n) if constant[v]), region, path, little, (v for v in range(n) if v + sizes[v] > end), *texts)


def main_text(page: Page, of: list[int], verdict: Verdict | None = None) -> str:
    """The text of the page's content region without the template's and without marginal parts; by names if there is no verdict."""
    n = len(page.tags)
    inside, drop = [False] * n, [False] * n
    if verdict is not None and verdict.region:
        for i in range(n):
            v, p = of[i], page.parents[i]
            inside[i] = v in verdict.region or (p >= 0 and inside[p])
            bad = page.tags[i] in DROPPED_TAGS or page.hidden[i] or page.roles[i] in DROPPED_ROLES
            if not bad and inside[i] and page.labels[i]:
                bad = (v in verdict.little and bool(page.labels[i] & (DROPPED_NAMES | COMMENT_NAMES))) or (v in verdict.last and bool(page.labels[i] & COMMENT_NAMES))
            drop[i] = p >= 0 and (drop[p] or (bad and v not in verdict.path and v not in verdict.region))
    else:
        inside, drop = named_region(page)
    constant, shared = (verdict.constant, verdict.shared) if verdict is not None else (frozenset(), frozenset())
    shared_nodes = {v for v, _ in shared}
    out: list[str] = []
    block, parts, own = None, [], False
    for e, b, raw in [*page.texts, (0, -1, "")]:
        if b != block:
            text = squeeze("".join(parts))
            if text and own:
                out.append(text)
            block, parts, own = b, [], False
        if inside[e] and not drop[e]:
            text = html.unescape(raw)
            parts.append(text)
            known = of[e] in constant or (of[e] in shared_nodes and (of[e], digest(squeeze(raw))) in shared)
            own = own or (not known and bool(text.strip()))  # a template's words inside a block of the page's own stay
    return "\n".join(out)


def named_region(page: Page) -> tuple[list[bool], list[bool]]:
    """Which elements are in the content region and which are dropped, by tags, roles and names alone."""
    n, tags, ends = len(page.tags), page.tags, page.ends
    articles = [0] * (n + 1)
    for i in range(n):
        articles[i + 1] = articles[i] + (tags[i] in ("article", "main"))
    drop, article = [False] * n, [False] * n
    for i in range(1, n):
        p = page.parents[i]
        article[i] = article[p] or tags[p] == "article"
        holds = articles[ends[i]] > articles[i + 1]
        bad = tags[i] in DROPPED_TAGS or page.hidden[i] or page.roles[i] in DROPPED_ROLES or (tags[i] == "header" and not article[i])
        if tags[i] == "form" and holds:
            bad = False
        names = page.labels[i] if article[i] else page.names[i]
        if not bad and names and tags[i] not in ("html", "body", "main"):
            bad = bool(names & COMMENT_NAMES) or (tags[i] != "article" and not holds and bool(names & (DROPPED_NAMES if article[i] else DROPPED_NAMES | DROPPED_OUTSIDE)))
        drop[i] = drop[p] or bad
    chosen = [i for i in range(n) if (tags[i] in ("article", "main") or page.roles[i] == "main") and not drop[i]]
    plain, linked, link = [0] * (n + 1), [0] * (n + 1), [False] * n
    for i in range(1, n):
        link[i] = link[page.parents[i]] or tags[i] == "a"
    for e, _, raw in page.texts:
        if not drop[e] and raw.strip():
            (linked if link[e] else plain)[e + 1] += 1
    for i in range(n):
        plain[i + 1] += plain[i]
        linked[i + 1] += linked[i]
    if not chosen:
        chosen = [i for i in range(n) if not drop[i] and tags[i] not in ("html", "body") and page.names[i] & CONTENT_NAMES and plain[ends[i]] + linked[ends[i]] > plain[i] + linked[i]]
    inside = [not chosen] * n
    for i in chosen:
        inside[i : ends[i]] = [True] * (ends[i] - i)
    if not chosen:
        for i in range(1, n):
            drop[i] = drop[page.parents[i]] or drop[i] or (tags[i] in ("ul", "ol") and plain[ends[i]] == plain[i] and linked[ends[i]] > linked[i])
    return inside, drop


# --- plans -----------------------------------------------------------------

PROFILE = "host string, tree bigint, whole bigint, facts array<struct<node:int,text:bigint,size:bigint,many:boolean,texts:array<bigint>>>, signature string"
PROFILE_ARROW = pa.schema([("host", pa.string()), ("tree", pa.int64()), ("whole", pa.int64()), ("facts", pa.list_(pa.struct([("node", pa.int32()), ("text", pa.int64()), ("size", pa.int64()), ("many", pa.bool_()), ("texts", pa.list_(pa.int64()))]))), ("signature", pa.string())])
WRAPPER = "host string, signature string, support array<bigint>"
WRAPPER_ARROW = pa.schema([("host", pa.string()), ("signature", pa.string()), ("support", pa.list_(pa.int64()))])
MATCHED = "host string, part int, tree bigint, signature string, to array<int>"
MATCHED_ARROW = pa.schema([("host", pa.string()), ("part", pa.int32()), ("tree", pa.int64()), ("signature", pa.string()), ("to", pa.list_(pa.int32()))])
SETS = ("constant", "region", "path", "little", "last")
SIDES = (*SETS, "shared_nodes", "shared_texts")
VERDICT = "host string, tree bigint, " + ", ".join(f"{x} array<int>" for x in SIDES[:-1]) + ", shared_texts array<bigint>"
VERDICT_ARROW = pa.schema([("host", pa.string()), ("tree", pa.int64()), *((x, pa.list_(pa.int32())) for x in SIDES[:-1]), ("shared_texts", pa.list_(pa.int64()))])


def record_batches(rows: list[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for lo in range(0, len(rows), 1000):
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows[lo : lo + 1000], strict=True), schema, strict=True)], schema=schema)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each page that differs from the task's others, and one with the signature for each tree of a host."""
    pages: set[tuple[str, int]] = set()
    trees: set[tuple[str, int]] = set()
    for batch in batches:
        out = []
        for host, source in zip(batch.column(0).to_pylist(), as_text(batch.column(1)).to_pylist(), strict=True):
            page = Page(source)
            of, nodes = page.fold()
            text = signature(nodes)
            tree = digest(text)
            whole, facts = page_profile(page, of)
            if (host, tree) not in trees:
                out.append((host, tree, None, None, text))
            if (host, whole) not in pages:
                lists = page_texts(page, of)
                out.append((host, tree, whole, [dict(zip(("node", "text", "size", "many", "texts"), (*x, lists.get(x[0], [])), strict=True)) for x in facts], None))
            trees.add((host, tree))
            pages.add((host, whole))
        yield from record_batches(out, PROFILE_ARROW)
        for known in (pages, trees):
            if len(known) > 100_000:  # what comes again is merged later
                known.clear()


def _induce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One wrapper for each run of rows (host, part, signature, support) of one host and part."""
    at, wrapper = None, None
    for host, part, text, support in rows_of(batches):
        if (host, part) != at:
            if at is not None:
                done = wrapper.ordered()
                yield from record_batches([(at[0], signature(done.nodes), done.support)], WRAPPER_ARROW)
            at, wrapper = (host, part), Tree([(-1, "#root", "")], [0])
        wrapper = absorb(wrapper, Tree.read(text, support if len(support) > 1 else support[0]))
    if at is not None:
        done = wrapper.ordered()
        yield from record_batches([(at[0], signature(done.nodes), done.support)], WRAPPER_ARROW)


def _matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """MATCHED for rows (host, part, tree, signature): in each run of one host and part the wrapper (without tree) comes first."""
    wrapper = None
    for host, part, tree, text in rows_of(batches):
        if tree is None:
            wrapper = Tree.read(text, 0)
            continue
        own = Tree.read(text, 0)
        found = simple_tree_matching(wrapper, own)
        yield from record_batches([(host, part, tree, text, [found.get(j, -1) for j in range(len(own.nodes))])], MATCHED_ARROW)


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """VERDICT for rows (host, part, tree, signature, to, pages, facts): in each run the wrapper's pages and facts come first."""
    at, facts, pages, shared = None, {}, 0, {}
    for host, _, tree, text, to, count, known in rows_of(batches):
        if tree is None:
            at, facts, pages = host, {x["v"]: (x["n"], x["low"], x["high"], x["size"], x["many"]) for x in known}, count
            shared = {x["v"]: x["shared"] for x in known if x["shared"]}
            continue
        if host != at:  # a host without any text has no head
            at, facts, pages, shared = host, {}, 0, {}
        v = judge(Tree.read(text, 0), to, facts, pages, shared)
        pairs = sorted(v.shared)
        yield from record_batches([(host, tree, *(sorted(getattr(v, x)) for x in SETS), [p for p, _ in pairs], [t for _, t in pairs])], VERDICT_ARROW)


def shared_texts(different: DataFrame, matched: DataFrame, by_node: DataFrame, totals: DataFrame) -> DataFrame:
    """(host, v, shared): the texts that are template among others of a wrapper node that differ from page to page.

    Such a text is on every page that has the node, LEAST_SHARED different ones and half of the host's at least. And the pages
    must not be copies of each other: all but a tenth of the node's other texts are on one page only, and outweigh the shared ones.
    """
    texts = different.select("host", "tree", F.explode("facts").alias("f")).select("host", "tree", "f.node", F.explode("f.texts").alias("t"))
    placed = texts.join(matched.select("host", "tree", "to"), ["host", "tree"]).withColumn("v", F.get("to", F.col("node"))).where("v >= 0")
    numbers = materialise(placed.groupBy("host", "v", "t").agg(F.count("*").alias("k")), run_folder(different.sparkSession, "page_texts"))
    nodes = by_node.select("host", "v", "n").join(totals, "host").where((F.col("n") >= LEAST_SHARED) & (2 * F.col("n") >= F.col("pages")))
    # a node's texts meet only as counts of how many are on so many pages, and those on many pages; its other texts stay where they are
    spread = numbers.groupBy("host", "v", "k").agg(F.count("*").alias("c")).join(nodes.select("host", "v", "n"), ["host", "v"])
    judged = spread.groupBy("host", "v", "n").agg(
        F.sum(F.when(F.col("k") == F.col("n"), F.col("c") * F.col("k")).otherwise(0)).alias("_shared"), F.sum(F.when(F.col("k") == 1, F.col("c")).otherwise(0)).alias("_single"),
        F.sum(F.when((F.col("k") > 1) & (F.col("k") < F.col("n")), F.col("c") * F.col("k")).otherwise(0)).alias("_some"))
    told = judged.where("_shared > 0 AND 10 * _some <= _single AND _shared < _single + _some").select("host", "v", F.col("n").alias("k"))
    return numbers.where(F.col("k") >= LEAST_SHARED).join(told, ["host", "v", "k"]).groupBy("host", "v").agg(F.sort_array(F.collect_list("t")).alias("shared"))


def _in_runs(heads: DataFrame, rows: DataFrame, partitions: int) -> DataFrame:
    """rows, dealt by host and part, each part after its copy of the host's row of heads."""
    parts = rows.groupBy("host").agg(F.max("part").alias("_last"))
    spread = heads.join(parts, "host").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("_last")))).select(rows.columns)
    return spread.unionByName(rows).repartition(partitions, "host", "part").sortWithinPartitions("host", "part", F.asc_nulls_first("tree"))


def wrappers(pages: DataFrame) -> DataFrame:
    """VERDICT of each folded tree of each host that has a wrapper, from rows (host, html); read from a table."""
    spark = pages.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    profiles = materialise(pages.select("host", "html").mapInArrow(_profiles, PROFILE), run_folder(spark, "page_profiles"))
    different = profiles.where("whole IS NOT NULL").groupBy("host", "whole").agg(F.min(F.struct("tree", "facts")).alias("p"))
    different = materialise(different.select("host", "p.tree", "p.facts"), run_folder(spark, "different_pages"))
    counts = different.groupBy("host", "tree").agg(F.count("*").alias("pages"))
    totals = materialise(counts.groupBy("host").agg(F.sum("pages").alias("pages")).where(F.col("pages") >= LEAST_PAGES), run_folder(spark, "host_pages"))
    trees = profiles.where("signature IS NOT NULL").groupBy("host", "tree").agg(F.min("signature").alias("signature")).join(totals.select("host"), "host", "left_semi")
    sized = trees.groupBy("host").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("parts"))
    dealt = trees.join(counts, ["host", "tree"], "left").join(sized, "host").select("host", F.pmod(F.xxhash64("tree"), F.col("parts")).cast("int").alias("part"), "tree", "signature", F.coalesce("pages", F.lit(0)).alias("pages"))
    trees = materialise(dealt, run_folder(spark, "page_trees"))
    level = trees.where("pages > 0").select("host", "part", "signature", F.array("pages").alias("support"), F.col("tree").alias("_order"))
    while True:
        runs = level.repartition(partitions, "host", "part").sortWithinPartitions("host", "part", "_order", "signature").drop("_order")
        made = materialise(runs.mapInArrow(_induce, WRAPPER), run_folder(spark, "wrappers"))
        sized = made.groupBy("host").agg(F.count("*").alias("_n"))
        if not sized.where("_n > 1").limit(1).count():
            break
        level = made.join(sized, "host").select("host", F.pmod(F.xxhash64("signature"), F.ceil(F.col("_n") / GROUP)).cast("int").alias("part"), "signature", "support", F.lit(0).cast("long").alias("_order"))
    rows = trees.select("host", "part", "tree", "signature")
    heads = made.select("host", F.lit(None).cast("long").alias("tree"), "signature")
    matched = materialise(_in_runs(heads, rows, partitions).select("host", "part", "tree", "signature").mapInArrow(_matched, MATCHED), run_folder(spark, "matched_trees"))
    facts = different.select("host", "tree", F.explode("facts").alias("f")).groupBy("host", "tree", "f.node").agg(
        F.sum((F.col("f.size") > 0).cast("long")).alias("n"), F.min(F.when(F.col("f.size") > 0, F.col("f.text"))).alias("low"), F.max(F.when(F.col("f.size") > 0, F.col("f.text"))).alias("high"),
        F.sum("f.size").alias("size"), F.sum(F.col("f.many").cast("long")).alias("many"))
    placed = facts.join(matched.select("host", "tree", "to"), ["host", "tree"]).withColumn("v", F.col("to")[F.col("node")]).where("v >= 0")
    by_node = placed.groupBy("host", "v").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("size").alias("size"), F.sum("many").alias("many"))
    by_node = by_node.join(shared_texts(different, matched, by_node, totals), ["host", "v"], "left")
    by_host = by_node.groupBy("host").agg(F.collect_list(F.struct("v", "n", "low", "high", "size", "many", "shared")).alias("facts"))  # a wrapper's nodes
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    heads = totals.join(by_host, "host").select("host", none("bigint", "tree"), none("string", "signature"), none("array<int>", "to"), "pages", "facts")
    rows = matched.select(*matched.columns, none("bigint", "pages"), none(by_host.schema["facts"].dataType, "facts"))
    return materialise(_in_runs(heads, rows, partitions).mapInArrow(_judged, VERDICT), run_folder(spark, "verdicts"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of each page.

    Pages are parsed twice and stay where they are; only if there are too many trees to send their verdicts to all
    tasks, they are parsed once more and joined with them.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), host_of(F.col(url_col).cast("string")).alias("host"), F.col(html_col).cast("string").alias("html"))
    found = wrappers(rows)
    fields = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])
    kind = "page_id bigint, url string, text string, n_chars bigint"

    def texts(batch: pa.RecordBatch, verdict_of) -> pa.RecordBatch:
        out = []
        for i, source in enumerate(as_text(batch.column(3)).to_pylist()):
            page = Page(source)
            of, nodes = page.fold()
            out.append(main_text(page, of, verdict_of(i, nodes)))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], schema=fields)

    number, nodes = found.agg(F.count("*"), F.sum(sum((F.size(x) for x in SIDES), F.lit(0)).cast("long"))).first()
    if number <= BROADCAST_ROWS and (nodes or 0) <= BROADCAST_NODES:
        shared = spark.sparkContext.broadcast({(r[0], r[1]): Verdict(*r[2:]) for r in found.collect()})

        def by_table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hosts = batch.column(2).to_pylist()
                yield texts(batch, lambda i, nodes, hosts=hosts: shared.value.get((hosts[i], digest(signature(nodes)))))

        return rows.mapInArrow(by_table, kind)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            trees = [digest(signature(Page(source).fold()[1])) for source in as_text(batch.column(3)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(trees, pa.int64())], names=[*batch.schema.names, "tree"])

    keyed = rows.mapInArrow(named, "page_id bigint, url string, host string, html string, tree bigint")
    joined = keyed.join(found, ["host", "tree"], "left").select("page_id", "url", "host", "html", *SIDES)

    def by_row(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [batch.column(4 + k).to_pylist() for k in range(len(SIDES))]
            yield texts(batch, lambda i, _, sides=sides: None if sides[0][i] is None else Verdict(*(x[i] for x in sides)))

    return joined.mapInArrow(by_row, kind)


def op8_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
