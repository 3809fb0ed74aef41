"""Main text of web pages by wrapper induction over same-host pages.

Pages are dealt by host (large hosts in parts).  A task parses the pages of a part into block trees and
aligns each tree with the part's pivot page by simple tree matching; what is aligned with a node of the
pivot is a slot of the wrapper.  Over the pages that differ (copies and near copies vote once), slots are judged:

* text that most pages have in the same slot is template;
* slots whose text is mostly links are menus;
* what varies is content, unless its kind says otherwise (nav, footer, aside, scripts, styles, reader comments).
  Class names and forms only break ties: a slot marked as an advert or a sidebar goes, but not if the wrapper
  finds more than half of the host's varying text in it, or if it holds an article.

With article or main elements, content is what lies in the smallest subtree that holds all of them; in them,
text is template only on the word of four pages or more.  Parsing and walking are iterative and linear in the page.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyloom.llm.scratch import stash

#: Pages of a part, about; levels of a tree that are aligned (deeper blocks vote with their ancestor there); children that are aligned one by one.
PART, LEVELS, KIDS = 128, 48, 48
#: Large hosts that are broadcast, at most; more of them are joined by a shuffle.
TOLD = 65536
#: Share of the pages that must have a text for it to be template; share of links that makes a menu; share of shared text that makes near copies.
MOST, LINKS, ALIKE = 0.6, 0.6, 0.5
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
SKIP = frozenset("script style noscript template nav footer aside button select option textarea input iframe object svg canvas dialog menu head title".split())
RAW = frozenset("script style textarea title noscript iframe".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Siblings of these kinds that follow each other are one slot.
RUNS = frozenset("p li tr td th dt dd h1 h2 h3 h4 h5 h6 blockquote pre figure".split())
#: Start tags that end an open element of these kinds.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("html body table ul ol dl article section div main aside nav footer header form".split())
MARKS = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscri\w*|sidebar|side|widget|menu|nav\w*|breadcrumbs?|toolbar|footer|foot|masthead|topbar|share|sharing|social|related|recommended|login|signin|signup|search|pagination|pager)(?=$|[\s_-])", re.I)
REPLIES = re.compile(r"(?:^|[\s_-])(?:comments?|commentlist|respond|replies|disqus)(?=$|[\s_-])", re.I)
# a start tag whose quotes do not close ends at its first ">"
TOKEN = re.compile(r"<!--.*?(-->|\Z)|<[!?][^>]*>|</([a-zA-Z][^\s/>]*)[^>]*>|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
ATTR = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)


class Node:
    """A block element, or an inline one that is left out: items are its children and texts in page order.

    out: left out for its kind; gone: in such a one; marked: the nearest element around it, itself included, that class
    names mark (or a form); holds: an article lies in it; inner: in an article or main; links: characters in links among its own texts.
    """

    __slots__ = ("tag", "label", "out", "gone", "mark", "marked", "holds", "inner", "links", "items", "parent", "depth")

    def __init__(self, tag: str, parent: Node | None, out: bool = False, mark: bool = False, label: str = ""):
        self.tag, self.label, self.parent, self.out, self.mark = tag, label or tag, parent, out, mark
        self.depth = parent.depth + 1 if parent else 0
        self.gone = out or bool(parent and parent.gone)
        self.marked = self if mark else parent.marked if parent else None
        self.holds = False
        self.inner = tag in ("article", "main") or bool(parent and parent.inner)
        self.links = 0
        self.items: list[Node | str] = []


class Page:
    """A parsed page: its tree, title, marked elements from outer to inner, and outermost articles."""

    def __init__(self, page: str):
        self.root, self.title, self.marks, self.articles = Node("html", None), "", [], []
        self._parse(page)
        self.blocks = blocks(self.root)
        found = [a for a in self.articles if blocks(a)]
        self.region = found[0] if found else self.root
        for x in found[1:]:  # the smallest subtree that holds both
            while x is not self.region:
                if x.depth >= self.region.depth:
                    x = x.parent
                else:
                    self.region = self.region.parent

    def _parse(self, page: str) -> None:
        node, at = self.root, 0
        stop = page.rfind(">") + 1  # no tag ends beyond
        open_: list[tuple[str, Node]] = []  # every open element with the block that was open before it
        live: Counter = Counter()

        def text(x: str) -> None:
            node.items.append(html.unescape(x) if "&" in x else x)
            if live["a"]:
                node.links += len(x.strip())

        def close(kinds, bound: bool) -> None:
            """Close the nearest open element of these kinds and all in it; with bound, only up to the nearest of SCOPE."""
            nonlocal node
            if not any(live[k] for k in kinds):
                return
            for k in range(len(open_) - 1, -1, -1):
                if open_[k][0] in kinds:
                    node = open_[k][1]
                    for tag, _ in open_[k:]:
                        live[tag] -= 1
                    del open_[k:]
                    return
                if bound and open_[k][0] in SCOPE:
                    return

        while at < stop:
            m = TOKEN.search(page, at, stop)
            if not m:
                break
            if m.start() > at:
                text(page[at : m.start()])
            at = m.end()
            if m[1] == "":  # a comment without an end
                return
            if m[2]:
                close({m[2].lower()}, False)
                continue
            name = m[3] or m[5]
            if not name:
                continue
            tag, attrs = name.lower(), m[4] or m[6] or ""
            if tag in RAW:
                after = re.compile(rf"</{tag}[\s/>]", re.I).search(page, at)
                if tag == "title" and not self.title:
                    self.title = page[at : after.start() if after else len(page)]
                end = page.find(">", after.start()) + 1 if after else 0
                if not end:
                    return
                at = end
                continue
            if tag == "br":
                node.items.append("\n")
                continue
            if tag in BLOCK:
                close({"p"}, True)  # a block ends an open paragraph
            if tag in ENDS:
                close(ENDS[tag], True)
            out = mark = False
            label = tag
            if attrs:
                found = [(a[0].lower(), a[1] or a[2] or a[3]) for a in ATTR.findall(attrs)]
                names = " ".join(v for k, v in found if k in ("class", "id", "role"))
                out = any(k == "hidden" or k == "aria-hidden" and v.lower() == "true" for k, v in found) or bool(names and REPLIES.search(names))
                mark = tag not in ("html", "body", "article", "main") and bool(names and MARKS.search(names))
                if tag not in ("html", "body", "article", "main") and (own := next((v for k, v in found if k == "class"), "").split()):
                    label = f"{tag}.{own[0].strip('0123456789')}"
            mark = mark or tag == "form"
            inner = live["article"] + live["main"]
            out = out or tag in SKIP or tag == "header" and not inner
            if tag in ("article", "main") and not out and not node.gone:
                up = node  # marks like "has-sidebar" on what holds an article say nothing
                while up is not None and not up.holds:
                    up.holds = True
                    up = up.parent
            if tag in VOID or attrs.endswith("/") and tag not in BLOCK:
                continue
            open_.append((tag, node))
            live[tag] += 1
            if tag in BLOCK or out or mark:
                child = Node(tag, node, out, mark, label)
                node.items.append(child)
                if mark:
                    self.marks.append(child)
                if tag in ("article", "main") and not node.inner and not child.gone:
                    self.articles.append(child)
                node = child
        rest = page[at:]
        if "<!--" in rest:
            rest = rest[: rest.index("<!--")]
        if rest:
            text(rest)


def blocks(root: Node) -> list[tuple[Node, str]]:
    """(block, text) in page order of what is not left out, white space turned into single spaces; a block's own texts around inner blocks are blocks of their own.

    Inline elements stand here only if they are marked or left out; marked ones give a text of their own.
    """
    out: list[tuple[Node, str]] = []
    held: list[str] = []
    stack, x, i = [], root, 0

    def flush() -> None:
        if held and (text := " ".join("".join(held).split())):
            out.append((x, text))
        held.clear()

    while True:
        if i < len(x.items):
            item = x.items[i]
            i += 1
            if isinstance(item, str):
                held.append(item)
            elif item.tag in BLOCK or not item.out:
                flush()
                if not item.out:
                    stack.append((x, i))
                    x, i = item, 0
        else:
            flush()
            if not stack:
                return out
            x, i = stack.pop()


class Slot:
    """A node of the tree that is aligned: one element, or a run of like ones, with all their children."""

    __slots__ = ("label", "nodes", "kids", "shape")


class Shapes:
    """Interned shapes (label, shapes of the children): equal shapes are one object, so they are matched once."""

    def __init__(self):
        self.held: dict[tuple, tuple] = {}
        self.memo: dict = {}

    def slot(self, nodes: list[Node], level: int = 0) -> Slot:
        s = Slot()
        s.label, s.nodes, s.kids = nodes[0].label, nodes, []
        inside = [x for node in nodes for x in node.items if isinstance(x, Node) and not x.out]
        if level < LEVELS:
            for by in (lambda x: x.label, lambda x: x.tag):
                runs: list[list[Node]] = []
                for x in inside:
                    if runs and x.tag in RUNS and runs[-1][0].label == x.label:
                        runs[-1].append(x)
                    else:
                        runs.append([x])
                if len(runs) <= KIDS:
                    break
                groups: dict[str, list[Node]] = {}  # too many: all of a label, or at last of a tag, are one
                for x in inside:
                    groups.setdefault(by(x), []).append(x)
                runs = list(groups.values())
                if len(runs) <= KIDS:
                    break
            s.kids = [self.slot(r, level + 1) for r in runs]
        else:
            s.nodes = list(nodes)
            for x in s.nodes:  # grows
                s.nodes += [y for y in x.items if isinstance(y, Node) and not y.out]
        s.shape = self.held.setdefault((s.label, *(id(k.shape) for k in s.kids)), (s.label, *(k.shape for k in s.kids)))
        return s


def match(a: tuple, b: tuple, memo: dict) -> tuple[int, list[tuple[int, int]]]:
    """Simple tree matching of two shapes (which outlive the memo): the size of the largest order-preserving match of equal labels, and the children it pairs."""
    if a[0] != b[0]:
        return 0, []
    key = id(a), id(b)
    if key in memo:
        return memo[key]
    m, n = len(a), len(b)
    if a is b:
        memo[key] = 1 + sum(match(x, x, memo)[0] for x in a[1:]), [(i, i) for i in range(m - 1)]
        return memo[key]
    best = [[0] * n for _ in range(m)]
    for i in range(1, m):
        for j in range(1, n):
            best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + match(a[i], b[j], memo)[0])
    pairs, i, j = [], m - 1, n - 1
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            pairs.append((i - 1, j - 1))
            i, j = i - 1, j - 1
    memo[key] = best[-1][-1] + 1, pairs[::-1]
    return memo[key]


def align(pivot: Slot, page: Slot, memo: dict) -> Iterator[tuple[Slot, Slot]]:
    """Pairs of slots of the pivot and the page that the match of their trees joins."""
    todo = [(pivot, page)]
    while todo:
        a, b = todo.pop()
        yield a, b
        todo += [(a.kids[i], b.kids[j]) for i, j in match(a.shape, b.shape, memo)[1]]


def voters(pages: list[Page]) -> list[int]:
    """Pages that differ: of copies, and of near copies (same title and first heading, and mostly the same text), the first."""
    named: dict[tuple, list[tuple[int, set]]] = {}
    for i, p in enumerate(pages):
        texts = {t for _, t in p.blocks}
        if not texts:
            continue
        known = named.setdefault((p.title, next((t for b, t in p.blocks if b.tag == "h1"), None)), [])
        size = sum(map(len, texts))
        for _, other in known:
            both = sum(map(len, texts & other))
            if both >= ALIKE * (size + sum(map(len, other)) - both):
                break
        else:
            known.append((i, texts))
    return sorted(i for group in named.values() for i, _ in group)


class Wrapper:
    """What the pages of a part tell of each other; without two pages that differ, nothing."""

    def __init__(self, pages: list[Page]):
        self.pages, self.slot_of = pages, [{} for _ in pages]
        self.votes: dict[int, Counter] = {}
        self.menus: set[int] = set()
        self.main: set[int] = set()
        asked = voters(pages)
        self.n = len(asked)
        if self.n < 2:
            return
        shapes = Shapes()
        slots = [shapes.slot([p.root]) for p in pages]
        common = Counter(id(slots[i].shape) for i in asked)
        self.pivot = slots[max(asked, key=lambda i: (common[id(slots[i].shape)], len(pages[i].blocks), -i))]  # kept: its slots are told by their ids
        for i, s in enumerate(slots):
            for p, q in align(self.pivot, s, shapes.memo):
                for node in q.nodes:
                    self.slot_of[i][node] = id(p)
        size, links = Counter(), Counter()
        for i in asked:
            for key in {(self.slot_of[i].get(b), t) for b, t in pages[i].blocks}:
                self.votes.setdefault(key[0], Counter())[key[1]] += 1
            for b, t in pages[i].blocks:
                size[self.slot_of[i].get(b)] += len(t)
            for b in {b for b, _ in pages[i].blocks}:
                links[self.slot_of[i].get(b)] += b.links
        self.menus = {s for s in size if s is not None and links[s] >= LINKS * size[s]}
        # marked slots that hold most of what varies
        total, held = 0, Counter()
        for i in asked:
            inside: dict[Node, int] = {}
            for b, t in self.varying(i):
                total += len(t)
                if b.marked:
                    inside[b.marked] = inside.get(b.marked, 0) + len(t)
            for m in reversed(pages[i].marks):  # inner before outer
                if m in inside:
                    held[self.slot_of[i].get(m)] += inside[m]
                    if m.parent.marked:
                        inside[m.parent.marked] = inside.get(m.parent.marked, 0) + inside[m]
        self.main = {s for s, k in held.items() if s is not None and 2 * k > total}

    def template(self, i: int, block: Node, text: str) -> bool:
        slot = self.slot_of[i].get(block)
        if slot is None or block.inner and self.n < 4:
            return False
        return self.votes[slot][text] >= max(3 if block.inner else 2, MOST * self.n)

    def varying(self, i: int) -> list[tuple[Node, str]]:
        """The blocks of a page that are neither template nor menus."""
        return [(b, t) for b, t in self.pages[i].blocks if not self.template(i, b, t) and (b.inner or self.slot_of[i].get(b) not in self.menus)]

    def text(self, i: int) -> str:
        """The main text of a page."""
        page = self.pages[i]
        dropped: set[Node] = set()
        for m in page.marks:  # outer before inner
            if m.parent.marked in dropped or not m.holds and self.slot_of[i].get(m) not in self.main:
                dropped.add(m)
        inside = {b for b, _ in blocks(page.region)} if page.region is not page.root else None
        return "\n\n".join(t for b, t in self.varying(i) if b.marked not in dropped and (inside is None or b in inside))


def extract_part(pages: list[str]) -> list[str]:
    """The main text of each of some pages of one host, which must differ from each other."""
    wrapper = Wrapper([Page(p) for p in pages])
    return [wrapper.text(i) for i in range(len(pages))]


def extract(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """One row per row of pages: ``page_id, url, text``.

    Null or empty html gives an empty text; pages without a host in their url are one host; repeated rows give
    rows of their own, and a task holds a page that repeats once; an empty table gives an empty result; other columns are not
    read.  Hosts with over PART pages are dealt in parts by hash; a part sees all its pages before the first text
    is given, in an order of its own, so neither the order of rows nor ties decide on anything.  Whole pages of any
    length and depth are read.
    """
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(page).alias("html")).withColumn("_host", F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1)))
    counts = rows.groupBy("_host").count().filter(F.col("count") > PART)
    parts = stash(counts.select(F.col("_host").alias("_h"), F.ceil(F.col("count") / PART).cast("int").alias("_parts")), "hosts")
    few = parts.count() <= TOLD
    dealt = rows.join(F.broadcast(parts) if few else parts, F.col("_host") == F.col("_h"), "left").withColumn("_part", F.pmod(F.xxhash64("page_id", "url"), F.coalesce("_parts", F.lit(1))))
    kind = pages.schema[page_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple]] = {}
        for batch in batches:
            for i, u, h in zip(batch.column("page_id").to_pylist(), batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True):
                held.setdefault(h or "", []).append((i, u))
            id_type = batch.schema.field("page_id").type
        order = sorted(held, key=lambda h: (min(str(r) for r in held[h]), h))
        for h, text in zip(order, extract_part(order), strict=True):
            rows = held[h]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], id_type), pa.array([u for _, u in rows], pa.string()), pa.array([text] * len(rows), pa.string())], names=["page_id", "url", "text"])

    dealt = dealt.select("_host", "_part", "page_id", "url", "html")
    if not few:  # else the groups would stay where the join has put whole hosts
        dealt = dealt.repartition("_host", "_part")
    return dealt.groupBy("_host", "_part").applyInArrow(run, f"page_id {kind}, url string, text string")


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumn("n_chars", F.char_length("text").cast("long"))
