"""Main text of web pages, with wrappers induced from pages of the same host.

A host's wrapper comes of all its pages: blocks of the main element that most
of the different pages have at the same place are its template, slots that
vary hold content. (``matched`` aligns two pages' slots.) What a page says about itself comes first: elements
whose names, roles or classes make them menus, notices or adverts are neither,
and an article element holds the content where there is one.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import blake2b
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framesift.llm.batches import pieces
from framesift.llm.shared import settled
from framesift.llm.urls import host

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong "
    "sub sup time tt u var wbr td th".split())
# Never content, whatever is in them.
UNSEEN = frozenset(
    "script style noscript template head title nav header footer aside form button select textarea iframe object svg "
    "canvas dialog menu audio video map".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar".split())
PART = (
    r"(?:ads?|adverts?|advertisements?|advertising|sponsor(?:ed|s)?|promos?|banner|nav|navbar|navigation|menu|"
    r"sidebar|footer|header|masthead|notices?|cookies?|consent|gdpr|popup|modal|overlay|comments?|replies|disqus|respond|"
    r"share|sharing|social|related|recommended|breadcrumbs?|newsletter|subscribe|signup|login|widgets?|pagination|pager|"
    r"toolbar|skip|copyright)")
NAMES = re.compile(rf"(?:^|[\s_-]){PART}(?=$|[\s_-])", re.I)
# A class or an id that as a whole names a part.
WHOLE = re.compile(rf"(?:^|\s){PART}(?=$|\s)", re.I)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTAINERS = frozenset("div section ul ol dl table".split())
MAIN = re.compile(r"(?:^|[\s_-])(?:article|articlebody|content|entry|main|post|story)(?=$|[\s_-])", re.I)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
# A start tag that ends an open element, and the elements that keep it from doing so.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
        "option": ("option",)}
LISTS = frozenset("ul ol dl table select".split())
DEEPEST = 40
SPACES = re.compile(r"\s+")


@dataclass(frozen=True)
class Induction:
    """A host needs at least ``fewest`` different pages; its template is what more
    than a ``share`` of them, and at least ``fewest``, say at the same place.
    Pages differ if their main elements' blocks do, so copies are one page."""

    fewest: int = 4
    share: float = 0.5


class Node:
    __slots__ = ("tag", "names", "children", "parent", "unseen", "holds", "said", "linked")

    def __init__(self, tag: str, attributes: list, parent: Node | None):
        self.tag, self.parent, self.children, self.holds = tag, parent, [], False
        self.names, self.unseen = "", tag in UNSEEN
        self.said = self.linked = -1  # characters, and those in links, once counted
        for key, value in attributes:
            # Generators make ids of headings and paragraphs from what these say.
            if key == "class" or key == "id" and tag != "p" and tag not in HEADINGS:
                self.names += f" {value or ''}"
            elif key == "itemprop" and value:
                self.names += f" {value}"
            elif key == "role" and value:
                self.unseen |= value.lower() in ROLES
                if value.lower() in ("main", "article"):
                    self.names += " main"
            elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and value and HIDDEN.search(value):
                self.unseen = True


class Tree(HTMLParser):
    """A page's elements as browsers would mend them, near enough."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", [], None)
        self.open: Counter[str] = Counter()
        self.mains: list[Node] = []

    def handle_starttag(self, tag, attributes):
        if tag not in INLINE and self.open["p"]:
            self.end("p", ("article", "div", "section", "td", "main", "body", "blockquote"))
        for ended in ENDS.get(tag, ()):
            if self.open[ended]:
                self.end(ended, LISTS)
        node = Node(tag, attributes, self.at)
        self.at.children.append(node)
        if tag in ("article", "main"):
            self.mains.append(node)
            up = node
            while up is not None and not up.holds:  # what holds an article isn't dropped for its class
                up.holds, up = True, up.parent
        if tag not in VOID:
            self.at = node
            self.open[tag] += 1

    def handle_startendtag(self, tag, attributes):
        self.handle_starttag(tag, attributes)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if self.open[tag]:
            self.end(tag, ())

    def end(self, tag, within):
        node = self.at
        while node.tag != tag:
            if node.tag in within or node.parent is None:
                return
            node = node.parent
        while self.at is not node.parent:
            self.open[self.at.tag] -= 1
            self.at = self.at.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parsed(html: str) -> Tree:
    tree = Tree()
    tree.feed(html)
    tree.close()  # what is left in its buffer
    return tree


def weighed(top: Node) -> None:
    """Counts the characters of all elements under one, and those in links."""
    order, stack = [], [top]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(c for c in node.children if not isinstance(c, str))
    for node in reversed(order):
        below = [c for c in node.children if not isinstance(c, str)]
        node.said = sum(len(c.strip()) for c in node.children if isinstance(c, str)) + sum(c.said for c in below)
        node.linked = node.said if node.tag == "a" else sum(c.linked for c in below)


def dropped(node: Node, main: Node | None = None) -> bool:
    """Whether an element is no content. In the main element a name has to be
    a whole class or id, unless a container holds mostly links; headings there
    go by no name."""
    if node.unseen:
        return True
    if not node.names or node.holds and node.tag not in ("article", "main") or not NAMES.search(node.names):
        return False
    if main is None or main.parent is None:
        return True
    if node.tag in HEADINGS:
        return False
    if WHOLE.search(node.names):
        return True
    if node.tag not in CONTAINERS:
        return False
    if node.said < 0:
        weighed(main)
    return 2 * node.linked > node.said


def spelled(path: str, node: Node) -> str:
    return f"{path}/{node.tag}{node.names}"


def digested(path: str, node: Node) -> str:
    """A path of fixed length, however deep."""
    return blake2b(spelled(path, node).encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()


def blocks(top: Node, step: Callable[[str, Node], str] | None = None) -> list[tuple[str, str]]:
    """What an element says, block by block in page order, each with its path
    (made by ``step``, if given) and white space made single."""
    found: list[tuple[str, str]] = []
    words: list[str] = []
    place = [""]

    def flush():
        text = SPACES.sub(" ", "".join(words)).strip()
        words.clear()
        if text:
            found.append((place[0], text))

    stack: list = [(top, top.tag, False)]
    while stack:
        item, path, leaving = stack.pop()
        if isinstance(item, str):
            words.append(item)
            place[0] = path
        elif leaving:
            flush()
        elif item is top or not dropped(item, top):
            inline = item.tag in INLINE
            if item.tag in ("br", "td", "th"):
                words.append(" ")
            if not inline:
                flush()
                stack.append((item, path, True))
            here = path if item is top or not step or inline else step(path, item)
            stack.extend((child, here, False) for child in reversed(item.children))
    flush()
    return found


def content(tree: Tree) -> tuple[Node, bool]:
    """The element that holds the main text, and whether the page itself says so."""
    def size(node: Node) -> int:
        return sum(len(t) for _, t in blocks(node))

    for tag in ("article", "main"):
        held = [n for n in tree.mains if n.tag == tag and not (n.unseen or n.names and NAMES.search(n.names))]
        if held:
            return (held[0] if len(held) == 1 else max(held, key=size)), True
    named, stack = [], [tree.root]
    while stack:
        node = stack.pop()
        if dropped(node):
            continue
        if node.names and MAIN.search(node.names) and node.tag not in INLINE:
            named.append(node)  # what it holds is in it
        else:
            stack.extend(c for c in node.children if not isinstance(c, str))
    return (max(named, key=size), True) if named else (tree.root, False)


def marked(html: str) -> list[tuple[int, str]]:
    """A page's blocks, each with a 64-bit hash of its path and text."""
    def mark(path: str, text: str) -> int:
        said = f"{path}\n{text}".encode("utf-8", "surrogatepass")
        return int.from_bytes(blake2b(said, digest_size=8).digest(), "little", signed=True)

    return [(mark(path, text), text) for path, text in blocks(content(parsed(html))[0], digested)]


def extract(html: str, template: frozenset[int] = frozenset()) -> str:
    """A page's main text without what its host's template says there."""
    if template:
        return "\n".join(text for mark, text in marked(html) if mark not in template)
    return "\n".join(text for _, text in blocks(content(parsed(html))[0]))


class Slot:
    """A node of a tree to be aligned: a label, its own text, its children."""

    __slots__ = ("label", "path", "text", "children")

    def __init__(self, label: str, path: str):
        self.label, self.path, self.text, self.children = label, path, "", []


def slots(html: str) -> Slot:
    """The main element's blocks as a tree of labelled slots."""
    node, _ = content(parsed(html))
    top = Slot(node.tag, node.tag)
    for path, text in blocks(node, spelled):
        at = top
        steps = path.split("/")[1:][:DEEPEST]
        for k, label in enumerate(steps):
            last = k == len(steps) - 1
            if last or not at.children or at.children[-1].label != label or at.children[-1].text:
                at.children.append(Slot(label, "/".join([top.path, *steps[: k + 1]])))
            at = at.children[-1]
        if at is top:
            at = Slot("", top.path)
            top.children.append(at)
        at.path, at.text = path, text
    return top


def matched(a: Slot, b: Slot) -> tuple[int, list[tuple[Slot, Slot]]]:
    """Simple tree matching: the best order-preserving alignment of two trees,
    equal texts counting for more, and the pairs of slots it aligns."""
    if a.label != b.label:
        return 0, []
    rows, columns = len(a.children), len(b.children)
    best = [[0] * (columns + 1) for _ in range(rows + 1)]
    pairs: dict[tuple[int, int], list] = {}
    for i in range(1, rows + 1):
        for j in range(1, columns + 1):
            score, found = matched(a.children[i - 1], b.children[j - 1])
            here = best[i - 1][j - 1] + score
            best[i][j] = max(here, best[i - 1][j], best[i][j - 1])
            if score and best[i][j] == here:
                pairs[i, j] = found
    aligned, i, j = [(a, b)], rows, columns
    while i and j:
        if (i, j) in pairs and best[i][j] > max(best[i - 1][j], best[i][j - 1]):
            aligned += pairs[i, j]
            i, j = i - 1, j - 1
        elif best[i - 1][j] >= best[i][j - 1]:
            i -= 1
        else:
            j -= 1
    return best[rows][columns] + 1 + 2 * (a.text == b.text and a.text != ""), aligned


def wrappers(pages: DataFrame, induction: Induction = Induction(), url: str = "url", html: str = "html") -> DataFrame:
    """``host, template`` of the hosts that have one: the hashes of its blocks.

    All pages count, however long. Tasks send a page's hashes, not its text;
    a host's different pages are grouped by the hash of their blocks and its
    blocks counted over these, both combined before the shuffle.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "html"):
            hosts, names, marks = [], [], []
            for at, page in zip(piece.column("host").to_pylist(), piece.column("html").to_pylist()):
                found = [m for m, _ in marked(page)] if page else []
                if found:
                    whole = b"".join(m.to_bytes(8, "little", signed=True) for m in found)
                    hosts.append(at)
                    names.append(int.from_bytes(blake2b(whole, digest_size=8).digest(), "little", signed=True))
                    marks.append(sorted(set(found)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(hosts, pa.string()), pa.array(names, pa.int64()), pa.array(marks, pa.list_(pa.int64()))], ["host", "page", "marks"])

    told = pages.select(F.coalesce(host(F.col(url)), F.lit("")).alias("host"), F.col(html).alias("html")).mapInArrow(
        run, "host string, page long, marks array<long>")
    different = settled(told.groupBy("host", "page").agg(F.first("marks").alias("marks")), "different")
    sized = different.groupBy("host").agg(F.count("*").alias("_pages")).where(F.col("_pages") >= induction.fewest)
    counted = different.select("host", F.explode("marks").alias("mark")).groupBy("host", "mark").agg(F.count("*").alias("_n"))
    shared = counted.where(F.col("_n") >= induction.fewest).join(sized, "host").where(F.col("_n") > induction.share * F.col("_pages"))
    return shared.groupBy("host").agg(F.collect_list("mark").alias("template"))


def extracted(pages: DataFrame, induction: Induction = Induction(), page_id: str = "page_id", url: str = "url",
              html: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars``, a row for each page given.

    ``text`` is the main element's blocks, white space inside a block made one
    space, trimmed and joined by line feeds, less the host's template; empty
    for a null or empty page and for one without content. A host with fewer
    than ``induction.fewest`` different pages has no template. Pages without a
    host (also null urls) share a wrapper. Repeated rows have equal texts.
    Other columns are left out whatever they're called.

    Pages aren't shuffled unless wrappers are too large to be sent to all,
    which Spark decides by their size; hosts without a template have no row
    there.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "html"):
            texts = []
            for page, template in zip(piece.column("html").to_pylist(), piece.column("template").to_pylist()):
                texts.append(extract(page, frozenset(template or ())) if page else "")
            yield pa.RecordBatch.from_arrays(
                [piece.column("page_id"), piece.column("url"), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    given = pages.select(
        F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    known = settled(wrappers(given, induction), "wrappers").withColumnRenamed("host", "_host")
    joined = given.join(known, F.coalesce(host(F.col("url")), F.lit("")) == F.col("_host"), "left").select("page_id", "url", "html", "template")
    kind = given.schema["page_id"].dataType.simpleString()
    return joined.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
