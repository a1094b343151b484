"""Main text of web pages by wrapper induction.

Pages of one host and layout are aligned with a reference page of theirs by simple tree matching. A
text that stands in the same aligned place on most of their different pages belongs to the template;
what varies is content. Menus, adverts, forms and the like are known by element and by
the words that end the names in their class, id or role, because their text may vary from page to
page as well.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DataType

from rowassay.llm.shared import sliced
from rowassay.llm.url_filter import host_and_path
from rowassay.session import durable

#: A text is template if it stands in one place on this share of the different pages of its host and layout, …
TEMPLATE_SHARE = 0.7
#: … which are two at least. On fewer than FIRM_PAGES it may be an article and its edited copy: then
#: such texts go only from pages of which they are at most half.
FIRM_PAGES = 5
#: Reference pages are broadcast up to this many characters in all.
BROADCAST_CHARS = 16_000_000
#: Blocks nested deeper become neighbours; their text and its order stay.
DEEPEST = 150
#: A layout is told by the first and last so many containers of a page.
FRAME = 3
CONTAINERS = "div|section|main|header|footer|nav|aside|article|table|ul|ol|dl|form|center"
#: Where references are not broadcast, a group with over 1 / HOT of all pages is dealt over SHARES.
HOT = 1000
SHARES = 64

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript xmp iframe noembed noframes template".split())
INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
DROPPED = frozenset("head nav footer aside form button select option dialog menu svg canvas object audio video map search datalist".split()) | RAW
#: Words that mark an element as no part of the article where a name in its class, id or role ends in them.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu menubar breadcrumb "
    "breadcrumbs masthead footer sidebar sidebars aside cookie cookies consent gdpr notice notices notification comment comments disqus reply replies respond "
    "share sharing social related recommended newsletter subscribe signup popup modal overlay pagination pager toolbar complementary contentinfo search".split()
)
#: Words after a mark that say no more than that this is a part of the page, …
PARTS = frozenset(
    "container wrapper wrap box block list area section region widget slot bar panel pane group row column col inner outer unit item items link links "
    "button buttons icon icons form logo logos media post posts article articles content body header footer title left right top bottom primary secondary main first second third small large mobile desktop".split()
)
#: … and words before one that tell of another element: class="has-sidebar".
TELLING = frozenset("has have no not with without is hide show toggle open close enable disable enabled disabled".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
READERS = frozenset("comment comments reply replies disqus".split())
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
}
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
NAMED = re.compile(r"(?<![\w-])(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")


class Node:
    """A block element, or a run of text (label #text). slot: the aligned node of the reference."""

    __slots__ = ("label", "kids", "text", "out", "main", "groups", "shape", "slot", "number", "named")

    def __init__(self, label: str, out: bool = False, main: bool = False):
        self.label, self.out, self.main = label, out, main
        self.kids: list[Node] = []
        self.text = ""
        self.groups: list[list[Node]] = []
        self.shape = self.number = 0
        self.slot = -1
        self.named = ""


def mark_of(token: str) -> str:
    """The mark a name ends in, parts of pages and numbers left out: cookie-notice, nav_list, not related-work or has-sidebar."""
    words = [w.lower() for w in WORDS.findall(token) if len(w) > 1 and not w.isdigit()]
    if not words or words[0] in TELLING:
        return ""
    while len(words) > 1 and words[-1] in PARTS and words[-1] not in MARKS:
        words.pop()
    return words[-1] if words[-1] in MARKS else ""


@lru_cache(maxsize=2000)  # pages of a layout repeat their tags
def marked(tag: str, attributes: str) -> tuple[str, bool, str]:
    """The label of an element, whether it is no part of an article, and the mark in its names."""
    if not attributes or attributes.isspace():
        return tag, tag in DROPPED, ""
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in NAMED.finditer(attributes)}
    if "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower():
        return tag, True, ""
    keys = ("class", "role") if tag in HEADINGS or tag in INLINE else ("class", "id", "role")
    names = {mark_of(token) for key in keys for token in found.get(key, "").split()}
    marks = READERS if tag == "article" else frozenset() if tag in ("html", "body", "main") else MARKS
    return tag + "." + found.get("class", ""), tag in DROPPED, min(names & marks, key=lambda m: (m not in READERS, m), default="")


def held(root: Node) -> None:
    """Drops the elements with marked names, but none that holds the main content of its page.

    That is a main part, or more than half of the text where no article or main part is elsewhere.
    Comments are no main content, however long.
    """
    order, stack = [], [(root, False)]
    while stack:
        node, under = stack.pop()
        if not node.out:
            order.append((node, under))
            stack += [(kid, under or bool(node.named)) for kid in node.kids]
    chars: dict[int, int] = {}
    mains: set[int] = set()
    elsewhere = any(n.main and not n.named and not under for n, under in order)
    for node, _ in reversed(order):
        kept = [k for k in node.kids if not k.out]
        chars[id(node)] = len(node.text) + sum(chars[id(k)] for k in kept)
        if node.main and not node.label.startswith("article") or any(id(k) in mains for k in kept):
            mains.add(id(node))
    for node, _ in order:
        if node.named:
            most = not elsewhere and 2 * chars[id(node)] > chars[id(root)]
            node.out = node.named in READERS or not (id(node) in mains or most)
            node.main = node.main and not node.out


def parse(page: str) -> Node:
    """The tree of blocks. Inline elements are part of their block's text."""
    root = Node("#page")
    stack: list[tuple[str, Node]] = [("#page", root)]
    run: list[str] = []

    def flush() -> None:
        text = " ".join("".join(run).split())
        run.clear()
        if text:
            leaf = Node("#text")
            leaf.text = text
            stack[-1][1].kids.append(leaf)

    at = 0
    while token := TOKEN.search(page, at):
        if token.start() > at:
            piece = page[at : token.start()]
            run.append(entities.unescape(piece) if "&" in piece else piece)
        at = token.end()
        tag = (token[2] or token[5] or "").lower()
        if not tag:
            continue
        closing = token[1] or token[4]
        attributes = token[3] or token[6] or ""
        if closing:
            if tag in INLINE and not any(t == tag for t, _ in stack[1:]):
                continue
            if any(t == tag for t, _ in stack[1:]):
                flush()
                while stack.pop()[0] != tag:
                    pass
            continue
        if tag in RAW and not attributes.endswith("/"):
            end = re.compile(rf"</{re.escape(tag)}\s*[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else len(page)
            run.append(" ")
            continue
        label, out, named = marked(tag, attributes)
        if tag in INLINE and not out and not named:
            if tag in ("br", "img", "wbr"):
                run.append(" " if tag != "wbr" else "")
            continue
        if tag in VOID:
            flush()
            continue
        flush()
        if tag in CLOSES or tag not in INLINE:
            _close(stack, tag)
        role_main = 'role="main"' in attributes or "role='main'" in attributes
        if tag == "header" and not any(n.main for _, n in stack):
            out = True
        if len(stack) > DEEPEST and not out and not named:
            stack.append((tag, stack[-1][1]))
            continue
        node = Node(label, out, (tag in ("article", "main") or role_main) and not out)
        node.named = named
        stack[-1][1].kids.append(node)
        if not attributes.endswith("/") or tag not in VOID:
            stack.append((tag, node))
    if at < len(page):
        run.append(entities.unescape(page[at:]))
    flush()
    held(root)
    return root


def _close(stack: list[tuple[str, Node]], tag: str) -> None:
    """Ends an open paragraph before any block, and an open item before the next of its kind."""
    for depth in range(len(stack) - 1, 0, -1):
        open_tag = stack[depth][0]
        if open_tag == "p" or open_tag in CLOSES.get(tag, ()):
            del stack[depth:]
            if open_tag == "p":
                continue
            return
        if open_tag not in INLINE and open_tag not in ("td", "th", "li"):
            return


def shaped(node: Node, counter: list[int]) -> None:
    """Numbers the nodes, and joins neighbours of one label into repeated groups."""
    node.number = counter[0]
    counter[0] += 1
    for kid in node.kids:
        shaped(kid, counter)
        if node.groups and node.groups[-1][0].label == kid.label:
            node.groups[-1].append(kid)
        else:
            node.groups.append([kid])
    node.shape = hash((node.label, *[g[0].shape for g in node.groups]))


def matching(a: Node, b: Node, known: dict[tuple[int, int], int]) -> int:
    """Simple tree matching: the size of the largest mapping that keeps order and levels."""
    if a.label != b.label:
        return 0
    key = (a.number, b.number)
    if key not in known:
        known[key] = 1 + _table(a, b, known)[len(a.groups)][len(b.groups)]
    return known[key]


def _table(a: Node, b: Node, known: dict[tuple[int, int], int]) -> list[list[int]]:
    best = [[0] * (len(b.groups) + 1)]
    for ga in a.groups:
        last, row = best[-1], [0]
        for j, gb in enumerate(b.groups):
            row.append(max(row[j], last[j + 1], last[j] + matching(ga[0], gb[0], known)))
        best.append(row)
    return best


def align(a: Node, b: Node, known: dict[tuple[int, int], int]) -> None:
    """Gives the nodes of page b the numbers of the reference nodes they are mapped to."""
    b.slot = a.number
    if a.shape == b.shape:
        pairs = list(zip(a.groups, b.groups, strict=True))
    else:
        best, pairs = _table(a, b, known), []
        i, j = len(a.groups), len(b.groups)
        while i and j:
            own = matching(a.groups[i - 1][0], b.groups[j - 1][0], known)
            if own and best[i][j] == best[i - 1][j - 1] + own:
                pairs.append((a.groups[i - 1], b.groups[j - 1]))
                i, j = i - 1, j - 1
            elif best[i][j] == best[i - 1][j]:
                i -= 1
            else:
                j -= 1
    for ga, gb in pairs:
        for kid in gb:
            align(ga[0], kid, known)


def texts(root: Node) -> list[Node]:
    """The text runs outside dropped elements; inside articles or main parts where a page has them."""
    inside: list[Node] = []
    anywhere: list[Node] = []

    stack = [(root, False)]
    while stack:
        node, main = stack.pop()
        if node.out:
            continue
        main = main or node.main
        if node.label == "#text":
            anywhere.append(node)
            if main:
                inside.append(node)
        stack.extend((kid, main) for kid in reversed(node.kids))
    return inside or anywhere


def place_of(leaf: Node) -> tuple[int, int]:
    return leaf.slot, _hash(leaf.text)


def _hash(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text.encode()) - (1 << 63)


class Wrappers:
    """Parsed reference pages of the hosts a task meets; a bounded number is kept."""

    def __init__(self):
        self.known: dict[str, Node] = {}

    def aligned(self, page: str, reference: str | None) -> list[Node]:
        root = parse(page)
        found = texts(root)
        if reference is not None:
            if reference not in self.known:
                if len(self.known) >= 500:
                    self.known.clear()
                tree = parse(reference)
                shaped(tree, [0])
                self.known[reference] = tree
            shaped(root, [0])
            align(self.known[reference], root, {})
        return found


def layout_of(html: Column) -> Column:
    """A hash of the frame of a page: names and classes of its first containers, names of its last."""
    opened = F.slice(F.regexp_extract_all(html, F.lit(rf"(?i)<(?:{CONTAINERS})\b[^>]*"), F.lit(0)), 1, FRAME)
    first = F.transform(opened, lambda t: F.concat(F.regexp_extract(t, r"<(\w+)", 1), F.lit("."), F.regexp_replace(F.regexp_extract(t, "(?i)\\sclass\\s*=\\s*[\"']?([^\"']*)", 1), "[0-9]+", "")))
    closed = F.regexp_extract_all(html, F.lit(rf"(?i)</({CONTAINERS})\b"), F.lit(1))
    return F.xxhash64(F.lower(F.concat_ws(" ", first, F.lit("/"), F.slice(F.reverse(closed), 1, FRAME))))


def places(pages: DataFrame) -> DataFrame:
    """(host, layout, page, slot, text): hashes of the aligned texts of each page; page is a hash of its texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wrappers = Wrappers()
        for batch in sliced(batches):
            rows = []
            for host, layout, page, reference in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                found = wrappers.aligned(page or "", reference)
                own = _hash("\n".join(x.text for x in found))
                rows += {(host, layout, own, *place_of(x)) for x in found if x.slot >= 0}
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)], names=["host", "layout", "page", "slot", "text"])

    return pages.select("host", "layout", "html", "reference").mapInArrow(run, "host string, layout long, page long, slot int, text long")


def induce(pages: DataFrame) -> DataFrame:
    """(host, layout, n, reference, template): a reference page per host and layout, and the places that are template.

    pages: host, layout, html. Every page is aligned and counted; copies of a page count once.
    """
    group = ["host", "layout"]
    references = durable(pages.where("html IS NOT NULL").groupBy(group).agg(F.count("*").alias("n"), F.min_by("html", F.struct(F.xxhash64("html"), "html")).alias("reference")))
    found = durable(places(with_reference(pages, references)).distinct())  # read twice, parsed once
    pages_of = found.groupBy(group).agg(F.count_distinct("page").alias("pages"))
    counted = found.groupBy(*group, "slot", "text").agg(F.count("*").alias("found")).where("found >= 2")
    constant = counted.join(pages_of, group).where(F.col("found") >= TEMPLATE_SHARE * F.col("pages"))
    place = F.struct("slot", "text", (F.col("found") >= FIRM_PAGES).alias("firm"))
    template = constant.groupBy(group).agg(F.sort_array(F.collect_list(place)).alias("template"))
    return durable(references.join(template, group, "left"))


def with_reference(pages: DataFrame, references: DataFrame) -> DataFrame:
    """The pages with the columns of their group. Broadcast by size; beyond it hot groups are dealt over shares."""
    group = ["host", "layout"]
    chars, rows = references.agg(F.sum(F.length("reference")), F.sum("n")).first()
    if (chars or 0) <= BROADCAST_CHARS:
        return pages.join(F.broadcast(references.drop("n")), group, "left")
    hot = references.select(*group, (F.col("n") * HOT > rows).alias("hot")).where("hot")  # fewer than HOT rows
    dealt = pages.join(F.broadcast(hot), group, "left").withColumn("share", F.when(F.col("hot"), F.pmod(F.xxhash64("html"), F.lit(SHARES))).otherwise(F.lit(0).cast("long")))
    shares = F.when(F.col("n") * HOT > rows, F.sequence(F.lit(0).cast("long"), F.lit(SHARES - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    return dealt.join(references.withColumn("share", F.explode(shares)).drop("n"), [*group, "share"], "left").drop("share", "hot")


def content(found: list[Node], template: list[dict]) -> list[str]:
    """The texts that are no template. What few pages share goes only if it is at most half of what is left."""
    firm = {(x["slot"], x["text"]) for x in template if x["firm"]}
    loose = {(x["slot"], x["text"]) for x in template if not x["firm"]}
    left = [(x.text, place in loose) for x in found if (place := place_of(x)) not in firm] if template else [(x.text, False) for x in found]
    if 2 * sum(len(t) for t, shared in left if shared) > sum(len(t) for t, _ in left):
        return [t for t, _ in left]
    return [t for t, shared in left if not shared]


def extract(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """One row per page: id, url, text, n_chars.

    Blocks are joined by one line feed in page order; white space inside a block is one space. A
    null or empty page has empty text. Pages without a host are aligned with each other. Repeated
    pages each get their row, null ids and URLs stay null, an empty table gives no rows. Whole pages
    are read however long; blocks nested deeper than DEEPEST keep their text, not their own place.
    """
    host, _ = host_and_path(F.col(url_column))
    named = pages.select(F.col(id_column).alias("id"), F.col(url_column).alias("url"), F.coalesce(host, F.lit("")).alias("host"), F.col(html_column).cast("string").alias("html"))
    named = named.withColumn("layout", layout_of(F.coalesce("html", F.lit(""))))
    wrappers = induce(named.select("host", "layout", "html"))
    joined = with_reference(named, wrappers).select("id", "url", "html", "reference", "template")
    kind: DataType = pages.schema[id_column].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Wrappers()
        for batch in sliced(batches):
            out = []
            for page, reference, template in zip(*[batch.column(c).to_pylist() for c in ("html", "reference", "template")], strict=True):
                found = known.aligned(page or "", reference if template else None)
                out.append("\n".join(content(found, template or [])))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], names=["id", "url", "text", "n_chars"])

    rows = joined.mapInArrow(run, f"id {kind.simpleString()}, url string, text string, n_chars long")
    return rows.select(F.col("id").alias(id_column), F.col("url").alias(url_column), "text", "n_chars")
