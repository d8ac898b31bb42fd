"""HTML extraction with removal of site templates.

Every element subtree outside a page's own article and every box inside of it is hashed; Spark counts on how many pages of a host each hash
occurs, and subtrees that recur on many pages of their host are deleted before the text is taken. In an ``article`` or ``main`` paragraphs,
headings, quotes and list items are that page's content and aren't counted: passages that many articles share are no template. Elements whose tag or
role says that they are a menu, header, footer, form or the like go as well, and elements whose whole name says advert, notice or comments, so that hosts with few pages come out clean too.

All steps take time in proportion to a page's length, also where its markup is broken on purpose.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.llm.common import chunks, small_batches
from kgspark.session import cut

#: A subtree is a template if it occurs on so many pages of its host, and on this share of them or on ``MANY_PAGES``.
LEAST_PAGES = 5
LEAST_SHARE = 0.2
MANY_PAGES = 50
#: Template hashes that are sent to the tasks, at most: 16 MB.
SENT = 2_000_000

#: Elements of HTML by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main "
    "menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: A start tag of a block ends an open paragraph; these also end an open element of their own kind, up to the nearest scope.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
#: Inside an article: what may be a template, and what is never taken apart.
BOX = frozenset("a address center details div dl fieldset figure menu ol section span table ul".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd td th caption figcaption summary".split())
NEVER = frozenset("head script style noscript template iframe nav footer aside form button select option textarea input svg canvas object embed audio video dialog menu search".split())
NEVER_ROLE = frozenset("navigation banner contentinfo complementary search form alert dialog alertdialog menu menubar toolbar".split())
#: Whole names by which an element of any kind says that it isn't the article, alone or (adverts) as a name's first part; other names are left to counting.
NEVER_NAME = re.compile("(?:ads?|adverts?|advertisements?)(?:[-_].*)?|menu|sidebar|notices?|comments")
KEPT = frozenset("html body main article".split())
#: Articles of these names announce other pages.
NOT_OWN = frozenset(["teaser", "related", "comment", "promo"])
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
COMMENT_END = re.compile(r"--!?>")
#: The rest of a tag up to its end; quoted values may hold any character.
REST = re.compile(r"""((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
#: An attribute: what separates it, its name, and its value if it has one.
ATTRIBUTE = re.compile(r"""[\s/]*+([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]*+)))?+""")
SPACE = re.compile(r"\s+")


class Node:
    """An element: its tag, names and roles, and children, which are nodes and texts."""

    __slots__ = ("tag", "names", "role", "hidden", "children", "number")

    def __init__(self, tag: str, attributes: str, number: int) -> None:
        self.tag, self.number, self.children = tag, number, []
        self.names: list[str] = []
        self.role, self.hidden = "", False
        if "=" in attributes or "hidden" in attributes.lower():
            seen = set()
            for name, *values in ATTRIBUTE.findall(attributes):
                if (key := name.lower()) in ("class", "id", "role", "hidden", "aria-hidden") and key not in seen:
                    seen.add(key)  # of a repeated attribute the first counts
                    words = entities.unescape("".join(values)).lower().split()
                    if key == "role":
                        self.role = words[0] if words else ""
                    elif key in ("class", "id"):
                        self.names += words
                    else:  # what no reader of the page gets
                        self.hidden = self.hidden or key == "hidden" or words == ["true"]


class _Open:
    """The open elements, with the depths of each kind, so that no rule has to look through them."""

    def __init__(self, root: Node) -> None:
        self.stack = [root]
        self.of: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def push(self, node: Node) -> None:
        self.of.setdefault(node.tag, []).append(len(self.stack))
        if node.tag in BLOCK:
            self.blocks.append(len(self.stack))
        self.stack.append(node)

    def deepest(self, tags: Iterable[str]) -> int:
        return max((self.of[t][-1] for t in tags if self.of.get(t)), default=0)

    def close(self, depth: int) -> None:
        """End the element at ``depth`` and all within it."""
        while len(self.stack) > depth:
            node = self.stack.pop()
            self.of[node.tag].pop()
            if node.tag in BLOCK:
                self.blocks.pop()


def parse(source: str) -> Node:
    """The element tree of a page; forgiving: missing end tags end with what surrounds them, unknown end tags are ignored.

    A tag whose quotes never close ends at the next ``>``, and so do all tags behind it; one that never ends is no text.
    """
    opened = _Open(root := Node("#root", "", 0))
    stack, number, at, quotes, size = opened.stack, 0, 0, True, len(source)
    while at < size:
        start = source.find("<", at)
        if start < 0:
            stack[-1].children.append(source[at:])
            break
        if start > at:
            stack[-1].children.append(source[at:start])
        sign = source[start + 1 : start + 2]
        if source.startswith("<!--", start):
            end = COMMENT_END.search(source, start + 2)
            at = end.end() if end else size
            continue
        ending = sign == "/"
        name = NAME.match(source, start + 1 + ending)
        if name is None:
            if sign in ("!", "?") or ending:
                end = source.find(">", start)
                at = end + 1 if end >= 0 else size
            else:  # a sign in the text
                stack[-1].children.append("<")
                at = start + 1
            continue
        rest = REST.match(source, name.end()) if quotes else None
        if rest is None:
            quotes = False
            if (end := source.find(">", name.end())) < 0:
                break
            attributes, at = source[name.end() : end], end + 1
        else:
            attributes, at = rest[1], rest.end()
        tag = name[0].lower()
        if ending:
            depth = opened.deepest([tag])
            if depth and (tag in BLOCK or depth > opened.deepest(("article", "main", "body"))):
                opened.close(depth)
            continue
        if tag in BLOCK and opened.blocks and stack[opened.blocks[-1]].tag == "p":
            opened.close(opened.blocks[-1])
        if tag in ENDS:
            scope = opened.deepest(SCOPE[tag])
            while (depth := opened.deepest(ENDS[tag])) > scope:
                opened.close(depth)
                if tag != "tr":
                    break
        number += 1
        node = Node(tag, attributes, number)
        stack[-1].children.append(node)
        if tag in VOID or attributes.endswith("/"):
            continue
        if tag in RAW:
            end = _raw_end(tag).search(source, at)
            node.children.append(source[at : end.start() if end else size])
            at = end.end() if end else size
            continue
        opened.push(node)
    return root


@cache
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}\s*+>", re.I)


def _walk(root: Node) -> Iterator[Node]:
    todo = [root]
    while todo:
        node = todo.pop()
        yield node
        todo += [c for c in reversed(node.children) if isinstance(c, Node)]


def boilerplate(node: Node, inside: bool) -> bool:
    """Whether markup says that the element is something else than the article; ``inside`` an article, a header may hold its title."""
    if node.tag in NEVER or node.hidden or node.role in NEVER_ROLE or (node.tag == "header" and not inside):
        return True
    if node.tag == "article":
        return inside and not NOT_OWN.isdisjoint(node.names)
    return node.tag not in KEPT and any(NEVER_NAME.fullmatch(n) for n in node.names)


def content(root: Node) -> list[Node]:
    """The page's own articles, else its main part; none if markup doesn't tell."""
    found: list[Node] = []
    mains: list[Node] = []
    todo = [root]
    while todo:
        node = todo.pop()
        if boilerplate(node, False):
            continue
        if node.tag == "article" and NOT_OWN.isdisjoint(node.names):
            found.append(node)
            continue
        if node.tag == "main" or node.role == "main":
            mains.append(node)
        todo += [c for c in reversed(node.children) if isinstance(c, Node)]
    return found or mains[:1]


def subtrees(root: Node) -> dict[int, list[int]]:
    """Hashes of all element subtrees outside the page's own content, with the numbers of the elements that have them.

    A hash covers tags, names, order and texts with white space made even.
    """
    own = {id(n) for n in content(root)}
    out: dict[int, list[int]] = {}
    done: dict[int, bytes] = {}
    holds: set[int] = set()
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        if id(node) not in own:
            todo += [c for c in node.children if isinstance(c, Node)]
    for node in reversed(order):  # children before their parents
        if id(node) in own:
            done[id(node)] = b"own %d" % node.number
            holds.add(id(node))
            continue
        parts = [node.tag.encode(), " ".join(node.names).encode("utf-8", "surrogatepass")]
        for c in node.children:
            if isinstance(c, Node):
                parts.append(done[id(c)])
                if id(c) in holds:
                    holds.add(id(node))
            else:
                parts.append(SPACE.sub(" ", c).strip().encode("utf-8", "surrogatepass"))
        value = xxhash.xxh64_intdigest(b"\0".join(parts))
        done[id(node)] = value.to_bytes(8, "little")
        # elements that hold the content aren't candidates
        if node.number and id(node) not in holds and node.tag not in ("html", "body", "head"):
            out.setdefault(_signed(value), []).append(node.number)
    return out


def boxes(root: Node) -> dict[int, list[int]]:
    """Like ``subtrees``, of the boxes with text inside the page's own content; their hashes differ from those of the same subtrees outside.

    Boxes are containers, and links that stand for themselves, outside of prose and lists' items. What ``text_of`` leaves out anyway isn't hashed.
    """
    asked: set[int] = set()
    order: list[Node] = []
    for top in content(root):
        todo = [(top, True)]
        while todo:
            node, may = todo.pop()
            order.append(node)
            may = may and node.tag not in PROSE
            spoken = any(isinstance(c, str) and not c.isspace() for c in node.children)
            for c in node.children:
                if isinstance(c, Node) and not boilerplate(c, True):
                    # a link or span within a sentence is part of it
                    if may and c.tag in BOX and not (spoken and c.tag in ("a", "span")):
                        asked.add(id(c))
                    todo.append((c, may))
        if not asked:
            order.clear()
    out: dict[int, list[int]] = {}
    done: dict[int, tuple[bytes, bool]] = {}
    for node in reversed(order):
        parts, text = [node.tag.encode(), " ".join(node.names).encode("utf-8", "surrogatepass")], False
        for c in node.children:
            if isinstance(c, str):
                own = SPACE.sub(" ", c).strip()
                parts.append(own.encode("utf-8", "surrogatepass"))
                text = text or bool(own)
            elif id(c) in done:
                parts.append(done[id(c)][0])
                text = text or done[id(c)][1]
        value = xxhash.xxh64_intdigest(b"\0".join(parts))
        done[id(node)] = value.to_bytes(8, "little"), text
        if text and id(node) in asked:
            out.setdefault(_signed(xxhash.xxh64_intdigest(done[id(node)][0], 1)), []).append(node.number)
    return out


def text_of(root: Node, deleted: frozenset[int] = frozenset()) -> str:
    """The main text: blocks in page order joined by line ends, white space within a block as one space."""
    parts = content(root)
    blocks: list[str] = []
    run: list[str] = []

    def close() -> None:
        if run:
            if text := SPACE.sub(" ", entities.unescape("".join(run))).strip():
                blocks.append(text)
            run.clear()

    for top in parts or [root]:
        inside = bool(parts)
        todo: list[object] = [top]
        while todo:
            item = todo.pop()
            if item is None:
                close()
            elif isinstance(item, str):
                run.append(item)
            elif item.number in deleted or (item is not top and boilerplate(item, inside)) or (not inside and item.tag == "title"):
                continue
            elif item.tag == "br":
                run.append(" ")
            elif item.tag == "header":  # of an article: its title
                todo += reversed([n for n in _walk(item) if n.tag in HEADINGS])
            else:
                block = item.tag in BLOCK
                if block:
                    close()
                    todo.append(None)
                todo += reversed(item.children)
        close()
    return "\n".join(blocks)


def host(url: str | None) -> str:
    m = re.match(r"(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _site_hash(site: bytes, value: int) -> int:
    """A subtree's hash on its host."""
    return _signed(xxhash.xxh64_intdigest(site + value.to_bytes(8, "little", signed=True))) or 1


def occurrences(pages: DataFrame, numbers: bool) -> DataFrame:
    """``(key, host, hash, unit[, numbers])``: each page's different subtrees, and one row of hash 0 for the page itself.

    Pages are known by a hash of url and html, so that repeated rows count once; host is a hash of the url's host. ``unit`` is what counts: the
    page, but for boxes inside an article the text, so that one article under many urls isn't a template of its host.
    """
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, 256):
            keys, hosts, hashes, units, places = [], [], [], [], []
            for key, url, source in zip(*(b.column(i).to_pylist() for i in range(3))):
                site = host(url).encode("utf-8", "surrogatepass")
                own = _signed(xxhash.xxh64_intdigest(site))
                root = parse(source or "")
                rows = {0: []} | {_site_hash(site, v): at for v, at in subtrees(root).items()}
                units += [key] * len(rows)
                if inner := boxes(root):
                    rows |= {_site_hash(site, v): at for v, at in inner.items()}
                    units += [_signed(xxhash.xxh64_intdigest(text_of(root).encode("utf-8", "surrogatepass")))] * (len(rows) - len(units) + len(keys))
                keys += [key] * len(rows)
                hosts += [own] * len(rows)
                hashes += rows
                places += rows.values()
            out = [pa.array(keys, pa.int64()), pa.array(hosts, pa.int64()), pa.array(hashes, pa.int64()), pa.array(units, pa.int64()), pa.array(places, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(out[: 4 + numbers], ["key", "host", "hash", "unit", "numbers"][: 4 + numbers])

    return pages.select(F.xxhash64("url", "html").alias("key"), "url", "html").mapInArrow(run, "key long, host long, hash long, unit long" + ", numbers array<int>" * numbers)


def templates(pages: DataFrame, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE) -> DataFrame:
    """``hash`` of the subtrees that recur on many pages of their host.

    Counting is a partial aggregate by host and hash; no host's pages come together in one task.
    """
    counted = occurrences(pages, False).groupBy("host", "hash").agg(F.count_distinct("unit").alias("pages")).where((F.col("hash") == 0) | (F.col("pages") >= least_pages))
    counted = cut(counted)
    all_ = counted.where("hash = 0").select(F.col("host").alias("of"), F.col("pages").alias("all"))
    often = counted.where("hash <> 0").join(all_, F.col("host") == F.col("of")).where((F.col("pages") >= MANY_PAGES) | (F.col("pages") >= least_share * F.col("all")))
    return cut(often.select("hash").distinct())


def main_text(pages: DataFrame, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE) -> DataFrame:
    """``(page_id, url, text, n_chars)``, one row for each row of ``pages``.

    Null and empty html give an empty text. Pages without a usable url form a host of their own. Repeated rows
    repeat; an empty table gives no rows; very long pages are parsed without recursion.

    Up to ``SENT`` template hashes, which is checked, go to the tasks as one sorted array, and pages stay where they are; with more, pages are joined with
    the elements to delete instead. Both ways delete the same.
    """
    small_batches(pages.sparkSession)
    gone = templates(pages, least_pages, least_share)
    kind = pages.schema["page_id"].dataType.simpleString()
    schema = f"page_id {kind}, url string, text string, n_chars long"

    def rows(b: pa.RecordBatch, out: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())], ["page_id", "url", "text", "n_chars"])

    if gone.count() <= SENT:
        hashes = np.sort(gone.toArrow().column("hash").to_numpy())
        sent = pages.sparkSession.sparkContext.broadcast(hashes)  # at most SENT longs

        def cleaned(source: str, url: str | None, known: np.ndarray) -> str:
            root = parse(source)
            deleted: list[int] = []
            if len(known) and (own := subtrees(root) | boxes(root)):
                site = host(url).encode("utf-8", "surrogatepass")
                asked = np.array([_site_hash(site, v) for v in own])
                hit = known[np.minimum(np.searchsorted(known, asked), len(known) - 1)] == asked
                deleted = [n for at, h in zip(own.values(), hit) if h for n in at]
            return text_of(root, frozenset(deleted))

        def here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in chunks(batches, 256):
                yield rows(b, [cleaned(s or "", u, sent.value) for u, s in zip(b.column(1).to_pylist(), b.column(2).to_pylist())])

        return pages.select("page_id", "url", "html").mapInArrow(here, schema)

    hits = occurrences(pages, True).join(gone, "hash", "left_semi")
    marks = hits.select("key", F.explode("numbers").alias("number")).groupBy("key").agg(F.collect_set("number").alias("numbers"))
    own = pages.select("page_id", "url", "html", F.xxhash64("url", "html").alias("own"))
    joined = own.join(marks, F.col("own") == F.col("key"), "left").select("page_id", "url", "html", "numbers")

    def there(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, 256):
            yield rows(b, [text_of(parse(s or ""), frozenset(n or ())) for s, n in zip(b.column(2).to_pylist(), b.column(3).to_pylist())])

    return joined.mapInArrow(there, schema)
