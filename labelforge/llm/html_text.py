"""HTML extraction with site template removal.

A page is cut into a tree of elements.  Every block element without the article
in it is hashed (tags and text), and the hashes are counted per host in Spark: a
subtree that recurs in enough different articles of its host is template and is
deleted from all pages.  Enough is a fixed number where the subtree usually stands
at one place of the page; a container is also template wherever it stands, from
a share of the pages or a larger fixed number on.
Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and
reader comments that are named as such go on every page, so a host with a single
page is cleaned too; a name that also fits main text (``share-prices``) only halves
the articles that the count must show.  What is left of the articles, of ``main`` or
of the body gives the text, one line per block: the narrowest of them that has at
least half of the next one's text outside of links.

A paragraph, heading, list item or cell needs twice the articles and the same place,
so a passage that many pages quote here and there stays; one that many
hosts have (a licence line) is not a site's template.  Short blocks (``Yes``)
need the share as well.  Copies of one article count as one; for paragraphs and
the like, so do near copies, which share their longest run of text.

Edge cases: null html is empty and gives an empty text; a null url's host is
empty, and pages without a host share no template; unclosed and stray tags are
closed where their parent ends; repeated rows are pages of their own; only
page_id, url and html are read.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelforge.llm.common import slices, stage

#: A subtree at one place of the page is template from so many articles of its host on (text blocks: twice as many).
MIN_PAGES = 4
#: A container at any place is template from this share of the host's pages on, or from so many articles.
MIN_SHARE = 0.02
MANY_PAGES = 100
#: A text block on more hosts than a site's names (plain, www, m) is a passage that sites share.
MOST_HOSTS = 3
#: Shorter texts recur by chance.
SHORT = 20
BROADCAST_BYTES = 32 << 20

#: A tag; quotes count only after an equals sign.  What is taken is never given back, so a match costs its length.
_TAG = re.compile(r"""<(/?)([A-Za-z][A-Za-z0-9:-]*+)((?:[^>=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|=)*+)>""")
_PLAIN_TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9:-]*+)([^<>]*+)>")
_TAG_START = re.compile(r"</?[A-Za-z]")
_ATTR = re.compile(r"""([A-Za-z_:-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_VOID = frozenset("area base br col embed hr img input link meta source track wbr param".split())
_RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "textarea", "title", "noscript", "template", "svg",
                                                    "iframe", "select")}
_BLOCK = frozenset("address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure "
                   "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section "
                   "summary table tbody td tfoot th thead tr ul caption".split())
#: Elements that are never main text.
_DROP = frozenset("head nav header footer aside form script style noscript template iframe svg button select textarea "
                  "input label title menu object canvas audio video dialog fieldset".split())
#: Names (classes, ids, roles) of parts that are never main text, as whole words of the name.
_NAMED = re.compile(
    r"(?:^|[\s_-])(?:nav(?:bar|igation)?|menus?|breadcrumbs?|masthead|topbar|footer|sidebar|"
    r"ads?|adverts?|advertisement|advert|sponsor(?:ed)?|promo(?:tion)?s?|banner|cookie|consent|popup|modal|"
    r"newsletter|subscribe|signup|login|searchbox|disqus|toolbar|pagination|pager|complementary|contentinfo)(?:$|[\s_-])", re.I)
#: Words that main text is named by too.
_HINT = re.compile(
    r"(?:^|[\s_-])(?:header|side|rail|widgets?|notice|alert|search|form|share|sharing|social|related|"
    r"recommend(?:ed|ations)?|comments?|replies|respond|skip|cookies)(?:$|[\s_-])", re.I)
#: Whole names with such words that say what the part is (reader comments differ by page, so no count shows them).
_PLAIN = re.compile(
    r"(?:^|\s)(?:comments?|replies|respond|header|widgets?|cookies[_-](?:notice|bar|message|policy|info|hint|box)|(?:site|page|main|global|top)[_-]header|skip[_-](?:links?|to[\w-]*)|"
    r"(?:side|left|right)[_-](?:bar|rail|column|panel)|(?:share|sharing|social|search|related|recommended|comments?|widgets?)"
    r"(?:[_-](?:share|sharing|social|search|bar|box|buttons?|links?|icons?|form|list|area|section|wrapper|container|wrap|panel|"
    r"posts?|articles?|items?|stories|thread|media|widgets?))+)(?:$|\s)", re.I)
#: Names of an article that is a reader's comment.
_COMMENT = re.compile(r"(?:^|\s)(?:(?:user|reader)[_-])?(?:comment|reply|comments|replies)(?:[_-](?:body|item|content|text|entry|\d+))?"
                      r"(?:$|\s)", re.I)
#: Headings and cells are not deleted by their name alone, and by a plain name no text block.
_HEADS = frozenset("h1 h2 h3 h4 h5 h6 tr td th caption".split())
#: A new start tag ends these open elements of the same kind.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
         "th": {"td", "th"}, "option": {"option"}}
_CONTAINER = frozenset("nav header footer aside article div section ul ol dl form table figure menu center blockquote".split())
#: Elements of their own text that are counted too; span and a only outside of others.
_TEXT = (_BLOCK | {"span", "a"}) - _CONTAINER - {"html", "body", "main", "article", "br", "hr"}
_CLOSES_P = _BLOCK - {"br", "html", "body"}
_CLOSES = {t: frozenset(_ENDS.get(t, set()) | ({"p"} if t in _CLOSES_P else set())) for t in _CLOSES_P | set(_ENDS)}


@dataclass(slots=True)
class Node:
    tag: str
    named: bool = False  # as something else than main text
    hint: bool = False  # by a word that main text is named by too
    comment: bool = False  # an article that is a reader's comment
    children: list = field(default_factory=list)  # of Node and str
    size: int = 0  # characters of text
    hash: int = 0  # signed 64-bit hash of the tags and texts
    longest: str = ""  # run of text that is not dropped
    prose: int = 0  # characters neither dropped nor in links


def spaced(text: str) -> str:
    """Character references decoded, white space as single spaces."""
    return " ".join(entities.unescape(text).split())


def hash64(text: str) -> int:
    digest = hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest()
    return int.from_bytes(digest, "little", signed=True)


def measure(root: Node, hashed: bool = True) -> Node:
    """Fill size, prose longest and, if asked, hash of every node, children first.  Trees are
    as deep as a page has unclosed tags, so they are walked with stacks of their own."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo.extend(c for c in node.children if not isinstance(c, str))
    for node in reversed(order):
        parts = ["<" + node.tag]
        for c in node.children:
            if isinstance(c, str):
                node.size += len(c.strip())
                text = spaced(c)
                parts.append(text)
                if len(text) > len(node.longest):
                    node.longest = text
                node.prose += len(text) if node.tag != "a" else 0
            else:
                node.size += c.size
                if hashed:
                    parts.append(f"\x01{c.hash}")
                if not dropped(c):
                    if len(c.longest) > len(node.longest):
                        node.longest = c.longest
                    node.prose += c.prose if node.tag != "a" else 0
        if hashed:
            node.hash = hash64("\x00".join(parts))
    return root


class Tags:
    """The tags of a page in one forward pass: (start, end, closing, name, attributes),
    comments and declarations without a name.

    A tag that runs to the end of the page unclosed is text.  From then on a tag
    ends before the next ``<``, so broken tags are not scanned to the end again."""

    def __init__(self, source: str):
        self.source, self.tag = source, _TAG

    def after(self, at: int) -> tuple[int, int, str, str, str] | None:
        source = self.source
        i = source.find("<", at)
        while i >= 0:
            if source.startswith(("<!", "<?"), i):
                note = source.startswith("<!--", i)
                j = source.find("-->", i + 4) if note else source.find(">", i)
                return i, len(source) if j < 0 else j + (3 if note else 1), "", "", ""
            if _TAG_START.match(source, i):
                m = self.tag.match(source, i)
                if not m and self.tag is _TAG:
                    self.tag = _PLAIN_TAG
                    m = _PLAIN_TAG.match(source, i)
                if m:
                    return i, m.end(), m[1], m[2].lower(), m[3]
            i = source.find("<", i + 1)
        return None


def _hidden(raw: str, attrs: dict[str, str]) -> bool:
    """An attribute is named ``hidden`` or ``aria-hidden`` is true."""
    if attrs.get("aria-hidden") == "true" or "hidden" in attrs:
        return True
    return "hidden" in raw.lower() and "hidden" in _ATTR.sub(" ", raw).lower().replace("/", " ").split()


def parse(source: str, hashed: bool = True) -> Node:
    """The element tree of a page; without hashes no template can be told in it."""
    root = Node("html")
    open_: list[Node] = [root]
    count: Counter = Counter()  # open tags by name, so none is looked for in vain
    at = 0

    def close_from(i: int) -> None:
        for n in open_[i:]:
            count[n.tag] -= 1
        del open_[i:]

    tags = Tags(source)
    while True:
        found = tags.after(at)
        end = found[0] if found else len(source)
        if end > at:
            open_[-1].children.append(source[at:end])
        if not found:
            return measure(root, hashed)
        _, at, closing, tag, raw = found
        if not tag:
            continue
        if closing:
            for i in range(len(open_) - 1, 0, -1) if count[tag] else ():
                if open_[i].tag == tag:
                    close_from(i)
                    break
            continue
        if tag in ("html", "body"):
            if tag == "body" and not count[tag]:
                node = Node(tag)
                open_[-1].children.append(node)
                open_.append(node)
                count[tag] += 1
            continue
        ends = _CLOSES.get(tag)
        if ends:
            for i in range(len(open_) - 1, 0, -1) if any([count[e] for e in ends]) else ():
                if open_[i].tag in ends:
                    close_from(i)
                    break
                if open_[i].tag in _CONTAINER or open_[i].tag in ("main", "body"):
                    break
        attrs = {k.lower(): a or b or c for k, a, b, c in _ATTR.findall(raw)} if "=" in raw else {}
        names = " ".join([attrs.get(k, "") for k in ("class", "id", "role")]) if attrs else ""
        node = Node(tag, bool(raw) and _hidden(raw, attrs))
        if names.strip():
            sure = _NAMED.search(names) and tag not in _HEADS
            plain = tag in _CONTAINER and (_PLAIN.search(names) or attrs.get("role") == "search")
            node.named |= bool(sure or plain)
            node.comment = tag == "article" and bool(_COMMENT.search(names))
            node.hint = not node.named and bool(_NAMED.search(names) or _HINT.search(names))
        open_[-1].children.append(node)
        empty = raw.rstrip().endswith("/")
        if tag in _RAW and not (tag == "svg" and empty):
            stop = _RAW[tag].search(source, at)
            node.children.append(source[at:stop.start() if stop else len(source)])
            at = stop.end() if stop else len(source)
        elif tag not in _VOID and not empty:
            open_.append(node)
            count[tag] += 1


def dropped(node: Node) -> bool:
    """Named or tagged as something else than main text."""
    return node.tag in _DROP or node.comment or (node.named and node.tag not in ("body", "article", "main", "html"))


def _find(root: Node, tag: str) -> list[Node]:
    """The outermost nodes of a tag that are not dropped, in page order."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        for c in reversed(node.children):
            if not isinstance(c, str) and not dropped(c):
                todo.append(c)
        while todo and todo[-1].tag == tag:
            out.append(todo.pop())
    return out


def main_parts(root: Node) -> list[Node]:
    """The articles, ``main`` or the body: the narrowest with at least half of the
    text outside of links of the next, so a teaser doesn't stand for the page."""
    best: list[Node] = []
    for wider in (_find(root, "article"), _find(root, "main"), _find(root, "body") or [root]):
        if wider and (not best or 2 * sum(n.prose for n in best) < sum(n.prose for n in wider)):
            best = wider
    return best


def holders(root: Node, parts: dict[int, Node]) -> set[int]:
    """Ids of the nodes around the parts."""
    holds: set[int] = set()
    open_, todo = [], [(root, 0)]
    while todo:
        node, depth = todo.pop()
        del open_[depth:]
        if id(node) in parts:
            holds.update(open_)
            continue
        open_.append(id(node))
        todo.extend((c, depth + 1) for c in node.children if not isinstance(c, str))
    return holds


@dataclass
class Candidate:
    node: Node
    stays: bool  # would otherwise stay in the main text
    scope: Node  # the article or page that it stands in
    first: int  # place of the page, counted from the start and from the end
    last: int

    @property
    def small(self) -> bool:
        """Not most of the text around it.  Where it is, it may be content, and the
        page says nothing on it."""
        return not self.stays or 2 * self.node.size <= self.scope.size

    @property
    def container(self) -> bool:
        return self.node.tag in _CONTAINER

    @property
    def article(self) -> int:
        """Hash by which different articles are told apart."""
        return self.scope.hash if self.container else hash64(self.scope.longest)


def candidates(root: Node) -> list[Candidate]:
    """Blocks that may be template, in page order."""
    found: list[Candidate] = []
    parts = {id(n): n for n in main_parts(root)}
    holds = holders(root, parts)
    top = root if all(n.tag in ("body", "html") for n in parts.values()) else None
    todo: list[tuple] = [(root, False, top, False, 0, 0)]
    while todo:
        c, out, around, inline, first, last = todo.pop()
        if c is not root:
            if c.tag == "head" or not c.size:
                continue
            out = out or dropped(c)
            if id(c) not in holds and id(c) not in parts and (c.tag in _CONTAINER or (c.tag in _TEXT and not (inline and c.tag in ("span", "a")))):
                found.append(Candidate(c, not out and around is not None, around or root, first, last))
            if id(c) in parts and not top:
                around = c
            inline = c.tag in _TEXT
            if id(c) in parts or c.tag == "body":
                first = last = 0
        inner = [n for n in c.children if not isinstance(n, str) and n.size]
        for i in range(len(inner) - 1, -1, -1):
            n = inner[i]
            todo.append((n, out, around, inline, zlib.crc32(f"{n.tag}{i}".encode(), first),
                         zlib.crc32(f"{n.tag}{len(inner) - i}".encode(), last)))
    return found


def main_text(root: Node, template: set[int]) -> str:
    """Lines of the main text; ``template`` holds hashes of deleted subtrees."""
    gone = {id(c.node) for c in candidates(root) if c.stays and c.node.hash in template} if template else set()
    parts = main_parts(root)
    lines: list[str] = []
    line: list[str] = []

    def close() -> None:
        text = spaced("".join(line))
        line.clear()
        if text:
            lines.append(text)

    for part in parts:
        todo: list = [part]  # nodes, texts and None where a block ends
        while todo:
            c = todo.pop()
            if c is None:
                close()
            elif isinstance(c, str):
                line.append(c)
            elif c is part or not (dropped(c) or id(c) in gone):
                if c.tag in _BLOCK:
                    close()
                    todo.append(None)
                todo.extend(reversed(c.children))
        close()
    return "\n".join(lines)


def host_of(url: str | None) -> str:
    found = re.search(r"://([^/?#]*)", url or "")
    return found[1].lower() if found else ""


_SUBTREE = [("page", pa.int64()), ("host", pa.string()), ("hash", pa.int64()), ("scope", pa.int64()), ("stays", pa.bool_()),
            ("small", pa.bool_()), ("container", pa.bool_()), ("short", pa.bool_()), ("hint", pa.bool_()), ("first", pa.int64()), ("last", pa.int64())]


def page_subtrees(pages: DataFrame) -> DataFrame:
    """(page, host, hash, scope, stays, small, container, short, hint, first, last) of the
    candidate subtrees of every page.

    ``page`` identifies url and html, ``scope`` is a hash of the article or page
    that the subtree stands in, so copies of one article count once.  One row
    with null hash per page counts the host's articles."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 128):
            rows = []
            for page, url, source in zip(*(c.to_pylist() for c in batch.columns)):
                host = host_of(url)
                if not host:
                    continue
                root = parse(source or "")
                rows.append((page, host, None, root.hash, False, True, False, False, False, 0, 0))
                rows.extend((page, host, c.node.hash, c.article, c.stays, c.small, c.container, c.node.size < SHORT,
                             c.node.hint or c.node.named, c.first, c.last) for c in candidates(root))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(_SUBTREE)],
                                             [name for name, _ in _SUBTREE])
    return pages.select(F.xxhash64("url", "html").alias("page"), "url", "html").mapInArrow(
        run, "page long, host string, hash long, scope long, stays boolean, small boolean, container boolean, "
             "short boolean, hint boolean, first long, last long")


def templates(subtrees: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """(host, hash, pages) of the subtrees that recur in enough articles of a host.

    An article counts where the subtree is not most of its text.  Counts are
    combined before the shuffle and keyed by (host, subtree, place), so a host
    with a third of all pages is spread over its subtrees."""
    known = [F.max(c).alias(c) for c in ("container", "short", "hint")]
    once = subtrees.where("small").groupBy("host", "hash", "scope").agg(F.min("first").alias("first"), F.max("last").alias("last"), *known)
    places = F.explode(F.array(F.struct(F.lit(True).alias("start"), F.col("first").alias("at")),
                               F.struct(F.lit(False).alias("start"), F.col("last").alias("at")))).alias("place")
    counts = (once.select("host", "hash", "container", "short", "hint", places).groupBy("host", "hash", "place")
              .agg(F.count(F.lit(1)).alias("n"), *known).groupBy("host", "hash")
              .agg(F.sum(F.when(F.col("place.start"), F.col("n"))).alias("n"), F.max("n").alias("there"), *known))
    counts = stage(counts.where(F.col("hash").isNull() | (2 * F.col("n") >= min_pages)), "subtree-counts")
    sizes = counts.where(F.col("hash").isNull()).select(F.col("host").alias("site"), F.col("n").alias("all_pages"))
    texts = counts.where(F.col("hash").isNotNull() & ~F.col("container") & (F.col("n") >= min_pages)).select("hash").distinct()
    spread = (subtrees.select("host", "hash").distinct().join(texts, "hash", "left_semi")
              .groupBy("hash").agg(F.count(F.lit(1)).alias("hosts")))
    share = F.col("n") >= F.col("all_pages") * F.lit(min_share)
    least = F.lit(float(min_pages)) * F.when(F.col("hint"), 0.5).otherwise(1.0)
    need = least * F.when(F.col("container"), 1.0).otherwise(2.0)
    own = F.col("container") | (F.col("hosts") <= MOST_HOSTS)
    placed = own & (F.col("there") >= need) & (2 * F.col("there") >= F.col("n")) & (~F.col("short") | share)
    anywhere = F.col("container") & (F.col("n") >= least) & (share | (~F.col("short") & (F.col("n") >= MANY_PAGES)))
    return (counts.where(F.col("hash").isNotNull()).join(sizes, F.col("host") == F.col("site"))
            .join(spread, "hash", "left").where(placed | anywhere).select("host", "hash", F.col("n").alias("pages")))


def extract(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE,
            broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Per page: page_id, url and text, the site's template removed.

    Only template subtrees that would stay in the text go with a page; their
    list is broadcast while its measured size allows and joined by a shuffle of
    the pages beyond that."""
    subtrees = stage(page_subtrees(pages), "subtrees")
    marks = subtrees.where("stays").select("host", "hash", "page").distinct() \
        .join(templates(subtrees, min_pages, min_share), ["host", "hash"]) \
        .groupBy("page").agg(F.collect_set("hash").alias("hashes"))
    marks = stage(marks, "template-marks")
    size = marks.agg(F.sum(F.size("hashes") * 8 + 64)).first()[0] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 128):
            texts = [main_text(parse(source or "", bool(hashes)), set(hashes or ()))
                     for source, hashes in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())],
                                             ["page_id", "url", "text"])
    kind = pages.schema["page_id"].dataType.simpleString()
    keyed = pages.select("page_id", "url", "html", F.xxhash64("url", "html").alias("page"))
    return (keyed.join(F.broadcast(marks) if size <= broadcast_bytes else marks, "page", "left")
            .select("page_id", "url", "html", "hashes").mapInArrow(run, f"page_id {kind}, url string, text string"))
