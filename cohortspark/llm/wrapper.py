"""Main text of web pages by wrapper induction.

Every layout of a host has a reference page; a layout is the set of tag paths of the page's
sections, and a layout of too few pages to vote uses the host's most common one.  A page's tree is
aligned with its reference by simple tree matching: the root pair, then, recursively, the children
in order so that the most nodes match.  A slot (node of the reference) whose most frequent text
most of the pages aligned with it hold is template; slots that vary are content, inside an article or main element and
outside of it.  Structure decides what content cannot be: scripts, forms, navigation, adverts,
comments and the like, by element or by the words of class, id and role.  The article mark shifts
the evidence: a marked slot needs ``MARKED_VOTES`` pages to become template, and only the very text
that is constant goes.  Where too few pages vote at all, the mark breaks the tie: if most of the
page's text is marked, the rest goes.

Texts are counted per slot from partial sums, so a host with a third of all pages is no hot
group, and no two pages are ever compared with each other.

Defined cases: null or empty html gives an empty text; pages without a url share the empty host;
unclosed and misnested elements close as browsers close them; exact copies vote once; an unmarked
slot needs more than ``MIN_VOTES`` pages, the reference among them, to become template.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.common import in_slices, saved

MIN_VOTES, MARKED_VOTES, TEMPLATE_SHARE, MARKED_MOST, REFERENCE_BYTES = 3, 8, 0.5, 0.5, 16 << 20

# Element and attribute names of HTML and of common page layouts.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe".split())
DROPPED = RAW | frozenset("head nav aside form button select option svg canvas object video audio menu dialog footer".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCKS - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot"}
SIBLINGS = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("table ul ol dl body html article section div main nav aside header footer form blockquote".split())
BAD_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright "
    "disqus footer form header login masthead menu modal nav navbar navigation newsletter notice notices notification pager pagination "
    "popup promo promoted promotion related replies reply search share sharing sidebar sidebars signup skip social sponsor sponsored "
    "subscribe subscription toolbar widget widgets alert gdpr paywall respond teaser recommended".split()
)
#: Words that may stand beside a listed one in a class or id ("related-posts"); any other makes it a name of its
#: own ("no-sidebar", "content-sidebar-wrap", "related-work", "comment-status-open").
PLAIN_WORDS = frozenset(
    "area articles bar block blocks bottom box button buttons col column container global group icon icons inner item items left "
    "link links list main module nav outer panel post posts right row section site slot stories text top unit wrap wrapper".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
GOOD_WORDS = frozenset("article content main post entry story body text page".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_WORDS = re.compile(r"[a-z]+")


class Node:
    __slots__ = ("tag", "children", "texts", "bad", "hinted", "kind", "number", "size")

    def __init__(self, tag: str, bad: bool, kind: str, hinted: bool = False):
        self.tag, self.bad, self.kind, self.hinted = tag, bad, kind, hinted
        self.children: list[Node] = []
        self.texts: list = []  # strings and, where a child stands, None
        self.number, self.size = -1, 1


def _is_bad(tag: str, raw: str) -> bool:
    if tag in DROPPED:
        return True
    if not raw or tag in ("html", "body", "main"):
        return False
    found = {m[0].lower(): m[1] or m[2] or m[3] for m in _ATTRIBUTE.findall(raw)}
    if found.get("role", "").lower() in ROLES or found.get("aria-hidden", "").lower() == "true":
        return True
    bare = _ATTRIBUTE.sub(" ", raw).lower().replace("/", " ").split()  # attributes without a value
    return "hidden" in bare or "hidden" in found or "display:none" in found.get("style", "").replace(" ", "").lower()


def _is_hinted(tag: str, raw: str) -> bool:
    """Does a class or the id name a part that is no content?  Headings and article elements never do."""
    if not raw or tag in HEADINGS or tag in ("html", "body", "main", "article"):
        return False
    found = {m[0].lower(): m[1] or m[2] or m[3] for m in _ATTRIBUTE.findall(raw)}
    names = f"{found.get('class', '')} {found.get('id', '')}".lower().split()
    for name in names:
        words = set(_WORDS.findall(name))
        bad = words & BAD_WORDS
        if bad and words <= BAD_WORDS | PLAIN_WORDS and not (bad == {"header"} and words & GOOD_WORDS):
            return True
    return False


def parse(page: str) -> Node:
    """The element tree; comments and the contents of raw-text elements are left out."""
    root = Node("#root", False, "#root")
    stack, at = [root], 0

    def text(s: str) -> None:
        if s and not s.isspace():
            stack[-1].texts.append(entities.unescape(s))
        elif s:
            stack[-1].texts.append(" ")

    while (m := _TOKEN.search(page, at)) is not None:
        text(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if stack[k].tag in SCOPES and tag not in SCOPES and tag not in BLOCKS:
                    break
            continue
        if tag in CLOSES_P:  # an open paragraph ends here
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    del stack[k:]
                    break
                if stack[k].tag in SCOPES:
                    break
        if tag in SIBLINGS:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in SIBLINGS[tag]:
                    del stack[k:]
                    if tag != "tr" or stack[-1].tag not in ("tr", "td", "th"):
                        break
                elif stack[k].tag in SCOPES:
                    break
        node = Node(tag, _is_bad(tag, m[3]), tag, _is_hinted(tag, m[3]))
        stack[-1].children.append(node)
        stack[-1].texts.append(None)
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else len(page)
        elif tag not in VOID and not m[3].endswith("/"):
            stack.append(node)
    text(page[at:])
    return _numbered(root)


def _numbered(root: Node) -> Node:
    """Document order numbers, and the number of nodes below each.

    A hinted element goes (``bad``) unless it holds the article: a main, article or h1 element, or
    nine tenths of the page's text.
    """
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        node.number = len(order)
        order.append(node)
        todo.extend(reversed(node.children))
    chars, holds = [0] * len(order), [False] * len(order)
    for node in reversed(order):
        node.size = 1 + sum(c.size for c in node.children)
        own = sum(len(t) for t in node.texts if t is not None)
        chars[node.number] = 0 if node.bad else own + sum(chars[c.number] for c in node.children)
        holds[node.number] = not node.bad and (node.tag in ("main", "article", "h1") or any(holds[c.number] for c in node.children))
    for node in order:
        if node.hinted and not holds[node.number] and 10 * chars[node.number] <= 9 * chars[0]:
            node.bad = True
    return root


def _pair(a: list[Node], b: list[Node]) -> list[tuple[Node, Node]]:
    """Simple tree matching of two child lists: the pairs of equal kind, in order, that match most nodes.

    A pair weighs as many nodes as the smaller of the two subtrees could match, one list row at a
    time; chosen pairs are matched further down on their own.
    """
    head = 0
    while head < min(len(a), len(b)) and a[head].kind == b[head].kind and a[head].size == b[head].size:
        head += 1
    out = list(zip(a[:head], b[:head]))
    a, b = a[head:], b[head:]
    if not a or not b:
        return out
    kinds = {k: i for i, k in enumerate({n.kind for n in a} | {n.kind for n in b})}
    ka, kb = (np.array([kinds[n.kind] for n in x]) for x in (a, b))
    sa, sb = (np.array([n.size for n in x]) for x in (a, b))
    best = np.zeros((len(a) + 1, len(b) + 1), np.int64)
    for i in range(len(a)):
        weight = np.where(kb == ka[i], np.minimum(sb, sa[i]), 0)
        best[i + 1, 1:] = np.maximum(best[i, 1:], best[i, :-1] + weight)
        np.maximum.accumulate(best[i + 1], out=best[i + 1])
    i, j, back = len(a), len(b), []
    while i and j:
        if best[i, j] == best[i - 1, j]:
            i -= 1
        elif best[i, j] == best[i, j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            back.append((a[i], b[j]))
    return out + back[::-1]


def align(page: Node, reference: Node) -> dict[int, int]:
    """Number of a page's node to number of the slot it fills."""
    out, todo = {}, [(page, reference)]
    while todo:
        p, r = todo.pop()
        out[p.number] = r.number
        if p.children and r.children:
            todo += _pair(p.children, r.children)
    return out


def blocks(root: Node) -> list[tuple[str, int, bool]]:
    """(text, number of the node, inside an article) of the blocks that structure allows, in page order."""
    out: list = []
    words: list = []
    owner = [0, False]

    def close() -> None:
        line = " ".join("".join(words).split())
        if line:
            out.append((line, owner[0], owner[1]))
        words.clear()

    todo: list = [(root, 0, 0, False)]  # node, next part, next child, inside
    while todo:
        node, part, child, inside = todo.pop()
        if part == 0 and node.tag in BLOCKS:
            close()
            owner[:] = [node.number, inside]
        while part < len(node.texts):
            piece = node.texts[part]
            part += 1
            if piece is not None:
                if not words:
                    owner[:] = [node.number, inside]
                words.append(piece)
                continue
            below = node.children[child]
            child += 1
            if below.tag == "br":
                words.append(" ")
            header = below.tag == "header" and not inside
            if below.bad or header or below.tag in VOID:
                if below.tag in BLOCKS:
                    close()
                continue
            todo.append((node, part, child, inside))
            todo.append((below, 0, 0, inside or below.tag in ("article", "main")))
            break
        else:
            if node.tag in BLOCKS:
                close()
    close()
    return out


SECTIONS = frozenset("main article section aside nav header footer form div table".split())


def layout(root: Node) -> str:
    """The set of tag paths of a page's sections; those inside an article are content."""
    paths, todo = set(), [(root, "")]
    while todo:
        node, path = todo.pop()
        if node.tag in SECTIONS:
            path += "/" + node.tag
            paths.add(path)
        if node.tag != "article":
            todo += [(c, path) for c in node.children]
    return " ".join(sorted(paths))


@lru_cache(maxsize=64)
def _reference(page: str) -> Node:
    return parse(page)


def host_of(url: str = "url"):
    return F.lower(F.regexp_extract(F.coalesce(F.col(url).cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, blocks (text, slot, article) that are content, and their joined text."""
    rows = pages.select(
        F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"), host_of(url_col).alias("host"),
    )

    def sign(batches: Iterator) -> Iterator:
        for batch in in_slices(batches, max_bytes=4 << 20, column=2):
            signs = [hashlib.sha256(layout(parse(page)).encode()).hexdigest()[:32] for page in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(signs, pa.string())], names=[*batch.schema.names, "layout"])

    signed = rows.mapInArrow(sign, "page_id bigint, url string, html string, host string, layout string")
    found = signed.filter("html != ''").groupBy("host", "layout").agg(
        F.min_by("html", F.struct(F.xxhash64("html"), F.col("page_id"))).alias("reference"),
        F.approx_count_distinct(F.xxhash64("html")).alias("n"),  # only chooses references
    )
    found = saved(found, "html-layouts")
    common = found.groupBy("host").agg(F.max_by("layout", F.struct("n", "layout")).alias("common"))
    layouts = found.select("host", "layout", "n").join(common, "host")
    layouts = layouts.select("host", "layout", F.when(F.col("n") > MIN_VOTES, F.col("layout")).otherwise(F.col("common")).alias("used"))
    reference = found.join(layouts.select("host", F.col("used").alias("layout")).distinct(), ["host", "layout"])
    reference = layouts.join(reference.select("host", F.col("layout").alias("used"), "reference"), ["host", "used"])
    reference = saved(reference, "html-reference")
    size = reference.agg(F.coalesce(F.sum(F.octet_length("reference") + F.octet_length("host") + 64), F.lit(0))).first()[0]
    # Small by measure, also the slots below (fewer than the references' bytes); else joins, whose hot hosts AQE splits.
    sent = F.broadcast if size <= REFERENCE_BYTES else (lambda df: df)

    def run(batches: Iterator) -> Iterator:
        import xxhash

        for batch in in_slices(batches, max_bytes=4 << 20, column=2):
            out = []
            for page_id, url, page, host, used, ref in zip(*(c.to_pylist() for c in batch.columns)):
                found = []
                if page:
                    tree = parse(page)
                    slots = align(tree, _reference(ref))
                    for text, number, inside in blocks(tree):
                        found.append({"text": text, "slot": slots.get(number, -1), "article": inside})
                out.append((page_id, url, host, used, xxhash.xxh3_64_intdigest(page.encode("utf-8", "replace")) - (1 << 63), found))
            for at in range(0, len(out), 1000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[at : at + 1000]), kinds)], names=names)

    names = ["page_id", "url", "host", "used", "page", "blocks"]
    block = pa.struct([("text", pa.string()), ("slot", pa.int32()), ("article", pa.bool_())])
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.list_(block)]
    schema = "page_id bigint, url string, host string, used string, page bigint, blocks array<struct<text: string, slot: int, article: boolean>>"
    aligned = signed.join(sent(reference), ["host", "layout"], "left")
    aligned = saved(aligned.select("page_id", "url", "html", "host", "used", "reference").mapInArrow(run, schema), "html-aligned")
    votes = aligned.select("host", "used", "page", F.explode("blocks").alias("b")).filter("b.slot >= 0")
    votes = votes.select("host", "used", "page", F.col("b.slot").alias("slot"), F.xxhash64("b.slot", "b.text").alias("text")).distinct()
    votes = votes.groupBy("host", "used", "slot", "text").agg(F.count(F.lit(1)).alias("n"))
    votes = votes.groupBy("host", "used", "slot").agg(F.sum("n").alias("n"), F.max(F.struct("n", "text")).alias("top"))
    constant = F.col("top.n") > TEMPLATE_SHARE * F.col("n")
    decided = votes.filter(F.col("n") > MIN_VOTES).groupBy("host", "used").agg(  # a layout's slots: those of one page at most
        F.collect_list(F.when(constant, F.col("slot"))).alias("template"),
        F.collect_list(F.when(constant & (F.col("n") > MARKED_VOTES), F.col("top.text"))).alias("marked_template"),
    )
    out = aligned.join(sent(decided), ["host", "used"], "left")
    length = lambda column: F.aggregate(column, F.lit(0), lambda n, b: n + F.char_length(b["text"]))
    marked = length(F.filter("blocks", lambda b: b["article"])) > MARKED_MOST * length(F.col("blocks"))
    of_template = lambda b: F.when(b["article"], F.array_contains("marked_template", F.xxhash64(b["slot"], b["text"]))).otherwise(F.array_contains("template", b["slot"]))
    content = F.filter("blocks", lambda b: F.when(F.col("template").isNull(), ~marked | b["article"]).otherwise(~of_template(b)))
    out = out.select("page_id", "url", content.alias("blocks"))
    return out.withColumn("text", F.array_join(F.transform("blocks", lambda b: b["text"]), "\n\n"))
