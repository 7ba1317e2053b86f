"""Main-text extraction with a site style tree.

The pages of a host are merged into one tree: a style node is the path of tags
and classes from the root. Per node the tree holds on how many pages it occurs
and how often each content and each presentation (the sequence of child tags)
occurs there. A content that is on c of a node's m pages has entropy log_m(c):
0 when it is unique, 1 when every page has it. Node importance is one minus the
mean entropy over its contents (or presentations, for a node without text), so
that template branches score near 0 and articles near 1. A branch combines the
importance of its presentation with that of all contents below it, weighted by
their number: low branches go as a whole, rare texts in them too. What markup
itself names as menu, advert, form or comment goes as well, since
adverts with changing text look important to the tree. A name in a class, id or
role is only a sign: a branch around the main root, or with nearly all of the
text, stays. The main root is the kind of root with most of the important text.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from inquest.llm.common import batch, in_arrow, stored, text_of

#: A node is judged on this many pages of a host at least, and goes below this importance.
LEAST_PAGES, LOW = 5, 0.2
#: The share of the presentation in the importance of a branch, the contents below it have the rest.
PRESENTATION = 0.1
#: A branch whose class, id or role names it as no article stays when it holds this share of a page's text at least.
STORY = 0.75
#: Template nodes inside an article go only where the host's articles score this at least (not on hosts of copies).
VARIED = 0.5

# Element names by role.
RAW = frozenset("script style template noscript iframe svg math canvas object textarea select title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "html body main article section header footer nav aside div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th "
    "blockquote pre figure figcaption address form fieldset details summary dialog menu hr center hgroup search".split()
)
NEVER = frozenset("head nav footer aside form button dialog menu search".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
ENDS_P = BLOCK - {"html", "body"}
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
LIMITS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
# Words in class, id or role that name what is not the article.
NAMED = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice "
    "alert popup modal overlay dialog nav navbar navigation menu breadcrumb breadcrumbs sidebar complementary footer contentinfo comment comments "
    "reply replies respond disqus discussion share sharing social related recommended recommendations newsletter subscribe subscription signup "
    "login search widget widgets pagination pager toolbar skip copyright masthead".split()
)

_TAG = re.compile(
    r"""<(?:!--.*?(?:-->|\Z)|[!?][^>]*+(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*+)([^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+>|[^>]*+(?:>|\Z)))""", re.S
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""\shidden(?:[\s>=/]|$)|display\s*:\s*none""", re.I)
_WORDS = re.compile(r"[a-z]+")

OUTSIDE, MAIN, ARTICLE = range(3)
BRANCH = 3  # in the place of a root: the row says that a node of text lies below a branch


class Block:
    """A run of text without a block boundary inside: its style node, text, place and why it may be left out.

    signs: the elements around it whose class, id or role holds a word of NAMED, and `below` how many of them stand
    outside of its root element. path: the style nodes from the root to its own.
    """

    __slots__ = ("node", "text", "root", "named", "heading", "signs", "below", "path")

    def __init__(self, path: tuple, text: str, root: int, named: bool, heading: bool, signs: tuple, below: int):
        self.node, self.text, self.root, self.named, self.heading, self.signs, self.below, self.path = path[-1], text, root, named, heading, signs, below, path


def blocks(page: str, shapes: Counter | None = None) -> list[Block]:
    """The text blocks of a page in order; `shapes` gets (node, hash of child tags) of each block element."""
    out: list[Block] = []
    # (tag, node, place, left out, inside a heading, child tags, signs, signs outside of the root) of each open element
    stack = [("", 0, OUTSIDE, False, False, [], (), 0)]
    text: list[str] = []

    def flush() -> None:
        if text:
            s = "".join(text)
            text.clear()
            if s := " ".join((html.unescape(s) if "&" in s else s).split()):
                path = tuple(x[1] for x in stack if x[0] in BLOCK or not x[0])
                _, _, root, named, heading, _, signs, below = stack[-1]
                out.append(Block(path, s, root, named, heading, signs, below))

    def close() -> None:
        tag, node, _, _, _, children, _, _ = stack.pop()
        if shapes is not None and children and tag in BLOCK:
            shapes[node, xxhash.xxh64_intdigest(" ".join(children)) >> 1] += 1

    def close_to(tag_set: set, limits: set | frozenset) -> None:
        """Closes the nearest open element of the set, unless an element of `limits` stands between."""
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in tag_set:
                while len(stack) > i:
                    close()
                return
            if stack[i][0] in limits:
                return

    at, n, find = 0, len(page), _TAG.search
    while at < n:
        m = find(page, at)
        if m is None:
            text.append(page[at:])
            break
        if m.start() > at:
            text.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in BLOCK:
                flush()
            if tag == "p" or any(x[0] == tag for x in reversed(stack)):
                close_to({tag}, frozenset())
            continue
        if tag in RAW:
            if not m[3].endswith("/>"):
                end = re.compile(rf"</{re.escape(tag)}\s*[^>]*>", re.I).search(page, at)
                at = end.end() if end else n
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            else:
                text.append(" ") if tag == "br" else None
            continue
        if tag in BLOCK:
            flush()
            if tag in ENDS_P:
                close_to({"p"}, {"td", "th", "table", "article", "section", "div", "button", "blockquote"})
        if tag in SAME:
            close_to(SAME[tag], LIMITS[tag])
        _, above, root, named, heading, children, signs, below = stack[-1]
        style, words, whole = tag, set(), False
        if len(m[3]) > 1:
            found = {a.lower(): (b or c or d).lower() for a, b, c, d in _ATTRIBUTE.findall(m[3])}
            style = f"{tag}.{' '.join(sorted(_WORDS.findall(found.get('class', '') + ' ' + found.get('id', ''))))}"
            words = {w for k in ("class", "id", "role") for w in _WORDS.findall(found.get(k, ""))}
            whole = found.get("role") == "main" or found.get("itemprop") == "articlebody"
            named = named or bool(_HIDDEN.search(m[3]))
        if tag in BLOCK:
            children.append(tag)
        named = named or tag in NEVER
        outside = len(signs)
        if tag not in ("html", "body", "main") and words & NAMED:
            signs = (*signs, m.start())
        named = named or ((tag == "header" or "header" in words) and root != ARTICLE and tag not in ("html", "body", "main", "article") and tag not in HEADING)
        if tag == "article" or whole and root != ARTICLE and "articlebody" in m[3].lower():
            root, below = (ARTICLE, outside) if root != ARTICLE else (root, below)
        elif (tag == "main" or whole) and root == OUTSIDE:
            root, below = MAIN, outside
        stack.append((tag, xxhash.xxh64_intdigest(f"{above}/{style}") >> 1, root, named, heading or tag in HEADING, [], signs, below))
    flush()
    while len(stack) > 1:
        close()
    return out


def main_text(page: str, low: set[int], varied: bool, cut: set[int] | frozenset[int] = frozenset()) -> str:
    """The article of a page: its blocks in page order, one a line.

    low: the host's style nodes of low importance; cut: its branches of low importance, with all below them; varied:
    whether the host's articles differ.
    """
    found = [b for b in blocks(page) if not b.named]
    template = {b for b in found if b.node in low or not cut.isdisjoint(b.path)}
    size: Counter = Counter()  # important text of each element with a sign, and of the page
    for b in found:
        size.update(dict.fromkeys((*b.signs, "page"), len(b.text) if b not in template else 0))
    large = {e for e, n in size.items() if n and n >= STORY * size["page"]}
    inside: Counter = Counter()  # important text of each kind of root and the signs around it, but for what has more signs
    for b in found:
        if b not in template and large.issuperset(b.signs[b.below :]):
            inside[b.root, b.signs[: b.below]] += len(b.text)
    best = max((k for k in inside if k[0] != OUTSIDE), key=lambda k: (inside[k], k[0]), default=None)
    plain = max((inside[k] for k in inside if large.issuperset(k[1])), default=0)
    around = set(best[1]) if best and inside[best] >= plain else set()
    found = [b for b in found if large.union(around).issuperset(b.signs)]
    of_root: Counter = Counter()
    for b in found:
        of_root[b.root] += len(b.text) if b not in template else 0
    root = max(of_root, key=lambda r: (of_root[r], r), default=OUTSIDE)
    first = next((i for i, b in enumerate(found) if b.root == root), 0)
    found = [b for i, b in enumerate(found) if b.root >= root or (b.root == MAIN and b.heading and i < first)]
    if template and (root == OUTSIDE or varied):
        kept = [b for b in found if b not in template or (b.heading and root != OUTSIDE)]
        found = kept or found
    return "\n".join(b.text for b in found)


def style_nodes(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The merged trees of `pages(host, html)`: host, node, root, n_pages, total and importance of each style node, and host, branch, n_pages and importance of each branch.

    Page counts are summed inside each batch before the shuffle, so a host with most of the pages sends few rows.
    """
    schema = "host string, node long, root int, content long, n long"
    arrow = pa.schema([("host", pa.string()), ("node", pa.int64()), ("root", pa.int32()), ("content", pa.int64()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: Counter = Counter()
            for host, page in zip(b.column("host").to_pylist(), b.column("html").to_pylist()):
                shapes: Counter = Counter()
                found = blocks(page, shapes)
                own = {(x.node, x.root, xxhash.xxh64_intdigest(x.text) >> 1) for x in found}
                with_text = {x[0] for x in own}
                own |= {(node, OUTSIDE, shape) for node, shape in shapes if node not in with_text}
                own |= {(node, root, -1) for node, root, _ in own}
                own |= {(above, BRANCH, path[-1]) for path in {x.path for x in found} for above in path if above}
                seen.update((host, *x) for x in own)
            if seen:
                rows = list(seen)
                yield batch(arrow, {k: [r[i] for r in rows] for i, k in enumerate(arrow.names[:-1])} | {"n": [seen[r] for r in rows]})

    counts = in_arrow(pages.select("host", "html"), count, schema).groupBy("host", "node", "root", "content").agg(F.sum("n").alias("n"))
    counts = stored(counts, "style-counts")  # nodes and branches both read it
    own = F.when(F.col("content") >= 0, F.col("n"))
    found = counts.where(F.col("root") < BRANCH).groupBy("host", "node", "root").agg(
        F.max(F.when(F.col("content") < 0, F.col("n"))).alias("n_pages"), F.sum(own).alias("total"), F.sum(own * F.ln(own)).alias("entropy")
    )
    # entropy: the sum of c ln c; over the total and ln m it is the mean of log_m c.
    importance = F.when(F.col("n_pages") < 2, 1.0).otherwise(1 - F.col("entropy") / F.col("total") / F.ln("n_pages"))
    nodes = stored(found.select("host", "node", "root", "n_pages", "total", importance.alias("importance")), "style-nodes")
    links = counts.where(F.col("root") == BRANCH).select("host", F.col("node").alias("branch"), F.col("content").alias("node"), F.col("n").alias("pages"))
    below = links.join(nodes.select("host", "node", "total", "importance"), ["host", "node"]).groupBy("host", "branch")
    mean = below.agg(F.max("pages").alias("n_pages"), (F.sum(F.col("total") * F.col("importance")) / F.sum("total")).alias("content"))
    look = nodes.join(links.select("host", "node").distinct(), ["host", "node"], "left_anti").groupBy("host", F.col("node").alias("branch")).agg(F.min("importance").alias("look"))
    both = PRESENTATION * F.col("look") + (1 - PRESENTATION) * F.col("content")
    return nodes, mean.join(look, ["host", "branch"], "left").select("host", "branch", "n_pages", F.coalesce(both, "content").alias("importance"))


def extract(pages: DataFrame, url: str = "url", content: str = "html") -> DataFrame:
    """`pages` with `text`, the main text of the whole `content` column (an existing `text` is replaced).

    Null, empty and text-free pages give the empty text. Pages without a usable URL form one host. Hosts with under
    LEAST_PAGES pages, and nodes seen on fewer, are judged by markup alone. Repeated rows stay and count as pages.
    If every block of a page is template, the page keeps them (a host of copies). Very long pages are read whole. Columns
    named `_host`, `_low`, `_cut`, `_varied`, `_of` or `_html` are working columns here: existing ones of these names are left out.
    """
    host = F.lower(F.regexp_extract(text_of(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    kept = [f for f in pages.schema if f.name not in ("text", "_host", "_low", "_cut", "_varied", "_of", "_html")]
    keyed = pages.select(*(f.name for f in kept), host.alias("_host"), text_of(content).alias("_html"))
    nodes, branches = style_nodes(keyed.select(F.col("_host").alias("host"), F.col("_html").alias("html")))
    low = F.collect_set(F.when((F.col("n_pages") >= LEAST_PAGES) & (F.col("importance") < LOW), F.col("node")))
    inside = F.when(F.col("root") == ARTICLE, F.col("total"))
    varied = F.coalesce(F.sum(inside * F.col("importance")) / F.sum(inside) >= VARIED, F.lit(False))
    cut = branches.where((F.col("n_pages") >= LEAST_PAGES) & (F.col("importance") < LOW)).groupBy("host").agg(F.collect_set("branch").alias("_cut"))
    hosts = nodes.groupBy("host").agg(low.alias("_low"), varied.alias("_varied")).join(cut, "host", "left").where((F.size("_low") > 0) | F.col("_cut").isNotNull())
    # Written first: its size is then known, so a small table is broadcast and a large one joined by shuffle.
    hosts = stored(hosts, "style-hosts").withColumnRenamed("host", "_of")
    joined = keyed.join(hosts, F.col("_host") == F.col("_of"), "left").select(*(f.name for f in kept), F.col("_low"), F.col("_cut"), F.col("_varied"), "_html")
    schema = StructType([*kept, StructField("text", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*(b.column(c).to_pylist() for c in ("_html", "_low", "_varied", "_cut")))
            made = pa.array([main_text(page, set(low or ()), bool(varied), set(cut or ())) for page, low, varied, cut in rows], pa.string())
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in kept), made], names=[*(f.name for f in kept), "text"])

    return in_arrow(joined, run, schema)


def main_texts(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text and its number of code points."""
    made = extract(pages.select("page_id", "url", "html"))
    return made.select(F.col("page_id").cast("long").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))
