"""Main text of web pages by a tree-structured graphical model.

A page's block elements are the variables, each content or not. Tag, names in class
and id from there to the root, length of text, share of linked text and sentence marks give each node its
own evidence; a potential on every edge ties a child to its parent. Messages go up
the tree and down again, which gives each block's exact marginal. All potentials
are counts over labelled pages.
"""

import html
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The bound of the fitting sample: pages, drawn by a hash of their id.
TRAIN_PAGES = 2000
# Weight of what is assumed of a feature before any page is counted.
PRIOR = 4.0

# Elements without an end, with text that is no markup, of these without text of the page, and inline.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title iframe xmp".split())
UNSEEN = RAW - {"xmp"}
INLINE = set(
    "a abbr acronym b bdi bdo big button cite code data del dfn em font i ins kbd label mark math nobr noscript option "
    "q rp rt ruby s samp select small span strike strong sub sup svg time tt u var "
    "annotation mfrac mi mn mo mover mroot mrow ms msqrt msub msubsup msup mtext munder semantics tspan".split()
)
# An open p ends before these; an open li, td and so on before its like.
ENDS_P = set(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 "
    "h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split()
)
LIKE = {
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "td", "th"},
    "td": {"td", "th"},
    "th": {"td", "th"},
}
SCOPE = {"ul", "ol", "table", "dl", "article", "main", "section", "div", "body"}
# What tags and names in class, id and role say.
CONTENT_TAGS = {"article", "main"}
OTHER_TAGS = set("nav header footer aside form menu dialog fieldset head address search".split())
CONTENT_NAMES = set("article content main post entry story body text".split())
OTHER_NAMES = set(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies "
    "consent disclaimer footer form header login masthead menu modal nav navbar navigation newsletter notice "
    "pagination popup promo promoted related reply replies respond search share sharing sidebar signup social "
    "sponsor sponsored subscribe subscription tags toolbar widget alert discussion disqus hidden".split()
)

# Names of reader comments: an article inside is a comment.
COMMENT_NAMES = set("comment comments reply replies respond discussion disqus".split())
WHOLE_PAGE = {"html", "body"}

# A quote that is never closed ends with its tag.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+(?=>|\Z)|[^>]*)(?:>|\Z)",
    re.S,
)
_NAMES = re.compile(r"(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_MARKS = re.compile(r"[.!?…。]")


class Node:
    __slots__ = ("tag", "names", "parent", "inside", "linked", "length", "marks")

    def __init__(self, tag: str, names: frozenset, parent: int, inside: str):
        """``inside``: what the nearest name or tag that says anything says, upwards from here.
        Reader comments hold whatever is in them."""
        self.tag, self.names, self.parent = tag, names, parent
        if inside == "comments" or names & COMMENT_NAMES and tag not in WHOLE_PAGE:
            inside = "comments"
        elif names & OTHER_NAMES or tag in OTHER_TAGS:
            inside = "other"
        elif tag in CONTENT_TAGS or names & CONTENT_NAMES and inside == "none":
            inside = "content"
        self.inside = inside
        self.linked = self.length = self.marks = 0


def parse(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """The block elements of a page, parents first, and its blocks of text in page order."""
    nodes = [Node("", frozenset(), -1, "none")]
    open_ = [0]
    blocks: list[tuple[int, str]] = []
    pending: list[str] = []
    links = at = 0

    def flush() -> None:
        text = " ".join(html.unescape("".join(pending)).split())
        pending.clear()
        if text:
            blocks.append((open_[-1], text))
            nodes[open_[-1]].marks += len(_MARKS.findall(text))

    def said(text: str) -> None:
        if text:
            if len(open_) == 1:
                # Text outside all elements is a paragraph of the page.
                if text.isspace() and not pending:
                    return
                nodes.append(Node("p", frozenset(), 0, "none"))
                open_.append(len(nodes) - 1)
            pending.append(text)
            node, size = nodes[open_[-1]], len(text)
            node.length += size
            node.linked += size if links else 0

    def close(upto: int) -> None:
        nonlocal links
        flush()
        del open_[upto:]
        links = 0

    while match := _TOKEN.search(page, at):
        said(page[at : match.start()])
        at = match.end()
        if match[2] is None:
            continue
        tag, ends = match[2].lower(), bool(match[1])
        if tag == "br":
            pending.append(" ")
        elif tag in INLINE:
            if tag == "a":
                links = max(0, links - 1) if ends else 1
        elif ends:
            for depth in range(len(open_) - 1, 0, -1):
                if nodes[open_[depth]].tag == tag:
                    close(depth)
                    break
        elif tag in RAW:
            end = re.compile(rf"</{tag}(?:[\s/>]|\Z)", re.I).search(page, at)
            begin, at = at, len(page) if end is None else end.start()
            if tag not in UNSEEN:
                said(page[begin:at].replace("&", "&amp;"))
        else:
            if tag in ENDS_P and nodes[open_[-1]].tag == "p":
                close(len(open_) - 1)
            for depth in range(len(open_) - 1, 0, -1):
                above = nodes[open_[depth]].tag
                if above in LIKE.get(tag, ()):
                    close(depth)
                elif above in SCOPE:
                    break
            if tag in VOID and tag != "hr":
                continue
            flush()
            if tag not in VOID:
                found = " ".join("".join(m) for m in _NAMES.findall(match[3])) if match[3] else ""
                names = {part.lower() for part in _PARTS.findall(found)}
                if match[3] and _HIDDEN.search(match[3]):
                    names.add("hidden")
                nodes.append(Node(tag, frozenset(names), open_[-1], nodes[open_[-1]].inside))
                open_.append(len(nodes) - 1)
                links = 0
    said(page[at:])
    flush()
    return nodes, blocks


def features(node: Node, blind: bool = False) -> tuple[str, ...]:
    """What speaks for or against a node. ``blind`` is without the tags and names of content."""
    linked = "none" if not node.linked else "some" if 2 * node.linked < node.length else "most"
    length = "none" if not node.length else "short" if node.length < 40 else "long"
    tag, inside = node.tag, node.inside
    if blind and (tag in CONTENT_TAGS or inside == "content"):
        tag, inside = ("div" if tag in CONTENT_TAGS else tag), ("none" if inside == "content" else inside)
    return (
        f"tag {tag}",
        f"inside {inside}",
        f"links {linked}",
        f"length {length}",
        f"marks {'yes' if node.marks else 'no'}",
    )


def labelled(nodes: list[Node]) -> list[int] | None:
    """Labels of a page whose markup gives them: what is inside article or main and not
    inside a menu, form, advert and so on. None if the page has no such element."""
    if not any(node.tag in CONTENT_TAGS for node in nodes):
        return None
    labels = []
    for node in nodes:
        if node.tag in OTHER_TAGS or node.names & OTHER_NAMES or node.inside == "comments":
            labels.append(0)
        elif node.tag in CONTENT_TAGS:
            labels.append(1)
        elif node.parent >= 0:
            above = labels[node.parent]
            labels.append(above)
        else:
            labels.append(0)
    return labels


def _assumed(feature: str) -> float:
    """Share of content assumed for a feature before counting."""
    kind, _, value = feature.partition(" ")
    if kind == "tag":
        return 0.97 if value in CONTENT_TAGS else 0.02 if value in OTHER_TAGS else 0.5
    if kind == "inside":
        return {"other": 0.01, "comments": 0.001, "content": 0.9}.get(value, 0.3)
    return {"links most": 0.2, "marks yes": 0.6, "length long": 0.6}.get(feature, 0.5)


class Model:
    """Potentials from counts: of (feature, label) and of (parent's label, label)."""

    def __init__(self, counts: dict[tuple[str, str, int], int]):
        self.counts = counts
        self.edges = [[self._share("edge", str(a), b) for b in (0, 1)] for a in (0, 1)]
        self.weights: dict[str, float] = {}

    def _share(self, kind: str, what: str, label: int) -> float:
        assumed = (0.9 if int(what) == label else 0.1) if kind == "edge" else None
        n = [self.counts.get((kind, what, x), 0) for x in (0, 1)]
        return (n[label] + PRIOR * assumed) / (sum(n) + PRIOR)

    def _weight(self, feature: str) -> float:
        """Log odds of content for a node that has the feature, against all nodes."""
        weight = self.weights.get(feature)
        if weight is None:
            n = [self.counts.get(("node", feature, x), 0) for x in (0, 1)]
            every = [self.counts.get(("label", "", x), 0) + 1 for x in (0, 1)]
            share = _assumed(feature)
            # Each label's nodes weigh the same, so that page sizes do not matter.
            on = n[1] / every[1] * 100 + PRIOR * share
            off = n[0] / every[0] * 100 + PRIOR * (1 - share)
            weight = self.weights[feature] = math.log(on / off)
        return weight

    def marginals(self, nodes: list[Node]) -> list[float]:
        """P(content) of each node: sum-product messages to the root and back."""
        own = []
        for node in nodes:
            odds = math.exp(max(-20.0, min(20.0, sum(map(self._weight, features(node))))))
            own.append((1 / (1 + odds), odds / (1 + odds)))
        (e00, e01), (e10, e11) = self.edges
        up = [(1.0, 1.0)] * len(nodes)  # message to the parent
        inward = list(own)  # evidence of a node and all below it
        for i in range(len(nodes) - 1, 0, -1):
            off, on = inward[i]
            to = (e00 * off + e01 * on, e10 * off + e11 * on)
            total = to[0] + to[1]
            up[i] = (to[0] / total, to[1] / total)
            parent = nodes[i].parent
            above = (inward[parent][0] * up[i][0], inward[parent][1] * up[i][1])
            total = above[0] + above[1]
            inward[parent] = (above[0] / total, above[1] / total)
        belief = list(inward)
        # The page itself is no content, unless it is nothing but text.
        belief[0] = (1.0, 0.0) if any(n.tag not in WHOLE_PAGE | {"", "p"} for n in nodes) else (0.5, 0.5)
        for i in range(1, len(nodes)):
            off, on = belief[nodes[i].parent]
            off, on = off / max(up[i][0], 1e-300), on / max(up[i][1], 1e-300)  # without this child's word
            below = inward[i]
            mine = (below[0] * (e00 * off + e10 * on), below[1] * (e01 * off + e11 * on))
            total = mine[0] + mine[1] or 1.0
            belief[i] = (mine[0] / total, mine[1] / total)
        return [on for _, on in belief]

    def text(self, page: str) -> str:
        nodes, blocks = parse(page)
        marginals = self.marginals(nodes)
        return "\n".join(text for owner, text in blocks if marginals[owner] >= 0.5)


def count(counts: Counter, page: str) -> None:
    """Add what a page whose markup labels it says about features, labels and edges.

    Every second page, by a hash of it, is counted without the tags and names of content: pages
    that have none are then told by the rest.
    """
    nodes, _ = parse(page)
    labels = labelled(nodes)
    if labels is None:
        return
    blind = zlib.crc32(page.encode("utf-8", "replace")) % 2 == 1
    for node, label in zip(nodes[1:], labels[1:]):
        counts["label", "", label] += 1
        for feature in features(node, blind):
            counts["node", feature, label] += 1
        if node.parent > 0:
            counts["edge", str(labels[node.parent]), label] += 1


def train(pages: DataFrame, rows: int = TRAIN_PAGES) -> Model:
    """Count potentials over at most ``rows`` pages whose markup labels them."""
    drawn = (
        pages.filter("html is not null")
        .select(F.col("page_id").cast("long").alias("page_id"))
        .distinct()
        .orderBy(F.xxhash64("page_id"), "page_id")
        .limit(rows)
    )
    texts = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html"))
    chosen = texts.join(F.broadcast(drawn), "page_id").select("html")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for page in batch.column(0).to_pylist():
                count(counts, page or "")
        rows = [(*key, n) for key, n in counts.items()]
        columns = list(zip(*rows)) or [[], [], [], []]
        types = [pa.string(), pa.string(), pa.int32(), pa.int64()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, types)], ["kind", "what", "label", "n"]
        )

    counted = chosen.mapInArrow(work, "kind string, what string, label int, n long")
    summed = counted.groupBy("kind", "what", "label").agg(F.sum("n").alias("n"))
    # One row per tag name and label of the sample, and a few more.
    return Model({(r["kind"], r["what"], r["label"]): r["n"] for r in summed.collect()})


def extract(pages: DataFrame, model: Model) -> DataFrame:
    """``(page_id, url, text, n_chars)`` for every row of ``pages``, from its whole html.

    Character references are decoded, white space inside a block becomes one space,
    blocks are joined in page order by a line feed. Null and empty pages, and pages
    without content, have an empty text. Null ids and URLs and repeated rows are
    kept; other columns are not read; an empty table gives no rows.
    """
    counts = model.counts

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = Model(counts)
        for batch in batches:
            texts = [mine.text(page or "") for page in batch.column(2).to_pylist()]
            columns = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *columns], ["page_id", "url", "text", "n_chars"]
            )

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(work, "page_id long, url string, text string, n_chars long")
