"""Main text of web pages by a site style tree.

Pages of one host are merged into a tree of styles: a node is a path of elements with their class and id. Each keeps how
often each content was seen there (joined over a page), which child elements it had (its presentation), and how much
text. A node's novelty is the entropy of its contents relative to the pages that have it: 0 where a site repeats
itself, 1 where no two pages agree. Its importance is the novel text of its branch (characters times novelty), weighed
by the entropy of its presentations. Entropies and sizes of a host with few pages lean on those of the same path over
all hosts, by ``LEAN`` pages' worth; no number of pages switches the tree on or off.

Nodes are judged against the most important node beside them, ``by``:

* where that is a container that a page has once, a branch of under ``SMALL`` of its importance is low (headings, short
  by nature, aside): menus, adverts, notices and footers against the article's container;
* everywhere, a branch whose novelty is under ``REPEATED`` of its novelty is low: what a site repeats inside articles.

Low branches are removed from every page that has their ``by``, so the tree never empties a page, nor judges between
templates that never meet. The names of elements, classes and ids only break ties: they say which of the remaining
branches are none of the article (reader comments may hold more new text than the article does), they may not be a
``by``, and an article or main element is never low against another element. Hidden elements and those without readable
text (scripts, styles, form controls) are no text at all.

Counts are summed per task before they meet, so a host with a third of all pages is no large group. The low nodes go
to the workers while they take under ``tree_bytes``; beyond that every page's paths are joined with them.

Defined results: null and empty html gives empty text; broken or unclosed elements are closed by what follows; text
without any block element is one block; pages without a host are judged by the paths of all hosts; equal pages get
equal text, and every row has its own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from texmill.llm._common import keep, map_batches, read

# Elements without an end, without text, that break blocks, and names of what is no article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template svg math iframe object canvas audio video select textarea button title".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
NO_ARTICLE = frozenset("nav footer aside form menu dialog header".split())
NO_ARTICLE_NAMES = re.compile(
    r"(?:^|[\s_-])(?:nav|navbar|navigation|menu|breadcrumbs?|footer|masthead|sidebar|side|aside|ads?|advert\w*|banner|sponsor\w*|promo\w*|cookie\w*|consent|notice|gdpr|popup|modal|overlay|newsletter|subscribe|signup|login|search|share|sharing|social|related|recommended|comments?|commentlist|disqus|replies|reply|respond|widget|toolbar|pagination|pager|skip|copyright|legal)(?:$|[\s_-])",
    re.I,
)
#: Names of a page's head, and not of an article's head inside the article; names that make even an article none.
HEAD_NAMES = re.compile(r"(?:^|[\s_-])(?:header|head|topbar)(?:$|[\s_-])", re.I)
NO_ARTICLE_ITSELF = re.compile(r"(?:^|[\s_-])(?:comments?|replies|reply|related|recommended|teaser|promo\w*|sponsor\w*|advert\w*|ads?)(?:$|[\s_-])", re.I)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar".split())
#: Elements that another of these closes when it begins.
CLOSES = {"p": BLOCKS - {"html", "body"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)", re.S)
_NAMED = re.compile(r"(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_DIGITS = re.compile(r"\d+")
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_MAIN = re.compile(r"/(?:article|main)(?:[./]|$)")

LEAN, SMALL, REPEATED = 4.0, 0.2, 0.25
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def host_of(url: str | None) -> str:
    m = re.match(r"\s*(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:\s]*)", url or "")
    return m[1].lower() if m else ""


class Page:
    """A page as blocks: (path, named as no article, text), in order; and the children of every path."""

    def __init__(self, source: str | None):
        self.blocks: list[tuple[str, bool, str]] = []
        self.children: dict[str, list[str]] = {}
        self.nodes: dict[str, list] = {}  # path of a block element: how often, named as no article
        self.stack: list[tuple[str, str, bool]] = [("", "", False)]  # element, path, no article
        self.text: list[str] = []
        self.at: tuple[str, bool] | None = None
        self.has_main = False
        if source:
            self._read(source)

    def _flush(self) -> None:
        if self.text:
            said = " ".join("".join(self.text).split())
            if said:
                self.blocks.append((*self.at, said))
            self.text = []

    def _say(self, raw: str) -> None:
        if not self.text:
            depth = len(self.stack) - 1
            while depth and self.stack[depth][0] not in BLOCKS:
                depth -= 1
            self.at = self.stack[depth][1], any(s[2] for s in self.stack)
        self.text.append(html.unescape(raw) if "&" in raw else raw)

    def _close(self, depth: int) -> None:
        if any(s[0] in BLOCKS for s in self.stack[depth:]):
            self._flush()
        del self.stack[depth:]

    def _open(self, name: str, attributes: str) -> None:
        while len(self.stack) > 1 and name in CLOSES.get(self.stack[-1][0], ()):
            self._close(len(self.stack) - 1)
        if name in BLOCKS:
            for depth in range(len(self.stack) - 1, 0, -1):  # an open paragraph ends, with what is open inside it
                if self.stack[depth][0] == "p":
                    if name in CLOSES["p"]:
                        self._close(depth)
                    break
                if self.stack[depth][0] in BLOCKS:
                    break
            self._flush()
        inside = any(s[0] in ("article", "main") for s in self.stack)
        label, off = name, name in NO_ARTICLE and not (name == "header" and inside)
        if attributes and not attributes.isspace():
            given = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _NAMED.finditer(attributes)}
            names = f"{given.get('class', '')} {given.get('id', '')}"
            said = _CAMEL.sub("-", names)
            if name in ("article", "main"):
                off |= bool(NO_ARTICLE_ITSELF.search(said))
            elif name not in ("html", "body"):
                off |= bool(NO_ARTICLE_NAMES.search(said)) or (not inside and bool(HEAD_NAMES.search(said)))
            if name not in ("html", "body"):
                off |= given.get("role", "").lower() in ROLES or "hidden" in given or given.get("aria-hidden", "").lower() == "true" or "display:none" in given.get("style", "").replace(" ", "").lower()
            if names.strip():
                label += "." + _DIGITS.sub("#", ".".join(sorted(names.split()[:4]))).replace("/", "_")
        self.has_main |= name in ("article", "main") and not off
        path = f"{self.stack[-1][1]}/{label}"
        if name in BLOCKS:
            self.children.setdefault(self.stack[-1][1], []).append(label)
            node = self.nodes.setdefault(path, [0, False])
            node[0] += 1
            node[1] |= off
        self.stack.append((name, path, off))

    def _read(self, source: str) -> None:
        at, end = 0, len(source)
        while at < end:
            m = _TOKEN.search(source, at)
            if m is None:
                self._say(source[at:])
                break
            if m.start() > at:
                self._say(source[at : m.start()])
            at = m.end()
            if m[2] is None:
                if m[0].startswith("<![CDATA["):
                    self._say(m[0][9:].removesuffix("]]>"))
                continue
            name = m[2].lower()
            if m[1]:
                if name == "br":
                    self._say(" ")
                for depth in range(len(self.stack) - 1, 0, -1):
                    if self.stack[depth][0] == name:
                        self._close(depth)
                        break
            elif name in SILENT:
                if not m[3].endswith("/"):
                    stop = re.compile(rf"</{name}\s*>", re.I).search(source, at)
                    at = stop.end() if stop else end
            elif name in VOID:
                if name in ("br", "wbr"):
                    self._say(" " if name == "br" else "")
                elif name == "hr":
                    self._flush()
            else:
                self._open(name, m[3] or "")
                if m[3] and m[3].endswith("/") and name not in BLOCKS:
                    self.stack.pop()
        self._flush()


def _digest(x: str) -> int:
    return xxhash.xxh3_64_intdigest(x) - (1 << 63)


def above(path: str) -> Iterator[str]:
    """A path and all those above it."""
    while path:
        yield path
        path = path.rpartition("/")[0]


def style_values(pages: DataFrame) -> DataFrame:
    """host, path, is_content, value, n (pages), chars, times, off: every content and presentation of every node, counted."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, str, bool, int], list[int]] = {}

        def out() -> pa.RecordBatch:
            cols = [pa.array([r[k] for r in seen], t) for k, t in enumerate((pa.string(), pa.string(), pa.bool_(), pa.int64()))]
            cols += [pa.array([v[k] for v in seen.values()], pa.int64()) for k in range(4)]
            return pa.RecordBatch.from_arrays(cols, ["host", "path", "is_content", "value", "n", "chars", "times", "off"])

        for batch in batches:
            for url, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                page, host = Page(source), host_of(url)
                content: dict[str, list[str]] = {}
                for path, _, said in page.blocks:
                    content.setdefault(path, []).append(said)
                rows = [((host, path, True, _digest("\n".join(of))), (1, sum(map(len, of)), 0, 0)) for path, of in content.items()]
                rows += [((host, path, False, _digest(" ".join(page.children.get(path, ())))), (1, 0, times, off)) for path, (times, off) in page.nodes.items()]
                for key, more in rows:
                    sums = seen.setdefault(key, [0, 0, 0, 0])
                    for k, x in enumerate(more):
                        sums[k] += x
            if len(seen) > 200_000:
                yield out()
                seen.clear()
        if seen:
            yield out()

    mapped = pages.select("url", "html").transform(map_batches, count, "host string, path string, is_content boolean, value long, n long, chars long, times long, off long")
    return mapped.groupBy("host", "path", "is_content", "value").agg(*(F.sum(c).alias(c) for c in ("n", "chars", "times", "off")))


def _entropy(n: str, s: str) -> Column:
    """Of counts that sum to n, whose n * log2(n) sum to s, relative to log2(n); 1 where one page says nothing."""
    return F.when(F.col(n) > 1, (F.log2(n) - F.col(s) / F.col(n)) / F.log2(n)).otherwise(1.0)


def _nodes(values: DataFrame, *by: str) -> DataFrame:
    """Pages, entropies, characters and instances a page of every node."""
    some = lambda c, x: F.sum(F.when(F.col("is_content") == c, x).otherwise(0))
    weighed = F.col("n") * F.log2("n")
    sums = values.groupBy(*by).agg(some(True, F.col("n")).alias("c"), some(True, weighed).alias("cs"), some(False, F.col("n")).alias("p"), some(False, weighed).alias("ps"), F.sum("chars").alias("chars"), F.sum("times").alias("times"), F.max("off").alias("off"))
    return sums.select(*by, "c", "p", _entropy("c", "cs").alias("contents"), _entropy("p", "ps").alias("presentations"), (F.col("chars") / F.greatest("c", F.lit(1))).alias("chars"), (F.col("times") / F.greatest("p", F.lit(1))).alias("times"), (F.col("off") > 0).alias("off"))


def style_tree(pages: DataFrame) -> DataFrame:
    """host, path, importance, novelty, container, times, off of every node with text in its branch."""
    values = keep(style_values(pages), "style_values")
    own = _nodes(values, "host", "path")
    every = _nodes(values.groupBy("path", "is_content", "value").agg(*(F.sum(c).alias(c) for c in ("n", "chars", "times", "off"))), "path")
    lean = lambda x, n, toward: (n * x + LEAN * toward) / (n + LEAN)
    shy = lambda n: F.greatest(F.col(n) - 1, F.lit(0))  # noqa: E731  # one page alone says nothing of what repeats
    every = every.select("path", lean(F.col("contents"), shy("c"), 1.0).alias("all_contents"), lean(F.col("presentations"), shy("p"), 1.0).alias("all_presentations"), F.col("chars").alias("all_chars"))
    hosted = (F.col("host") != "").cast("int")
    nodes = own.join(every, "path").select(
        "host", "path", "off", "times",
        lean(F.col("contents"), hosted * shy("c"), F.col("all_contents")).alias("contents"),
        lean(F.col("presentations"), hosted * shy("p"), F.col("all_presentations")).alias("presentations"),
        lean(F.col("chars"), hosted * F.col("c"), F.col("all_chars")).alias("chars"),
    )
    nodes = keep(nodes, "style_nodes")
    parts = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    branch = nodes.where("chars > 0 and path <> ''").select("host", F.explode(prefixes).alias("path"), (F.col("chars") * F.col("contents")).alias("new"), "chars", (F.size(parts)).alias("depth"))
    branch = branch.groupBy("host", "path").agg(F.sum("new").alias("new"), F.sum("chars").alias("chars"), (F.max("depth") > F.size(F.split("path", "/"))).alias("container"))
    rest = nodes.select("host", "path", "off", "times", "presentations")
    weight = F.when(F.col("container"), (1 + F.col("presentations")) / 2).otherwise(0.5)
    return branch.join(rest, ["host", "path"], "left").select("host", "path", (F.col("new") * F.coalesce(weight, F.lit(0.5))).alias("importance"), (F.col("new") / F.col("chars")).alias("novelty"), "container", F.coalesce("times", F.lit(1.0)).alias("times"), F.coalesce("off", F.lit(False)).alias("off"))


def low_nodes(tree: DataFrame) -> DataFrame:
    """host, path, by of the nodes of low importance beside by."""
    parent = F.regexp_replace("path", "/[^/]*$", "")
    tag = lambda c: F.regexp_extract(c, r"/([^/.]*)[^/]*$", 1)
    nodes = tree.withColumn("parent", parent)
    best = nodes.where("not off").groupBy("host", "parent").agg(F.max(F.struct("importance", "path", "novelty", "container", "times")).alias("best"))
    beside = nodes.join(best, ["host", "parent"]).where("path <> best.path")
    once = F.col("best.container") & (F.col("best.times") < 1.2)
    main = tag("path").isin("article", "main") & ~tag("best.path").isin("article", "main")
    small = once & (F.col("importance") < SMALL * F.col("best.importance")) & ~tag("path").isin(*sorted(_HEADINGS))
    return beside.where(~main & (small | (F.col("novelty") < REPEATED * F.col("best.novelty")))).select("host", "path", F.col("best.path").alias("by"))


def main_text(source: str | None, low: dict[str, str], names: bool = True) -> str:
    """Blocks of a page outside the low branches of its host; names settle what the tree leaves open."""
    page = Page(source)
    gone = {path for path in page.nodes if low.get(path) in page.nodes}
    kept = [(path, off, said) for path, off, said in page.blocks if not any(x in gone for x in above(path))]
    if names:
        kept = [x for x in kept if not x[1]]
        if page.has_main:
            kept = [x for x in kept if _MAIN.search(x[0])]
    return "\n\n".join(said for *_, said in kept)


def extract(pages: DataFrame, tree_bytes: int = 32_000_000, names: bool = True) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    spark = pages.sparkSession
    low = keep(low_nodes(style_tree(pages)), "low_nodes")
    size = low.agg(F.sum(F.length("host") + F.length("path") + F.length("by") + 100)).first()[0] or 0
    kinds = dict(pages.dtypes)
    schema = f"page_id {kinds['page_id']}, url string, text string"
    if size <= tree_bytes:
        by_host: dict[str, dict[str, str]] = {}
        for r in low.collect():  # tree_bytes at most
            by_host.setdefault(r.host, {})[r.path] = r.by
        given = spark.sparkContext.broadcast(by_host)
        rows = pages.select("page_id", "url", "html")

        def nodes_of(batch: pa.RecordBatch) -> Iterator[dict[str, str]]:
            return (given.value.get(host_of(url), {}) for url in batch.column(1).to_pylist())
    else:
        rows = _with_low_nodes(pages.select("page_id", "url", "html"), low)

        def nodes_of(batch: pa.RecordBatch) -> Iterator[dict[str, str]]:
            return ({x["path"]: x["by"] for x in of or ()} for of in batch.column(3).to_pylist())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(source, of, names) for source, of in zip(batch.column(2).to_pylist(), nodes_of(batch), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return rows.transform(map_batches, run, schema).withColumn("n_chars", F.length("text").cast("long"))


def _with_low_nodes(pages: DataFrame, low: DataFrame) -> DataFrame:
    """The pages with the low nodes among their own paths (a list no longer than the page)."""

    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, h, host, path = [], [], [], []
            for a, b, url, source in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                of = list(Page(source).nodes)
                u += [a] * len(of)
                h += [b] * len(of)
                host += [host_of(url)] * len(of)
                path += of
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(h, pa.int64()), pa.array(host, pa.string()), pa.array(path, pa.string())], ["u", "h", "host", "path"])

    named = pages.withColumns({"u": F.xxhash64("url"), "h": F.xxhash64("html")})
    own = named.select("u", "h", "url", "html").transform(map_batches, paths, "u long, h long, host string, path string")
    of = keep(own.join(low, ["host", "path"]).groupBy("u", "h").agg(F.collect_set(F.struct("path", "by")).alias("low")), "pages_low_nodes")
    return named.join(of, ["u", "h"], "left").select("page_id", "url", "html", "low")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))
