"""Main text of web pages by site style trees.

The pages of a host are merged into one tree: its nodes are element paths (tags
with their classes), and for each it knows in how many pages it stands, with
which sequences of children (presentations) and with which texts (content). A
branch whose content is spread over the host's pages has high entropy and so
low importance; one whose content is of a page alone has high importance, and
varied presentation adds to it. Branches of low importance are removed from
each page. Pages of a host with the same text count once, so that copies don't
look like boilerplate. That a branch is inside <article> or <main> is evidence
of importance: it must be more repeated than others to go, and it stays if else
most of the page's text would go (a near copy). Elements that are named as
menus, adverts, forms, comments and the like are removed before, even on a host
with a single page, where no tree can tell; but a name in class, id or role
counts only whole ("sidebar" or "cookie-notice", not "with-sidebar"), and a
branch that holds an article, <main> or most of the page's text is left open.

A page is parsed once to count and once to extract. Null or empty html gives an
empty text; a page without a host, or of a host with fewer than PAGES texts, has
no tree and is judged by its markup: where <article> and <main> hold most of the
text, they hold all of it.
Repeated rows each count and each give a row; empty input gives none. Parsing
takes time in proportion to the html, malformed or not, for pages of any length.
Ties: an importance equal to the bound stays.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import carried, cut, released, small_batches, table

GAMMA = 0.9
LOW, LOW_INSIDE, PAGES = 0.4, 0.2, 4
BODY = 400

# Names of elements, and words in class, id and role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title svg math object canvas".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
NOISE = RAW | frozenset("head nav aside footer form button select option menu dialog fieldset input label".split())
NOISE_WORDS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs header masthead banner footer sidebar aside widget ad ads advert adverts advertisement sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription share sharing social comment comments reply replies respond disqus related recommended pagination pager toolbar login signup search complementary contentinfo".split()
)
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
LISTS = frozenset("ul ol dl table select".split())
PARAGRAPH_ENDS = BLOCKS - {"br", "body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "summary", "legend", "figcaption"}
OPEN, ENDS_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/<>]*)"), re.compile(r"""[<>"']""")
#: Elements nested deeper belong to the element at this depth, as in browsers.
DEEPEST = 400
NAME = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
TOKEN = re.compile(r"[^\W_]+")


def next_tag(html: str, at: int, last: dict[str, int]) -> tuple[int, int, bool, str, str] | None:
    """(start, end, is an end tag, name, attributes) of the first tag from at on; comments and declarations have no name.

    A "<" that no ">" ends before the next "<" outside quotes is text. last has
    the last place of each quote and of ">", so that none is looked for in vain.
    """
    while (at := html.find("<", at)) >= 0:
        if html.startswith("<!--", at):
            end = html.find("-->", at + 4)
            return at, end + 3 if end >= 0 else len(html), False, "", ""
        if html.startswith(("<!", "<?"), at):
            if at < last[">"]:
                return at, html.find(">", at) + 1, False, "", ""
        elif m := OPEN.match(html, at):
            k = m.end()
            while (q := ENDS_TAG.search(html, k)) and q[0] in "\"'" and q.start() < last[q[0]]:
                k = html.find(q[0], q.end()) + 1
            if q and q[0] == ">":
                return at, q.end(), bool(m[1]), m[2].lower(), html[m.end() : q.start()]
        at += 1
    return None


class Page:
    """Element nodes of a page in order (parent, tag, path, noise, inside) and its pieces of text (node, text), None between blocks."""

    def __init__(self, html: str):
        self.parent, self.tag, self.path, self.named = [-1], ["#"], [0], [False]
        self.pieces: list[tuple[int, str] | None] = []
        stack, at, last = [0], 0, {q: html.rfind(q) for q in "\"'>"}
        self.count: dict[str, int] = {}
        while found := next_tag(html, at, last):
            start, end, closes, tag, attributes = found
            if start > at:
                self.pieces.append((stack[-1], html[at:start]))
            at = end
            if not tag:
                continue
            if tag in BLOCKS:
                self.pieces.append(None)
            if closes:
                self._close(stack, {tag}, frozenset(), across=True)
                continue
            if tag in PARAGRAPH_ENDS:
                self._close(stack, {"p"}, frozenset({"button"}))
            if tag in ENDS:
                self._close(stack, ENDS[tag], LISTS)
            node = self._open(stack[-1], tag, attributes)
            if tag in RAW:
                close = re.compile(rf"</{tag}\b[^<>]*>?", re.I).search(html, at)
                at = close.end() if close else len(html)
            elif tag not in VOID and not attributes.endswith("/") and len(stack) < DEEPEST:
                stack.append(node)
                self.count[tag] = self.count.get(tag, 0) + 1
        if at < len(html):
            self.pieces.append((stack[-1], html[at:]))
        self._judge()

    def _close(self, stack: list[int], names: set[str], walls: frozenset[str], across: bool = False) -> None:
        """Close the innermost open element with one of the names; unless across is given, not across blocks or walls."""
        if not any(self.count.get(t) for t in names):
            return
        for k in range(len(stack) - 1, 0, -1):
            tag = self.tag[stack[k]]
            if tag in names:
                for gone in stack[k:]:
                    self.count[self.tag[gone]] -= 1
                del stack[k:]
                return
            if not across and (tag in BLOCKS or tag in walls):
                return

    def _open(self, parent: int, tag: str, attributes: str) -> int:
        names = " ".join(x or y or z for x, y, z in NAME.findall(attributes)).lower() if attributes else ""
        self.parent.append(parent)
        self.tag.append(tag)
        self.path.append(xxhash.xxh64_intdigest(f"{self.path[parent]}/{tag}.{names}") >> 1)
        self.named.append(any(NOISE_WORDS.issuperset(TOKEN.findall(name)) and TOKEN.search(name) is not None for name in names.split()))
        return len(self.tag) - 1

    def _judge(self) -> None:
        """Find noise, and what is inside <article> or <main>.

        An element's tag always makes noise of it. Its name doesn't if it holds
        an article (not one of its own, as comments are) or <main>; or over half
        of the text, where no such element is on the page or the text is BODY
        long at least.
        """
        n = len(self.tag)
        tagged, article, size = [False] * n, [False] * n, [0] * n
        holds = [False] * n
        for k in range(1, n):
            up, tag = self.parent[k], self.tag[k]
            article[k] = article[up] or tag == "article"
            tagged[k] = tagged[up] or tag in NOISE
            holds[k] = not tagged[k] and (tag == "main" or tag == "article" and not article[up] and not self.named[k])
        for piece in self.pieces:
            if piece and not tagged[piece[0]]:
                size[piece[0]] += len("".join(piece[1].split()))
        for k in range(n - 1, 0, -1):
            size[self.parent[k]] += size[k]
            holds[self.parent[k]] |= holds[k]
        self.noise, self.inside = [False] * n, [""] * n
        for k in range(1, n):
            up, tag = self.parent[k], self.tag[k]
            body = holds[k] or 2 * size[k] > size[0] and (not holds[0] or size[k] >= BODY)
            by_name = self.named[k] and tag not in ("html", "body", "main") and not body
            self.noise[k] = self.noise[up] or tagged[k] or tag == "header" and not self.inside[up] or by_name
            self.inside[k] = "article" if tag == "article" and not self.noise[k] else self.inside[up] or ("main" if tag == "main" else "")

    def branches(self) -> tuple[int, list[tuple[int, bool, int, list[int]]]]:
        """Hash of the page's text, and (path, inside <article> or <main>, hash of its children, hashes of its texts) of each node with text that the markup leaves open; nodes of one path together."""
        children: dict[int, dict[str, None]] = {}
        texts: dict[int, set[int]] = {}
        inside: dict[int, bool] = {}
        page = xxhash.xxh64()
        for k in range(1, len(self.tag)):
            if not self.noise[k]:
                children.setdefault(self.path[k], {})
                inside[self.path[k]] = inside.get(self.path[k], False) or bool(self.inside[k])
                if not self.noise[self.parent[k]]:
                    children.setdefault(self.path[self.parent[k]], {})[self.tag[k]] = None
        for piece in self.pieces:
            if piece and not self.noise[piece[0]] and (text := " ".join(piece[1].split())):
                page.update(text + "\n")
                h, k = xxhash.xxh64_intdigest(text) >> 1, piece[0]
                while k > 0:
                    texts.setdefault(self.path[k], set()).add(h)
                    k = self.parent[k]
        return page.intdigest() >> 1, [(p, inside[p], xxhash.xxh64_intdigest(",".join(children.get(p, ()))) >> 1, sorted(t)) for p, t in sorted(texts.items())]

    def _size(self, gone: list[bool], inside: bool) -> int:
        return sum(len("".join(p[1].split())) for p in self.pieces if p and not gone[p[0]] and bool(self.inside[p[0]]) == inside)

    def _gone(self, low: frozenset[int], inside: bool) -> list[bool]:
        """Which nodes go: noise, and branches of low importance; those inside <article> and <main> only if asked."""
        gone = list(self.noise)
        for k in range(1, len(self.tag)):
            gone[k] = gone[k] or gone[self.parent[k]] or (inside or not self.inside[k]) and self.path[k] in low and self.tag[k] not in ("html", "body")
        return gone

    def text(self, low: frozenset[int] | None = None) -> str:
        """The blocks that stay, joined by line ends. low: the branches of low importance, None without a tree."""
        if low is None:
            gone = list(self.noise)
            if self._size(gone, True) >= self._size(gone, False):
                gone = [g or not i for g, i in zip(gone, self.inside, strict=True)] if any(self.inside) else gone
        else:
            gone, outside = self._gone(low, True), self._gone(low, False)
            held = self._size(gone, False)
            if 2 * (self._size(gone, True) + held) < self._size(outside, True) + held:
                gone = outside
        blocks, now = [], []
        for piece in [*self.pieces, None]:
            if piece is None:
                if line := " ".join(unescape("".join(now)).split()):
                    blocks.append(line)
                now = []
            elif not gone[piece[0]]:
                now.append(piece[1])
        return "\n".join(blocks)


def with_host(pages: DataFrame) -> DataFrame:
    return pages.withColumn("host", F.lower(F.expr("try_parse_url(cast(url as string), 'HOST')")))


def style_trees(pages: DataFrame) -> DataFrame:
    """(host, path, pages, inside, importance) of the nodes that the markup leaves open; path 0 is the host itself. Pages of a host with the same text count once.

    content: 1 - mean over the node's texts of log(pages with that text) / log(pages with the node).
    presentation: entropy of its sequences of children, in units of log(pages with the node).
    """
    tree = pa.struct([("path", pa.int64()), ("inside", pa.bool_()), ("style", pa.int64()), ("texts", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            rows = {"host": [], "page": [], "tree": []}
            for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                page, nodes = Page(html).branches()
                if nodes:
                    nodes.append((0, False, 0, []))
                    for c, x in zip(rows, (host, page, [dict(zip(("path", "inside", "style", "texts"), n, strict=True)) for n in nodes]), strict=True):
                        rows[c].append(x)
            yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([("host", pa.string()), ("page", pa.int64()), ("tree", pa.list_(tree))]))

    seen = with_host(pages).where("host is not null and html is not null").select("host", F.col("html").cast("string")).mapInArrow(run, "host string, page long, tree array<struct<path:long,inside:boolean,style:long,texts:array<long>>>")
    nodes = seen.groupBy("host", "page").agg(F.min("tree").alias("tree")).select("host", F.explode("tree").alias("t")).select("host", "t.*")
    values = F.explode(F.concat(F.array(F.struct(F.lit("style").alias("kind"), F.col("style").alias("value"))), F.transform("texts", lambda x: F.struct(F.lit("text").alias("kind"), x.alias("value")))))
    counts = cut(nodes.select("host", "path", "inside", values.alias("v")).groupBy("host", "path", "v.kind", "v.value").agg(F.count("*").alias("n"), F.max("inside").alias("inside")))
    is_style = F.col("kind") == "style"
    node = counts.groupBy("host", "path").agg(
        F.sum(F.when(is_style, F.col("n"))).alias("pages"),
        F.sum(F.when(is_style, F.col("n") * F.ln("n"))).alias("style_nln"),
        F.count_if(~is_style).alias("texts"),
        F.sum(F.when(~is_style, F.ln("n"))).alias("text_ln"),
        F.max("inside").alias("inside"),
    )
    many, log_m = F.col("pages") > 1, F.ln("pages")
    content = F.when(many & (F.col("texts") > 0), 1 - F.col("text_ln") / F.col("texts") / log_m).otherwise(1.0)
    presentation = F.when(many, (log_m - F.col("style_nln") / F.col("pages")) / log_m).otherwise(1.0)
    return node.select("host", "path", "pages", "inside", ((1 - GAMMA) * presentation + GAMMA * content).alias("importance"))


def main_text(pages: DataFrame) -> DataFrame:
    """pages with one more column, text (in place of one of that name)."""
    small_batches(pages.sparkSession)
    low = style_trees(pages).where((F.col("pages") >= PAGES) & ((F.col("path") == 0) | (F.col("importance") < F.when(F.col("inside"), LOW_INSIDE).otherwise(LOW))))
    low = cut(low.groupBy("host").agg(F.collect_list("path").alias("_low"))).withColumnRenamed("host", "_host")
    # Spark broadcasts the trees' low nodes while their file is small, and else splits hosts with many pages
    both = with_host(carried(pages, "url", "html").withColumn("html", F.col("html").cast("string")))
    both = both.join(low, F.col("host") == F.col("_host"), "left")

    @F.pandas_udf("string")
    def extract(html, low):
        import pandas as pd

        known: dict[bytes, frozenset | None] = {}
        out = []
        for h, x in zip(html, low, strict=True):
            if h is None or h != h:
                out.append("")
                continue
            key = b"" if x is None else x.tobytes()
            if key not in known:
                known[key] = None if x is None else frozenset(x.tolist()) - {0}
            out.append(Page(h).text(known[key]))
        return pd.Series(out, dtype=object)

    return released(both.withColumn("text", extract("html", "_low")), "text")


def op7_site_style_tree(spark, sf_dir: str) -> DataFrame:
    out = main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
