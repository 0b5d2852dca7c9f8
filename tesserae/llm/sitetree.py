"""Main text of pages by a site style tree.

The pages of a host are merged into one style tree. A node is an element at its
path (tags with their classes, digits left out); its style nodes are the
sequences of children that it takes, runs of like children as one; the texts
right under it are its content. With shares s of the m pages that hold the node,
and entropy h(s) = max(0, 1 + log s / log min(m, 64)):

* presentation importance of a node is the entropy of its style nodes;
* content importance is 1 - mean of h over its distinct texts, so what every
  page repeats counts 0 and what is new on each counts 1. The base stops at 64
  pages: a verdict depends on shares, not on how many pages a host has;
* composite importance of an inner node, bottom-up with l style nodes, is
  (1 - 0.9^l) presentation + 0.9^l times the mean over its own content and its
  children.

A branch is removed from each page if it and all below it are under
``IMPORTANCE``. Flow elements without a class (headings, paragraphs, items and
so on) are no branches of their own: they go with the branch they are in, so an
article's usual headings stay. Any other text that over half of a host's pages
have goes wherever it stands. Nodes on few pages (under ``MIN_PAGES``, however
many the host has) are important: the tree can't tell. Equal pages of a host
count once.

Entropy can't tell menus, adverts or comments that are new on every page, nor
anything on hosts of few pages. There labels decide: elements that say what they
are by tag (nav, footer, aside, form, header outside articles and so on), role
or class word never are main text.

Scale: pages are parsed once; their blocks are written with hashes of paths,
texts and styles. Only hashes go to the tree, in partial sums, so a host with a
third of all pages is no hot task; one host's tree, a row for each path on
``MIN_PAGES`` pages or more, is held at once. The hosts' lists of what goes are
joined with salted hosts.

Edge cases: null or empty html, or pages without text, give an empty text; a
null url is the host ""; unclosed or stray tags, comments and bad entities are
taken as browsers do; repeated pages, also with equal page_id, each get their
text; null page_ids stay null; ties in importance keep the branch; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import Stash

MIN_PAGES = 8
IMPORTANCE = 0.4
BASE = 64
DECAY = 0.9
REPEATED = 0.5
SALTS = 32

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:_-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([A-Za-z][A-Za-z0-9:_-]*)([^>]*+)>", re.S)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template title textarea svg math iframe object canvas select".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr br img".split())
_NOISE_TAG = frozenset("nav footer aside form button menu dialog fieldset head".split())
_NOISE_ROLE = frozenset("navigation banner contentinfo complementary search dialog alert".split())
#: Class words that say what an element is: alone, or as the last part of a compound ("cookie-notice").
_NOISE_WORD = frozenset("ad ads adv advert adverts advertisement advertising banner menu nav navbar navigation sidebar footer masthead comment comments disqus replies cookie cookies consent notice notices alert promo promotion sponsor sponsored social share sharing related breadcrumb breadcrumbs popup modal overlay subscribe newsletter signup login widget toolbar pager pagination".split())
#: Those that do so as the first part as well ("ad-slot", "comments_list").
_NOISE_FIRST = frozenset("ad ads advert comment comments cookie nav navbar menu sidebar footer breadcrumb breadcrumbs site-header page-header".split())
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_FLOW = frozenset("h1 h2 h3 h4 h5 h6 p li dt dd td th tr tbody thead tfoot caption figcaption blockquote pre ul ol dl table".split())
_CLOSES_P = frozenset("address article aside blockquote center details dialog div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_LIMITS = frozenset("ul ol table div article section main body html blockquote".split())


def _hash(x: str) -> int:
    return xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) - (1 << 63)


def labelled(tag: str, names: list[tuple[str, str]], article: bool) -> bool:
    """Whether an element says itself that it is no main text."""
    if tag in _NOISE_TAG or (tag == "header" and not article):
        return True
    for kind, words in names:
        for word in words.lower().split():
            parts = re.split("[-_]", word)
            if kind == "role":
                noise = word in _NOISE_ROLE
            elif kind == "id":
                noise = word in _NOISE_WORD
            else:
                noise = word in _NOISE_WORD or word in _NOISE_FIRST or parts[-1] in _NOISE_WORD or parts[0] in _NOISE_FIRST
            if noise:
                return True
    return False


class Page:
    """One page's ``blocks`` (path, labelled as noise, text, plain heading) in order, and its ``styles``: path to parent, flow and the child sequences it has here."""

    def __init__(self, page: str):
        self.blocks: list[tuple[int, bool, str, bool]] = []
        self.styles: dict[int, tuple[int, bool, set[int]]] = {}
        # open elements: tag, path, noise, article, path hash, flow, children
        self.stack: list[tuple[str, str, bool, bool, int, bool, list[str]]] = [("", "", False, False, _hash(""), False, [])]
        self.held: list[str] = []
        self._read(page)
        self._flush()
        self._close(0)

    def _flush(self) -> None:
        if self.held:
            text = " ".join(html.unescape("".join(self.held)).split())
            self.held.clear()
            if text:
                at = next(x for x in reversed(self.stack) if x[0] not in _INLINE)
                self.blocks.append((at[4], at[2], text, at[5] and at[0] in _HEADINGS))
                if at[6][-1:] != ["#"]:
                    at[6].append("#")

    def _close(self, depth: int) -> None:
        """Ends the elements from ``depth`` on; inline ones leave no node."""
        while len(self.stack) > depth:
            tag, _, _, _, me, flow, children = self.stack.pop()
            if tag not in _INLINE:
                up = next((x[4] for x in reversed(self.stack) if x[0] not in _INLINE), me)
                self.styles.setdefault(me, (up, flow, set()))[2].add(_hash(" ".join(children)))

    def _last(self, tags: tuple[str, ...], limits: frozenset[str] = frozenset()) -> int:
        """The innermost open element among ``tags`` that no limit encloses; 0 if none."""
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i][0] in tags:
                return i
            if self.stack[i][0] in limits:
                return 0
        return 0

    def _read(self, page: str) -> None:
        at, end = 0, len(page)
        for m in iter(lambda: _TAG.search(page, at), None):
            if m.start() > at:
                self.held.append(page[at : m.start()])
            at = m.end()
            tag = (m[2] or m[5] or "").lower()
            if not tag:
                continue
            close, attrs = (m[1] or m[4]) == "/", m[3] or m[6] or ""
            if tag in ("br", "wbr"):
                self.held.append(" " if tag == "br" else "")
                continue
            if tag not in _INLINE:
                self._flush()
            if close:
                if depth := self._last((tag,)):
                    self._close(depth)
                continue
            if tag in _RAW:
                if not attrs.rstrip().endswith("/"):
                    stop = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
                    at = stop.end() if stop else end
                continue
            if tag in _VOID:
                continue
            if tag in _CLOSES_P:
                if depth := self._last(("p",), _LIMITS):
                    self._close(depth)
            elif tag in _SIBLINGS and (depth := self._last(_SIBLINGS[tag], _LIMITS)):
                self._close(depth)
            self._open(tag, attrs)
        if at < end:
            self.held.append(page[at:])

    def _open(self, tag: str, attrs: str) -> None:
        _, path, noise, article, me, _, _ = self.stack[-1]
        names = [(k.lower(), v.strip("\"'")) for k, v in _ATTRIBUTE.findall(attrs)] if attrs else []
        article = article or tag in ("article", "main")
        noise = noise or (tag not in ("html", "body", "article", "main") and labelled(tag, names, article))
        flow = False
        if tag not in _INLINE:
            style = re.sub("[0-9]+", "", " ".join(v for k, v in names if k == "class"))
            sign = f"{tag}.{style}" if style else tag
            path, flow = f"{path}>{sign}", tag in _FLOW and not names
            me = _hash(path)
            up = next(x for x in reversed(self.stack) if x[0] not in _INLINE)
            if up[6][-1:] != [sign]:
                up[6].append(sign)
        self.stack.append((tag, path, noise, article, me, flow, []))


def main_text(page: str, noisy: frozenset[int] | set[int] = frozenset(), repeated: frozenset[int] | set[int] = frozenset()) -> str:
    """Kept blocks joined by newlines, given the host's paths and texts that go."""
    return "\n".join(t for p, noise, t, heading in Page(page).blocks if not noise and p not in noisy and (heading or _hash(t) not in repeated))


def _parsed(df: DataFrame) -> DataFrame:
    """page_id, url, host, page (hash), blocks (path, noise, content, heading, text) and styles (path, parent, flow, style) of every page."""
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))
    src = df.select("page_id", "url", F.xxhash64(host).alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    block = pa.struct([("path", pa.int64()), ("noise", pa.bool_()), ("content", pa.int64()), ("heading", pa.bool_()), ("text", pa.string())])
    style = pa.struct([("path", pa.int64()), ("parent", pa.int64()), ("flow", pa.bool_()), ("style", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                hashes, found, styles = [], [], []
                for text in part.column(3).to_pylist():
                    page = Page(text)
                    hashes.append(_hash(text))
                    found.append([{"path": p, "noise": n, "content": _hash(t), "heading": heading, "text": t} for p, n, t, heading in page.blocks])
                    styles.append([{"path": p, "parent": up, "flow": flow, "style": x} for p, (up, flow, xs) in page.styles.items() for x in xs])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(hashes, pa.int64()), pa.array(found, pa.list_(block)), pa.array(styles, pa.list_(style))], ["page_id", "url", "host", "page", "blocks", "styles"])

    kind = src.schema["page_id"].dataType.simpleString()
    return src.mapInArrow(run, f"page_id {kind}, url string, host long, page long, blocks array<struct<path:long,noise:boolean,content:long,heading:boolean,text:string>>, styles array<struct<path:long,parent:long,flow:boolean,style:long>>")


def _entropy(share: Column, pages: Column) -> Column:
    base = F.log(F.greatest(F.least(pages, F.lit(BASE)), F.lit(2)).cast("double"))
    return F.when(pages > 1, F.greatest(F.lit(0.0), 1 + F.log(share) / base)).otherwise(0.0)


_TREE = "host long, path long, parent long, flow boolean, pages long, presentation double, content double, composite double, top double, noisy boolean"


def _resolve(importance: float):
    """Composite importance of one host's nodes, the highest at or below each, and what goes."""

    def run(table: pa.Table) -> pa.Table:
        path, parent = (table.column(n).to_numpy() for n in ("path", "parent"))
        place = {p: i for i, p in enumerate(path.tolist())}
        up = [place.get(q, -1) if q != p else -1 for p, q in zip(path.tolist(), parent.tolist(), strict=True)]
        children: list[list[int]] = [[] for _ in up]
        for i, j in enumerate(up):
            if j >= 0:
                children[j].append(i)
        order = [i for i, j in enumerate(up) if j < 0]
        for i in order:  # grows: parents before children
            order.extend(children[i])
        shown, content, styles = (table.column(n).to_pylist() for n in ("presentation", "content", "n_styles"))
        composite, top = [1.0] * len(up), [1.0] * len(up)
        for i in reversed(order):
            parts = [composite[c] for c in children[i]] + ([content[i]] if content[i] is not None else [])
            mean = sum(parts) / len(parts) if parts else 0.0
            own = DECAY ** styles[i] if children[i] else 1.0
            composite[i] = (1 - own) * shown[i] + own * mean
            top[i] = max([composite[i], *(top[c] for c in children[i]), *([content[i]] if content[i] is not None else [])])
        flow = table.column("flow").to_pylist()
        noisy = [False] * len(up)
        for i in order:
            inside = up[i] >= 0 and noisy[up[i]]
            noisy[i] = inside or (top[i] < importance and not (flow[i] and up[i] >= 0))
        cols = [table.column(n) for n in ("host", "path", "parent", "flow", "pages", "presentation", "content")]
        return pa.Table.from_arrays([*cols, pa.array(composite), pa.array(top), pa.array(noisy)], [x.split()[0] for x in _TREE.split(", ")])

    return run


def _tree(parsed: DataFrame, importance: float, min_pages: int) -> tuple[DataFrame, DataFrame]:
    """The style tree of each host (see ``_TREE``), and host, content of texts on most of its pages."""
    slim = parsed.select("host", "page", F.transform("blocks", lambda b: F.struct(b["path"].alias("path"), b["content"].alias("content"))).alias("texts"), F.array_distinct(F.transform(F.filter("blocks", lambda b: ~b["heading"]), lambda b: b["content"])).alias("plain"), "styles").dropDuplicates(["host", "page"])
    hosts = slim.groupBy("host").agg(F.count(F.lit(1)).alias("all"))
    one = slim.select("host", F.explode("styles").alias("s")).groupBy("host", "s.path", "s.style").agg(F.count(F.lit(1)).alias("k"), F.min("s.parent").alias("parent"), F.min("s.flow").alias("flow"))
    pages = slim.select("host", F.explode(F.array_distinct(F.transform("styles", lambda s: s["path"]))).alias("path")).groupBy("host", "path").agg(F.count(F.lit(1)).alias("pages"))
    pages = pages.where(F.col("pages") >= min_pages)
    total = one.groupBy("host", "path").agg(F.sum("k").alias("n"), F.count(F.lit(1)).alias("n_styles"), F.sum(F.col("k") * F.log("k")).alias("x"), F.min("parent").alias("parent"), F.min("flow").alias("flow"))
    # - sum p log p = log n - sum k log k / n
    shown = F.least(F.lit(1.0), (F.log("n") - F.col("x") / F.col("n")) / F.log(F.least(F.col("pages"), F.lit(BASE)).cast("double")))
    nodes = total.join(pages, ["host", "path"]).withColumn("presentation", F.when(F.col("pages") > 1, F.greatest(F.lit(0.0), shown)).otherwise(1.0))
    texts = slim.select("host", F.explode(F.array_distinct("texts")).alias("t")).groupBy("host", "t.path", "t.content").agg(F.count(F.lit(1)).alias("k"))
    # by how many texts have which count first, so that a path with new texts on every page is few rows before it is joined
    texts = texts.groupBy("host", "path", "k").agg(F.count(F.lit(1)).alias("n"))
    leaf = texts.join(pages, ["host", "path"]).groupBy("host", "path").agg((1 - F.sum(F.col("n") * _entropy(F.col("k") / F.col("pages"), F.col("pages"))) / F.sum("n")).alias("content"))
    nodes = nodes.join(leaf, ["host", "path"], "left").select("host", "path", "parent", "flow", "pages", "presentation", "content", "n_styles")
    tree = nodes.groupBy("host").applyInArrow(_resolve(importance), _TREE)
    said = slim.select("host", F.explode("plain").alias("content")).groupBy("host", "content").agg(F.count(F.lit(1)).alias("k"))
    repeated = said.where(F.col("k") >= min_pages).join(hosts, "host").where(F.col("k") > REPEATED * F.col("all")).select("host", "content")
    return tree, repeated


def style_tree(df: DataFrame, importance: float = IMPORTANCE, min_pages: int = MIN_PAGES) -> DataFrame:
    """host (hash), path, parent, flow, pages, presentation, content and composite importance, the highest below, and whether it goes, of every node of every host."""
    return _tree(_parsed(df), importance, min_pages)[0]


def extract(df: DataFrame, min_pages: int = MIN_PAGES, importance: float = IMPORTANCE) -> DataFrame:
    """page_id, url and main text of every page."""
    stash = Stash(df.sparkSession)
    parsed = stash.write(_parsed(df), "parsed")
    tree, repeated = _tree(parsed, importance, min_pages)
    gone = tree.where("noisy").select("host", F.col("path").alias("p"), F.lit(None).cast("long").alias("t")).union(repeated.select("host", F.lit(None).cast("long"), "content"))
    gone = stash.write(gone.groupBy("host").agg(F.collect_list("p").alias("noisy"), F.collect_list("t").alias("repeated")), "gone")
    salted = gone.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    pages = parsed.withColumn("salt", F.pmod(F.col("page"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")
    none = F.array().cast("array<long>")
    kept = F.filter("blocks", lambda b: ~b["noise"] & ~F.array_contains(F.coalesce("noisy", none), b["path"]) & (b["heading"] | ~F.array_contains(F.coalesce("repeated", none), b["content"])))
    return pages.select("page_id", "url", F.array_join(F.transform(kept, lambda b: b["text"]), "\n").alias("text"))


def op6(df: DataFrame) -> DataFrame:
    """The contract's columns."""
    return extract(df).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
