"""Operator 3: main text by site style trees.

The pages of a host are merged into one tree of presentation nodes (paths of tag
and class words from the body down) with a content node for the text of each.
A content node's importance is the entropy of its texts over its instances; a
presentation node's is (1 - GAMMA**l) times the entropy of its child sequences plus
GAMMA**l times the mean importance of its l children (averaged over instances):
both entropies are divided by their largest possible value, the logarithm of the
number of instances. Text that every page repeats and layout that never changes
score near 0, articles near 1. A node with fewer than ``FEW_PAGES`` instances isn't
judged. A branch's score is the largest importance of its judged nodes: branches
that score below ``LEAST`` (``LEAST_INSIDE`` within an article) are removed from each
page. Hosts of fewer than ``FEW_PAGES`` pages are judged by the tree of all pages.

Fixed priors go first. Elements that never hold an article (scripts, forms,
navigation, ...) are cut. So are branches with a class, id or role word that names
boilerplate: the whole word, or the first or last part of a word with hyphens, but
no word that tells a state (``has-sidebar``, ``comments-open``, ``no-ad``). Such a
branch stays if it holds the page's only article or, where nothing else is left, its
only h1. Where articles (article, main, role=main) hold at least ``MOST_INSIDE`` of
the characters that are left, the text is what they hold.

Character references are decoded; white space within a block becomes one space;
blocks are joined in page order by one space. A path has ``DEEPEST`` elements at
most: deeper elements count as parts of the last one, with all their text.

Nulls: a null html gives the empty text; a null url is a host of its own; a null
page_id passes through. Repeated rows are pages of their own. Malformed markup is
read leniently: an end tag closes up to its element, an open comment or script
runs to the end. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mlode.llm import common as C

GAMMA = 0.9
LEAST = 0.5
LEAST_INSIDE = 0.2
FEW_PAGES = 30
#: Low nodes of hosts, and of all pages, that are sent to every task; with more, they come by a salted join on the host, or on the nodes in the page.
MOST_SENT = 200_000
SALTS = 32
ALL_SITES = 0
#: The share of characters that articles must hold for the rest to go.
MOST_INSIDE = 1 / 3
DEEPEST = 48

# fixed values: elements and class words
NEVER = frozenset("nav footer aside form button select option textarea input label fieldset dialog menu svg canvas iframe object embed audio video map head title meta link base".split())
RAW = "script|style|noscript|template|textarea|iframe|svg|title|noembed|noframes|xmp"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption address hr details summary header footer nav aside form fieldset center hgroup".split())
CLOSES_P = BLOCK - {"html", "body"}
CORE = frozenset(("article", "main"))
BOILER = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer masthead topbar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login comment comments commentlist disqus reply replies respond related recommended recommendations share sharing social widget widgets pagination pager toolbar skip copyright disclaimer contentinfo complementary search".split()
)
OUTER_ONLY = frozenset(("header", "top"))
STATE = frozenset("no not non has have is with without hide show open opened closed on off free enabled disabled allowed visible hidden active".split())

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW})\b[^>]*+>.*?(?:</\1\s*+>|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>",
    re.S | re.I,
)
_CLASS = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PARTS = re.compile(r"[-_:]+")
_HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")


#: Where markup begins that no > ends.
_MARKUP = re.compile(r"<(?=[a-zA-Z/!?])")
_CLOSED = re.compile(r"</[a-z]+\s*>\Z", re.I)


def _open(m: re.Match) -> bool:
    """Whether a token is a comment or raw element that nothing closes."""
    return (m[0].startswith("<!--") and not m[0].endswith("-->")) or (m[1] is not None and not _CLOSED.search(m[0]))


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def site_of(url: str | None) -> int:
    m = _HOST.match(url or "")
    return _hash("host " + m[1].lower()) if m else (_hash("no host") if url is None else _hash("other"))


class _Node:
    __slots__ = ("tag", "path", "key", "leaf", "depth", "cut", "flag", "kids", "core", "up")

    def __init__(self, tag: str, path: str, up: "_Node | None", cut: bool, flag: bool, core: bool, depth: int):
        self.tag, self.path, self.up, self.cut, self.flag, self.core, self.depth, self.kids = tag, path, up, cut, flag, core, depth, []
        found = _KEYS.get(path)
        if found is None:
            if len(_KEYS) > 200_000:
                _KEYS.clear()
            found = _KEYS[path] = (_hash(path), _hash(path + ">#text"))
        self.key, self.leaf = found

    def block(self) -> "_Node":
        node = self
        while node.tag not in BLOCK and node.up is not None:
            node = node.up
        return node

    def above(self) -> "Iterator[_Node]":
        node = self
        while node is not None:
            yield node
            node = node.up


_KEYS: dict[str, tuple[int, int]] = {}


def named(words: list[str], of: frozenset) -> bool:
    """Whether a word, or the first or last part of one that tells no state, is among those."""
    for w in words:
        parts = [x for x in _PARTS.split(w) if x]
        if w in of or (len(parts) > 1 and STATE.isdisjoint(parts) and (parts[0] in of or parts[-1] in of)):
            return True
    return False


def blocks(page: str) -> tuple[list[tuple[_Node, str]], list[_Node]]:
    """(block element, normal text) of each block with text, in page order, and all block elements with their children's names. What the priors cut is left out of both."""
    root = _Node("body", "body", None, False, False, False, 0)
    stack, found, nodes, parts, at = [root], [], [root], [], 0

    def flush() -> None:
        if parts:
            text = "".join(parts)
            parts.clear()
            text = " ".join((html_lib.unescape(text) if "&" in text else text).split())
            if text:
                found.append((stack[-1].block(), text))

    m, end = None, page.rfind(">") + 1
    for m in _TOKEN.finditer(page, 0, end):
        if m.start() > at and not stack[-1].cut:
            parts.append(page[at : m.start()])
        at = m.end()
        name = (m[3] or m[6] or "").lower()
        if not name:
            continue
        if m[2] or m[5]:  # an end tag
            if name in VOID or not any(n.tag == name for n in stack[1:]):
                continue
            if name in BLOCK:
                flush()
            while stack[-1].tag != name:
                if stack[-1].tag in BLOCK:
                    flush()
                stack.pop()
            stack.pop()
            continue
        if name in ("html", "body"):
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name in BLOCK:
            flush()
            if name in CLOSES_P:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == "p":
                        del stack[k:]
                        break
                    if stack[k].tag in BLOCK:
                        break
            if name == "li" and stack[-1].tag == "li":
                stack.pop()
        if name in VOID:
            continue
        attrs = m[4] or m[7] or ""
        words: list[str] = []
        main = name in CORE
        if "=" in attrs:
            for kind, *value in _CLASS.findall(attrs):
                words += "".join(value).lower().split()
                main = main or (kind.lower() == "role" and "".join(value).lower() == "main")
        up = stack[-1]
        flag = named(words, BOILER) or (not up.core and not main and (name == "header" or named(words, OUTER_ONLY)))
        deep = name in BLOCK and up.depth < DEEPEST
        path = up.path + ">" + name + ("." + ".".join(words) if words else "") if deep else up.path
        node = _Node(name, path, up, up.cut or name in NEVER, flag, up.core or main, up.depth + deep)
        if name in BLOCK and not node.cut:
            nodes.append(node)
        if not attrs.endswith("/") or name in BLOCK:
            stack.append(node)
    if not stack[-1].cut and not (m and at == end and _open(m)):
        parts.append(_MARKUP.split(page[at:], maxsplit=1)[0])
    flush()

    flagged = lambda node: any(n.flag for n in node.above())
    cores = [n for n in nodes if n.core and not n.flag and not (n.up and n.up.core)]
    keep = cores if cores and all(map(flagged, cores)) else []
    if not keep and all(flagged(b) for b, _ in found):
        keep = [n for n in nodes if n.tag == "h1"]
    for n in keep:
        for x in n.above():
            x.flag = False
    live = {id(n): not flagged(n) for n in nodes}
    live[id(root)] = True
    nodes = [n for n in nodes if live[id(n)]]
    for n in nodes[1:]:
        n.up.block().kids.append(n)
    return [x for x in found if live[id(x[0])]], nodes


def features(pages: DataFrame) -> DataFrame:
    """(site, node, depth, kind, feature, n, kids, share): how often a node had a child sequence (kind 0, with the number of children) or a content node a text (kind 1), and the share of a child in a node's children, summed over instances (kind 2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple, list] = {}

        def add(key: tuple, kids: int = 0, share: float = 0.0) -> None:
            have = seen.setdefault(key, [0, 0, 0.0])
            have[0] += 1
            have[1] += kids
            have[2] += share

        def out() -> pa.RecordBatch:
            cols = list(zip(*seen, strict=True)) or [()] * 5
            sums = list(zip(*seen.values(), strict=True)) or [()] * 3
            seen.clear()
            kinds = (pa.int64(),) * 7 + (pa.float64(),)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([*cols, *sums], kinds, strict=True)], ["site", "node", "depth", "kind", "feature", "n", "kids", "share"])

        for batch in batches:
            for i in range(batch.num_rows):
                site = site_of(batch.column(0)[i].as_py())
                found, nodes = blocks(batch.column(1)[i].as_py() or "")
                texts: dict[int, list[str]] = {}
                for block, text in found:
                    texts.setdefault(id(block), []).append(text)
                for node in nodes:
                    mine = texts.get(id(node), [])
                    below = [(k.key) for k in node.kids] + [node.leaf] * len(mine)
                    add((site, node.key, node.depth, 0, _hash("".join(k.path[k.path.rindex(">") :] for k in node.kids))), len(below))
                    for text in mine:
                        add((site, node.leaf, node.depth + 1, 1, _hash(text)))
                    for key, k in Counter(x for x in below if x != node.key).items():
                        add((site, node.key, node.depth, 2, key), 0, k / len(below))
                if len(seen) > 200_000:
                    yield out()
        if seen:
            yield out()

    return pages.select("url", "html").mapInArrow(run, "site long, node long, depth long, kind long, feature long, n long, kids long, share double")


def importances(counts: DataFrame, few: int) -> DataFrame:
    """site, node, instances, importance and score (the largest importance of the judged nodes of the branch; null if none is judged).

    From the deepest nodes up, one join a depth; the trees have DEEPEST + 1 depths at most."""
    n = F.col("n").cast("double")
    own = counts.filter("kind < 2").groupBy("site", "node", "depth", "kind").agg(F.sum("n").alias("instances"), F.sum(n * F.log(n)).alias("nlogn"), F.sum("kids").alias("kids"))
    most = F.log(F.col("instances").cast("double"))
    entropy = F.when(F.col("instances") > 1, (most - F.col("nlogn") / F.col("instances")) / most).otherwise(1.0)
    own = C.Kept(own.select("site", "node", "depth", "kind", "instances", entropy.alias("entropy"), F.pow(F.lit(GAMMA), F.col("kids") / F.col("instances")).alias("weight")), "style-entropies")
    shares = counts.filter("kind = 2").select("site", "node", "depth", F.col("feature").alias("child"), "share")
    judged = lambda v: F.when(F.col("instances") >= few, v)
    deepest = own.df.agg(F.max("depth").alias("d")).first()["d"]
    done, below = None, None
    for depth in range(deepest if deepest is not None else -1, -1, -1):
        here = own.df.filter(F.col("depth") == depth)
        leaves = here.filter("kind = 1").select("site", "node", "instances", F.col("entropy").alias("importance"), judged(F.col("entropy")).alias("score"))
        inner = here.filter("kind = 0")
        if below is None:
            inner = inner.withColumn("content", F.lit(0.0)).withColumn("best", F.lit(None).cast("double"))
        else:
            children = below.df.select("site", F.col("node").alias("child"), "importance", "score")
            composed = shares.filter(F.col("depth") == depth).join(children, ["site", "child"]).groupBy("site", "node").agg(F.sum(F.col("share") * F.col("importance")).alias("sum"), F.max("score").alias("best"))
            inner = inner.join(composed, ["site", "node"], "left").withColumn("content", F.coalesce(F.col("sum") / F.col("instances"), F.lit(0.0)))
        value = (1 - F.col("weight")) * F.col("entropy") + F.col("weight") * F.col("content")
        inner = inner.select("site", "node", "instances", value.alias("importance"), "best").select("site", "node", "instances", "importance", F.greatest(judged(F.col("importance")), "best").alias("score"))
        below = C.Kept(leaves.unionByName(inner), "style-importances")
        done = below.df if done is None else done.unionByName(below.df)
    own.drop()
    if done is None:
        return counts.sparkSession.createDataFrame([], "site long, node long, instances long, importance double, score double")
    return done


def low_nodes(pages: DataFrame) -> DataFrame:
    """(site, node, score) of branches below LEAST: of each host, and of all pages with site ALL_SITES; a host with a tree of its own has a row with node 0."""
    counts = C.written(features(pages).groupBy("site", "node", "depth", "kind", "feature").agg(F.sum("n").alias("n"), F.sum("kids").alias("kids"), F.sum("share").alias("share")), "style-trees")
    everywhere = counts.groupBy("node", "depth", "kind", "feature").agg(F.sum("n").alias("n"), F.sum("kids").alias("kids"), F.sum("share").alias("share")).withColumn("site", F.lit(ALL_SITES).cast("long"))
    found = importances(counts.unionByName(everywhere), FEW_PAGES)
    own = found.filter(F.col("site") != ALL_SITES)
    large = own.filter((F.col("node") == _hash("body")) & (F.col("instances") >= FEW_PAGES)).select("site")
    low = F.col("score") < LEAST
    per_host = own.filter(low).join(large, "site", "left_semi").select("site", "node", "score")
    return per_host.unionByName(found.filter(F.col("site") == ALL_SITES).filter(low).select("site", "node", "score")).unionByName(large.select("site", F.lit(0).cast("long").alias("node"), F.lit(0.0).alias("score")))


def main_text(page: str, low: dict[int, float]) -> str:
    found, _ = blocks(page)
    inside = [x for x in found if x[0].core]
    if inside and sum(len(t) for _, t in inside) >= MOST_INSIDE * sum(len(t) for _, t in found):
        found = inside

    def kept(block: _Node) -> bool:
        least = LEAST_INSIDE if block.core else LEAST
        return low.get(block.leaf, 1.0) >= least and all(low.get(n.key, 1.0) >= (LEAST_INSIDE if n.core else least) for n in block.above())

    verdict: dict[int, bool] = {}
    out = []
    for block, text in found:
        if block.key not in verdict:
            verdict[block.key] = kept(block)
        if verdict[block.key]:
            out.append(text)
    return " ".join(out)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each page."""
    spark = pages.sparkSession
    base = pages.select("page_id", "url", "html")
    low = C.written(low_nodes(base), "low-nodes")
    everywhere, hosts = low.filter(F.col("site") == ALL_SITES), low.filter(F.col("site") != ALL_SITES)
    many_general, many_hosts = everywhere.count() > MOST_SENT, hosts.count() > MOST_SENT
    kind = pages.schema["page_id"].dataType.simpleString()
    schema = f"page_id {kind}, url string, text string, n_chars long"

    def cut(batch: pa.RecordBatch, low_of) -> pa.RecordBatch:
        texts = [main_text(batch.column("html")[i].as_py() or "", low_of(i)) for i in range(batch.num_rows)]
        return pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    trees: dict[int, dict[int, float]] = {}
    for r in [] if many_hosts else hosts.collect():
        trees.setdefault(r["site"], {})[r["node"]] = r["score"]
    sent = spark.sparkContext.broadcast(({} if many_general else {r["node"]: r["score"] for r in everywhere.collect()}, trees))
    given = [c for c, many in (("_own", many_hosts), ("_general", many_general)) if many]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        general, own = sent.value

        def low_of(part: pa.RecordBatch, i: int) -> dict[int, float]:
            found = dict(v) if "_own" in given and (v := part.column("_own")[i].as_py()) is not None else own.get(site_of(part.column("url")[i].as_py()))
            if found is None:
                found = dict(part.column("_general")[i].as_py() or ()) if "_general" in given else general
            return found

        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                yield cut(part, lambda i, part=part: low_of(part, i))

    if not given:
        return base.mapInArrow(run, schema)

    @F.udf("long")
    def site(url):
        return site_of(url)

    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    joined = base.withColumn("_salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    per_site = hosts.groupBy("site").agg(F.map_from_entries(F.collect_list(F.struct("node", "score"))).alias("_own")).withColumn("_salt", salts)
    if many_general:
        # the nodes of a page depend on its html alone
        joined = joined.withColumn("_doc", F.md5(F.coalesce("html", F.lit(""))))

        def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = sent.value[1]
            for batch in batches:
                for k in range(0, batch.num_rows, 256):
                    rows = []
                    for url, page, doc, salt in zip(*(batch.column(c)[k : k + 256].to_pylist() for c in range(4)), strict=True):
                        if (at := site_of(url)) not in own:
                            rows += [(at, doc, salt, key) for key in {x for node in blocks(page or "")[1] for x in (node.key, node.leaf)}]
                    cols = list(zip(*rows, strict=True)) or [()] * 4
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int32(), pa.int64()), strict=True)], ["site", "_doc", "_salt", "node"])

        there = joined.select("url", "html", "_doc", "_salt").mapInArrow(keys, "site long, _doc string, _salt int, node long")
        there = there.join(everywhere.select("node", "score", salts.alias("_salt")), ["node", "_salt"])
        if many_hosts:
            there = there.join(per_site.select("site", "_salt"), ["site", "_salt"], "left_anti")
        per_page = there.groupBy("_doc", "_salt").agg(F.map_from_entries(F.collect_set(F.struct("node", "score"))).alias("_general"))
    if many_hosts:
        joined = joined.withColumn("site", site("url")).join(per_site, ["site", "_salt"], "left")
    if many_general:
        joined = joined.join(per_page, ["_doc", "_salt"], "left")
    return joined.select("page_id", "url", "html", *given).mapInArrow(run, schema)


def op3_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(C.table(spark, sf_dir, "pages"))
