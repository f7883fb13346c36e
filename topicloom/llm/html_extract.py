"""Main text of pages by site style trees.

The pages of a host are merged into one tree: an element node is a path of tags and
classes, its style nodes are the sequences of children seen below it, and its content
features are the words and link targets of its blocks.  Importance follows from entropy:

* presentation, for a node with m pages and styles of shares p:  -sum p log_m p
  (1 if m = 1): many presentations speak for content, one for a template;
* content, for a node with features:  1 - mean over features of log_m n, with n the
  pages that show the feature: a word found there on every page counts 0, on one page 1;
* composite, for a node E with l styles:  (1 - g^l) presentation(E) + g^l times the
  mean of the composites below, weighted by style share.

* information, for a branch: the sum over its features and the pages that show them of
  1 - log_m n, and its share of its parent's branch.

Branches with low composite importance are removed from every page.  So are branches that
are a fixed part of a fixed whole: presented alike on all pages (presentation below
``THRESHOLD``), below a node presented alike, and with less than ``SHARE`` of its
information; words of menus, adverts and footers may differ from page to page, but their
place does not, and they say little.  A branch with a page's heading is none.  HTML's own
landmarks weigh beside it: ``nav``, ``footer``, adverts, comments and the like are no
content (see ``dom``); inside ``article`` and ``main`` importance must be lower by
``MAIN_WEIGHT`` for a branch to go; on pages whose main landmark has text, a block
outside of it stays only where its importance is high (``1 - THRESHOLD`` at least).
Hosts with fewer than ``MIN_PAGES`` pages have no statistics: landmarks alone decide.

The tree is a table of (host, path) nodes built by counts by (host, path, feature),
combined before the shuffle, so a host with most of the pages is no hot spot.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.llm.common import SALTS, bounded_batches, cut, lean, remove, scratch_path
from topicloom.llm.dom import Page
from topicloom.llm.url_filter import host_of

DAMPING = 0.9
THRESHOLD = 0.25
MIN_PAGES = 5
MAIN_WEIGHT = 0.5
SHARE = 0.1
#: Bytes of verdicts that are broadcast at most.
BROADCAST_BYTES = 64 << 20
NODE, STYLE, CONTENT = 0, 1, 2
OBSERVED = "host string, path long, kind int, key long, chain array<long>, decided boolean, inside boolean, outside boolean, heads boolean, occ long, share double, words array<int>, shows array<int>"


@lru_cache(1 << 16)
def _signed(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def observe(pages: DataFrame, landmarks: bool = True) -> DataFrame:
    """``host, html`` -> what each page says of its nodes and styles, and what a batch's pages say of a node's contents.

    A row of contents has the hashes of a node's words and links, and how many pages show each.
    """
    names = [c.split()[0] for c in OBSERVED.split(", ")]
    types = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.bool_(), pa.bool_(), pa.bool_(), pa.bool_(), pa.int64(), pa.float64(), pa.list_(pa.int32()), pa.list_(pa.int32())]

    def seen(source: str | None) -> tuple[dict, Counter, dict]:
        page = Page(source, landmarks)
        nodes, styles, found, share = {}, Counter(), defaultdict(set), Counter()
        for e in page.elements:
            if e.path not in nodes:
                nodes[e.path] = [e.chain(), True, True, False, False, 0]
            n = nodes[e.path]
            n[1] &= e.dropped
            n[2] &= e.main and not e.dropped
            n[4] |= e.tag == "h1"
            n[5] += 1
            if e.kids:
                styles[e.path, _signed(" ".join(map(str, e.kids)))] += 1
                for k in e.kids:
                    if k != e.path:
                        share[k] += 1 / len(e.kids)
            if e.links:
                found[e.path].update(" " + link for link in e.links)
        kept = [e for e, _ in page.blocks if not e.dropped]
        if any(e.main for e in kept):
            for e in kept:
                nodes[e.path][3] |= not e.main
        for e, text in page.blocks:
            found[e.path].update(text.split())
        for p, n in nodes.items():
            n.append(float(share[p]))
        return nodes, styles, found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list, contents: dict) -> pa.RecordBatch:
            for (host, path), n in contents.items():
                words = np.fromiter(map(xxhash.xxh32_intdigest, n), np.uint32, len(n)).view(np.int32)
                rows.append((host, path, CONTENT, 0, None, None, None, None, None, None, 0.0, words, np.fromiter(n.values(), np.int32, len(n))))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        for b in batches:
            rows, contents, size = [], defaultdict(Counter), 0
            for host, source in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                nodes, styles, found = seen(source)
                rows += [(host, p, NODE, 0, *marks, None, None) for p, marks in nodes.items()]
                rows += [(host, p, STYLE, k, None, None, None, None, None, n, 0.0, None, None) for (p, k), n in styles.items()]
                for p, words in found.items():
                    contents[host, p].update(words)
                    size += len(words)
                if len(rows) + size > 500_000:
                    yield out(rows, contents)
                    rows, contents, size = [], defaultdict(Counter), 0
            if rows:
                yield out(rows, contents)

    return bounded_batches(pages).select("host", "html").mapInArrow(lean(run), OBSERVED)


def style_tree(pages: DataFrame, damping: float = DAMPING, landmarks: bool = True) -> DataFrame:
    """``host, html`` -> ``host, path, pages, decided, inside, outside, heads, presentation, content, importance, share, within``.

    ``share`` is a branch's part of its parent's information, ``within`` the parent's
    presentation.  Pages are read once: what they say is written, and read for the nodes
    and for the contents.
    """
    spark = pages.sparkSession
    path = scratch_path(spark, "observed")
    observe(pages, landmarks).write.option("compression", "zstd").parquet(path)
    said = spark.read.parquet(path)
    node = F.xxhash64("host", "path").alias("node")
    shown = said.filter(F.col("kind") == CONTENT).select(node, F.explode(F.arrays_zip("words", "shows")).alias("x"))
    shown = shown.groupBy("node", F.col("x.words").alias("word")).agg(F.sum("x.shows").alias("shows"))
    contents = shown.groupBy("node").agg(F.count("*").alias("texts"), F.sum(F.log("shows")).alias("tlog"), F.sum("shows").alias("shows"), F.sum(F.col("shows") * F.log("shows")).alias("slog"))
    counted = said.filter(F.col("kind") != CONTENT).groupBy("host", "path", "kind", "key").agg(
        F.count("*").alias("pages"), F.sum("occ").alias("occ"), F.sum("share").alias("share"), F.first("chain", True).alias("chain"),
        F.min("decided").alias("decided"), F.min("inside").alias("inside"), F.max("outside").alias("outside"), F.max("heads").alias("heads"),
    )
    is_ = lambda k: F.col("kind") == k
    nodes = counted.groupBy("host", "path").agg(
        F.sum(F.when(is_(NODE), F.col("pages"))).alias("pages"),
        F.sum(F.when(is_(NODE), F.col("occ"))).alias("occ"),
        F.sum(F.when(is_(NODE), F.col("share"))).alias("share"),
        F.first("chain", True).alias("chain"),
        F.min("decided").alias("decided"),
        F.min("inside").alias("inside"),
        F.max("outside").alias("outside"),
        F.max("heads").alias("heads"),
        F.count(F.when(is_(STYLE), 1)).alias("l"),
        F.sum(F.when(is_(STYLE), F.col("occ"))).alias("shown"),
        F.sum(F.when(is_(STYLE), F.col("occ") * F.log("occ"))).alias("olog"),
    )
    nodes = nodes.withColumn("node", node).join(contents, "node", "left").fillna(0, ["texts"])
    lm = F.log("pages")
    present = F.when(F.col("pages") <= 1, 1.0).otherwise(F.least(F.lit(1.0), (F.log("shown") - F.col("olog") / F.col("shown")) / lm))
    content = F.when(F.col("texts") > 0, F.when(F.col("pages") <= 1, 1.0).otherwise(1 - F.col("tlog") / (F.col("texts") * lm)))
    told = F.coalesce(F.when(F.col("pages") <= 1, F.col("shows")).otherwise(F.col("shows") - F.col("slog") / lm), F.lit(0.0))
    gl = F.pow(F.lit(damping), F.col("l"))
    base = F.when(F.col("l") > 0, (1 - gl) * present).otherwise(F.coalesce(content, F.lit(1.0)))
    nodes = cut(
        nodes.select("host", "path", "pages", "occ", "share", "chain", "decided", "inside", "outside", "heads", F.when(F.col("l") > 0, present).otherwise(0.0).alias("presentation"), content.alias("content"), told.alias("told"), base.alias("base"), gl.alias("gl"))
    )
    remove(spark, path)
    # The weight of a node in its parent's composite, then in every ancestor's.
    parent = F.when(F.size("chain") > 1, F.element_at("chain", -2))
    up = nodes.select("host", F.col("path").alias("parent"), F.col("gl").alias("pgl"), F.col("occ").alias("pocc"), F.col("presentation").alias("within"))
    # A node has many below it, a root all of its host: they are spread over tasks.
    dealt = F.pmod(F.xxhash64("path"), F.lit(SALTS)).cast("int").alias("salt")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    own = nodes.select("host", "path", "share", "base", "told", "heads", "chain", parent.alias("parent"), dealt).join(up.select("*", salts), ["host", "parent", "salt"], "left")
    own = own.select("host", "path", "base", "told", "heads", "chain", "parent", "within", F.coalesce(F.col("pgl") * F.col("share") / F.col("pocc"), F.lit(1.0)).alias("f"))
    factor = own.select("host", F.col("path").alias("step"), "f")
    steps = own.select("host", "path", "base", "told", "heads", "within", "chain", dealt, F.posexplode("chain").alias("depth", "step")).join(factor.select("*", salts), ["host", "step", "salt"])
    lines = steps.groupBy("host", "path").agg(
        F.first("base").alias("base"), F.first("told").alias("told"), F.first("heads").alias("heads"), F.first("within").alias("within"), F.first("chain").alias("chain"), F.array_sort(F.collect_list(F.struct("depth", "f"))).alias("fs")
    )
    above = F.transform(
        "chain", lambda p, i: F.struct(p.alias("path"), F.aggregate(F.slice("fs", i + 2, F.size("fs")), F.lit(1.0), lambda a, x: a * x["f"]).alias("w"))
    )
    parts = lines.select("host", "path", "base", "told", "heads", "within", F.explode(above).alias("a"))
    own_row = F.col("path") == F.col("a.path")
    comp = parts.groupBy("host", F.col("a.path").alias("path")).agg(
        F.sum(F.col("a.w") * F.col("base")).alias("composite"), F.sum("told").alias("branch"), F.max("heads").alias("heads"), F.max(F.when(own_row, F.col("within"))).alias("within")
    )
    out = cut(nodes.drop("heads").join(comp, ["host", "path"]).withColumn("parent", parent))
    whole = out.select("host", F.col("path").alias("parent"), F.col("branch").alias("whole"))
    x = out.withColumn("salt", dealt).join(whole.select("*", salts), ["host", "parent", "salt"], "left")
    share = F.when(F.col("whole") > 0, F.col("branch") / F.col("whole")).otherwise(F.lit(1.0))
    importance = F.greatest("composite", "content").alias("importance")
    return x.select("host", "path", "pages", "decided", "inside", "outside", "heads", "presentation", "content", importance, share.alias("share"), "within")


def verdicts(pages: DataFrame, threshold=THRESHOLD, min_pages=MIN_PAGES, landmarks: bool = True) -> DataFrame:
    """``host, path, body``: branches found unimportant, and important ones (``body``) outside main landmarks."""
    tree = style_tree(pages, landmarks=landmarks).filter(~F.col("decided") & (F.col("pages") >= min_pages))
    low = F.col("importance") < F.when(F.col("inside"), threshold * MAIN_WEIGHT).otherwise(threshold)
    fixed = (F.col("presentation") < threshold) & (F.coalesce("within", F.lit(1.0)) < threshold) & (F.col("share") < SHARE) & ~F.col("heads") & ~F.col("inside")
    low = low | fixed
    body = F.col("outside") & (F.col("importance") >= 1 - threshold) & ~low
    return cut(tree.filter(low | body).select("host", "path", body.alias("body")))


def _collected() -> list[Column]:
    return [F.collect_set(F.when(~F.col("body"), F.col("path"))).alias("noise"), F.collect_set(F.when(F.col("body"), F.col("path"))).alias("body")]


def _texts(pages: DataFrame, landmarks: bool) -> DataFrame:
    """``row, html, noise, body`` -> ``row, text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            said = zip(*(b.column(c).to_pylist() for c in ("html", "noise", "body")), strict=True)
            got = [Page(h, landmarks).main_text(frozenset(n or ()), frozenset(k or ())) for h, n, k in said]
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(got, pa.string())], ["row", "text"])

    x = bounded_batches(pages).select("row", "html", "noise", "body")
    return x.mapInArrow(lean(run), f"row {x.schema['row'].dataType.simpleString()}, text string")


def extract(pages: DataFrame, id_col="page_id", url_col="url", html_col="html", threshold=THRESHOLD, min_pages=MIN_PAGES, most=BROADCAST_BYTES, landmarks: bool = True) -> DataFrame:
    """``page_id, url, text, n_chars`` for every page, from its whole HTML.

    Null or empty HTML gives an empty text; a null URL and such without a host share
    the empty host's tree; repeated rows stay repeated; an empty table gives no rows;
    other columns are not read.  Verdicts reach the pages by host: by a broadcast while
    their counted bytes are few (``most``), else by a join in which a host's pages are
    dealt to ``SALTS`` tasks each.  ``landmarks`` false leaves the decision to the tree alone.
    """
    p = pages.select(F.struct(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")).alias("row"), host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
    found = verdicts(p, threshold, min_pages, landmarks)
    size = found.select(F.sum(F.octet_length("host") + 8)).first()[0] or 0
    by_host = found.groupBy("host").agg(*_collected())
    if size <= most:
        x = p.join(F.broadcast(by_host), "host", "left")
    else:
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
        x = p.withColumn("salt", F.pmod(F.xxhash64("row", "html"), F.lit(SALTS)).cast("int")).join(by_host.select("*", salts), ["host", "salt"], "left")
    return _texts(x, landmarks).select("row.page_id", "row.url", "text", F.length("text").cast("long").alias("n_chars"))
