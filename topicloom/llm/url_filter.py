"""URL filtering: suffix rules, then a blocked Bloom filter before an exact join.

The list of canonical URLs is hashed into a table of 512-bit blocks (eight 64-bit
words); each URL sets one bit in each word of one block, so a probe reads one block.
Pages whose bits are all set are possible hits; a hash join on the canonical URL
itself then removes the false positives.  All of it is DataFrame functions.

The list is a table of its own, with a column ``key``; ``published_list`` makes one by
rule, from parameters alone, to stand in for such a table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.llm.common import ascii_lower, cut

#: (verdict, host, path); the longest rule that fits decides.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: What the list names: on each of these sites, in each of these sections, pages with these numbers.
LISTED_SITES = tuple(f"{label}.example.{top}" for label in ("casino-win", "cheap-pills", "spam-farm", "adult-x", "phish-login") for top in ("com", "net", "org"))
LISTED_SECTIONS = ("de", "en", "es", "fr")
LISTED_PAGES = 600
WORDS, KEYS_PER_BLOCK, SALTS = 8, 32, 16
#: Bytes of a filter, and of a list's keys, that are broadcast at most.
BROADCAST_BYTES = 64 << 20
ROW_BYTES = 160


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))
    return F.coalesce(ascii_lower(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))
    return F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without ``www.`` or ``m.``, path without ``.html`` and slashes at its end, query without ``utm_`` and ``ref`` fields.

    Scheme and fragment go.  Null where there is no ``://``.
    """
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda f: (f != "") & ~f.startswith("utm_") & ~f.startswith("ref=")), "&")
    shown = F.concat(
        F.regexp_replace(host_of(url), r"^(www|m)\.", ""),
        F.regexp_replace(path_of(url), r"(\.html)?/*\z", ""),
        F.when(kept == "", F.lit("")).otherwise(F.concat(F.lit("?"), kept)),
    )
    return F.when(F.instr(url, "://") > 0, shown)


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _place(key: Column, blocks: int) -> list[Column]:
    first = F.xxhash64(F.lit("block"), key)
    second = F.xxhash64(F.lit("bits"), key)
    bits = [F.pmod(F.shiftrightunsigned(second, 6 * i), F.lit(64)).cast("int") for i in range(WORDS)]
    return [F.pmod(first, F.lit(blocks)).alias("block"), *[F.call_function("shiftleft", F.lit(1).cast("long"), b).alias(f"w{i}") for i, b in enumerate(bits)]]


def build_filter(keys: DataFrame, n_keys: int) -> tuple[DataFrame, int]:
    """Distinct keys (column ``key``) -> rows (block, w0..w7) and the number of blocks."""
    blocks = max(1, -(-n_keys // KEYS_PER_BLOCK))
    bits = keys.select(*_place(F.col("key"), blocks))
    return bits.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)]), blocks


def judge(pages: DataFrame, listed: DataFrame, id_col="page_id", url_col="url", rules=RULES, most: int = BROADCAST_BYTES) -> DataFrame:
    """``page_id, url, host, path, rule, verdict, possible, listed`` for every page.

    ``listed`` has a column ``key`` of canonical URLs (repeats and nulls allowed).
    A rule decides where one fits; else listed pages are blocked, others allowed.
    Null URLs and such without ``://`` have empty host and path and are allowed;
    repeated pages stay repeated; an empty list blocks nothing.  Other columns are
    not read.

    The filter is broadcast while it is counted to take ``most`` bytes at most; beyond,
    pages go to its blocks in a shuffle without their URLs' lists.  Either way rows are
    salted, so that one very common URL stays spread, and pages without a key wait
    for no match in places of their own.
    """
    keys = cut(listed.select("key").filter(F.col("key").isNotNull()).distinct())
    n_keys = keys.count()
    blocks, n_blocks = build_filter(keys, n_keys)
    p = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    p = p.withColumn("host", host).withColumn("path", path).withColumn("key", canonical(F.col("url")))
    p = p.withColumn("r", rule_for(F.col("host"), F.col("path"), rules))
    spread = F.xxhash64("page_id", "url")
    p = p.withColumn("salt", F.pmod(spread, F.lit(SALTS)).cast("int"))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    place = _place(F.coalesce("key", F.lit("")), n_blocks)
    probe = p.withColumns({c: col for c, col in zip(["block"] + [f"p{i}" for i in range(WORDS)], place, strict=True)})
    probe = probe.withColumn("block", F.when(F.col("key").isNotNull(), F.col("block")).otherwise(-1 - F.pmod(spread, F.lit(1 << 40))))
    hit = F.lit(True)
    for i in range(WORDS):
        hit = hit & (F.col(f"w{i}").bitwiseAND(F.col(f"p{i}")) != 0)
    hit = F.coalesce(hit & F.col("key").isNotNull(), F.lit(False))
    table, on = (F.broadcast(blocks), ["block"]) if n_blocks * ROW_BYTES <= most else (blocks.select("*", salts), ["block", "salt"])
    x = probe.join(table, on, "left").select("page_id", "url", "host", "path", "key", "r", "salt", hit.alias("possible"))
    # Only possible hits are asked for in the list; the others carry a key that no URL has.
    nowhere = F.concat(F.lit("\0"), F.pmod(spread, F.lit(1 << 40)).cast("string"))
    x = x.withColumn("key", F.when(F.col("possible"), F.col("key")).otherwise(nowhere))
    known = keys.select("key", F.lit(True).alias("found"))
    table, on = (F.broadcast(known), ["key"]) if n_keys * ROW_BYTES <= most else (known.select("*", salts), ["key", "salt"])
    x = x.join(table, on, "left")
    found = F.coalesce("found", F.lit(False))
    verdict = F.coalesce("r.verdict", F.when(found, "block").otherwise("allow"))
    return x.select("page_id", "url", "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"), "possible", found.alias("listed"))


def published_list(spark: SparkSession, sites=LISTED_SITES, sections=LISTED_SECTIONS, pages: int = LISTED_PAGES) -> DataFrame:
    """Canonical URLs of a list: ``site/section/number`` and their second pages."""
    each = lambda name, values: F.explode(F.array(*[F.lit(v) for v in values])).alias(name)
    x = spark.range(pages).select("id", each("site", sites)).select("*", each("section", sections)).select("*", each("query", ("", "?page=2")))
    return x.select(F.concat("site", F.lit("/"), "section", F.lit("/"), F.col("id").cast("string"), "query").alias("key"))
