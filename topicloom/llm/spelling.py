"""Spelling variants: words one edit apart, found by bands of letter-parity masks.

A word's mask has one bit for each letter: whether it occurs an odd number of times.  An
inserted or deleted letter flips one bit, a replaced one two, so of three bands that
share the mask's bits at least one is equal in two near words.  Words are joined on an
equal band; a pair must then differ by as many bits as its lengths ask for (one if they
differ by one, two if they are equal), and edit distance has the last word.

Bands of letters alone leave a few in a thousand of all pairs.  As one edit lies either
behind the first ``END`` letters or before the last ``END``, the join's key holds these
letters of one end, too; a pair is taken at the first end and band that it shares, once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.llm.common import ascii_lower, cut, forget

RUN = r"[A-Za-zÀ-ÿ]+"
#: One run in so many loses a letter.
DAMAGE = 199
LEAST_LETTERS, LEAST_COUNT = 6, 5
#: A form is so many times as frequent as its variant at least.
RATIO = 5
BANDS, END = 3, 3
#: Words for which a key's rows stay in one task; with more they are dealt to more.
SALT_WORDS = 2_000_000
MAX_ROUNDS = 64
# The letters of the runs, those without accents by falling frequency, so that bands share the frequent ones.
LETTERS = "etaonirslhdcumpgfybwvkxjzq" + "".join(map(chr, range(0xC0, 0x100)))


def damaged(doc_id: Column, run: Column) -> Column:
    """The run, without one letter where the checksum of ``<doc_id>:<run>`` says so; a null id counts as empty."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % DAMAGE == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def count_words(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT) -> DataFrame:
    """``word, n`` of all runs of letters, lower-cased from A to Z, with enough letters and occurrences."""
    runs = F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(RUN), F.lit(0))
    x = docs.select("doc_id", F.explode(runs).alias("run")).filter(F.length("run") >= least_letters)
    x = x.select(damaged(F.col("doc_id"), F.col("run")).alias("word")).filter(F.length("word") >= least_letters)
    return x.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


def masks(word: Column) -> list[Column]:
    """Parities of the word's letters, in ``BANDS`` bands of 30 bits."""
    codes = F.transform(F.split(word, ""), F.ascii)

    def parities(band: int) -> Column:
        bits = [0] * 256
        for i, c in enumerate(LETTERS):
            if i % BANDS == band:
                bits[ord(c)] = 1 << i // BANDS
        return F.aggregate(codes, F.lit(0), lambda a, c: a.bitwiseXOR(F.coalesce(F.get(F.array(*map(F.lit, bits)), c), F.lit(0))))

    return [parities(band) for band in range(BANDS)]


def near_words(words: DataFrame, salts: int = 1) -> DataFrame:
    """``a, na, b, nb``: every pair of words that one edit tells apart, once, a's length at most b's.

    ``words`` holds ``word, n``, each word of at least ``2 * END`` letters.  A key's words
    on one side are dealt to ``salts`` tasks, those on the other go to all of them.
    """
    x = words.select("word", "n", F.length("word").alias("size"), *[m.alias(f"m{k}") for k, m in enumerate(masks(F.col("word")))])
    x = x.withColumns({"e0": F.substring("word", 1, END), "e1": F.substring("word", -END, END)})
    key = F.explode(F.array(*[F.struct(F.lit(e).alias("end"), F.lit(k).alias("band"), F.xxhash64(F.lit(BANDS * e + k), f"e{e}", f"m{k}").alias("key")) for e in range(2) for k in range(BANDS)]))
    rows = x.select("word", "n", "size", "m0", "m1", "m2", key.alias("at")).select("word", "n", "size", "m0", "m1", "m2", "at.*")
    left, right = rows, rows
    if salts > 1:
        left = rows.withColumn("salt", F.pmod(F.xxhash64("word"), F.lit(salts)))
        right = rows.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    a, b = left.alias("a"), right.alias("b")
    pair = lambda c: (F.col(f"a.{c}"), F.col(f"b.{c}"))
    same = lambda c: F.equal_null(*pair(c))
    flips = sum((F.bit_count(F.col(f"a.m{k}").bitwiseXOR(F.col(f"b.m{k}"))) for k in range(1, BANDS)), F.bit_count(F.col("a.m0").bitwiseXOR(F.col("b.m0"))))
    grows = F.col("b.size") - F.col("a.size")
    length = (grows == 1) & (flips == 1) | (grows == 0) & (flips == 2) & (F.col("a.word") < F.col("b.word"))
    # The first band, then the first end, that a pair shares.
    band = (F.col("a.band") == 0) | ~same("m0") & ((F.col("a.band") == 1) | ~same("m1"))
    end = (F.col("a.end") == 0) | (F.substring("a.word", 1, END) != F.substring("b.word", 1, END))
    on = same("key") & same("salt") if salts > 1 else F.col("a.key") == F.col("b.key")
    exact = F.levenshtein(*pair("word"), 1) == 1
    met = a.join(b, on & (F.col("a.end") == F.col("b.end")) & (F.col("a.band") == F.col("b.band")) & length & band & end & exact)
    return met.select(F.col("a.word").alias("a"), F.col("a.n").alias("na"), F.col("b.word").alias("b"), F.col("b.n").alias("nb"))


def roots(links: DataFrame) -> DataFrame:
    """``word, form`` -> ``word, root``: the last form that following them reaches, in rounds that double the steps.

    A form is more frequent than its variant by ``RATIO``, so chains are short and have an end.
    """
    at = cut(links.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")))
    for _ in range(MAX_ROUNDS):
        further = at.select(F.col("word").alias("root"), F.col("root").alias("far"))
        new = cut(at.join(further, "root", "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")))
        forget(at)
        at = new
        if at.filter("moved").isEmpty():
            return at.select("word", "root")
    raise RuntimeError("forms did not come to an end")


def group_variants(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, ratio: int = RATIO, salt_words: int = SALT_WORDS) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of ``doc_id, text``.

    A word's form is its near word of largest n, the smallest of several, if that n is
    at least ``ratio`` times the word's.  Null and empty texts have no words; repeated rows
    count again; a null id damages runs as an empty one; other columns are not read; an
    empty table gives no rows.
    """
    if least_letters < 2 * END:
        raise ValueError(f"words need {2 * END} letters for their ends to be told apart")
    words = cut(count_words(docs, least_letters, least_count))
    found = near_words(words, 1 + words.count() // salt_words)
    both = found.select(F.explode(F.array(*[F.struct(F.col(w).alias("word"), F.col(o).alias("near"), F.col(f"n{o}").alias("n")) for w, o in ("ab", "ba")])).alias("p")).select("p.*")
    per = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("less"), "near")).alias("top"))
    x = words.join(per, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "top.near", (-F.col("top.less")).alias("near_n"))
    takes = F.col("near_n") >= ratio * F.col("n")
    x = cut(x.select("word", "n", "n_near", F.when(takes, F.col("near")).alias("form"), F.when(takes, F.col("near_n")).alias("form_n")))
    forget(words)
    out = x.join(roots(x.filter("form IS NOT NULL")), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
