"""Mix sources to target weights by entropy balancing, in DataFrame functions only.

Sources are given shares of a token budget; each document gets an expected number
of copies (its rate) such that every source's expected tokens equal its target and
the rates stay as close as possible, in relative entropy, to a common base rate.  As no
rate may exceed ``cap``, the entropy is that of a share of ``cap``, and what is tilted
exponentially in document length is the odds of a rate, rate / (cap - rate) = exp(l x):

    rate = cap * exp(l x) / (1 + exp(l x)),   x = size / mean size of the source,

with one dual variable ``l`` per source; small rates are tilted exponentially themselves.  The dual is convex and separable by source.
Newton steps (kept inside a bracket, bisecting where a step leaves it) solve it over
the distributed histogram of (source, size); a step moves one row per source.

Rates become whole copies by systematic rounding along each source in order of size:
a source's taken tokens then differ from its target by about one long document,
however many documents it has; of ``STARTS`` starting points the nearest is taken.  All sums that decide a rounding are integers or
decimals, so reruns and retried tasks agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topicloom.llm.common import cut, small

#: A word is a run of characters that are neither space nor tab to carriage return.
WORD_AND_SPACE = r"[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+"
WHITE = " \t\n\x0b\x0c\r"
WEIGHTS = (3.0, 1.0, 2.0)
TOTAL = 1.5
CAP = 2.0
#: Parts of a source's size class at least, and rows of all sources for one more.
SUBS, ROWS_PER_SUB = 64, 1_000_000
CLASSES_PER_OCTAVE = 8
UNIT_BITS = 24
STARTS = 16
MAX_STEPS = 80


def word_count(text):
    """Number of words of a text column, 0 for null: each is shrunk to one mark, which are counted."""
    marks = F.translate(F.regexp_replace(text, WORD_AND_SPACE, "x"), WHITE, "")
    return F.coalesce(F.length(marks), F.lit(0)).cast("long")


def water_fill(sizes: DataFrame, weights=WEIGHTS, total=TOTAL, cap=CAP) -> DataFrame:
    """``skey, source_size, n`` -> the same with ``target``.

    ``skey`` is a struct (is_null, source): its order is by code point, null last.
    Weights repeat in that order.  A target stops at ``cap`` times its source's size
    and the excess is shared again by weight: target = min(cap * size, weight * t).
    With the sources sorted by cap * size / weight, t is the largest of the levels
    that result from assuming a prefix to be capped.  One row per source is windowed.
    """
    by_name = Window.orderBy("skey")
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy("fill", "skey").rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.orderBy("fill", "skey").rowsBetween(0, Window.unboundedFollowing)
    w = F.element_at(
        F.array(*[F.lit(float(x)) for x in weights]),
        (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"),
    )
    x = sizes.withColumn("weight", w).withColumn("limit", F.lit(float(cap)) * F.col("source_size"))
    x = x.withColumn("fill", F.col("limit") / F.col("weight")).withColumn(
        "budget", F.lit(float(total)) * F.sum("source_size").over(everything)
    )
    level = (F.col("budget") - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    x = x.withColumn("level", level).withColumn("level", F.max("level").over(everything))
    return x.select("skey", "source_size", "n", F.least("limit", F.col("weight") * F.col("level")).alias("target"))


def _rate(lam, x, cap):
    return F.lit(cap / 2) * (1 + F.tanh(lam * x / 2))


def _exact_sum(c):
    """Sum of doubles in fixed point, the same in any order of the rows."""
    return (F.sum(F.round(c * 1024).cast("decimal(38,0)")) / 1024).cast("double")


def solve(hist: DataFrame, targets: DataFrame, cap: float, n_sources: int) -> DataFrame:
    """Dual variables by source: ``skey, source_size, mean, target, full, lam``.

    ``full`` marks sources whose target is all that ``cap`` allows; they need no tilt.
    """
    state = targets.select(
        "skey",
        "source_size",
        "target",
        (F.col("source_size") / F.greatest("n", F.lit(1))).alias("mean"),
        (F.col("target") >= F.lit(cap * (1 - 1e-12)) * F.col("source_size")).alias("full"),
        # The exact dual of a source whose documents all have its mean size.
        (2 * F.atanh(F.least(F.coalesce(F.try_divide("target", "source_size"), F.lit(1.0)), F.lit(cap * 0.999)) * (2 / cap) - 1)).alias("lam"),
        F.lit(None).cast("double").alias("lo"),
        F.lit(None).cast("double").alias("hi"),
    )
    state = cut(state.withColumn("done", F.col("full") | (F.col("source_size") == 0)))
    keep = ["skey", "source_size", "target", "mean", "full"]
    for _ in range(MAX_STEPS):
        if state.filter(~F.col("done")).isEmpty():
            return state.select(*keep, "lam")
        x = F.col("size") / F.col("mean")
        th = F.tanh(F.col("lam") * x / 2)
        mass = F.col("n") * F.col("size")
        step = (
            hist.join(small(state.filter(~F.col("done")), n_sources), "skey")
            .groupBy("skey")
            .agg(
                _exact_sum(mass * F.lit(cap / 2) * (1 + th)).alias("tokens"),
                _exact_sum(mass * F.lit(cap / 4) * x * (1 - th * th)).alias("slope"),
            )
        )
        s = state.join(small(step, n_sources), "skey", "left")
        g = F.col("tokens") - F.col("target")
        lo = F.when(g < 0, F.col("lam")).otherwise(F.col("lo"))
        hi = F.when(g > 0, F.col("lam")).otherwise(F.col("hi"))
        s = s.withColumn("g", g).withColumn("lo", lo).withColumn("hi", hi)
        newton = F.when(F.col("slope") > 0, F.col("lam") - F.col("g") / F.col("slope"))
        inside = (F.col("lo").isNull() | (newton > F.col("lo"))) & (F.col("hi").isNull() | (newton < F.col("hi")))
        near = F.abs(newton - F.col("lam")) <= 2 + 2 * F.abs(F.col("lam"))
        outer = F.when(F.col("lo").isNull(), 2 * F.col("hi") - 1).when(F.col("hi").isNull(), 2 * F.col("lo") + 1)
        other = F.coalesce(outer, (F.col("lo") + F.col("hi")) / 2)
        there = F.coalesce(F.abs(F.col("g")) <= F.greatest(F.lit(0.5), F.lit(1e-9) * F.col("target")), F.lit(True))
        done = F.col("done") | there
        lam = F.when(done, F.col("lam")).when(F.coalesce(inside & near, F.lit(False)), newton).otherwise(other)
        state = cut(s.select(*keep, lam.alias("lam"), "lo", "hi", done.alias("done")))
    if not state.filter(~F.col("done")).isEmpty():
        raise RuntimeError(f"the dual did not settle in {MAX_STEPS} steps")
    return state.select(*keep, "lam")


def sized(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source") -> DataFrame:
    """``doc_id, source, size`` without the text, for planning alone."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))


def plan_copies(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights=WEIGHTS,
    total: float = TOTAL,
    cap: float = CAP,
    size_col: str | None = None,
) -> DataFrame:
    """Rows of ``docs`` as a struct ``row``, with size, source_size, target, rate, copies.

    Null text and texts of white space have size 0 and rate 1 (``cap`` where their
    source is taken in full), a null source is a source of its own, repeated ids are
    separate documents, an empty table gives an empty result.  Other columns stay in
    ``row``, whatever their names.  ``size_col`` names sizes that are known already.
    No document gets more than ``cap`` copies.
    """
    def keyed(row=None):
        return docs.select(
            *([row] if row is not None else []),
            F.struct(F.col(source_col).isNull().alias("none"), F.coalesce(source_col, F.lit("")).alias("name")).alias("skey"),
            (F.col(size_col) if size_col else word_count(F.col(text_col))).alias("size"),
            F.xxhash64(F.lit("mix"), F.col(id_col), F.col(source_col)).alias("h"),
        )

    # Words are counted once for all of the plan, which works on narrow rows.
    narrow = cut(keyed())
    subs = max(SUBS, -(-narrow.count() // ROWS_PER_SUB))
    dealt = lambda df: df.withColumn("sub", F.pmod("h", F.lit(subs)).cast("int"))
    fine = cut(dealt(narrow).groupBy("skey", "size", "sub").agg(F.count("*").alias("n")))
    hist = cut(fine.groupBy("skey", "size").agg(F.sum("n").alias("n")))
    sizes = hist.groupBy("skey").agg(
        F.sum(F.col("n") * F.col("size")).cast("long").alias("source_size"), F.sum("n").alias("n")
    )
    targets = cut(water_fill(sizes, weights, total, cap))
    n_sources = targets.count()
    duals = small(solve(hist.filter("size > 0"), targets, cap, n_sources), n_sources)

    def rated(df):
        r = _rate(F.col("lam"), F.when(F.col("mean") > 0, F.col("size") / F.col("mean")).otherwise(0.0), cap)
        r = F.when(F.col("full"), F.lit(float(cap))).otherwise(r)
        units = F.round(r * (1 << UNIT_BITS)).cast("long")
        octave = F.floor(F.log2(F.col("size") + 1.0) * CLASSES_PER_OCTAVE).cast("int")
        return df.join(duals, "skey").withColumns(
            {"rate": r, "units": units, "class": octave, "part": units.bitwiseAND((1 << UNIT_BITS) - 1)}
        )

    cell = ["skey", "class", "sub"]
    earlier = Window.partitionBy("skey").orderBy("class", "sub").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rated(fine)
        .groupBy(*cell)
        .agg(F.sum(F.col("n") * F.col("part")).alias("due"))
        .withColumn("start", F.coalesce(F.sum("due").over(earlier), F.lit(0)))
        .drop("due")
    )
    upto = Window.partitionBy(*cell).orderBy("size", "h", "part").rowsBetween(Window.unboundedPreceding, 0)

    def placed(df):
        x = rated(dealt(df)).withColumn("run", F.sum("part").over(upto)).join(offsets, cell)
        return x.withColumn("last", F.col("start") + F.col("run"))

    def copies_from(begin):
        last = F.col("last") + begin
        extra = F.shiftright(last, UNIT_BITS) - F.shiftright(last - F.col("part"), UNIT_BITS)
        return F.shiftright("units", UNIT_BITS) + extra

    # Of several starting points of the rounding, each source takes the one nearest its target.
    begins = [((2 * k + 1) << UNIT_BITS) // (2 * STARTS) for k in range(STARTS)]
    tried = placed(narrow).groupBy("skey").agg(
        F.first("target").alias("target"), F.array(*[F.sum(copies_from(F.lit(b)) * F.col("size")) for b in begins]).alias("taken")
    )
    off = F.transform("taken", lambda t, k: F.struct(F.abs(t - F.col("target")).alias("off"), k.alias("k")))
    best = F.element_at(F.array(*[F.lit(b) for b in begins]), F.array_min(off)["k"] + 1)
    chosen = cut(tried.select("skey", best.cast("long").alias("begin")))
    whole = keyed(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    x = placed(whole).join(small(chosen, n_sources), "skey")
    copies = copies_from(F.col("begin")).cast("int")
    return x.select("row", "size", "source_size", "target", "rate", copies.alias("copies"))


def mix(docs: DataFrame, **kw) -> DataFrame:
    """The mixed corpus: every row of ``docs`` as often as its copies say."""
    planned = plan_copies(docs, **kw)
    return planned.filter("copies > 0").select(F.explode(F.array_repeat("row", F.col("copies"))).alias("row")).select("row.*")
