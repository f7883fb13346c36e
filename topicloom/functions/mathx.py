"""Numbers as Columns: log gamma, xorshift draws, powers of two, partition functions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The six-term Lanczos series, and the unit of the generator's draws.
LANCZOS = (76.18009172947146, -86.50532032941677, 24.01409824083091, -1.231739572450155, 0.1208650973866179e-2, -0.5395239384953e-5)
LANCZOS_BASE, LANCZOS_SHIFT, ROOT_TWO_PI = 1.000000000190015, 5.5, 2.5066282746310005
UNIT = 4.6566125e-10
MASK = 0xFFFFFFFF


def log_gamma(x: Column) -> Column:
    series = F.lit(LANCZOS_BASE)
    for k, c in enumerate(LANCZOS, 1):
        series = series + F.lit(c) / (x + k)
    t = x + LANCZOS_SHIFT
    return (x + 0.5) * F.log(t) - t + F.log(F.lit(ROOT_TWO_PI) * series / x)


def log_gamma_of(x: float) -> float:
    series = LANCZOS_BASE + sum(c / (x + k) for k, c in enumerate(LANCZOS, 1))
    t = x + LANCZOS_SHIFT
    return (x + 0.5) * math.log(t) - t + math.log(ROOT_TWO_PI * series / x)


def xorshift(x: Column) -> Column:
    """One step of the 32-bit generator with shifts 13, 17 and 5, on a long."""
    x = x.bitwiseXOR(F.shiftleft(x, 13)).bitwiseAND(MASK)
    x = x.bitwiseXOR(F.shiftright(x, 17))
    return x.bitwiseXOR(F.shiftleft(x, 5)).bitwiseAND(MASK)


def token_seed(doc: Column, pos: Column, seed: int) -> Column:
    return (doc * 1000003 + pos.cast("long") * 7919 + seed).bitwiseAND(0x7FFFFFFF)


def draw_topic(doc: Column, pos: Column, topics: int, seed: int) -> Column:
    """Uniform topic of a token, a pure function of its place and the seed."""
    q = xorshift(token_seed(doc, pos, seed)).bitwiseAND(0x7FFFFFFF)
    return F.floor(q * F.lit(UNIT) * topics).cast("int")


def next_power_of_two(x: Column) -> Column:
    """Smallest power of two at or above a long (1 for less)."""
    y = F.greatest(x.cast("long"), F.lit(1).cast("long")) - 1
    for k in (1, 2, 4, 8, 16, 32):
        y = y.bitwiseOR(F.shiftright(y, k))
    return y + 1


def owner(word_id: Column, n: int) -> Column:
    """Server, shard or client of a word."""
    return F.pmod(word_id, F.lit(n)).cast("int")
