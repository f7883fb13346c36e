"""Tokenising as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATORS = r"[\s\p{Punct}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Default stop words; any other list can be given.
STOP_WORDS = tuple(
    "a about after all also an and any are as at be because been before but by can could did do does down each even for from had has have he her "
    "here him his how i if in into is it its just like made make many may me more most much must my no not now of on one only or other our out over "
    "said same she should since so some such than that the their them then there these they this those through to too under up upon very was we "
    "well were what when where which while who will with would you your".split()
)


def ascii_lower(c: Column) -> Column:
    """Lower case of A to Z alone, as C's default locale has it."""
    return F.translate(c, UPPER, LOWER)


def tokens(c: Column) -> Column:
    """Words of a text: white space and ASCII punctuation separate, empty tokens drop."""
    return F.filter(F.split(ascii_lower(F.coalesce(c, F.lit(""))), SEPARATORS), lambda t: t != "")
