"""Re-anchoring of quotes in a changed text, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from annalist.functions.text import context, let, occurrences, text_digest


def reanchored(old: Column, start: Column, end: Column, new: Column) -> Column:
    """struct(outcome, new_start, candidates) of the quote ``old[start:end]`` in ``new``.

    exact: the same text, or the quote still at its place. Else by the quote's places in the new text: missing (none),
    unique_move (one; or of several the only one whose context of 64 code points on either side is the old one), else
    ambiguous. A null text: missing. The texts must be NFC.
    """
    quote = F.substring(old, start + 1, end - start)
    size = end - start
    exact = (old == new) | ((F.substring(new, start + 1, size) == quote) & (end <= F.length(new)))
    none = F.lit(None).cast("long")

    def told(places: Column) -> Column:
        """The outcome, given the places: contexts are compared only where there are several."""
        mine = text_digest(context(old, start, end))
        alike = F.filter(places, lambda p: text_digest(context(new, p, p + size)) == mine)
        some = lambda outcome, at: F.struct(F.lit(outcome).alias("outcome"), at.cast("long").alias("new_start"), places.alias("candidates"))
        several = F.transform(F.array(alike), lambda a: F.when(F.size(a) == 1, some("unique_move", a[0])).otherwise(some("ambiguous", none)))[0]
        return F.when(exact, some("exact", start)).when(F.size(places) == 0, some("missing", none)).when(F.size(places) == 1, some("unique_move", places[0])).otherwise(several)

    lost = F.struct(F.lit("missing").alias("outcome"), none.alias("new_start"), F.array().cast("array<int>").alias("candidates"))
    return F.when(old.isNull() | new.isNull(), lost).otherwise(let(occurrences(new, quote), told))
