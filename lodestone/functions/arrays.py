"""Array functions: common prefixes, masks, padding, shifting, splicing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The lengths that evaluation batches are padded to.
BUCKETS = (128, 256, 512, 1024, 2048, 4096)
IGNORE = -1


def common_length(sequences: Column, from_right: bool = False) -> Column:
    """Length of the common prefix, or suffix, of an array of arrays."""

    def of(rows: Column) -> Column:
        whole = lambda r: F.coalesce(r, F.array())
        least = F.array_min(F.transform(rows, F.size))
        # a shorter one ends in nulls here, which the least size makes good
        differ = F.transform(rows, lambda r: F.array_position(F.zip_with(whole(rows[0]), whole(r), lambda x, y: x.eqNullSafe(y)), F.lit(False)))
        first = (F.array_min(F.filter(differ, lambda i: i > 0)) - 1).cast("int")
        return F.when(F.size(rows) > 0, F.when(least.isNotNull(), F.least(first, least)))

    # the variable of a lambda function is a value; the sequences themselves would be made anew for each element
    return F.get(F.transform(F.array(F.transform(sequences, F.reverse) if from_right else sequences), of), F.lit(0))


def choice_mask(ids: Column, prefix: Column) -> Column:
    """0 over the common prefix, 1 over the rest."""
    return F.concat(F.array_repeat(F.lit(0), prefix), F.array_repeat(F.lit(1), F.size(ids) - prefix))


def suffix_mask(ids: Column, suffix: Column) -> Column:
    """1 over the common suffix, 0 before it."""
    return F.concat(F.array_repeat(F.lit(0), F.size(ids) - suffix), F.array_repeat(F.lit(1), suffix))


def continuation_mask(without: Column, whole: Column) -> Column:
    """1 over what the whole has beyond the context."""
    return choice_mask(whole, F.size(without))


def keep_head(c: Column, n: int) -> Column:
    return F.slice(c, 1, n)


def keep_tail(c: Column, n: int) -> Column:
    return F.when(F.size(c) > n, F.slice(c, -n, n)).otherwise(c)


def bucket(longest: Column) -> Column:
    """The smallest padded length that holds the longest; null beyond the largest."""
    return F.try_element_at(F.filter(F.array(*map(F.lit, BUCKETS)), lambda b: b >= longest), F.lit(1))


def pad(ids: Column, length: Column, value: int) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(value), F.greatest(length - F.size(ids), F.lit(0))))


def shift(ids: Column, mask: Column | None = None) -> Column:
    """(inputs, targets) for next-token prediction; masked targets are the ignored index."""
    n = F.greatest(F.size(ids) - 1, F.lit(0))
    targets = F.slice(ids, 2, n)
    if mask is not None:
        targets = F.zip_with(targets, F.slice(mask, 2, n), lambda t, m: F.when(m == 0, F.lit(IGNORE)).otherwise(t))
    return F.struct(F.slice(ids, 1, n).alias("inputs"), targets.alias("targets"))


def splice(c: Column, at: Column, more: Column) -> Column:
    """more inserted before the 1-based position at."""
    return F.concat(F.slice(c, F.lit(1), at - 1), more, F.slice(c, at, F.size(c)))


def chunked(c: Column, size: int) -> Column:
    """Slices of at most size elements."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(c), F.lit(1)), F.lit(size))
    return F.when(F.size(c) > 0, F.transform(starts, lambda i: F.slice(c, i, size))).otherwise(F.array())
