"""Array arithmetic and id-keyed pseudo-random numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Largest finite double: value of a relative update away from zero.
MAX_DOUBLE = 1.7976931348623157e308


def total(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def cosine_distance(a: Column, b: Column) -> Column:
    return F.lit(1.0) - F.try_divide(dot(a, b), norm(a) * norm(b))


def _divided(a: Column, size: Column) -> Column:
    """Entries divided by ``size``, which is worked out once per array and not once per entry."""
    by = lambda n: F.transform(a, lambda x: F.coalesce(F.try_divide(x, n), F.lit(0.0)))
    return F.element_at(F.transform(F.array(size), by), 1)


def l1_scaled(a: Column) -> Column:
    """Array divided by the sum of magnitudes; all zeros stay zeros."""
    return _divided(a, total(F.transform(a, F.abs)))


def l2_scaled(a: Column) -> Column:
    """Array divided by its length; all zeros stay zeros."""
    return _divided(a, norm(a))


def hellinger_scaled(a: Column) -> Column:
    """Square roots of the L1-scaled magnitudes; euclidean on these is Hellinger times sqrt 2."""
    return F.transform(l1_scaled(a), lambda x: F.sqrt(F.abs(x)))


def hellinger(a: Column, b: Column) -> Column:
    return euclidean(hellinger_scaled(a), hellinger_scaled(b)) / F.sqrt(F.lit(2.0))


def largest_update(new: Column, old: Column, relative: bool = True) -> Column:
    """Largest elementwise change; 0/0 counts 0 and x/0 the largest double."""

    def change(x: Column, y: Column) -> Column:
        diff = F.abs(x - y)
        if not relative:
            return diff
        return (
            F.when(y != 0.0, diff / F.abs(y))
            .when(diff == 0.0, F.lit(0.0))
            .otherwise(F.lit(MAX_DOUBLE))
        )

    return F.array_max(F.zip_with(new, old, change))


def hash_uniform(*parts: Column) -> Column:
    """Number in [0, 1) that depends only on the parts, never on partitioning."""
    digest = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def hash_bin(col: Column, bins: int) -> Column:
    """Stable bin number in [0, bins) of a string."""
    digest = F.md5(col.cast("string"))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint"), F.lit(bins)).cast("int")


def random_factors(id_col: Column, k: int, seed: int) -> Column:
    """``k`` uniform start values per id."""
    return F.array(*[hash_uniform(id_col, F.lit(f), F.lit(seed)) for f in range(k)])


def padded(arr: Column, length: int, fill: Column) -> Column:
    """First ``length`` entries, filled up at the end; null counts as empty."""
    filler = F.array_repeat(fill, length)
    return F.slice(F.coalesce(F.concat(arr, filler), filler), 1, length)
