"""The unbiased pass@k estimate."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def pass_at_k(n: Column, c: Column, k: Column) -> Column:
    """1 - C(n-c, k) / C(n, k), as a product of k factors.

    The k-factor form needs no array as long as the number of generations, so a
    task with billions of them costs the same as any other.
    """
    wrong = (n - c).cast("double")
    total = n.cast("double")
    missed = F.aggregate(
        F.sequence(F.lit(0).cast("long"), k.cast("long") - 1),
        F.lit(1.0),
        lambda product, j: product * ((wrong - j) / (total - j)),
    )
    return F.when(n - c < k, F.lit(1.0)).otherwise(1.0 - missed)
