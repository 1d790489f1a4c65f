"""Keyed permutations of row numbers: an epoch's order without a sort.

A number below n is a pair (left, right) of digits to the bases a, about the root of n, and b. Each round
adds to one digit a hash of the other, modulo its base, which can be undone; what falls beyond n, fewer
than a numbers, is permuted again until it falls below.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.stats import hash32

ROUNDS = 4


def bases(n: int) -> tuple[int, int]:
    a = math.isqrt(max(n - 1, 0)) + 1
    return a, max(1, -(-n // a))


def _mixed(x: Column, seed: str, k: int) -> Column:
    return hash32(F.concat(x.cast("string"), F.lit(f"/{seed}/{k}")))


def _once(x: Column, a: int, b: int, seed: str, back: bool) -> Column:
    """One pass over all rounds: left is x // b, right is x % b. As an array, so that each round's
    digits are made once."""
    def turn(k: int):
        def added(pair: Column) -> Column:
            left, right = F.get(pair, F.lit(0)), F.get(pair, F.lit(1))
            own, other, base = (left, right, a) if k % 2 == 0 else (right, left, b)
            moved = F.pmod(own - _mixed(other, seed, k) if back else own + _mixed(other, seed, k), F.lit(base))
            return F.array(moved, right) if k % 2 == 0 else F.array(left, moved)

        return added

    held = F.array(F.array(F.floor(x / b), F.pmod(x, F.lit(b))))
    for k in range(ROUNDS)[:: -1 if back else 1]:
        held = F.transform(held, turn(k))
    return F.get(F.transform(held, lambda p: F.get(p, F.lit(0)) * b + F.get(p, F.lit(1))), F.lit(0))


def permuted(x: Column, n: int, seed: str, back: bool = False) -> Column:
    """The place of x among 0..n-1 in the order that ``seed`` names; with ``back`` the number at place
    x. A bijection for every n. Null stays null."""
    a, b = bases(n)
    walks = F.array(*map(F.lit, range(min(a, 64))))  # fewer than a numbers lie beyond n, and 64 passes meet only them with a chance of a / n each
    walked = F.aggregate(walks, _once(x.cast("long"), a, b, seed, back), lambda v, _: F.when(v < n, v).otherwise(_once(v, a, b, seed, back)))
    return F.when(walked < n, walked).when(x.isNotNull(), F.raise_error(F.lit("a permutation did not end")).cast("long"))


def epoch_batches(numbered: DataFrame, n: int, epochs: int, size: int = 32, number: str = "rn") -> DataFrame:
    """R2: rows numbered from 1 to n, for each epoch with their place in its order and their batch."""
    d = numbered.withColumn("epoch", F.lit(1)) if epochs == 1 else numbered.withColumn("epoch", F.explode(F.array(*map(F.lit, range(1, epochs + 1)))))
    place = F.lit(None).cast("long")
    for e in range(epochs, 0, -1):
        place = F.when(F.col("epoch") == e, permuted(F.col(number) - 1, n, f"epoch-{e}")).otherwise(place)
    return d.withColumn("place", place).withColumn("batch", F.floor(F.col("place") / size))


def batch_numbers(spark, n: int, epoch: int, batch: int, size: int = 32) -> DataFrame:
    """R2: (place, rn): the row numbers of one batch of one epoch, without touching any other."""
    first = batch * size
    places = spark.range(first, min(first + size, n)).select(F.col("id").alias("place"))
    return places.withColumn("rn", permuted(F.col("place"), n, f"epoch-{epoch}", back=True) + 1)
