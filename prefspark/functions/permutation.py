"""A seeded order of the numbers 0 to n - 1 as a column expression: no sort, no shuffle.

A number below a * b (with n <= a * b < n + a and a about the root of n) is a pair of digits.
Rounds add to one digit, modulo its base, a hash of the other one: each round can be undone, so
all of them map the pairs one to one. A result of n or more is mapped again until it is below
n, which keeps the mapping of 0 to n - 1 one to one as well.
"""

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

ROUNDS = 6
# Results that are mapped again. At most a - 1 of a * b numbers are out of range, so with more
# than this many of them the chance to meet as many in a row is below 1e-100.
MOST_STEPS = 64


def bases(n: int) -> tuple[int, int]:
    """The bases of the two digits of the numbers below ``n``."""
    first = math.isqrt(max(n - 1, 0)) + 1
    return first, -(-n // first)


def round_hash(seed: int, number: Column, digit: Column) -> Column:
    """The first 32 bits of ``md5('seed|round|digit')``, the same in every SQL engine."""
    text = F.concat(F.lit(f"{seed}|"), number.cast("string"), F.lit("|"), digit.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def permuted(index: Column, n: int, seed: int = 42, rounds: int = ROUNDS) -> Column:
    """Where ``index`` (0 to n - 1) comes in a seeded order of the numbers below ``n``.

    Null stays null; an index that is out of range fails the job. ``n`` is a plain number: it
    decides the bases. It may have up to 62 bits.
    """
    if not 0 <= n < 1 << 62:
        raise ValueError("n is from 0 to 2**62 - 1")
    a, b = bases(n)

    def turn(pair: Column, number: Column) -> Column:
        first = (pair["first"] + round_hash(seed, number, pair["second"])) % a
        second = (pair["second"] + round_hash(seed, number, pair["first"])) % b
        even = number % 2 == 0
        return F.struct(
            F.when(even, first).otherwise(pair["first"]).alias("first"),
            F.when(even, pair["second"]).otherwise(second).alias("second"),
        )

    def mapped(value: Column) -> Column:
        digits = F.struct(_quotient(value, b).alias("first"), (value % b).alias("second"))
        numbers = F.sequence(F.lit(0), F.lit(rounds - 1))
        return F.aggregate(numbers, digits, turn, lambda p: p["first"] * b + p["second"])

    index = index.cast("long")
    inside = (index >= 0) & (index < n)
    refuse = F.raise_error(F.concat(F.lit(f"not from 0 to {n - 1}: "), index.cast("string"))).cast("long")
    value = F.when(index.isNull(), F.lit(None).cast("long")).when(inside, mapped(index)).otherwise(refuse)
    outside = min(a * b - n, MOST_STEPS)
    if outside > 0:
        steps = F.sequence(F.lit(1), F.lit(outside))
        value = F.aggregate(steps, value, lambda v, _: F.when(v >= n, mapped(v)).otherwise(v))
    return value


def _quotient(value: Column, divisor: int) -> Column:
    """Integer division; doubles would round what has more than 53 bits."""
    return F.call_function("div", value, F.lit(divisor).cast("long"))
