"""A keyed permutation of 0 .. n-1 that is computed, not stored.

A number is split into a digit below a and a digit below b, with a * b just above n, and each round adds to one digit a
function of the other, so the rounds can be undone. What falls on n or above is permuted again until it falls below n
(cycle walking). All products stay below 2**62, so Python, numpy and Spark's long columns give the same numbers.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..spark import fresh

PRIME = (1 << 31) - 1
ROUNDS = 6


def constants(seed: int) -> list[tuple[int, int, int]]:
    """Multiplier, first and second addend of each round."""
    state, out = seed & ((1 << 64) - 1), []
    for _ in range(3 * ROUNDS):
        state = (state + 0x9E3779B97F4A7C15) & ((1 << 64) - 1)
        z = (state ^ (state >> 30)) * 0xBF58476D1CE4E5B9 & ((1 << 64) - 1)
        z = (z ^ (z >> 27)) * 0x94D049BB133111EB & ((1 << 64) - 1)
        out.append((z ^ (z >> 31)) % (PRIME - 1) + 1)
    return [tuple(out[i : i + 3]) for i in range(0, len(out), 3)]


def sides(n: int) -> tuple[int, int]:
    a = max(1, math.isqrt(max(n, 1) - 1) + 1)
    return a, max(1, -(-n // a))


@dataclass(frozen=True)
class Permutation:
    n: int
    seed: int = 1

    def _once(self, x: int) -> int:
        a, b = sides(self.n)
        left, right = divmod(x, b)
        for i, (m, c, d) in enumerate(constants(self.seed)):
            t = ((right if i % 2 == 0 else left) * m + c) % PRIME
            t = (t * t + d) % PRIME
            if i % 2 == 0:
                left = (left + t) % a
            else:
                right = (right + t) % b
        return left * b + right

    def _back(self, y: int) -> int:
        a, b = sides(self.n)
        left, right = divmod(y, b)
        for i, (m, c, d) in reversed(list(enumerate(constants(self.seed)))):
            t = ((right if i % 2 == 0 else left) * m + c) % PRIME
            t = (t * t + d) % PRIME
            if i % 2 == 0:
                left = (left - t) % a
            else:
                right = (right - t) % b
        return left * b + right

    def __call__(self, x: int) -> int:
        y = self._once(x)
        while y >= self.n:
            y = self._once(y)
        return y

    def inverse(self, y: int) -> int:
        x = self._back(y)
        while x >= self.n:
            x = self._back(x)
        return x

    def walks(self) -> int:
        """How often a number has to be permuted again at most: the longest path above n (fewer than sqrt(n) + 1 start there)."""
        if self.n < 1:
            return 0
        a, b = sides(self.n)
        longest = 0
        for x in range(self.n, a * b):
            steps, y = 1, self._once(x)
            while y >= self.n:
                steps, y = steps + 1, self._once(y)
            longest = max(longest, steps)
        return longest

    def column(self, df: DataFrame, number: str, out: str) -> DataFrame:
        """df with the permuted number, by arithmetic on long columns."""
        a, b = sides(self.n)

        left, right, t, after = (fresh(df, x) for x in ("left", "right", "t", "after"))

        def once(df: DataFrame) -> DataFrame:
            df = df.withColumn(left, F.expr(f"`{out}` div {b}L")).withColumn(right, F.col(out) % F.lit(b))
            for i, (m, c, d) in enumerate(constants(self.seed)):
                source, target, modulus = (right, left, a) if i % 2 == 0 else (left, right, b)
                df = df.withColumn(t, (F.col(source) * F.lit(m) + F.lit(c)) % F.lit(PRIME))
                df = df.withColumn(t, (F.col(t) * F.col(t) + F.lit(d)) % F.lit(PRIME))
                df = df.withColumn(target, (F.col(target) + F.col(t)) % F.lit(modulus))
            return df.withColumn(after, F.col(left) * F.lit(b) + F.col(right))

        df = df.withColumn(out, F.col(number).cast("long"))
        df = once(df).withColumn(out, F.col(after))
        for _ in range(self.walks()):
            df = once(df).withColumn(out, F.when(F.col(out) < self.n, F.col(out)).otherwise(F.col(after)))
        return df.drop(left, right, t, after)


def permute(x: np.ndarray, n: np.ndarray, seed: np.ndarray, back: bool = False) -> np.ndarray:
    """x permuted within 0 .. n-1, with an n and a seed of its own for each number; back undoes it."""
    a = np.maximum(1, np.ceil(np.sqrt(n)).astype(np.int64))
    b = np.maximum(1, -(-n // a))
    kinds, which = np.unique(seed, return_inverse=True)
    table = np.array([constants(int(k)) for k in kinds], np.int64).reshape(-1, ROUNDS, 3)
    out = x.astype(np.int64).copy()
    todo, sign = np.arange(len(out)), -1 if back else 1
    while len(todo):
        aa, bb, y, own = a[todo], b[todo], out[todo], which[todo]
        left, right = y // bb, y % bb
        for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
            m, c, d = table[own, i].T
            t = ((right if i % 2 == 0 else left) * m + c) % PRIME
            t = (t * t + d) % PRIME
            if i % 2 == 0:
                left = (left + sign * t) % aa
            else:
                right = (right + sign * t) % bb
        out[todo] = left * bb + right
        todo = todo[out[todo] >= n[todo]]
    return out
