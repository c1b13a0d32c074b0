"""Counter-based uniforms: the same numbers from Spark columns, numpy and SQL, for any partitioning or retry.

h0 = (sum of keys times fixed odd factors) mod P, then three rounds h = (h * ((h + B) mod P) + C) mod P; all products
stay below 2**62, so 64-bit integers suffice everywhere. u = (h + 0.5) / P lies strictly between 0 and 1.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

P = 2147483647
FACTORS = (1000003, 7919, 104729, 15485863)
ROUNDS = ((48271, 11), (69621, 2017), (16807, 40503))


def uniform(*keys: Column | int) -> Column:
    """A Spark column in (0, 1) from up to four integer keys."""
    h = None
    for k, f in zip(keys, FACTORS, strict=False):
        c = F.pmod((k if isinstance(k, Column) else F.lit(k)).cast("long"), F.lit(P)) * F.lit(f)
        h = c if h is None else h + c
    h = F.pmod(h, F.lit(P))
    for b, c in ROUNDS:
        # bound once by a lambda variable, so that a round reads its input instead of computing it twice
        h = F.transform(F.array(h), _round(b, c))[0]
    return (h + F.lit(0.5)) / F.lit(float(P))


def _round(b: int, c: int):
    return lambda x: F.pmod(x * F.pmod(x + F.lit(b), F.lit(P)) + F.lit(c), F.lit(P))


def uniform_np(*keys) -> np.ndarray:
    h = np.zeros(np.broadcast(*[np.asarray(k) for k in keys]).shape, np.int64)
    for k, f in zip(keys, FACTORS, strict=False):
        h = h + np.mod(np.asarray(k, np.int64), P) * f
    h = h % P
    for b, c in ROUNDS:
        h = (h * ((h + b) % P) + c) % P
    return (h + 0.5) / P


def uniform_sql(*keys: str) -> str:
    """The same in ANSI SQL; keys are expressions of non-negative integers."""
    h = "(" + " + ".join(f"(({k}) % {P}) * {f}" for k, f in zip(keys, FACTORS, strict=False)) + f") % {P}"
    for b, c in ROUNDS:
        h = f"(({h}) * ((({h}) + {b}) % {P}) + {c}) % {P}"
    return f"((({h}) + 0.5::DOUBLE) / {float(P)}::DOUBLE)"
