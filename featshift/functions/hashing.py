"""Seeded hashes of row keys: the only source of randomness in the package.

A row's draw depends on the seed and on its key alone, so results survive
re-partitioning, task retries and a lost executor.
"""

from __future__ import annotations

import hashlib
import math
from pyspark.sql import Column
from pyspark.sql import functions as F

_TWO_32 = 4294967296.0


def _as_column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def seeded_hash(seed: int | str, *key: str | Column) -> Column:
    """md5 hex text of ``seed:key1:key2:...``."""
    parts = [_as_column(c).cast("string") for c in key]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *parts))


def seeded_uniform(seed: int | str, *key: str | Column) -> Column:
    """Uniform draw in [0, 1) from the first 32 bits of the seeded hash."""
    head = F.substring(seeded_hash(seed, *key), 1, 8)
    return F.conv(head, 16, 10).cast("double") / F.lit(_TWO_32)


def seeded_normal(seed: int | str, *key: str | Column) -> Column:
    """Standard normal draw: Box-Muller over two seeded uniforms."""
    radius = F.sqrt(-2.0 * F.log(1.0 - seeded_uniform(f"{seed}:radius", *key)))
    return radius * F.cos(2.0 * math.pi * seeded_uniform(f"{seed}:angle", *key))


def driver_uniform(seed: int | str, *key: object) -> float:
    """The same draw as :func:`seeded_uniform`, for parameters made on the driver."""
    text = ":".join([str(seed), *map(str, key)])
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16) / _TWO_32


def driver_normal(seed: int | str, *key: object) -> float:
    radius = math.sqrt(-2.0 * math.log(1.0 - driver_uniform(f"{seed}:radius", *key)))
    return radius * math.cos(2.0 * math.pi * driver_uniform(f"{seed}:angle", *key))


def unit_directions(seed: int | str, n: int, dim: int) -> list[list[float]]:
    """``n`` seeded unit vectors of length ``dim``."""
    out = []
    for j in range(n):
        raw = [driver_normal(seed, j, d) for d in range(dim)]
        norm = math.sqrt(sum(v * v for v in raw))
        out.append([v / norm for v in raw])
    return out
