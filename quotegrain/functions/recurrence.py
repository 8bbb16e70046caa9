"""First-order linear recurrences over ordered rows, without Python: y[t] = b y[t-1] + a x[t], seeded by a mean.

Rows are cut in blocks. Inside a block the recurrence is a scaled running sum; a block as a whole takes y to b^B y + end.
Such maps are scanned over blocks, and a row adds what its block takes over. A block is so long that b^B is small, yet
the scaled sum can't overflow; then only a few blocks before a row's own say anything that a double can hold, and the
scan is a sum of a few ends. Time is linear in the rows, whatever a key's length.

``linear_recurrence`` is windows over one exchange by key: rows are read once and joined with nothing. With
``spread_recurrence`` a key's blocks are dealt to any task: ends are sums by block, the scan runs over one row per block,
and rows meet what their block takes over in a join by key and block.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

#: A scaled sum stays below e to this power times the largest input.
_SCALE = 500
#: Blocks reach no further back than to a weight of e to minus this power, which is below a double's last place.
_REACH = 40
#: Rows of a block at most, and ends that a row's block adds up at most before recurrences are split up.
_LONGEST, _ENDS = 1 << 16, 16


@dataclass(frozen=True)
class Recurrence:
    """``x`` is valid from index ``start`` on; the first value, at ``start + n - 1``, is the mean of ``n``."""

    name: str
    x: str
    n: int
    b: float
    a: float
    start: int = 0

    def __post_init__(self):
        if not 0 < self.b < 1:
            raise ValueError("b is between 0 and 1")

    @property
    def rate(self) -> float:
        return -math.log(self.b)

    @property
    def seed(self) -> int:
        return self.start + self.n - 1


def ema(name: str, x: str, n: int, start: int = 0) -> Recurrence:
    a = 2 / (n + 1)
    return Recurrence(name, x, n, 1 - a, a, start)


def wilder(name: str, x: str, n: int, start: int = 0) -> Recurrence:
    return Recurrence(name, x, n, (n - 1) / n, 1 / n, start)


def _block(specs: list[Recurrence]) -> int:
    """The longest block, a power of two, in which no scaled sum of these overflows."""
    most = _SCALE / max(s.rate for s in specs)
    return max(1, min(_LONGEST, 1 << int(math.log2(most)))) if most >= 1 else 1


def _reach(s: Recurrence, block: int) -> int:
    return math.ceil(_REACH / (block * s.rate))


def _grouped(specs: list[Recurrence]) -> list[tuple[int, list[Recurrence]]]:
    """Recurrences that can share blocks, with the block's length: fast ones first, each with those that reach back over
    few of its blocks. One that is so slow that the longest block is short for it stands alone."""
    rest, out = sorted(specs, key=lambda s: -s.rate), []
    while rest:
        block = _block(rest[:1])
        own = [s for s in rest if s is rest[0] or _reach(s, block) <= _ENDS]
        out.append((block, own))
        rest = [s for s in rest if s not in own]
    return out


def _scaled(u: Column, s: Recurrence, inside: Window) -> Column:
    """The recurrence inside a block that starts from 0."""
    step = F.col("_step")
    return F.pow(F.lit(s.b), step) * F.sum(u * F.pow(F.lit(s.b), -step)).over(inside)


def _input(s: Recurrence, seed: Column, index: str) -> Column:
    return F.when(F.col(index) == s.seed, seed).when(F.col(index) > s.seed, F.col(s.x) * s.a).otherwise(0.0)


def _decayed(s: Recurrence, end, block: int) -> Column:
    """What a block takes over: the ends of those before it, ``end(k)`` being that of the k-th before."""
    return sum((F.coalesce(end(k), F.lit(0.0)) * s.b ** (block * (k - 1)) for k in range(2, _reach(s, block) + 1)), F.coalesce(end(1), F.lit(0.0)))


def _cut(df: DataFrame, index: str, block: int) -> DataFrame:
    return df.withColumns({"_block": F.floor(F.col(index) / block), "_step": (F.col(index) % block).cast("double")})


def linear_recurrence(df: DataFrame, specs: list[Recurrence], key: str = "ticker", index: str = "i") -> DataFrame:
    """``df`` with a column for each recurrence, null before its seed. ``index`` counts a key's rows from 0."""
    for block, group in _grouped(specs):
        df = _in_one_task(df, group, block, key, index)
    return df


def _in_one_task(df: DataFrame, specs: list[Recurrence], block: int, key: str, index: str) -> DataFrame:
    ordered = Window.partitionBy(key).orderBy(index)
    so_far = ordered.rowsBetween(Window.unboundedPreceding, 0)
    inside = Window.partitionBy(key, "_block").orderBy(index).rowsBetween(Window.unboundedPreceding, 0)
    df = _cut(df, index, block)
    known = lambda s: F.when(F.col(index) >= s.start, F.col(s.x))
    df = df.withColumns({f"_u_{s.name}": _input(s, F.avg(known(s)).over(so_far), index) for s in specs})
    df = df.withColumns({f"_y_{s.name}": _scaled(F.col(f"_u_{s.name}"), s, inside) for s in specs})
    # found at a block's first row: the row k blocks back from the row before it ends a block
    first = {f"_c_{s.name}": F.when(F.col("_step") == 0, _decayed(s, lambda k, s=s: F.lag(f"_y_{s.name}", 1 + block * (k - 1)).over(ordered), block)) for s in specs}
    df = df.withColumns(first)
    return df.withColumns({
        s.name: F.when(F.col(index) >= s.seed, F.col(f"_y_{s.name}") + F.pow(F.lit(s.b), F.col("_step") + 1) * F.last(f"_c_{s.name}", ignorenulls=True).over(so_far)) for s in specs
    }).drop("_block", "_step", *(f"{p}{s.name}" for p in ("_u_", "_y_", "_c_") for s in specs))


def spread_recurrence(df: DataFrame, specs: list[Recurrence], key: str = "ticker", index: str = "i") -> DataFrame:
    """The same of keys that are too long for one task: no window, group or join is by key alone, but for one row a block."""
    for block, group in _grouped(specs):
        df = _by_blocks(df, group, block, key, index)
    return df


def _by_blocks(df: DataFrame, specs: list[Recurrence], block: int, key: str, index: str) -> DataFrame:
    columns, at = df.columns, F.col(index)
    rows = _cut(df, index, block)
    left = lambda s, step: F.pow(F.lit(s.b), F.lit(block - 1) - step)
    sums = [F.coalesce(F.sum(F.when(at > s.seed, F.col(s.x) * s.a * left(s, F.col("_step")))), F.lit(0.0)).alias(f"_e_{s.name}") for s in specs]
    # a seed's mean is of rows of one or several blocks: their sums and counts meet in the block of the seed
    parts = [f(F.when(at.between(s.start, s.seed), F.col(s.x))).alias(f"_{p}_{s.name}") for s in specs for p, f in (("s", F.sum), ("k", F.count))]
    blocks = rows.groupBy(key, "_block").agg(*sums, *parts)
    by = Window.partitionBy(key).orderBy("_block")
    so_far = by.rowsBetween(Window.unboundedPreceding, 0)
    mean = {f"_m_{s.name}": F.when(F.col("_block") == s.seed // block, F.try_divide(F.sum(f"_s_{s.name}").over(so_far), F.sum(f"_k_{s.name}").over(so_far))) for s in specs}
    blocks = blocks.withColumns(mean)
    blocks = blocks.withColumns({f"_e_{s.name}": F.col(f"_e_{s.name}") + F.coalesce(F.col(f"_m_{s.name}") * s.b ** (block - 1 - s.seed % block), F.lit(0.0)) for s in specs})
    carry = [_decayed(s, lambda k, s=s: F.lag(f"_e_{s.name}", k).over(by), block).alias(f"_c_{s.name}") for s in specs]
    met = rows.join(blocks.select(key, "_block", *mean, *carry), [key, "_block"])
    inside = Window.partitionBy(key, "_block").orderBy(index).rowsBetween(Window.unboundedPreceding, 0)
    out = met.withColumns({f"_y_{s.name}": _scaled(_input(s, F.col(f"_m_{s.name}"), index), s, inside) for s in specs})
    value = {s.name: F.when(at >= s.seed, F.col(f"_y_{s.name}") + F.pow(F.lit(s.b), F.col("_step") + 1) * F.col(f"_c_{s.name}")) for s in specs}
    return out.withColumns(value).select(*columns, *value)
