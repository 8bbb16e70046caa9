"""Rolling percentile ranks of long series, without an array for each row.

Sorted rows stream by; only the last values of the key at hand are held. A batch's values are compared with those before
them in blocks, a whole block in one step, so the time of a row is that of comparing one window of doubles.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

#: Values that are compared at a time.
_BLOCK = 1 << 20


def shares(values: np.ndarray, window: int) -> np.ndarray:
    """Of each value from the ``window``-th on, which share of the last ``window`` values is at or below it."""
    if len(values) < window:
        return np.zeros(0)
    views, own = np.lib.stride_tricks.sliding_window_view(values, window), values[window - 1 :]
    step = max(1, _BLOCK // window)
    return np.concatenate([(views[k : k + step] <= own[k : k + step, None]).sum(1) for k in range(0, len(own), step)]) / window


class _Series:
    """The end of one key's series: its last values, and the last row's share."""

    def __init__(self, window: int):
        self.window, self.tail, self.last = window, np.zeros(0), np.nan

    def extend(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shares of these rows and of the rows before them; nan where there is none, as of rows whose value is nan."""
        known = ~np.isnan(values)
        series = np.concatenate([self.tail, values[known]])
        found = shares(series, self.window)
        own = np.full(known.sum(), np.nan)
        if len(found):
            own[len(own) - len(found) :] = found
        self.tail = series[max(0, len(series) - self.window + 1) :]
        out = np.full(len(values), np.nan)
        out[known] = own
        before = np.concatenate([[self.last], out[:-1]])
        self.last = out[-1] if len(out) else self.last
        return out, before


def with_trailing_share(df: DataFrame, value: str, window: int, name: str, key: str = "ticker", order: str = "i") -> DataFrame:
    """``df`` with ``name``, the share of the key's last ``window`` values that are at or below the row's own, and
    ``name``_before, that of the row before it. Null and nan values are no values; null until there are ``window``.

    Rows are dealt by key as for any window, and stay so dealt; a key's rows need not fit in memory.
    """
    by = Window.partitionBy(key).orderBy(order)
    ready = df.withColumn("_nth", F.row_number().over(by)).sortWithinPartitions(key, order)
    kept = df.columns
    columns = [*kept, name, f"{name}_before"]
    kinds = {**dict(df.dtypes), name: "double", f"{name}_before": "double"}

    def run(batches):
        series = _Series(window)
        for batch in batches:
            at = {c: i for i, c in enumerate(batch.schema.names)}
            values = batch.column(at[value]).cast(pa.float64()).to_numpy(zero_copy_only=False)
            firsts = np.flatnonzero(batch.column(at["_nth"]).to_numpy() == 1)
            found = []
            for a, b in zip(np.r_[0, firsts], np.r_[firsts, len(values)], strict=True):
                if a in firsts:
                    series = _Series(window)
                if b > a:
                    found.append(series.extend(values[a:b]))
            out = [pa.array(np.concatenate(x) if x else np.zeros(0), pa.float64(), from_pandas=True) for x in ([f[0] for f in found], [f[1] for f in found])]
            yield pa.RecordBatch.from_arrays([*(batch.column(at[c]) for c in kept), *out], columns)

    return ready.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in columns))
