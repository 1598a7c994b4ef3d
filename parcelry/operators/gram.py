"""Ridge regression from one pass: sums of products for each group, solved without the rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F


def gram_statistics(rows: DataFrame, by: Sequence[str], features: str, label: str) -> DataFrame:
    """One row for each group: ``by``, n_rows, means (features, then label) and ``gram``, the centred sums of
    products of all pairs of these columns, row after row of the upper triangle.

    A map adds up what it sees of each group and sends centred sums with their means; these are merged by
    group, so what is shuffled does not depend on the number of rows. Rows without label or features are
    left out.
    """
    chosen = rows.where(F.col(label).isNotNull() & F.col(features).isNotNull()).select(*by, features, label)
    keys = ", ".join(f"`{c}` {chosen.schema[c].dataType.simpleString()}" for c in by)
    kind = f"{keys}{', ' if by else ''}n_rows long, means array<double>, gram array<double>"

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, tuple] = {}
        for frame in frames:
            groups = frame.groupby(list(by), dropna=False) if by else [((), frame)]
            for key, part in groups:
                table = np.column_stack([np.stack(part[features].to_numpy()), part[label].to_numpy(dtype=float)])
                mean = table.mean(axis=0)
                centred = table - mean
                held[key] = merged(held.get(key), (len(table), mean, centred.T @ centred))
            if len(held) > 10_000:
                yield packed(held)
                held = {}
        yield packed(held)

    def packed(held: dict[tuple, tuple]) -> pd.DataFrame:
        rows = [(*[None if k != k else k for k in key], n, mean.tolist(), upper(gram)) for key, (n, mean, gram) in held.items()]
        return pd.DataFrame(rows, columns=[*by, "n_rows", "means", "gram"])

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        total = None
        for n, mean, gram in zip(frame["n_rows"], frame["means"], frame["gram"]):
            total = merged(total, (n, np.array(mean), square(np.array(gram), len(mean))))
        head = frame[list(by)].iloc[:1].reset_index(drop=True)
        return pd.concat([head, pd.DataFrame({"n_rows": [total[0]], "means": [total[1].tolist()], "gram": [upper(total[2])]})], axis=1)

    parts = chosen.mapInPandas(add, kind)
    # Sixteen merges for a group first, so that a group that every task has seen is not one task's alone.
    lanes = parts.withColumn("_lane", F.pmod(F.spark_partition_id(), F.lit(16)))
    return lanes.groupBy(*by, "_lane").applyInPandas(merge, kind).groupBy(*by).applyInPandas(merge, kind)


def merged(one: tuple | None, other: tuple) -> tuple:
    """Count, means and centred sums of two parts together."""
    if one is None:
        return other
    n, m = one[0], other[0]
    apart = other[1] - one[1]
    return n + m, one[1] + apart * (m / (n + m)), one[2] + other[2] + np.outer(apart, apart) * (n * m / (n + m))


def upper(gram: np.ndarray) -> list[float]:
    return gram[np.triu_indices(len(gram))].tolist()


def square(values: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((width, width))
    out[np.triu_indices(width)] = values
    return np.triu(out) + np.triu(out, 1).T


def solve_ridge(statistics: DataFrame, alpha: float) -> DataFrame:
    """``statistics`` with ``weights``, ``intercept`` and ``r2`` instead of the sums.

    The penalty ``alpha`` is on the squared weights; the intercept bears none. Columns that do not vary in a group
    weigh nothing. ``r2`` is null where the label does not vary.
    """
    by = [f for f in statistics.schema if f.name not in ("n_rows", "means", "gram")]
    keys = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in by)

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            weights, intercepts, r2 = [], [], []
            for mean, gram in zip(frame["means"], frame["gram"]):
                mean, full = np.array(mean), square(np.array(gram), len(mean))
                inner, cross, total = full[:-1, :-1], full[:-1, -1], full[-1, -1]
                found = np.linalg.lstsq(inner + alpha * np.eye(len(cross)), cross, rcond=None)[0]
                weights.append(found.tolist())
                intercepts.append(float(mean[-1] - mean[:-1] @ found))
                r2.append(float(1 - (total - 2 * found @ cross + found @ inner @ found) / total) if total > 0 else None)
            yield frame.drop(columns=["means", "gram"]).assign(weights=weights, intercept=intercepts, r2=r2)

    return statistics.mapInPandas(solve, f"{keys}n_rows long, weights array<double>, intercept double, r2 double")


def predict(rows: DataFrame, fitted: DataFrame, by: Sequence[str], features: str) -> DataFrame:
    """``rows`` with the ``prediction`` of their group's ridge; null where the group has none."""
    names = {c: f"_{c}" for c in by}
    model = fitted.select(*[F.col(c).alias(n) for c, n in names.items()], "weights", "intercept")
    match = [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()]
    products = F.zip_with(F.col(features), F.col("weights"), lambda x, w: x * w)
    value = F.aggregate(products, F.col("intercept"), lambda a, p: a + p)
    return rows.join(model, match, "left").withColumn("prediction", value).drop(*names.values(), "weights", "intercept")
