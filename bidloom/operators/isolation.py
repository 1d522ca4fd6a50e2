"""Isolation-forest anomaly scores (Liu, Ting and Zhou, ICDM 2008).

Trees are grown on small samples, whose total size depends on the settings and
not on the table, one group of rows for each tree; scoring is one Arrow pass over
all rows; both cut-offs are exact quantiles of the scores.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidloom.operators.quantiles import group_quantiles
from bidloom.operators.scalars import with_scalars
from bidloom.sources.staging import stage_table

# tasks carry this module's functions themselves, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SAMPLE = 256
TREES = 100
CONTAMINATION = 0.1
HIGH_SHARE = 0.05
SEED = 42
_EULER = 0.5772156649015329

_TREE = (
    "tree int, feature array<int>, cut array<double>, left array<int>, right array<int>, depth array<double>"
)


def mean_path(n: np.ndarray | float) -> np.ndarray:
    """Expected path length of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=float)
    big = 2 * (np.log(np.maximum(n - 1, 1)) + _EULER) - 2 * (n - 1) / np.maximum(n, 1)
    return np.where(n > 2, big, np.where(n == 2, 1.0, 0.0))


def grow_tree(points: np.ndarray, rng: np.random.Generator) -> dict[str, list]:
    """Flat arrays of one tree; a leaf's depth already includes its unsplit points."""
    limit = int(np.ceil(np.log2(max(len(points), 2))))
    tree: dict[str, list] = {"feature": [], "cut": [], "left": [], "right": [], "depth": []}

    def add(rows: np.ndarray, depth: int) -> int:
        at = len(tree["feature"])
        for name, blank in (("feature", -1), ("cut", 0.0), ("left", -1), ("right", -1), ("depth", 0.0)):
            tree[name].append(blank)
        low, high = (rows.min(axis=0), rows.max(axis=0)) if len(rows) else (np.zeros(1), np.zeros(1))
        usable = np.flatnonzero(high > low)
        if depth >= limit or len(rows) <= 1 or len(usable) == 0:
            tree["depth"][at] = depth + float(mean_path(len(rows)))
            return at
        feature = int(rng.choice(usable))
        cut = float(rng.uniform(low[feature], high[feature]))
        below = rows[:, feature] <= cut
        tree["feature"][at], tree["cut"][at] = feature, cut
        tree["left"][at] = add(rows[below], depth + 1)
        tree["right"][at] = add(rows[~below], depth + 1)
        return at

    add(points, 0)
    return tree


def _path_lengths(points: np.ndarray, tree: dict[str, np.ndarray]) -> np.ndarray:
    at = np.zeros(len(points), dtype=np.int64)
    active = np.flatnonzero(tree["feature"][at] >= 0)
    while len(active):
        node = at[active]
        go_left = points[active, tree["feature"][node]] <= tree["cut"][node]
        at[active] = np.where(go_left, tree["left"][node], tree["right"][node])
        active = active[tree["feature"][at[active]] >= 0]
    return tree["depth"][at]


def fit_forest(
    df: DataFrame, key: str, features: list[str], n_trees: int = TREES, sample: int = SAMPLE, seed: int = SEED
) -> tuple[list[dict[str, np.ndarray]], int]:
    """Trees and the sample size they were grown on.

    A row's draw hashes its key, its features and a number among the rows that
    agree in all of them, so equal rows are drawn apart and no layout matters. The ``n_trees * sample`` smallest draws
    are the pool, a uniform sample whose size the arguments set; every tree then
    takes its own ``sample`` of the pool and grows in a group of its own.
    """
    values = [F.col(f).cast("double").alias(f) for f in features]
    wanted = n_trees * sample
    # counted, then numbered: rows that agree in all columns are interchangeable
    alike = df.select(F.col(key).cast("string").alias("_key"), *values).groupBy("_key", *features).agg(
        F.count("*").alias("_n")
    )
    rows = alike.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_n")))).drop("_n")
    draw = F.xxhash64(F.lit(seed), "_key", *features, "_i")
    # about four times the pool passes, so that finding the smallest draws moves little
    share = min(1.0, 4.0 * wanted / max(df.count(), 1))
    near = rows.select(draw.alias("_draw"), *features).where(F.col("_draw") <= F.lit(int(-(2**63) + share * (2**64 - 2048))))
    pool = stage_table(near.orderBy("_draw").limit(wanted), "forest-pool")
    size = min(sample, pool.count())
    if size == 0:
        raise ValueError("no rows to fit")
    trees = F.explode(F.sequence(F.lit(0), F.lit(n_trees - 1))).alias("tree")
    turn = F.xxhash64(F.lit(seed), F.col("tree"), F.col("_draw")).alias("_turn")
    # each row reaches a tree of its own draw: n_trees groups of the pool's rows
    dealt = pool.select("*", trees).select("tree", turn, *features)

    def grow(rows: pd.DataFrame) -> pd.DataFrame:
        tree = int(rows["tree"].iloc[0])
        picked = rows.nsmallest(size, "_turn")[features].to_numpy(dtype=float)
        return pd.DataFrame([{"tree": tree, **grow_tree(picked, np.random.default_rng([seed, tree]))}])

    # one row per tree
    rows = dealt.groupBy("tree").applyInPandas(grow, _TREE).orderBy("tree").collect()
    forest = [
        {name: np.array(r[name]) for name in ("feature", "cut", "left", "right", "depth")} for r in rows
    ]
    return forest, size


def score_rows(df: DataFrame, features: list[str], forest: list[dict[str, np.ndarray]], size: int) -> DataFrame:
    """Add ``anomaly_score`` in [-1, 0): lower is more anomalous."""
    scale = float(mean_path(size)) or 1.0

    @F.pandas_udf("double")
    def score(*columns: pd.Series) -> pd.Series:
        points = np.column_stack([c.to_numpy(dtype=float) for c in columns])
        total = np.zeros(len(points))
        for tree in forest:
            total += _path_lengths(points, tree)
        return pd.Series(-np.power(2.0, -(total / len(forest)) / scale))

    return df.withColumn("anomaly_score", score(*[F.col(f).cast("double") for f in features]))


def detect_anomalies(
    df: DataFrame,
    key: str,
    features: list[str],
    contamination: float = CONTAMINATION,
    n_trees: int = TREES,
    sample: int = SAMPLE,
    seed: int = SEED,
) -> DataFrame:
    """Score all rows, flag the lowest share, and grade the severity.

    Rows below the 5 % quantile are 'high' whether or not they are flagged.
    """
    forest, size = fit_forest(df, key, features, n_trees, sample, seed)
    # written once: the quantiles and the flags must see the same scores
    scored = stage_table(score_rows(df, features, forest, size), "anomaly-scores")
    cuts = group_quantiles(scored, "anomaly_score", {"_flag_cut": contamination, "_high_cut": HIGH_SHARE})
    out = with_scalars(scored, stage_table(cuts, "anomaly-cuts"))
    score = F.col("anomaly_score")
    flagged = score < F.col("_flag_cut")
    return out.withColumns(
        {
            "is_anomaly": flagged,
            "anomaly_severity": F.when(score < F.col("_high_cut"), "high").when(flagged, "medium").otherwise("normal"),
        }
    ).drop("_flag_cut", "_high_cut")
