"""Isolation Forest (Liu, Ting and Zhou 2008): trees from small samples, scored in Arrow batches."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..sources.shared import written
from .profile import near_quantiles

EULER = 0.5772156649015329


def average_path(n) -> np.ndarray:
    """c(n): the mean depth of an unsuccessful search in a tree of n rows."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + EULER) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def grow(rows: np.ndarray, random: np.random.Generator, limit: int) -> tuple[np.ndarray, ...]:
    """A tree as arrays: column (-1: leaf), threshold, left, right, depth plus c(leaf size)."""
    column, threshold, left, right, length = [], [], [], [], []

    def node(part: np.ndarray, depth: int) -> int:
        at = len(column)
        for x in (column, left, right):
            x.append(-1)
        threshold.append(0.0)
        length.append(depth + float(average_path(len(part))))
        low, high = part.min(0), part.max(0)
        usable = np.flatnonzero(high > low)
        if depth < limit and len(part) > 1 and len(usable):
            c = int(random.choice(usable))
            t = random.uniform(low[c], high[c])
            t = t if t < high[c] else low[c]  # rounding may reach the upper end; both sides keep rows
            side = part[:, c] <= t
            column[at], threshold[at] = c, t
            left[at], right[at] = node(part[side], depth + 1), node(part[~side], depth + 1)
        return at

    node(rows, 0)
    return tuple(map(np.array, (column, threshold, left, right, length)))


#: Trees of at most so many levels are scored in the complete layout.
LEVELS = 12
#: Rows scored at once, so that what a tree reads of them stays in a core's cache; levels whose nodes are compared with all of them.
ROWS, TOP = 1 << 14, 3


def complete(nodes: list[tuple[np.ndarray, ...]]) -> tuple[int, list[np.ndarray], list[tuple[np.ndarray, ...]]] | None:
    """Trees as complete ones (children of k: 2k, 2k + 1), where leaves repeat down to the last level; None if they are too deep.

    Thresholds are given as their places among all of their column, which come
    second: x <= t holds where as many of these lie below x as below t, or fewer.
    """

    def levels(tree, k: int = 0) -> int:
        return 0 if tree[0][k] < 0 else 1 + max(levels(tree, tree[2][k]), levels(tree, tree[3][k]))

    depth = max(1, max(map(levels, nodes), default=1))
    if depth > LEVELS:
        return None
    width = max(1, 1 + max((int(tree[0].max()) for tree in nodes), default=0))
    cuts = [np.unique(np.concatenate([np.zeros(0), *[tree[1][tree[0] == c] for tree in nodes]])) for c in range(width)]
    kind = np.min_scalar_type(max(map(len, cuts)))
    out = []
    for column, threshold, left, right, length in nodes:
        c, t, last = np.zeros(1 << depth, np.intp), np.zeros(1 << depth, kind), np.zeros(1 << depth)
        stack = [(0, 1)]
        while stack:
            k, at = stack.pop()
            if at >= 1 << depth:
                last[at - (1 << depth)] = length[k]
                continue
            inner = column[k] >= 0
            if inner:
                c[at], t[at] = column[k], np.searchsorted(cuts[column[k]], threshold[k])
            stack += [(left[k] if inner else k, 2 * at), (right[k] if inner else k, 2 * at + 1)]
        out.append((c, t, last))
    return depth, cuts, out


def descend(x: np.ndarray, depth: int, cuts: list[np.ndarray], trees: list[tuple[np.ndarray, ...]]) -> np.ndarray:
    """The sum of the complete trees' depths: the first levels by comparing all rows with each of their few nodes, the others by looking up each row's own."""
    n, kind = len(x), trees[0][1].dtype
    placed = np.stack([np.searchsorted(c, x[:, k]).astype(kind) for k, c in enumerate(cuts)])
    flat, base, total = placed.ravel(), np.arange(n), np.zeros(n)
    at, where, own, limit = np.empty(n, np.intp), np.empty(n, np.intp), np.empty(n, kind), np.empty(n, kind)
    go = np.empty(n, bool)
    for column, threshold, last in trees:
        sides, first = [], list(zip(column[: 1 << TOP].tolist(), threshold[: 1 << TOP]))
        at[:] = 1
        for level in range(min(TOP, depth)):
            nodes = [placed[c] > t for c, t in first[1 << level : 2 << level]]
            for side in reversed(sides):  # of two neighbours the one on the row's side
                nodes = [a ^ ((a ^ b) & side) for a, b in zip(nodes[::2], nodes[1::2])]
            sides.append(nodes[0])
            at += at
            at += nodes[0]
        offsets = column * n
        for _ in range(TOP, depth):
            offsets.take(at, out=where, mode="clip")
            where += base
            flat.take(where, out=own, mode="clip")
            threshold.take(at, out=limit, mode="clip")
            np.greater(own, limit, out=go)
            at += at
            at += go
        total += last.take(at - (1 << depth))
    return total


class IsolationForest:
    def __init__(self, trees: int = 200, sample: int = 256, seed: int = 42):
        self.trees, self.sample, self.seed = trees, sample, seed
        self.contamination = self.threshold = None

    def fit(self, df: DataFrame, columns: list[str], key: list[str] | None = None) -> IsolationForest:
        """Each tree sees at most `sample` rows; the driver gets trees * sample rows at most.

        Rows are drawn by a hash of their key (all columns of df, if none is given),
        so that rows with equal values are drawn one by one; rows with equal keys
        as well go together.
        """
        self.columns, key = columns, key or df.columns
        total = df.count()
        want = min(total, self.trees * self.sample)
        h = F.xxhash64(F.lit(self.seed), *key)
        share = min(1.0, (want + 10 * want**0.5 + 10) / max(total, 1))  # what can be among them, before the order
        near = df.where(F.pmod(h, F.lit(1 << 31)) <= F.lit(int(share * (1 << 31))))
        drawn = near.orderBy(h, *key, *columns).limit(want).select(*[F.col(c).cast("double") for c in columns])
        x = np.array([tuple(r) for r in drawn.collect()], float).reshape(-1, len(columns))
        if not len(x) or not np.isfinite(x.astype(np.float32)).all():
            raise ValueError("training rows must exist and be finite")
        self.psi = min(self.sample, total)
        random, limit = np.random.default_rng(self.seed), math.ceil(math.log2(max(self.psi, 2)))
        self.nodes = [grow(x[random.choice(len(x), min(self.psi, len(x)), replace=False)], random, limit) for _ in range(self.trees)]
        return self

    def calibrate(self, df: DataFrame, contamination: float) -> IsolationForest:
        """The score above which the given share of df lies (linear between neighbours); kept with the model."""
        return self.threshold_of(written(self.score(df).select("anomaly_score"), "scores"), contamination)  # read more than once

    def threshold_of(self, scored: DataFrame, contamination: float) -> IsolationForest:
        """calibrate() on rows that have their scores."""
        self.contamination = contamination
        self.threshold = near_quantiles(scored, "anomaly_score", [1 - contamination]).first()["q0"]
        return self

    def flag(self) -> Column:
        return (F.col("anomaly_score") > self.threshold).cast("int")

    def flagged(self, df: DataFrame, name: str = "flag") -> DataFrame:
        """Df with its scores, and 1 for those above the threshold; equality is 0."""
        return self.score(df).withColumn(name, self.flag())

    def score_array(self, x: np.ndarray) -> np.ndarray:
        """Higher is more anomalous: 2^(-mean depth / c(psi))."""
        return 2 ** (-(self.depths(x, complete(self.nodes)) / len(self.nodes)) / max(float(average_path(self.psi)), 1e-12))

    def depths(self, x: np.ndarray, trees) -> np.ndarray:
        """The sum of all trees' depths; trees: complete(self.nodes)."""
        total = np.zeros(len(x))
        if trees is not None:
            for k in range(0, len(x), ROWS):
                total[k : k + ROWS] = descend(x[k : k + ROWS], *trees)
            return total
        for column, threshold, left, right, length in self.nodes:
            at = np.zeros(len(x), int)
            while True:
                c = column[at]
                live = np.flatnonzero(c >= 0)
                if not len(live):
                    break
                go = x[live, c[live]] <= threshold[at[live]]
                at[live] = np.where(go, left[at[live]], right[at[live]])
            total += length[at]
        return total

    def score(self, df: DataFrame, name: str = "anomaly_score") -> DataFrame:
        columns, at = self.columns, [df.columns.index(c) for c in self.columns]
        trees, n, scale = complete(self.nodes), len(self.nodes), max(float(average_path(self.psi)), 1e-12)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = np.stack([b.column(i).to_numpy(zero_copy_only=False).astype(float) for i in at], 1) if b.num_rows else np.zeros((0, len(columns)))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(2 ** (-(self.depths(x, trees) / n) / scale))], [*b.schema.names, name])

        return df.mapInArrow(run, StructType([*df.schema.fields, StructField(name, DoubleType())]))
