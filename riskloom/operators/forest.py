"""Random forest over packed blocks, for tables of more than one block.

The forest is that of Spark's ``RandomForestClassifier``: bootstrap counts drawn from Poisson(1),
the square root of the number of features at every node, weighted Gini impurity, categories ordered
by their impurity (few categories: every subset), children that are leaves of one class merged, and
the mean of the trees' class shares as probability. Spark keeps a count and a node number per row
and tree, which are 2.4 KB a row for 300 trees; here a row is its bin numbers. Counts come again
from a seed per tree and block, nodes from the splits made so far.

All trees grow level by level. Tasks sum the class weights per (node, feature, bin) of their
blocks, the sums of a tree meet in one task, which picks the splits; only these reach the driver.
"""

from __future__ import annotations

import base64
import json
import math
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel, keyword_only
from pyspark.ml import Transformer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.operators import boosting

#: Rows of a block. MB of sums that a task holds at once; more trees of a level go in further jobs.
BLOCK_ROWS, HIST_MB = 100_000, 128
#: Bootstrap counts by two random bytes: P(count <= i) of Poisson(1) in 65,536ths.
_STEPS = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(9)])
COUNTS = np.searchsorted(_STEPS, (np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.uint8)


@dataclass
class Forest:
    """Complete trees: inner nodes in heap order (feature, and the bins that go left; a node that
    is not split sends all left); class shares of the leaves from left to right."""

    feature: np.ndarray
    left: np.ndarray
    leaf: np.ndarray

    def dump(self) -> str:
        parts = [self.feature, np.packbits(self.left, axis=2), self.leaf]
        raw = zlib.compress(b"".join(a.tobytes() for a in parts))
        return json.dumps([[(str(a.dtype), a.shape) for a in parts], self.left.shape[2],
                           base64.b64encode(raw).decode()])

    @staticmethod
    def load(text: str) -> "Forest":
        heads, width, body = json.loads(text)
        raw, at, out = zlib.decompress(base64.b64decode(body)), 0, []
        for kind, shape in heads:
            n = int(np.prod(shape))
            out.append(np.frombuffer(raw, np.dtype(kind), n, at).reshape(shape))
            at += n * np.dtype(kind).itemsize
        feature, left, leaf = out
        return Forest(feature, np.unpackbits(left, axis=2, count=width).astype(bool), leaf)


def shares(forest: Forest, x: np.ndarray) -> np.ndarray:
    """(row, class) mean class share over the trees that say something."""
    trees, leaves, k = forest.leaf.shape
    depth, codes = leaves.bit_length() - 1, boosting.Codes(x, [forest.left.shape[2]] * x.shape[1])
    out = np.zeros((len(x), k))
    for t in range(trees):
        out += forest.leaf[t][codes.places(forest.feature[t], forest.left[t], depth)]
    total = out.sum(axis=1, keepdims=True)
    return np.where(total > 0, out / np.where(total > 0, total, 1), 1.0 / k)


# ---- splits ----

def gini(c: np.ndarray) -> np.ndarray:
    n = c.sum(axis=-1)
    return 1 - (c * c).sum(axis=-1) / np.where(n > 0, n * n, 1)


def subsets(arity: int) -> np.ndarray:
    """(subset, category): every split of the categories in two; the last one goes right."""
    return (np.arange(1, 1 << (arity - 1))[:, None] >> np.arange(arity)[None, :] & 1).astype(bool)


def feature_splits(h: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gain, bins that go left, left sums) of each node's best split on one feature; ``h`` is
    (nodes, bins, classes). kind: 'number', 'ordered' or 'subsets' of categories."""
    m, bins, k = h.shape
    node = np.arange(m)
    total = h.sum(axis=1)
    order = np.tile(np.arange(bins), (m, 1))
    if kind == "subsets":
        masks = subsets(bins)
        left = np.einsum("sb,mbk->msk", masks.astype(float), h)
    else:
        if kind == "ordered":
            n = h.sum(axis=2)
            key = gini(h) if k > 2 else h[..., -1] / np.where(n > 0, n, 1)
            order = np.where(n > 0, key, np.inf).argsort(axis=1, kind="stable")
        left = np.cumsum(np.take_along_axis(h, order[..., None], 1), axis=1)[:, :-1]
    if not left.shape[1]:
        return np.full(m, -np.inf), np.ones((m, bins), bool), total
    right = total[:, None] - left
    wl, wr = left.sum(axis=2), right.sum(axis=2)
    w = np.where(wl + wr > 0, wl + wr, 1)
    gain = gini(total)[:, None] - wl / w * gini(left) - wr / w * gini(right)
    # Sums that came together in another order leave traces of 1e-16.
    gain = np.where((wl > 1e-9 * w) & (wr > 1e-9 * w), gain, -np.inf)
    at = gain.argmax(axis=1)
    if kind == "subsets":
        goes = masks[at]
    else:
        goes = np.zeros((m, bins), bool)
        np.put_along_axis(goes, order, np.arange(bins)[None, :] <= at[:, None], 1)
    return gain[node, at], goes, left[node, at]


def best_splits(hist: np.ndarray, picks: np.ndarray, starts: np.ndarray, bins: list[int], k: int,
                kinds: list[str]):
    """(gain, feature, bins that go left, left sums, all sums) of each node of one tree; ``picks``
    (node, j) are its features and ``starts`` their places in ``hist``."""
    m, n_picks = picks.shape
    widest = max(bins)
    gain, feature = np.full(m, -np.inf), np.zeros(m, np.int64)
    goes, sums, total = np.ones((m, widest), bool), np.zeros((m, k)), np.zeros((m, k))
    first = np.full(m, n_picks)
    for f, b in enumerate(bins):
        node, j = np.nonzero(picks == f)
        if not len(node):
            continue
        h = hist[starts[node, j][:, None] + np.arange(b * k)].reshape(-1, b, k)
        g, left, s = feature_splits(h, kinds[f])
        total[node] = h.sum(axis=1)
        better = (g > gain[node]) | ((g == gain[node]) & (j < first[node]))
        at = node[better]
        gain[at], feature[at], sums[at], first[at] = g[better], f, s[better], j[better]
        goes[at] = True
        goes[at, :b] = left[better]
    return gain, feature, goes, sums, total


# ---- growing ----

def picked(seed: int, tree: int, level: int, nodes: np.ndarray, width: int) -> np.ndarray:
    """(node, j) features of the given nodes of a level."""
    draw = np.random.default_rng([seed, tree, level]).random((1 << level, width))
    return np.sort(draw.argsort(axis=1)[:, :math.ceil(math.sqrt(width))], axis=1)[nodes]


def layout(picks: np.ndarray, bins: list[int], k: int) -> tuple[np.ndarray, int]:
    """Places of the (node, j) sums of a tree, j by j, and their number."""
    size = np.asarray(bins)[picks].T.ravel() * k
    ends = np.cumsum(size)
    return (ends - size).reshape(picks.shape[::-1]).T, int(ends[-1]) if len(ends) else 0


def tree_sums(codes: "boosting.Codes", y, w, counts, slot, picks, feature, left, level: int,
              bins: list[int], k: int) -> np.ndarray:
    """Class weights per (node, picked feature, bin) of the open nodes of one tree's level."""
    starts, size = layout(picks, bins, k)
    live = np.flatnonzero(counts)
    s = slot[codes.places(feature, left, level)[live]]
    keep = s >= 0
    s, live = s[keep], live[keep]
    weight = w[live] * counts[live]
    at, label = live * codes.x.shape[1], y[live]
    out = np.zeros(size)
    for j in range(picks.shape[1]):
        lo = int(starts[0, j])
        hi = int(starts[0, j + 1]) if j + 1 < picks.shape[1] else size
        cell = (starts[:, j] - lo)[s] + codes.cells[at + picks[:, j][s]].astype(np.int64) * k + label
        out[lo:hi] = np.bincount(cell, weight, hi - lo)
    return out


def fit(df: DataFrame, y: str, k: int, weight: str | None, key: str, features: str = "features",
        arity: dict[int, int] | None = None, trees: int = 300, depth: int = 8, max_bins: int = 64,
        seed: int = 42, block_rows: int | None = None) -> tuple[Forest, list[list[float]]]:
    """Forest and cut points; ``arity`` gives the number of categories of features that hold
    category numbers."""
    arity = arity or {}
    needed = [F.col(c).isNull() for c in (y, weight) if c]
    bad = F.lit(False)
    for c in [*needed, ~F.col(y).between(0, k - 1)]:
        bad = bad | F.coalesce(c, F.lit(False))
    if df.filter(bad).limit(1).count():
        raise ValueError(f"labels must be 0 to {k - 1}, weights must be given")
    cuts = boosting.cut_points(df, features, max_bins)
    for f, n in arity.items():
        cuts[f] = [float(i) for i in range(n - 1)]
    bins = [len(c) + 1 for c in cuts]
    most = int(math.log2(max_bins / 2 + 1) + 1)
    kinds = ["number" if f not in arity else "subsets" if k > 2 and 1 < arity[f] <= most else "ordered"
             for f in range(len(bins))]
    blocks, n_blocks = boosting.packed(df, cuts, y, weight, None, key, features,
                                       block_rows or BLOCK_ROWS)
    sc = df.sparkSession.sparkContext
    slots = max(1, min(n_blocks, sc.defaultParallelism))
    rows = blocks.rdd.coalesce(slots).persist(StorageLevel.MEMORY_AND_DISK)
    inner, width, widest = (1 << depth) - 1, len(bins), max(bins)
    feature, left = np.zeros((trees, inner), np.uint8), np.ones((trees, inner, widest), bool)
    sums, split = np.zeros((trees, 2 * inner + 1, k)), np.zeros((trees, 2 * inner + 1), bool)
    open_ = {t: np.zeros(1, np.int64) for t in range(trees)}
    for level in range(depth):
        for some in _groups(open_, level, bins, k, seed):
            got = _level(sc, rows, some, level, feature, left, bins, kinds, k, seed, slots)
            for t, (gain, f, goes, l_sums, total) in got:
                node = some[t]
                heap = (1 << level) - 1 + node
                sums[t, heap] = total
                go = gain > 1e-12
                heap, f, goes, l_sums, total = heap[go], f[go], goes[go], l_sums[go], total[go]
                split[t, heap], feature[t, heap], left[t, heap] = True, f, goes
                sums[t, 2 * heap + 1], sums[t, 2 * heap + 2] = l_sums, np.maximum(total - l_sums, 0)
                open_[t] = np.sort(np.concatenate([2 * node[go], 2 * node[go] + 1]))
    rows.unpersist()
    return Forest(feature, *_leaves(feature, left, sums, split, depth)), cuts


def _groups(open_: dict, level: int, bins: list[int], k: int, seed: int):
    """Trees with open nodes, as many at a time as a task may hold sums of."""
    now, room = {}, HIST_MB << 17  # numbers of 8 bytes
    for t, nodes in list(open_.items()):
        open_[t] = nodes[:0]
        if not len(nodes):
            continue
        size = layout(picked(seed, t, level, nodes, len(bins)), bins, k)[1]
        if now and size > room:
            yield now
            now, room = {}, HIST_MB << 17
        now[t] = nodes
        room -= size
    if now:
        yield now


def _level(sc, rows, some, level, feature, left, bins, kinds, k, seed, slots) -> list:
    """(tree, its best splits) of one level for some trees."""
    done = (1 << level) - 1
    told = {t: (nodes, feature[t, :done], left[t, :done]) for t, nodes in some.items()}
    shared = sc.broadcast(told)

    def count(blocks):
        total = {}
        for row in blocks:
            x = np.frombuffer(row["x"], np.uint8).reshape(row["n"], -1)
            codes = boosting.Codes(x, bins)
            y, w = np.frombuffer(row["y"], np.int8).astype(np.int64), np.frombuffer(row["w"])
            for t, (nodes, feat, goes) in shared.value.items():
                draw = np.random.Generator(np.random.SFC64([seed, t, row["block"]]))
                counts = COUNTS[np.frombuffer(draw.bytes(2 * len(y)), np.uint16)]
                slot = np.full(1 << level, -1)
                slot[nodes] = np.arange(len(nodes))
                part = tree_sums(codes, y, w, counts, slot, picked(seed, t, level, nodes, len(bins)),
                                 feat, goes, level, bins, k)
                if t in total:
                    total[t] += part
                else:
                    total[t] = part
        yield from total.items()

    def choose(parts):
        for t, hist in parts:
            picks = picked(seed, t, level, shared.value[t][0], len(bins))
            yield t, best_splits(hist, picks, layout(picks, bins, k)[0], bins, k, kinds)
    try:
        return (rows.mapPartitions(count).reduceByKey(np.add, slots).mapPartitions(choose).collect())
    finally:
        shared.destroy()


def _leaves(feature, left, sums, split, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The bins that go left and the leaves' class shares, with children that are leaves of one
    class merged into their parent."""
    said = sums.argmax(axis=2)
    for level in range(depth - 1, -1, -1):
        heap = np.arange((1 << level) - 1, (2 << level) - 1)
        a, b = 2 * heap + 1, 2 * heap + 2
        split[:, heap] &= split[:, a] | split[:, b] | (said[:, a] != said[:, b])
    left[~split[:, :left.shape[1]]] = True
    leaf = np.zeros((len(sums), 1 << depth, sums.shape[2]))
    reached = np.zeros_like(split)
    reached[:, 0] = True
    for level in range(depth + 1):
        node = np.arange(1 << level)
        heap = (1 << level) - 1 + node
        t, i = np.nonzero(reached[:, heap] & ~split[:, heap])
        leaf[t, i << (depth - level)] = sums[t, heap[i]]
        if level < depth:
            on = reached[:, heap] & split[:, heap]
            reached[:, 2 * heap + 1] = on
            reached[:, 2 * heap + 2] = on
    n = leaf.sum(axis=2, keepdims=True)
    return left, np.where(n > 0, leaf / np.where(n > 0, n, 1), 0.0)


class ForestModel(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Adds ``p`` (array<double>, sums to 1) and ``prediction`` (lowest class on ties)."""

    featuresCol = Param(Params._dummy(), "featuresCol", "feature vector", typeConverter=TypeConverters.toString)
    cuts = Param(Params._dummy(), "cuts", "cut points (JSON)", typeConverter=TypeConverters.toString)
    trees = Param(Params._dummy(), "trees", "trees (JSON, packed)", typeConverter=TypeConverters.toString)

    @keyword_only
    def __init__(self, featuresCol="features", cuts="[]", trees="[]"):
        super().__init__()
        self._setDefault(featuresCol="features", cuts="[]", trees="[]")
        self._set(**self._input_kwargs)

    def _transform(self, df):
        forest, cuts = Forest.load(self.getOrDefault(self.trees)), json.loads(self.getOrDefault(self.cuts))
        k = forest.leaf.shape[2]
        shared = df.sparkSession.sparkContext.broadcast((forest, cuts))

        @F.pandas_udf("array<double>")
        def probabilities(x):
            import pandas as pd
            trees, at = shared.value
            out = []
            for lo in range(0, len(x), 20_000):
                part = np.stack(x.iloc[lo:lo + 20_000].to_list())
                out.extend(shares(trees, boosting.binned(part, at)).tolist())
            return pd.Series(out, dtype=object)
        return boosting.with_prediction(df, probabilities(
            vector_to_array(F.col(self.getOrDefault(self.featuresCol)))), k)


def model_of(forest: Forest, cuts: list, features: str = "features") -> ForestModel:
    return ForestModel(featuresCol=features, cuts=json.dumps(cuts), trees=forest.dump())
