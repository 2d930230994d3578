"""Multiclass gradient boosting with histograms and a softmax loss.

Every feature is cut once into at most ``BINS`` quantile bins. Rows become packed blocks of bin
numbers, label, weight and fold, written to shared storage. A round grows one tree per class,
level by level: gradient and hessian sums per (class, node, feature, bin) decide the splits of
all nodes of a level. Of two children only the smaller one is counted; the other one is the
difference to their parent.

With G, H the sums of a node, lambda (L2), alpha (L1), gamma (least gain) and T(G) = G drawn
towards 0 by alpha: a split gains T(GL)^2/(HL+lambda) + T(GR)^2/(HR+lambda) - T(G)^2/(H+lambda)
and is made if that exceeds gamma; a leaf is worth -rate T(G)/(H+lambda).

Two engines run the same loop:

* ``BlockRows``: a table of one block (up to ``BLOCK_ROWS`` rows) trains inside one task. Many
  models (grids, candidates x folds) are dealt one to a task, in one Spark job, on up to
  ``TASK_ROWS`` rows.
* ``SparkRows``: larger tables take one aggregation per level over all blocks, which are persisted
  with their margins. Histograms are summed in the tasks and then over the tasks. The child with
  the smaller hessian sum is counted, and the values of the last level's leaves come from the sums
  of their parents' splits, so that a round takes one job per level. Margins are written to the
  checkpoint folder every ``CHUNK`` rounds; a lost executor costs the trees since then.

In large blocks several features share one number (``Codes``), whose sums are then added up for
each feature. The same rows give the same trees in both engines, up to the order of sums.
"""

from __future__ import annotations

import base64
import json
import zlib
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, keyword_only
from pyspark.ml import Transformer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.session import ensure_checkpoint_dir

BINS, BLOCK_ROWS, TASK_ROWS, CHUNK = 64, 250_000, 1_000_000, 50
#: Most values of a number that stands for several features; blocks whose sums are made on them.
CELLS, COMBINE_ROWS = 4096, 20_000
#: Tables of several blocks are cut into as many as there are slots, of at least a fifth of a full
#: block; sums of more tasks than ``TREE_TASKS`` meet in a tree.
SHARE, TREE_TASKS = 5, 64
LEAST_HESSIAN = 1e-16


@dataclass(frozen=True)
class Boost:
    """Training parameters. The defaults are the reference's (fixed values)."""

    n_estimators: int = 300
    max_depth: int = 6
    learning_rate: float = 0.3
    gamma: float = 0.0
    reg_lambda: float = 1.0
    reg_alpha: float = 0.0
    min_child_weight: float = 1.0
    subsample: float = 1.0
    colsample_bytree: float = 1.0
    seed: int = 42
    fold: int = -1        # rows of this fold are left out of training and measured
    patience: int = 0     # stop after so many rounds without a lower loss there; 0: never


# ---- binning and packing ----

def cut_points(df: DataFrame, features: str = "features", bins: int = BINS) -> list[list[float]]:
    """Ascending cut points of each entry of the feature vector; a value x is in the bin of the
    first cut that is not below x."""
    x = vector_to_array(F.col(features))
    size = df.select(F.size(x).alias("n")).first()
    if size is None:
        return []
    at = [i / bins for i in range(1, bins)]
    row = df.agg(*[F.percentile_approx(x[i], at, 10 * bins).alias(f"q{i}") for i in range(size.n)]).first()
    return [sorted(set(row[i])) for i in range(size.n)]


def binned(x: np.ndarray, cuts: list[list[float]]) -> np.ndarray:
    out = np.empty(x.shape, np.uint8)
    for i, c in enumerate(cuts):
        out[:, i] = np.searchsorted(np.asarray(c, float), x[:, i], side="left")
    return out


def packed(df: DataFrame, cuts, y: str, weight: str | None, fold: str | None, key: str,
           features: str = "features", block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, int]:
    """(block, n, x, y, w, fold) with binary columns, one row per block, and the number of
    blocks; written to the checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    width = len(cuts)
    slim = df.select(
        F.col(key).alias("key"), F.col(y).cast("int").alias("y"),
        (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"),
        (F.col(fold).cast("int") if fold else F.lit(-2)).alias("fold"),
        vector_to_array(F.col(features)).alias("x"))
    n = df.count()
    n_blocks = 1 + n // block_rows
    if n_blocks > 1:
        slots = df.sparkSession.sparkContext.defaultParallelism
        n_blocks = max(n_blocks, min(slots, n // max(1, block_rows // SHARE)))

    def run(batches):
        parts = []
        for b in batches:
            x = b.column(4).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            parts.append((binned(x, cuts), *(b.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3))))
        if parts:
            x, yy, w, f = (np.concatenate(c) for c in zip(*parts))
            block = int(np.int64(zlib.crc32(x.tobytes())))
            yield pa.RecordBatch.from_arrays(
                [pa.array([block]), pa.array([len(yy)]), pa.array([x.tobytes()], pa.binary()),
                 pa.array([yy.astype(np.int8).tobytes()], pa.binary()),
                 pa.array([w.astype(float).tobytes()], pa.binary()),
                 pa.array([f.astype(np.int8).tobytes()], pa.binary())],
                names=["block", "n", "x", "y", "w", "fold"])
    rows = slim.repartition(n_blocks, "key").sortWithinPartitions("key").mapInArrow(
        run, "block long, n long, x binary, y binary, w binary, fold binary")
    return rows.checkpoint(), n_blocks


# ---- trees ----

@dataclass
class Trees:
    """Complete trees, one per round and class: inner nodes in heap order (feature and bin; a
    bin beyond that goes right; 255 sends all left), their gain, cover (hessian sum) and the
    share of the cover that goes left; leaves from left to right."""

    feature: np.ndarray
    bin: np.ndarray
    gain: np.ndarray
    cover: np.ndarray
    share: np.ndarray
    leaf: np.ndarray

    def arrays(self) -> tuple:
        return self.feature, self.bin, self.gain, self.cover, self.share, self.leaf

    @staticmethod
    def empty(k: int, depth: int) -> "Trees":
        inner = (1, k, (1 << depth) - 1)
        return Trees(np.zeros(inner, np.uint8), np.full(inner, 255, np.uint8), np.zeros(inner),
                     np.zeros(inner), np.ones(inner), np.zeros((1, k, 1 << depth)))

    @staticmethod
    def joined(parts: list["Trees"], k: int, depth: int) -> "Trees":
        parts = parts or [Trees.empty(k, depth)]  # one tree that says nothing
        return Trees(*(np.concatenate(c) for c in zip(*(t.arrays() for t in parts))))

    def first(self, rounds: int) -> "Trees":
        return Trees(*(a[:rounds] for a in self.arrays()))

    def dump(self) -> str:
        raw = b"".join(a.tobytes() for a in self.arrays())
        return json.dumps([[(str(a.dtype), a.shape) for a in self.arrays()],
                           base64.b64encode(zlib.compress(raw)).decode()])

    @staticmethod
    def load(text: str) -> "Trees":
        heads, body = json.loads(text)
        raw, at, out = zlib.decompress(base64.b64decode(body)), 0, []
        for kind, shape in heads:
            n = int(np.prod(shape))
            out.append(np.frombuffer(raw, np.dtype(kind), n, at).reshape(shape))
            at += n * np.dtype(kind).itemsize
        return Trees(*out)


def grouped(bins, cells: int) -> list[list[int]]:
    """Features in groups of at most ``cells`` combined values (or of one), those of many bins
    first."""
    groups: list[list[int]] = []
    sizes: list[int] = []
    for f in sorted(range(len(bins)), key=lambda f: -bins[f]):
        at = next((i for i, n in enumerate(sizes) if n * bins[f] <= cells), None)
        if at is None:
            groups.append([f])
            sizes.append(int(bins[f]))
        else:
            groups[at].append(f)
            sizes[at] *= int(bins[f])
    return groups


def _halves(levels: int) -> np.ndarray:
    """Per inner node in heap order the leaves of its left half, as bits."""
    out = []
    for level in range(levels):
        half = 1 << (levels - level - 1)
        out += [((1 << half) - 1) << (2 * half * node) for node in range(1 << level)]
    return np.array(out, np.uint64)


HALVES = [_halves(i) for i in range(7)]


class Codes:
    """Bin numbers of rows, the features of a group combined into one number."""

    def __init__(self, x: np.ndarray, bins, cells: int | None = None):
        self.x, self.bins = x, [int(b) for b in bins]
        self.cells = x.ravel()
        self.row_start = np.arange(len(x)) * x.shape[1]
        self.groups = grouped(self.bins, min(CELLS, len(x) // 16) if cells is None else cells)
        self.codes = []
        for group in self.groups:
            code = x[:, group[0]].astype(np.int64)
            for f in group[1:]:
                code *= self.bins[f]
                code += x[:, f]
            self.codes.append(code)

    def step(self, at: np.ndarray, feature: np.ndarray) -> np.ndarray:
        """Bin of each row on the feature of its node; ``at`` is the node's place in ``feature``."""
        return self.cells[self.row_start + feature[at]]

    def places(self, feature: np.ndarray, left: np.ndarray, levels: int) -> np.ndarray:
        """Place of every row among the nodes of level ``levels`` of a tree: ``feature`` of its inner
        nodes in heap order and ``left`` (node, bin), whether a bin goes left.

        A feature's bin excludes the left halves of its nodes that send it right; of the leaves
        that no feature excludes, the first is the row's. Six levels go at once."""
        top = min(levels, 6)
        inner = (1 << top) - 1
        real = ~left[:inner].all(axis=1)
        stays = np.where(left[:inner], ~np.uint64(0), ~HALVES[top][:, None])
        tables = {f: np.bitwise_and.reduce(stays[real & (feature[:inner] == f)], axis=0)
                  for f in np.unique(feature[:inner][real]).tolist()}
        may = None
        for group, code in zip(self.groups, self.codes):
            if not any(f in tables for f in group):
                continue
            table = np.full(1, ~np.uint64(0))
            for f in group:
                one = tables[f][:self.bins[f]] if f in tables else np.full(self.bins[f], ~np.uint64(0))
                table = (table[:, None] & one).ravel()
            part = table[code]
            may = part if may is None else np.bitwise_and(may, part, out=may)
        if may is None:
            at = np.zeros(len(self.x), np.int64)
        else:
            at = np.bitwise_count((may & (~may + np.uint64(1))) - np.uint64(1)).astype(np.int64)
        for level in range(top, levels):
            node = (1 << level) - 1 + at
            at = 2 * at + ~left[node, self.step(node, feature)]
        return at


def goes_left(at_bin: np.ndarray, bins: int) -> np.ndarray:
    """(node, bin): whether the bin goes left."""
    return np.arange(bins) <= at_bin[:, None]


def places(tree: Trees, r: int, codes: Codes, levels: int) -> np.ndarray:
    """(class, row): place among the nodes of level ``levels`` of round ``r``'s trees."""
    widest = max(codes.bins)
    return np.stack([codes.places(f, goes_left(b, widest), levels)
                     for f, b in zip(tree.feature[r], tree.bin[r])])


def margins(trees: Trees, x: np.ndarray) -> np.ndarray:
    """(row, class)"""
    rounds, k, leaves = trees.leaf.shape
    out = np.zeros((k, len(x)))
    if len(x):
        codes = Codes(x, x.max(axis=0).astype(int) + 1)
        for r in range(rounds):
            for c, at in enumerate(places(trees, r, codes, leaves.bit_length() - 1)):
                out[c] += trees.leaf[r, c][at]
    return np.ascontiguousarray(out.T)


def softmax(m: np.ndarray, axis: int = 1) -> np.ndarray:
    e = np.exp(m - m.max(axis=axis, keepdims=True))
    return e / e.sum(axis=axis, keepdims=True)


# ---- engines ----

class BlockRows:
    """Rows of one block: margins, gradients and node places, each (class, row)."""

    def __init__(self, x, y, w, fold, k: int, offsets: np.ndarray, p: Boost, block: int = 0):
        self.y, self.w, self.k, self.p, self.block = y.astype(np.int64), w, k, p, block
        self.out = fold == p.fold
        self.offsets = offsets
        self.codes = Codes(x, np.diff(offsets), None if len(y) >= COMBINE_ROWS else 0)
        self.margin = np.zeros((k, len(y)))

    def start(self, r: int) -> None:
        prob = softmax(self.margin, 0)
        w = np.where(self.out, 0.0, self.w)
        if self.p.subsample < 1:
            draw = np.random.default_rng([self.p.seed, r, self.block]).random(len(w))
            w = np.where(draw < self.p.subsample, w, 0.0)
        self.live = w > 0
        hit = np.arange(self.k)[:, None] == self.y
        self.g = (prob - hit) * w
        self.h = np.maximum(2 * prob * (1 - prob), LEAST_HESSIAN) * w
        self.at = np.zeros((self.k, len(self.y)), np.int64)
        self.level = 0

    def counts(self, nodes: int) -> np.ndarray:
        """Training rows of each (class, node) of a level of ``nodes`` nodes."""
        return np.stack([np.bincount(at[self.live], minlength=nodes) for at in self.at])

    def histogram(self, slot: np.ndarray) -> np.ndarray:
        """(slots, bins, 2) sums of gradient and hessian; ``slot`` (class, node) is -1 for what
        need not be counted."""
        n = int(slot.max()) + 1 if slot.size else 0
        out = np.zeros((n, int(self.offsets[-1]), 2))
        for c in range(self.k):
            nodes = np.flatnonzero(slot[c] >= 0)
            if not len(nodes):
                continue
            local = np.full(slot.shape[1], -1)
            local[nodes] = np.arange(len(nodes))
            s = local[self.at[c]]
            some = np.flatnonzero((s >= 0) & self.live)
            s, g, h = s[some], self.g[c][some], self.h[c][some]
            for group, code in zip(self.codes.groups, self.codes.codes):
                bins = [self.codes.bins[f] for f in group]
                size = int(np.prod(bins))
                cell = s * size
                cell += code[some]
                for i, v in ((0, g), (1, h)):
                    sums = np.bincount(cell, v, len(nodes) * size).reshape(len(nodes), *bins)
                    for j, f in enumerate(group):
                        rest = tuple(1 + o for o in range(len(group)) if o != j)
                        out[slot[c][nodes], self.offsets[f]:self.offsets[f + 1], i] = (
                            sums.sum(axis=rest) if rest else sums)
        return out

    def split(self, feature: np.ndarray, at_bin: np.ndarray) -> None:
        for c, at in enumerate(self.at):
            right = self.codes.step(at, feature[c]) > at_bin[c][at]
            self.at[c] = 2 * at + right
        self.level += 1

    def finish(self, tree: Trees) -> None:
        """Adds the tree's values; rows already stand in its nodes if it grew on them."""
        for c, at in enumerate(self.at):
            self.margin[c] += tree.leaf[0, c][at << (self.p.max_depth - self.level)]

    def follow(self, tree: Trees) -> None:
        """Adds the values of a tree that grew elsewhere."""
        for c, at in enumerate(places(tree, 0, self.codes, self.p.max_depth)):
            self.margin[c] += tree.leaf[0, c][at]

    def measure(self) -> np.ndarray:
        """(rows, loss sum, wrong) of the training rows and of the rows left out; the confusion
        counts of the latter follow."""
        prob = softmax(self.margin, 0)
        loss = -np.log(np.clip(prob[self.y, np.arange(len(self.y))], 1e-15, 1 - 1e-15))
        said = prob.argmax(axis=0)
        rows = [(m.sum(), loss[m].sum(), (said != self.y)[m].sum()) for m in (~self.out, self.out)]
        table = np.bincount(self.y[self.out] * self.k + said[self.out], minlength=self.k ** 2)
        return np.concatenate([np.array(rows, float).ravel(), table])


def _block_rows(row: dict, k: int, offsets, p: Boost) -> BlockRows:
    x = np.frombuffer(row["x"], np.uint8).reshape(row["n"], -1)
    return BlockRows(x, np.frombuffer(row["y"], np.int8), np.frombuffer(row["w"]),
                     np.frombuffer(row["fold"], np.int8), k, offsets, p, row["block"])


class SparkRows:
    """Rows of many blocks: the same calls as ``BlockRows``, each aggregation a Spark job over a
    persisted RDD of blocks with their margins before the round."""

    def __init__(self, blocks: DataFrame, n_blocks: int, k: int, offsets: np.ndarray, p: Boost):
        sc = blocks.sparkSession.sparkContext
        self.k, self.offsets, self.p = k, offsets, p
        # A task sums its blocks before anything leaves it.
        self.state = (blocks.rdd.coalesce(max(1, min(n_blocks, sc.defaultParallelism)))
                      .map(lambda row: (row.asDict(), None)).persist(StorageLevel.MEMORY_AND_DISK))
        self.many = self.state.getNumPartitions() > TREE_TASKS
        self.old: list = []
        self.round, self.level, self.tree, self.since = 0, 0, None, 0

    def start(self, r: int) -> None:
        self.round, self.level, self.tree = r, 0, Trees.empty(self.k, self.p.max_depth)

    def _sum(self, fn) -> np.ndarray:
        """Sum of an array over all blocks: in the tasks, then on the driver, or over a tree of
        tasks if there are many."""
        k, offsets, p = self.k, self.offsets, self.p

        def run(blocks):
            total = None
            for row, margin in blocks:
                rows = _block_rows(row, k, offsets, p)
                if margin is not None:
                    rows.margin = np.frombuffer(margin).reshape(k, -1)
                part = np.asarray(fn(rows), float)
                total = part if total is None else total + part
            if total is not None:
                yield total
        parts = self.state.mapPartitions(run)
        total = parts.treeReduce(np.add) if self.many else sum(parts.collect())
        for rdd in self.old:  # the job above has read them for the last time
            rdd.unpersist()
        self.old = []
        return total

    def histogram(self, slot: np.ndarray) -> np.ndarray:
        r, level, tree = self.round, self.level, self.tree

        def run(rows: BlockRows) -> np.ndarray:
            rows.start(r)
            rows.at, rows.level = places(tree, 0, rows.codes, level), level
            return rows.histogram(slot)
        return self._sum(run)

    def split(self, feature: np.ndarray, at_bin: np.ndarray) -> None:
        node = (1 << self.level) - 1
        width = feature.shape[1]
        self.tree.feature[0][:, node:node + width] = feature
        self.tree.bin[0][:, node:node + width] = at_bin
        self.level += 1

    def finish(self, tree: Trees) -> None:
        """Puts the tree's values into the margins; the next job does so in its own pass."""
        k, offsets, p = self.k, self.offsets, self.p

        def add(entry):
            row, margin = entry
            rows = _block_rows(row, k, offsets, p)
            if margin is not None:
                rows.margin = np.frombuffer(margin).reshape(k, -1).copy()
            rows.follow(tree)
            return row, rows.margin.tobytes()
        self.old.append(self.state)
        self.state = self.state.map(add).persist(StorageLevel.MEMORY_AND_DISK)
        self.since += 1
        if self.since == CHUNK:  # a lost executor costs the trees since then
            self.state.checkpoint()
            self.since = 0

    def measure(self) -> np.ndarray:
        return self._sum(lambda rows: rows.measure())

    def close(self) -> None:
        for rdd in [*self.old, self.state]:
            rdd.unpersist()


# ---- growing ----

def shrunk(g: np.ndarray, alpha: float) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - alpha, 0) if alpha else g


def best_splits(hist: np.ndarray, offsets: np.ndarray, use: np.ndarray, p: Boost):
    """(gain, feature, bin, sums, left sums) of each node's best split, gain -inf where there
    is none; ties go to the first feature and bin. ``hist`` is (nodes, bins, 2), ``use`` (nodes, features) the
    features a node may take."""
    of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    left = np.cumsum(hist, axis=1)
    total = left[:, offsets[1] - 1]
    start = np.concatenate([np.zeros((len(hist), 1, 2)), left[:, offsets[1:-1] - 1]], axis=1)
    left -= start[:, of]
    rest = total[:, None] - left
    score = lambda s: shrunk(s[..., 0], p.reg_alpha) ** 2 / (s[..., 1] + p.reg_lambda + 1e-12)
    ok = (left[..., 1] >= p.min_child_weight) & (rest[..., 1] >= p.min_child_weight) & use[:, of]
    ok[:, offsets[1:] - 1] = False  # nothing would go right
    gain = np.where(ok, score(left) + score(rest) - score(total)[:, None], -np.inf)
    at = gain.argmax(axis=1)
    feature = of[at]
    node = np.arange(len(hist))
    return gain[node, at], feature, at - offsets[feature], total, left[node, at]


def columns_of(p: Boost, r: int, k: int, width: int) -> np.ndarray:
    """(class, feature): the features that each class's tree of round ``r`` may use."""
    use = np.ones((k, width), bool)
    if p.colsample_bytree < 1:
        n = max(1, int(p.colsample_bytree * width))
        for c in range(k):
            pick = np.random.default_rng([p.seed, r, 7, c]).permutation(width)[n:]
            use[c, pick] = False
    return use


def grow(rows, r: int, k: int, offsets: np.ndarray, p: Boost) -> Trees:
    """One tree per class."""
    tree = Trees.empty(k, p.max_depth)
    rows.start(r)
    use = columns_of(p, r, k, len(offsets) - 1)
    # Open nodes of the level as (class, node), with their histograms.
    far = isinstance(rows, SparkRows)

    def leaf_value(total):
        return -p.learning_rate * shrunk(total[:, 0], p.reg_alpha) / (total[:, 1] + p.reg_lambda + 1e-12)
    open_ = np.argwhere(np.ones((k, 1), bool))
    slot = np.arange(k)[:, None]
    hist = rows.histogram(slot)
    for level in range(p.max_depth + 1):
        width = 1 << level
        gain, feature, at_bin, total, left = best_splits(hist, offsets, use[open_[:, 0]], p)
        go = gain > max(p.gamma, 1e-9) if level < p.max_depth else np.zeros(len(open_), bool)
        value = leaf_value(total)
        c, node = open_.T
        leaf = ~go
        tree.leaf[0][c[leaf], node[leaf] << (p.max_depth - level)] = value[leaf]
        if not go.any():
            break
        c, node = c[go], node[go]
        f_map, b_map = np.zeros((k, width), np.int64), np.full((k, width), 255)
        f_map[c, node], b_map[c, node] = feature[go], at_bin[go]
        heap = width - 1 + node
        tree.feature[0][c, heap], tree.bin[0][c, heap] = feature[go], at_bin[go]
        tree.gain[0][c, heap], tree.cover[0][c, heap] = gain[go], total[go, 1]
        tree.share[0][c, heap] = left[go, 1] / total[go, 1]
        rows.split(f_map, b_map)
        if far and level == p.max_depth - 1:
            tree.leaf[0][c, 2 * node] = leaf_value(left[go])
            tree.leaf[0][c, 2 * node + 1] = leaf_value(total[go] - left[go])
            break
        if far:
            small = 2 * node + (2 * left[go, 1] > total[go, 1])
        else:
            n = rows.counts(2 * width)
            small = 2 * node + (n[c, 2 * node] > n[c, 2 * node + 1])
        slot = np.full((k, 2 * width), -1)
        slot[c, small] = np.arange(len(c))
        counted = rows.histogram(slot)
        other = hist[go] - counted
        open_ = np.concatenate([np.stack([c, small], 1), np.stack([c, small ^ 1], 1)])
        hist = np.concatenate([counted, other])
    return tree


def train(rows, k: int, offsets: np.ndarray, p: Boost) -> tuple[Trees, list]:
    """Trees of all rounds and, per round, the training and left-out measures; with patience,
    rounds end when the left-out loss stays above its lowest value so long."""
    parts, curve, lowest, since = [], [], np.inf, 0
    for r in range(p.n_estimators):
        tree = grow(rows, r, k, offsets, p)
        rows.finish(tree)
        parts.append(tree)
        if p.patience:
            m = rows.measure()
            curve.append(m[:6].tolist())
            loss = m[4] / max(m[3], 1)
            lowest, since = (loss, 0) if loss < lowest else (lowest, since + 1)
            if since >= p.patience:
                break
    return Trees.joined(parts, k, p.max_depth), curve


# ---- fitting on tables ----

@dataclass
class Fitted:
    """A trained model with what it measured on the rows left out."""

    trees: Trees
    cuts: list[list[float]]
    params: Boost
    curve: list = field(default_factory=list)
    measured: np.ndarray | None = None


def fit_many(df: DataFrame, grid: list[Boost], y: str, k: int, weight: str | None = None,
             fold: str | None = None, key: str = "record_id", features: str = "features",
             bins: int = BINS, block_rows: int | None = None) -> list[Fitted]:
    """Models of all parameter sets over shared bins and blocks."""
    block_rows = block_rows or (TASK_ROWS if len(grid) > 1 else BLOCK_ROWS)
    n, kept = df.count(), None
    if n > BLOCK_ROWS and df.storageLevel == StorageLevel.NONE:  # read by three passes
        df = kept = df.select(*dict.fromkeys(c for c in (key, y, weight, fold, features) if c)).persist()
    try:
        return _fit_many(df, grid, y, k, weight, fold, key, features, bins, block_rows)
    finally:
        if kept is not None:
            kept.unpersist()


def _fit_many(df, grid, y, k, weight, fold, key, features, bins, block_rows) -> list[Fitted]:
    cuts = cut_points(df, features, bins)
    offsets = np.concatenate(([0], np.cumsum([len(c) + 1 for c in cuts]))).astype(np.int64)
    if not cuts:  # no rows: one tree that says nothing
        return [Fitted(Trees.joined([], k, p.max_depth), cuts, p) for p in grid]
    blocks, n_blocks = packed(df, cuts, y, weight, fold, key, features, block_rows)
    if n_blocks > 1:
        out = []
        for p in grid:
            rows = SparkRows(blocks, n_blocks, k, offsets, p)
            trees, curve = train(rows, k, offsets, p)
            out.append(Fitted(trees, cuts, p, curve, rows.measure()))
            rows.close()
        return out

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                p = Boost(**json.loads(row["params"]))
                rows = _block_rows(row, k, offsets, p)
                trees, curve = train(rows, k, offsets, p)
                yield pa.RecordBatch.from_pylist([{
                    "model": row["model"], "trees": trees.dump(), "curve": json.dumps(curve),
                    "measured": rows.measure().tolist()}])
    told = F.array(*[F.lit(json.dumps(asdict(p))) for p in grid])
    got = (blocks.select("*", F.posexplode(told).alias("model", "params"))
           .repartitionByRange(len(grid), "model")
           .mapInArrow(run, "model long, trees string, curve string, measured array<double>").collect())
    by = {r.model: r for r in got}
    return [Fitted(Trees.load(by[i].trees), cuts, p, json.loads(by[i].curve), np.array(by[i].measured))
            for i, p in enumerate(grid)]


class BoostedModel(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Adds ``p`` (array<double>, sums to 1) and ``prediction`` (lowest class on ties)."""

    featuresCol = Param(Params._dummy(), "featuresCol", "feature vector", typeConverter=TypeConverters.toString)
    cuts = Param(Params._dummy(), "cuts", "cut points (JSON)", typeConverter=TypeConverters.toString)
    trees = Param(Params._dummy(), "trees", "trees (JSON, packed)", typeConverter=TypeConverters.toString)

    @keyword_only
    def __init__(self, featuresCol="features", cuts="[]", trees="[]"):
        super().__init__()
        self._setDefault(featuresCol="features", cuts="[]", trees="[]")
        self._set(**self._input_kwargs)

    def unpacked(self) -> tuple[Trees, list]:
        return Trees.load(self.getOrDefault(self.trees)), json.loads(self.getOrDefault(self.cuts))

    def _transform(self, df):
        shared = df.sparkSession.sparkContext.broadcast(self.unpacked())

        @F.pandas_udf("array<double>")
        def probabilities(x):
            import pandas as pd
            trees, cuts = shared.value
            rows = (np.stack(x.to_list()) if len(x) and cuts
                    else np.zeros((len(x), max(1, len(cuts)))))
            out = []
            for lo in range(0, len(rows), 20_000):
                part = rows[lo:lo + 20_000]
                bins_ = binned(part, cuts) if cuts else np.zeros(part.shape, np.uint8)
                out.extend(softmax(margins(trees, bins_)).tolist())
            return pd.Series(out, dtype=object)
        return with_prediction(df, probabilities(vector_to_array(F.col(self.getOrDefault(self.featuresCol)))),
                               self.unpacked()[0].leaf.shape[1])


def with_prediction(df: DataFrame, p, k: int) -> DataFrame:
    """Adds the probabilities ``p`` and the most probable class."""
    out = df.withColumn("p", p)
    best = F.array_max("p")
    said = F.lit(k - 1)
    for c in range(k - 2, -1, -1):
        said = F.when(F.col("p")[c] == best, F.lit(c)).otherwise(said)
    return out.withColumn("prediction", said.cast("int"))


def model_of(fitted: Fitted, features: str = "features") -> BoostedModel:
    return BoostedModel(featuresCol=features, cuts=json.dumps(fitted.cuts), trees=fitted.trees.dump())


def importance(trees: Trees, names) -> list[tuple]:
    """(feature, gain, splits, cover): mean gain and mean hessian sum of a feature's splits."""
    real = trees.bin < 255
    f = trees.feature[real]
    n = np.bincount(f, minlength=len(names))
    per = lambda v: np.bincount(f, v[real], len(names)) / np.maximum(n, 1)
    gain, cover = per(trees.gain), per(trees.cover)
    rows = [(name, float(gain[i]), int(n[i]), float(cover[i])) for i, name in enumerate(names)]
    return sorted(rows, key=lambda r: (-r[1], r[0]))
