"""Language-model scoring by logistic mixing of hashed-context bit predictors.

The model reads a text as the bytes of its UTF-8 form with A-Z in lower case, ended by a byte
that UTF-8 never uses, and gives the probability of every bit of every byte. Predictors: the
contexts of the last 0 to ``ORDER`` bytes each tell how often, after them and after the byte's
bits so far, a one and a zero came in the training texts. Their log odds are added under
weights; a gate (the longest known context, how often it was seen, the number of the bit)
chooses the weight vector. A last adaptive map refines the mixed probability from how often
such a prediction came true. The sum over all bits is the text's log probability.

What a byte costs depends on its window alone: the byte and the ``ORDER`` bytes before it. So
nothing is gathered per place of a text:

1. Documents are numbered into blocks of about ``BLOCK_BYTES`` and written once. Each block
   counts its distinct windows and words; the counts are summed by key over the whole corpus,
   so the table grows with the corpus and is never held by one process.
2. Windows are dealt by their last three context bytes, so the longer contexts of a window lie
   in one task; contexts up to two bytes are tables of bounded size (``SHORT_SLOTS`` hashed
   slots of 256 bytes) and are broadcast.
3. Weights are learned online: each task walks through its windows in hash order and takes a
   gradient step per batch, each window predicted without its own occurrence (leave one out).
   Tasks' weights are averaged by the mass they saw, and the next round starts from there.
   The adaptive map is counted in one more pass.
4. Each window's cost goes back to the blocks that hold it, and a block's documents are scored
   with the block's own dictionary of windows and words.

A key returns to a block at most once for each task that read it, so hot words and windows
cost no more than the number of blocks, and copies of a text add nothing to a block's
dictionary. Lists of blocks are cut into pieces of ``LIST_BLOCKS``; the pieces hold them all.

The base score is that of single tokens with additive smoothing; words are keyed by 128-bit
hashes.

Defined results: a null text is empty and has one token, the end; without training documents
every bit is a half; rows with a null id teach nothing and are not held out; repeated rows are
scored alike and count as often as they come; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.llm.common import handed_on, learnable, slices, tune
from riskloom.llm.subwords import mix

MODULUS, HELD_OUT = 10, 0
ORDER = 5
BITS = 8
END = 0xFF
BLOCK_BYTES, TABLE_BYTES, LIST_BLOCKS = 32 << 20, 16 << 20, 4096
#: Characters handled at once in a task, and entries packed at once.
SLICE, PACKED = 1_000_000, 500_000
PART_WINDOWS = 150_000
SHORT, SHORT_SLOTS = 2, 1 << 14
#: Added to the counts of ones and zeros.
PRIOR = 0.3
CONFIDENCE = 4
GATES = (ORDER + 1) * CONFIDENCE * BITS
ROUNDS, STEP_WINDOWS, RATE = 4, 2048, 0.08
#: Places of the adaptive map over the log odds, from -SPAN to SPAN.
PLACES, SPAN = 25, 12.0
LEAST_P = 1e-7
#: Fixed value of the base score.
SMOOTH = 0.1


# ---- windows and words of a batch ----

def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Windows of all places of lower-cased texts and the number of places of each text. A
    window is packed with its nearest context byte first and the byte itself last."""
    pad = bytes([END]) * ORDER
    end = bytes([END])
    flat = np.frombuffer(b"".join([x for t in texts for x in (pad, t, end)]), np.uint8)
    n = np.array([len(t) + 1 for t in texts], np.int64)
    at = np.cumsum(n + ORDER) - n - ORDER
    real = np.ones(len(flat), bool)
    real[(at[:, None] + np.arange(ORDER)).ravel()] = False
    key = np.zeros(len(flat) - ORDER, np.int64)
    for k in range(1, ORDER + 1):
        key = (key << 8) | flat[ORDER - k:len(flat) - k]
    return ((key << 8) | flat[ORDER:])[real[ORDER:]], n


def words(texts: list[bytes]) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Word number of every token, the distinct words, and the number of words of each text.
    Words are parted by ASCII white space."""
    lists = [t.split() for t in texts]
    n = np.array([len(x) for x in lists], np.int64)
    coded = pa.array([w for x in lists for w in x], pa.binary()).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary, n


def word_keys(distinct: pa.Array) -> np.ndarray:
    """128-bit keys of words, as rows of two 64-bit numbers."""
    raw = b"".join([xxhash.xxh3_128_digest(w) for w in distinct.to_pylist()])
    return np.frombuffer(raw, np.int64).reshape(-1, 2)


def lowered(texts: pa.Array) -> list[bytes]:
    return [t.lower() if t else b"" for t in texts.cast(pa.binary()).to_pylist()]


# ---- counts per block ----

BLOCKED = "block long, size long, train boolean, doc_id long, text string"
#: Packed keys: one row for the keys of one bucket and block, or of one block and task. Windows
#: have no second half.
PAIRS = "kind long, bucket long, block long, k1 array<long>, k2 array<long>, n array<long>"
BUCKETS_PER_PART = 8


def blocked(docs: DataFrame) -> DataFrame:
    """Documents with their block's number, written to shared storage so that it stays."""
    tune(docs.sparkSession)
    slim = docs.select(
        F.coalesce(learnable(F.col("doc_id"), MODULUS, HELD_OUT), F.lit(False)).alias("train"),
        F.col("doc_id").cast("long").alias("doc_id"), "text")

    def run(batches):
        task, size = TaskContext.get().partitionId(), 0
        for b in batches:
            n = pc.binary_length(b.column(2)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            before = size + np.cumsum(n) - n
            size += int(n.sum())
            block = (np.int64(task) << 32) + before // BLOCK_BYTES
            yield pa.RecordBatch.from_arrays(
                [pa.array(block), pa.array(n), *b.columns],
                names=["block", "size", "train", "doc_id", "text"])
    return handed_on(slim.mapInArrow(run, BLOCKED), "blocks")


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of ``keys`` in order, and the sum of ``n`` over each."""
    order = np.lexsort(keys.T[::-1])
    keys, n = keys[order], n[order]
    lead = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(axis=1))))
    return keys[lead], np.add.reduceat(n, lead)


class _Block:
    """Distinct windows and words of one block with their number of training places."""

    def __init__(self):
        self.windows, self.words = [], []

    def add(self, texts: list[bytes], train: np.ndarray) -> None:
        key, n = windows(texts)
        both, count = np.unique((key << 1) | np.repeat(train, n), return_counts=True)
        self.windows.append((both, count))
        code, distinct, n = words(texts)
        learned = np.bincount(code, np.repeat(train, n), len(distinct)).astype(np.int64)
        if len(distinct):
            self.words.append((word_keys(distinct), learned))
        if sum(len(x) for x, _ in self.windows) > 2_000_000:
            self.windows = [self._merged()]
        if sum(len(x) for _, x in self.words) > 1_000_000:
            self.words = [self._merged_words()]

    def _merged_words(self):
        return _summed(np.concatenate([x for x, _ in self.words]),
                       np.concatenate([c for _, c in self.words]))

    def _merged(self):
        key, at = np.unique(np.concatenate([x for x, _ in self.windows]), return_inverse=True)
        return key, np.bincount(at, np.concatenate([c for _, c in self.windows])).astype(np.int64)

    def rows(self, block: int, buckets: int):
        key, count = self._merged()
        plain, at = np.unique(key >> 1, return_inverse=True)
        n = np.bincount(at, count * (key & 1)).astype(np.int64)
        empty = np.empty(0, np.int64)
        yield _packed(["kind", "bucket", "block", "k1", "k2", "n"], _bucket(plain, buckets),
                      lambda x: [0, x, block], [plain, empty, n])
        if self.words:
            k, n = self._merged_words()
            yield _packed(["kind", "bucket", "block", "k1", "k2", "n"], _bucket(k[:, 0], buckets),
                          lambda x: [1, x, block], [k[:, 0], k[:, 1], n])


def _bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(key.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def _packed(names: list[str], group: np.ndarray, plain, lists: list[np.ndarray]) -> pa.RecordBatch:
    """One row per value x of ``group``: the plain columns ``plain(x)`` and the members of
    ``lists`` as list columns; an empty one gives empty lists."""
    order = np.argsort(group, kind="stable")
    values, lead = np.unique(group[order], return_index=True)
    offsets = pa.array(np.append(lead, len(group)).astype(np.int32))
    columns = [pa.array(list(c), pa.int64()) for c in zip(*map(plain, values.tolist()))]
    for x in lists:
        at = offsets if len(x) else pa.array(np.zeros(len(values) + 1, np.int32))
        columns.append(pa.ListArray.from_arrays(at, pa.array(x[order] if len(x) else x)))
    return pa.RecordBatch.from_arrays(columns, names=names)


def _unpacked(rows: pa.Table, kind: int, columns: list[str]) -> list[np.ndarray]:
    """Flat list columns of one kind, and before them the row of each member."""
    mine = rows.filter(pc.equal(rows.column("kind"), kind)).combine_chunks()
    out = [pc.list_parent_indices(mine.column(columns[0])).to_numpy(), mine]
    return out + [pc.list_flatten(mine.column(c)).to_numpy() for c in columns]


def counted(rows: DataFrame, parts: int) -> DataFrame:
    """Windows (kind 0) and words (kind 1) of each block, with their number of places in its
    training documents, packed by block and hash bucket."""
    buckets = BUCKETS_PER_PART * parts

    def run(batches):
        now, mine = None, None
        for b in batches:
            blocks = b.column(0).to_numpy(zero_copy_only=False)
            train = b.column(1).to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
            for lo, hi in zip(edges, edges[1:]):
                if lo == hi:
                    continue
                if blocks[lo] != now:
                    if mine:
                        yield from mine.rows(now, buckets)
                    now, mine = int(blocks[lo]), _Block()
                texts = lowered(b.column(2).slice(lo, hi - lo))
                for x, y in slices(texts, SLICE):
                    mine.add(texts[x:y], train[lo + x:lo + y].astype(np.int64))
        if mine:
            yield from mine.rows(now, buckets)
    return rows.select("block", "train", "text").mapInArrow(run, PAIRS)


TABLE = "kind long, k1 long, k2 long, n long, part long, blocks array<long>"


def summed(pairs: DataFrame, parts: int) -> DataFrame:
    """One row per key and ``LIST_BLOCKS`` of its blocks: the key's training places in the
    whole corpus and the blocks, written to shared storage."""
    def run(batches):
        got = list(batches)
        rows = pa.Table.from_batches(got) if got else None
        for kind, halves in ((0, ["k1"]), (1, ["k1", "k2"])) if got else ():
            at, mine, *columns = _unpacked(rows, kind, [*halves, "n"])
            if not len(at):
                continue
            block, n = mine.column("block").to_numpy()[at], columns.pop()
            order = np.lexsort((block, *columns[::-1]))
            block, n, columns = block[order], n[order], [c[order] for c in columns]
            new = np.concatenate(([True], np.any([c[1:] != c[:-1] for c in columns], axis=0)))
            lead = np.flatnonzero(new)
            total = np.add.reduceat(n, lead)
            owner = np.cumsum(new) - 1
            nth = np.arange(len(n)) - lead[owner]
            cut = np.flatnonzero(nth % LIST_BLOCKS == 0)
            lists = pa.ListArray.from_arrays(
                pa.array(np.append(cut, len(n)).astype(np.int32)), pa.array(block))
            k2 = columns[-1][cut] if kind else np.zeros(len(cut), np.int64)
            whole = pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(cut), kind)), pa.array(columns[0][cut]), pa.array(k2),
                 pa.array(total[owner[cut]]), pa.array(nth[cut] // LIST_BLOCKS), lists],
                names=["kind", "k1", "k2", "n", "part", "blocks"])
            for lo in range(0, len(cut), 100_000):
                yield whole.slice(lo, 100_000)
    return handed_on(pairs.repartition(parts, "kind", "bucket").mapInArrow(run, TABLE), "counts")


# ---- bit counts of contexts ----

def path_counts(gram: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For grams (context then byte, sorted, distinct) and their counts: how often the context
    came with the first 0, 1, ..., 8 bits of the byte. Rows are grams."""
    total = np.concatenate(([0], np.cumsum(n)))
    out = np.empty((len(gram), BITS + 1))
    for j in range(BITS + 1):
        new = np.concatenate(([True], (gram[1:] >> (BITS - j)) != (gram[:-1] >> (BITS - j))))
        lead = np.flatnonzero(new)
        run = total[np.append(lead[1:], len(gram))] - total[lead]
        out[:, j] = run[np.cumsum(new) - 1]
    return out


def gram_of(key, order: int):
    """Gram of a window for a context of ``order`` bytes; for ``SHORT`` bytes the context is
    hashed into ``SHORT_SLOTS`` slots."""
    context = key >> np.int64(8 * (ORDER + 1 - order))
    if order == SHORT:
        context = (mix(context.astype(np.uint64)) & np.uint64(SHORT_SLOTS - 1)).astype(np.int64)
    return (context << np.int64(8)) | (key & np.int64(255))


class Shorts:
    """Counts of the contexts of 0 to ``SHORT`` bytes: tables of bounded size."""

    def __init__(self, table: DataFrame):
        def run(batches):
            for b in batches:
                key, n = (c.to_numpy(zero_copy_only=False) for c in b.columns)
                for order in range(SHORT + 1):
                    gram, at = np.unique(gram_of(key, order), return_inverse=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(gram), order)), pa.array(gram),
                         pa.array(np.bincount(at, n, len(gram)).astype(np.int64))],
                        names=["order", "gram", "n"])
        rows = (table.where("kind = 0 AND part = 0").select("k1", "n")
                .mapInArrow(run, "order long, gram long, n long")
                .groupBy("order", "gram").agg(F.sum("n").alias("n")).toPandas())
        self.grams, self.counts = [], []
        for order in range(SHORT + 1):
            mine = rows[rows["order"] == order].sort_values("gram")
            gram = mine["gram"].to_numpy(np.int64)
            self.grams.append(gram)
            self.counts.append(path_counts(gram, mine["n"].to_numpy(np.int64)))

    def of(self, key: np.ndarray, order: int) -> np.ndarray:
        return self.counts[order][np.searchsorted(self.grams[order], gram_of(key, order))]


def context_counts(key: np.ndarray, n: np.ndarray, shorts: Shorts) -> np.ndarray:
    """(order, window, bits read) counts of the windows; all windows with the same last three
    context bytes are there."""
    out = [shorts.of(key, order) for order in range(SHORT + 1)]
    for order in range(SHORT + 1, ORDER + 1):
        gram, at = np.unique(gram_of(key, order), return_inverse=True)
        out.append(path_counts(gram, np.bincount(at, n, len(gram)).astype(np.int64))[at])
    return np.stack(out)


def inputs(counts: np.ndarray, bit: int, left_out) -> tuple[np.ndarray, np.ndarray]:
    """Log odds (order x window) of the bit that came, and the gate of each window."""
    seen = np.maximum(counts[:, :, bit] - left_out, 0)
    came = np.maximum(counts[:, :, bit + 1] - left_out, 0)
    x = np.log((came + PRIOR) / (seen - came + PRIOR))
    known = (seen > 0)
    longest = np.maximum(ORDER - np.argmax(known[::-1], axis=0), 0) * known.any(axis=0)
    often = seen[longest, np.arange(seen.shape[1])]
    level = np.clip(np.log2(np.maximum(often, 1)).astype(np.int64) // 2, 0, CONFIDENCE - 1)
    return x, (longest * CONFIDENCE + level) * BITS + bit


def logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


# ---- learning ----

def start_weights() -> np.ndarray:
    return np.full((GATES, ORDER + 1), 1.5 / (ORDER + 1))


def walk(key: np.ndarray, n: np.ndarray, counts: np.ndarray, weights: np.ndarray,
         rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights after one online walk through the training windows in hash order, and the mass
    each gate saw."""
    w, slope, mass = weights.copy(), np.full(weights.shape, 1e-4), np.zeros(GATES)
    learn = np.flatnonzero(n > 0)
    learn = learn[np.argsort(mix(key[learn].astype(np.uint64)))]
    for lo in range(0, len(learn), STEP_WINDOWS):
        some = learn[lo:lo + STEP_WINDOWS]
        part, m = counts[:, some], n[some].astype(float)
        for bit in range(BITS):
            x, gate = inputs(part, bit, 1)
            miss = m * (1 - logistic((w[gate].T * x).sum(axis=0)))
            weight = np.bincount(gate, m, GATES)
            got = np.flatnonzero(weight)
            step = np.stack([np.bincount(gate, miss * x[k], GATES)[got] for k in range(ORDER + 1)], 1)
            step /= weight[got, None]
            slope[got] += step ** 2
            w[got] += rate * step / np.sqrt(slope[got])
            mass += weight
    return w, mass


def ones_odds(counts, key, bit, weights, left_out):
    """Mixed log odds that the bit is a one, its gate, and the bit."""
    x, gate = inputs(counts, bit, left_out)
    one = (key >> np.int64(BITS - 1 - bit)) & 1
    return np.where(one, 1, -1) * (weights[gate].T * x).sum(axis=0), gate, one


def places(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower place of the adaptive map and the share of the upper one."""
    at = (np.clip(z, -SPAN, SPAN) + SPAN) * (PLACES - 1) / (2 * SPAN)
    low = np.minimum(at.astype(np.int64), PLACES - 2)
    return low, at - low


def map_counts(key, n, counts, weights) -> np.ndarray:
    """(gate and place, 2): mass of predictions at each place, and of ones among them."""
    out = np.zeros((GATES * PLACES, 2))
    learn = np.flatnonzero(n > 0)
    part, m, k = counts[:, learn], n[learn].astype(float), key[learn]
    for bit in range(BITS):
        z, gate, one = ones_odds(part, k, bit, weights, 1)
        low, share = places(z)
        for at, s in ((low, 1 - share), (low + 1, share)):
            for c, y in ((0, 1.0), (1, one)):
                out[:, c] += np.bincount(gate * PLACES + at, m * s * y, len(out))
    return out


def adaptive_map(sums: np.ndarray) -> np.ndarray:
    """Probability of a one at each place, drawn towards the place's own odds where few
    predictions came."""
    own = logistic(np.tile(np.linspace(-SPAN, SPAN, PLACES), GATES))
    return ((sums[:, 1] + 20 * own) / (sums[:, 0] + 20)).reshape(GATES, PLACES)


def window_bits(key: np.ndarray, counts: np.ndarray, model: dict) -> np.ndarray:
    """Bits that each window's byte costs."""
    out = np.zeros(len(key))
    if not model["learned"]:
        return out + BITS
    for bit in range(BITS):
        z, gate, one = ones_odds(counts, key, bit, model["weights"], 0)
        low, share = places(z)
        refined = model["map"][gate, low] * (1 - share) + model["map"][gate, low + 1] * share
        p = np.clip((logistic(z) + refined) / 2, LEAST_P, 1 - LEAST_P)
        out -= np.log2(np.where(one, p, 1 - p))
    return out


def _dealt(table: DataFrame, parts: int, *columns: str) -> DataFrame:
    """Windows dealt so that those with the same last three context bytes share a task."""
    rows = table.where("kind = 0")
    if not columns:
        rows = rows.where("part = 0")
    return rows.select("k1", "n", *columns).repartition(
        parts, F.shiftright("k1", 8 * (ORDER + 1 - SHORT - 1)))


def _gathered(batches):
    """Distinct windows of a task in order, their training places, and the rows' columns."""
    got = list(batches)
    if not got:
        return None
    rows = pa.Table.from_batches(got)
    key, first, at = np.unique(rows.column(0).to_numpy(), return_index=True, return_inverse=True)
    return key, rows.column(1).to_numpy()[first], at, rows


def learn(table: DataFrame, rounds: int = ROUNDS) -> dict:
    """Weights and adaptive map. The driver gathers one row per weight and per place."""
    spark = table.sparkSession
    size = table.where("kind = 0 AND part = 0").agg(F.count("*").alias("n"), F.sum("n").alias("t")).first()
    parts = 1 + size.n // PART_WINDOWS
    model = {"learned": bool(size.t), "weights": start_weights(), "parts": parts,
             "shorts": spark.sparkContext.broadcast(Shorts(table))}
    if not model["learned"]:
        return model
    shorts = model["shorts"]

    def summed_up(fn, shape):
        """Sum over the tasks of an array that ``fn`` makes of a task's windows: one row per
        task, summed in groups before the driver adds the groups' sums."""
        groups = max(1, int(parts ** 0.5))

        def run(batches):
            got = _gathered(batches)
            if got:
                key, n, _, _ = got
                task = TaskContext.get().partitionId()
                value = fn(key, n, context_counts(key, n, shorts.value)).astype(float).tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([task % groups]), pa.array([task]), pa.array([value])],
                    names=["g", "task", "v"])

        def add(rows: pa.Table) -> pa.Table:
            rows = rows.sort_by("task")
            total = sum(np.frombuffer(v) for v in rows.column("v").to_pylist())
            return pa.table({"g": rows.column("g")[:1], "v": [total.tobytes()]})
        sums = (_dealt(table, parts).mapInArrow(run, "g long, task long, v binary")
                .groupBy("g").applyInArrow(add, "g long, v binary").orderBy("g").collect())
        return sum(np.frombuffer(r.v) for r in sums).reshape(shape)

    for r in range(rounds):
        def walked(key, n, counts, weights=model["weights"], rate=RATE / (1 + r)):
            w, mass = walk(key, n, counts, weights, rate)
            return np.column_stack([w * mass[:, None], mass])
        sums = summed_up(walked, (GATES, ORDER + 2))
        seen = sums[:, -1] > 0
        model["weights"] = model["weights"].copy()
        model["weights"][seen] = sums[seen, :-1] / sums[seen, -1:]
    weights = model["weights"]
    model["map"] = adaptive_map(summed_up(
        lambda key, n, counts: map_counts(key, n, counts, weights), (GATES * PLACES, 2)))
    return model


# ---- scoring ----

ENTRIES = "kind long, block long, k1 array<long>, k2 array<long>, value array<double>"


def _entries(kind: int, rows: pa.Table, k1, k2, value):
    """Entries of the blocks in the rows' lists, packed by block, some rows at a time."""
    held = np.cumsum(pc.list_value_length(rows.column("blocks")).to_numpy()) // PACKED
    edges = [0, *(np.flatnonzero(np.diff(held)) + 1).tolist(), len(held)]
    for lo, hi in zip(edges, edges[1:]):
        if lo < hi:
            blocks = rows.column("blocks").slice(lo, hi - lo).combine_chunks()
            owner = pc.list_parent_indices(blocks).to_numpy(zero_copy_only=False) + lo
            yield _packed(["kind", "block", "k1", "k2", "value"],
                          blocks.flatten().to_numpy(zero_copy_only=False), lambda x: [kind, x],
                          [k1[owner], k2[owner] if kind else k2, value[owner]])


def dictionaries(table: DataFrame, model: dict) -> DataFrame:
    """The cost in bits of every window of a block and the training count of every word,
    packed by block."""
    shorts, plain = model["shorts"], {k: v for k, v in model.items() if k != "shorts"}
    shared = table.sparkSession.sparkContext.broadcast(plain)

    def costs(batches):
        got = _gathered(batches)
        if got:
            key, n, at, rows = got
            bits = window_bits(key, context_counts(key, n, shorts.value), shared.value)[at]
            yield from _entries(0, rows, rows.column("k1").to_numpy(), np.empty(0, np.int64), bits)

    def counts(batches):
        def entries(got):
            rows = pa.Table.from_batches(got)
            return _entries(1, rows, *(rows.column(c).to_numpy() for c in ("k1", "k2")),
                            rows.column("n").to_numpy().astype(float))
        got, held = [], 0
        for b in batches:
            got.append(b)
            held += len(b.column(3).flatten())
            if held > PACKED:
                yield from entries(got)
                got, held = [], 0
        if got:
            yield from entries(got)
    counted_words = table.where("kind = 1").select("k1", "k2", "n", "blocks")
    return (_dealt(table, model["parts"], "blocks").mapInArrow(costs, ENTRIES)
            .unionByName(counted_words.mapInArrow(counts, ENTRIES)))


SCORED = ("doc_id long, n_tokens long, n_known long, base_score double, score double, "
          "bits_per_byte double")


def _word_index(k1: np.ndarray, k2: np.ndarray, value: np.ndarray):
    """Function from word keys to values. First halves that clash are settled by the second."""
    order = np.lexsort((k2, k1))
    k1, k2, value = k1[order], k2[order], value[order]

    def of(keys: np.ndarray) -> np.ndarray:
        at = np.searchsorted(k1, keys[:, 0])
        while True:
            off = np.flatnonzero(k2[at] != keys[:, 1])
            if not len(off):
                return value[at]
            at[off] += 1
    return of


def scored(rows: DataFrame, entries: DataFrame, totals: dict) -> DataFrame:
    """Scores of the documents of each block from its dictionary."""
    n_all, kinds, n_docs = totals["tokens"], totals["kinds"], totals["docs"]
    below = n_all + SMOOTH * (kinds + 1)

    def log10(c):
        return np.log10((c + SMOOTH) / below)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        import pandas as pd
        _, _, k1, value = _unpacked(left, 0, ["k1", "value"])
        wins, position = np.unique(k1, return_index=True)
        cost = value[position]
        place = pd.Index(wins)
        word_value = _word_index(*_unpacked(left, 1, ["k1", "k2", "value"])[2:])
        text = right.column("text")
        held = np.cumsum(pc.binary_length(text).fill_null(0).to_numpy()) // SLICE
        edges = [0, *(np.flatnonzero(np.diff(held)) + 1).tolist(), len(held)]
        parts = []
        for lo, hi in zip(edges, edges[1:]):
            if lo == hi:
                continue
            some = lowered(text.slice(lo, hi - lo).combine_chunks())
            key, n = windows(some)
            bits = np.add.reduceat(cost[place.get_indexer(key)], np.cumsum(n) - n)
            code, distinct, m = words(some)
            count = word_value(word_keys(distinct)) if len(distinct) else np.empty(0)
            doc = np.repeat(np.arange(hi - lo), m)
            base = np.bincount(doc, log10(count)[code], hi - lo) + log10(n_docs)
            known = np.bincount(doc, (count > 0)[code], hi - lo) + (n_docs > 0)
            parts.append((m + 1, known.astype(np.int64), base, bits * -np.log10(2), bits / n))
        cols = [np.concatenate(c) for c in zip(*parts)]
        return pa.table([right.column("doc_id"), *cols],
                        names=["doc_id", "n_tokens", "n_known", "base_score", "score", "bits_per_byte"])

    docs = rows.select("block", "doc_id", "text")
    return (entries.groupBy("block").cogroup(docs.groupBy("block"))
            .applyInArrow(run, SCORED))


def score_documents(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """One row per document: tokens, known tokens, base score, the model's log10 probability
    and its bits per byte (the end counts as a byte)."""
    rows = blocked(docs)
    of = rows.agg(F.sum("size").alias("bytes"), F.sum(F.col("train").cast("long")).alias("docs")).first()
    parts = 1 + (of.bytes or 0) // TABLE_BYTES
    table = summed(counted(rows, parts), parts)
    model = learn(table, rounds)
    told = table.where("kind = 1 AND part = 0").agg(
        F.sum("n").alias("n"), F.sum((F.col("n") > 0).cast("long")).alias("kinds")).first()
    n_docs = of.docs or 0
    totals = {"tokens": (told.n or 0) + n_docs, "kinds": (told.kinds or 0) + (n_docs > 0),
              "docs": n_docs}
    held = ~F.coalesce(learnable(F.col("doc_id"), MODULUS, HELD_OUT), F.lit(True))
    return scored(rows, dictionaries(table, model), totals).select(
        "doc_id", held.alias("held_out"), "n_tokens", "n_known",
        F.lit(totals["tokens"]).cast("long").alias("train_tokens"), "base_score", "score",
        "bits_per_byte")
