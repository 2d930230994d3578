"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer
numpy network with temperature-calibrated probabilities.

Tokens are words in lower case and runs of punctuation; a mark precedes a word in capitals,
a capitalised word and a token equal to the one before. Tokens hash into ``VOCAB`` words. Each word has a sparse index
vector (``NONZERO`` signed ones, derived from the word); its context vector is the sum of the
index vectors of its neighbours within ``REACH`` places over all documents: tasks sum into a
table of fixed size, and one grouped sum adds the tables. A document is the mean of its
tokens' unit-length context vectors with their spread, and the logarithm of its length.

Bounds: the network is fitted on at most about ``MAX_LABELLED`` labelled documents, four fifths
for the weights and one fifth for the temperature. Context vectors cover all documents, and
scoring reads every token of every text.

Defined results: a text without tokens scores 0; rows without id or label teach nothing; with
one class or none among the labels every score is 0; repeated rows score alike; other columns
are not read.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.llm.common import (binary_labels, bounded_sample, learnable, map_texts,
                                 slices, tune)

VOCAB, DIM, NONZERO, REACH = 1 << 13, 16, 2, 2
MAX_LABELLED = 20_000
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 24, 60, 256, 0.01, 1e-4
SEED = 31
CUT = 0.5
#: crc32(doc_id as text) mod 3 = 1 is held out.
MODULUS, HELD_OUT = 3, 1
TOKENS = re.compile(r"\w+|[^\w\s]+")
UPPER, TITLE, AGAIN = (zlib.crc32(m.encode()) % VOCAB for m in ("<upper>", "<title>", "<again>"))
FEATURES = 2 * DIM + 1


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of every word's index vector."""
    rng = np.random.default_rng(SEED)
    return (rng.integers(0, DIM, (VOCAB, NONZERO)).astype(np.int32),
            rng.choice(np.array([-1.0, 1.0], np.float32), (VOCAB, NONZERO)))


def encode(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """(word, text number) of every token of the texts, in order."""
    found = [TOKENS.findall(t) if t else [] for t in texts]
    n = np.array([len(f) for f in found])
    flat = [w for f in found for w in f]
    if not flat:
        return np.empty(0, np.int32), np.empty(0, np.int64)
    code, kinds = pd.factorize(np.array(flat, dtype=object))
    word = np.array([zlib.crc32(k.lower().encode("utf-8", "surrogatepass")) % VOCAB
                     for k in kinds], np.int32)
    mark = np.array([UPPER if k.isupper() and len(k) > 1 else TITLE if k[0].isupper() else -1
                     for k in kinds], np.int32)
    text = np.repeat(np.arange(len(texts)), n)
    again = np.zeros(len(code), bool)
    again[1:] = (code[1:] == code[:-1]) & (text[1:] == text[:-1])
    # Each token may come with marks before it: a case mark, and one for a repetition.
    cells = np.stack([np.where(again, AGAIN, -1).astype(np.int32), mark[code], word[code]], 1)
    there = cells >= 0
    return cells[there], np.repeat(text, there.sum(1))


def add_contexts(total: np.ndarray, word: np.ndarray, text: np.ndarray, place: np.ndarray,
                 sign: np.ndarray) -> None:
    """Add the index vectors of the neighbours of every token to ``total`` (VOCAB x DIM)."""
    flat = total.reshape(-1)
    for d in range(1, REACH + 1):
        near = text[d:] == text[:-d]
        a, b = word[:-d][near], word[d:][near]
        for x, y in ((a, b), (b, a)):
            for k in range(NONZERO):
                flat += np.bincount(x * np.int64(DIM) + place[y, k], sign[y, k], flat.size)


def context_vectors(docs: DataFrame) -> np.ndarray:
    """Unit-length context vectors of all words over all documents. Each task returns one
    table of VOCAB rows; the grouped sum, and what reaches the driver, have that size too."""
    spark = docs.sparkSession
    tune(spark)
    schema = T.StructType([T.StructField("word", T.IntegerType()),
                           *[T.StructField(f"d{k}", T.LongType()) for k in range(DIM)]])

    def run(batches):
        place, sign = index_vectors()
        total = np.zeros((VOCAB, DIM))
        for b in batches:
            texts = b.column(0).to_pylist()
            for lo, hi in slices(texts):
                add_contexts(total, *encode(texts[lo:hi]), place, sign)
        seen = np.flatnonzero(total.any(axis=1))
        if len(seen):
            out = total[seen].astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(seen.astype(np.int32)), *[pa.array(out[:, k]) for k in range(DIM)]],
                names=[f.name for f in schema])

    sums = (docs.select("text").mapInArrow(run, schema).groupBy("word")
            .agg(*[F.sum(f"d{k}").alias(f"d{k}") for k in range(DIM)]))
    got = sums.toPandas()
    out = np.zeros((VOCAB, DIM))
    out[got["word"].to_numpy(dtype=int)] = got[[f"d{k}" for k in range(DIM)]].to_numpy(dtype=float)
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(vectors: np.ndarray, texts: list) -> np.ndarray:
    """Mean and spread of the token vectors, and log length; NaN rows for empty texts."""
    word, text = encode(texts)
    n = np.bincount(text, minlength=len(texts)).astype(float)
    out = np.full((len(texts), FEATURES), np.nan)
    some = np.flatnonzero(n)
    if len(some):
        first = np.searchsorted(text, some)
        # In steps of one column: no tokens-by-dimensions table is built.
        for k in range(DIM):
            v = vectors[:, k][word]
            mean = np.add.reduceat(v, first, dtype=np.float64) / n[some]
            out[some, k] = mean
            out[some, DIM + k] = np.sqrt(np.maximum(
                np.add.reduceat(v * v, first, dtype=np.float64) / n[some] - mean ** 2, 0))
        out[some, -1] = np.log1p(n[some])
    return out


def _forward(net: dict, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = np.tanh((x - net["mean"]) / net["std"] @ net["w1"] + net["b1"])
    return h, h @ net["w2"] + net["b2"]


def fit(x: np.ndarray, y: np.ndarray) -> dict | None:
    """Network and temperature; None unless both classes are there."""
    good = ~np.isnan(x).any(axis=1)
    x, y = x[good], np.asarray(y, float)[good]
    rng = np.random.default_rng(SEED)
    order = rng.permutation(len(y))
    x, y = x[order], y[order]
    held = np.arange(len(y)) % 5 == 0
    if not len(y) or y.min() == y.max():
        return None
    a, b = x[~held], y[~held]
    net = {"mean": a.mean(0), "std": a.std(0) + 1e-6,
           "w1": rng.normal(0, FEATURES ** -0.5, (FEATURES, HIDDEN)), "b1": np.zeros(HIDDEN),
           "w2": rng.normal(0, HIDDEN ** -0.5, HIDDEN), "b2": np.zeros(1), "temperature": 1.0}
    names = ("w1", "b1", "w2", "b2")
    first = {k: np.zeros_like(net[k]) for k in names}
    second = {k: np.zeros_like(net[k]) for k in names}
    step = 0
    for _ in range(EPOCHS):
        mixed = rng.permutation(len(b))
        for i in range(0, len(b), BATCH):
            at = mixed[i:i + BATCH]
            h, z = _forward(net, a[at])
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - b[at]) / len(at)
            gh = np.outer(g, net["w2"]) * (1 - h * h)
            grads = {"w1": ((a[at] - net["mean"]) / net["std"]).T @ gh, "b1": gh.sum(0),
                     "w2": h.T @ g, "b2": np.array([g.sum()])}
            step += 1
            for k in names:
                d = grads[k] + DECAY * net[k]
                first[k] += 0.1 * (d - first[k])
                second[k] += 0.001 * (d * d - second[k])
                net[k] = net[k] - RATE * (first[k] / (1 - 0.9 ** step)) / (
                    np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)
    # The temperature that gives the held-out fifth the least log loss.
    z, t = _forward(net, x[held])[1], y[held]
    tries = np.exp(np.linspace(np.log(0.2), np.log(10), 60))
    loss = [np.logaddexp(0, -np.where(t == 1, z, -z) / k).mean() if len(t) else 0 for k in tries]
    return net | {"temperature": float(tries[int(np.argmin(loss))]) if len(t) else 1.0}


def probabilities(net: dict | None, x: np.ndarray) -> np.ndarray:
    if net is None:
        return np.zeros(len(x))
    z = _forward(net, np.nan_to_num(x))[1] / net["temperature"]
    return np.where(np.isnan(x).any(axis=1), 0.0, 1 / (1 + np.exp(-np.clip(z, -30, 30))))


def train(docs: DataFrame, labels: DataFrame, vectors: np.ndarray,
          column: str = "quality") -> dict | None:
    """Network from the bounded labelled sample; the sampled labels are broadcast, so no text
    is shuffled, and the driver gets pooled vectors only."""
    known = binary_labels(labels, column).where(learnable(F.col("doc_id"), MODULUS, HELD_OUT))
    known = bounded_sample(known, ["doc_id"], MAX_LABELLED, SEED)
    rows = (docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
            .select("text", "y"))
    field = T.StructField("x", T.ArrayType(T.DoubleType()))
    got = map_texts(rows, lambda: lambda ts: {"x": pooled(vectors, ts).tolist()},
                    [field], ["y"]).toPandas()
    x = np.array(got["x"].tolist(), float).reshape(-1, FEATURES)
    return fit(x, got["y"].to_numpy())


def score_documents(docs: DataFrame, vectors: np.ndarray, net: dict | None) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    out = map_texts(docs.select("doc_id", "text"),
                    lambda: lambda ts: {"score": probabilities(net, pooled(vectors, ts)).tolist()},
                    [T.StructField("score", T.DoubleType())], ["doc_id"])
    held = ~F.coalesce(learnable(F.col("doc_id"), MODULUS, HELD_OUT), F.lit(True))
    return out.select("doc_id", held.alias("held_out"), "score",
                      (F.col("score") >= CUT).cast("int").alias("predicted"))
