"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A word's vector is the mean of the vectors of its character n-grams (between boundary marks,
hashed into ``BUCKETS``), so an unseen misspelling shares most of its vector with the word it
misspells. A window is ``WINDOW`` consecutive words; its vector is the mean of its words'
vectors, and a linear softmax over two classes gives its logit. A document's logit pools all
its windows, so a few words in a long text still count. Embeddings and softmax are trained
jointly in numpy with Adam on a smooth maximum over windows; a two-parameter logistic fit then
turns the document logit (the maximum over windows) into a probability.

Bounds: fitted on at most about ``MAX_TOXIC`` and ``MAX_CLEAN`` labelled documents, and on at most
about ``MAX_CHARS`` characters of each class: whole texts of fewer documents where texts are
long. Scoring reads every word of every text.

Defined results: a text without words scores 0; rows
without id or label teach nothing; with one class or none among the labels every score is 0;
repeated rows score alike; other columns are not read.
"""

from __future__ import annotations

import re
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.llm.common import HASH_CUT, binary_labels, bounded_sample, learnable, map_texts
from riskloom.llm.subwords import word_grams

BUCKETS, DIM = 1 << 16, 8
LEAST, MOST = 3, 6
WINDOW, STEP = 4, 2
MAX_TOXIC, MAX_CLEAN, MAX_CHARS = 2_000, 4_000, 24_000_000
EPOCHS, RATE, SHARP, DECAY = 60, 0.05, 6.0, 1e-4
CHUNK = 20_000
SEED = 23
CUT = 0.7
#: crc32(doc_id as text) mod 3 = 1 is held out.
MODULUS, HELD_OUT = 3, 1
WORDS = re.compile(r"\w+(?:[^\w\s]+\w+)*")


def words_of(text: str | None) -> list[str]:
    """Words in lower case; a run of one word counts once, as it is evidence only once."""
    return [w for w, _ in groupby(WORDS.findall((text or "").lower()))]


def window_starts(n: int) -> np.ndarray:
    """First words of the windows over ``n`` words: every ``STEP``, and the last full one."""
    if n <= WINDOW:
        return np.zeros(1, np.int64)
    return np.unique(np.append(np.arange(0, n - WINDOW + 1, STEP), n - WINDOW))


def training_words(text: str | None) -> str:
    """Words of the whole text, one a line."""
    return "\n".join(words_of(text))


def training_rows(docs: DataFrame, labels: DataFrame, column: str) -> DataFrame:
    """(y, words) of the bounded labelled sample: whole texts, thinned by a hash of the id where
    the rows have more than ``MAX_CHARS`` characters. The sampled labels are bounded, so they
    are broadcast and no text is shuffled."""
    known = binary_labels(labels, column).where(learnable(F.col("doc_id"), MODULUS, HELD_OUT))
    known = bounded_sample(known.where("y = 1"), ["doc_id"], MAX_TOXIC, SEED).unionByName(
        bounded_sample(known.where("y = 0"), ["doc_id"], MAX_CLEAN, SEED))
    rows = (docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
            .select("doc_id", "text", "y"))
    chars = {r.y: r.n or 0 for r in rows.groupBy("y").agg(F.sum(F.length("text")).alias("n")).collect()}
    for y, n in chars.items():
        if n > MAX_CHARS:
            h = F.pmod(F.xxhash64("doc_id", F.lit(SEED + 1)), F.lit(HASH_CUT))
            rows = rows.where((F.col("y") != y) | (h < int(HASH_CUT * MAX_CHARS / n)))
    field = T.StructField("words", T.StringType())
    return map_texts(rows.select("text", "y"), lambda: lambda ts: {"words": [training_words(t) for t in ts]},
                     [field], ["y"])


def _pool(z: np.ndarray, first: np.ndarray, sharp: float) -> tuple[np.ndarray, np.ndarray]:
    """Smooth maximum of the windows' logits per document, and each window's weight in it."""
    top = np.maximum.reduceat(z, first)
    of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(z))))
    e = np.exp(sharp * (z - top[of]))
    total = np.add.reduceat(e, first)
    return top + np.log(total / np.diff(np.append(first, len(z)))) / sharp, e / total[of]


class Adam:
    def __init__(self, *shapes):
        self.m = [np.zeros(s) for s in shapes]
        self.v = [np.zeros(s) for s in shapes]
        self.t = 0

    def step(self, params: list, grads: list, rate: float) -> None:
        self.t += 1
        for p, g, m, v in zip(params, grads, self.m, self.v):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= rate * (m / (1 - 0.9 ** self.t)) / (np.sqrt(v / (1 - 0.999 ** self.t)) + 1e-8)


def grams_in_chunks(words: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets, n-grams of each word) for ``CHUNK`` words at a time, in word order."""
    out = []
    for i in range(0, len(words), CHUNK):
        ids, of = word_grams(words[i:i + CHUNK], LEAST, MOST, BUCKETS)
        out.append((ids[np.argsort(of, kind="stable")].astype(np.uint16),
                    np.bincount(of, minlength=len(words[i:i + CHUNK]))))
    return out


def word_scores(u: np.ndarray, chunks: list) -> np.ndarray:
    """Mean of ``u`` over the n-grams of every word."""
    return np.concatenate([
        np.add.reduceat(u[ids], np.concatenate(([0], np.cumsum(n)[:-1]))) / n
        for ids, n in chunks])


def fit(docs: list[str], y: np.ndarray) -> dict | None:
    """Model from ``training_words`` and 0/1 labels; None unless both classes are there."""
    keep = [i for i, d in enumerate(docs) if d]
    y = np.asarray(y)[keep].astype(float)
    if not len(y) or y.min() == y.max():
        return None
    numbers: dict[str, int] = {}
    coded = [np.array([numbers.setdefault(w, len(numbers)) for w in docs[i].split("\n")],
                      np.int32) for i in keep]
    n = np.array([len(d) for d in coded])
    code, n_words = np.concatenate(coded), len(numbers)
    chunks = grams_in_chunks(list(numbers))
    del coded, numbers
    base = np.concatenate(([0], np.cumsum(n)[:-1]))
    starts = [window_starts(k) + b for k, b in zip(n, base)]
    first = np.concatenate(([0], np.cumsum([len(s) for s in starts])[:-1]))
    lo = np.concatenate(starts)
    hi = np.minimum(lo + WINDOW, np.repeat(base + n, [len(s) for s in starts]))
    size = (hi - lo).astype(float)
    rng = np.random.default_rng(SEED)
    emb = rng.normal(0, 0.1, (BUCKETS, DIM))
    soft, bias = rng.normal(0, 0.3, (DIM, 2)), np.zeros(2)
    adam = Adam(emb.shape, soft.shape, bias.shape)
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    weight /= weight.sum()
    for _ in range(EPOCHS):
        d = soft[:, 1] - soft[:, 0]
        u = (emb @ d).astype(np.float32)
        s = word_scores(u, chunks)[code]
        run = np.concatenate(([0.0], np.cumsum(s)))
        z = (run[hi] - run[lo]) / size + bias[1] - bias[0]
        logit, share = _pool(z, first, SHARP)
        g = weight * (1 / (1 + np.exp(-logit)) - y)
        gz = share * np.repeat(g, np.diff(np.append(first, len(z))))
        # Back through the window means: each word gets the sum over its windows.
        edge = np.bincount(lo, gz / size, len(code) + 1) - np.bincount(hi, gz / size, len(code) + 1)
        gs = np.bincount(code, np.cumsum(edge)[:-1], n_words)
        gu, at = np.zeros(BUCKETS), 0
        for ids, count in chunks:
            gu += np.bincount(ids, np.repeat(gs[at:at + len(count)] / count, count), BUCKETS)
            at += len(count)
        gd = emb.T @ gu
        adam.step([emb, soft, bias],
                  [np.outer(gu, d) + DECAY * emb, np.stack([-gd, gd], 1) + DECAY * soft,
                   np.array([-gz.sum(), gz.sum()])], RATE)
    u = (emb @ (soft[:, 1] - soft[:, 0])).astype(np.float32)
    run = np.concatenate(([0.0], np.cumsum(word_scores(u, chunks)[code])))
    top = np.maximum.reduceat((run[hi] - run[lo]) / size, first)
    a, b = logistic(top + bias[1] - bias[0], y, weight)
    return {"u": u, "bias": float(bias[1] - bias[0]), "a": a, "b": b}


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a weighted, lightly damped one-feature logistic regression."""
    a, b = 1.0, 0.0
    x = np.asarray(x, float)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        r, w = weight * (p - y), weight * p * (1 - p) + 1e-9
        g = np.array([(r * x).sum() + 1e-4 * a, r.sum()])
        h = np.array([[(w * x * x).sum() + 1e-4, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-6]])
        da, db = np.clip(np.linalg.solve(h, g), -2, 2)
        a, b = a - da, b - db
    return float(a), float(b)


def logits(model: dict, docs: list[list[str]]) -> np.ndarray:
    """Maximum over all windows of each document's words; minus infinity without words."""
    out = np.full(len(docs), -np.inf)
    words = [w for d in docs for w in d]
    if not words:
        return out
    code, vocab = pd.factorize(np.array(words, dtype=object))
    s = word_scores(model["u"], grams_in_chunks(list(vocab)))[code]
    run, at = np.concatenate(([0.0], np.cumsum(s))), 0
    for i, d in enumerate(docs):
        if d:
            lo = window_starts(len(d)) + at
            hi = np.minimum(lo + WINDOW, at + len(d))
            out[i] = model["bias"] + ((run[hi] - run[lo]) / (hi - lo)).max()
            at += len(d)
    return out


def scores(model: dict | None, texts: list) -> np.ndarray:
    if model is None:
        return np.zeros(len(texts))
    x = logits(model, [words_of(t) for t in texts])
    p = 1 / (1 + np.exp(-np.clip(model["a"] * x + model["b"], -30, 30)))
    return np.where(np.isfinite(x), p, 0.0)


def train(docs: DataFrame, labels: DataFrame, column: str = "toxic") -> dict | None:
    """The model; the driver holds the bounded sample only."""
    rows = training_rows(docs, labels, column).toPandas()
    return fit(rows["words"].tolist(), rows["y"].to_numpy())


def score_documents(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    keyed = docs.select("doc_id", "text")
    out = map_texts(keyed, lambda: lambda ts: {"score": scores(model, ts).tolist()},
                    [T.StructField("score", T.DoubleType())], ["doc_id"])
    held = ~F.coalesce(learnable(F.col("doc_id"), MODULUS, HELD_OUT), F.lit(True))
    return out.select("doc_id", held.alias("held_out"), "score",
                      (F.col("score") >= CUT).cast("int").alias("predicted"))
