"""Periodic runs against a scan of every lag at every place."""

import hashlib
import random
import re
import zlib

import numpy as np

from riskloom.llm import periodic, queries
from tests.llm.cases import SF, edge_documents


def brute_runs(w, least=12):
    """Every lag over every place."""
    code = np.unique(np.array(w, dtype=object), return_inverse=True)[1] if len(w) else np.empty(0)
    found, n = {}, len(w)
    for q in range(1, n // 2 + 1):
        same = np.concatenate(([0], code[:-q] == code[q:], [0])).astype(np.int8)
        edge = np.diff(same)
        for i, j in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
            if j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q), q)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def brute_row(doc_id, text, plant=True):
    w = re.findall("[^\x20\x09-\x0d]+", text or "")
    n = len(w)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if plant and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    runs = brute_runs(w)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    top = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *top, 1000 * top[1] // top[2] if runs else None,
            sha("".join("%d,%d,%d\n" % r for r in runs)),
            sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def random_sequences(seed, cases):
    rng = random.Random(seed)
    for _ in range(cases):
        docs = []
        for _ in range(rng.randint(1, 5)):
            w = []
            for _ in range(rng.randint(0, 6)):
                k = rng.randint(1, rng.choice([2, 3, 8, 40]))
                base = [rng.randint(0, rng.choice([1, 2, 3, 30])) for _ in range(k)]
                w += base * rng.randint(1, 6) + base[:rng.randint(0, k)]
            docs.append(w)
        yield docs


def test_runs_equal_brute_force():
    for docs in random_sequences(3, 600):
        code = np.array([x for w in docs for x in w], np.int64)
        doc = np.repeat(np.arange(len(docs)), [len(w) for w in docs]).astype(np.int64)
        off = np.cumsum([0, *map(len, docs)])
        want = [(s + off[d], length, q) for d, w in enumerate(docs) for s, length, q in brute_runs(w)]
        assert [tuple(r) for r in periodic.find_runs(code, doc).tolist()] == want


def test_splitting_loses_no_word_of_a_run():
    dropped = 0
    for docs in random_sequences(4, 200):
        for w in docs:
            at, _ = periodic.split(np.array(w, np.int64), np.zeros(len(w), np.int64))
            inside = {i for s, length, _ in brute_runs(w) for i in range(s, s + length)}
            assert inside <= set(at.tolist())
            dropped += len(w) - len(at)
    assert dropped > 1000


def test_long_sequences():
    for w, runs in ((np.zeros(200_000, np.int64), [[0, 200_000, 1]]),
                    (np.arange(200_001) % 7, [[0, 200_001, 7]]),
                    (np.arange(60_000) // 2 * (np.arange(60_000) % 2), None)):
        got = periodic.find_runs(w, np.zeros(len(w), np.int64)).tolist()
        assert runs is None or got == runs


COLUMNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256",
           "collapsed_sha256")


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = queries.op13_periodic_runs(spark, SF)
    assert tuple(got.columns) == COLUMNS
    want = [brute_row(r.doc_id, r.text) for r in docs]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert sum(r[1] > 0 for r in want) > 5


def test_edge_texts(spark):
    docs = edge_documents(spark)
    found = periodic.periodic_runs(docs, ["doc_id"], rearrange=periodic.looped)
    got = [tuple(r) for r in periodic.digest(found).collect()]
    assert sorted(map(str, got)) == sorted(
        str(brute_row(r.doc_id, r.text)) for r in docs.collect())
    assert periodic.digest(periodic.periodic_runs(docs.limit(0), ["doc_id"])).count() == 0


def test_operator_gives_texts_and_spans(spark):
    docs = spark.createDataFrame([(1, "x a b c a b c a b c a b c y", 9), (2, None, 9)],
                                 "doc_id long, text string, n_words long")
    got = {r.doc_id: r for r in periodic.periodic_runs(docs, ["doc_id"]).collect()}
    assert got[1].collapsed == "x a b c y" and got[1].n_words == 14
    assert [tuple(r) for r in got[1].runs] == [(1, 12, 3)]
    assert got[2].collapsed == "" and got[2].runs == []
