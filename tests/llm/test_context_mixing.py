"""Context mixing: the base score and the model's bits against plain dictionaries, the bit
probabilities as a distribution, and held-out bits against single contexts."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.llm import context_mixing as cm
from riskloom.llm import queries
from tests.llm.cases import SF, edge_documents


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def learns(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 != 0


def brute_base(docs):
    """{(doc_id, text): (held_out, n_tokens, n_known, N, base)}; the end is token None."""
    tokens = [(i, t, [*re.findall("[^\x20\x09-\x0d]+", lower(t)), None]) for i, t in docs]
    count = Counter(w for i, _, ws in tokens if learns(i) for w in ws)
    total = sum(count.values())
    below = total + 0.1 * (len(count) + 1)
    return {(i, t): (i is not None and not learns(i), len(ws), sum(count[w] > 0 for w in ws), total,
                     sum(math.log10((count[w] + 0.1) / below) for w in ws)) for i, t, ws in tokens}


def places(text):
    """(five bytes before, nearest first; byte) of every place."""
    b = bytes([0xFF]) * 5 + lower(text).encode() + b"\xff"
    return [(bytes(b[i - 1:i - 6 if i > 5 else None:-1]), b[i]) for i in range(5, len(b))]


class BruteModel:
    def __init__(self, docs, model):
        self.model, self.count = model, Counter()
        for i, t in docs:
            if learns(i):
                for context, byte in places(t):
                    for k in range(6):
                        c = context[:k]
                        if k == 2:  # two bytes are hashed into slots
                            c = int(cm.mix(np.array([c[0] << 8 | c[1]], np.uint64))[0]) % cm.SHORT_SLOTS
                        for j in range(9):
                            self.count[k, c, j, byte >> (8 - j)] += 1

    def bits(self, context, byte):
        out = 0.0
        for j in range(8):
            x, longest, often = [], 0, 0
            for k in range(6):
                c = context[:k]
                if k == 2:
                    c = int(cm.mix(np.array([c[0] << 8 | c[1]], np.uint64))[0]) % cm.SHORT_SLOTS
                seen = self.count[k, c, j, byte >> (8 - j)]
                came = self.count[k, c, j + 1, byte >> (7 - j)]
                x.append(math.log((came + 0.3) / (seen - came + 0.3)))
                if seen:
                    longest, often = k, seen
            level = min(int(math.log2(max(often, 1))) // 2, 3)
            gate = (longest * 4 + level) * 8 + j
            one = byte >> (7 - j) & 1
            z = (1 if one else -1) * float(self.model["weights"][gate] @ np.array(x))
            at = (min(max(z, -12.0), 12.0) + 12) * 24 / 24
            low = min(int(at), 23)
            row = self.model["map"][gate]
            p = (1 / (1 + math.exp(-z)) + row[low] * (1 - at + low) + row[low + 1] * (at - low)) / 2
            p = min(max(p, cm.LEAST_P), 1 - cm.LEAST_P)
            out -= math.log2(p if one else 1 - p)
        return out


@pytest.fixture(scope="module")
def scored(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return docs, {(r.doc_id): r for r in queries.op12_context_mixing(spark, SF).collect()}


def test_query_base_equals_brute_force(scored):
    docs, got = scored
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute_base(rows)
    assert len(got) == len(rows)
    for i, t in rows:
        r, w = got[i], want[i, t]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4]
        assert r.base_score == pytest.approx(w[4], rel=1e-9)


def test_model_bits_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("n_chars < 3000")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    blocks = cm.blocked(docs)
    table = cm.summed(cm.counted(blocks, 3), 3)
    model = cm.learn(table, rounds=2)
    got = {r.doc_id: r for r in cm.scored(blocks, cm.dictionaries(table, model),
                                          {"tokens": 9, "kinds": 5, "docs": 1}).collect()}
    brute = BruteModel(rows, model)
    for i, t in [r for r in rows if learns(r[0])][:6] + [r for r in rows if not learns(r[0])][:6]:
        bits = sum(brute.bits(c, b) for c, b in places(t))
        assert got[i].score == pytest.approx(-bits * math.log10(2), rel=1e-6)
        assert got[i].bits_per_byte == pytest.approx(bits / (len(lower(t).encode()) + 1), rel=1e-6)
    # After any context the probabilities of all bytes sum to one.
    for context in (b"\xff" * 5, b"eht \n"[::-1], b"zqxjk", places(rows[0][1])[40][0]):
        assert sum(2 ** -brute.bits(context, b) for b in range(256)) == pytest.approx(1, abs=1e-6)


def test_mixing_beats_single_contexts_on_held_out_texts(spark):
    docs = spark.read.parquet(f"/root/testdata/sf0.01/documents.parquet")
    blocks = cm.blocked(docs)
    table = cm.summed(cm.counted(blocks, 2), 2)
    model = cm.learn(table)
    totals = {"tokens": 9, "kinds": 5, "docs": 1}
    held = docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0).select("doc_id")

    def held_bits(m):
        got = cm.scored(blocks, cm.dictionaries(table, m), totals).join(held, "doc_id")
        return got.agg(F.sum("score")).first()[0] / -math.log10(2)
    size = blocks.join(held, "doc_id").agg(F.sum(F.col("size") + 1)).first()[0]
    mixed = held_bits(model) / size
    plain_map = cm.adaptive_map(np.zeros((cm.GATES * cm.PLACES, 2)))
    singles = []
    for k in range(cm.ORDER + 1):
        w = np.zeros((cm.GATES, cm.ORDER + 1))
        w[:, k] = 1
        singles.append(held_bits({**model, "weights": w, "map": plain_map}) / size)
    start = held_bits({**model, "weights": cm.start_weights(), "map": plain_map}) / size
    assert mixed < 0.95 * min(singles) and mixed < start


def test_edge_texts(spark):
    docs = edge_documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute_base(rows)
    got = cm.score_documents(docs, rounds=1).collect()
    assert sorted(map(str, ((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) for r in got))) == sorted(
        map(str, ((i, *want[i, t][:4]) for i, t in rows)))
    assert all(r.score < 0 and r.base_score < 0 for r in got)
    copies = {}
    for r in got:
        copies.setdefault(r.doc_id, set()).add((r.score, r.base_score))
    assert all(len(x) == 1 for x in copies.values())
    assert cm.score_documents(docs.limit(0)).count() == 0


def test_no_training_documents(spark):
    held = next(i for i in range(100) if not learns(i))
    docs = spark.createDataFrame([(held, "abc"), (None, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in cm.score_documents(docs).collect()}
    assert got[held].base_score == 0 and got[held].n_known == 0 and got[held].train_tokens == 0
    assert got[held].score == pytest.approx(-32 * math.log10(2)) and got[held].held_out
    assert got[None].n_tokens == 1 and not got[None].held_out
