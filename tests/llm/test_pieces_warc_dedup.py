"""SentencePiece against the public library, WARC round trips, near-duplicates against all
pairs, and the pipeline."""

import base64
import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from riskloom.llm import (decontaminate, near_dedup, pieces, quality_rules, secret_scan, warc)
from tests.llm.cases import EDGE_TEXTS, SF, documents, edge_documents, rows_of


# ---- SentencePiece ----

def odd_texts():
    rng = np.random.default_rng(0)
    letters = [*"aeinst▁ .,1é\n|", "th", "ing", "  "]
    return ["".join(rng.choice(letters, rng.integers(1, 60))) for _ in range(400)] + [
        "".join(chr(c) for c in rng.integers(1, 0x2FFF, 30)) for _ in range(100)] + [
        " ", "  a", "日本語 текст 12345 \n\n x\t y", "aaaaaaaaaaaa", "<s> <0x0A> 😀",
        " " * 40 + "x" + " " * 17, "the" * 50]


def test_ids_equal_the_library(spark):
    ref = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL_PATH)
    texts = [*EDGE_TEXTS, *odd_texts()] + [r.text for r in documents(spark).collect()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = pieces.encode_documents(docs, ["doc_id"])
    for r in out.collect():
        t = texts[r.doc_id]
        if t is None:
            assert r.ids is None and r.round_trip is None
        else:
            assert r.ids == ref.encode(t) and r.round_trip, t[:80]
    back = {r.doc_id: r.text for r in pieces.decode_documents(out, ["doc_id"]).collect()}
    assert all(back[i] == (t and t.replace("▁", " ")) for i, t in enumerate(texts))


def test_unigram_viterbi_is_the_best_segmentation():
    """Against trying every segmentation."""
    rng = np.random.default_rng(3)
    words = sorted({"".join(rng.choice(list("abc"), rng.integers(1, 4))) for _ in range(30)} | set("abc"))
    vocab = [("<unk>", 0.0, pieces.UNKNOWN), *[(w, -float(rng.random() * 9 + 1), pieces.NORMAL)
                                               for w in ["▁", *words]]]
    v = pieces.Vocabulary(vocab, pieces.UNIGRAM)

    def best(t):
        score = {0: (0.0, [])}
        for j in range(1, len(t) + 1):
            score[j] = max((score[i][0] + v.score[v.ids[t[i:j]]], score[i][1] + [v.ids[t[i:j]]])
                           for i in range(j) if t[i:j] in v.ids)
        return score[len(t)][1]
    texts = ["".join(rng.choice(list("abc"), rng.integers(1, 25))) for _ in range(200)]
    ids, at = pieces.Encoder(v).encode(texts)
    for k, t in enumerate(texts):
        own = ids[at[k]:at[k + 1]]
        assert "".join(v.texts[i] for i in own) == "▁" + t
        # Orders of the same pieces tie, so the totals are compared.
        assert np.isclose(v.score[own].sum(), v.score[best("▁" + t)].sum())


def test_characters_outside_a_vocabulary_without_bytes():
    v = pieces.Vocabulary([("<unk>", 0.0, pieces.UNKNOWN), ("▁", -1.0, 1), ("a", -2.0, 1)], pieces.BPE)
    ids, at = pieces.Encoder(v).encode(["aéa", "", None])
    assert ids.tolist() == [1, 2, 0, 2] and at.tolist() == [0, 4, 4, 4]


# ---- WARC ----

FAKE = ("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x-page:999>\r\n"
        "Content-Length: 5\r\n\r\nhello\r\n\r\n")


def pages(spark):
    rows = [(i, f"http://x/{i}", ("<p>é %d</p>" % (i % 7)) * (i % 5) + FAKE * (i % 9 == 0)
             + "\r\n\r\nWARC/1.1\r\nfoo" * (i % 11 == 0) + "WARC/1.1\r\n" * (i % 13 == 0))
            for i in range(150)]
    rows += [(None, "u\r\nv", "x"), (7777, None, None), (5, "a", "dup"), (5, "a", "dup"),
             (None, None, "q"), (None, None, "q"),
             (8888, None, "z" * 3000 + FAKE * 40 + "WARC/1.1\r\n" * 30),
             (8889, None, "z" * 3000 + FAKE * 40 + "WARC/1.1\r\n" * 30)]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)


def expected(rows):
    top = defaultdict(lambda: None)
    for i, _, h in rows:
        if i is not None:
            top[h or ""] = max(i, top[h or ""] if top[h or ""] is not None else i)
    out = []
    for i, _, h in rows:
        raw, t = (h or "").encode(), top[h or ""]
        again = t is not None and t != i
        out.append(str((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(),
                        "revisit" if again else "response", t if again else None)))
    return sorted(out)


@pytest.mark.parametrize("compression,segment,split", [("gzip", 4096, "128m"), ("none", 7, "4096")])
def test_archives_come_back(spark, workdir, monkeypatch, compression, segment, split):
    rows, df = pages(spark)
    monkeypatch.setattr(warc, "SEGMENT", segment)
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        warc.write_warc(df, f"{workdir}/a", compression=compression)
        for payload in (True, False):
            got = warc.read_warc(spark, f"{workdir}/a", payload).collect()
            assert sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type,
                               r.refers_to)) for r in got) == expected(rows)
            if payload:
                want = Counter((h or "") for (i, _, h), e in zip(rows, map(str, rows))
                               if h is not None or i is not None)
                texts = Counter(bytes(r.payload).decode() for r in got if r.payload is not None)
                assert set(texts) == set(want)
        assert warc.broken_archives(spark, f"{workdir}/a").count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "128m")


def test_empty_and_truncated_archives(spark, workdir):
    _, df = pages(spark)
    warc.write_warc(df.limit(0), f"{workdir}/none")
    assert warc.read_warc(spark, f"{workdir}/none").count() == 0
    warc.write_warc(df.coalesce(1), f"{workdir}/all", compression="none")
    text = [p for p in __import__("glob").glob(f"{workdir}/all/part-*")][0]
    with open(text, "rb") as f:
        whole = f.read()
    __import__("os").mkdir(f"{workdir}/cut")
    with open(f"{workdir}/cut/a.warc", "wb") as f:
        f.write(whole[:len(whole) // 2])
    n = warc.read_warc(spark, f"{workdir}/cut").count()
    assert 0 < n < df.count()
    assert warc.broken_archives(spark, f"{workdir}/cut").count() == 1


@pytest.mark.parametrize("inner", [False, True])
def test_last_record_cut_anywhere(spark, workdir, inner):
    """The last record is read exactly if its block is whole, whether or not payloads of the
    file hold magic lines."""
    import glob
    import os
    trick = "WARC/1.1\r\nWARC-Type: response\r\n" if inner else "plain"
    df = spark.createDataFrame([(1, "http://a/", f"<p>{trick} one</p>"), (2, "http://b/", f"<b>{trick} two</b>")],
                               "page_id long, url string, html string")
    warc.write_warc(df.coalesce(1), f"{workdir}/all", compression="none")
    whole = b"".join(open(p, "rb").read() for p in sorted(glob.glob(f"{workdir}/all/part-*")))
    os.mkdir(f"{workdir}/cut")
    from riskloom.llm.warc import END, MAGIC
    full = {r.q: r for r in warc.read_warc(spark, f"{workdir}/all").collect()}
    last = max(full)
    assert len(full) >= 2 and whole.startswith(MAGIC, last)
    size = len(whole)
    cuts = sorted({*range(last, last + 30), *range(last, size, 9), *range(size - 20, size + 1)})
    for n in cuts:
        with open(f"{workdir}/cut/{n:06d}.warc", "wb") as f:
            f.write(whole[:n])
    got = Counter(os.path.basename(r.file) for r in warc.read_warc(spark, f"{workdir}/cut").collect())
    for n in cuts:
        want = len(full) - (n < size - len(END))
        assert got[f"{n:06d}.warc"] == want, n


# ---- near-duplicates ----

def brute_classes(docs):
    """doc_id list -> smallest doc_id of its component, from all pairs."""
    bags = [near_dedup.bag_of(t) for _, t in docs]
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    where = defaultdict(set)
    for i, b in enumerate(bags):
        for s in b:
            where[s].add(i)
    for i, b in enumerate(bags):
        for j in {j for s in b for j in where[s] if j < i}:
            if near_dedup.overlap(b, bags[j]) >= near_dedup.THRESHOLD:
                parent[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(docs)):
        groups[find(i)].append(docs[i][0])
    return {d: min(g) for g in groups.values() for d in g}


def test_registers_estimate_the_weighted_overlap():
    rng = np.random.default_rng(5)
    for n, edits, times in ((30, 2, 1), (200, 9, 1), (40, 3, 6), (1000, 40, 2), (4, 0, 1)):
        a = [f"w{k}" for k in rng.integers(0, 900, n)] * times
        b = list(a)
        for k in rng.integers(0, len(a), edits):
            b[k] = "edit"
        r, _ = near_dedup.registers([" ".join(a), " ".join(b)], m=3000)
        exact = near_dedup.overlap(near_dedup.bag_of(" ".join(a)), near_dedup.bag_of(" ".join(b)))
        assert abs((r[0] == r[1]).mean() - exact) < 0.04


def families(spark):
    """Chains of near copies, copies of them, and documents that share half their text."""
    rng = np.random.default_rng(9)
    word = lambda n: [f"v{k}" for k in rng.integers(0, 5000, n)]
    out = []
    for _ in range(3):
        t = word(120)
        for _ in range(6):
            t = list(t)
            t[rng.integers(0, 120)] = "new%d" % rng.integers(0, 10_000)
            out += [" ".join(t)] * rng.integers(1, 3)
    common = word(60)
    out += [" ".join(common + word(30)) for _ in range(10)]
    out += [" ".join(word(80)) for _ in range(10)] + ["a b c", "a b c", "a  b c", "d e f g"]
    return [(i, t) for i, t in enumerate(out)]


def star(n, seed):
    """One large group of near copies of one text, most of them just below the threshold of each
    other (overlaps of 0.5 to 0.9), with repeated words, and a second group of another length."""
    rng = np.random.default_rng(seed)
    out = []
    for size, copies in ((130, n), (90, n // 4)):
        base = [f"s{k}" for k in rng.integers(0, 4000, size - 20)] + ["again", "and"] * 10
        for _ in range(copies):
            t = list(base)
            for k in rng.choice(size, rng.integers(0, 7), replace=False):
                t[k] = "edit%d" % rng.integers(0, 10 ** 6)
            out.append(" ".join(t))
    return list(enumerate(out))


@pytest.mark.parametrize("docs", [families(None), star(260, 1) + [(10_000 + i, t) for i, t in star(40, 2)]],
                         ids=["families", "star"])
def test_classes_equal_all_pairs(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.class_id for r in near_dedup.classes(df).collect()}
    want = brute_classes(docs)
    assert got == want
    assert len(set(want.values())) > 5


def test_rare_shingles_lose_no_link():
    """Every pair at the threshold meets at a rare shingle with room for the rest."""
    docs = [t for _, t in star(120, 3)]
    bags = [near_dedup.bag_of(t) for t in docs]
    for common in (np.full(near_dedup.ORDER_SLOTS, 2), np.arange(near_dedup.ORDER_SLOTS) % 7 + 2):
        doc, token, place, w = near_dedup.prefix_tokens(docs, common)
        at = defaultdict(list)
        for d, t, p, n in zip(doc.tolist(), token.tolist(), place.tolist(), w.tolist()):
            at[t].append((d, p, n))
        met = set()
        for rows in at.values():
            for i, (d, p, n) in enumerate(rows):
                for e, q, m in rows[:i]:
                    least = int(np.ceil((n + m) * 0.8 / 1.8 - 1e-9))
                    if min(n - p, m - q) >= least:
                        met.add((min(d, e), max(d, e)))
        links = {(i, j) for j in range(len(bags)) for i in range(j)
                 if near_dedup.overlap(bags[i], bags[j]) >= near_dedup.THRESHOLD}
        assert links and links <= met


def test_one_of_each_class_stays(spark):
    docs = edge_documents(spark)
    out = near_dedup.deduplicated(docs)
    assert out.columns == docs.columns
    texts = Counter(r.text for r in out.collect() if (r.text or "").split())
    assert set(texts.values()) == {1}
    blank = [r for r in docs.collect() if not (r.text or "").split()]
    assert sum(not (r.text or "").split() for r in out.collect()) == len(blank)
    assert near_dedup.classes(docs.limit(0)).count() == 0
    assert near_dedup.deduplicated(documents(spark).limit(1)).count() == 1


# ---- pipeline ----

def test_pipeline_equals_its_stages_by_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in documents(spark).collect()]
    rules = quality_rules.learn(quality_rules.labelled_statistics(
        documents(spark), spark.read.parquet(f"{SF}/labels.parquet")))
    kept = {r.doc_id for r in quality_rules.judge(documents(spark), rules).where("kept").collect()}
    docs = [d for d in docs if d[0] in kept]
    classes = brute_classes(docs)
    docs = [d for d in docs if classes[d[0]] == d[0]]
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    auto = decontaminate.automaton(decontaminate.window_blocks(
        [(b.item_id, b.text) for b in bench], decontaminate.WINDOW, 10 ** 9)[0])
    docs = [d for d in docs if not len(decontaminate.scan(auto, d[1])[1])]
    scan = secret_scan.prefilter()
    ref = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL_PATH)
    want = {i: ref.encode(secret_scan.redact(t, secret_scan.find(scan, t))) for i, t in docs}
    out = corpus_pipeline.run(spark, SF)
    assert {r.doc_id: r.ids for r in out.collect()} == want
    assert out.where(F.size("ids") != F.col("n_tokens")).count() == 0


def test_pipeline_of_empty_and_odd_documents(spark, workdir):
    edge_documents(spark).write.parquet(f"{workdir}/documents.parquet")
    for t in ("benchmark", "labels"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{workdir}/{t}.parquet")
    rows = rows_of(corpus_pipeline.run(spark, workdir))
    assert all(r["n_tokens"] > 0 for r in rows) and rows
    for name, stage in corpus_pipeline.STAGES[:-1]:
        df = edge_documents(spark)
        assert stage(spark, df, workdir).columns == df.columns, name
        assert stage(spark, df.limit(0), workdir).count() == 0, name
