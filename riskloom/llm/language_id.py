"""Language identification with bit-sliced Bloom filters of character n-grams.

One table of ``SLOTS`` words holds a filter per language: bit l of every word is the filter of
language l, so one probe per hash function, and-ed together, gives the bitmask of all languages
that contain an n-gram. A text's hits per language are popcounts of one bit over its n-grams;
the share of hits is corrected for the filter's own false-positive rate, and the largest
corrected share decides (ties: the language with more n-grams, then by name; a language's
n-grams are those learned from, scaled up to all its documents that may be learned from).

Learned from at most about ``MAX_LABELLED`` documents of each language, none of them held out,
so that a rare language is learned whatever the size of the table: an n-gram enters a language's filter if its rate there is at least ``LEAST_RATE`` and at least
``LEAST_RATIO`` of its highest rate in any language. Rates of a language sum to one, so a
filter never holds more than 1 / LEAST_RATE n-grams per n-gram length, whatever the corpus.

Defined results: a text that is null or has no letter is ``und`` with score 0; rows without
language teach nothing; without any learned language every text is ``und``; a text with letters
but no known n-gram gets the language with most n-grams and score 0; repeated rows
score alike; any number of languages works (64 to a plane); other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.llm.common import HASH_CUT, learnable, map_texts, slices, tune
from riskloom.llm.subwords import codes, gram_hashes, mix

LENGTHS = (3, 4)
SLOTS, HASHES = 1 << 20, 2
LEAST_RATE, LEAST_RATIO = 1e-5, 0.25
MAX_LABELLED = 8_000
SEED = 47
#: crc32(doc_id as text) mod 5 = 0 is held out.
MODULUS, HELD_OUT = 5, 0
UNKNOWN = "und"


def letter_table() -> np.ndarray:
    """Packed bits: which code points are letters."""
    return np.packbits(np.array([chr(c).isalpha() for c in range(0x110000)]))


def grams(texts: list, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text number) of every n-gram of the lower-cased texts, runs of other characters
    than letters being one space, and whether each text has a letter."""
    low = [" " + t.lower() + " " if t else " " for t in texts]
    code = codes("".join(low))
    text = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) for t in low])
    is_letter = letters[code]
    has = np.bincount(text[is_letter], minlength=len(texts)) > 0
    keep = is_letter.copy()
    keep[0] = True
    keep[1:] |= is_letter[:-1] | (text[1:] != text[:-1])
    code = np.where(is_letter, code, np.uint32(32))[keep]
    text = text[keep]
    parts = [gram_hashes(code, text, n) for n in LENGTHS]
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), has


def slots_of(h: np.ndarray) -> list[np.ndarray]:
    """Places of each hash in the table, one array per hash function."""
    out = []
    for k in range(HASHES):
        h = mix(h + np.uint64(k + 1))
        out.append((h & np.uint64(SLOTS - 1)).astype(np.int64))
    return out


def counted_grams(rows: DataFrame) -> DataFrame:
    """(lang, gram, n) over the (text, lang) rows, counted in each task before the shuffle."""
    tune(rows.sparkSession)
    packed = letter_table()
    schema = T.StructType([T.StructField("lang", T.StringType()),
                           T.StructField("gram", T.LongType()), T.StructField("n", T.LongType())])

    def run(batches):
        letters = np.unpackbits(packed).astype(bool)
        for b in batches:
            texts, langs = b.column(0).to_pylist(), b.column(1).to_pylist()
            for lo, hi in slices(texts):
                h, of, _ = grams(texts[lo:hi], letters)
                for lang in sorted(set(langs[lo:hi])):
                    mine = np.array([x == lang for x in langs[lo:hi]])
                    g, n = np.unique(h[mine[of]], return_counts=True)
                    if len(g):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([lang] * len(g)), pa.array(g.view(np.int64)),
                             pa.array(n.astype(np.int64))], names=schema.names)

    return (rows.select("text", "lang").mapInArrow(run, schema)
            .groupBy("lang", "gram").agg(F.sum("n").alias("n")))


def training_rows(docs: DataFrame) -> tuple[DataFrame, dict]:
    """(text, lang) of the bounded sample of each language, and by how much each was thinned.
    A language of at most ``MAX_LABELLED`` rows is taken whole."""
    rows = docs.select("doc_id", "text", "lang").where(
        F.col("lang").isNotNull() & F.col("text").isNotNull()
        & learnable(F.col("doc_id"), MODULUS, HELD_OUT))
    thinned = {r["lang"]: max(1.0, r["count"] / MAX_LABELLED)
               for r in rows.groupBy("lang").count().collect()}
    cuts = [x for g, t in sorted(thinned.items()) if t > 1
            for x in (F.lit(g), F.lit(int(HASH_CUT / t)))]
    if cuts:
        h = F.pmod(F.xxhash64("doc_id", "text", F.lit(SEED)), F.lit(HASH_CUT))
        rows = rows.where(h < F.coalesce(F.try_element_at(F.create_map(*cuts), F.col("lang")),
                                         F.lit(HASH_CUT)))
    return rows.select("text", "lang"), thinned


def learn(docs: DataFrame, least_rate: float = LEAST_RATE,
          least_ratio: float = LEAST_RATIO) -> dict | None:
    """Filter planes, languages and false-positive rates."""
    rows, thinned = training_rows(docs)
    counts = counted_grams(rows)
    # Rates need each language's total: a few rows, gathered once with the counts' own pass.
    counts = counts.persist()
    try:
        totals = {r["lang"]: r["t"] for r in
                  counts.groupBy("lang").agg(F.sum("n").alias("t")).collect()}
        if not totals:
            return None
        langs = sorted(totals)
        rate = F.element_at(F.create_map(*[x for g in langs for x in (
            F.lit(g), F.lit(1.0 / totals[g]))]), F.col("lang")) * F.col("n")
        top = F.max("rate").over(Window.partitionBy("gram"))
        kept = (counts.withColumn("rate", rate).where(F.col("rate") >= least_rate)
                .withColumn("top", top).where(F.col("rate") >= least_ratio * F.col("top"))
                .select("lang", "gram").toPandas())
    finally:
        counts.unpersist()
    planes = np.zeros((1 + (len(langs) - 1) // 64, SLOTS), np.uint64)
    rates = []
    for i, lang in enumerate(langs):
        h = kept.loc[kept["lang"] == lang, "gram"].to_numpy(np.int64).view(np.uint64)
        bit = np.uint64(1 << (i % 64))
        for at in slots_of(h):
            planes[i // 64][at] |= bit
        fill = float(((planes[i // 64] & bit) != 0).mean())
        rates.append(fill ** HASHES)
    return {"planes": planes, "langs": langs, "false": rates,
            "weight": [totals[g] * thinned[g] for g in langs]}


def identify(model: dict | None, letters: np.ndarray, texts: list) -> tuple[list, list]:
    """Language and score of each text."""
    n = len(texts)
    h, of, has = grams(texts, letters)
    if model is None:
        return [UNKNOWN] * n, [0.0] * n
    total = np.maximum(np.bincount(of, minlength=n), 1)
    places = slots_of(h)
    share = np.zeros((len(model["langs"]), n))
    for p, plane in enumerate(model["planes"]):
        mask = plane[places[0]]
        for at in places[1:]:
            mask &= plane[at]
        for i in range(64 * p, min(64 * p + 64, len(model["langs"]))):
            hit = (mask >> np.uint64(i % 64)) & np.uint64(1)
            found = np.bincount(of, hit, n) / total
            fp = model["false"][i]
            share[i] = np.clip((found - fp) / (1 - fp) if fp < 1 else 0.0, 0, 1)
    rank = sorted(range(len(model["langs"])), key=lambda i: (-model["weight"][i], i))
    best = np.array(rank)[share[rank].argmax(axis=0)]
    lang = [model["langs"][b] if ok else UNKNOWN for b, ok in zip(best, has)]
    score = np.where(has, share[best, np.arange(n)], 0.0)
    return lang, score.tolist()


def identify_documents(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document. The model's size is fixed by
    ``SLOTS`` and the number of languages, so it is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    packed = letter_table()

    def make():
        letters = np.unpackbits(packed).astype(bool)

        def run(texts):
            lang, score = identify(shared.value, letters, texts)
            return {"lang_pred": lang, "score": score}
        return run
    out = map_texts(docs.select("doc_id", "text"), make,
                    [T.StructField("lang_pred", T.StringType()),
                     T.StructField("score", T.DoubleType())], ["doc_id"])
    held = ~F.coalesce(learnable(F.col("doc_id"), MODULUS, HELD_OUT), F.lit(True))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")
