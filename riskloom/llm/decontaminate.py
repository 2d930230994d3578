"""Benchmark decontamination with one Aho-Corasick automaton.

Text is normalised byte-wise: A-Z lower-cased; digits, a-z and everything beyond ASCII are
word characters; every other byte separates words. A window is ``window`` consecutive words
of a test item (an item of fewer, but not none, is one window). All windows of all items go
into one automaton over the normalised form, each text is scanned once, and each hit maps
back to word numbers and to offsets in the original text. A document word inside any
occurrence of a window is hit.

The automaton is broadcast, so its size is checked against ``MAX_AUTOMATON_CHARS``. A larger
test set is cut into blocks below that bound by a running size over the items, and every
document meets every block in turn; the results are the same.

Defined results: null or empty text has no words and no hit; null or empty items have no
window; repeated items act as one; rows of items sharing an id count as one item; an empty
benchmark leaves every document clean; other columns of the input are carried through only
where asked.
"""

from __future__ import annotations

from collections import defaultdict

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.llm.common import apart, map_texts

WINDOW = 10
MAX_AUTOMATON_CHARS = 64_000_000

#: Byte table of the normal form: lower-case A-Z, keep word bytes, all else is a space.
_TABLE = bytes((b | 32) if 65 <= b <= 90 else
               b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

FIELDS = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
          T.StructField("n_items", T.LongType()),
          T.StructField("item_ids", T.ArrayType(T.StringType())),
          T.StructField("spans", T.ArrayType(T.ArrayType(T.IntegerType())))]


def normal_words(text: str | None) -> list[bytes]:
    """Words of the normal form, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def item_windows(text: str | None, window: int = WINDOW) -> list[str]:
    """Distinct windows of a test item in the automaton's form: one Latin-1 character per
    byte, single spaces, a space at both ends."""
    words = [w.decode("latin-1") for w in normal_words(text)]
    if not words:
        return []
    return list(dict.fromkeys(" " + " ".join(words[i:i + window]) + " "
                              for i in range(max(1, len(words) - window + 1))))


def window_blocks(items: list[tuple], window: int, max_chars: int) -> list[dict]:
    """Windows with the ids of their items, in dicts of at most ``max_chars`` characters
    (one item at least)."""
    blocks, size = [defaultdict(set)], 0
    for item_id, text in items:
        own = item_windows(text, window)
        n = sum(map(len, own))
        if size and size + n > max_chars:
            blocks.append(defaultdict(set))
            size = 0
        size += n
        for w in own:
            blocks[-1][w].add(str(item_id))
    return [{w: sorted(ids) for w, ids in b.items()} for b in blocks if b]


def automaton(windows: dict[str, list[str]]) -> ahocorasick.Automaton | None:
    if not windows:
        return None
    a = ahocorasick.Automaton()
    for w, ids in windows.items():
        a.add_word(w, (len(w), w.count(" ") - 1, tuple(ids)))
    a.make_automaton()
    return a


def word_offsets(text: str) -> np.ndarray:
    """Code-point (start, end) of every word of ``text``."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    word = np.frombuffer(bytes(raw).translate(_TABLE), np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.concatenate(([False], word, [False])).astype(np.int8)))
    # Bytes that begin a code point, counted up to each position.
    point = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    return point[edge].reshape(-1, 2)


def scan(auto: ahocorasick.Automaton | None, text: str | None) -> tuple:
    """(n_words, hit word numbers, item ids) of one whole text."""
    words = normal_words(text)
    if auto is None or not words:
        return len(words), (), ()
    form = " " + b" ".join(words).decode("latin-1") + " "
    hits = list(auto.iter(form))
    if not hits:
        return len(words), (), ()
    spaces = np.flatnonzero(np.frombuffer(form.encode("latin-1"), np.uint8) == 32)
    ends = np.searchsorted(spaces, [e for e, _ in hits])
    cover = np.zeros(len(words) + 1, np.int64)
    ids = set()
    for end, (_, (_, n, own)) in zip(ends, hits):
        cover[end - n] += 1
        cover[end] -= 1
        ids.update(own)
    return len(words), np.flatnonzero(np.cumsum(cover[:-1]) > 0), ids


def _scanner(windows: dict[str, list[str]]):
    def make():
        auto = automaton(windows)

        def run(texts: list) -> dict:
            out = {f.name: [] for f in FIELDS}
            for t in texts:
                n, hit, ids = scan(auto, t)
                out["n_words"].append(n)
                out["n_hit"].append(len(hit))
                out["n_items"].append(len(ids))
                out["item_ids"].append(sorted(ids))
                spans = []
                if len(hit):
                    at = word_offsets(t)
                    cuts = np.flatnonzero(np.diff(hit) > 1)
                    first = np.concatenate(([hit[0]], hit[cuts + 1]))
                    last = np.concatenate((hit[cuts], [hit[-1]]))
                    spans = [[int(at[a, 0]), int(at[b, 1])] for a, b in zip(first, last)]
                out["spans"].append(spans)
            return out
        return run
    return make


def hits(docs: DataFrame, benchmark: DataFrame, keep: list[str], window: int = WINDOW,
         max_automaton_chars: int = MAX_AUTOMATON_CHARS, text: str = "text") -> DataFrame:
    """``keep`` columns of every document with n_words, n_hit, n_items, item_ids and spans
    (code-point start and end of each run of hit words in the original text)."""
    items = [(r[0], r[1]) for r in
             benchmark.select("item_id", "text").where(F.col("text").isNotNull())
             .toLocalIterator()]
    blocks = window_blocks(items, window, max_automaton_chars)
    if len(blocks) <= 1:
        return map_texts(docs, _scanner(blocks[0] if blocks else {}), FIELDS, keep, text)
    return _in_blocks(docs, blocks, keep, text)


def _in_blocks(docs: DataFrame, blocks: list[dict], keep: list[str], text: str) -> DataFrame:
    """Every document against every block of windows, one pass per block, results gathered
    per document row inside the row itself."""
    state = T.StructField("__hit", T.ArrayType(T.IntegerType()))
    ids = T.StructField("__ids", T.ArrayType(T.StringType()))
    df = docs
    for k, windows in enumerate(blocks):
        def make(windows=windows):
            auto = automaton(windows)

            def run(texts):
                found = [scan(auto, t) for t in texts]
                return {f"__hit{k}": [list(map(int, h)) for _, h, _ in found],
                        f"__ids{k}": [sorted(i) for _, _, i in found]}
            return run
        fields = [T.StructField(f"__hit{k}", state.dataType),
                  T.StructField(f"__ids{k}", ids.dataType)]
        df = map_texts(df, make, fields, df.columns, text)
    hit = F.array_distinct(F.flatten(F.array(*[F.col(f"__hit{k}") for k in range(len(blocks))])))
    got = F.array_distinct(F.flatten(F.array(*[F.col(f"__ids{k}") for k in range(len(blocks))])))
    df = df.withColumns({"__hit": F.array_sort(hit), "__ids": F.array_sort(got)})

    def close():
        def run(texts):
            return {"__at": [word_offsets(t or "").tolist() for t in texts]}
        return run
    pairs = T.StructField("__at", T.ArrayType(T.ArrayType(T.IntegerType())))
    df = map_texts(df, close, [pairs], df.columns, text)
    at = F.col("__at")
    first = F.filter("__hit", lambda i: ~F.array_contains("__hit", i - 1))
    last = F.filter("__hit", lambda i: ~F.array_contains("__hit", i + 1))
    spans = F.zip_with(first, last, lambda a, b: F.array(at[a][0], at[b][1]))
    return df.select(*keep, F.size("__at").cast("long").alias("n_words"),
                     F.size("__hit").cast("long").alias("n_hit"),
                     F.size("__ids").cast("long").alias("n_items"),
                     F.col("__ids").alias("item_ids"), spans.alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from ``hits``: item list as a hash, and the verdict."""
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items",
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents without a hit, with the columns of ``docs``."""
    df, back, name = apart(docs)
    return back(hits(df, benchmark, df.columns, text=name("text")).where(F.col("n_hit") == 0))


ORACLE = r"""
WITH dw AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
bw AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
win AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS k
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM bw
        WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
dwin AS (
  SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS k
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, sizes
        WHERE len(w) >= n)),
occ AS (SELECT r, item, i, dwin.n FROM dwin JOIN win ON win.n = dwin.n AND win.k = dwin.k),
hit AS (SELECT r, count(DISTINCT p) AS n_hit
        FROM (SELECT r, unnest(range(i, i + n)) AS p FROM occ) GROUP BY r),
ids AS (SELECT r, count(DISTINCT item) AS n_items,
               array_to_string(list_sort(list(DISTINCT item)), ',') AS items
        FROM occ GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit,
       coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (r) LEFT JOIN ids USING (r)
"""
