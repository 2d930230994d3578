"""Periodic run detection in word sequences by recursive frequency splitting and a lag scan.

A run is a stretch of consecutive words with smallest period q (words q apart are equal) of at
least ``max(LEAST, 2 q)`` words that no neighbouring word extends with that period.

Splitting: in a run of period q every word has an equal word exactly q places before or after
it, and q is at most half the segment. A word that occurs too rarely in its segment, so that
no equal word lies within half the segment's length, is in no run and splits the segment.
Shorter segments make more words rare, so the pieces of a split segment are looked at again
until none changes; pieces of fewer than ``LEAST`` words go. A run never crosses a split.

Lag scan: a run of period q has at least q neighbouring places whose word recurs q later, so
one of the places q-1, 2q-1, 3q-1, ... of its segment is among them. Per lag only those places
of all surviving segments are compared, n/q of n words, and matches are extended both ways.
Lags rise, so a stretch that a run of smaller period p spans by p words on both sides holds no
run of the larger lag (two periods that overlap by their sum have a common one); such matches
are passed over, which keeps long plain repeats linear.

Everything works on whole texts, batch by batch inside a task; a document needs no other, so
nothing is shuffled and no key can be hot.

Defined results: null, empty and blank texts have no words, no run and an empty collapsed
text; repeated rows give repeated results; an empty table gives no rows; columns beside the
text and the kept ones are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from riskloom.llm.common import SLICE_CHARS, tune

LEAST = 12
#: Steps by which all matches of a lag are extended together before the long ones go alone.
STEPS = 12
#: Places compared at once over several lags.
LAG_PLACES = 1 << 16
RUN = T.StructType([T.StructField(n, T.LongType(), False) for n in ("start", "length", "period")])


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in order, and the number of words of each text. Words are parted
    by ASCII white space."""
    parts = pc.ascii_split_whitespace(texts.cast(pa.string()).fill_null(""))
    flat, owner = parts.flatten(), pc.list_parent_indices(parts)
    some = pc.greater(pc.binary_length(flat), 0)
    owner = owner.filter(some).to_numpy(zero_copy_only=False)
    return flat.filter(some), np.bincount(owner, minlength=len(texts)).astype(np.int64)


def _pieces(at: np.ndarray, seg: np.ndarray) -> np.ndarray:
    """Segment number of every kept place: a gap or a change of segment starts a new one."""
    new = (np.diff(at, prepend=-2) != 1) | (np.diff(seg, prepend=-1) != 0)
    return np.cumsum(new) - 1


def split(code: np.ndarray, doc: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """(place, segment) of the words that recursive frequency splitting leaves, in order of
    places. ``code`` numbers the words, ``doc`` the documents they stand in."""
    at, seg = np.arange(len(code)), doc
    kinds = int(code.max()) + 1 if len(code) else 1
    stable = []
    while len(at):
        seg = _pieces(at, seg)
        length = np.bincount(seg)
        long = length[seg] >= least
        at, seg = at[long], seg[long]
        if not len(at):
            break
        key = seg * kinds + code[at]
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        gap = np.where(same, np.diff(at[order]), np.iinfo(np.int64).max)
        near = np.full(len(at), np.iinfo(np.int64).max)
        near[order[1:]] = gap
        near[order[:-1]] = np.minimum(near[order[:-1]], gap)
        ok = near <= length[seg] // 2
        changed = np.zeros(len(length), bool)
        changed[seg[~ok]] = True
        done = ~changed[seg]
        stable.append((at[done], seg[done]))
        ok &= ~done
        at, seg = at[ok], seg[ok]
    if not stable:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    # Numbers of different passes may clash, so places apart or passes apart part segments.
    at = np.concatenate([x for x, _ in stable])
    seg = np.concatenate([_pieces(x, s) + i * (len(code) + 1) for i, (x, s) in enumerate(stable)])
    order = np.argsort(at, kind="stable")
    at, seg = at[order], seg[order]
    return at, _pieces(at, seg)


def _reach(word: np.ndarray, i: int, q: int, lo: int, hi: int) -> tuple[int, int]:
    """The stretch [a, b) around ``i`` of places in [lo, hi - q) whose word recurs ``q`` later."""
    b, step = i + 1, 64
    while b < hi - q:
        e = min(b + step, hi - q)
        differ = np.flatnonzero(word[b:e] != word[b + q:e + q])
        if len(differ):
            b += int(differ[0])
            break
        b, step = e, step * 2
    a, step = i, 64
    while a > lo:
        s = max(a - step, lo)
        differ = np.flatnonzero(word[s:a] != word[s + q:a + q])
        if len(differ):
            a = s + int(differ[-1]) + 1
            break
        a, step = s, step * 2
    return a, b


def lag_scan(word: np.ndarray, seg: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, end, period) of all runs inside the segments of ``word``, by period."""
    if not len(word):
        return []
    length = np.bincount(seg)
    first = np.concatenate(([0], np.cumsum(length)[:-1]))
    order = np.argsort(-length, kind="stable")
    length, first = length[order], first[order]
    cover = np.full(len(word), -1)
    found: dict[tuple[int, int], int] = {}
    last_lag = int(length[0]) // 2
    lag = 1
    while lag <= last_lag:
        # Lags with few places each are compared together.
        lags = np.arange(lag, min(lag + max(1, LAG_PLACES * lag // len(word)), last_lag + 1))
        lag = int(lags[-1]) + 1
        k = np.searchsorted(-length, -np.maximum(least, 2 * lags), side="right")
        q = np.repeat(lags, k)
        owner = np.arange(len(q)) - np.repeat(np.cumsum(k) - k, k)
        n = length[owner] // q - 1
        nth = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        q, owner = np.repeat(q, n), np.repeat(owner, n)
        i = first[owner] + q - 1 + nth * q
        hit = np.flatnonzero(word[i] == word[i + q])
        hit = hit[i[hit] + q[hit] > cover[i[hit]]]
        if not len(hit):
            continue
        i, q, owner = i[hit], q[hit], owner[hit]
        lo, hi = first[owner], first[owner] + length[owner]
        need = np.maximum(q, least - q)
        a, b = i.copy(), i + 1
        left, right = np.arange(len(i)), np.arange(len(i))
        for _ in range(STEPS):
            right = right[b[right] + q[right] < hi[right]]
            right = right[word[b[right]] == word[b[right] + q[right]]]
            b[right] += 1
            left = left[a[left] > lo[left]]
            left = left[word[a[left] - 1] == word[a[left] - 1 + q[left]]]
            a[left] -= 1
        maybe = b - a >= need
        maybe[left] = True
        maybe[right] = True
        stretch = (0, 0, 0)
        for x, p, low, high in zip(*(v[maybe].tolist() for v in (i, q, lo, hi))):
            if x + p <= cover[x] or (p == stretch[2] and stretch[0] <= x < stretch[1]):
                continue
            s, e = _reach(word, x, p, low, high)
            stretch = (s, e, p)
            if e - s >= max(p, least - p) and (s, e + p) not in found:
                found[s, e + p] = p
                np.maximum(cover[s + p:e], e, out=cover[s + p:e])
    return [(s, e, q) for (s, e), q in found.items()]


def find_runs(code: np.ndarray, doc: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Rows (start place, length, period) of the runs of all documents, by start then period."""
    at, seg = split(code, doc, least)
    runs = [(at[s], e - s, q) for s, e, q in lag_scan(code[at], seg, least)]
    out = np.array(runs, np.int64).reshape(-1, 3)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def collapse(words: pa.Array, counts: np.ndarray, order: np.ndarray | None = None,
             least: int = LEAST) -> dict:
    """Runs and collapsed text of each document. ``order`` gives each word's place in
    ``words`` where documents are rearranged; ``counts`` the words of each document."""
    coded = words.dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    if order is not None:
        code = code[order]
    ends = np.cumsum(counts)
    begin = ends - counts
    doc = np.repeat(np.arange(len(counts)), counts)
    runs = find_runs(code, doc, least)
    of = doc[runs[:, 0]]
    change = np.zeros(len(code) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    kept = np.cumsum(change[:-1]) == 0
    offsets = np.concatenate(([0], np.cumsum(np.bincount(doc[kept], minlength=len(counts)))))
    left = coded.dictionary.take(pa.array(code[kept]))
    text = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), left), " ")
    spans = pa.StructArray.from_arrays(
        [pa.array(runs[:, 0] - begin[of]), pa.array(runs[:, 1]), pa.array(runs[:, 2])],
        fields=[pa.field(f.name, pa.int64(), False) for f in RUN])
    at = np.concatenate(([0], np.cumsum(np.bincount(of, minlength=len(counts)))))
    return {"n_words": pa.array(counts), "collapsed": text,
            "runs": pa.ListArray.from_arrays(pa.array(at, pa.int32()), spans)}


def periodic_runs(docs: DataFrame, keep: list[str], text: str = "text", least: int = LEAST,
                  rearrange: Callable[[list, np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """``keep`` columns, n_words, runs (start, length, period; by start, then period) and the
    collapsed text: words of a run beyond its first period are dropped, the others joined by
    one space. ``rearrange`` maps the first kept column and the word counts of a batch to
    places, for sequences that are made from the texts' words."""
    tune(docs.sparkSession)
    schema = T.StructType([docs.schema[c] for c in keep] + [
        T.StructField("n_words", T.LongType()), T.StructField("collapsed", T.StringType()),
        T.StructField("runs", T.ArrayType(RUN, False))])
    arrow = to_arrow_schema(schema)
    tail = [f.name for f in schema.fields[len(keep):]]

    def run(batches):
        for b in batches:
            size = pc.utf8_length(b.column(len(keep))).fill_null(0).to_numpy(zero_copy_only=False)
            part = np.cumsum(size) // SLICE_CHARS
            for p in np.unique(part):
                x = b.take(pa.array(np.flatnonzero(part == p)))
                words, counts = words_of(x.column(len(keep)))
                order = rearrange(x.column(0).to_pylist(), counts) if rearrange else None
                got = collapse(words, counts, order, least)
                yield pa.RecordBatch.from_arrays(
                    [x.column(i) for i in range(len(keep))]
                    + [got[c].cast(arrow.field(c).type) for c in tail], schema=arrow)

    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`")).mapInArrow(run, schema)


def looped(ids: list, counts: np.ndarray) -> np.ndarray:
    """Places of the words of the contract's sequences: in a tenth of the documents, chosen by
    the CRC of their id, the words from some place on repeat with a period drawn from it."""
    order = np.arange(int(counts.sum()))
    begin = np.cumsum(counts) - counts
    for k, (x, n) in enumerate(zip(ids, counts.tolist())):
        h = zlib.crc32(str(x).encode()) if x is not None and n else 1
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            order[begin[k] + a:begin[k] + n] = begin[k] + a + np.arange(n - a) % p
    return order


def digest(found: DataFrame) -> DataFrame:
    """One row per document: number of runs, the longest one, and hashes of the runs and of
    the collapsed text."""
    longest = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(
        F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"),
                    r["period"].cast("string")), F.lit("\n"))), "")
    hexed = lambda c: F.sha2(c.cast("binary"), 256)
    slim = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"),
                        longest.alias("top"), hexed(lines).alias("runs_sha256"),
                        hexed(F.col("collapsed")).alias("collapsed_sha256"))
    top = F.col("top")
    return slim.select(
        "doc_id", "n_runs", (-top["start"]).alias("start"), top["length"].alias("length"),
        (-top["period"]).alias("period"),
        F.floor(1000 * top["length"] / -top["period"]).cast("long").alias("exponent_milli"),
        "runs_sha256", "collapsed_sha256")
