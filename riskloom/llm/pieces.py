"""SentencePiece encoding and decoding by batched Viterbi in numpy.

A text is cut where no vocabulary piece can cross; equal segments are encoded once per batch.
Segments of equal length advance together, one character at a time: substring hashes probe the
sorted hashes of all pieces, the best last piece of every prefix is chosen by a vectorised
maximum, and its start is the backpointer.

* Unigram models: the maximum is over (best score of the shorter prefix + score of the piece).
* BPE models: a prefix has exactly one last piece, namely the one that the merges leave
  beside the last piece of the shorter prefix, so every other candidate scores minus infinity.
  Two pieces stay side by side if no merge across their border comes before the merges that
  build them (checked from the last merge backwards along the two edges of the border). The
  result equals merging by score, leftmost first on ties.

Pieces that share a score (runs of the space mark) have no order of merges of their own;
segments with such a run, and single segments of more than ``LONG`` characters, are merged pair
by pair from a heap, in n log n steps.

Defined results: a null text has null ids, an empty text none; a character outside the
vocabulary becomes its UTF-8 bytes if the model has byte pieces, else the unknown id; decoding
gives the text back exactly, save that the space mark itself (U+2581) decodes to a space, as
the format implies. Other columns are carried through only where asked.
"""

from __future__ import annotations

from collections import Counter
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.llm.common import apart, map_texts
from riskloom.llm.subwords import codes, mix

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
#: Fixed values of the model format.
SPACE = "▁"
NORMAL, UNKNOWN, BYTE = 1, 2, 6
UNIGRAM, BPE = 1, 2
#: Characters encoded together in a task, and segments kept encoded between batches.
BATCH_CHARS, KEPT_SEGMENTS = 3_000_000, 300_000
#: Slots of the bitmap before the piece keys, and of the memory of checked pairs.
BITMAP, PAIR_MEMORY = 1 << 20, 1 << 20
#: Characters of a segment from which its merges are made one by one.
LONG = 256
_P = 0x9E3779B97F4A7C15
_P_INVERSE = pow(_P, -1, 1 << 64)
_FREE = np.iinfo(np.int64).max


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out, dtype=np.uint64)


class Hasher:
    """Hashes of substrings of one code array."""

    def __init__(self, code: np.ndarray):
        with np.errstate(over="ignore"):
            terms = (code.astype(np.uint64) + np.uint64(1)) * powers(_P, len(code))
            self.run = np.concatenate((np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)))
        self.back = powers(_P_INVERSE, len(code) + 1)

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.run[hi] - self.run[lo]) * self.back[lo]
                       + (hi - lo).astype(np.uint64))


def probe(keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Index of each x in sorted keys, -1 where it is not there."""
    at = np.searchsorted(keys, x)
    at[at == len(keys)] = 0
    return np.where(keys[at] == x, at, -1)


class Vocabulary:
    """Lookup tables of one model; their size is that of the model file."""

    def __init__(self, pieces: list[tuple[str, float, int]], kind: int):
        self.kind, self.size = kind, len(pieces)
        self.texts = [p for p, _, _ in pieces]
        self.types = np.array([t for _, _, t in pieces])
        self.score = np.array([s for _, s, _ in pieces], float)
        self.unknown = next((i for i, t in enumerate(self.types) if t == UNKNOWN), 0)
        self.byte = np.full(256, -1, np.int32)
        for i, (p, _, t) in enumerate(pieces):
            if t == BYTE:
                self.byte[int(p[3:-1], 16)] = i
        usable = [i for i, t in enumerate(self.types) if t == NORMAL and self.texts[i]]
        self.ids = {self.texts[i]: i for i in usable}
        self.longest = max((len(self.texts[i]) for i in usable), default=1)
        flat = "".join(self.texts[i] for i in usable)
        ends = np.cumsum([len(self.texts[i]) for i in usable]).astype(np.int64)
        starts = np.concatenate((np.zeros(1, np.int64), ends[:-1]))[:len(ends)]
        hashes = Hasher(codes(flat)).of(starts, ends) if usable else np.empty(0, np.uint64)
        order = np.argsort(hashes)
        self.keys = hashes[order]
        self.key_ids = np.array(usable, np.int64)[order]
        self.maybe = np.zeros(BITMAP, bool)
        self.maybe[(self.keys & np.uint64(BITMAP - 1)).astype(np.int64)] = True
        joined = {p[k:k + 2] for p in self.ids for k in range(len(p) - 1)}
        self.joined = np.unique(np.array(
            [(ord(a) << 32) | ord(b) for a, b in joined], np.int64))
        small = self.joined[((self.joined >> 32) < 512) & ((self.joined & 0xFFFFFFFF) < 512)]
        self.joined_small = np.zeros((512, 512), bool)
        self.joined_small[small >> 32, small & 0xFFFFFFFF] = True
        # Order of merging: higher scores first, equal scores alike.
        _, rank = np.unique(-self.score, return_inverse=True)
        self.rank = rank.astype(np.int64)
        self.ranks = self.rank.tolist()
        shared = Counter(self.score[i] for i in usable if len(self.texts[i]) > 1)
        self.tied = {self.texts[i] for i in usable
                     if len(self.texts[i]) > 1 and shared[self.score[i]] > 1}
        if kind == BPE:
            if any(set(p) != {SPACE} for p in self.tied):
                raise ValueError("pieces other than runs of spaces share a score")
            self._merges()

    def _merges(self) -> None:
        """Last merge of every piece, and the piece that each mergeable pair gives."""
        self.left = np.full(self.size, -1, np.int64)
        self.right = np.full(self.size, -1, np.int64)
        self.whole = np.zeros(self.size, bool)
        self.formed = np.where(np.array([len(t) for t in self.texts]) > 1, self.rank, -1)
        pairs, to = [], []
        for text, i in self.ids.items():
            for k in range(1, len(text)):
                a, b = self.ids.get(text[:k]), self.ids.get(text[k:])
                if a is not None and b is not None:
                    pairs.append(a * self.size + b)
                    to.append(i)
            if len(text) == 1:
                self.whole[i] = True
                continue
            symbols, last = self.merge(text)
            if len(symbols) == 1:
                self.whole[i] = True
                self.left[i], self.right[i] = (self.ids[s] for s in last)
        order = np.argsort(np.array(pairs, np.int64))
        self.pairs = np.array(pairs, np.int64)[order]
        self.pair_to = np.array(to, np.int64)[order]

    def merge(self, text: str) -> tuple[list[str], tuple[str, str]]:
        """Symbols that merging leaves, best pair first and of equal pairs the left one, and the
        last pair merged. Pairs wait in a heap, so a text of n characters takes n log n steps."""
        n = len(text)
        symbols, last = list(text), ("", "")
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n:
                to = self.ids.get(symbols[i] + symbols[j])
                if to is not None:
                    heappush(heap, (self.ranks[to], i, len(symbols[i]), len(symbols[j])))
        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, a, b = heappop(heap)
            j = after[i]
            if not symbols[i] or j >= n or len(symbols[i]) != a or len(symbols[j]) != b:
                continue  # one of the two has been merged since
            last = (symbols[i], symbols[j])
            symbols[i] += symbols[j]
            symbols[j] = ""
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [x for x in symbols if x], last

    def lookup(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), -1, np.int64)
        some = np.flatnonzero(self.maybe[(h & np.uint64(BITMAP - 1)).astype(np.int64)])
        at = probe(self.keys, h[some])
        out[some] = np.where(at >= 0, self.key_ids[at], -1)
        return out

    def crossable(self, code: np.ndarray) -> np.ndarray:
        """Whether some piece holds each pair of neighbouring characters."""
        a, b = code[:-1], code[1:]
        out = np.zeros(len(a), bool)
        small = (a < 512) & (b < 512)
        out[small] = self.joined_small[a[small], b[small]]
        rest = ~small
        if rest.any() and len(self.joined):
            key = (a[rest].astype(np.int64) << 32) | b[rest].astype(np.int64)
            out[rest] = probe(self.joined, key) >= 0
        return out

    def side_by_side(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging leaves pieces a and b next to each other."""
        a, b = a.copy(), b.copy()
        good = np.ones(len(a), bool)
        used_a = np.full(len(a), _FREE)  # when the symbol at each side of the border goes
        used_b = np.full(len(a), _FREE)
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            at = probe(self.pairs, x * np.int64(self.size) + y)
            rank = np.where(at >= 0, self.rank[self.pair_to[at]], _FREE)
            bad = (at >= 0) & (rank < used_a[live]) & (rank <= used_b[live])
            good[live[bad]] = False
            fa, fb = self.formed[x], self.formed[y]
            go = ~bad & ((fa >= 0) | (fb >= 0))
            # Undo the later merge; of equal ones the right, as the left came first.
            undo_a = go & (fa > fb)
            undo_b = go & ~undo_a
            i, j = live[undo_a], live[undo_b]
            used_a[i], a[i] = fa[undo_a], self.right[x[undo_a]]
            used_b[j], b[j] = fb[undo_b], self.left[y[undo_b]]
            live = live[go]
        return good


class Pairs:
    """Remembers which pairs of pieces stay side by side; a slot holds its latest pair."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self.key = np.full(PAIR_MEMORY, -1, np.int64)
        self.good = np.zeros(PAIR_MEMORY, bool)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * np.int64(self.v.size) + b
        slot = (mix(key.view(np.uint64)) & np.uint64(PAIR_MEMORY - 1)).astype(np.int64)
        out = self.good[slot]
        new = np.flatnonzero(self.key[slot] != key)
        if len(new):
            out[new] = self.v.side_by_side(a[new], b[new])
            self.key[slot[new]] = key[new]
            # Of pairs in one slot the last stays, for the key and the answer alike.
            last = self.key[slot[new]] == key[new]
            self.good[slot[new[last]]] = out[new[last]]
        return out


def load_model(path: str = MODEL_PATH) -> Vocabulary:
    """Vocabulary of a model file; only plain normalisation with a dummy prefix is known."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    n = model.normalizer_spec
    if n.precompiled_charsmap or n.remove_extra_whitespaces or not (
            n.add_dummy_prefix and n.escape_whitespaces):
        raise ValueError(f"the normalisation of {path} is not supported")
    return Vocabulary([(p.piece, p.score, p.type) for p in model.pieces],
                      model.trainer_spec.model_type)


def viterbi(v: Vocabulary, pairs: Pairs | None, hasher: Hasher, start: np.ndarray,
            n: int) -> tuple[np.ndarray, np.ndarray]:
    """(piece, first character) of the best last piece of every prefix of ``n``-character
    segments at ``start``; piece -1 is a character outside the vocabulary."""
    k = len(start)
    piece = np.full((k, n + 1), -1, np.int64)
    begin = np.zeros((k, n + 1), np.int64)
    best = np.full((k, n + 1), -np.inf)
    best[:, 0] = 0.0
    worst = v.score.min() - 10.0
    for j in range(1, n + 1):
        # BPE: only one candidate has a finite score, so rows leave once they have it.
        open_ = np.arange(k)
        for i in range(max(0, j - v.longest), j):
            if not len(open_):
                break
            ids = v.lookup(hasher.of(start[open_] + i, start[open_] + j))
            if v.kind == BPE:
                ok = (ids >= 0) & v.whole[ids]
                if i:
                    known = ok & (piece[open_, i] >= 0)
                    ok[known] = pairs(piece[open_[known], i], ids[known])
                ok &= best[open_, i] > -np.inf
                if i == j - 1:
                    ok |= ids < 0
                rows, won = open_[ok], ids[ok]
                best[rows, j] = 0.0
                open_ = open_[~ok]
            else:
                gain = np.where(ids >= 0, v.score[ids], worst if i == j - 1 else -np.inf)
                total = best[open_, i] + gain
                ok = total > best[open_, j]
                rows, won = open_[ok], ids[ok]
                best[rows, j] = total[ok]
            piece[rows, j], begin[rows, j] = won, i
    return piece, begin


def walk_back(piece: np.ndarray, begin: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
    """(segment, start, piece) along the backpointers, in reading order per segment."""
    at = np.full(len(piece), n)
    seg, pos, got = [], [], []
    live = np.arange(len(piece))
    while len(live):
        seg.append(live)
        got.append(piece[live, at[live]])
        at[live] = begin[live, at[live]]
        pos.append(at[live])
        live = live[at[live] > 0]
    seg, pos, got = map(np.concatenate, (seg, pos, got))
    order = np.lexsort((pos, seg))
    return seg[order], pos[order], got[order]


class Encoder:
    """Encodes batches of texts; keeps a bounded number of encoded segments."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self.pairs = Pairs(v) if v.kind == BPE else None
        self.kept: dict[int, np.ndarray] = {}

    def _char_ids(self, c: int) -> list[int]:
        raw = chr(c).encode("utf-8", "surrogatepass")
        out = [int(self.v.byte[b]) for b in raw]
        return out if min(out) >= 0 else [self.v.unknown]

    def _encode(self, code: np.ndarray, hasher: Hasher, lo: np.ndarray, hi: np.ndarray,
                into: list, where: np.ndarray) -> None:
        """Ids of the segments [lo, hi), written to ``into`` at ``where``."""
        v, size = self.v, hi - lo
        tied = np.zeros(len(lo), bool)
        if v.kind == BPE:
            two = np.minimum(lo + 1, len(code) - 1)
            tied = (size > 1) & (code[lo] == ord(SPACE)) & (code[two] == ord(SPACE))
            # A batch of one long segment gains nothing from numpy; it is merged by heap.
            tied |= size > LONG
        for i in np.flatnonzero(tied):
            text = "".join(map(chr, code[lo[i]:hi[i]]))
            into[where[i]] = np.array([x for s in v.merge(text)[0] for x in (
                [v.ids[s]] if s in v.ids else self._char_ids(ord(s)))], np.int32)
        for n in np.unique(size[~tied]):
            mine = np.flatnonzero((size == n) & ~tied)
            if n == 1:
                found = v.lookup(hasher.of(lo[mine], hi[mine]))
                for i, x in zip(mine, found):
                    into[where[i]] = np.array(
                        [x] if x >= 0 else self._char_ids(int(code[lo[i]])), np.int32)
                continue
            seg, pos, got = walk_back(*viterbi(v, self.pairs, hasher, lo[mine], int(n)),
                                      int(n))
            odd = set(seg[got < 0].tolist())
            cut = np.searchsorted(seg, np.arange(len(mine) + 1))
            got32 = got.astype(np.int32)
            for s, i in enumerate(mine):
                own = got32[cut[s]:cut[s + 1]]
                if s in odd:
                    at = pos[cut[s]:cut[s + 1]]
                    own = np.array([x for p, t in zip(at, own) for x in (
                        [t] if t >= 0 else self._char_ids(int(code[lo[i] + p])))], np.int32)
                into[where[i]] = own

    def encode(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts and the offsets of each text in them."""
        full = [SPACE + t.replace(" ", SPACE) if t else "" for t in texts]
        size = np.array([len(t) for t in full], np.int64)
        code = codes("".join(full))
        if not len(code):
            return np.empty(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        cut = np.ones(len(code) + 1, bool)
        cut[1:-1] = ~self.v.crossable(code)
        cut[np.cumsum(size)] = True
        edge = np.flatnonzero(cut)
        lo, hi = edge[:-1], edge[1:]
        hasher = Hasher(code)
        name, first, which = np.unique(hasher.of(lo, hi), return_index=True, return_inverse=True)
        names = name.tolist()
        ids: list = [self.kept.get(h) for h in names]
        new = np.array([i for i, x in enumerate(ids) if x is None], np.int64)
        if len(new):
            self._encode(code, hasher, lo[first[new]], hi[first[new]], ids, new)
            if len(self.kept) + len(new) > KEPT_SEGMENTS:
                self.kept = {}
            self.kept.update((names[i], ids[i]) for i in new[:KEPT_SEGMENTS].tolist())
        count = np.array([len(x) for x in ids], np.int64)
        begin = np.concatenate((np.zeros(1, np.int64), np.cumsum(count)))
        flat = np.concatenate(ids)
        n = count[which]
        to = np.concatenate((np.zeros(1, np.int64), np.cumsum(n)))
        out = flat[np.repeat(begin[which] - to[:-1], n) + np.arange(to[-1])]
        text_first = np.searchsorted(lo, np.concatenate((np.zeros(1, np.int64), np.cumsum(size))))
        return out, to[text_first]


def decoder(v: Vocabulary):
    """Function from a list of ids to its text."""
    raw = [p.replace(SPACE, " ").encode() if t == NORMAL else
           bytes([int(p[3:-1], 16)]) if t == BYTE else
           " ⁇ ".encode() if t == UNKNOWN else b""
           for p, t in zip(v.texts, v.types)]

    def decode(ids) -> str:
        out = b"".join([raw[i] for i in ids])
        out = out[1:] if out[:1] == b" " else out
        try:
            return out.decode("utf-8", "surrogatepass")
        except UnicodeDecodeError:
            return out.decode("utf-8", "replace")
    return decode


def _batches(texts: list):
    lo, n = 0, 0
    for i, t in enumerate(texts):
        if i > lo and n + len(t or "") > BATCH_CHARS:
            yield lo, i
            lo, n = i, 0
        n += len(t or "")
    yield lo, len(texts)


def encode_documents(docs: DataFrame, keep: list[str], text: str = "text",
                     model: Vocabulary | None = None, ids: str = "ids",
                     round_trip: str | None = "round_trip") -> DataFrame:
    """``keep`` columns with the ids of each whole text and, if named, whether decoding them
    gives the text back. The vocabulary is broadcast; the model file bounds its size."""
    shared = docs.sparkSession.sparkContext.broadcast(model or load_model())
    fields = [T.StructField(ids, T.ArrayType(T.IntegerType()))]
    if round_trip:
        fields.append(T.StructField(round_trip, T.BooleanType()))

    def make():
        encoder, decode = Encoder(shared.value), decoder(shared.value)

        def run(texts):
            flat, at, same = [], [np.zeros(1, np.int64)], []
            for lo, hi in _batches(texts):
                part, to = encoder.encode(texts[lo:hi])
                flat.append(part)
                at.append(at[-1][-1] + to[1:])
                if round_trip:
                    as_list = part.tolist()
                    same += [None if t is None else
                             decode(as_list[to[k]:to[k + 1]]) == t.replace(SPACE, " ")
                             for k, t in enumerate(texts[lo:hi])]
            offsets = pa.array(np.concatenate(at).astype(np.int32))
            if any(t is None for t in texts):
                null = np.array([t is None for t in texts] + [False])
                offsets = pa.array(np.concatenate(at).astype(np.int32), mask=null)
            out = {ids: pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(flat), pa.int32()))}
            return out | ({round_trip: same} if round_trip else {})
        return run
    return map_texts(docs, make, fields, keep, text)


def decode_documents(rows: DataFrame, keep: list[str], ids: str = "ids", text: str = "text",
                     model: Vocabulary | None = None) -> DataFrame:
    """``keep`` columns with the text of each list of ids (null for null)."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(model or load_model())
    schema = T.StructType([*[rows.schema[c] for c in keep], T.StructField(text, T.StringType())])
    cols = [*keep, ids] if ids not in keep else list(keep)

    def run(batches):
        decode = decoder(shared.value)
        for b in batches:
            texts = [None if x is None else decode(x) for x in b.column(cols.index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*[b.column(cols.index(c)) for c in keep], pa.array(texts, pa.string())],
                names=[*keep, text])
    return rows.select(*[F.col(f"`{c}`") for c in cols]).mapInArrow(run, schema)


def tokenized(docs: DataFrame, model: Vocabulary | None = None) -> DataFrame:
    """``docs`` with its text replaced by ``ids`` and ``n_tokens`` at the end."""
    df, _, name = apart(docs)
    keep = [c for c in df.columns if c != name("text")]
    out = encode_documents(df, keep, name("text"), model, round_trip=None)
    old = [c for c in docs.columns if c not in ("text", "ids", "n_tokens")]
    return out.select(*[F.col(name(c)).alias(c) for c in old], "ids",
                      F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"))
