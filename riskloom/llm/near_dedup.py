"""Near-duplicate detection: BagMinHash signatures, banding, verified multiset overlap.

A document is the bag of its five-word shingles (words are separated by white space; a shorter
text is one shingle). Two documents are linked if their bags overlap by ``THRESHOLD`` or more:
sum of minima over sum of maxima. Classes are the connected components of the links.

Signatures: every shingle owns Poisson processes over its weight axis, cut into the dyadic
blocks [0,1), [1,2), [2,4), [4,8), ... A point has a time, a register and a place in its block,
all drawn from the shingle's hash, so equal shingles have equal points in every document; the
place is the path of halvings inside the block, and a point counts where it lies below the
shingle's weight. A register keeps the earliest point of the bag; two registers agree with
probability equal to the weighted Jaccard similarity. Points come in order of time and stop at
the time by which all registers are filled, so a bag costs its size plus m log m points, not
its size times m.

Search: equal texts collapse first. Documents that agree in all registers of a band share a
bucket. Nobody emits all pairs of a bucket; two steps verify its members:

1. Star rounds. Each bucket verifies its members against one pivot, the member with most company
   in all its buckets, which links most of a family of copies at once. Components of the links
   found so far are carried on, and only new links between them are joined. Since one minus the
   overlap is a metric, a member y outside the first pivot's component can only be linked to a member x
   with |d(pivot, x) - d(pivot, y)| <= 1 - THRESHOLD; members out of reach of all such y leave.
   Rounds go on while each settles at least half of the open members, so they are few.
2. Rare shingles. Members still open are often just below the threshold of many others. Two bags
   that overlap by ``THRESHOLD`` share one of their rarest shingles (their prefixes, in one order
   of all shingles), at places that leave room for the rest of the overlap. So only a document's
   prefix is emitted, and pairs form where a rare shingle meets at such places. The order comes
   from shingle counts in a table of ``ORDER_SLOTS`` slots; any order loses no link.

Pairs of both steps are verified on whole texts. No link between two members of a bucket is lost.

With ``BANDS`` bands of ``ROWS`` registers a pair at 0.8 shares no bucket with probability
(1 - 0.8^5)^32, about 3 in a million.

Defined results: a text without words (null, empty, blank) is in a class of its own; a null
doc_id is a document like any other; repeated rows are equal texts; the class id is the
smallest doc_id of the class (null if all are null) and the document kept is the row with it,
the first read if several; an empty table gives no rows; other columns stay as they are.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.llm.common import apart, cut, handed_on, map_texts, tune
from riskloom.llm.subwords import mix

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 32, 5
REGISTERS = BANDS * ROWS
#: Slots of the shingle counts that order prefixes, and documents read by one task there.
ORDER_SLOTS, TEXTS_PER_TASK = 1 << 20, 20_000
#: Rows of (row, label) or of bucket members for one task, and for a broadcast after counting
#: (32 bytes a row at most).
ROWS_PER_TASK, BROADCAST_ROWS = 100_000, 200_000
#: Time allowed beyond the mean filling time before a document's stopping time doubles.
SLACK = 3.5
_G = np.uint64(0x9E3779B97F4A7C15)
_P = np.uint64(0x100000001B3)


def words_of(text: str | None) -> list[str]:
    return text.split() if text else []


def bag_of(text: str | None) -> Counter:
    """Multiset of the text's shingles."""
    w = words_of(text)
    if len(w) < SHINGLE:
        return Counter([tuple(w)]) if w else Counter()
    return Counter(zip(*(w[k:] for k in range(SHINGLE))))


def overlap(a: Counter, b: Counter) -> float:
    """Multiset Jaccard similarity; 0 for two empty bags."""
    if len(a) > len(b):
        a, b = b, a
    common = sum(min(n, b[s]) for s, n in a.items() if s in b)
    total = a.total() + b.total() - common
    return common / total if total else 0.0


def weighted_shingles(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, shingle hash, weight) of the distinct shingles of every text."""
    lists = [words_of(t) for t in texts]
    n = np.array([len(x) for x in lists], np.int64)
    flat = [w for x in lists for w in x]
    if not flat:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
    code, kinds = pd.factorize(np.array(flat, dtype=object))
    word = pd.util.hash_array(np.asarray(kinds, dtype=object), categorize=False)[code]
    count = np.where(n > 0, np.maximum(n - SHINGLE + 1, 1), 0)
    doc = np.repeat(np.arange(len(texts)), count)
    base = np.concatenate((np.zeros(1, np.int64), np.cumsum(n)[:-1]))
    first = np.concatenate((np.zeros(1, np.int64), np.cumsum(count)[:-1]))
    at = base[doc] + np.arange(len(doc)) - first[doc]
    end = (base + n)[doc]
    h = np.full(len(doc), _G)
    with np.errstate(over="ignore"):
        for k in range(SHINGLE):
            there = at + k < end
            h = mix(h * _P + np.where(there, word[np.minimum(at + k, len(word) - 1)],
                                      np.uint64(0)))
        # Equal shingles of one text become neighbours.
        key = mix(h ^ mix(doc.astype(np.uint64) + _G))
    order = np.argsort(key)
    new = np.concatenate(([True], key[order][1:] != key[order][:-1]))
    lead = np.flatnonzero(new)
    weight = np.diff(np.append(lead, len(order)))
    return doc[order][lead], h[order][lead], weight


def blocks(doc: np.ndarray, h: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, block hash, low end, length, weight) of the dyadic blocks that reach below each
    shingle's weight."""
    parts = []
    t = 0
    while True:
        low = 0 if t == 0 else 1 << (t - 1)
        some = np.flatnonzero(weight > low)
        if not len(some):
            break
        size = 1 if t == 0 else low
        with np.errstate(over="ignore"):
            seed = mix(h[some] + np.uint64(t) * _G)
        parts.append((doc[some], seed, np.full(len(some), low, float),
                      np.full(len(some), size, float), weight[some].astype(float)))
        t += 1
    return tuple(np.concatenate(x) for x in zip(*parts))


def registers(texts: list, m: int = REGISTERS) -> tuple[np.ndarray, np.ndarray]:
    """Registers (texts x m, 32-bit) and the weight of each text's bag; rows of texts without
    words are zero."""
    doc, h, weight = weighted_shingles(texts)
    total = np.bincount(doc, weight, len(texts)).astype(np.int64)
    out = np.zeros((len(texts), m), np.uint32)
    if not len(doc):
        return out, total
    doc, seed, low, size, weight = blocks(doc, h, weight)
    todo = total > 0
    stop = (np.log(m) + SLACK) / np.maximum(total, 1)
    while todo.any():
        live = np.flatnonzero(todo[doc])
        d, s, time = doc[live], seed[live], np.zeros(len(live))
        earliest = np.full(len(texts) * m, np.inf)
        where, when, name = [], [], []
        k = 0
        while len(live):
            k += 1
            with np.errstate(over="ignore"):
                r = mix(s + np.uint64(k) * _G)
                q = mix(r + _P)
            time = time - np.log(((r >> np.uint64(11)).astype(float) + 1) * 2.0 ** -53) / (
                m * size[live])
            go = time <= stop[d]
            live, d, s, time, q = live[go], d[go], s[go], time[go], q[go]
            place = low[live] + size[live] * ((q >> np.uint64(32)).astype(float) * 2.0 ** -32)
            hit = place < weight[live]
            where.append(d[hit] * m + ((q[hit] & np.uint64(0xFFFFFFFF)) % np.uint64(m)).astype(np.int64))
            when.append(time[hit])
            name.append(mix(q[hit]).astype(np.uint32))
        where, when, name = map(np.concatenate, (where, when, name))
        np.minimum.at(earliest, where, when)
        won = when == earliest[where]
        flat = out.reshape(-1)
        flat[where[won]] = name[won]
        full = np.isfinite(earliest.reshape(-1, m)).all(axis=1)
        todo &= ~full
        stop = stop * 2
    return out, total


def band_keys(reg: np.ndarray) -> np.ndarray:
    """64-bit key of every band of registers."""
    part = reg.reshape(len(reg), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(mix(np.arange(1, BANDS + 1).astype(np.uint64)), part.shape[:2]).copy()
    with np.errstate(over="ignore"):
        for k in range(ROWS):
            key = mix(key * _P + part[:, :, k])
    return key.view(np.int64)


def _signer():
    def run(texts):
        reg, total = registers(texts)
        keys = band_keys(reg)
        offsets = np.concatenate(([0], np.cumsum(np.where(total > 0, BANDS, 0))))
        return {"same": [hashlib.md5(t.encode("utf-8", "surrogatepass")).digest() if t else b""
                         for t in texts],
                "weight": total.tolist(),
                "bands": pa.ListArray.from_arrays(
                    pa.array(offsets.astype(np.int32)), pa.array(keys[total > 0].reshape(-1)))}
    return run


def signed(docs: DataFrame, keep: list[str], text: str) -> DataFrame:
    """``keep`` columns with a row number, the text's identity (MD5 of the whole text), its
    weight and its band keys, written to shared storage so that the numbers stay."""
    fields = [T.StructField("same", T.BinaryType()), T.StructField("weight", T.LongType()),
              T.StructField("bands", T.ArrayType(T.LongType()))]
    out = map_texts(docs, _signer, fields, keep, text)
    return handed_on(out.withColumn("row", F.monotonically_increasing_id()), "signatures")


def similarities(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, sim) of every pair of rows, from their whole texts. The pivot side's text joins
    last; adaptive execution splits pivots with many members."""
    tune(pairs.sparkSession)
    both = (pairs.join(texts.select(F.col("row").alias("b"), F.col("text").alias("tb")), "b")
            .join(texts.select(F.col("row").alias("a"), F.col("text").alias("ta")), "a")
            .select("a", "b", "ta", "tb"))
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()),
                           T.StructField("sim", T.DoubleType())])

    def run(batches):
        last, bag = None, None
        for x in batches:
            a, b, ta, tb = (c.to_pylist() for c in x.columns)
            sim = []
            for i, t, u in zip(a, ta, tb):
                if i != last:
                    last, bag = i, bag_of(t)
                sim.append(overlap(bag, bag_of(u)))
            yield pa.RecordBatch.from_arrays(
                [x.column(0), x.column(1), pa.array(sim, pa.float64())], names=schema.names)
    return both.mapInArrow(run, schema)


def _packed(df: DataFrame) -> tuple[DataFrame, int]:
    """``df`` written to shared storage and read by one task per ``ROWS_PER_TASK`` rows, and
    its row count: slim frames need few tasks, however many partitions their shuffle had."""
    out = cut(df)
    n = out.count()
    return out.coalesce(1 + n // ROWS_PER_TASK), n


def _sized(df: DataFrame, n: int) -> DataFrame:
    """Join side of ``n`` counted rows: broadcast up to ``BROADCAST_ROWS``, else shuffled."""
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def components(links: DataFrame) -> DataFrame:
    """(row, label) of every row in a link; the label is the smallest row of its component.
    Labels spread along links and then jump to their own label's label, until none changes."""
    both, _ = _packed(links.select(F.col("a").alias("u"), F.col("b").alias("v"))
                      .union(links.select("b", "a")).distinct())
    label, n = _packed(both.groupBy(F.col("u").alias("row"))
                       .agg(F.least(F.min("v"), F.first("u")).alias("label")))
    while True:
        side = lambda **names: _sized(label.select(
            *[F.col(c).alias(x) for c, x in names.items()]), n)
        near = both.join(side(row="v", label="label"), "v").select(F.col("u").alias("row"), "label")
        low = label.union(near).groupBy("row").agg(F.min("label").alias("label"))
        new = (low.join(side(row="label", label="further"), "label", "left")
               .select("row", F.least("label", F.coalesce("further", "label")).alias("label"))
               # The former label rides along, so one pass tells whether anything moved.
               .join(side(row="row", label="old"), "row"))
        new, _ = _packed(new.coalesce(1 + n // ROWS_PER_TASK))
        label = new.select("row", "label")
        if new.where("label <> old").isEmpty():
            return label


def _labels(rows: DataFrame, label: DataFrame, row: str, name: str) -> DataFrame:
    """``rows`` with the component of column ``row``; a row without links is its own."""
    known = label.select(F.col("row").alias(row), F.col("label").alias(name))
    return rows.join(_sized(known, label.count()), row, "left").withColumn(name, F.coalesce(name, row))


def _merged(label: DataFrame | None, found: DataFrame) -> DataFrame:
    """Labels after the new links ``found``: components of the links between present labels."""
    if label is None:
        return components(found)
    lifted = _labels(_labels(found.select("a", "b"), label, "a", "la"), label, "b", "lb")
    new = components(lifted.where("la <> lb").select(F.col("la").alias("a"), F.col("lb").alias("b")))
    rows = label.union(new.select("row", F.col("row").alias("label"))).groupBy("row").agg(
        F.min("label").alias("label"))
    out, _ = _packed(_labels(rows, new, "label", "to").select("row", F.col("to").alias("label")))
    return out


def prefix_tokens(texts: list, common: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text number, token, place, weight) of the tokens in each text's prefix that others may
    have. A shingle's n-th occurrence is a token of its own, so bags are sets of tokens; they
    are ordered by their slot's count in ``common``, then by hash."""
    doc, h, weight = weighted_shingles(texts)
    first = np.cumsum(weight) - weight
    nth = np.arange(int(weight.sum())) - np.repeat(first, weight)
    doc = np.repeat(doc, weight)
    with np.errstate(over="ignore"):
        token = mix(np.repeat(h, weight) + nth.astype(np.uint64) * _G)
    count = common[(token & np.uint64(ORDER_SLOTS - 1)).astype(np.int64)]
    order = np.lexsort((token, count, doc))
    doc, token, count = doc[order], token[order], count[order]
    total = np.bincount(doc, minlength=len(texts))
    place = np.arange(len(doc)) - (np.cumsum(total) - total)[doc]
    w = total[doc]
    keep = (place <= w - np.ceil(THRESHOLD * w - 1e-9)) & (count > 1)
    return doc[keep], token[keep].view(np.int64), place[keep], w[keep]


def shingle_counts(rows: DataFrame) -> np.ndarray:
    """Tokens per slot over the texts of ``rows``: a table of fixed size."""
    def run(batches):
        total = np.zeros(ORDER_SLOTS, np.int64)
        for b in batches:
            doc, h, weight = weighted_shingles(b.column("text").to_pylist())
            first = np.cumsum(weight) - weight
            nth = np.arange(int(weight.sum())) - np.repeat(first, weight)
            with np.errstate(over="ignore"):
                token = mix(np.repeat(h, weight) + nth.astype(np.uint64) * _G)
            total += np.bincount((token & np.uint64(ORDER_SLOTS - 1)).astype(np.int64),
                                 minlength=ORDER_SLOTS)
        # A token that one task saw once may be seen by another task, so all counts go out.
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["slot", "n"])
    got = (rows.select("text").mapInArrow(run, "slot long, n long")
           .groupBy("slot").agg(F.sum("n").alias("n")).toPandas())
    out = np.zeros(ORDER_SLOTS, np.int64)
    out[got["slot"].to_numpy()] = got["n"].to_numpy()
    return out


def rare_shingle_pairs(left: DataFrame, known: DataFrame) -> DataFrame:
    """(a, b) pairs of rows of ``left`` (row, own, open) in different components, one of them
    open, that can overlap by ``THRESHOLD``."""
    spark = left.sparkSession
    tune(spark)
    rows, n = _packed(left)
    rows = cut(known.join(_sized(rows, n), "row").coalesce(1 + n // TEXTS_PER_TASK))
    common = spark.sparkContext.broadcast(shingle_counts(rows))

    def run(batches):
        for b in batches:
            row, own, open_ = (b.column(c).to_numpy(zero_copy_only=False) for c in ("row", "own", "open"))
            doc, token, place, w = prefix_tokens(b.column("text").to_pylist(), common.value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(token), pa.array(place), pa.array(w), pa.array(row[doc]),
                 pa.array(own[doc]), pa.array(open_[doc])],
                names=["token", "place", "w", "row", "own", "open"])
    tokens = cut(rows.select("row", "own", "open", "text").mapInArrow(
        run, "token long, place long, w long, row long, own long, open boolean"))

    def needed(w, v):  # least common tokens of two bags of these weights
        return F.ceil((w + v) * (THRESHOLD / (1 + THRESHOLD)) - 1e-9)
    # Tokens that meet no open document of another component, and places too late for the
    # smallest bag that has the token, go before any pair is made.
    told = (tokens.groupBy("token").agg(F.min("w").alias("least"), F.min("own").alias("lo"),
                                        F.max("own").alias("hi"), F.max("open").alias("any"))
            .where("lo <> hi AND any").select("token", "least"))
    least = F.greatest(F.col("least"), F.ceil(F.col("w") * THRESHOLD - 1e-9))
    some, _ = _packed(tokens.join(told, "token").where(
        F.col("place") <= F.col("w") - needed(F.col("w"), least)).drop("least"))
    x = some.where("open").select("token", *[F.col(c).alias(f"x_{c}") for c in ("place", "w", "row", "own")])
    y = some.select("token", *[F.col(c).alias(f"y_{c}") for c in ("place", "w", "row", "own", "open")])
    room = F.least(F.col("x_w") - F.col("x_place"), F.col("y_w") - F.col("y_place"))
    return (x.join(y, (x["token"] == y["token"]) & (F.col("x_own") != F.col("y_own"))
                   & ((F.col("x_row") < F.col("y_row")) | ~F.col("y_open"))
                   & (F.least("x_w", "y_w") >= THRESHOLD * F.greatest("x_w", "y_w") - 1e-9)
                   & (room >= needed(F.col("x_w"), F.col("y_w"))))
            .select(F.least("x_row", "y_row").alias("a"), F.greatest("x_row", "y_row").alias("b"))
            .distinct())


def find_links(reps: DataFrame, texts) -> DataFrame:
    """(row, label) components of the links among the bucket members ``reps`` (row, weight,
    bands) with pairwise different texts; rows without links are left out. ``texts`` gives (row,
    text) for a frame of rows."""
    spark = reps.sparkSession
    place = cut(reps.select(F.explode("bands").alias("bucket"), "row", "weight"))
    shared = place.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    member, _ = _packed(place.join(shared, "bucket"))
    # Pivots are the members with most company in all their buckets: central to a family of
    # copies, so that one round links most of it.
    company = member.groupBy("row").agg(F.sum("n").alias("company"))
    member, n_member = _packed(member.drop("n").join(company, "row").withColumns(
        {"open": F.lit(True), "main": F.lit(None).cast("long")}))
    if not n_member:
        return spark.createDataFrame([], "row long, label long")
    known = handed_on(texts(member.select("row").distinct()), "candidate-texts")
    reach = 1 - THRESHOLD + 1e-9
    label, before = None, None
    while True:
        head = (member.where("open").groupBy("bucket")
                .agg(F.min(F.struct(-F.col("company"), F.col("row").alias("row"))).alias("top"))
                .select("bucket", F.col("top.row").alias("pivot")))
        to_pivot = member.join(head, "bucket").where(F.col("row") != F.col("pivot"))
        pairs = to_pivot.select(F.col("pivot").alias("a"), F.col("row").alias("b")).distinct()
        seen, n_seen = _packed(similarities(pairs, known))
        label = _merged(label, seen.where(F.col("sim") >= THRESHOLD))
        d = to_pivot.join(_sized(seen.select(
            F.col("a").alias("pivot"), F.col("b").alias("row"), (1 - F.col("sim")).alias("d")),
            n_seen), ["pivot", "row"])
        # Open are those outside the component of the bucket's first pivot.
        d = d.withColumn("main", F.coalesce("main", "pivot"))
        d = _labels(_labels(d, label, "row", "own"), label, "main", "its")
        d = d.withColumn("open", F.col("open") & (F.col("own") != F.col("its"))).select(
            "bucket", "row", "weight", "company", "own", "main", "d", "open")
        d, _ = _packed(d)
        # Buckets with open members, and how near the pivot they are.
        rest = d.where("open").groupBy("bucket").agg(F.min("d").alias("nearest"))
        # Open members stay, so only the others look up their bucket (one row of ``rest`` each).
        near = d.where(~F.col("open")).join(rest, "bucket").where(F.col("d") >= F.col("nearest") - reach)
        left = d.where("open").unionByName(near.drop("nearest"))
        # A bucket is settled when what is left of it lies in one component.
        several = (left.groupBy("bucket").agg(F.min("own").alias("lo"), F.max("own").alias("hi"))
                   .where("lo <> hi").select("bucket"))
        left, _ = _packed(left.join(several, "bucket"))
        rows = left.groupBy("row").agg(F.min("own").alias("own"), F.max("open").alias("open"))
        n_open = rows.where("open").count()
        if not n_open:
            return label
        if before is not None and 2 * n_open > before:
            break
        before = n_open
        member = left.select("bucket", "row", "weight", "company", "open", "main")
    pairs, n_pairs = _packed(rare_shingle_pairs(rows, known))
    if not n_pairs:
        return label
    return _merged(label, cut(similarities(pairs, known)).where(F.col("sim") >= THRESHOLD))


def classified(docs: DataFrame, keep: list[str], doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """The signed rows (``keep`` columns, row, ...) and, per row, label (of its class),
    class_id and kept."""
    rows = signed(docs, keep, text)
    order = F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("doc"), "row")
    slim = rows.select("row", "same", "weight", order.alias("first"))
    worded = slim.where("weight > 0")
    groups = cut(worded.groupBy("same").agg(F.min("row").alias("rep"), F.min("first").alias("first")))
    reps = (rows.select("row", "weight", "bands")
            .join(groups.select(F.col("rep").alias("row")), "row"))

    def texts(wanted: DataFrame) -> DataFrame:
        return rows.select("row", F.col(text).alias("text")).join(wanted, "row", "left_semi")

    label = find_links(reps, texts)
    # Only classes of several texts have labels; the rest is settled by equal texts alone.
    named = _labels(groups, label, "rep", "label")
    heads = named.groupBy("label").agg(F.min("first").alias("head"))
    head_of = named.join(heads, "label").select("same", "label", "head")
    out = (worded.select("row", "same").join(head_of, "same")
           .select("row", "label", F.col("head.doc").alias("class_id"),
                   (F.col("head.row") == F.col("row")).alias("kept")))
    alone = slim.where("weight = 0").select("row", F.col("row").alias("label"),
                                            F.col("first.doc").alias("class_id"),
                                            F.lit(True).alias("kept"))
    return rows, out.unionByName(alone)


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id and kept of every document."""
    rows, found = classified(docs.select("doc_id", "text"), ["doc_id", "text"], "doc_id", "text")
    return rows.select("row", "doc_id").join(found, "row").select("doc_id", "class_id", "kept")


def deduplicated(docs: DataFrame) -> DataFrame:
    """One document of each class, with the columns of ``docs``."""
    df, back, name = apart(docs)
    rows, found = classified(df, df.columns, name("doc_id"), name("text"))
    return back(rows.join(found.where(~F.col("kept")).select("row"), "row", "left_anti"))
