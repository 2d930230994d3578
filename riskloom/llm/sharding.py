"""Sharding through fixed virtual slots.

Every record hashes into one of ``SLOTS`` virtual slots, and a small versioned map says
which shard owns each slot. Version 1 deals the slots round robin. Rebalancing aggregates
the bytes of each slot, edits the map by moving or swapping single slots from the fullest
to the emptiest shard, and appends the edited map as the next version; records never hash
anew. The map has ``SLOTS`` rows whatever the data size, so it may be edited on the driver
and broadcast.

Defined results: a null text counts no bytes (size 1, crc 0); a null doc_id is a key like
any other; repeated rows are counted together before the shuffle and dealt in chunks of
``CHUNK`` copies, each with a slot of its own, so one repeated record neither fills one task
nor one shard; an empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.llm.common import handed_on, scratch_path

SLOTS = 4096
CHUNK = 256
#: Rounds of map edits: a bound on the work over the fixed-size map, reached only when
#: every edit still helps.
MAX_EDITS = 20 * SLOTS


def initial_map(n_slots: int, n_shards: int) -> list[int]:
    return [s % n_shards for s in range(n_slots)]


def rebalance(owner: list[int], load: list[int], n_shards: int) -> tuple[list[int], int]:
    """Edited copy of the map and the number of edits: the fullest shard gives the slot, or
    swaps the pair of slots, that best halves its distance to the emptiest shard, until no
    edit brings the two closer."""
    owner = list(owner)
    total = [0] * n_shards
    slots: list[list[int]] = [[] for _ in range(n_shards)]
    for s, o in enumerate(owner):
        total[o] += load[s]
        if load[s]:
            slots[o].append(s)
    edits = 0
    while edits < MAX_EDITS:
        hi = max(range(n_shards), key=lambda k: (total[k], -k))
        lo = min(range(n_shards), key=lambda k: (total[k], k))
        gap = total[hi] - total[lo]
        if gap <= 1:
            break
        move = min(slots[hi], key=lambda s: (abs(2 * load[s] - gap), s))
        best, back = abs(2 * load[move] - gap), None
        if best:
            give = sorted(slots[hi], key=lambda s: (load[s], s))
            take = sorted(slots[lo], key=lambda s: (load[s], s))
            j = 0
            for s in give:
                while j < len(take) and 2 * (load[s] - load[take[j]]) > gap:
                    j += 1
                for k in (j - 1, j):
                    if 0 <= k < len(take):
                        d = abs(2 * (load[s] - load[take[k]]) - gap)
                        if d < best:
                            best, move, back = d, s, take[k]
        if best >= gap:
            break
        for s, a, b in ((move, hi, lo), (back, lo, hi)):
            if s is not None:
                owner[s] = b
                slots[a].remove(s)
                slots[b].append(s)
                total[a] -= load[s]
                total[b] += load[s]
                edits += 1
    return owner, edits


def grow(owner: list[int], load: list[int], n_shards: int) -> list[int]:
    """Map for one more shard: slots only move into the new shard, which takes them in turn
    from whichever shard is then the fullest, until it holds an even share."""
    owner, new = list(owner), n_shards
    heaps: dict[int, list] = {k: [] for k in range(n_shards)}
    total = [0] * n_shards
    for s, o in enumerate(owner):
        heapq.heappush(heaps[o], (-load[s], s))
        total[o] += load[s]
    share, got = sum(load) / (n_shards + 1), 0
    while any(heaps.values()):
        k = max(range(n_shards), key=lambda x: (total[x], -x))
        if not heaps[k]:
            break
        w, s = heapq.heappop(heaps[k])
        if got - w > share:
            # Too large for what is left: look at this shard's smaller slots only.
            if not heaps[k] or all(got - x[0] > share for x in heaps[k]):
                break
            continue
        owner[s] = new
        total[k] += w
        got -= w
    return owner


def slot_units(docs: DataFrame, n_slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, n, vslot): equal records counted together, in chunks of at
    most ``CHUNK`` copies, each chunk hashed into a virtual slot."""
    base = docs.select(
        F.col("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long")
        .alias("text_crc32"))
    counted = base.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("copies"))
    chunk = F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / CHUNK)))
    return (counted.select("*", chunk.alias("chunk"))
            .select("doc_id", "size", "text_crc32",
                    F.least(F.lit(CHUNK), F.col("copies") - F.col("chunk") * CHUNK).alias("n"),
                    F.pmod(F.xxhash64("doc_id", "text_crc32", "chunk"), F.lit(n_slots))
                    .cast("int").alias("vslot")))


def slot_loads(units: DataFrame) -> DataFrame:
    """(vslot, bytes, rows) of the occupied slots."""
    return units.groupBy("vslot").agg(F.sum(F.col("size") * F.col("n")).alias("bytes"),
                                      F.sum("n").alias("rows"))


def write_map(spark: SparkSession, path: str, version: int, owner: list[int],
              loads: dict[int, tuple[int, int]]) -> None:
    """Append one version of the map (one row per slot) to the map table at ``path``."""
    rows = [(s, o, *loads.get(s, (0, 0))) for s, o in enumerate(owner)]
    (spark.createDataFrame(rows, "vslot int, shard int, bytes long, rows long").coalesce(1)
     .write.mode("overwrite").parquet(f"{path}/version={version}"))


def read_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The map of ``version``, the latest when None."""
    every = spark.read.parquet(path)
    if version is None:
        version = every.agg(F.max("version")).first()[0]
    return every.where(F.col("version") == version)


def shard_documents(docs: DataFrame, n_shards: int = 16, n_slots: int = SLOTS,
                    map_path: str | None = None) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law ('bytes'), shard, slot (position
    in its shard, gapless from 0), grown_shard (null under this law), vslot (virtual slot)
    and map_version. The map versions stay at ``map_path``: 1 round robin, 2 edited for equal
    bytes."""
    spark = docs.sparkSession
    path = map_path or scratch_path(spark, "slot-map")
    units = handed_on(slot_units(docs, n_slots), "slot-units")
    loads = {r["vslot"]: (r["bytes"], r["rows"]) for r in slot_loads(units).collect()}
    first = initial_map(n_slots, n_shards)
    write_map(spark, path, 1, first, loads)
    edited, _ = rebalance(first, [loads.get(s, (0, 0))[0] for s in range(n_slots)], n_shards)
    write_map(spark, path, 2, edited, loads)
    # Where each slot's rows begin inside its shard: over the fixed-size map only.
    w = Window.partitionBy("shard").orderBy("vslot")
    owners = read_map(spark, path).select(
        "vslot", "shard", F.col("version").cast("int").alias("map_version"),
        (F.sum("rows").over(w) - F.col("rows")).alias("first_slot"))
    inside = (Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size", "n")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = (units.withColumn("before", F.sum("n").over(inside) - F.col("n"))
              .join(F.broadcast(owners), "vslot"))
    copy = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n").cast("long") - 1))
    return (placed.select("*", copy.alias("copy"))
            .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                    (F.col("first_slot") + F.col("before") + F.col("copy")).cast("long")
                    .alias("slot"),
                    F.lit(None).cast("int").alias("grown_shard"), "vslot", "map_version"))
