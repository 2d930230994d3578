"""Trie of shared conversation prefixes, built by bursting containers.

A conversation is a sequence of turns (role and text), named by the MD5 of both. Equal
sequences collapse first: conversations are sorted by sequence and id over all tasks, so the
ids of one sequence come out in order as pieces, and one digest runs over the pieces.

Containers: the distinct sequences below a trie head form a container, which holds their
remaining turns. A container of more than ``CONTAINER_TURNS`` remaining turns bursts: turns
that all its sequences share (the common prefix of the least and the greatest one) become a
chain of nodes, and the next turn's id deals the sequences to new heads one turn deeper.
Rounds end when no container is oversized; each round treats all oversized containers at once,
and a shared prefix of any length takes one round. The remaining containers are sorted and
swept: neighbours' common prefixes push and pop the nodes on a stack. Leaves and saved tokens
of the burst heads are summed from their containers, round by round upwards.

Containers hold ``CONTAINER_TURNS`` turns at most, or one sequence; one sequence's turn ids lie
in one row. No task gathers the conversations of a sequence or the sequences of a head.

Defined results: rows with a null conv_id belong to no conversation; turns come by number, null
first, and equal numbers by role and then by turn id; null role and text are empty; a
conversation without rebuilt turns ends at the root; an empty table has no nodes; other columns
are not read.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.llm.common import handed_on, tune

CONTAINER_TURNS = 20_000
#: Ids in one piece of a sequence's list, and heads that may be broadcast after counting.
PIECE_IDS, BROADCAST_HEADS = 4096, 100_000
ROOT = "root"


# ---- sequences ----

def sequences(conversations: DataFrame) -> DataFrame:
    """conv_id, ids and lens (code points of the text) of each conversation's turns."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turn = F.struct(
        F.col("turn"), role.alias("role"),
        F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("id"),
        F.length(text).cast("long").alias("len"))
    return (conversations.where(F.col("conv_id").isNotNull())
            .groupBy(F.col("conv_id").cast("long").alias("conv_id"))
            .agg(F.sort_array(F.collect_list(turn)).alias("turns"))
            .select("conv_id", F.col("turns.id").alias("ids"), F.col("turns.len").alias("lens")))


def rebuilt(own: DataFrame) -> DataFrame:
    """The contract's conversations: the first h turns of the hundred's first conversation,
    then the own turns after the first h. A head is joined to less than 200 conversations."""
    c = F.col("conv_id")
    base = own.where(c % 100 == 0).select(
        c.alias("base"), F.slice("ids", 1, 5).alias("base_ids"), F.slice("lens", 1, 5).alias("base_lens"))
    h = (F.crc32(c.cast("string").cast("binary")) % 6).cast("int")
    rows = own.select("*", (c - c % 100).alias("base"), h.alias("h")).join(base, "base", "left")

    def spliced(name: str) -> Column:
        head = F.coalesce(F.slice(f"base_{name}", F.lit(1), F.col("h")), F.array().cast(
            own.schema[name].dataType))
        return F.concat(head, F.slice(name, F.col("h") + 1, F.greatest(
            F.size(name) - F.col("h"), F.lit(0)))).alias(name)
    return rows.select("conv_id", spliced("ids"), spliced("lens"))


def distinct_sequences(rows: DataFrame) -> DataFrame:
    """One row per distinct sequence: ids, lens, n conversations, the lowest conv_id and the
    digest of all conv_ids. ``rows`` lies in shared storage."""
    tune(rows.sparkSession)
    named = rows.select(F.md5(F.array_join("ids", "")).alias("seq"), "conv_id")

    def pieces(batches):
        seq, ids = None, []

        def piece():
            return pa.RecordBatch.from_arrays(
                [pa.array([seq]), pa.array([ids[0]]), pa.array([len(ids)]),
                 pa.array([",".join(map(str, ids))])], names=["seq", "low", "n", "ids"])
        for b in batches:
            for s, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if s != seq or len(ids) == PIECE_IDS:
                    if ids:
                        yield piece()
                    seq, ids = s, []
                ids.append(c)
        if ids:
            yield piece()

    def digests(batches):
        seq, sha, low, n = None, None, None, 0
        out = []

        def flush():
            names = ["conv_id", "n", "ends"]
            return pa.RecordBatch.from_arrays(
                [pa.array(list(x), t) for x, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.string()))],
                names=names)
        for b in batches:
            for s, first, k, text in zip(*(c.to_pylist() for c in b.columns)):
                if s != seq:
                    if seq is not None:
                        out.append((low, n, sha.hexdigest()))
                    seq, sha, low, n = s, hashlib.sha256(text.encode()), first, k
                else:
                    sha.update(b"," + text.encode())
                    n += k
            if len(out) > 5000:
                yield flush()
                out = []
        if seq is not None:
            out.append((low, n, sha.hexdigest()))
        if out:
            yield flush()

    chunks = (named.repartitionByRange("seq", "conv_id").sortWithinPartitions("seq", "conv_id")
              .mapInArrow(pieces, "seq string, low long, n long, ids string"))
    ends = (chunks.repartition("seq").sortWithinPartitions("seq", "low")
            .mapInArrow(digests, "conv_id long, n long, ends string"))
    return rows.join(ends, "conv_id").select(
        "ids", "lens", "n", F.col("conv_id").alias("low"), "ends")


# ---- bursting ----

def _joined(rows: DataFrame, heads: DataFrame, n: int) -> DataFrame:
    """``heads`` has ``n`` counted rows, at most one per ``CONTAINER_TURNS`` turns."""
    return rows.join(F.broadcast(heads) if n <= BROADCAST_HEADS else heads, "head")


def _shared_turns(lo: Column, hi: Column) -> Column:
    """Leading turns that two sequences share."""
    equal = F.zip_with(lo, hi, lambda a, b: a.eqNullSafe(b))
    at = F.array_position(equal, False)
    return F.when(at > 0, at - 1).otherwise(F.size(lo)).cast("int")


#: A member of a container: the head's name and depth, its parent head and that one's lowest
#: conv_id, the length of the head's own turn, and the sequence below the head.
MEMBER = ["head", "depth", "parent", "parent_low", "top_len", "ids", "lens", "n", "low", "ends"]


def burst(members: DataFrame, limit: int) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """(members of containers within the limit, bursting heads, members of the new containers,
    number of bursting heads). A bursting head carries what is known of its branch node."""
    least = F.min(F.struct("ids", "lens"))
    sizes = (members.groupBy("head").agg(
        F.sum(F.size("ids")).alias("turns"), F.count("*").alias("sequences"),
        F.sum("n").alias("total"), F.min("low").alias("least_low"),
        least.alias("lo"), F.max("ids").alias("hi"))
        .where((F.col("turns") > limit) & (F.col("sequences") > 1)))
    skip = _shared_turns(F.col("lo.ids"), F.col("hi"))
    heads = handed_on(sizes.select(
        "head", "total", "least_low", skip.alias("skip"),
        F.slice("lo.lens", F.lit(1), skip).alias("chain")), "burst-heads")
    n = heads.count()
    if not n:
        return members, heads, members.limit(0), 0
    slim = heads.select("head", "skip", "least_low")
    calm = members.join(F.broadcast(slim) if n <= BROADCAST_HEADS else slim, "head", "left_anti")
    moved = _joined(members, slim, n)
    over = moved.where(F.size("ids") > F.col("skip"))
    ended = moved.where(F.size("ids") == F.col("skip")).select("head", F.col("ends").alias("branch_ends"))
    tops = members.groupBy("head").agg(*[F.min(c).alias(c) for c in
                                         ("depth", "parent", "parent_low", "top_len")])
    told = _joined(tops, heads, n).join(ended, "head", "left")
    step = F.col("skip") + 1
    new = over.select(
        F.md5(F.concat("head", F.array_join(F.slice("ids", F.lit(1), step), ""))).alias("head"),
        (F.col("depth") + step).alias("depth"), F.col("head").alias("parent"),
        F.col("least_low").alias("parent_low"), F.element_at("lens", step).alias("top_len"),
        F.slice("ids", step + 1, F.size("ids")).alias("ids"),
        F.slice("lens", step + 1, F.size("lens")).alias("lens"), "n", "low", "ends")
    return calm, handed_on(told, "burst"), handed_on(new.select(MEMBER), "containers"), n


# ---- sweeping ----

NODE = T.StructType(
    [T.StructField(n, T.LongType()) for n in
     ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")]
    + [T.StructField("ends_sha256", T.StringType())])
TOP = T.StructType([*NODE.fields, T.StructField("head", T.StringType()),
                    T.StructField("parent", T.StringType())])
NO_ENDS = hashlib.sha256(b"").hexdigest()


def sweep(depth: int, top_len: int, parent_low: int | None, members) -> list[list]:
    """Nodes of one container, the head first. ``members`` are (ids, lens, n, low, ends) of its
    sequences below the head, in order of ids."""
    # conv_id, depth, parent's place, n, children, leaves, saved, ends, length of the last text
    nodes = [[None, depth, None, 0, 0, 0, 0, NO_ENDS, top_len]]
    path, before = [0], []

    def close():
        k = path.pop()
        x = nodes[k]
        x[5] = x[5] or 1
        x[6] += (x[3] - 1) * x[8]
        if path:
            up = nodes[path[-1]]
            x[2] = path[-1]
            up[3] += x[3]
            up[4] += 1
            up[5] += x[5]
            up[6] += x[6]
            up[0] = x[0] if up[0] is None else min(up[0], x[0])

    for ids, lens, n, low, ends in members:
        same = 0
        for a, b in zip(before, ids):
            if a != b:
                break
            same += 1
        while len(path) > same + 1:
            close()
        for k in range(same, len(ids)):
            path.append(len(nodes))
            nodes.append([None, depth + k + 1, None, 0, 0, 0, 0, NO_ENDS, lens[k]])
        end = nodes[path[-1]]
        end[3] += n
        end[7] = ends
        end[0] = low if end[0] is None else min(end[0], low)
        before = ids
    while path:
        close()
    for x in nodes[1:]:
        x[2] = nodes[x[2]][0]
    nodes[0][2] = parent_low
    return nodes


def swept(members: DataFrame) -> DataFrame:
    """Nodes of all containers; a container's own head carries the names of head and parent."""
    types = [pa.int64()] * 7 + [pa.string()] * 3

    def run(batches):
        head, about, mine, out = None, None, [], []

        def finish():
            nodes = [x[:8] + [None, None] for x in sweep(*about[:3], mine)]
            nodes[0][8:] = [head, about[3]]
            out.extend(nodes)

        def flush():
            return pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(zip(*out), types)], names=TOP.names)

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if row[0] != head:
                    if mine:
                        finish()
                    head, about, mine = row[0], (row[1], row[4], row[3], row[2]), []
                mine.append(row[5:])
                if len(out) > 20_000:
                    yield flush()
                    out = []
        if mine:
            finish()
        if out:
            yield flush()

    return (members.select(MEMBER).repartition("head").sortWithinPartitions("head", "ids")
            .mapInArrow(run, TOP))


def burst_nodes(heads: DataFrame, below: DataFrame) -> DataFrame:
    """Nodes of the bursting ``heads``: the chain of shared turns down to the branch node.
    ``below`` are the heads of their containers, with whole subtrees."""
    sums = below.groupBy(F.col("parent").alias("head")).agg(
        F.count("*").alias("children"), F.sum("n_leaves").alias("leaves"),
        F.sum("saved_tokens").alias("saved"))
    x = heads.join(sums, "head")
    lens = F.concat(F.array("top_len"), "chain")
    x = x.select("*", F.posexplode(lens).alias("at", "_"), lens.alias("all_lens"))
    rest = F.slice("all_lens", F.col("at") + 1, F.size("all_lens"))
    own = F.aggregate(rest, F.lit(0).cast("long"), lambda a, b: a + b) * (F.col("total") - 1)
    branch = F.col("at") == F.col("skip")
    top = F.col("at") == 0
    return x.select(
        F.col("least_low").alias("conv_id"), (F.col("depth") + F.col("at")).cast("long").alias("depth"),
        F.when(top, F.col("parent_low")).otherwise(F.col("least_low")).alias("parent_conv_id"),
        F.col("total").alias("n_convs"),
        F.when(branch, F.col("children")).otherwise(1).cast("long").alias("n_children"),
        F.col("leaves").alias("n_leaves"), (F.col("saved") + own).alias("saved_tokens"),
        F.when(branch, F.coalesce("branch_ends", F.lit(NO_ENDS))).otherwise(NO_ENDS).alias("ends_sha256"),
        F.when(top, F.col("head")).alias("head"), F.when(top, F.col("parent")).alias("parent"))


def trie(rows: DataFrame, limit: int = CONTAINER_TURNS) -> DataFrame:
    """Nodes of the trie of (conv_id, ids, lens) rows, one conversation each."""
    rows = handed_on(rows, "conversations")
    active = handed_on(distinct_sequences(rows).select(
        F.lit(ROOT).alias("head"), F.lit(0).cast("long").alias("depth"),
        F.lit(None).cast("string").alias("parent"), F.lit(None).cast("long").alias("parent_low"),
        F.lit(0).cast("long").alias("top_len"), "ids", "lens", "n", "low", "ends"), "containers")
    calm, heads = [], []
    while True:
        still, told, new, n = burst(active, limit)
        calm.append(still.select(MEMBER))
        if not n:
            break
        heads.append(told)
        active = new
    nodes = handed_on(swept(reduce(DataFrame.unionByName, calm)), "swept")
    parts = [nodes]
    for told in reversed(heads):
        # Parents of this round's containers are the heads that burst in it.
        tops = reduce(DataFrame.unionByName, parts).where(F.col("parent").isNotNull())
        parts.append(handed_on(burst_nodes(told, tops), "burst-nodes"))
    return reduce(DataFrame.unionByName, parts).select(*NODE.names)


def conversation_trie(conversations: DataFrame, limit: int = CONTAINER_TURNS) -> DataFrame:
    """Nodes of the prefix trie of the contract's rebuilt conversations."""
    return trie(rebuilt(handed_on(sequences(conversations), "turns")), limit)


#: The same nodes in SQL: prefixes as lists of turns, subtree sums over every node's ancestors.
ORACLE = """
WITH t AS (
  SELECT conv_id, list({'role': r, 'text': x} ORDER BY turn NULLS FIRST, r, md5(length(r) || ':' || r || x)) AS turns
  FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x
        FROM conversations WHERE conv_id IS NOT NULL)
  GROUP BY conv_id),
crc AS (
  SELECT conv_id, xor(4294967295, list_reduce(
    list_concat([4294967295::BIGINT], flatten(list_transform(
      string_split(conv_id::VARCHAR, ''),
      lambda ch: [ascii(ch)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, b: CASE WHEN b >= 0 THEN xor(a, b)
                      ELSE xor(a >> 1, 3988292384 * (a & 1)) END)) % 6 AS h
  FROM t),
c AS (
  SELECT t.conv_id, list_concat(coalesce(b.turns, [])[1:h], t.turns[h + 1:]) AS turns
  FROM t JOIN crc USING (conv_id) LEFT JOIN t AS b ON b.conv_id = t.conv_id - t.conv_id % 100),
p AS (
  SELECT conv_id, len(turns) AS size, d, turns[1:d] AS path
  FROM c, unnest(range(0, len(turns) + 1)) AS u(d)),
n AS (
  SELECT path, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         (count(*) - 1) * CASE WHEN d = 0 THEN 0 ELSE length(path[d].text) END AS saved,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)
                         FILTER (WHERE size = d), '')) AS ends_sha256
  FROM p GROUP BY path, d),
k AS (
  SELECT n.*, u.conv_id AS parent_conv_id
  FROM n LEFT JOIN n AS u ON n.depth = u.depth + 1 AND u.path = n.path[1:n.depth - 1]),
ch AS (SELECT path[1:depth - 1] AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
f AS (SELECT k.*, coalesce(n_children, 0) AS n_children FROM k LEFT JOIN ch USING (path)),
s AS (
  SELECT path[1:a] AS path, sum(saved) AS saved_tokens, count(*) FILTER (WHERE n_children = 0) AS n_leaves
  FROM f, unnest(range(0, depth + 1)) AS u(a) GROUP BY 1)
SELECT conv_id, depth::BIGINT AS depth, parent_conv_id, n_convs, n_children, n_leaves,
       saved_tokens::BIGINT AS saved_tokens, ends_sha256
FROM f JOIN s USING (path)
"""
