"""Prefix tries against a plain dictionary of prefixes, and the query against its SQL."""

import hashlib
import random
import zlib

import duckdb
import pytest

from riskloom.llm import prefix_trie, queries
from tests.llm.cases import SF


def brute_rebuilt(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            name = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own.setdefault(c, []).append((turn is not None, turn or 0, role, name, text))
    own = {c: [(x[2], x[4]) for x in sorted(t)] for c, t in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))  # the remainder keeps the sign
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def brute_trie(convs):
    members, ends = {}, {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        below = kids.get(p, [])
        leaves[p] = sum(leaves[k] for k in below) or 1
        saved[p] = (sum(saved[k] for k in below)
                    + (len(members[p]) - 1) * (len(p[-1][1]) if p else 0))
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m),
                   len(kids.get(p, [])), leaves[p], saved[p],
                   hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest())
                  for p, m in members.items())


COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
           "saved_tokens", "ends_sha256")


def collected(df):
    assert tuple(df.columns) == COLUMNS
    return sorted(tuple(r) for r in df.collect())


def key(r):
    return tuple(-10 ** 9 if x is None else x for x in r)


def test_query_equals_sql_and_brute_force(spark):
    got = collected(queries.op11_prefix_trie(spark, SF))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    sql = con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({queries.ORACLES['op11_prefix_trie']})").fetchall()
    rows = con.execute("SELECT conv_id, turn, role, text FROM conversations").fetchall()
    want = brute_trie(brute_rebuilt(rows))
    assert sorted(got, key=key) == sorted(want, key=key) == sorted(sql, key=key)


def random_conversations(seed, n):
    """Shared prefixes, copies, one long shared prefix that a third of all rows has, nulls,
    repeated rows, negative ids and empty texts."""
    rng = random.Random(seed)
    rows = []
    for c in range(-20, n):
        kind = rng.random()
        if kind < 0.3:
            turns = [("user", f"hot {k}") for k in range(40)] + [
                ("user", rng.choice("abcd")) for _ in range(rng.randint(0, 4))]
        elif kind < 0.4:
            turns = [("user", "same"), ("assistant", "copy")]
        else:
            turns = [(rng.choice(["user", "assistant", None]), rng.choice(["x", "yy", "zzz", "", None]))
                     for _ in range(rng.randint(1, 9))]
        rows += [(c, i, r, t) for i, (r, t) in enumerate(turns)]
    rows += [(None, 0, "user", "nobody"), (5, None, "user", "before all"), (5, None, None, None),
             (7, 0, "user", "twice"), (7, 0, "user", "twice")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("limit", [1, 30, 400, 20_000])
def test_bursting_equals_brute_force(spark, limit):
    rows = random_conversations(limit, 150)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows],
                               "conv_id long, turn long, role string, text string, n long, head string")
    got = collected(prefix_trie.conversation_trie(df.repartition(5), limit))
    assert sorted(got, key=key) == sorted(brute_trie(brute_rebuilt(rows)), key=key)


def test_copies_in_many_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE_IDS", 7)
    rows = [(c, ["a", "b"], [1, 2]) for c in range(300)] + [(c, [], []) for c in range(300, 330)]
    df = spark.createDataFrame(rows, "conv_id long, ids array<string>, lens array<long>")
    got = {r[1]: r for r in collected(prefix_trie.trie(df.repartition(6)))}
    digest = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert got[0][3] == 330 and got[0][7] == digest(range(300, 330))
    assert got[2][:7] == (0, 2, 0, 300, 0, 1, 299 * 2) and got[2][7] == digest(range(300))


def test_empty_table_and_turnless(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert prefix_trie.conversation_trie(spark.createDataFrame([], schema)).count() == 0
    only = [(1, 0, "user", "a")]  # one turn, and h turns of it go
    got = collected(prefix_trie.conversation_trie(spark.createDataFrame(only, schema)))
    assert got == brute_trie(brute_rebuilt(only))
