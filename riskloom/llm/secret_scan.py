"""Secret scan: one Aho-Corasick pass finds keywords, anchored expressions run only at the
hits, and candidates with an embedded checksum are validated by it.

Base kinds, leftmost and non-overlapping per kind as a full expression scan would give them:
``assign`` (keyword, separator, value of 6 characters or more), ``access`` (20 characters or
more) and ``hex`` (runs of 24 characters or more, found through all four-digit hexadecimal
keywords: every long run holds one at its very start). Kinds the checksum adds: ``github``
and ``npm`` tokens (six base-62 digits of the CRC-32 of the body) and ``xprv`` (an extended
private key in Base58Check: four bytes of a double SHA-256).

Defined results: null text is empty and has no spans; offsets are code points, end exclusive;
spans sort by start, then by kind in the order of ``KINDS``; overlapping spans of different
kinds all stay; other columns are carried through only where asked.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import zlib

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.llm.common import apart, map_texts

#: The base kinds' expressions and least lengths.
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
HEX_LEAST, ACCESS_LEAST, ASSIGN_LEAST = 24, 20, 6
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "github", "npm", "xprv")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"

_either = lambda s: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in s)
ASSIGN = re.compile(
    "(" + "|".join(_either(w) for w in ("password", "passwd", "secret", "token")) + "|"
    + _either("api") + "_?" + _either("key")
    + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX_RUN = re.compile("[0-9a-f]+")
HEX = re.compile("[0-9a-f]{%d,}" % HEX_LEAST)
_checked = {
    "github": re.compile(r"(?<![A-Za-z0-9_])gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])"),
    "npm": re.compile(r"(?<![A-Za-z0-9_])npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])"),
    "xprv": re.compile(r"(?<![A-Za-z0-9])xprv[%s]{107}(?![A-Za-z0-9])" % BASE58),
}
MASK = "[REDACTED]"

FIELDS = [T.StructField("spans", T.ArrayType(T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()),
    T.StructField("end", T.IntegerType())])))]


def base62_crc(body: str) -> str:
    """CRC-32 of ``body`` as six base-62 digits."""
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, d = divmod(n, 62)
        out = BASE62[d] + out
    return out


def base58check(text: str) -> bool:
    n = 0
    for c in text:
        n = n * 58 + BASE58.index(c)
    raw = n.to_bytes(max(5, (n.bit_length() + 7) // 8), "big")
    return hashlib.sha256(hashlib.sha256(raw[:-4]).digest()).digest()[:4] == raw[-4:]


def _valid(kind: str, m: re.Match) -> bool:
    return base58check(m[0]) if kind == "xprv" else base62_crc(m[1]) == m[2]


def prefilter() -> ahocorasick.Automaton:
    """Automaton over the lower-cased text; each keyword carries its kind and length."""
    a = ahocorasick.Automaton()
    for q in itertools.product("0123456789abcdef", repeat=4):
        a.add_word("".join(q), ("hex", 4))
    for w in ASSIGN_WORDS:
        a.add_word(w, ("assign", len(w)))
    a.add_word("akia", ("access", 4))
    for c in "pousr":
        a.add_word(f"gh{c}_", ("github", 4))
    a.add_word("npm_", ("npm", 4))
    a.add_word("xprv", ("xprv", 4))
    a.make_automaton()
    return a


def find(auto: ahocorasick.Automaton, text: str | None) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end) of one whole text."""
    if not text:
        return []
    # One character for one: this capital is the only one whose lower case is longer.
    low = text.replace("İ", "i").lower()
    starts: dict[str, list[int]] = {}
    hex_end, out = 0, []
    for end, (kind, n) in auto.iter(low):
        start = end - n + 1
        if kind != "hex":
            starts.setdefault(kind, []).append(start)
        elif start >= hex_end:
            hex_end = HEX_RUN.match(low, start).end()
            if hex_end - start >= HEX_LEAST:
                out += [("hex", m.start(), m.end()) for m in HEX.finditer(text, start, hex_end)]
    for kind, at in starts.items():
        rule = {"assign": ASSIGN, "access": ACCESS}.get(kind) or _checked[kind]
        done = 0
        for s in sorted(set(at)):
            if s < done or not (m := rule.match(text, s)):
                continue
            done = m.end()
            if kind == "assign":
                good = len(m[2]) >= ASSIGN_LEAST
            elif kind == "access":
                good = len(m[0]) >= ACCESS_LEAST
            else:
                good = _valid(kind, m)
            if good:
                out.append((kind, m.start(), m.end()))
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def redact(text: str, spans: list[tuple[str, int, int]], mask: str = MASK) -> str:
    """``text`` with the union of the spans replaced by ``mask``."""
    out, at = [], 0
    for _, s, e in sorted(spans, key=lambda x: (x[1], x[2])):
        if s >= at:
            out += [text[at:s], mask]
        at = max(at, e)
    return "".join([*out, text[at:]])


def _scanner():
    auto = prefilter()

    def run(texts):
        return {"spans": [[{"kind": k, "start": s, "end": e} for k, s, e in find(auto, t)]
                          for t in texts]}
    return run


def scan(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns of every document and its ``spans`` (kind, start, end)."""
    return map_texts(docs, _scanner, FIELDS, keep, text)


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from ``scan``."""
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    join = lambda spans: F.array_join(F.transform(
        spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in BASE_KINDS],
                        F.sha2(join(base).cast("binary"), 256).alias("base_sha256"),
                        join(F.col("spans")).alias("spans"))


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every span of its text masked; n_chars, where there is one, follows the
    text. Rows without a span pass unchanged."""
    df, back, name = apart(docs)
    t, n = F.col(name(text)), "n_chars" in docs.columns and name("n_chars")

    def make():
        auto = prefilter()

        def run(texts):
            return {"masked": [x if not (s := find(auto, x)) else redact(x, s) for x in texts]}
        return run
    out = map_texts(df, make, [T.StructField("masked", T.StringType())], df.columns, name(text))
    if n:
        kind = df.schema[n].dataType
        out = out.withColumn(n, F.when(F.col("masked").eqNullSafe(t), F.col(n))
                             .otherwise(F.length("masked").cast(kind)))
    return back(out.withColumn(name(text), F.col("masked")))
