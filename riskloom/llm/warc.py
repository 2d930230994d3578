"""WARC archives of pages: writing with revisit records, reading with boundary-chain
verification.

Writing: one record per page. Pages with equal payloads (of ``min_bytes`` or more) share one
``response``, that of the largest page_id; the others become ``revisit`` records that refer to
it. Spark's text sink writes the records, whose end mark is the line separator, so files are
committed per task and a lost executor leaves no half archive.

Reading: the magic line cuts an archive into pieces, and every piece is a candidate record.
Tasks emit each candidate's offset and that of its successor (from its own Content-Length),
and contract the chain inside runs of ``SEGMENT`` candidates. Pointer jumping from the start of
every file over these exits then finds the reachable candidates; the rest is magic inside
payloads and goes back to the record that covers it. Offsets are sums of piece lengths: inside
a task along the split, across splits of one file by a sum over splits.

Defined results: null html is an empty payload; line breaks inside a url are percent-encoded;
pages sharing the largest page_id of a group are all responses, as are all pages of a group
without any page_id; an empty table gives an empty archive and no records; a chain that
breaks (truncated or damaged file) ends at the break, and ``broken_archives`` names the file;
other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.llm.common import cut, handed_on, scratch_path, tune

#: Fixed values of the format.
MAGIC = b"WARC/1.1\r\n"
END = b"\r\n\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID = "urn:x-page:"

DATE = "1970-01-01T00:00:00Z"
SEGMENT = 4096
MAX_RECORDS_PER_FILE = 50_000


def base32_sha1(payload) -> F.Column:
    """Upper-case base32 SHA-1 of a binary column: eight groups of 20 bits, four digits each."""
    out = []
    for g in range(8):
        n = F.conv(F.substring(F.sha1(payload), 5 * g + 1, 5), 16, 10).cast("int")
        out += [F.substring(F.lit(BASE32), F.shiftright(n, s).bitwiseAND(31) + 1, F.lit(1))
                for s in (15, 10, 5, 0)]
    return F.concat(*out)


def with_verdict(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, record_type and refers_to. Only
    groups of two or more have a row on the other side of the join; a hot group is a hot key
    of the left side, which adaptive execution splits."""
    p = pages.select("page_id", F.col("url").cast("string").alias("url"),
                     F.coalesce(F.col("html"), F.lit("")).alias("payload"))
    p = p.withColumns({"payload_bytes": F.octet_length("payload").cast("long"),
                       "payload_digest": base32_sha1(F.col("payload").cast("binary"))})
    groups = (p.where(F.col("payload_bytes") >= min_bytes)
              .groupBy("payload_digest", "payload_bytes")
              .agg(F.max("page_id").alias("top"), F.count(F.lit(1)).alias("n"))
              .where("n > 1").drop("n"))
    again = F.col("top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top"))
    return (p.join(groups, ["payload_digest", "payload_bytes"], "left")
            .withColumns({"record_type": F.when(again, "revisit").otherwise("response"),
                          "refers_to": F.when(again, F.col("top"))})
            .drop("top"))


def record_text() -> F.Column:
    """One whole record without its end mark, from the columns of ``with_verdict``."""
    revisit = F.col("record_type") == "revisit"
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
                          "Content-Length: "), F.col("payload_bytes").cast("string"),
                    F.lit("\r\n\r\n"))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    page = F.coalesce(F.col("page_id").cast("string"), F.lit("null"))
    url = F.regexp_replace(F.regexp_replace(F.col("url"), "\r", "%0D"), "\n", "%0A")
    line = lambda name, *value: F.concat(F.lit(f"{name}: "), *value, F.lit("\r\n"))
    some = lambda when, text: F.when(when, text).otherwise("")
    return F.concat(
        F.lit(MAGIC.decode()), line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", F.lit(f"<{ID}"), page, F.lit(">")),
        line("WARC-Date", F.lit(DATE)),
        some(F.col("url").isNotNull(), line("WARC-Target-URI", url)),
        line("WARC-Payload-Digest", F.lit("sha1:"), F.col("payload_digest")),
        some(revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)),
                               line("WARC-Refers-To", F.lit(f"<{ID}"),
                                    F.col("refers_to").cast("string"), F.lit(">")))),
        line("Content-Type", F.lit("application/http;msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")), F.lit("\r\n"), block)


def write_warc(pages: DataFrame, path: str, min_bytes: int = 0,
               compression: str = "gzip") -> None:
    """Archives of all pages as files under ``path``."""
    (with_verdict(pages, min_bytes).select(record_text().alias("value"))
     .write.option("lineSep", END.decode()).option("compression", compression)
     .option("maxRecordsPerFile", MAX_RECORDS_PER_FILE).text(path))


def parse(raw: bytes) -> tuple[dict, int, int] | None:
    """(header fields, header length, block length) of a record after its magic line; None if
    it cannot be one."""
    end = raw.find(END)
    if end < 0:
        return None
    fields = {}
    for row in raw[:end].split(b"\r\n"):
        name, colon, value = row.partition(b":")
        if not colon:
            return None
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    length = fields.get("content-length", "")
    if not (length.isascii() and length.isdigit()):
        return None
    return fields, end + len(END), int(length)


def page_of(uri: str | None) -> int | None:
    number = (uri or "").strip("<>").removeprefix(ID)
    return int(number) if number.lstrip("-").isdigit() else None


def content(raw: bytes) -> dict:
    """Columns of a whole record from its bytes after the magic line."""
    fields, start, length = parse(raw)
    http, _, payload = raw[start:start + length].partition(END)
    kind = fields.get("warc-type")
    out = {"page_id": page_of(fields.get("warc-record-id")), "url": fields.get("warc-target-uri"),
           "record_type": kind, "refers_to": page_of(fields.get("warc-refers-to")),
           "stated_digest": fields.get("warc-payload-digest", "").removeprefix("sha1:")}
    if kind == "revisit":
        size = [v for k, _, v in (r.partition(b":") for r in http.split(b"\r\n"))
                if k.strip().lower() == b"content-length"]
        return out | {"payload": None, "payload_bytes": int(size[0]) if size else None,
                      "payload_digest": out["stated_digest"]}
    return out | {"payload": payload, "payload_bytes": len(payload),
                  "payload_digest": base64.b32encode(hashlib.sha1(payload).digest()).decode()}


RECORD = [T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()),
          T.StructField("record_type", T.StringType()), T.StructField("refers_to", T.LongType()),
          T.StructField("stated_digest", T.StringType()),
          T.StructField("payload", T.BinaryType()),
          T.StructField("payload_bytes", T.LongType()),
          T.StructField("payload_digest", T.StringType())]
PIECE = [T.StructField("file", T.StringType()), T.StructField("split", T.LongType()),
         T.StructField("segment", T.LongType()), T.StructField("q", T.LongType()),
         T.StructField("size", T.LongType()), T.StructField("succ", T.LongType()),
         T.StructField("exit", T.LongType()), T.StructField("raw", T.BinaryType()),
         T.StructField("record", T.StructType(RECORD))]


def exits(q: list[int], succ: list[int | None]) -> list[int | None]:
    """Where the chain from each candidate leaves this run of candidates; None if it dies."""
    at = {x: i for i, x in enumerate(q)}
    out = list(succ)
    for i in range(len(q) - 1, -1, -1):
        j = at.get(succ[i])
        if j is not None and j > i:
            out[i] = out[j]
    return out


def pieces(spark: SparkSession, path: str, payload: bool) -> DataFrame:
    """One row per piece of every archive under ``path``, offsets counted from the first piece
    of its split (column ``split``: where the split begins). ``record`` holds the parsed
    columns of pieces that are whole records by their own lengths. ``raw`` is kept where a
    record may need it: at a record that goes on in later pieces, at the pieces it covers,
    and throughout splits that do not begin a file; with ``payload``, nowhere is the payload
    left out."""
    tune(spark)
    schema = T.StructType(PIECE)
    lines = (spark.read.option("lineSep", MAGIC.decode()).text(path)
             .select(F.col("_metadata.file_path").alias("file"),
                     F.col("_metadata.file_block_start").alias("split"),
                     F.col("value").cast("binary").alias("raw")))

    def run(batches):
        here, at, covered, segment, rows = None, 0, 0, 0, []

        def flush():
            nonlocal rows
            q, succ = [r["q"] for r in rows], [r["succ"] for r in rows]
            out = [r | {"exit": e} for r, e in zip(rows, exits(q, succ))]
            rows = []
            return pa.RecordBatch.from_pylist(out, schema=arrow)

        from pyspark.sql.pandas.types import to_arrow_schema
        arrow = to_arrow_schema(schema)
        held = 0
        for b in batches:
            for file, split, raw in zip(*(c.to_pylist() for c in b.columns)):
                if (file, split) != here:
                    if rows:
                        yield flush()
                    here, at, covered, segment, held = (file, split), 0, 0, 0, 0
                q, end = at - len(MAGIC), at + len(raw)
                known = parse(raw)
                succ = at + known[1] + known[2] + len(END) if known else None
                whole = succ == end
                if known and not whole:
                    covered = max(covered, succ)
                row = {"file": file, "split": split, "segment": segment, "q": q,
                       "size": len(raw), "succ": succ, "raw": None, "record": None}
                if whole:
                    row["record"] = content(raw)
                    if not payload:
                        row["record"]["payload"] = None
                if not whole or q < covered or split:
                    row["raw"] = raw
                rows.append(row)
                held += len(raw)
                at = end + len(MAGIC)
                if len(rows) >= SEGMENT or payload and held > 32_000_000:
                    yield flush()
                    segment, held = segment + 1, 0
        if rows:
            yield flush()
    return lines.mapInArrow(run, schema)


def placed(found: DataFrame) -> DataFrame:
    """``pieces`` with offsets counted from the start of each file."""
    splits = found.groupBy("file", "split").agg(
        F.sum(F.col("size") + len(MAGIC)).alias("length"))
    w = Window.partitionBy("file").orderBy("split")
    base = splits.select("file", "split", (F.sum("length").over(w) - F.col("length"))
                         .alias("base"))
    shift = {c: F.col(c) + F.col("base") for c in ("q", "succ", "exit")}
    return found.join(base, ["file", "split"]).withColumns(shift).drop("base")


def reachable(candidates: DataFrame) -> DataFrame:
    """(file, q) of the candidates on the chain from the start of each file.

    ``exit`` skips a whole segment, so the jumps only visit one candidate per segment; the
    segments they enter are then walked. Each round follows the pointers of every reached
    candidate and doubles the pointers' reach, so the rounds grow with the logarithm of the
    segments in the longest file."""
    jump = candidates.select("file", "q", F.col("exit").alias("to")).where("to is not null")
    reached = cut(candidates.where("q = 0").select("file", "q"))
    n = reached.count()
    while True:
        ahead = reached.join(jump, ["file", "q"]).select("file", F.col("to").alias("q"))
        more = cut(reached.unionByName(ahead).distinct())
        m = more.count()
        if m == n:
            break
        reached, n = more, m
        far = jump.select("file", F.col("q").alias("to"), F.col("to").alias("far"))
        jump = cut(jump.join(far, ["file", "to"], "left")
                   .select("file", "q", F.coalesce("far", "to").alias("to")))
    entry = (reached.join(candidates.select("file", "q", "split", "segment"), ["file", "q"])
             .groupBy("file", "split", "segment").agg(F.min("q").alias("entry")))
    schema = "file string, q long"

    def walk(pdf):
        succ = dict(zip(pdf["q"].tolist(), pdf["succ"].tolist()))
        at, out = int(pdf["entry"].iloc[0]), []
        while at in succ:
            out.append(at)
            at = succ[at]
            if at is None or at != at or at <= out[-1]:
                break
            at = int(at)
        return pdf.head(len(out))[["file"]].assign(q=out)
    return (candidates.join(entry, ["file", "split", "segment"])
            .select("file", "split", "segment", "q", "succ", "entry")
            .groupBy("file", "split", "segment").applyInPandas(walk, schema))


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """All records of the archives under ``path``: file, q (offset in the uncompressed file)
    and the columns of RECORD; with ``payload`` False the payload column stays null, though
    payload_bytes and payload_digest still come from the whole payload. In a cut archive the
    last record is read if its block is whole (its end mark may be missing); a record whose
    header or block is cut is left out."""
    found = handed_on(pieces(spark, path, payload), "warc-pieces")
    every = placed(found)
    # The piece before the first magic of a file holds nothing.
    candidates = cut(every.where("q >= 0").select("file", "split", "segment", "q", "succ", "exit"))
    chain = cut(reachable(candidates))
    on_chain = every.join(chain, ["file", "q"])
    single = on_chain.where("record is not null").select("file", "q", "record.*")
    # Records that go on in later pieces: all pieces up to the next record, put together.
    # A header that is cut names no end; such a piece is no record.
    long = (on_chain.where("record is null AND succ is not null")
            .select("file", F.col("q").alias("owner"), "succ"))
    parts = (every.where("raw is not null and q >= 0").select("file", "q", "raw")
             .join(_owners(candidates, chain, long), ["file", "q"])
             .join(long, ["file", "owner"])
             .groupBy("file", "owner", "succ")
             .agg(F.array_sort(F.collect_list(F.struct("q", "raw"))).alias("parts")))
    schema = T.StructType([T.StructField("file", T.StringType()),
                           T.StructField("q", T.LongType()), *RECORD])
    names = [f.name for f in schema]

    def assemble(batches):
        from pyspark.sql.pandas.types import to_arrow_schema
        arrow = to_arrow_schema(schema)
        for b in batches:
            for r in b.to_pylist():
                raw = MAGIC.join(p["raw"] for p in r["parts"])
                if r["owner"] + len(MAGIC) + len(raw) < r["succ"] - len(END):
                    continue  # truncated
                row = {"file": r["file"], "q": r["owner"]} | content(raw)
                if not payload:
                    row["payload"] = None
                yield pa.RecordBatch.from_pylist([row], schema=arrow)
    return single.unionByName(parts.mapInArrow(assemble, schema).select(*names))


def _owners(candidates: DataFrame, chain: DataFrame, long: DataFrame) -> DataFrame:
    """(file, q, owner): the record on the chain that each piece belongs to. Runs over offsets
    only, and only for files that have candidates off the chain or records in ``long``."""
    mark = chain.withColumn("on", F.lit(True))
    marked = candidates.select("file", "q").join(mark, ["file", "q"], "left")
    odd = marked.where("on is null").select("file").union(long.select("file")).distinct()
    w = Window.partitionBy("file").orderBy("q").rowsBetween(Window.unboundedPreceding, 0)
    return (marked.join(odd, "file", "left_semi")
            .withColumn("owner", F.last(F.when(F.col("on"), F.col("q")), ignorenulls=True).over(w))
            .where("owner is not null").select("file", "q", "owner"))


def broken_archives(spark: SparkSession, path: str) -> DataFrame:
    """(file, reached, length) of archives whose chain does not end at the end of the file."""
    every = placed(handed_on(pieces(spark, path, False), "warc-pieces"))
    candidates = cut(every.where("q >= 0").select("file", "split", "segment", "q", "succ", "exit"))
    ends = (candidates.join(reachable(candidates), ["file", "q"])
            .groupBy("file").agg(F.max("succ").alias("reached")))
    length = every.groupBy("file").agg(
        F.max(F.col("q") + len(MAGIC) + F.col("size")).alias("length"))
    return (length.join(ends, "file", "left").select("file", "reached", "length")
            .where("reached is null or reached <> length"))


def round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write all pages as archives, read them back, and return the contract's columns."""
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    write_warc(pages, path)
    return read_warc(spark, path, payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h FROM pages),
d AS (
  SELECT page_id, payload, strlen(payload) AS payload_bytes,
         array_to_string(list_transform(range(40), lambda i: substr(
           '0000000100100011010001010110011110001001101010111100110111101111',
           4 * (strpos('0123456789abcdef', substr(h, i + 1, 1)) - 1) + 1, 4)), '') AS bits
  FROM p),
b AS (
  SELECT page_id, payload, payload_bytes,
         array_to_string(list_transform(range(32), lambda i: substr(
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           CAST(list_sum(list_transform(range(5), lambda k: CAST(substr(bits, 5 * i + k + 1, 1) AS INTEGER)
             * CAST(pow(2, 4 - k) AS INTEGER))) AS BIGINT) + 1, 1)), '') AS payload_digest,
         max(page_id) OVER (PARTITION BY payload) AS top
  FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN top IS NOT NULL AND page_id IS DISTINCT FROM top THEN 'revisit'
            ELSE 'response' END AS record_type,
       CASE WHEN top IS NOT NULL AND page_id IS DISTINCT FROM top THEN top END AS refers_to
FROM b
"""
