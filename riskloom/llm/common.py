"""Shared helpers of the corpus operators: table access, per-batch text mapping, bounded
label samples and cut lineage."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from riskloom.session import ensure_checkpoint_dir

#: Rows of one Arrow batch and characters handled at once inside a task. Long texts make
#: small slices, so a task's memory follows the longest text and not the batch.
BATCH_ROWS = 2000
SLICE_CHARS = 4_000_000
#: Resolution of the hash cut of ``bounded_sample``.
HASH_CUT = 1 << 40


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tune(spark: SparkSession) -> None:
    """Keep Arrow batches small unless the session already chose a size."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder of the session."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from the files, so that a
    lost executor costs only the reading."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def handed_on(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it back: like
    ``cut``, but compressed and readable column by column."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def apart(df: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame], Callable[[str], str]]:
    """``df`` under positional column names, so that no input column can clash with a computed
    one; a function that gives the original columns back; and the new name of a column."""
    names = {c: f"__c{i}" for i, c in enumerate(df.columns)}
    out = df.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    return (out, lambda x: x.select(*[F.col(n).alias(c) for c, n in names.items()]),
            lambda c: names[c])


def slices(texts: list, limit: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Index ranges of ``texts`` of at most ``limit`` characters, one text at least."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > start and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def map_texts(df: DataFrame, make: Callable[[], Callable[[list], dict]],
              fields: list[T.StructField], keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns of ``df`` followed by ``fields`` computed from the whole texts.

    ``make()`` runs once per task and returns a function from a list of texts (None for
    null) to a dict of equally long lists or Arrow arrays, one per field."""
    tune(df.sparkSession)
    kept = [df.schema[c] for c in keep]
    schema = T.StructType([*kept, *fields])
    types = [to_arrow_type(f.dataType) for f in fields]
    names = [f.name for f in fields]
    cols = list(keep) if text in keep else [*keep, text]

    def run(batches):
        fn = make()
        for b in batches:
            texts = b.column(cols.index(text)).to_pylist()
            for lo, hi in slices(texts):
                part = b.slice(lo, hi - lo)
                out = fn(texts[lo:hi])
                arrays = [part.column(cols.index(c)) for c in keep]
                arrays += [out[n] if isinstance(out[n], (pa.Array, pa.ChunkedArray))
                           else pa.array(out[n], type=t) for n, t in zip(names, types)]
                yield pa.RecordBatch.from_arrays(arrays, names=[*keep, *names])

    return df.select(*[F.col(f"`{c}`") for c in cols]).mapInArrow(run, schema)


def binary_labels(labels: DataFrame, column: str) -> DataFrame:
    """(doc_id, y) with one row per labelled document: rows without id or label are left
    out, and a document labelled more than once takes the majority (a tie counts as 1)."""
    return (labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull())
            .groupBy("doc_id")
            .agg((F.avg(F.col(column).cast("double")) >= 0.5).cast("int").alias("y")))


def learnable(doc_id, modulus: int, held_out: int):
    """Column: true where crc32(doc_id as text) mod ``modulus`` is not ``held_out``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus != held_out


def bounded_sample(df: DataFrame, keys: list[str], bound: int, seed: int) -> DataFrame:
    """About ``bound`` rows of ``df`` at most, chosen by a hash of ``keys``: the row count
    sets the hash cut, so no task ever gathers more than its share of the sample. All rows
    when there are no more than ``bound``."""
    n = df.count()
    if n <= bound:
        return df
    h = F.pmod(F.xxhash64(*[F.col(k) for k in keys], F.lit(seed)), F.lit(HASH_CUT))
    return df.where(h < int(HASH_CUT * bound / n))
