"""Small shared helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.functions.numeric import round_to

# Range of the seeded order keys: fifteen hexadecimal digits of an MD5, which any SQL engine
# computes identically (so seeded orders can be checked against an oracle).
HASH_M = 1 << 60


def key_hash(key: Column, seed: int) -> Column:
    """Seeded pseudo-random order key in [0, 2^60) from a bigint key."""
    text = F.concat(key.cast("bigint").cast("string"), F.lit(f":{seed}")).cast("binary")
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def key_hash_sql(key: str, seed: int) -> str:
    text = f"CAST(CAST({key} AS BIGINT) AS VARCHAR) || ':{seed}'"
    return f"(CAST('0x' || substr(md5({text}), 1, 15) AS BIGINT))"


def normalize_types(df: DataFrame) -> DataFrame:
    """Result hygiene: every integral column as bigint, every decimal/float as double,
    so results compare by value across engines."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            out.append(F.col(f.name).cast("bigint").alias(f.name))
        elif isinstance(f.dataType, (T.DecimalType, T.FloatType)):
            out.append(F.col(f.name).cast("double").alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def round_doubles(df: DataFrame, digits: int = 6, skip=()) -> DataFrame:
    """Round every double column (except ``skip``) -- for value comparison across
    engines whose float summation orders differ."""
    return df.select(*[
        round_to(F.col(f.name), digits).alias(f.name)
        if isinstance(f.dataType, T.DoubleType) and f.name not in skip else F.col(f.name)
        for f in df.schema.fields])


def parallel_map(fn, items, parallelism: int = 4):
    """Run independent Spark jobs (model fits, evaluations) ``parallelism`` at a time from
    driver threads -- the scheduler interleaves their tasks, as CrossValidator does."""
    from concurrent.futures import ThreadPoolExecutor
    items = list(items)
    if parallelism <= 1 or len(items) <= 1:
        return [fn(x) for x in items]
    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        return list(pool.map(fn, items))
