"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, **names: str) -> DataFrame:
    """The named columns and no others, by exact name and position, so that
    extra columns whose names differ only in case don't clash.

    names: new name = old name. Each old name must be there in exact case, or
    else in one other case.
    """
    at = []
    for old in names.values():
        hits = [i for i, c in enumerate(df.columns) if c == old] or [i for i, c in enumerate(df.columns) if c.lower() == old.lower()]
        if not hits:
            raise ValueError(f"no column {old} in {df.columns}")
        at.append(hits[0])
    plain = df.toDF(*[f"__c{i}" for i in range(len(df.columns))])
    return plain.select(*[plain[f"__c{i}"].alias(new) for i, new in zip(at, names)])


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir where it
    is set; else, in local runs only, a folder of this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        import tempfile

        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="textloom-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again: later work neither
    repeats nor loses it when executors go."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/textloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*dfs: DataFrame) -> None:
    """Removes what stored() wrote for these, which nothing may read any more."""
    for df in dfs:
        if path := getattr(df, "_stored_at", None):
            jvm = df.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
            df._stored_at = None


def sliced(batches, at: int, least: int = 4_000_000):
    """Arrow batches in parts of at least so many bytes in the column `at`, so that what is made of a part stays small."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        i = 0
        while i < len(ends):
            j = min(len(ends), int(np.searchsorted(ends, (ends[i - 1] if i else 0) + least)) + 1)
            yield batch.slice(i, j - i)
            i = j


def spare(forget: bool = True) -> None:
    """In a worker: gives back what earlier stages' caches and allocators hold, for a stage that doesn't use them; without
    `forget`, the tokenizers' caches stay."""
    import ctypes
    import gc
    import sys

    import pyarrow as pa

    if forget and (tokens := sys.modules.get("textloom.llm.tokens")):
        tokens.forget()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))
