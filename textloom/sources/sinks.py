"""Writers: indexes as Parquet with a manifest, CoNLL, slim JSON, metrics."""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import search

VERSION = 2


def index_name(path: str) -> str:
    stem = re.sub(r"\.[^.]*$", "", path.rsplit("/", 1)[-1])
    return f"index_{re.sub('[^a-zA-Z0-9_-]+', '_', stem)}_{hashlib.sha1(path.encode()).hexdigest()[:10]}"


def manifest(source: DataFrame, **options) -> str:
    """What an index was built from: a digest of its files with size and time, the version and the options. min_words counts
    among these, so that another value builds anew."""
    one = F.xxhash64("path", "length", F.col("modificationTime").cast("string"))
    row = source.agg(F.count("*").alias("n"), F.sum("length").alias("bytes"), F.bit_xor(one).alias("digest"), F.bit_xor(F.xxhash64(one)).alias("second")).first()
    return json.dumps({"version": VERSION, "options": options, "files": row["n"], "bytes": row["bytes"], "digest": [row["digest"], row["second"]]}, sort_keys=True)


def save_index(passages: DataFrame, path: str, made_of: str, buckets: int = search.BUCKETS) -> None:
    """Passages with their tokens, postings in folders by hash of the term, and document frequencies; the manifest is last."""
    spark = passages.sparkSession
    search.embedded(search.annotate(passages)).write.mode("overwrite").parquet(f"{path}/passages")
    kept = spark.read.parquet(f"{path}/passages")
    rows = search.postings(kept).withColumn("bucket", search.bucket(F.col("term"), buckets))
    rows.repartition("bucket").sortWithinPartitions("term", "id").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    search.document_frequency(kept).write.mode("overwrite").parquet(f"{path}/df")
    spark.createDataFrame([(made_of,)], "manifest string").coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def is_current(spark: SparkSession, path: str, made_of: str, *, embedded: bool = False) -> bool:
    """Whether the index there is of that manifest and, if asked, every passage has an embedding."""
    try:
        rows = spark.read.schema("manifest string").json(f"{path}/manifest").collect()  # one row
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
    if [r[0] for r in rows] != [made_of]:
        return False
    if not embedded:
        return True
    kept = spark.read.parquet(f"{path}/passages")
    return "embedding" in kept.columns and kept.where(F.col("embedding").isNull() | (F.size("embedding") == 0)).isEmpty()


#: What an index's tables have at least.
TABLES = {"passages": {"id", "ord", "chapter", "text", "norm", "tokens"}, "postings": {"term", "id", "pos", "bucket"}, "df": {"term", "df"}}


def load_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Passages, postings and document frequencies; tables that lack columns are no index."""
    out = []
    for name, columns in TABLES.items():
        df = spark.read.parquet(f"{path}/{name}")
        if lacks := columns - set(df.columns):
            raise ValueError(f"{path}/{name} is no part of an index: it lacks {', '.join(sorted(lacks))}")
        out.append(df)
    return tuple(out)


def conll_lines(sentences: DataFrame) -> DataFrame:
    """(frase_id, tokens, labels) -> (frase_id, value): a line for each token that isn't blank; sentences without one go.
    Tokens and labels of unequal number are an error."""
    pairs = F.when(F.size("tokens") != F.size("labels"), F.raise_error(F.lit("tokens and labels differ in number"))).otherwise(F.arrays_zip("tokens", "labels"))
    real = F.filter(pairs, lambda p: F.trim(F.regexp_replace(p["tokens"], r"\s+", "")) != "")
    line = F.transform(real, lambda p: F.concat_ws(" ", F.replace(p["tokens"], F.lit("\n"), F.lit("\\n")), T.bio(p["labels"])))
    return sentences.select("frase_id", line.alias("lines")).where(F.size("lines") > 0).select("frase_id", F.array_join("lines", "\n").alias("value"))


def write_conll(sentences: DataFrame, path: str, *, one_file: bool = False) -> None:
    """Sentences in order, a blank line between two. In one file, which one task writes, a single line feed ends the last."""
    rows = conll_lines(sentences)
    if not one_file:
        rows.orderBy("frase_id").select("value").write.mode("overwrite").option("lineSep", "\n\n").text(path)
        return
    last = F.lead("frase_id").over(Window.orderBy("frase_id")).isNull()
    rows.select("frase_id", F.when(last, F.col("value")).otherwise(F.concat("value", F.lit("\n"))).alias("value")).repartition(1).sortWithinPartitions("frase_id").select("value").write.mode("overwrite").text(path)


def write_slim(sentences: DataFrame, path: str) -> None:
    sentences.select("frase_id", "text", "tokens", "labels").write.mode("overwrite").json(path)


def write_templates(templates: DataFrame, sentences: DataFrame, files: DataFrame, path: str, *, unit: str = "palabra") -> None:
    """A folder of annotators' files, a JSON array each under file=N, and the sentences with who has which, as one object."""
    templates.select("file", F.to_json("records").alias("value")).repartition("file").write.mode("overwrite").partitionBy("file").text(f"{path}/files")
    texts = sentences.agg(F.transform(F.array_sort(F.collect_list(F.struct("sentence", "text"))), lambda s: s["text"]).alias("frases"))  # those drawn for annotators
    own = files.groupBy("file").agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "sentence"))), lambda s: s["sentence"]).alias("own"))
    lists = own.agg(F.transform(F.array_sort(F.collect_list(F.struct("file", "own"))), lambda s: s["own"]).alias("asignaciones"))
    texts.crossJoin(lists).select(F.lit(unit).alias("granularidad"), "frases", "asignaciones").coalesce(1).write.mode("overwrite").json(f"{path}/assignments")


def write_metrics(metrics: DataFrame, path: str) -> None:
    """A row, or a few, as one indented JSON text."""
    rows = [r.asDict(recursive=True) for r in metrics.collect()]
    text = json.dumps(rows[0] if len(rows) == 1 else rows, indent=2, ensure_ascii=False, default=str)
    metrics.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """A text made on the driver, such as a report's page, to any store."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_bytes(spark: SparkSession, data: bytes, path: str) -> None:
    """Bytes made on the driver, such as a trained model, as one file in any store."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).create(at, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
