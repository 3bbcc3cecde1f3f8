"""Queries of the tokenizer, the language model's data and the codec, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bpe, codec, lm
from .base import Book, table

book = Book()


@book("""WITH c AS (SELECT doc_id, unnest(string_split(text, '')) AS a, unnest(range(length(text))) AS pos FROM documents),
p AS (SELECT a, lead(a) OVER (PARTITION BY doc_id ORDER BY pos) AS b FROM c)
SELECT a, b, CAST(count(*) AS BIGINT) AS n FROM p WHERE b IS NOT NULL GROUP BY a, b""")
def bpe_pair_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("tokens"))
    return bpe.pair_counts(rows).select("a", "b", "n")


def _trained(spark, sf_dir) -> bpe.Bpe:
    """Of all documents, with the vocabulary size of the reference."""
    return bpe.train(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), 300)


@book()
def bpe_train_k_merges(spark, sf_dir):
    tok = _trained(spark, sf_dir)
    return spark.createDataFrame(list(enumerate(tok.vocabulary)), "id int, token string")


@book()
def bpe_encode_stats(spark, sf_dir):
    tok = _trained(spark, sf_dir)
    rows = bpe.encoded(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), tok)
    n = F.length("tokens")
    return rows.select(F.col("id").alias("doc_id"), F.length("text").alias("n_chars"), n.alias("n_tokens"), F.try_divide(F.length("text"), n).alias("ratio"), (F.col("back") == F.col("text")).alias("round_trip"))


@book("""WITH d AS (SELECT doc_id, length(text) AS n FROM documents)
SELECT doc_id, CAST(greatest(n - 64, 0) AS BIGINT) AS examples, CAST(floor(n * 0.9) AS BIGINT) AS training FROM d""")
def lm_windows(spark, sf_dir):
    """Windows of 64 characters and the training part of each document."""
    ids = F.filter(F.split("text", ""), lambda c: c != "")
    rows = table(spark, sf_dir, "documents").select("doc_id", ids.alias("ids"))
    examples = lm.windows(rows, 64).groupBy("doc_id").agg(F.count("*").alias("examples"))
    training = rows.select("doc_id", F.floor(F.size("ids") * 0.9).cast("long").alias("training"))
    return training.join(examples, "doc_id", "left").select("doc_id", F.coalesce("examples", F.lit(0)).alias("examples"), "training")


@book("""WITH b AS (SELECT doc_id, string_split(text, '') AS c FROM documents), s AS (SELECT doc_id, c, unnest(range(1, len(c) - 63, 64)) AS i FROM b)
SELECT doc_id, i AS start, array_to_string(c[i:i + 63], '') AS x, array_to_string(c[i + 1:i + 64], '') AS y FROM s WHERE i <= len(c) - 64""")
def lm_batches(spark, sf_dir):
    """Of every document's windows of 64 characters, each 64th: those that a batch without overlaps takes."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.filter(F.split("text", ""), lambda c: c != "").alias("ids"))
    return lm.windows(rows, 64).where("start % 64 = 1").select("doc_id", F.col("start").cast("long").alias("start"), F.array_join("x", "").alias("x"), F.array_join("y", "").alias("y"))


@book("""WITH b AS (SELECT item_id, string_split(text, '') AS c FROM benchmark), s AS (SELECT item_id, c, unnest(range(1, len(c) - 7)) AS i FROM b)
SELECT item_id, i AS start, array_to_string(c[i:i + 7], '') AS x, array_to_string(c[i + 1:i + 8], '') AS y FROM s""")
def lm_examples(spark, sf_dir):
    """Every window of 8 characters of the benchmark's passages with the one that follows."""
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.filter(F.split("text", ""), lambda c: c != "").alias("ids"))
    return lm.windows(rows, 8).select("item_id", F.col("start").cast("long").alias("start"), F.array_join("x", "").alias("x"), F.array_join("y", "").alias("y"))


@book("""WITH l AS (SELECT vec_id, unnest(range(64)) AS token, unnest(CAST(embedding AS DOUBLE[])) / 0.8 AS z FROM embeddings),
r AS (SELECT *, rank() OVER (PARTITION BY vec_id ORDER BY z DESC) AS k, max(z) OVER (PARTITION BY vec_id) AS m FROM l)
SELECT vec_id, token, round(exp(z - m) / sum(exp(z - m)) OVER (PARTITION BY vec_id), 6) AS chance FROM r WHERE k <= 10""")
def topk_softmax(spark, sf_dir):
    logits = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.posexplode("embedding").alias("token", "logit")).withColumn("logit", F.col("logit").cast("double"))
    out = lm.top_k_chances(logits, 10, 0.8)
    return out.select(F.col("id").alias("vec_id"), F.col("token").cast("long").alias("token"), F.round("chance", 6).alias("chance"))


_BYTES = "b AS (SELECT doc_id, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: CAST('0x' || h AS INTEGER)) AS v FROM documents)"


def _share(variant: str) -> str:
    known = ", ".join(map(str, codec.Codec.of(variant).valid))
    return f"round(CASE WHEN len(v) > 0 THEN len(list_filter(v, lambda x: x IN ({known}))) / len(v) ELSE 0 END, 6)"


@book(f"WITH {_BYTES} SELECT doc_id, {_share('lenient')} AS lenient, {_share('strict')} AS strict FROM b")
def codec_detect(spark, sf_dir):
    data = F.encode("text", "UTF-8")
    return table(spark, sf_dir, "documents").select("doc_id", F.round(codec.detect(data, "lenient"), 6).alias("lenient"), F.round(codec.detect(data, "strict"), 6).alias("strict"))


@book(f"WITH {_BYTES} SELECT x AS byte, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(v) AS x FROM b) GROUP BY x")
def byte_histogram(spark, sf_dir):
    return codec.histogram(table(spark, sf_dir, "documents").select(F.encode("text", "UTF-8").alias("data")))


@book()
def codec_roundtrip(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    sides = [codec.convert(docs, v).select("id", F.octet_length("coded").alias(f"{v}_bytes"), F.sha2("back", 256).alias(f"{v}_sha256")) for v in ("lenient", "strict")]
    return sides[0].join(sides[1], "id")


@book("""SELECT CAST(t AS DOUBLE) AS temperature, k AS top_k FROM (VALUES (0.5), (0.8), (1.2)) AS a(t), (VALUES (10), (20), (50)) AS b(k)""")
def param_grid(spark, sf_dir):
    own = lambda name, values: spark.createDataFrame([(v,) for v in values], f"{name} {'double' if name == 'temperature' else 'int'}")
    return lm.experiments(own("temperature", (0.5, 0.8, 1.2)), own("top_k", (10, 20, 50)))
