"""The queries of this subpackage and what SQL can say of them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, table, tokenizer_path


def op6_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import token_file

    path = f"{shared_dir(spark)}/textloom-tokens-{uuid.uuid4().hex}"
    token_file.write(table(spark, sf_dir, "documents"), path, tokenizer_path())
    return token_file.read(spark, path).drop("ids")


def op7_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract

    return extract(table(spark, sf_dir, "pages"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op1_bit_sliced_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bit_sliced import top_k

    return top_k(table(spark, sf_dir, "embeddings"))


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s
)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM r WHERE k <= 10
"""


def op2_rule_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import fit, score

    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))


def op4_language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .languages import fit, label

    docs = table(spark, sf_dir, "documents")
    return label(docs, fit(docs))


def op3_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .permutations import nearest

    return nearest(table(spark, sf_dir, "embeddings"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import dedup_lines

    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH lines AS (
  SELECT doc_id, i, l, translate(trim(l, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS l,
               unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents)
), repeated AS (
  SELECT k, max(doc_id) AS keeper FROM lines WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT doc_id, i, l, keeper IS NOT NULL AND keeper <> doc_id AS gone FROM lines LEFT JOIN repeated USING (k)
)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def op9_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sentence_pieces import encode

    return encode(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), with_ids=False)


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_bit_sliced_top_k, op2_rule_quality, op3_permutation_index, op4_language_spans, op5_line_dedup, op6_token_file, op7_html_blocks, op8_packing, op9_sentence_pieces, op10_near_duplicates)}
ORACLE_SQL = {"op1_bit_sliced_top_k": OP1_SQL, "op5_line_dedup": OP5_SQL}
