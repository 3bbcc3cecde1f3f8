"""Documents as blocks of coded token ids, in ascending doc_id order, and back.

write() range-partitions documents by doc_id, tokenizes them with the tokenizers library and codes them
in blocks. Coding and decoding run in Spark's JVM (TokenCoder.java); coder has the same in numpy, for readers without Spark. A file is a Parquet file of rows (part, block, documents, tokens, payload), where each payload is a
block that can be read by itself; Spark's writer commits files whole, so a lost
executor leaves none in part. read() decodes and checks every block and places its documents in the whole: the sums before a
part are gathered by part, those before a block by a running sum within its part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DataType

from .common import pick, spare
from .compiled import function
from .tokens import encoder, runs

BLOCKS = "part int, block int, documents int, tokens long, payload binary"
#: Ids that go to the JVM in one piece.
PART = 1 << 16


def blocks(docs: DataFrame, tokenizer: str, *, end_id: int = 0, block_tokens: int = 1 << 20) -> DataFrame:
    """The blocks of the documents, each closed by the first document that fills it.

    Null text: the end id alone. Documents are in order of doc_id (null first), those that repeat a doc_id in
    order of text. No rows give no blocks. Other columns play no part. A text is never split, so a
    very long one makes a longer block.
    """

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        from .coder import table

        part, enc = TaskContext.get().partitionId(), encoder(tokenizer)
        vocabulary = max(enc.tok.get_vocab_size(), end_id + 1)
        schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("documents", pa.int32()), ("tokens", pa.int64()), ("table", pa.binary()), ("ids", pa.list_(pa.binary())), ("vocabulary", pa.int32())])
        held_docs, held_ids, held_sizes, held, number = [], [], [], 0, 0

        def settled(last: bool):
            """The blocks that the documents held fill, and, at last, the one that they begin."""
            nonlocal held, number
            docs, ids, sizes = held_docs.copy(), np.concatenate(held_ids), np.concatenate(held_sizes)
            ends, first, at = np.cumsum(sizes), 0, 0
            while first < len(docs):
                stop = int(np.searchsorted(ends, at + block_tokens)) + 1
                if stop > len(docs) and not last:
                    break
                stop = min(stop, len(docs))
                own, to = sizes[first:stop], int(ends[stop - 1])
                # from buffers: pyarrow doesn't give back what it makes of memoryviews
                cuts = np.append(np.arange(at, to, PART), to)
                parts = pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((4 * (cuts - at)).astype(np.int32)), pa.py_buffer(ids[at:to].tobytes())])
                row = [[part], [number], [stop - first], [to - at], [table(docs[first:stop], own)], pa.ListArray.from_arrays(pa.array([0, len(parts)], pa.int32()), parts), [vocabulary]]
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) if isinstance(x, list) else x for x, f in zip(row, schema)], schema=schema)
                first, at, number = stop, to, number + 1
            held_docs[:], held_ids[:], held_sizes[:] = docs[first:], [ids[at:]], [sizes[first:]]
            held = len(ids) - at

        for batch in batches:
            docs = batch.column(0).to_pylist()
            for i, j, texts in runs(batch.column(1)):
                ids, sizes = enc.encode(texts, end_id)
                held_docs += docs[i:j]
                held_ids.append(ids)
                held_sizes.append(sizes)
                held += len(ids)
                if held >= block_tokens:
                    yield from settled(False)
        if held_docs:
            yield from settled(True)
        spare(forget=False)  # the JVM needs it

    docs = pick(docs, doc_id="doc_id", text="text").selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    plain = docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(work, "part int, block int, documents int, tokens long, table binary, ids array<binary>, vocabulary int")
    coded = function(docs.sparkSession, "TokenCoder", "Write", BinaryType())
    return plain.select("part", "block", "documents", "tokens", coded(plain.table, plain.ids, plain.documents, plain.vocabulary).alias("payload"))


def write(docs: DataFrame, path: str, tokenizer: str, **options) -> None:
    blocks(docs, tokenizer, **options).write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and ids (little-endian unsigned
    32-bit integers) of every document. A block that fails its checksum fails the read."""
    rows = spark.read.schema(BLOCKS).parquet(path)
    parts = rows.groupBy("part").agg(F.sum("tokens").alias("n")).orderBy("part")
    before, total = [], 0
    for r in parts.toLocalIterator():  # one number for each part
        before.append((r["part"], total))
        total += r["n"]
    base = spark.createDataFrame(before, "part int, base long")
    place = rows.select("part", "block", "tokens").withColumn("within", F.sum("tokens").over(Window.partitionBy("part").orderBy("block")) - F.col("tokens"))
    start = place.join(base, "part").select("part", "block", (F.col("base") + F.col("within")).alias("start"))

    documents = function(spark, "TokenCoder", "Read", DataType.fromDDL("array<struct<doc_id: long, before: long, n_tokens: long, ids: binary>>"))
    found = rows.join(start, ["part", "block"])
    found = found.select("start", F.inline(documents(found.payload)))
    return found.select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", F.crc32("ids").alias("ids_crc32"), "ids")
