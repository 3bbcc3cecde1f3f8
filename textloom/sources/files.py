"""Readers of what the engine takes in. Files are read by Spark, so any store that it knows will do."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What makes an archive's entry the main one, beside its size (fixed values).
ENTRY_MARKS = [("quijote", 1_000_000), ("2000-h", 750_000), ("index", -250_000)]


def decode_bytes(data: bytes) -> str:
    """UTF-8, else Windows' western code page, else Latin-1."""
    for name in ("utf-8", "cp1252"):
        try:
            return data.decode(name)
        except UnicodeDecodeError:
            continue
    return data.decode("latin-1")


def main_entry(entries: list[tuple[str, int]]) -> str:
    """The entry (name, size) of an archive that holds the page: the largest, by marks in its name; the first on ties."""
    return max(entries, key=lambda e: e[1] + sum(w for m, w in ENTRY_MARKS if m in e[0].lower()))[0]


def html(spark: SparkSession, path: str) -> DataFrame:
    """(path, entry, kind, html) of .html, .htm and .zip files; another kind of file is an error."""

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            out: dict[str, list] = {"path": [], "entry": [], "kind": [], "html": []}
            for p, data in zip(*(batch.column(k).to_pylist() for k in (0, 1))):
                low, entry = p.lower(), None
                if low.endswith(".zip"):
                    with zipfile.ZipFile(io.BytesIO(data)) as z:
                        pages = [(i.filename, i.file_size) for i in z.infolist() if i.filename.lower().endswith((".htm", ".html"))]
                        if not pages:
                            raise ValueError(f"no page in {p}")
                        entry = main_entry(pages)
                        data = z.read(entry)
                elif not low.endswith((".htm", ".html")):
                    raise ValueError(f"neither a page nor an archive: {p}")
                for k, v in zip(out, (p, entry, "zip" if entry else "html", decode_bytes(data))):
                    out[k].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([(k, pa.string()) for k in out]))

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(read, "path string, entry string, kind string, html string")


#: Where a page is looked for when none is given (fixed values).
USUAL = ["data/El_ingenioso_hidalgo_don_Quijote_de_la_Mancha.zip", "El_ingenioso_hidalgo_don_Quijote_de_la_Mancha.zip", "data/2000-h.htm", "2000-h.htm"]


def resolve(spark: SparkSession, path: str | None = None, candidates: list[str] | None = None) -> str:
    """The path given, which must be there, else the first candidate that is."""
    tried = [path] if path else list(candidates or USUAL)
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    for p in tried:
        at = spark._jvm.org.apache.hadoop.fs.Path(p)
        if at.getFileSystem(conf).exists(at):
            return p
    raise FileNotFoundError(f"no source at {', '.join(tried)}")


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of the .txt files under a folder, a row each; a folder without one is an error."""
    rows = spark.read.option("pathGlobFilter", "*.txt").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    if rows.select("path").isEmpty():
        raise FileNotFoundError(f"no .txt file in {path}")
    return rows


def joined(texts: DataFrame) -> DataFrame:
    """One row: the texts of (path, text) in order of path, a blank line between two. For a corpus that a driver's tokenizer trains on;
    tables of texts stay in rows."""
    return texts.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "text"))), lambda s: s["text"]), "\n\n").alias("text"))


def conll(spark: SparkSession, path: str) -> DataFrame:
    """(path, sentence, pos, word, label): a blank line ends a sentence, the last field of a line is the label.

    Files are read as blocks between blank lines, so a large one is many rows; a sentence is numbered within its file by
    where it starts."""
    rows = spark.read.option("lineSep", "\n\n").text(path).select(F.col("_metadata.file_path").alias("path"), F.struct("_metadata.file_block_start", F.monotonically_increasing_id()).alias("at"), "value")
    # line ends of other systems and blank lines with spaces leave several sentences in a block
    parts = rows.select("path", "at", F.posexplode(F.split("value", r"\r?\n\s*\r?\n|^\s*\n")).alias("part", "block"))
    lines = parts.select("path", "at", "part", F.filter(F.transform(F.split("block", r"\r?\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x.contains(" ")).alias("lines")).where(F.size("lines") > 0)
    numbered = lines.withColumn("sentence", F.row_number().over(Window.partitionBy("path").orderBy("at", "part")))
    each = numbered.select("path", "sentence", F.posexplode("lines").alias("pos", "text"))
    return each.select("path", "sentence", (F.col("pos") + 1).alias("pos"), F.regexp_extract("text", r"^(.*) (\S+)$", 1).alias("word"), F.regexp_extract("text", r"^(.*) (\S+)$", 2).alias("label"))


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """(path, file, part, pos, clave, valor) of annotators' JSON files: file is the number in .../json_N/ (or jsonN, with zeros before it or not), part
    that in ..._pN.json. Of several files of one part in folders of a number the first by name counts."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    # a folder's name is tried as json_07, json_7, json7 and json07
    folder = F.regexp_extract("path", r"/(json_?0*\d+)/[^/]*$", 1)
    form = F.when(folder.rlike(r"^json_\d\d"), 0).when(folder.rlike(r"^json_"), 1).when(folder.rlike(r"^json[1-9]"), 2).otherwise(3)
    named = rows.withColumn("file", F.regexp_extract("path", r"json_?0*(\d+)/[^/]*$", 1).cast("int")).withColumn("part", F.regexp_extract("path", r"_p(\d)\.json$", 1).cast("int")).withColumn("form", form)
    first = Window.partitionBy("file", "part").orderBy("form", "path")  # an annotator's few files
    one = named.withColumn("k", F.row_number().over(first)).where(F.col("k") == 1)
    records = F.from_json("value", "array<struct<clave:string,valor:string>>")
    return one.select("path", "file", "part", F.posexplode(records).alias("pos", "r")).select("path", "file", "part", "pos", "r.clave", "r.valor")


def assignments(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Sentences (sentence, text) and who annotates them (file from 1, slot, sentence) of an assignment file."""
    schema = "granularidad string, frases array<string>, asignaciones array<array<int>>"
    rows = spark.read.schema(schema).json(path, multiLine=True)
    sentences = rows.select(F.posexplode("frases").alias("sentence", "text"))
    files = rows.select(F.posexplode("asignaciones").alias("file", "own")).select((F.col("file") + 1).alias("file"), F.posexplode("own").alias("slot", "sentence"))
    return sentences, files


def merged(spark: SparkSession, path: str) -> DataFrame:
    """Merged sentences, from a list or from an object that holds them as `sentences`."""
    own = "array<struct<frase_id:int,text:string,tokens:array<string>,labels:array<string>>>"
    rows = spark.read.text(path, wholetext=True)
    found = F.coalesce(F.from_json("value", own), F.from_json("value", f"sentences {own}")["sentences"])
    return rows.select(F.explode(found).alias("s")).select("s.*")


def binary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", F.col("content").alias("data"))


def bytes_as_text(data: Column) -> Column:
    """Valid UTF-8 as text, else null: what decode_bytes() then reads."""
    return F.when(F.is_valid_utf8(data.cast("string")), F.decode(data, "UTF-8"))
