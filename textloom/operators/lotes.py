"""Annotated sentences in lots: from annotators' files of records to merged sentences, their agreement and its report.

Tables: records (file, pos, clave, valor), a unit of text with its label each; sentences (sentence, text); and
files (file, slot, sentence), which says whose files hold which sentences.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import annotation as A


def placed(records: DataFrame) -> DataFrame:
    """records with the place of each unit in its file's text: start (from 0) and end."""
    upto = Window.partitionBy("file").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.length("clave")).over(upto)
    return records.withColumn("end", end).withColumn("start", F.col("end") - F.length("clave"))


def file_texts(records: DataFrame) -> DataFrame:
    """(file, text): a file's units joined. One annotator's file is one task's, as it was one person's."""
    units = records.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("pos", "clave"))).alias("u"))
    return units.select("file", F.array_join(F.transform("u", lambda s: s["clave"]), "").alias("text"))


def found_at(text: Column, sentence: Column) -> Column:
    """Where a sentence starts in a text (from 0), null if nowhere; else where it does with straight quotes."""
    exact = F.instr(text, sentence)
    return F.when(exact > 0, exact - 1).otherwise(F.nullif(F.instr(T.straight_quotes(text), T.straight_quotes(sentence)), F.lit(0)) - 1)


def annotations(records: DataFrame, sentences: DataFrame, files: DataFrame) -> DataFrame:
    """(sentence, turn, file, k, clave, label): of each sentence, in each file that has it, the units that its characters
    overlap, numbered from 0; turn numbers its files from 0."""
    asked = files.join(sentences, "sentence").select("sentence", "file", "slot", F.lower("text").alias("sought"))
    turn = F.row_number().over(Window.partitionBy("sentence").orderBy("file", "slot")) - 1
    where = asked.withColumn("turn", turn).join(file_texts(records), "file").withColumn("from", found_at(F.col("text"), F.col("sought"))).where("from is not null")
    spans = where.select("sentence", "turn", "file", "from", (F.col("from") + F.length("sought")).alias("to"))
    units = spans.join(placed(records), "file").where((F.col("end") > F.col("from")) & (F.col("start") < F.col("to")))
    k = F.row_number().over(Window.partitionBy("sentence", "turn").orderBy("pos")) - 1
    return units.select("sentence", "turn", "file", k.alias("k"), "clave", T.label(F.col("valor")).alias("label"))


def labelled(rows: DataFrame) -> DataFrame:
    """Those of annotations() that have a label beside o."""
    some = rows.groupBy("sentence", "turn").agg(F.max((F.col("label") != "o").cast("int")).alias("some")).where("some = 1")
    return rows.join(some.select("sentence", "turn"), ["sentence", "turn"], "left_semi")


def pairs(rows: DataFrame, files: DataFrame) -> DataFrame:
    """(sentence, state, n): of each sentence in files, whether it has two annotations of one length: `merged`, or
    else `no pair` (it isn't in two files), `unlabeled` (fewer than two are found) or `lengths`."""
    asked = files.groupBy("sentence").agg(F.count("*").alias("files"))
    sizes = rows.groupBy("sentence", "turn").agg(F.count("*").alias("n")).groupBy("sentence").agg(F.count("*").alias("found"), F.min("n").alias("n"), F.max("n").alias("most"))
    state = F.when(F.col("files") != 2, "no pair").when(F.coalesce("found", F.lit(0)) < 2, "unlabeled").when(F.col("n") != F.col("most"), "lengths").otherwise("merged")
    return asked.join(sizes, "sentence", "left").select("sentence", state.alias("state"), "n")


def side_by_side(rows: DataFrame, states: DataFrame) -> DataFrame:
    """(sentence, pos, clave, a, b) of the sentences that can be merged: both annotators' labels at each place."""
    one = rows.where("turn = 0").select("sentence", F.col("k").alias("pos"), "clave", F.col("label").alias("a"))
    two = rows.where("turn = 1").select("sentence", F.col("k").alias("pos"), F.col("label").alias("b"))
    return one.join(two, ["sentence", "pos"]).join(states.where("state = 'merged'").select("sentence"), "sentence", "left_semi")


def details(both: DataFrame) -> DataFrame:
    """(sentence, n, kappa, agreement, disagreements) of side_by_side()."""
    per = A.kappa(both.select("sentence", "a", "b"), ["sentence"])
    return per.select("sentence", "n", "kappa", "agreement", F.round(F.col("n") * (1 - F.col("agreement"))).cast("long").alias("disagreements"))


def merged(both: DataFrame) -> DataFrame:
    """(sentence, text, tokens, labels): merged sentences, from side_by_side()."""
    rows = A.merged(both).groupBy("sentence").agg(F.array_sort(F.collect_list(F.struct("pos", "clave", "label"))).alias("u"))  # a sentence's
    tokens = F.transform("u", lambda s: s["clave"])
    return rows.select("sentence", F.array_join(tokens, "").alias("text"), tokens.alias("tokens"), F.transform("u", lambda s: s["label"]).alias("labels"))


def report(lots: dict[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """For each lot, given as pairs() and details(), and over all (lote null): sentences, merged ones, those
    passed over and why, and the means of kappa and agreement, each sentence weighing the same."""
    rows = None
    for name, (states, found) in lots.items():
        own = states.drop("n").join(found, "sentence", "left").withColumn("lote", F.lit(name))
        rows = own if rows is None else rows.unionByName(own)
    is_ = lambda s: F.count_if(F.col("state") == s)
    mean = lambda c: F.coalesce(F.avg(F.when(F.col("state") == "merged", F.col(c))), F.lit(0.0))
    return rows.rollup("lote").agg(F.count("*").alias("sentences"), is_("merged").alias("merged"), is_("no pair").alias("no_pair"), is_("unlabeled").alias("unlabeled"), is_("lengths").alias("lengths"), mean("kappa").alias("kappa"), mean("agreement").alias("agreement"))


def union(lots: list[DataFrame], sizes: list[int]) -> DataFrame:
    """Lots of sentences as one, the numbers of each moved on by the sizes of those before."""
    out, before = None, 0
    for df, n in zip(lots, sizes):
        own = df.withColumn("sentence", F.col("sentence") + F.lit(before))
        out, before = own if out is None else out.unionByName(own), before + n
    return out


def char_labels(tokens: Column, labels: Column) -> Column:
    """A label for each character of the tokens; lists of unequal number are an error."""
    each = F.flatten(F.transform(F.arrays_zip(tokens.alias("t"), labels.alias("l")), lambda p: F.array_repeat(p["l"], F.length(p["t"]))))
    return F.when(F.size(tokens) != F.size(labels), F.raise_error(F.lit("tokens and labels differ in number"))).otherwise(each)


def entity_counts(rows: DataFrame, *by: str) -> DataFrame:
    """(label) rows -> type, n: the entities that start, by kind."""
    kind = F.when(F.col("label").startswith("p"), "PER").when(F.col("label").startswith("l"), "LOC")
    return rows.where(F.col("label").endswith("i")).groupBy(*by, kind.alias("type")).agg(F.count("*").alias("n"))


def coverage(records: DataFrame) -> DataFrame:
    """(file, units, entity, entity_pct): a file's characters, and those with a label beside o."""
    n, own = F.length("clave"), T.label(F.col("valor")) != "o"
    sums = records.groupBy("file").agg(F.sum(n).alias("units"), F.sum(F.when(own, n).otherwise(0)).alias("entity"))
    return sums.select("file", "units", "entity", F.round(100 * F.col("entity") / F.greatest("units", F.lit(1)), 2).alias("entity_pct"))


def conll_statistics(sentences: DataFrame) -> DataFrame:
    """One row on what becomes of (tokens, labels) in CoNLL form: sentences, tokens, those written, blank ones, which count by their labels
    too, those of entities, and how many have each label."""
    rows = sentences.select(F.explode_outer(F.arrays_zip("tokens", "labels")).alias("p"))
    blank = F.regexp_replace("p.tokens", r"(?U)\s+", "") == ""
    tags = rows.where("p is not null").select(T.bio(F.col("p.labels")).alias("tag"), blank.alias("blank"))
    names = {"O": "o", "B-PER": "b_per", "I-PER": "i_per", "B-LOC": "b_loc", "I-LOC": "i_loc"}
    counts = tags.agg(F.count("*").alias("source_tokens"), F.count_if(~F.col("blank")).alias("written_tokens"), F.count_if("blank").alias("blank_tokens"), F.count_if(F.col("tag") != "O").alias("entity_tokens"), *[F.count_if(F.col("tag") == t).alias(n) for t, n in names.items()])
    return sentences.agg(F.count("*").alias("sentences")).crossJoin(counts)  # one row each


def drawn(sentences: DataFrame, n: int, seed: int) -> DataFrame:
    """n of the sentences (sentence, text), those whose hash with the seed is lowest, numbered from 0 in that order."""
    best = sentences.select("text", F.xxhash64("sentence", "text", F.lit(seed)).alias("h"), "sentence").orderBy("h", "sentence").limit(n)
    return best.select((F.row_number().over(Window.orderBy("h", "sentence")) - 1).cast("long").alias("sentence"), "text")  # n rows


def made(texts: DataFrame, *, files: int, each: int, least: int, seed: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sentences drawn from (path, text), who gets which (files and slots), and the templates. Every sentence goes to two files of `each`
    sentences, so files * each is even; fewer sentences of `least` words than that takes are an error."""
    if files * each % 2:
        raise ValueError("files * each must be even, as each sentence is in two files")
    n = files * each // 2
    found = texts.select("path", F.posexplode(T.phrases(F.col("text"))).alias("pos", "text")).where(T.word_runs(F.col("text")) >= least)
    own = drawn(found.select(F.xxhash64("path", "pos").alias("sentence"), "text"), n, seed)
    if (there := own.count()) < n:
        raise ValueError(f"{there} sentences of {least} words or more, {n} are needed")
    given = A.double_assignment(own.select("sentence"), each)
    return own, given, templates(own, given)


def templates(sentences: DataFrame, files: DataFrame) -> DataFrame:
    """(file, records): what an annotator fills in: the units of a file's sentences, in order and parted by spaces, each without a label."""
    rows = files.join(sentences, "sentence").groupBy("file").agg(F.array_sort(F.collect_list(F.struct("slot", "text"))).alias("s"))  # a file's sentences
    whole = F.array_join(F.transform("s", lambda x: x["text"]), " ")
    units = F.transform(T.lossless_tokens(whole), lambda t: F.struct(t.alias("clave"), F.lit("").alias("valor")))
    return rows.select("file", units.alias("records"))
