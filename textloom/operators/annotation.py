"""Two annotators' labels: agreement, merging, entities and evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def kappa(pairs: DataFrame, by: list[str]) -> DataFrame:
    """(by..., a, b) rows -> by..., n, agreement, kappa. One pass of counts; empty margins can't occur,
    and full chance agreement gives 1."""
    cells = pairs.groupBy(*by, "a", "b").agg(F.count("*").alias("n"))
    key = [F.col(c) for c in by]
    whole = Window.partitionBy(*key) if by else Window.partitionBy(F.lit(0))
    sums = cells.withColumn("na", F.sum("n").over(whole.partitionBy(*key, "a") if by else Window.partitionBy("a")))
    rows = sums.groupBy(*by, "a").agg(F.max("na").alias("na"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    cols = cells.groupBy(*by, F.col("b").alias("a")).agg(F.sum("n").alias("nb"))
    margins = rows.join(cols, [*by, "a"], "full")
    per = margins.groupBy(*by).agg(F.sum("na").alias("n"), F.sum("same").alias("same"), F.sum(F.coalesce("na", F.lit(0)) * F.coalesce("nb", F.lit(0))).alias("cross"))
    po, pe = F.col("same") / F.col("n"), F.col("cross") / (F.col("n") * F.col("n"))
    return per.select(*by, "n", po.alias("agreement"), F.when(pe == 1, 1.0).otherwise((po - pe) / (1 - pe)).alias("kappa"))


def merged(pairs: DataFrame) -> DataFrame:
    """(sentence, pos, a, b) -> + label: agreeing labels stay, a label beats o, and of two kinds of entity the
    first annotator's stays. An entity's first token starts it and each that follows one of its kind continues it."""
    a, b = T.label(F.col("a")), T.label(F.col("b"))
    chosen = F.when(a == b, a).when(a == "o", b).otherwise(a)
    return _continued(pairs.withColumn("chosen", chosen))


def _continued(rows: DataFrame) -> DataFrame:
    """(sentence, pos, chosen) rows with label in place of chosen: what starts and what continues."""
    rows = rows.withColumn("kind", F.when(F.col("chosen") != "o", F.left("chosen", F.lit(1))))
    before = F.lag("kind").over(Window.partitionBy("sentence").orderBy("pos"))
    label = F.when(F.col("kind").isNull(), "o").when(before == F.col("kind"), F.concat("kind", F.lit("c"))).otherwise(F.concat("kind", F.lit("i")))
    return rows.withColumn("label", label).drop("kind", "chosen")


def merged_votes(votes: DataFrame) -> DataFrame:
    """(sentence, pos, annotator, label) of any number of annotators -> sentence, pos, label: of the labels beside o the commonest
    wins, of equals the first annotator's; o where there is none."""
    rows = votes.select("sentence", "pos", "annotator", T.label(F.col("label")).alias("label"))
    each = rows.groupBy("sentence", "pos", "label").agg(F.count("*").alias("n"), F.min("annotator").alias("first"))
    beside = F.when(F.col("label") != "o", F.struct(F.col("n"), (-F.col("first")).alias("first"), F.col("label").alias("l")))
    chosen = each.groupBy("sentence", "pos").agg(F.coalesce(F.max(beside)["l"], F.lit("o")).alias("chosen"))
    return _continued(chosen)


def agreement(votes: DataFrame) -> DataFrame:
    """(sentence, pos, annotator, label) -> sentence, agreement: the share of places where two annotators agree; 1 where there aren't two."""
    rows = votes.select("sentence", "pos", "annotator", T.label(F.col("label")).alias("label"))
    per = rows.groupBy("sentence", "pos").agg(F.count("*").alias("n"), (F.min("label") == F.max("label")).alias("same"))
    two = F.max("n") == 2
    return per.groupBy("sentence").agg(F.when(two & (F.min("n") == 2), F.avg(F.col("same").cast("double"))).otherwise(1.0).alias("agreement"))


def entities(tags: DataFrame) -> DataFrame:
    """(sentence, pos, tag in BIO form) -> sentence, type, start, end (exclusive): a stray I starts one, a change of type parts two."""
    order = Window.partitionBy("sentence").orderBy("pos")
    kind = F.when(F.col("tag") != "O", F.substring("tag", 3, 100))
    rows = tags.withColumn("type", kind)
    starts = F.col("type").isNotNull() & (F.col("tag").startswith("B-") | ~F.lag("type").over(order).eqNullSafe(F.col("type")))
    rows = rows.withColumn("no", F.sum(starts.cast("int")).over(order)).where("type is not null")
    return rows.groupBy("sentence", "no", "type").agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("end")).drop("no")


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b)


def token_metrics(rows: DataFrame, ignore: int = -100) -> DataFrame:
    """(pred, gold) ids -> accuracy, and precision, recall and F1 of all but label 0. A wrong entity label counts on both sides."""
    rows = rows.where(F.col("gold") != ignore)
    p, g = F.col("pred"), F.col("gold")
    c = rows.agg(F.count("*").alias("n"), F.count_if(p == g).alias("same"), F.count_if((p == g) & (g != 0)).alias("tp"), F.count_if((p != g) & (p != 0)).alias("fp"), F.count_if((p != g) & (g != 0)).alias("fn"))
    return _prf(c, F.col("n"), _ratio(F.col("same"), F.col("n")).alias("accuracy"))


def _prf(c: DataFrame, *first: Column) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    f1 = _ratio(2 * tp, 2 * tp + fp + fn)
    return c.select(*first, _ratio(tp, tp + fp).alias("precision"), _ratio(tp, tp + fn).alias("recall"), F.when((tp + fp > 0) & (tp + fn > 0), f1).alias("f1"))


def entity_metrics(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """Entities (sentence, type, start, end) -> type (null: all), support, precision, recall, f1."""
    keys = ["sentence", "type", "start", "end"]
    both = pred.select(*keys, F.lit(1).alias("p")).join(gold.select(*keys, F.lit(1).alias("g")), keys, "full")
    p, g = F.col("p").isNotNull(), F.col("g").isNotNull()
    c = both.rollup("type").agg(F.count_if(p & g).alias("tp"), F.count_if(p & ~g).alias("fp"), F.count_if(~p & g).alias("fn"))
    return _prf(c, F.col("type"), (F.col("tp") + F.col("fn")).alias("support"))


def class_weights(labels: DataFrame, most: float = 8.0) -> DataFrame:
    """label -> weight: the root of all over the label's share, at most `most`; every count starts at 1."""
    c = labels.groupBy("label").agg((F.count("*") + 1).alias("c"))
    total = c.agg(F.sum("c").alias("total"), F.count("*").alias("k"))
    return c.crossJoin(total).select("label", F.least(F.lit(most), F.sqrt(F.col("total") / (F.col("k") * F.col("c")))).alias("weight"))


def double_assignment(sentences: DataFrame, per_file: int) -> DataFrame:
    """(sentence from 0) -> file, slot, sentence: every sentence goes to two files, in rounds. Slot s holds sentence s mod n;
    what is over goes to the last file."""
    n = sentences.agg(F.count("*").alias("n"))
    slots = sentences.crossJoin(n).select("n", F.explode(F.array(F.col("sentence"), F.col("sentence") + F.col("n"))).alias("s"))
    files = F.greatest(F.floor(2 * F.col("n") / per_file), F.lit(1))
    file = F.least(F.floor(F.col("s") / per_file), files - 1)
    return slots.select(file.cast("long").alias("file"), (F.col("s") - file * per_file).cast("long").alias("slot"), (F.col("s") % F.col("n")).cast("long").alias("sentence"))
