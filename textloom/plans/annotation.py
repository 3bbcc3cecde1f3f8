"""Annotation queries, with their SQL. Labels of documents stand for annotators: quality for one, not toxic for the other."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import annotation as A
from ..operators import lotes, ner
from ..operators.bpe import Bpe
from .base import Book, table

book = Book()
_PAIRS = "p AS (SELECT d.source, d.lang, l.quality AS a, 1 - l.toxic AS b FROM labels l JOIN documents d USING (doc_id))"


def _pairs(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), "doc_id").select("source", "lang", F.col("quality").alias("a"), (1 - F.col("toxic")).alias("b"))


def _kappa_sql(by: str) -> str:
    g, own = (f"GROUP BY {by}", f"{by},") if by else ("", "")
    return f"""SELECT {own} n, agreement, CASE WHEN pe = 1 THEN 1.0 ELSE (agreement - pe) / (1 - pe) END AS kappa FROM (
 SELECT {own} count(*) AS n, avg(CASE WHEN a = b THEN 1.0 ELSE 0 END) AS agreement,
  CAST(sum(a) AS DOUBLE) / count(*) * sum(b) / count(*) + (count(*) - sum(a)) / count(*) * (count(*) - sum(b)) / count(*) AS pe FROM p {g})"""


@book(f"WITH {_PAIRS} SELECT CAST(n AS BIGINT) AS n, round(agreement, 6) AS agreement, round(kappa, 6) AS kappa FROM ({_kappa_sql('')})")
def cohen_kappa(spark, sf_dir):
    k = A.kappa(_pairs(spark, sf_dir).select(F.lit(0).alias("all"), "a", "b"), ["all"])
    return k.select("n", F.round("agreement", 6).alias("agreement"), F.round("kappa", 6).alias("kappa"))


@book(f"WITH {_PAIRS} SELECT a, CAST(count(*) FILTER (b = 0) AS BIGINT) AS b0, CAST(count(*) FILTER (b = 1) AS BIGINT) AS b1 FROM p GROUP BY a")
def confusion_pivot(spark, sf_dir):
    return _pairs(spark, sf_dir).groupBy("a").pivot("b", [0, 1]).agg(F.count(F.lit(1))).fillna(0).toDF("a", "b0", "b1")


@book("""WITH c AS (SELECT lang, quality, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY lang, quality)
SELECT lang, quality, CAST(n AS BIGINT) AS n, round(100 * n / sum(n) OVER (), 6) AS pct, round(100 * n / sum(n) OVER (PARTITION BY lang), 6) AS pct_lang FROM c""")
def label_distribution(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    c = table(spark, sf_dir, "labels").join(docs, "doc_id").groupBy("lang", "quality").agg(F.count("*").alias("n"))
    # a row for each language and label
    whole, lang = Window.partitionBy(F.lit(0)), Window.partitionBy("lang")
    return c.select("lang", "quality", "n", F.round(100 * F.col("n") / F.sum("n").over(whole), 6).alias("pct"), F.round(100 * F.col("n") / F.sum("n").over(lang), 6).alias("pct_lang"))


@book(f"WITH {_PAIRS}, k AS ({_kappa_sql('lang, source')}) SELECT lang, CAST(sum(n) AS BIGINT) AS n, round(avg(kappa), 6) AS mean_kappa, round(avg(agreement), 6) AS mean_agreement, CAST(count(*) AS BIGINT) AS groups FROM k GROUP BY ROLLUP (lang)")
def agreement_rollup(spark, sf_dir):
    """By language and over all, each source weighing the same."""
    k = A.kappa(_pairs(spark, sf_dir), ["lang", "source"])
    return k.rollup("lang").agg(F.sum("n").alias("n"), F.round(F.avg("kappa"), 6).alias("mean_kappa"), F.round(F.avg("agreement"), 6).alias("mean_agreement"), F.count("*").alias("groups"))


@book(f"""WITH {_PAIRS}, k AS ({_kappa_sql('source')}) SELECT CAST(count(*) FILTER (kappa < 0.2) AS BIGINT) AS k0, CAST(count(*) FILTER (kappa >= 0.2 AND kappa < 0.4) AS BIGINT) AS k2,
CAST(count(*) FILTER (kappa >= 0.4 AND kappa < 0.6) AS BIGINT) AS k4, CAST(count(*) FILTER (kappa >= 0.6 AND kappa < 0.8) AS BIGINT) AS k6, CAST(count(*) FILTER (kappa >= 0.8) AS BIGINT) AS k8 FROM k""")
def kappa_histogram(spark, sf_dir):
    k = F.col("kappa")
    return A.kappa(_pairs(spark, sf_dir), ["source"]).agg(F.count_if(k < 0.2).alias("k0"), *[F.count_if((k >= lo) & (k < hi)).alias(n) for n, lo, hi in (("k2", 0.2, 0.4), ("k4", 0.4, 0.6), ("k6", 0.6, 0.8))], F.count_if(k >= 0.8).alias("k8"))


@book(f"WITH {_PAIRS} SELECT source, round(kappa, 6) AS kappa FROM ({_kappa_sql('source')}) ORDER BY round(kappa, 6), source LIMIT 6")
def worst_agreement(spark, sf_dir):
    k = A.kappa(_pairs(spark, sf_dir), ["source"]).select("source", F.round("kappa", 6).alias("kappa"))
    return k.orderBy("kappa", "source").limit(6)


# Tags of conversations' words: two rules stand for two annotators.
_TAGS = r"""w AS (SELECT conv_id * 1000 + turn AS sentence, unnest(string_split(text, ' ')) AS w, unnest(range(len(string_split(text, ' ')))) AS pos FROM conversations WHERE text IS NOT NULL),
t AS (SELECT sentence, pos, CASE WHEN regexp_matches(w, '^[A-Z]') THEN 'pi' WHEN length(w) > 9 THEN 'li' WHEN w LIKE '%.' THEN 'ps' ELSE 'o' END AS a,
  CASE WHEN regexp_matches(w, '^[A-Z]') AND length(w) > 3 THEN 'pc' WHEN length(w) > 8 THEN 'lc' ELSE '' END AS b FROM w)"""
_MERGED = _TAGS + """,
n AS (SELECT *, CASE WHEN a = 'ps' THEN 'pi' ELSE a END AS x, CASE WHEN b = '' THEN 'o' ELSE b END AS y FROM t),
k AS (SELECT *, CASE WHEN x = y THEN x WHEN x = 'o' THEN y ELSE x END AS c FROM n),
p AS (SELECT sentence, pos, CASE WHEN c = 'o' THEN NULL ELSE left(c, 1) END AS kind FROM k),
g AS (SELECT sentence, pos, kind, lag(kind) OVER (PARTITION BY sentence ORDER BY pos) AS before FROM p),
m AS (SELECT sentence, pos, CASE WHEN kind IS NULL THEN 'o' WHEN before = kind THEN kind || 'c' ELSE kind || 'i' END AS label FROM g)"""


def _tags(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").where("text is not null").select((F.col("conv_id") * 1000 + F.col("turn")).alias("sentence"), F.posexplode(F.split("text", " ")).alias("pos", "w"))
    w, n = F.col("w"), F.length("w")
    a = F.when(w.rlike("^[A-Z]"), "pi").when(n > 9, "li").when(w.endswith("."), "ps").otherwise("o")
    b = F.when(w.rlike("^[A-Z]") & (n > 3), "pc").when(n > 8, "lc").otherwise("")
    return rows.select("sentence", "pos", a.alias("a"), b.alias("b"))


@book(f"WITH {_MERGED} SELECT label, CAST(count(*) AS BIGINT) AS n, CAST(sum(pos) AS BIGINT) AS places FROM m GROUP BY label")
def vote_merge_bio(spark, sf_dir):
    return A.merged(_tags(spark, sf_dir)).groupBy("label").agg(F.count("*").alias("n"), F.sum("pos").cast("long").alias("places"))


_SPANS = """{0} AS (SELECT sentence, type, min(pos) AS start, max(pos) + 1 AS stop FROM (
  SELECT sentence, pos, type, sum(CASE WHEN type IS NOT NULL AND (first OR before IS DISTINCT FROM type) THEN 1 ELSE 0 END) OVER (PARTITION BY sentence ORDER BY pos) AS no FROM (
    SELECT *, lag(type) OVER (PARTITION BY sentence ORDER BY pos) AS before FROM (
      SELECT sentence, pos, CASE left({1}, 1) WHEN 'p' THEN 'PER' WHEN 'l' THEN 'LOC' END AS type, {1} LIKE '_i' AS first FROM {2})))
  WHERE type IS NOT NULL GROUP BY sentence, no, type)"""


@book(f"WITH {_MERGED}, {_SPANS.format('e', 'label', 'm')} SELECT sentence, type, CAST(start AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop FROM e")
def bio_to_entities(spark, sf_dir):
    tags = A.merged(_tags(spark, sf_dir)).select("sentence", "pos", T.bio(F.col("label")).alias("tag"))
    return A.entities(tags).select("sentence", "type", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("stop"))


@book(f"""WITH {_MERGED}, {_SPANS.format('gold', 'label', 'm')}, one AS (SELECT sentence, pos, CASE WHEN a = 'ps' THEN 'pi' ELSE a END AS label FROM t), {_SPANS.format('pred', 'label', 'one')},
f AS (SELECT coalesce(p.type, g.type) AS type, p.type IS NOT NULL AS p, g.type IS NOT NULL AS g FROM pred p FULL JOIN gold g ON p.sentence = g.sentence AND p.type = g.type AND p.start = g.start AND p.stop = g.stop),
c AS (SELECT type, count(*) FILTER (p AND g) AS tp, count(*) FILTER (p AND NOT g) AS fp, count(*) FILTER (g AND NOT p) AS fn FROM f GROUP BY ROLLUP (type))
SELECT type, CAST(tp + fn AS BIGINT) AS support, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM c""")
def entity_metrics(spark, sf_dir):
    """The first annotator's entities against the merged ones."""
    tags = _tags(spark, sf_dir)
    gold = A.entities(A.merged(tags).select("sentence", "pos", T.bio(F.col("label")).alias("tag")))
    pred = A.entities(tags.select("sentence", "pos", T.bio(T.label(F.col("a"))).alias("tag")))
    out = A.entity_metrics(pred, gold)
    return out.select("type", "support", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@book("""WITH c AS (SELECT count(*) AS n, count(*) FILTER (quality = toxic) AS same, count(*) FILTER (quality = toxic AND toxic <> 0) AS tp,
 count(*) FILTER (quality <> toxic AND quality <> 0) AS fp, count(*) FILTER (quality <> toxic AND toxic <> 0) AS fn FROM labels)
SELECT CAST(n AS BIGINT) AS n, round(same / n, 6) AS accuracy, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM c""")
def token_metrics(spark, sf_dir):
    m = A.token_metrics(table(spark, sf_dir, "labels").select(F.col("quality").alias("pred"), F.col("toxic").alias("gold")))
    return m.select("n", *[F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


@book(f"""WITH {_MERGED}, c AS (SELECT label, count(*) + 1 AS c FROM m GROUP BY label)
SELECT label, round(least(8.0, sqrt(sum(c) OVER () / (count(*) OVER () * c))), 6) AS weight FROM c""")
def class_weights(spark, sf_dir):
    return A.class_weights(A.merged(_tags(spark, sf_dir))).select("label", F.round("weight", 6).alias("weight"))


@book(f"""WITH {_MERGED}, s AS (SELECT sentence, count(*) AS units, count(*) FILTER (label <> 'o') AS entity FROM m GROUP BY sentence)
SELECT sentence, CAST(units AS BIGINT) AS units, round(100 * entity / units, 2) AS entity_pct FROM s ORDER BY entity / units DESC, sentence LIMIT 15""")
def coverage_top(spark, sf_dir):
    c = A.merged(_tags(spark, sf_dir)).groupBy("sentence").agg(F.count("*").alias("units"), F.count_if(F.col("label") != "o").alias("entity"))
    return c.orderBy(F.desc(F.col("entity") / F.col("units")), "sentence").limit(15).select("sentence", "units", F.round(100 * F.col("entity") / F.col("units"), 2).alias("entity_pct"))


@book(f"WITH {_PAIRS} SELECT source, round(kappa, 6) AS kappa FROM ({_kappa_sql('source')}) ORDER BY round(kappa, 6) DESC, source LIMIT 5")
def best_agreement(spark, sf_dir):
    k = A.kappa(_pairs(spark, sf_dir), ["source"]).select("source", F.round("kappa", 6).alias("kappa"))
    return k.orderBy(F.desc("kappa"), "source").limit(5)


_CAPS = ", ".join(f"'{w}'" for w in T.CAPITALISED)


@book(rf"""WITH e AS (SELECT doc_id, list_filter(regexp_extract_all(regexp_replace(text, '[\x{{AA}}\x{{B5}}\x{{BA}}\x{{C0}}-\x{{D6}}\x{{D8}}-\x{{F6}}\x{{F8}}-\x{{2FF}}\x{{370}}-\x{{1FFF}}\x{{3040}}-\x{{D7FF}}]', '_', 'g'), '\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\b', 1), lambda x: x NOT IN ({_CAPS})) AS found FROM documents)
SELECT doc_id, CAST(len(list_distinct(found)) AS BIGINT) AS n, found[1] AS first FROM e""")
def capitalised_entities(spark, sf_dir):
    found = T.capitalised_entities(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(found).cast("long").alias("n"), F.get(found, F.lit(0)).alias("first"))


# Three rules for words of conversations stand for three annotators.
_VOTES = r"""w AS (SELECT conv_id * 1000 + turn AS sentence, unnest(string_split(text, ' ')) AS w, unnest(range(len(string_split(text, ' ')))) AS pos FROM conversations WHERE text IS NOT NULL),
v AS (SELECT sentence, pos, 1 AS annotator, CASE WHEN regexp_matches(w, '^[A-Z]') THEN 'pi' WHEN length(w) > 9 THEN 'li' ELSE 'o' END AS label FROM w
 UNION ALL SELECT sentence, pos, 2, CASE WHEN length(w) > 8 THEN 'lc' WHEN w LIKE '%e' THEN 'pc' ELSE 'o' END FROM w
 UNION ALL SELECT sentence, pos, 3, CASE WHEN length(w) > 7 THEN 'pc' WHEN w LIKE '%e' THEN 'li' ELSE 'o' END FROM w)"""


def _votes(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").where("text is not null").select((F.col("conv_id") * 1000 + F.col("turn")).alias("sentence"), F.posexplode(F.split("text", " ")).alias("pos", "w"))
    w, n = F.col("w"), F.length("w")
    one = F.when(w.rlike("^[A-Z]"), "pi").when(n > 9, "li").otherwise("o")
    two = F.when(n > 8, "lc").when(w.endswith("e"), "pc").otherwise("o")
    three = F.when(n > 7, "pc").when(w.endswith("e"), "li").otherwise("o")
    return rows.select("sentence", "pos", F.posexplode(F.array(one, two, three)).alias("annotator", "label")).withColumn("annotator", F.col("annotator") + 1)


@book(f"""WITH {_VOTES}, c AS (SELECT sentence, pos, label, count(*) AS n, min(annotator) AS first FROM v WHERE label <> 'o' GROUP BY ALL),
r AS (SELECT sentence, pos, label, row_number() OVER (PARTITION BY sentence, pos ORDER BY n DESC, first) AS k FROM c),
p AS (SELECT w.sentence, w.pos, left(r.label, 1) AS kind FROM w LEFT JOIN r ON r.sentence = w.sentence AND r.pos = w.pos AND r.k = 1),
g AS (SELECT *, lag(kind) OVER (PARTITION BY sentence ORDER BY pos) AS before FROM p)
SELECT sentence, CAST(pos AS BIGINT) AS pos, CASE WHEN kind IS NULL THEN 'o' WHEN before = kind THEN kind || 'c' ELSE kind || 'i' END AS label FROM g""")
def votes_of_three(spark, sf_dir):
    return A.merged_votes(_votes(spark, sf_dir)).select("sentence", F.col("pos").cast("long").alias("pos"), "label")


@book(f"""WITH {_VOTES}, p AS (SELECT sentence, pos, min(label) = max(label) AS same FROM v WHERE annotator < 3 GROUP BY ALL)
SELECT sentence, round(avg(CASE WHEN same THEN 1.0 ELSE 0 END), 6) AS two, CAST(1 AS DOUBLE) AS three FROM p GROUP BY sentence""")
def annotator_agreement(spark, sf_dir):
    """Of two annotators; with three there is nothing to agree on and it is 1."""
    v = _votes(spark, sf_dir)
    two = A.agreement(v.where("annotator < 3")).select("sentence", F.round("agreement", 6).alias("two"))
    return two.join(A.agreement(v).select("sentence", F.col("agreement").alias("three")), "sentence")


# Each conversation, as one text, is annotated in two files, by rules; its turns are the sentences. Some second files are missing.
_LOTE = r"""t AS (SELECT conv_id, turn, lower(text) AS text FROM conversations WHERE text IS NOT NULL),
full_ AS (SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS text FROM t GROUP BY conv_id),
u AS (SELECT conv_id, unnest(regexp_extract_all(text, '\s+|[\p{L}\p{N}_\p{Mn}]+|[^\p{L}\p{N}_\p{Mn}\s]')) AS clave, unnest(range(len(regexp_extract_all(text, '\s+|[\p{L}\p{N}_\p{Mn}]+|[^\p{L}\p{N}_\p{Mn}\s]')))) AS pos FROM full_),
o AS (SELECT *, sum(length(clave)) OVER (PARTITION BY conv_id ORDER BY pos) AS stop FROM u),
x AS (SELECT conv_id, pos, clave, stop - length(clave) AS start, stop, CASE WHEN length(clave) > 8 THEN 'pi' WHEN clave LIKE '%a' THEN 'li' ELSE 'o' END AS a, CASE WHEN length(clave) > 7 THEN 'pi' WHEN clave LIKE '%a' THEN 'lc' ELSE 'o' END AS b FROM o),
s AS (SELECT t.conv_id, t.conv_id * 1000 + turn AS sentence, strpos(f.text, t.text) - 1 AS from_, strpos(f.text, t.text) - 1 + length(t.text) AS to_, t.conv_id % 7 = 0 AS lacks FROM t JOIN full_ f USING (conv_id)),
m AS (SELECT s.sentence, s.conv_id, lacks, row_number() OVER (PARTITION BY s.sentence ORDER BY pos) - 1 AS k, clave, a, b FROM s JOIN x ON x.conv_id = s.conv_id AND stop > from_ AND start < to_),
both_ AS (SELECT * FROM m WHERE NOT lacks)"""


def _lote(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Records, sentences and files."""
    turns = table(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "turn", F.lower("text").alias("text"))
    whole = turns.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), " ").alias("text"))
    units = whole.select("conv_id", F.posexplode(T.lossless_tokens(F.col("text"))).alias("pos", "clave"))
    n, ends = F.length("clave"), F.col("clave").endswith("a")
    sides = [F.when(n > 8, "pi").when(ends, "li").otherwise("o"), F.when(n > 7, "pi").when(ends, "lc").otherwise("o")]
    one, two = (units.select((F.col("conv_id") * 2 + k).alias("file"), "pos", "clave", label.alias("valor")) for k, label in enumerate(sides))
    records = one.unionByName(two.where("(file - 1) / 2 % 7 <> 0"))
    sentences = turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("sentence"), "text", "conv_id", "turn")
    files = sentences.select("sentence", F.col("turn").alias("slot"), F.explode(F.array(F.col("conv_id") * 2, F.col("conv_id") * 2 + 1)).alias("file"))
    return records, sentences.select("sentence", "text"), files


@book(f"""WITH {_LOTE} SELECT sentence, CAST(count(*) AS BIGINT) AS n, round(avg(CASE WHEN a = b THEN 1.0 ELSE 0 END), 6) AS agreement, CAST(count(*) FILTER (a <> b) AS BIGINT) AS disagreements FROM both_ GROUP BY sentence""")
def lote_sentences(spark, sf_dir):
    """Sentences found in their annotators' files by place, and how far the two agree."""
    records, sentences, files = _lote(spark, sf_dir)
    rows = lotes.annotations(records, sentences, files)
    found = lotes.details(lotes.side_by_side(rows, lotes.pairs(rows, files)))
    return found.select("sentence", "n", F.round("agreement", 6).alias("agreement"), "disagreements")


_PE = "CAST(count(*) FILTER (a = '{0}') AS DOUBLE) / count(*) * count(*) FILTER (b = '{0}') / count(*)"


@book(f"""WITH {_LOTE}, k AS (SELECT sentence, avg(CASE WHEN a = b THEN 1.0 ELSE 0 END) AS po, {' + '.join(_PE.format(x) for x in ('o', 'pi', 'li', 'lc', 'pc'))} AS pe FROM both_ GROUP BY sentence),
d AS (SELECT s.sentence, CASE WHEN s.conv_id % 2 = 0 THEN 'even' ELSE 'odd' END AS lote, lacks, po, CASE WHEN pe = 1 THEN 1.0 ELSE (po - pe) / (1 - pe) END AS kappa FROM s LEFT JOIN k USING (sentence))
SELECT lote, CAST(count(*) AS BIGINT) AS sentences, CAST(count(*) FILTER (NOT lacks) AS BIGINT) AS merged, CAST(count(*) FILTER (lacks) AS BIGINT) AS unlabeled, round(avg(kappa), 6) AS kappa, round(avg(po), 6) AS agreement FROM d GROUP BY ROLLUP (lote)""")
def lote_report(spark, sf_dir):
    """Two lots, of conversations with even and odd numbers."""
    records, sentences, files = _lote(spark, sf_dir)
    found = {}
    for name, rest in (("even", 0), ("odd", 1)):
        own = files.where(F.floor(F.col("file") / 2) % 2 == rest)
        rows = lotes.annotations(records, sentences, own)
        states = lotes.pairs(rows, own)
        found[name] = states, lotes.details(lotes.side_by_side(rows, states))
    out = lotes.report(found)
    return out.select("lote", "sentences", "merged", "unlabeled", F.round("kappa", 6).alias("kappa"), F.round("agreement", 6).alias("agreement"))


@book(f"""WITH {_LOTE}, p AS (SELECT sentence, k, clave, left(CASE WHEN a <> 'o' THEN a ELSE nullif(b, 'o') END, 1) AS kind FROM both_),
g AS (SELECT *, lag(kind) OVER (PARTITION BY sentence ORDER BY k) AS before FROM p),
l AS (SELECT sentence, k, clave, CASE WHEN kind IS NULL THEN 'o' WHEN before = kind THEN kind || 'c' ELSE kind || 'i' END AS label FROM g)
SELECT sentence, string_agg(clave, '' ORDER BY k) AS text, string_agg(label, ' ' ORDER BY k) AS labels, CAST(sum(length(clave)) FILTER (label <> 'o') AS BIGINT) AS entity FROM l GROUP BY sentence""")
def merged_sentences(spark, sf_dir):
    """Merged sentences, with their labels and how many characters have one beside o."""
    records, sentences, files = _lote(spark, sf_dir)
    rows = lotes.annotations(records, sentences, files)
    out = lotes.merged(lotes.side_by_side(rows, lotes.pairs(rows, files)))
    chars = F.size(F.filter(lotes.char_labels(F.col("tokens"), F.col("labels")), lambda x: x != "o")).cast("long")
    return out.select("sentence", "text", F.array_join("labels", " ").alias("labels"), F.nullif(chars, F.lit(0).cast("long")).alias("entity"))


@book(f"""WITH {_LOTE}, f AS (SELECT conv_id * 2 AS file, clave, a AS label FROM x UNION ALL SELECT conv_id * 2 + 1, clave, b FROM x WHERE conv_id % 7 <> 0)
SELECT file, CAST(sum(length(clave)) AS BIGINT) AS units, CAST(coalesce(sum(length(clave)) FILTER (label <> 'o'), 0) AS BIGINT) AS entity, round(100.0 * coalesce(sum(length(clave)) FILTER (label <> 'o'), 0) / sum(length(clave)), 2) AS entity_pct FROM f GROUP BY file""")
def coverage_by_file(spark, sf_dir):
    return lotes.coverage(_lote(spark, sf_dir)[0]).select("file", F.col("units").cast("long").alias("units"), F.col("entity").cast("long").alias("entity"), "entity_pct")


@book(f"WITH {_MERGED} SELECT CASE left(label, 1) WHEN 'p' THEN 'PER' WHEN 'l' THEN 'LOC' END AS type, CAST(count(*) AS BIGINT) AS n FROM m WHERE label LIKE '%i' GROUP BY 1")
def entity_counts(spark, sf_dir):
    return lotes.entity_counts(A.merged(_tags(spark, sf_dir)))


@book(f"""WITH {_MERGED}, k2 AS (SELECT m.sentence, w, label FROM m JOIN w USING (sentence, pos))
SELECT (SELECT count(DISTINCT sentence) FROM m) AS sentences, CAST(count(*) AS BIGINT) AS source_tokens, CAST(count(*) FILTER (trim(w) <> '') AS BIGINT) AS written_tokens, CAST(count(*) FILTER (trim(w) = '') AS BIGINT) AS blank_tokens, CAST(count(*) FILTER (label <> 'o') AS BIGINT) AS entity_tokens,
 CAST(count(*) FILTER (label = 'o') AS BIGINT) AS o, CAST(count(*) FILTER (label = 'pi') AS BIGINT) AS b_per, CAST(count(*) FILTER (label = 'pc') AS BIGINT) AS i_per, CAST(count(*) FILTER (label = 'li') AS BIGINT) AS b_loc, CAST(count(*) FILTER (label = 'lc') AS BIGINT) AS i_loc FROM k2""")
def conll_statistics(spark, sf_dir):
    words = table(spark, sf_dir, "conversations").where("text is not null").select((F.col("conv_id") * 1000 + F.col("turn")).alias("sentence"), F.posexplode(F.split("text", " ")).alias("pos", "w"))
    rows = A.merged(_tags(spark, sf_dir)).join(words, ["sentence", "pos"]).groupBy("sentence").agg(F.array_sort(F.collect_list(F.struct("pos", "w", "label"))).alias("u"))
    return lotes.conll_statistics(rows.select(F.transform("u", lambda x: x["w"]).alias("tokens"), F.transform("u", lambda x: x["label"]).alias("labels")))


@book(r"""WITH s AS (SELECT row_number() OVER (ORDER BY item_id) - 1 AS sentence, text FROM benchmark), n AS (SELECT count(*) AS n FROM s),
x AS (SELECT n, sentence + k * n AS s, text FROM s, n, (VALUES (0), (1)) AS v(k)), f AS (SELECT least(s // 6, greatest(2 * n // 6, 1) - 1) AS file, s, text FROM x),
j AS (SELECT file, string_agg(text, ' ' ORDER BY s) AS text FROM f GROUP BY file)
SELECT CAST(file AS BIGINT) AS file, CAST(len(regexp_extract_all(text, '\s+|[\p{L}\p{N}_\p{Mn}]+|[^\p{L}\p{N}_\p{Mn}\s]')) AS BIGINT) AS units, text FROM j""")
def annotation_templates(spark, sf_dir):
    """What each annotator is given: every passage of the benchmark stands in two files."""
    sentences = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("sentence"), "text")
    out = lotes.templates(sentences, A.double_assignment(sentences.select("sentence"), 6))
    return out.select("file", F.size("records").cast("long").alias("units"), F.array_join(F.transform("records", lambda r: r["clave"]), "").alias("text"))


_WORDS = r"w AS (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS w, unnest(range(len(string_split(text, ' ')))) AS pos FROM conversations WHERE text IS NOT NULL)"
_LOW = ", ".join(f"'{w}'" for w in ner.PLAIN)
_IS = {k: ", ".join(f"'{w}'" for w in v) for k, v in ner.KNOWN.items()}


def _worded(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "turn", F.split("text", " ").alias("words"))
    raw = F.transform("words", lambda w: F.when(w.rlike("^[A-Z]"), "B-PER").when(F.length(w) > 9, "B-LOC").when(w.endswith("e"), "I-PER").otherwise("O"))
    return rows.withColumn("labels", raw)


@book(rf"""WITH {_WORDS}, l AS (SELECT *, CASE WHEN regexp_matches(w, '^[A-Z]') THEN 'B-PER' WHEN length(w) > 9 THEN 'B-LOC' WHEN w LIKE '%e' THEN 'I-PER' ELSE 'O' END AS raw FROM w),
r AS (SELECT conv_id, turn, pos, w, CASE WHEN NOT regexp_matches(w, '[\p{{L}}\p{{N}}]') THEN 'O' WHEN lower(w) IN ({_LOW}) THEN 'O'
  WHEN lower(w) IN ({_IS['PER']}) AND (raw <> 'O' OR regexp_matches(w, '^\p{{Lu}}')) THEN 'B-PER' WHEN lower(w) IN ({_IS['LOC']}) AND (raw <> 'O' OR regexp_matches(w, '^\p{{Lu}}')) THEN 'B-LOC'
  WHEN raw LIKE 'B-PER%' AND regexp_matches(w, '^\p{{Ll}}') THEN 'O' ELSE raw END AS label FROM l),
k AS (SELECT *, CASE WHEN label <> 'O' THEN substr(label, 3) END AS type FROM r),
b AS (SELECT *, CASE WHEN type IS NOT NULL AND lag(type) OVER (PARTITION BY conv_id, turn ORDER BY pos) IS DISTINCT FROM type THEN 1 ELSE 0 END AS starts FROM k),
g AS (SELECT *, sum(starts) OVER (PARTITION BY conv_id, turn ORDER BY pos) AS no FROM b)
SELECT conv_id, turn, CAST(no - 1 AS BIGINT) AS n, type, string_agg(w, ' ' ORDER BY pos) AS text FROM g WHERE type IS NOT NULL GROUP BY conv_id, turn, no, type""")
def ner_entities(spark, sf_dir):
    """Words' labels refined, and runs of one kind as entities."""
    rows = _worded(spark, sf_dir)
    labels = F.transform(F.arrays_zip(F.col("words").alias("w"), F.col("labels").alias("l")), lambda z: ner.refined(z["w"], z["l"]))
    found = rows.withColumn("labels", labels).select("conv_id", "turn", F.posexplode(ner.grouped(F.col("words"), F.col("labels"))).alias("n", "e"))
    return found.select("conv_id", "turn", F.col("n").cast("long").alias("n"), "e.type", "e.text")


#: A vocabulary of a few merges.
_TOK = Bpe(("\n", " ", *"abcdefghijklmnopqrstuvwxyz"), (("t", "h", "\U000f0000"), ("\U000f0000", "e", "\U000f0001"), ("a", "n", "\U000f0002"), ("i", "n", "\U000f0003")))
_ENCODED = "replace(replace(replace(replace(regexp_replace({0}, '[^\\n a-z]', chr(10), 'g'), 'th', chr(983040)), chr(983040) || 'e', chr(983041)), 'an', chr(983042)), 'in', chr(983043))"


@book(rf"""WITH {_WORDS}, l AS (SELECT *, CASE WHEN regexp_matches(w, '^[A-Z]') THEN 'B-PER' WHEN length(w) > 9 THEN 'B-LOC' WHEN w LIKE '%e' THEN 'I-PER' ELSE 'O' END AS label, length({_ENCODED.format('w')}) AS n FROM w),
s AS (SELECT *, sum(n + 1) OVER (PARTITION BY conv_id, turn ORDER BY pos) - n - 1 AS start FROM l)
SELECT conv_id, turn, CAST(sum(n) + count(*) - 1 AS BIGINT) AS subtokens, CAST(count(*) FILTER (label LIKE 'B-%' AND n > 0) AS BIGINT) AS begins, CAST(sum(CASE WHEN label LIKE 'B-%' THEN greatest(n - 1, 0) WHEN label = 'I-PER' THEN n ELSE 0 END) AS BIGINT) AS insides,
 string_agg(start || '-' || (start + n), ' ' ORDER BY pos) AS spans FROM s GROUP BY conv_id, turn""")
def ner_alignment(spark, sf_dir):
    """Words and labels by subtoken, and each word's subtokens in the whole."""
    rows = _worded(spark, sf_dir)
    out = rows.select("conv_id", "turn", ner.aligned(F.col("words"), F.col("labels"), _TOK).alias("a"), ner.word_spans(F.col("words"), _TOK).alias("s"))
    count = lambda start: F.size(F.filter("a.labels", lambda x: x.startswith(start))).cast("long")
    return out.select("conv_id", "turn", F.size("a.tokens").cast("long").alias("subtokens"), count("B-").alias("begins"), count("I-").alias("insides"), F.array_join(F.transform("s", lambda x: F.concat_ws("-", x["start"], x["end"])), " ").alias("spans"))


@book(rf"""WITH {_WORDS}, q AS (SELECT conv_id, turn, w, pos, ['O', 'B-PER', 'I-LOC', 'I-PER', 'B-LOC'] AS names FROM w),
t AS (SELECT conv_id, turn, pos, unnest([names[(length(w) + i) * (pos + 2) * (i + 1) % 5 + 1] FOR i IN range(4)]) AS label, unnest(range(4)) AS i FROM q),
c AS (SELECT conv_id, turn, pos, substr(label, 3) AS kind, count(*) AS n, min(i) AS first FROM t WHERE label <> 'O' GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn, pos ORDER BY n DESC, first) AS k FROM c)
SELECT w.conv_id, w.turn, CAST(w.pos AS BIGINT) AS pos, coalesce('B-' || kind, 'O') AS label FROM w LEFT JOIN r ON r.conv_id = w.conv_id AND r.turn = w.turn AND r.pos = w.pos AND r.k = 1""")
def ner_word_labels(spark, sf_dir):
    """Four made subtoken labels for each word, and the word's own from them."""
    words = table(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "turn", F.posexplode(F.split("text", " ")).alias("pos", "w"))
    names = F.array(*map(F.lit, ["O", "B-PER", "I-LOC", "I-PER", "B-LOC"]))
    made = F.array(*[F.get(names, (F.length("w") + i) * (F.col("pos") + 2) * (i + 1) % 5) for i in range(4)])
    return words.select("conv_id", "turn", F.col("pos").cast("long").alias("pos"), ner.word_label(made).alias("label"))


@book("""WITH s AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS sentence FROM documents), n AS (SELECT count(*) AS n FROM s),
x AS (SELECT n, sentence + k * n AS s FROM s, n, (VALUES (0), (1)) AS v(k)), f AS (SELECT *, least(s // 6, greatest(2 * n // 6, 1) - 1) AS file FROM x)
SELECT CAST(file AS BIGINT) AS file, CAST(s - file * 6 AS BIGINT) AS slot, CAST(s % n AS BIGINT) AS sentence FROM f""")
def double_assignment(spark, sf_dir):
    """doc_id numbers the documents from 0 here, and so the sentences."""
    return A.double_assignment(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("sentence")), 6)
