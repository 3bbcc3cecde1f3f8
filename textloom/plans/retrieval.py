"""Retrieval queries over documents, embeddings and pages, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import corpus, search
from .base import Book, table

book = Book()
QUERY, PHRASE = "the of then with", "of the"


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("ord"), F.concat_ws(" ", "source", "lang").alias("chapter"), "text")


# What the SQL shares: normalized texts, base forms and terms.
NORM = r"trim(regexp_replace(lower(strip_accents(coalesce({0}, ''))), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
_SINGULAR = """CASE WHEN t LIKE '%ces' AND length(t) > 4 THEN left(t, length(t) - 3) || 'z'
  WHEN t LIKE '%es' AND length(t) > 4 AND substr(t, length(t) - 2, 1) NOT IN ('a','e','i','o','u') THEN left(t, length(t) - 2)
  WHEN t LIKE '%s' AND length(t) > 3 AND substr(t, length(t) - 1, 1) IN ('a','e','i','o','u') THEN left(t, length(t) - 1) ELSE t END"""
_INFINITIVE = "CASE " + " ".join(f"WHEN t LIKE '%{e}' AND length(t) >= {len(e) + 3} THEN left(t, length(t) - {len(e)}) || '{v}'" for v, es in T.VERB_ENDINGS for e in es) + " ELSE t END"
_STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)
LEMMAS = f"list_filter(list_transform(list_transform(list_filter(string_split({{0}}, ' '), lambda t: t <> ''), lambda t: {_SINGULAR}), lambda t: {_INFINITIVE}), lambda t: t <> '' AND NOT regexp_matches(t, '^\\p{{{{Nd}}}}+$'))"
TERMS = f"CASE WHEN len(list_filter({{0}}, lambda t: t NOT IN ({_STOP}))) > 0 THEN list_filter({{0}}, lambda t: t NOT IN ({_STOP})) ELSE {{0}} END"
DOCS = f"""n AS (SELECT doc_id, source, lang, text, {NORM.format("text")} AS norm FROM documents),
l AS (SELECT *, {LEMMAS.format("norm")} AS lemmas FROM n),
d AS (SELECT *, {TERMS.format("lemmas")} AS terms FROM l)"""


@book(f"SELECT doc_id, {NORM.format('text')} AS norm, CAST(len(list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda w: w <> '')) AS BIGINT) AS n_words FROM documents")
def normalize_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.normalize(F.col("text")).alias("norm"), T.word_count(F.col("text")).cast("long").alias("n_words"))


@book(r"SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(trim(text), '\s+'), lambda w: w <> '')) AS BIGINT) AS split_words, CAST(len(regexp_extract_all(text, '[\p{L}\p{N}_\p{Mn}]+')) AS BIGINT) AS run_words FROM documents")
def word_counts_two_ways(spark, sf_dir):
    x = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", T.word_count(x).cast("long").alias("split_words"), T.word_runs(x).cast("long").alias("run_words"))


@book(r"""SELECT doc_id, CAST(len(string_split(regexp_replace(text, '([.!?;:])\s+', '\1' || chr(1), 'g'), chr(1))) AS BIGINT) AS n_sentences,
  CAST(len(list_filter(list_transform(string_split(text, '.'), lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g')), lambda p: p <> '')) AS BIGINT) AS n_phrases FROM documents""")
def sentence_split_stats(spark, sf_dir):
    x = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.sentences(x)).cast("long").alias("n_sentences"), F.size(T.phrases(x)).cast("long").alias("n_phrases"))


@book(r"""SELECT doc_id, CAST(len(regexp_extract_all(text, '\s+|[\p{L}\p{N}_\p{Mn}]+|[^\p{L}\p{N}_\p{Mn}\s]')) AS BIGINT) AS n_tokens,
  array_to_string(regexp_extract_all(text, '\s+|[\p{L}\p{N}_\p{Mn}]+|[^\p{L}\p{N}_\p{Mn}\s]'), '') = text AS lossless,
  CAST(len(regexp_extract_all(text, '[\p{L}\p{N}_\p{Mn}]+|[^\p{L}\p{N}_\p{Mn}\s]')) AS BIGINT) AS n_simple FROM documents""")
def tokenize_lossless(spark, sf_dir):
    x = F.col("text")
    tokens = T.lossless_tokens(x)
    return table(spark, sf_dir, "documents").select("doc_id", F.size(tokens).cast("long").alias("n_tokens"), (F.array_join(tokens, "") == x).alias("lossless"), F.size(T.simple_tokens(x)).cast("long").alias("n_simple"))


@book(f"WITH {DOCS} SELECT t AS lemma, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT doc_id) AS BIGINT) AS docs FROM (SELECT doc_id, unnest(lemmas) AS t FROM l) GROUP BY t")
def heuristic_lemmas(spark, sf_dir):
    norm = table(spark, sf_dir, "documents").select("doc_id", T.normalize(F.col("text")).alias("norm"))
    tokens = norm.select("doc_id", F.explode(F.split("norm", " ")).alias("token")).where("token <> '' and not token rlike '^[0-9]+$'")
    rows = tokens.groupBy("doc_id", "token").agg(F.count("*").alias("c")).select("doc_id", T.lemma(F.col("token")).alias("lemma"), "c").where(~F.col("lemma").rlike(r"^\p{Nd}+$"))
    return rows.groupBy("lemma", "doc_id").agg(F.sum("c").alias("c")).groupBy("lemma").agg(F.sum("c").alias("n"), F.count("*").alias("docs"))


@book(f"WITH {DOCS} SELECT t AS term, CAST(count(*) AS BIGINT) AS df FROM (SELECT doc_id, unnest(list_distinct(terms)) AS t FROM d) GROUP BY t")
def document_frequency(spark, sf_dir):
    return search.document_frequency(search.annotate(passages(spark, sf_dir)))


def _hits(spark, sf_dir, wanted: list[str]) -> DataFrame:
    # exploding one value keeps what follows from working out the hits anew
    return search.annotate(passages(spark, sf_dir)).select("id", F.explode(F.array(search.occurrences(F.col("tokens"), wanted))).alias("hits"))


@book(f"""WITH {DOCS}, f AS (SELECT t AS term, count(*) AS df FROM (SELECT unnest(list_distinct(terms)) AS t FROM d) GROUP BY t),
q AS (SELECT unnest(['the', 'of', 'then', 'nowhere']) AS term)
SELECT term, CAST(coalesce(df, 0) AS BIGINT) AS df, round(ln(((SELECT greatest(count(*), 1) FROM d) + 1) / (coalesce(df, 0) + 1)) + 1, 6) AS idf FROM q LEFT JOIN f USING (term)""")
def idf_table(spark, sf_dir):
    terms = ["the", "of", "then", "nowhere"]
    asked = spark.createDataFrame([(t,) for t in terms], "term string")
    known = _hits(spark, sf_dir, terms).select(F.explode(F.array_distinct("hits.term")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    n = passages(spark, sf_dir).agg(F.count("*").alias("n"))
    return asked.join(known, "term", "left").crossJoin(n).select("term", F.coalesce("df", F.lit(0)).alias("df"), F.round(search.idf(F.col("df"), F.col("n")), 6).alias("idf"))


_SCORE = f"""WITH {DOCS}, q AS (SELECT unnest(['the', 'of', 'then', 'with']) AS term),
tot AS (SELECT greatest(count(*), 1) AS n FROM d),
f AS (SELECT t AS term, count(*) AS df FROM (SELECT unnest(list_distinct(terms)) AS t FROM d) GROUP BY t),
p AS (SELECT term, ln((n + 1) / (coalesce(df, 0) + 1)) + 1 AS idf, 0.25 AS qtf FROM q LEFT JOIN f USING (term), tot),
o AS (SELECT doc_id, unnest(terms) AS term, unnest(range(len(terms))) AS pos FROM d),
h AS (SELECT o.doc_id, o.term, o.pos FROM o JOIN q USING (term)),
c AS (SELECT doc_id, term, count(*) AS hits FROM h GROUP BY doc_id, term),
a AS (SELECT doc_id, sum(hits) AS hits, count(*) AS matched, sum(hits * idf * qtf) AS weight FROM c JOIN p USING (term) GROUP BY doc_id),
lst AS (SELECT h.doc_id, h.pos, q.term, max(CASE WHEN h.term = q.term THEN h.pos END) OVER (PARTITION BY h.doc_id, q.term ORDER BY h.pos) AS last FROM h, q),
sp AS (SELECT doc_id, pos, pos - min(last) + 1 AS span, count(last) AS seen FROM lst GROUP BY doc_id, pos),
cover AS (SELECT s.doc_id, min(span) AS span FROM sp s JOIN a USING (doc_id) WHERE seen = matched AND matched >= 2 GROUP BY s.doc_id),
x AS (SELECT doc_id, greatest(len(list_filter(string_split_regex(' ' || replace(norm, ' ', '  ') || ' ', ' the  of  then  with '), lambda z: true)) - 1,
  len(list_filter(range(1, len(terms) - 2), lambda i: terms[i:i + 3] = ['the', 'of', 'then', 'with']))) AS exact,
  len(terms) AS n_terms, len(string_split(norm, ' ')) AS n_words, chapter FROM (SELECT *, source || ' ' || lang AS chapter FROM d)),
s AS (SELECT doc_id, chapter, exact, coalesce(matched, 0) AS matched, coalesce(hits, 0) AS hits,
  120.0 * (coalesce(weight, 0) / greatest(n_terms, 1)) * (coalesce(matched, 0) / 4) + 12.0 * (coalesce(matched, 0) / 4)
  + CASE WHEN coalesce(matched, 0) / 4 >= 0.999 THEN 4.0 ELSE 0 END + CASE WHEN exact > 0 THEN 4.0 + 2.0 * least(exact, 6) ELSE 0 END
  + coalesce(5.0 * least(1.0, matched / span), 0) - CASE WHEN n_words > 220 THEN least(10.0, (n_words - 220) * 0.06) ELSE 0 END AS score
  FROM x LEFT JOIN a USING (doc_id) LEFT JOIN cover USING (doc_id) WHERE exact > 0 OR coalesce(hits, 0) > 0)
"""
_BEST = "SELECT doc_id AS id, round(score, 6) AS score, CAST(exact AS BIGINT) AS exact, CAST(matched AS BIGINT) AS matched, CAST(hits AS BIGINT) AS hits FROM s {0} ORDER BY score DESC, doc_id LIMIT {1}"


def _found(df: DataFrame) -> DataFrame:
    return df.select("id", F.round("score", 6).alias("score"), "exact", "matched", "hits")


@book(_SCORE + _BEST.format("", 20))
def classic_search_full(spark, sf_dir):
    return _found(search.classic(passages(spark, sf_dir), QUERY, limit=20))


@book(_SCORE + _BEST.format("WHERE contains(chapter, 'src3')", 5))
def search_filtered(spark, sf_dir):
    return _found(search.classic(passages(spark, sf_dir), QUERY, chapter="SRC3", limit=5))


@book(_SCORE + "SELECT doc_id AS id, round(weight, 6) AS weight, CAST(hits AS BIGINT) AS hits FROM a JOIN d USING (doc_id) ORDER BY a.weight DESC, doc_id LIMIT 10")
def tfidf_topk(spark, sf_dir):
    """Sums of hits times idf times the query's frequency: the ten highest."""
    _, _, wanted = search.analyze(spark, QUERY)
    each = _hits(spark, sf_dir, wanted).select("id", F.explode("hits.term").alias("term")).groupBy("id", "term").agg(F.count("*").alias("c"))
    # a row for each term of the query
    profile = each.groupBy("term").agg(F.count("*").alias("df")).crossJoin(passages(spark, sf_dir).agg(F.count("*").alias("n"))).select("term", search.idf(F.col("df"), F.col("n")).alias("idf"))
    best = each.join(F.broadcast(profile), "term").groupBy("id").agg(F.sum(F.col("c") * F.col("idf") * 0.25).alias("weight"), F.sum("c").alias("hits"))
    return best.orderBy(F.desc("weight"), "id").limit(10).select("id", F.round("weight", 6).alias("weight"), "hits")


@book(f"WITH {DOCS} SELECT doc_id AS id, CAST(len(list_filter(range(1, len(terms)), lambda i: terms[i:i + 1] = ['of', 'the'])) AS BIGINT) AS matches FROM d WHERE len(list_filter(range(1, len(terms)), lambda i: terms[i:i + 1] = ['of', 'the'])) > 0")
def exact_phrase_counts(spark, sf_dir):
    whole, lemmas, wanted = search.analyze(spark, PHRASE)
    rows = search.annotate(passages(spark, sf_dir))
    return rows.select("id", search.exact_matches(F.col("norm"), F.col("tokens"), whole, lemmas, wanted).cast("long").alias("matches")).where("matches > 0")


@book(_SCORE + "SELECT doc_id AS id, CAST(span AS BIGINT) AS span FROM cover")
def min_cover_span(spark, sf_dir):
    _, _, wanted = search.analyze(spark, QUERY)
    found = _hits(spark, sf_dir, wanted).where(F.size("hits") > 1)
    return found.select("id", search.cover_span(F.col("hits"), wanted).cast("long").alias("span")).where("span is not null")


@book(r"""WITH s AS (SELECT doc_id, text, length(text) AS n, lower(strip_accents(text)) AS bare FROM documents),
m AS (SELECT *, CASE WHEN regexp_matches(bare, '(?:^|[^\p{L}\p{N}])with(?:[^\p{L}\p{N}]|$)') THEN length(regexp_extract(bare, '(?s)^(.*?(?:^|[^\p{L}\p{N}]))with(?:[^\p{L}\p{N}]|$)', 1)) + 1 ELSE 0 END AS loc FROM s),
w AS (SELECT *, CASE WHEN loc > 0 THEN (loc - 1 + loc + 3) // 2 ELSE n // 2 END AS mid FROM m),
e AS (SELECT *, CASE WHEN n <= 340 THEN n ELSE least(n, greatest(0, mid - 170) + 340) END AS stop FROM w),
x AS (SELECT *, CASE WHEN n <= 340 THEN 0 ELSE greatest(0, stop - 340) END AS start FROM e)
SELECT doc_id, CASE WHEN start > 0 THEN '... ' ELSE '' END
  || CASE WHEN loc > 0 THEN substr(text, start + 1, loc - 1 - start) || '[' || substr(text, loc, 4) || ']' || substr(text, loc + 4, stop - loc - 3) ELSE substr(text, start + 1, stop - start) END
  || CASE WHEN stop < n THEN ' ...' ELSE '' END AS excerpt FROM x""")
def excerpt_window(spark, sf_dir):
    """Of the texts as they stand, whatever their case, accents and punctuation."""
    return table(spark, sf_dir, "documents").select("doc_id", search.excerpt(F.col("text"), "with").alias("excerpt"))


@book(f"""WITH {DOCS} SELECT doc_id AS id, CAST(length(norm) AS BIGINT) AS n, norm FROM d""")
def normalized_mapping(spark, sf_dir):
    """Character by character, with where each came from."""
    rows = search.with_mapping(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))
    return rows.select(F.col("id").cast("long").alias("id"), F.size("at").cast("long").alias("n"), "norm")


@book(r"""SELECT CAST(count(*) AS BIGINT) AS passages, round(avg(len(list_filter(regexp_split_to_array(trim(text), '\s+'), lambda w: w <> ''))), 6) AS mean_words, CAST(count(DISTINCT source) AS BIGINT) AS chapters, CAST(count(DISTINCT lang) AS BIGINT) AS parts FROM documents""")
def corpus_stats(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.agg(F.count("*").alias("passages"), F.round(F.avg(T.word_count(F.col("text"))), 6).alias("mean_words"), F.countDistinct("source").alias("chapters"), F.countDistinct("lang").alias("parts"))


@book("SELECT coalesce(nullif(source, 'src0'), 'Sin capítulo detectado') AS chapter, CAST(count(*) AS BIGINT) AS n, min(doc_id) AS first FROM documents GROUP BY 1 ORDER BY n DESC, first LIMIT 20")
def group_most_common(spark, sf_dir):
    chapter = F.coalesce(F.nullif("source", F.lit("src0")), F.lit("Sin capítulo detectado"))
    return table(spark, sf_dir, "documents").groupBy(chapter.alias("chapter")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).orderBy(F.desc("n"), "first").limit(20)


_NOISE = " OR ".join(f"contains(norm, '{m}')" for m in corpus.NOISE_MARKS)


_LINES = rf"""WITH n AS (SELECT doc_id, i, s AS text, {NORM.format("s")} AS norm FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents))
SELECT doc_id, CAST(count(*) AS BIGINT) AS blocks, CAST(count(*) FILTER (norm = '' OR {_NOISE} OR regexp_matches(norm, '^(\p{{Nd}}+|[ivxlcdm]+)$')
  OR (length(norm) - length(replace(norm, 'capitulo', ''))) / 8 >= 3 {{0}}
  OR len(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+-[\p{{L}}\p{{N}}_]')) >= 3) AS BIGINT) AS noise FROM n GROUP BY doc_id"""
_LATER = "OR (len(list_filter(string_split(norm, ' '), lambda w: w = 'de')) >= 8 AND contains(norm, 'capitulo')) OR len(list_filter(string_split(norm, ' '), lambda w: w = 'donde')) >= 4"


def _noise(spark, sf_dir, first: bool) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("text"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("blocks"), F.count_if(corpus.is_noise(F.col("text"), first=first)).alias("noise"))


@book(_LINES.replace("{0}", _LATER))
def noise_filter(spark, sf_dir):
    return _noise(spark, sf_dir, False)


@book(_LINES.replace("{0}", ""))
def noise_filter_first(spark, sf_dir):
    return _noise(spark, sf_dir, True)


@book(rf"""WITH w AS (SELECT doc_id, length({NORM.format("text")}) AS chars, len(list_filter(regexp_split_to_array(trim(text), '\s+'), lambda w: w <> '')) AS words, len(regexp_extract_all(text, '[\p{{L}}\p{{N}}_\p{{Mn}}]+')) AS runs FROM documents)
SELECT CAST(count(*) FILTER (words >= 8 AND chars >= 16) AS BIGINT) AS long_blocks, CAST(count(*) FILTER (words >= 45) AS BIGINT) AS long_passages, CAST(count(*) FILTER (runs >= 20) AS BIGINT) AS long_phrases FROM w""")
def min_length_filter(spark, sf_dir):
    x = F.col("text")
    n = table(spark, sf_dir, "documents").select(T.word_count(x).alias("words"), F.length(T.normalize(x)).alias("chars"), T.word_runs(x).alias("runs"))
    return n.agg(F.count_if((F.col("words") >= 8) & (F.col("chars") >= 16)).alias("long_blocks"), F.count_if(F.col("words") >= 45).alias("long_passages"), F.count_if(F.col("runs") >= 20).alias("long_phrases"))


@book(r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(trim(text), '\s+'), lambda w: w <> '') AS words FROM documents),
c AS (SELECT doc_id, words, unnest(range((len(words) + 89) // 90)) AS piece FROM w)
SELECT doc_id, piece, array_to_string(words[piece * 90 + 1:piece * 90 + 90], ' ') AS text FROM c""")
def fixed_word_windows(spark, sf_dir):
    return corpus.word_windows(table(spark, sf_dir, "documents").select("doc_id", "text"), 90).select("doc_id", F.col("piece").cast("long").alias("piece"), "text")


@book()
def html_blocks(spark, sf_dir):
    return corpus.html_blocks(table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "html"))


@book()
def html_marker_window(spark, sf_dir):
    return corpus.headed_blocks(corpus.html_blocks(table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "html")))


@book()
def overlap_chunks(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    return corpus.passages(docs.select("id", "pos", F.lit("p").alias("tag"), "text"))


_COS = "list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))"


@book(f"""SELECT e.vec_id AS id, round({_COS}, 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 7) q
WHERE e.embedding IS NOT NULL ORDER BY {_COS} DESC, e.vec_id LIMIT 10""")
def semantic_topk(spark, sf_dir):
    return search.semantic(_vectors(spark, sf_dir), _query_vector(spark, sf_dir), limit=10).select("id", F.round("score", 6).alias("score"))


def _vectors(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("vec_id").alias("ord"), "embedding", "label")


def _query_vector(spark, sf_dir) -> list[float]:
    return [float(x) for x in table(spark, sf_dir, "embeddings").where("vec_id = 7").first()["embedding"]]


@book("""WITH c AS (SELECT label, unnest(range(1, 65)) AS k, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings),
m AS (SELECT label, list(m ORDER BY k) AS v FROM (SELECT label, k, avg(x) AS m FROM c GROUP BY label, k) GROUP BY label)
SELECT a.label AS label_a, b.label AS label_b, round(list_cosine_similarity(a.v, b.v), 6) AS similarity FROM m a, m b WHERE a.label < b.label""")
def semantic_pairs_by_label(spark, sf_dir):
    """Cosines of the labels' mean vectors: a pair for each two labels."""
    parts = _vectors(spark, sf_dir).select("label", F.posexplode("embedding").alias("k", "x")).groupBy("label", "k").agg(F.avg(F.col("x").cast("double")).alias("m"))
    means = parts.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "m"))), lambda s: s["m"]).alias("v"))
    a, b = means.select(F.col("label").alias("label_a"), F.col("v").alias("va")), means.select(F.col("label").alias("label_b"), F.col("v").alias("vb"))
    return a.join(b, F.col("label_a") < F.col("label_b")).select("label_a", "label_b", F.round(T.cosine(F.col("va"), F.col("vb")), 6).alias("similarity"))


_FUSED = _SCORE + f""", one AS (SELECT doc_id AS id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, 0 AS list FROM s ORDER BY score DESC, doc_id LIMIT 12),
two AS (SELECT e.vec_id AS id, {_COS} AS score, row_number() OVER (ORDER BY {_COS} DESC, e.vec_id) AS rank, 1 AS list FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 7) q ORDER BY {_COS} DESC, e.vec_id LIMIT 12),
once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY list, rank) AS k FROM (SELECT * FROM one UNION ALL SELECT * FROM two)) WHERE k = 1),
f2 AS (SELECT o.id, o.list, o.rank, text, source || ' ' || lang AS chapter, o.score + {" + ".join(f"CASE WHEN contains(lower(text), '{w}') THEN 0.2 ELSE 0 END" for w in ("the", "then", "with"))}
  + CASE WHEN {" OR ".join(f"contains(lower(text), '{m}')" for m in search.DEFINING)} THEN 0.2 ELSE 0 END AS score FROM once o JOIN documents ON doc_id = o.id)
"""


def _rag(spark, sf_dir):
    docs = passages(spark, sf_dir)
    one = search.classic(docs, QUERY, limit=12)
    two = search.semantic(_vectors(spark, sf_dir), _query_vector(spark, sf_dir), limit=12)
    # a dozen rows each
    lists = [x.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "ord"))) for x in (one, two)]
    return search.fused(*lists, docs, QUERY, limit=4), docs


@book(_FUSED + "SELECT id, round(score, 6) AS score FROM f2 ORDER BY f2.score DESC, list, rank LIMIT 4")
def rag_fusion(spark, sf_dir):
    return _rag(spark, sf_dir)[0].select("id", F.round("score", 6).alias("score"))


@book(_FUSED + """SELECT string_agg('REFERENCIA: ' || chapter || ' [' || id || ']' || chr(10) || 'TEXTO: ' || text, chr(10) || chr(10) ORDER BY score DESC, list, rank) AS context FROM (SELECT * FROM f2 ORDER BY f2.score DESC, list, rank LIMIT 4)""")
def rag_prompt(spark, sf_dir):
    best, docs = _rag(spark, sf_dir)
    ranked = best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "list", "rank"))).select("id", "rank")  # four rows
    return search.context(docs.join(F.broadcast(ranked), "id"))


@book(r"""WITH f AS (SELECT b.item_id, d.doc_id, b.text AS passage, d.text, string_split(d.text, b.text) AS parts FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
a AS (SELECT item_id, doc_id, length(passage) AS n, unnest(range(1, len(parts))) AS k, parts, passage FROM f),
x AS (SELECT item_id, doc_id, n, list_sum(list_transform(parts[1:k], lambda x: length(x))) + (k - 1) * n + 1 AS at FROM a),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS no FROM documents),
p AS (SELECT doc_id, no, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY no) - length(line) - 1 AS start, length(line) AS size FROM l)
SELECT x.item_id, x.doc_id, p.no AS line_no, CAST(x.at AS BIGINT) AS at FROM x JOIN p ON p.doc_id = x.doc_id AND p.start < x.at - 1 + x.n AND p.start + p.size > x.at - 1""")
def offset_range_join(spark, sf_dir):
    """Benchmark passages in documents, at every place, with the lines whose characters they overlap."""
    asked = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("passage"))
    return corpus.overlapping_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), asked)
