"""Ranked retrieval of passages.

A passage is a row (id, ord, chapter, text). The index is three tables: passages with their tokens, postings in buckets
by term, and document frequencies. A query is a handful of terms; the tokens that have these as base forms are
known beforehand, so that a text is searched without making the base forms of all it has, and what is
shuffled grows with the hits and not with the corpus.
"""

from __future__ import annotations

import math
import unicodedata
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

from ..functions import text as T
from ..session import stored


def analyze(spark: SparkSession, query: str) -> tuple[str, list[str], list[str]]:
    """A query's normalized text, its base forms, and the terms that count."""
    row = spark.range(1).select(T.normalize(F.lit(query)).alias("q"), T.lemmas(F.lit(query)).alias("l")).select("q", "l", T.content(F.col("l")).alias("t")).first()
    if not row["q"]:
        raise ValueError("the query is empty when normalized")
    if not row["t"]:
        raise ValueError("the query needs at least one useful term")
    return row["q"], row["l"], row["t"]


def annotate(passages: DataFrame, analyzer: Callable[[Column], Column] | None = None) -> DataFrame:
    """Adds norm and tokens: the tokens that count, as they stand. An analyzer, such as a pandas UDF of another library, makes the tokens of
    the text; the rules then are applied to what it gives."""
    rows = passages.withColumn("norm", T.normalize(F.col("text")))
    return rows.withColumn("tokens", analyzer(F.col("text")) if analyzer else T.useful_tokens(F.col("norm")))


#: Characters of a normalized text that are embedded (fixed value), and the size of the embedder that is built in.
EMBEDDED, WIDTH = 3000, 64


def hashed(texts: list[str]) -> list[list[float] | None]:
    """An embedder without a model: each word and pair of words adds to or takes from a place that its hash gives; of length 1."""
    out: list[list[float] | None] = []
    for text in texts:
        w = text.split()
        x = np.zeros(WIDTH)
        for t in w + [f"{a} {b}" for a, b in zip(w, w[1:])]:
            h = zlib.crc32(t.encode())
            x[h % WIDTH] += 1 if h >> 16 & 1 else -1
        n = np.sqrt((x * x).sum())
        out.append((x / n).tolist() if n else None)
    return out


def embedded(annotated: DataFrame, embedder: Callable[[list[str]], list] = hashed) -> DataFrame:
    """Adds embedding, of the first EMBEDDED characters of norm. Texts that the embedder fails on, by themselves too, have null."""
    at = annotated.columns.index("norm")

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def one(text: str):
            try:
                return embedder([text])[0]
            except Exception:  # noqa: BLE001  what a service says no to has no embedding
                return None

        for batch in batches:
            texts = [(t or "")[:EMBEDDED].strip() for t in batch.column(at).to_pylist()]
            try:
                found = embedder(texts)
            except Exception:  # noqa: BLE001
                found = [one(t) for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.float32()))], names=[*batch.schema.names, "embedding"])

    return annotated.mapInArrow(work, StructType([*annotated.schema.fields, StructField("embedding", ArrayType(FloatType()))]))


def postings(annotated: DataFrame) -> DataFrame:
    """(term, id, pos) of every term: the index to write in buckets by term."""
    return annotated.select("id", F.posexplode("tokens").alias("pos", "token")).select(T.lemma(F.col("token")).alias("term"), "id", "pos")


def document_frequency(annotated: DataFrame) -> DataFrame:
    """(term, df). Base forms are made of exploded tokens, in generated code."""
    each = annotated.select("id", F.explode(F.array_distinct("tokens")).alias("token")).select("id", T.lemma(F.col("token")).alias("term"))
    return each.distinct().groupBy("term").agg(F.count("*").alias("df"))


#: Parts of the postings by hash of the term.
BUCKETS = 64


def bucket(term: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def idf(df: Column, n: Column) -> Column:
    return F.log((F.greatest(n, F.lit(1)) + 1) / (F.coalesce(df, F.lit(0)) + 1)) + 1.0


def _any_of(term: str) -> str:
    return "(?:" + "|".join(rf"\Q{t}\E" for t in T.tokens_of(term)) + ")"


def windows_equal(tokens: Column, wanted: list[str]) -> Column:
    """How often tokens of the base forms wanted stand in a row, overlaps included."""
    # tokens hold no spaces, and matches of no width may overlap
    row = F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" "))
    return F.regexp_count(row, F.lit(f"(?= {' '.join(map(_any_of, wanted))} )"))


def exact_matches(norm: Column, tokens: Column, query: str, lemmas: list[str], wanted: list[str]) -> Column:
    """The most of: the whole query in the text by word bounds, its base forms in a row, its terms in a row."""
    whole = F.regexp_count(norm, F.lit(rf"(?U)(?<!\w)\Q{query}\E(?!\w)"))
    rows = [windows_equal(tokens, w) for w in ([lemmas] if lemmas == wanted else [lemmas, wanted])]
    return F.greatest(whole, *rows)


def occurrences(tokens: Column, wanted: list[str]) -> Column:
    """An array of struct(pos, term) where the query's terms stand, in order."""
    terms = list(dict.fromkeys(wanted))
    forms = {t: T.tokens_of(t) for t in terms}
    every = [f for own in forms.values() for f in own]
    # places and tokens by themselves, so that tokens that are no hit make no struct
    places = F.filter(F.transform(tokens, lambda t, i: F.when(t.isin(*every), i)), lambda i: i.isNotNull())
    hits = F.filter(tokens, lambda t: t.isin(*every))

    def term(token: Column) -> Column:
        out = F.lit(terms[-1])
        for t in terms[:-1]:
            out = F.when(token.isin(*forms[t]), t).otherwise(out)
        return out

    return F.zip_with(places, hits, lambda i, t: F.struct(i.alias("pos"), term(t).alias("term")))


def _is(term: str) -> Callable:
    return lambda s: s["term"] == term


def cover_span(hits: Column, wanted: list[str]) -> Column:
    """The fewest places that hold all the query's terms that the passage has; null if these are fewer than two.

    One pass over the occurrences keeps the latest place of each term; the earliest of these
    bounds the shortest span that ends at an occurrence.
    """
    terms = list(dict.fromkeys(wanted))
    none = F.lit(None).cast("int")
    has = [F.exists(hits, _is(t)) for t in terms]
    start = F.struct(*[none.alias(f"last{k}") for k in range(len(terms))], none.alias("best"))

    def move(state: Column, s: Column) -> Column:
        last = [F.when(s["term"] == t, s["pos"]).otherwise(state[f"last{k}"]) for k, t in enumerate(terms)]
        seen = sum((x.isNotNull().cast("int") for x in last), F.lit(0))
        span = s["pos"] - (F.least(*last) if len(last) > 1 else last[0]) + 1
        # a span counts once as many terms were met as by then; a later, fuller one begins anew
        fuller = seen > sum((state[f"last{k}"].isNotNull().cast("int") for k in range(len(terms))), F.lit(0))
        best = F.when(fuller | state["best"].isNull(), span).otherwise(F.least(state["best"], span))
        return F.struct(*[x.alias(f"last{k}") for k, x in enumerate(last)], best.alias("best"))

    matched = sum((h.cast("int") for h in has), F.lit(0))
    return F.when(matched >= 2, F.aggregate(hits, start, move, lambda s: s["best"]))


def _probed(rows: DataFrame, query: tuple[str, list[str], list[str]]) -> DataFrame:
    """(id, ord, chapter, hits, exact, n_terms, n_words) of the annotated passages where the query's terms or the query itself stand."""
    whole, lemmas, wanted = query
    # exploding one value keeps the filter from working out the hits anew
    found = rows.select("id", "ord", "chapter", "norm", "tokens", F.explode(F.array(occurrences(F.col("tokens"), wanted))).alias("hits")).select("id", "ord", "chapter", "hits", exact_matches(F.col("norm"), F.col("tokens"), whole, lemmas, wanted).alias("exact"), F.size("tokens").alias("n_terms"), F.size(F.split("norm", " ")).alias("n_words"))
    return found.where((F.size("hits") > 0) | (F.col("exact") > 0))


def in_chapter(passages: DataFrame, chapter: str | None) -> DataFrame:
    """Passages whose chapter holds the text, both normalized; all without one."""
    return passages.where(T.normalize(F.coalesce("chapter", F.lit(""))).contains(F.trim(T.normalize(F.lit(chapter))))) if chapter else passages


def frequencies(probed: DataFrame, wanted: list[str]) -> dict[str, int]:
    """In how many passages each of the query's terms stands: a row of a few numbers."""
    terms = list(dict.fromkeys(wanted))
    row = probed.agg(*[F.count_if(F.exists("hits", _is(t))).alias(f"c{k}") for k, t in enumerate(terms)]).first()
    return {t: row[f"c{k}"] for k, t in enumerate(terms)}


def _ranked(probed: DataFrame, wanted: list[str], known: dict[str, int], total: int, limit: int | None, chapter: str | None) -> DataFrame:
    counts = Counter(wanted)
    probed = in_chapter(probed, chapter)
    each = {t: F.size(F.filter("hits", _is(t))) for t in counts}
    weight = sum((each[t] * F.lit(math.log((max(total, 1) + 1) / (known.get(t, 0) + 1)) + 1.0) * F.lit(c / len(wanted)) for t, c in counts.items()), F.lit(0.0))
    matched = sum(((each[t] > 0).cast("long") for t in counts), F.lit(0).cast("long"))
    rows = probed.select("id", "ord", "exact", "n_terms", "n_words", F.size("hits").cast("long").alias("hits"), matched.alias("matched"), weight.alias("weight"), cover_span(F.col("hits"), wanted).alias("span"))
    cov = F.col("matched") / len(counts)
    score = 120.0 * (F.col("weight") / F.greatest(F.col("n_terms"), F.lit(1))) * cov + 12.0 * cov
    score += F.when((F.lit(len(counts)) > 1) & (cov >= 0.999), 4.0).otherwise(0.0)
    score += F.when(F.col("exact") > 0, 4.0 + 2.0 * F.least(F.col("exact"), F.lit(6))).otherwise(0.0)
    score += F.coalesce(5.0 * F.least(F.lit(1.0), F.col("matched") / F.col("span")), F.lit(0.0))
    score -= F.when(F.col("n_words") > 220, F.least(F.lit(10.0), (F.col("n_words") - 220) * 0.06)).otherwise(0.0)
    out = rows.select("id", "ord", score.alias("score"), F.col("exact").cast("long").alias("exact"), "matched", "hits")
    return out if limit is None else out.orderBy(F.desc("score"), "ord").limit(limit)


def classic(passages: DataFrame, query: str, *, limit: int | None = 5, chapter: str | None = None) -> DataFrame:
    """id, ord, score, exact, matched, hits of the best passages, best first, ties by ord.

    Frequencies are of the whole index even when a chapter narrows the passages. The texts are read once: what the
    query meets there is stored, and all else is worked out of that.
    """
    asked = analyze(passages.sparkSession, query)
    probed = stored(_probed(annotate(passages), asked), "probed")
    return _ranked(probed, asked[2], frequencies(probed, asked[2]), passages.count(), limit, chapter)


def indexed(passages: DataFrame, post: DataFrame, df: DataFrame, query: str, *, buckets: int = BUCKETS, limit: int | None = 5, chapter: str | None = None) -> DataFrame:
    """classic() over an index: the postings of the query's terms alone are read, by bucket, and of the passages those that they name.

    A query of stopwords alone stands in passages whose postings don't have it, so that one reads the passages.
    """
    spark = passages.sparkSession
    asked = whole, lemmas, wanted = analyze(spark, query)
    if set(wanted) <= set(T.STOPWORDS):
        probed = stored(_probed(passages, asked), "probed")
    else:
        numbers = [r[0] for r in spark.createDataFrame([(t,) for t in set(wanted)], "term string").select(bucket(F.col("term"), buckets)).collect()]
        own = post.where(F.col("bucket").isin(*set(numbers)) & F.col("term").isin(*set(wanted)))
        hits = own.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "term"))).alias("hits"))  # of one passage
        rows = passages.join(hits, "id")
        exact = exact_matches(F.col("norm"), F.col("tokens"), whole, lemmas, wanted)
        probed = stored(rows.select("id", "ord", "chapter", "hits", exact.alias("exact"), F.size("tokens").alias("n_terms"), F.size(F.split("norm", " ")).alias("n_words")), "probed")
    known = {r["term"]: r["df"] for r in df.where(F.col("term").isin(*set(wanted))).select("term", "df").collect()}  # of the query's terms
    return _ranked(probed, wanted, known, passages.count(), limit, chapter)


def semantic(vectors: DataFrame, query: list[float], *, limit: int | None = 5) -> DataFrame:
    """id, ord, score: cosine to the query's vector, best first, ties by ord; rows without a vector play no part."""
    rows = vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0))
    out = rows.select("id", "ord", T.cosine(F.col("embedding"), F.array(*map(F.lit, query))).alias("score"))
    return out if limit is None else out.orderBy(F.desc("score"), "ord").limit(limit)


#: Marks of a defining passage (fixed values).
DEFINING = ["es ", "era ", "fue ", "dama", "escudero", "amada", "senora", "senor", "hidalgo", "caballero", "toboso", "dulcinea", "sancho panza"]


#: Rows of ranked lists that may be broadcast.
SENT = 10_000


def fused(first: DataFrame, second: DataFrame, passages: DataFrame, query: str, *, limit: int = 4) -> DataFrame:
    """Two ranked lists (id, score, rank) as one: the first's rows win, then passages that name the query's
    words or define something rise; best first, ties in order of the lists. Lists of up to SENT rows are sent to the passages."""
    both = first.select("id", "score", F.lit(0).alias("list"), "rank").union(second.select("id", "score", F.lit(1).alias("list"), "rank"))
    once = both.withColumn("k", F.row_number().over(Window.partitionBy("id").orderBy("list", "rank"))).where("k = 1")
    few = len(once.take(SENT + 1)) <= SENT
    rows = passages.join(F.broadcast(once) if few else once, "id")
    low, chapter = F.lower("text"), F.lower(F.coalesce("chapter", F.lit("")))
    score = F.col("score")
    for w in [w for w in query.lower().split() if len(w) > 2]:
        score += F.when(low.contains(w), 0.2).otherwise(0.0)
    score += F.when(F.exists(F.array(*map(F.lit, DEFINING)), lambda m: low.contains(m)), 0.2).otherwise(0.0)
    score -= F.when(chapter.contains("prologo"), 0.1).otherwise(0.0)
    return rows.select("id", score.alias("score"), "list", "rank").orderBy(F.desc("score"), "list", "rank").limit(limit)


def reference(chapter: Column, id_: Column) -> Column:
    c = F.trim(F.coalesce(chapter, F.lit("")))
    mark = F.concat(F.lit(" ["), id_, F.lit("]"))
    return F.when(c != "", F.concat(T.shorten(c, 90, 87), mark)).otherwise(F.concat(F.lit("Pasaje"), mark))


def context(ranked: DataFrame) -> DataFrame:
    """One row: the references and texts of ranked rows (id, chapter, text, rank), for a generator's prompt."""
    part = F.concat(F.lit("REFERENCIA: "), reference(F.col("chapter"), F.col("id").cast("string")), F.lit("\nTEXTO: "), F.col("text"))
    rows = ranked.select("rank", part.alias("part"))
    return rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "part"))), lambda s: s["part"]), "\n\n").alias("context"))


#: What is said when nothing fits, and before what failed (fixed values).
NOTHING, FAILED = "No he encontrado informacion suficiente en el Quijote para responder a eso.", "Error de conexion con Ollama: Verifica que esta abierto y el modelo descargado. Detalle: "
#: A generator's instructions (fixed values).
PROMPT = """
Eres un asistente experto en "El ingenioso hidalgo don Quijote de la Mancha".

Tu tarea es responder usando UNICAMENTE la informacion contenida en los pasajes proporcionados.

Reglas:
- No inventes datos.
- No uses conocimiento externo.
- Si la respuesta no aparece con claridad en los pasajes, di exactamente:
  "No he encontrado informacion suficiente en los pasajes recuperados."
- Responde de forma breve, clara y directa.
- Si la pregunta es del tipo "quien es..." o "que relacion tiene...",
  empieza con una definicion corta y luego añade una o dos frases de apoyo.
- No incluyas referencias, listas, identificadores ni citas al final.
- Devuelve solo la respuesta redactada en texto corrido.

PASAJES DE REFERENCIA:
{context}

PREGUNTA DEL USUARIO:
{query}

RESPUESTA:
"""


def rag(passages: DataFrame, query: str, *, limit: int = 4, chapter: str | None = None, embedder: Callable[[list[str]], list] = hashed) -> DataFrame:
    """id, score, list, rank of the passages (with norm, tokens and embedding) that an answer may draw on: both searches' best, fused."""
    asked = embedder([analyze(passages.sparkSession, query)[0]])[0]
    most = max(3 * limit, 8)
    lists = [classic(passages, query, limit=most, chapter=chapter), semantic(in_chapter(passages, chapter), asked or [0.0], limit=most)]
    ranked = [x.select("id", "score", F.row_number().over(Window.orderBy(F.desc("score"), "ord")).alias("rank")) for x in lists]  # `most` rows
    return fused(*ranked, passages, query, limit=limit)


def answered(passages: DataFrame, query: str, generator: Callable[[str], str], *, limit: int = 4, chapter: str | None = None, embedder: Callable[[list[str]], list] = hashed) -> str:
    """A generator's answer from the passages found, with their references."""
    best = rag(passages, query, limit=limit, chapter=chapter, embedder=embedder)
    rows = best.join(passages.select("id", "chapter", "text"), "id").withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "list", "rank")))  # `limit` rows
    found = stored(rows.select("id", "chapter", "text", "rank"), "found")
    names = [r["r"] for r in found.orderBy("rank").select(reference(F.col("chapter"), F.col("id").cast("string")).alias("r")).collect()]
    if not names:
        return NOTHING
    try:
        answer = generator(PROMPT.format(context=context(found).first()["context"], query=query)).strip()
    except Exception as e:  # noqa: BLE001  whatever the generator fails with is the answer
        return f"{FAILED}{e}"
    return answer + "\n\nReferencias:\n" + "\n".join(f"- {n}" for n in names)


def query_span(text: Column, query: str) -> tuple[Column, Column]:
    """Start (from 1, 0 if none) and length, in the text as it stands, of the normalized query, else of its first word that occurs."""
    at, size = F.lit(0), F.lit(0)
    for t in reversed(list(dict.fromkeys([query, *query.split()]))):
        pattern = rf"(?<![\p{{L}}\p{{N}}])(?<![\p{{L}}\p{{N}}]\p{{Mn}}{{1,4}}){T.spelled(t)}(?!\p{{Mn}}*[\p{{L}}\p{{N}}])"
        found = F.regexp_instr(text, F.lit(pattern))
        at, size = F.when(found > 0, found).otherwise(at), F.when(found > 0, F.length(F.regexp_substr(text, F.lit(pattern)))).otherwise(size)
    return at, size


def excerpt(text: Column, query: str, most: int = 340) -> Column:
    """A window of the text around the match of the normalized query, which stands in brackets; dots where text was left out."""
    both = F.transform(F.array(F.struct(*(c.alias(n) for c, n in zip(query_span(text, query), ("at", "size"))))), lambda m: _window(text, m["at"], m["size"], most))
    return F.get(both, F.lit(0))


def _window(text: Column, at: Column, size: Column, most: int) -> Column:
    n = F.length(text)
    middle = F.when(at > 0, F.floor((at - 1 + at - 1 + size) / 2)).otherwise(F.floor(n / 2))
    end = F.when(n <= most, n).otherwise(F.least(n, F.greatest(F.lit(0), middle - most // 2) + most)).cast("int")
    start = F.when(n <= most, 0).otherwise(F.greatest(F.lit(0), end - most)).cast("int")
    a, b = F.greatest(at - 1, start), F.least(at - 1 + size, end)
    marked = F.concat(F.substring(text, start + 1, a - start), F.lit("["), F.substring(text, a + 1, b - a), F.lit("]"), F.substring(text, b + 1, end - b))
    body = F.when((at > 0) & (a < b), marked).otherwise(F.substring(text, start + 1, end - start))
    return F.concat(F.when(start > 0, "... ").otherwise(""), body, F.when(end < n, " ...").otherwise(""))


def marked_parts(excerpt: Column) -> Column:
    """An excerpt as an array of struct(text, marked): what stands in brackets and what doesn't."""
    pieces = F.regexp_extract_all(excerpt, F.lit(r"(\[[^\]]+\]|(?:(?!\[[^\]]+\])(?s:.))+)"), F.lit(1))
    inside = lambda p: p.rlike(r"^\[[^\]]+\]$")
    return F.transform(pieces, lambda p: F.struct(F.when(inside(p), F.substring(p, F.lit(2), F.length(p) - 2)).otherwise(p).alias("text"), inside(p).alias("marked")))


def with_mapping(texts: DataFrame) -> DataFrame:
    """(id, text) -> (id, norm, at): the text normalized character by character, and from which character (from 0) each
    character of it came."""

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            norms, places = [], []
            for text in batch.column(1).to_pylist():
                norm, at = [], []
                for i, c in enumerate(text or ""):
                    for d in unicodedata.normalize("NFD", c.lower()):
                        if d.isalnum():
                            norm.append(d)
                            at.append(i)
                        elif unicodedata.category(d) != "Mn" and norm and norm[-1] != " ":
                            norm.append(" ")
                            at.append(i)
                if norm and norm[-1] == " ":
                    norm.pop(), at.pop()
                norms.append("".join(norm))
                places.append(at)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(norms, pa.string()), pa.array(places, pa.list_(pa.int32()))], names=["id", "norm", "at"])

    return texts.selectExpr("cast(id as string) id", "cast(text as string) text").mapInArrow(work, "id string, norm string, at array<int>")
