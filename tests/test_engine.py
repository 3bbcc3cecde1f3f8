"""The engine's own operators on small cases."""

import json
import random
import re
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import annotation as A
from textloom.operators import bpe, codec, corpus, lm, lotes, ner, report, search, trade, training
from textloom.sources import butler, files, sinks
from textloom.streaming import agent


def passages(spark, *texts, chapters=None):
    return spark.createDataFrame([(f"P{i}", i, (chapters or {}).get(i), t) for i, t in enumerate(texts)], "id string, ord long, chapter string, text string")


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_normalize(spark):
    assert one(spark, T.normalize(F.lit("  DULCINEA,   del   Toboso!!! "))) == "dulcinea del toboso"
    assert one(spark, T.normalize(F.lit("Ñandú_é2"))) == "nandu e2"
    assert one(spark, T.normalize(F.lit(None).cast("string"))) == ""


@pytest.mark.parametrize(("word", "base"), [("molinos", "molino"), ("luces", "luz"), ("cantaba", "cantar"), ("cantando", "cantar"), ("comiendo", "comer"), ("flores", "flor"), ("mes", "mes"), ("cada", "cada")])
def test_lemma(spark, word, base):
    assert one(spark, T.lemma(F.lit(word))) == base


def test_tokens_are_lossless(spark):
    text = "Hola,  ¿qué\ttal? 3-2\n"
    assert "".join(one(spark, T.lossless_tokens(F.lit(text)))) == text
    assert one(spark, T.phrases(F.lit("Uno. Dos..  tres "))) == ["Uno", "Dos", "tres"]


def test_search_finds_forms_and_ignores_stopwords(spark):
    rows = passages(spark, "un molino alto", "dos molinos", "remolino fuerte", "el de la que")
    assert {r["id"] for r in search.classic(rows, "molino").collect()} == {"P0", "P1"} == {r["id"] for r in search.classic(rows, "molinos").collect()}
    with pytest.raises(ValueError, match="empty"):
        search.classic(rows, "...")


def test_search_prefers_coverage_and_keeps_to_a_chapter(spark):
    rows = passages(spark, "Insula y viento fuerte", "Insula Insula Insula Insula", chapters={0: "Capitulo XIII", 1: "Capitulo XXV"})
    assert search.classic(rows, "insula viento").first()["id"] == "P0"
    assert [r["id"] for r in search.classic(rows, "insula", chapter="xxv").collect()] == ["P1"]


def test_cover_spans_match_brute_force(spark):
    rng = random.Random(1)
    docs = [" ".join(rng.choice("abcx") * 3 for _ in range(rng.randint(1, 12))) for _ in range(80)]
    rows = search.annotate(passages(spark, *docs))
    for wanted in (["aaa", "bbb", "ccc"], ["aaa", "bbb"], ["ccc"]):
        got = {r["id"]: r["span"] for r in rows.select("id", search.cover_span(search.occurrences(F.col("tokens"), wanted), wanted).alias("span")).collect()}
        for i, d in enumerate(docs):
            w = d.split()
            here = set(w) & set(wanted)
            best = min((j - i0 + 1 for i0 in range(len(w)) for j in range(i0, len(w)) if here <= set(w[i0 : j + 1])), default=None) if len(here) > 1 else None
            assert got[f"P{i}"] == best


def test_tokens_of_a_base_form_are_all_of_them(spark):
    rng = random.Random(7)
    ends = ["", "s", "es", "ces", *[e for _, es in T.VERB_ENDINGS for e in es], "ar", "er", "z"]
    words = sorted({"".join(rng.choice("abcelnorz") for _ in range(rng.randint(1, 5))) + rng.choice(ends) + rng.choice(["", "s", "es"]) for _ in range(4000)} | set(T.STOPWORDS))
    got = {r["w"]: r["l"] for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", T.lemma(F.col("w")).alias("l")).collect()}
    for w in words:
        assert got[w] == T.lemma_of(w) and w in T.tokens_of(got[w])
        assert all(T.lemma_of(t) == got[w] for t in T.tokens_of(got[w]))


def test_useful_tokens_are_those_of_the_content(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["de", "del", "la", "las", "los", "12", "3x", "casas", "unos", "cantando", "y", "voces"]) for _ in range(rng.randint(0, 6))) for _ in range(200)]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select(F.transform(T.useful_tokens(T.normalize(F.col("text"))), T.lemma).alias("a"), T.content(T.lemmas(F.col("text"))).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in rows)


def test_excerpt_marks_the_match(spark):
    text = "x " * 300 + "Dulcinea  del Tóboso" + " y" * 300
    found = one(spark, search.excerpt(F.lit(text), "dulcinea del toboso"))
    assert "[Dulcinea  del Tóboso]" in found and found.startswith("... ") and found.endswith(" ...") and len(found) == 340 + 2 + 8
    assert one(spark, search.excerpt(F.lit("En un lugar de la Mancha"), "rocinante")) == "En un lugar de la Mancha"
    assert one(spark, search.excerpt(F.lit("La sin par Dulcinea del Toboso, dijo"), "dulcinea del toboso")) == "La sin par [Dulcinea del Toboso], dijo"
    assert one(spark, search.excerpt(F.lit("El Toboso."), "dulcinea del toboso")) == "El [Toboso]."  # a word of the query
    assert one(spark, search.excerpt(F.lit("¡DULCINÉA!-del ... toboso"), "dulcinea del toboso")) == "¡[DULCINÉA!-del ... toboso]"
    assert one(spark, search.excerpt(F.lit("Dulcineas"), "dulcinea")) == "Dulcineas"
    assert one(spark, search.excerpt(F.lit("dulcine\u0301a"), "dulcinea")) == "[dulcine\u0301a]"
    parts = one(spark, search.marked_parts(F.lit("a [b c] d [e]")))
    assert [(p["text"], p["marked"]) for p in parts] == [("a ", False), ("b c", True), (" d ", False), ("e", True)]


def test_spans_match_a_search_in_the_mapped_text(spark):
    """Against a character-by-character mapping and Python's own search."""
    rng = random.Random(4)
    bits = ["dulcinea", "Dulcinéa", "DEL", "del", "toboso", " ", "  ", ", ", "-", "x", "Ñu", "\u0301", "_", "3"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 9))) for _ in range(400)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    mapped = {int(r["id"]): (r["norm"], r["at"]) for r in search.with_mapping(rows).collect()}
    for query in ("dulcinea del toboso", "del", "nu x"):
        at, size = search.query_span(F.col("text"), query)
        for r in rows.select("id", "text", at.alias("at"), size.alias("size")).collect():
            norm, places = mapped[r["id"]]
            hit = next((m for q in [query, *query.split()] if (m := re.search(rf"(?<!\w){re.escape(q)}(?!\w)", norm))), None)
            want = (places[hit.start()] + 1, places[hit.end() - 1] + 1) if hit else (0, 0)
            assert (r["at"], r["at"] + r["size"] - 1 if r["at"] else 0) == want, r["text"]


def test_search_over_the_index_is_the_search_of_the_texts(spark, tmp_path):
    rng = random.Random(3)
    bits = ["molino", "molinos", "de", "viento", "el", "cantaba", "cantar", "Sancho", "la", "vientos", "12"]
    rows = passages(spark, *[" ".join(rng.choice(bits) for _ in range(rng.randint(1, 40))) for _ in range(60)], chapters={i: f"Capitulo {i % 3}" for i in range(60)}).withColumn("part", F.lit(None).cast("string"))
    sinks.save_index(rows, str(tmp_path / "i"), "v")
    kept, post, df = sinks.load_index(spark, str(tmp_path / "i"))
    for query in ("molino de viento", "cantar", "el de la", "nada", "sancho sancho viento"):
        for chapter in (None, "capitulo 1"):
            a = [tuple(r) for r in search.classic(rows, query, limit=None, chapter=chapter).orderBy("ord").collect()]
            b = [tuple(r) for r in search.indexed(kept, post, df, query, limit=None, chapter=chapter).orderBy("ord").collect()]
            assert [(x[0], round(x[2], 9), *x[3:]) for x in a] == [(x[0], round(x[2], 9), *x[3:]) for x in b]
    own = post.where(F.col("bucket").isin(*{r[0] for r in spark.createDataFrame([("molino",)], "t string").select(search.bucket(F.col("t"))).collect()}))
    plan = own._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1][:80]
    assert sinks.is_current(spark, str(tmp_path / "i"), "v", embedded=True)
    with pytest.raises(ValueError, match="no part of an index"):
        df.write.parquet(str(tmp_path / "j/passages"))
        sinks.load_index(spark, str(tmp_path / "j"))


def test_answers_draw_on_both_searches(spark):
    rows = search.embedded(search.annotate(passages(spark, "Dulcinea era la dama de don Quijote", "Sancho comia pan", "El molino y el viento")))
    asked = []
    said = search.answered(rows, "dulcinea", lambda prompt: asked.append(prompt) or " Una dama. ")
    assert said.startswith("Una dama.\n\nReferencias:\n- Pasaje [P0]") and "TEXTO: Dulcinea era" in asked[0] and "dulcinea\n" in asked[0]
    assert search.answered(rows, "dulcinea", lambda prompt: 1 / 0).startswith(search.FAILED)
    failing = search.embedded(search.annotate(passages(spark, "uno", "dos")), lambda texts: [[1.0]] if texts == ["uno"] else 1 / 0)
    assert [r["embedding"] for r in failing.orderBy("ord").collect()] == [[1.0], None]


def test_passages_overlap_and_keep_to_the_book(spark):
    paragraphs = "".join(f"<p>{'frase compartida ' if i == 4 else ''}{' '.join([f'palabra{i}'] * 30)}</p>" for i in range(1, 7))
    page = f"<div>{corpus.START} X ***</div><h3>Capitulo XV</h3>{paragraphs}<div>{corpus.END} X ***</div><p>Project Gutenberg footer text that is long enough to be a block</p>"
    blocks = corpus.html_blocks(spark.createDataFrame([(1, page)], "id long, html string"))
    found = corpus.passages(blocks, least=20).collect()
    assert len(found) >= 2 and sum("frase compartida" in r["text"] for r in found) >= 2
    assert all("footer" not in r["text"] and r["chapter"] == "Capitulo XV" for r in found)


def test_split_unit_and_chunk():
    assert corpus.split_unit("a b") == ["a b"]
    assert [len(u.split()) for u in corpus.split_unit("w " * 200)] == [90, 90, 20]
    assert corpus.chunk([], 1) == [] and corpus.chunk(["a " * 30] * 6, 20)[0].split() == ["a"] * 120


def test_overlap_chunks_match_a_model(spark):
    """Passages of a text, against the rules stated over lists."""
    rng = random.Random(6)

    def model(units, least):
        out, start = [], 0
        while start < len(units):
            end = start + 1
            while end < len(units) and sum(len(u) for u in units[start:end]) < 120:
                end += 1
            words = [w for u in units[start:end] for w in u]
            out += [" ".join(p) for p in (words[i : i + 140] for i in range(0, len(words), 140)) if len(p) >= least]
            if end == len(units):
                return out
            back = end
            while back > start and sum(len(u) for u in units[back:end]) < 35:
                back -= 1
            start = max(back, start + 1)
        return out

    for _ in range(200):
        units = [[f"w{rng.randint(0, 9)}" for _ in range(rng.randint(1, rng.choice([10, 60, 200])))] for _ in range(rng.randint(0, 12))]
        assert corpus.chunk([" ".join(u) for u in units], 20) == model(units, 20)


def test_blocks_between_marks_match_a_loop(spark):
    """Which blocks stay, and under which headings, against a loop over them."""
    rng = random.Random(8)
    texts = ["Primera parte", "SEGUNDA PARTE del libro", "Capitulo I", "CAPITULO II de algo", "Prólogo", "una frase cualquiera", "otra frase mas larga", "xiv", "1605", corpus.START + " X", corpus.END + " X", "produced by nobody"]
    pages = [[(rng.choice(["h2", "h3", "p", "div"]), rng.choice(texts)) for _ in range(rng.randint(0, 14))] for _ in range(150)]
    rows = [(i, pos, tag, text) for i, page in enumerate(pages) for pos, (tag, text) in enumerate(page)]
    want = []
    for i, page in enumerate(pages):
        starts, ends = ([p for p, (_, t) in enumerate(page) if m in t.upper()] for m in (corpus.START, corpus.END))
        both, inside, part, chapter = bool(starts and ends), not (starts and ends), None, None
        for pos, (tag, text) in enumerate(page):
            if corpus.START in text.upper():
                inside = True
                continue
            if corpus.END in text.upper() and (inside or not both):
                break
            if not inside or re.fullmatch(r"[ivxlcdm]+|\d+", text) or "produced by" in text or corpus.END in text.upper():
                continue
            if tag in ("h2", "h3") and re.match(r"(primera|segunda)\s+parte", text, re.I):
                part = text
            elif tag in ("h2", "h3") and re.match(r"capitulo|pr[oó]logo", text, re.I):
                chapter = text
            want.append((i, pos, part, f"{part} | {chapter}" if part and chapter else part or chapter))
    got = corpus.headed_blocks(spark.createDataFrame(rows, "id long, pos int, tag string, text string")).orderBy("id", "pos").collect()
    assert [(r["id"], r["pos"], r["part"], r["chapter"]) for r in got] == want


@pytest.mark.parametrize("variant", ["lenient", "strict"])
def test_codec_comes_back(spark, variant):
    rng = random.Random(9)
    own = codec.Codec.of(variant)
    alphabet = [c for c in "abcxyzABCñÑáÉüÜ .,;:0123456789\n" if own.decode(own.encode(c)) == c]
    assert len(alphabet) > 28
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(200)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    for r in codec.convert(rows, variant).collect():
        assert r["back"] == texts[r["id"]] and set(r["coded"]) <= set(own.valid)
    data = spark.createDataFrame([(bytes(rng.randrange(256) for _ in range(rng.randint(0, 300))),) for _ in range(50)] + [(None,)], "data binary")
    for r in data.select("data", codec.detect(F.col("data"), variant).alias("share")).collect():
        if r["data"] is not None:
            assert r["share"] == (sum(b in own.valid for b in r["data"]) / len(r["data"]) if r["data"] else 0.0)
    want = {}
    for r in data.where("data is not null").collect():
        for b in r["data"]:
            want[b] = want.get(b, 0) + 1
    assert {r["byte"]: r["n"] for r in codec.histogram(data).collect()} == want


def test_votes_of_many_and_agreement(spark):
    votes = [(1, 0, 1, "pi"), (1, 0, 2, "li"), (1, 0, 3, "li"), (1, 1, 1, "li"), (1, 1, 2, "pi"), (1, 1, 3, "o"), (1, 2, 1, "o"), (1, 2, 2, "o"), (1, 2, 3, "ps"), (1, 3, 1, ""), (1, 3, 2, "x"), (1, 3, 3, "o"), (2, 0, 1, "pi")]
    rows = spark.createDataFrame(votes, "sentence long, pos int, annotator int, label string")
    assert [r["label"] for r in A.merged_votes(rows).orderBy("sentence", "pos").collect()] == ["li", "lc", "pi", "o", "pi"]
    got = {r["sentence"]: r["agreement"] for r in A.agreement(rows.where("annotator < 3")).collect()}
    assert got == {1: 0.5, 2: 1.0}
    assert {r["agreement"] for r in A.agreement(rows).collect()} == {1.0}


def test_lots_of_annotated_sentences(spark, tmp_path):
    def records(file, units):
        return [(file, i, t, v) for i, (t, v) in enumerate(units)]

    first = [("ana", "pi"), (" ", ""), ("va", "o"), (".", "o"), (" ", ""), ("dijo", "o"), (" ", ""), ("\"", "o"), ("no", "o"), ("\"", "o")]
    second = [("ana", "pi"), (" ", "o"), ("va", "li"), (".", "o"), (" ", ""), ("dijo", "o"), (" ", ""), ("“", "o"), ("no", "o"), ("”", "o")]
    rows = spark.createDataFrame(records(1, first) + records(2, second), "file int, pos int, clave string, valor string")
    sentences = spark.createDataFrame([(0, "Ana va."), (1, "dijo \"no\""), (2, "falta"), (3, "sola")], "sentence long, text string")
    files = spark.createDataFrame([(1, 0, 0), (2, 0, 0), (1, 1, 1), (2, 1, 1), (1, 2, 2), (3, 0, 2), (1, 3, 3)], "file int, slot int, sentence long")
    found = lotes.annotations(rows, sentences, files)
    states = lotes.pairs(found, files)
    assert {r["sentence"]: r["state"] for r in states.collect()} == {0: "merged", 1: "merged", 2: "unlabeled", 3: "no pair"}
    both = lotes.side_by_side(found, states)
    got = {r["sentence"]: r for r in lotes.details(both).collect()}
    assert got[0]["n"] == 4 and got[0]["agreement"] == 0.75 and got[0]["disagreements"] == 1 and got[1]["kappa"] == 1.0
    merged = {r["sentence"]: r for r in lotes.merged(both).collect()}
    assert merged[0]["labels"] == ["pi", "o", "li", "o"] and merged[0]["text"] == "ana va."
    total = {r["lote"]: r for r in lotes.report({"x": (states, lotes.details(both))}).collect()}
    assert total[None]["merged"] == 2 and total["x"]["no_pair"] == 1 and total["x"]["unlabeled"] == 1
    assert {r["sentence"] for r in lotes.labelled(found).select("sentence").collect()} == {0}
    assert [r["sentence"] for r in lotes.union([sentences, sentences], [4, 4]).orderBy("sentence").collect()] == list(range(8))
    assert one_row(lotes.coverage(rows.where("file = 1")))["entity_pct"] == round(100 * 3 / 17, 2)
    assert one(spark, lotes.char_labels(F.array(F.lit("ab"), F.lit("c")), F.array(F.lit("x"), F.lit("y")))) == ["x", "x", "y"]
    page = report.page(report.tables(both.withColumn("lote", F.lit("x")), lotes.coverage(rows)))
    assert "<svg" in page and "rgba(" in page and "coverage" in page
    slim = spark.createDataFrame([(1, "Ana va", ["Ana", " ", "va"], ["pi", "o", "o"]), (2, " ", [" "], ["o"]), (3, "Y", ["Y"], ["lc"])], "frase_id int, text string, tokens array<string>, labels array<string>")
    sinks.write_conll(slim, str(tmp_path / "c"), one_file=True)
    assert next((tmp_path / "c").glob("part-*")).read_text() == "Ana B-PER\nva O\n\nY I-LOC\n"
    assert one_row(lotes.conll_statistics(slim)).asDict() == {"sentences": 3, "source_tokens": 5, "written_tokens": 3, "blank_tokens": 2, "entity_tokens": 2, "o": 3, "b_per": 1, "i_per": 0, "b_loc": 0, "i_loc": 1}
    sinks.write_metrics(lotes.conll_statistics(slim), str(tmp_path / "m"))
    assert json.loads(next((tmp_path / "m").glob("part-*")).read_text())["sentences"] == 3


def one_row(df):
    (row,) = df.collect()
    return row


def test_templates_for_annotators(spark, tmp_path):
    texts = spark.createDataFrame([("a", ". ".join(f"frase numero {i} de prueba" for i in range(40)))], "path string, text string")
    sentences, files, made = lotes.made(texts, files=4, each=6, least=4, seed=1)
    assert sentences.count() == 12 and files.groupBy("sentence").count().where("count <> 2").isEmpty()
    assert {r["n"] for r in made.select(F.size(F.filter("records", lambda r: r["clave"] == "frase")).alias("n")).collect()} == {6}
    sinks.write_templates(made, sentences, files, str(tmp_path / "t"))
    got = json.loads(next((tmp_path / "t/assignments").glob("part-*")).read_text())
    assert len(got["frases"]) == 12 and [len(x) for x in got["asignaciones"]] == [6] * 4
    with pytest.raises(ValueError, match="are needed"):
        lotes.made(texts, files=40, each=6, least=4, seed=1)
    with pytest.raises(ValueError, match="even"):
        lotes.made(texts, files=3, each=3, least=4, seed=1)


def test_kappa_and_merge(spark):
    same = spark.createDataFrame([("s", 1, 1)] * 3, "g string, a int, b int")
    assert A.kappa(same, ["g"]).first()["kappa"] == 1.0
    rows = spark.createDataFrame([(1, i, a, b) for i, (a, b) in enumerate([("pi", "o"), ("pi", "pi"), ("o", ""), ("li", "pi"), ("ps", "pc")])], "sentence long, pos int, a string, b string")
    assert [r["label"] for r in A.merged(rows).orderBy("pos").collect()] == ["pi", "pc", "o", "li", "pi"]


def test_entities(spark):
    tags = ["I-PER", "I-PER", "B-PER", "O", "I-LOC", "I-PER"]
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate(tags)], "sentence long, pos int, tag string")
    assert sorted((r["type"], r["start"], r["end"]) for r in A.entities(rows).collect()) == [("LOC", 4, 5), ("PER", 0, 2), ("PER", 2, 3), ("PER", 5, 6)]


def test_offers(spark):
    o = one(spark, trade.offered(F.lit('[OFERTA_V1] quiero={"Piedras": 1} ofrezco={"oro": 2}')))
    assert (o["wants"], o["gives"]) == (["piedra"], ["oro"])
    o = one(spark, trade.offered(F.lit("Te doy 1 Madera a cambio de 1 piedra")))
    assert (o["wants"], o["gives"]) == (["piedra"], ["madera"])
    assert one(spark, trade.offered(F.lit("[OFERTA_V1] quiero={mal}")))["wants"] == []
    assert one(spark, trade.object_in(F.lit('dice {"a": 1} ya')).cast("string")) == '{"a":1}'


def test_bpe_matches_brute_force(spark):
    texts = ["aaabdaaabac", "abab aaaa"]
    tok = bpe.train(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), 9)
    seqs, vocab = [list(t) for t in texts], sorted(set("".join(texts)))
    while len(vocab) < 9:
        first, n = {}, {}
        for s in seqs:
            for p in zip(s, s[1:]):
                n[p] = n.get(p, 0) + 1
                first.setdefault(p, len(first))
        a, b = min(n, key=lambda p: (-n[p], first[p]))
        vocab.append(a + b)
        out = []
        for s in seqs:
            r, i = [], 0
            while i < len(s):
                if s[i : i + 2] == [a, b]:
                    r.append(a + b)
                    i += 2
                else:
                    r.append(s[i])
                    i += 1
            out.append(r)
        seqs = out
    assert tok.vocabulary == vocab
    ids = one(spark, tok.ids(tok.encode(F.lit(texts[0]))))
    assert [vocab[i] for i in ids] == seqs[0] and one(spark, tok.decode(tok.encode(F.lit(texts[0])))) == texts[0]


def test_codec():
    lenient, strict = codec.Codec.of("lenient"), codec.Codec.of("strict")
    assert lenient.encode("¡Hola, señor! 42").hex() == bytes([27, 53, 34, 31, 20, 71, 11, 38, 24, 33, 52, 34, 37, 74, 11, 100, 98]).hex()
    assert strict.decode(strict.encode("Ñandú pingüino. (3)")) == "Ñandú pingüino. (3)"
    assert lenient.decode(lenient.encode("«a» -")) == "«a» —" and lenient.decode(bytes([81])) == "[81]"
    for bad in ("¿", "ç", "à"):
        with pytest.raises(ValueError):
            strict.encode(bad)
    with pytest.raises(ValueError):
        strict.decode(bytes([50]))


def test_sampling_keeps_ties(spark):
    rows = spark.createDataFrame([(1, t, z) for t, z in enumerate([3.0, 2.0, 2.0, 1.0])], "id long, token int, logit double")
    got = lm.top_k_chances(rows, 2).collect()
    assert len(got) == 3 and abs(sum(r["chance"] for r in got) - 1) < 1e-12
    model = lm.Transformer.random(11, 8, 16, 4, 2)
    a, b = model.logits([1, 2, 3]), model.logits([1, 2, 4])
    assert (abs(a[:2] - b[:2]) < 1e-9).all() and len(model.generate([1], 5, k=3)) == 5


def test_sources(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("index.html", "<p>small</p>")
        z.writestr("2000-h.htm", "<p>" + "palabra " * 200)
    row = files.html(spark, str(tmp_path / "b.zip")).first()
    assert (row["entry"], row["kind"]) == ("2000-h.htm", "zip") and "palabra palabra" in row["html"]
    (tmp_path / "x.conll").write_text("Ana B-PER\nva O\n\n\nNueva York B-LOC\nmal\n")
    got = [(r["sentence"], r["pos"], r["word"], r["label"]) for r in files.conll(spark, str(tmp_path / "x.conll")).orderBy("line" if False else "sentence", "pos").collect()]
    assert got == [(1, 1, "Ana", "B-PER"), (1, 2, "va", "O"), (2, 1, "Nueva York", "B-LOC")]
    (tmp_path / "json_04").mkdir()
    (tmp_path / "json_04/a_p1.json").write_text(json.dumps([{"clave": "Ana", "valor": "pi"}]))
    r = files.annotations(spark, str(tmp_path / "json_04/a_p1.json")).first()
    assert (r["file"], r["part"], r["clave"], r["valor"]) == (4, 1, "Ana", "pi")
    assert files.decode_bytes("ñ".encode("cp1252")) == "ñ"


def test_index_is_built_once(spark, tmp_path):
    rows = passages(spark, "un molino", "una casa")
    sinks.save_index(rows, str(tmp_path / "i"), "v1", buckets=2)
    assert sinks.is_current(spark, str(tmp_path / "i"), "v1") and not sinks.is_current(spark, str(tmp_path / "i"), "v2")
    kept, post, df = sinks.load_index(spark, str(tmp_path / "i"))
    assert kept.count() == 2 and {r["term"] for r in post.collect()} == {"molino", "casa"} == {r["term"] for r in df.collect()}


def test_conll_lines(spark):
    rows = spark.createDataFrame([(1, ["Ana", " ", "va"], ["pi", "o", "o"])], "frase_id int, tokens array<string>, labels array<string>")
    assert sinks.conll_lines(rows).first()["value"] == "Ana B-PER\nva O"


def test_agent_stream(spark, tmp_path):
    schema = "letter string, sender string, subject string, body string, at timestamp"
    rows = [
        ("1", "eva", "", '[OFERTA_V1] quiero={"Oros": 1} ofrezco={"trigo": 1}', "2024-01-01 00:00:00"),
        ("2", "eva", "", "hola", "2024-01-01 00:01:00"),
        ("3", "eva", "", "hola", "2024-01-01 00:04:00"),
        ("4", "eva", "Válé", "¡Hecho!", "2024-01-01 00:05:00"),
        ("5", "sistema", "", "aviso", "2024-01-01 00:00:00"),
        ("6", " YO", "", "hola", "2024-01-01 00:00:00"),
        ("7", "ana", "", "hola", "2024-01-01 00:00:00"),
        ("8", "ana", "", "t r i g o", "2024-01-01 00:02:00"),
        ("9", "luz", "", "hola", "2024-01-01 00:00:00"),
        ("10", "luz", "", "vale", "2024-01-01 00:16:00"),
    ]
    got = {}
    for batch in (rows, [("1", "eva", "", "vale", "2024-01-01 00:20:00")]):  # an id that comes again isn't answered again
        spark.createDataFrame(batch, "letter string, sender string, subject string, body string, at string").write.mode("append").json(str(tmp_path / "in"))
        q = agent.run(spark.readStream.schema(schema).json(str(tmp_path / "in")), ["oro"], ["Trigo"], "yo").writeStream.foreachBatch(lambda df, _: got.update({r["letter"]: r["outcome"] for r in df.collect()})).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
    assert got == {"1": "accepted", "2": "waiting", "3": "offered", "4": "confirmed", "7": "offered", "8": "confirmed", "9": "offered", "10": "offered"}


class Server:
    """A server that notes what it is told."""

    def __init__(self, have, goal, inbox, people=("Ana", "Yo")):
        self.have, self.goal, self.inbox, self.names, self.said, self.fails = have, goal, dict(inbox), people, [], False

    def info(self):
        return None if self.fails else (self.have, self.goal, "Yo", self.inbox)

    def people(self):
        return list(self.names)

    def send_letter(self, sender, to, subject, body):
        self.said.append(("letter", to, subject, body))
        return True

    def send_goods(self, sender, to, goods):
        self.said.append(("goods", to, goods))
        return True

    def remove(self, letter):
        self.inbox.pop(letter, None)
        return True


def test_agent_turns(spark):
    def letter(i, who, body):
        return i, {"id": i, "remi": who, "asunto": "", "cuerpo": body}

    class Draw(random.Random):
        def random(self):
            return 0.9  # no offer where there is mail

    now = [1000.0]
    server = Server({"oro": 3, "trigo": 0}, {"oro": 1, "trigo": 2}, [letter("a", "Ana", "te doy 1 trigo a cambio de 1 oros"), letter("b", "Ana", "te doy 1 trigo a cambio de 1 oro")])
    a = agent.Agent(spark, server, draw=Draw(1), clock=lambda: now[0], sleep=lambda s: None)
    assert a.turn() == "accepted" and server.said[0] == ("goods", "Ana", {"oro": 1}) and "envíame 1 de trigo" in server.said[1][3] and list(server.inbox) == ["b"]
    server.inbox["c"] = letter("c", "sistema", "aviso")[1]
    assert a.turn() == "accepted" and a.turn() == "passed over" and not server.inbox
    server.said.clear()
    assert a.turn() == "no letter" and server.said[0][1:3] == ("Ana", "Propuesta 1x1") and a.pending["Ana"][:2] == ("oro", "trigo")
    a.turn()
    assert len(server.said) == 1  # the cooldown
    server.inbox |= dict([letter("d", "Eva", "hola"), letter("e", "Ana", "VALE, recibido")])
    assert a.turn() == "confirmed" and list(server.inbox) == ["d"] and not a.pending  # the confirmation goes first
    assert a.turn() == "declined"
    now[0] += 200
    a.turn()
    server.have = {"oro": 1, "trigo": 0}
    server.inbox |= dict([letter("f", "Ana", "hecho")])
    assert a.turn() == "no longer over" and "Ana" in a.pending  # and removed all the same
    now[0] += 901
    server.inbox |= dict([letter("g", "Ana", "hecho")])
    assert a.turn() == "declined" and not a.pending  # it has lapsed
    server.inbox |= dict([letter("h", "yo", "hola"), letter("i", "Ana", "hola")])
    assert a.turn() == a.turn() == "own letter" and list(server.inbox) == ["h", "i"]
    server.inbox = dict([letter("j", "Ana", "algo raro")])
    server.have = {"oro": 3}
    a.reader = lambda body: (["Oro"], ["trigo"])
    assert a.turn() == "accepted"
    server.fails, slept = True, []
    a.sleep = slept.append
    assert a.turn() is None
    a.run(1)
    assert slept == [2]


def test_server_client():
    import http.server
    import threading

    seen = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            seen.append((self.command, self.path, self.rfile.read(int(self.headers.get("Content-Length") or 0)).decode()))
            body = {"/info": {"Recursos": {"oro": 1}, "Objetivo": {}, "Alias": ["", " Yo "], "Buzon": {}}, "/gente": [{"alias": "Ana"}, {}, "x"]}.get(self.path.split("?")[0])
            self.send_response(200 if body is not None or self.command != "GET" else 500)
            self.end_headers()
            self.wfile.write(json.dumps(body if body is not None else {}).encode())

        do_POST = do_DELETE = do_GET

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    b = butler.Butler(f"http://127.0.0.1:{server.server_port}/", "yo")
    assert b.info() == ({"oro": 1}, {}, "Yo", {}) and b.people() == ["Ana"]
    assert b.send_letter("Yo", "Ana", "s", "ñ") and not b.send_letter("Yo", " yo ", "s", "b") and not b.send_goods("Yo", "YO", {"oro": 1})
    assert b.send_goods("Yo", "Ana Luz", {"oro": 1}) and b.remove("7")
    assert [s[:2] for s in seen[2:]] == [("POST", "/carta?agente=yo"), ("POST", "/paquete/Ana%20Luz?agente=yo"), ("DELETE", "/mail/7?agente=yo")]
    assert json.loads(seen[2][2])["cuerpo"] == "ñ"
    server.shutdown(), server.server_close()
    assert b.info() is None and b.people() == [] and not b.send_letter("a", "b", "", "")


@pytest.mark.parametrize(("info", "alias"), [({"Alias": " Yo "}, "Yo"), ({"Alias": ["", " ", "Ana"]}, "Ana"), ({"Alias": []}, "Desconocido"), ({"Alias": ""}, "Desconocido"), ({}, "Desconocido"), ({"Alias": None}, "Desconocido")])
def test_own_alias(spark, info, alias):
    assert one(spark, T.own_alias(F.lit(json.dumps(info)))) == alias == butler.alias_of(info)
    assert one(spark, T.same_alias(F.lit(" ANA"), F.lit("ana "))) and not one(spark, T.same_alias(F.lit("ana"), F.lit(None).cast("string")))


def test_word_labels_and_entities(spark):
    def label(*tags):
        return one(spark, ner.word_label(F.array(*map(F.lit, tags))))

    assert label("O", "B-PER", "I-LOC", "I-LOC") == "B-LOC" and label("I-LOC", "B-PER") == "B-LOC" and label("O") == "O"
    words = ["Alice", "the", "Queen", "queen", "bob", "...", "Bob", "garden"]
    tags = ["O", "B-PER", "O", "O", "B-PER", "B-PER", "B-PER", "B-PER"]
    rows = spark.createDataFrame(list(zip(range(8), words, tags)), "i int, w string, l string")
    assert [r["x"] for r in rows.orderBy("i").select(ner.refined(F.col("w"), F.col("l")).alias("x")).collect()] == ["B-PER", "O", "B-PER", "O", "O", "O", "B-PER", "B-LOC"]
    got = one(spark, ner.grouped(F.array(*map(F.lit, "abcdef")), F.array(*map(F.lit, ["B-PER", "B-PER", "O", "B-PER", "B-LOC", "I-LOC"]))))
    assert [(e["text"], e["type"]) for e in got] == [("a b", "PER"), ("d", "PER"), ("e f", "LOC")]


def test_alignment_and_tagging(spark):
    tok = bpe.Bpe(("\n", " ", *"abcdefghijklmnopqrstuvwxyz"), (("t", "h", "\U000f0000"), ("\U000f0000", "e", "\U000f0001")))
    rows = spark.createDataFrame([(1, ["the", "cat", ""], ["B-PER", "I-LOC", "O"]), (2, [], []), (3, ["abcde"] * 5, ["B-LOC"] * 5)], "id long, words array<string>, labels array<string>")
    got = {r["id"]: r for r in rows.select("id", ner.aligned(F.col("words"), F.col("labels"), tok).alias("a"), ner.word_spans(F.col("words"), tok).alias("s"), ner.explained(F.col("words"), F.col("labels"), tok).alias("e"), ner.aligned(F.col("words"), F.col("labels"), tok, 3).alias("cut")).collect()}
    assert got[1]["a"]["labels"] == ["B-PER", "O", "I-LOC", "I-LOC", "I-LOC", "O"] and [tuple(x) for x in got[1]["s"]] == [(0, 1), (2, 5), (6, 6)]
    assert got[1]["e"][1] == "cat             I-LOC  -> c/I-LOC  a/I-LOC  t/I-LOC" and got[2]["a"]["tokens"] == []
    assert got[3]["a"]["labels"][:7] == ["B-LOC", *["I-LOC"] * 4, "O", "B-LOC"] and got[3]["cut"]["labels"] == ["B-LOC", "I-LOC", "I-LOC"]
    assert one(spark, ner.padded(ner.label_ids(F.array(F.lit("O"), F.lit("I-LOC"))), F.lit(4), ner.PAD)) == [0, 4, -100, -100]
    tagger = ner.Tagger.random(len(tok.vocabulary), 12, 8, 2, 1, seed=3)
    out = {r["id"]: r for r in ner.tagged(rows, tok, tagger).collect()}
    assert len(out[1]["labels"]) == 3 and out[2]["entities"] == [] and out[3]["labels"][:2] == ["O", "O"]  # only the last 12 subtokens are seen
    ids = [3, 4, 5, 1, 6]
    assert np.allclose(tagger.loss(ids, [0, 1, -100, 2, 0]), np.mean([-np.log(np.exp(z)[y] / np.exp(z).sum()) for z, y in zip(tagger.logits(ids), [0, 1, -100, 2, 0]) if y >= 0]))
    assert tagger.loss(ids, [-100] * 5) == 0.0
    with pytest.raises(ValueError, match="at most 12"):
        tagger.logits([0] * 13)


def test_generation_and_windows(spark):
    model = lm.Transformer.random(11, 6, 8, 2, 2, seed=1)
    rows = spark.createDataFrame([(1, [1, 2, 3]), (2, [4])], "id long, ids array<int>")
    a, b = (sorted(map(str, lm.generated(rows.repartition(n), model, 5, k=3, seed=7).collect())) for n in (1, 3))
    assert a == b and all(len(r["ids"]) == 5 for r in lm.generated(rows, model, 5).collect())
    z = model.logits([1, 2, 3])
    assert np.allclose(z[:2], model.logits([1, 2])) and np.isclose(model.loss([1, 2, 3]), -np.mean([np.log(np.exp(z[i])[y] / np.exp(z[i]).sum()) for i, y in enumerate((2, 3))]))
    got = lm.windows(rows, 2).orderBy("id", "start").collect()
    assert [(r["id"], r["start"], r["x"], r["y"]) for r in got] == [(1, 1, [1, 2], [2, 3])]
    assert lm.as_markdown([(0.5, "a|b\nc")], ["t", "text"]) == "| t | text |\n|-|-|\n| 0.5 | a\\|b c |\n"


@pytest.mark.parametrize("head", [False, True])
def test_gradients_are_the_slopes(head):
    rng = np.random.default_rng(2)
    model = lm.Transformer.random(9, 5, 6, 2, 2, seed=4, causal=not head)
    w = {k: v + rng.normal(0, 0.3, v.shape) for k, v in model.w.items()} | {"0.qkv.b": rng.normal(size=18), "1.up.b": rng.normal(size=24), "out.b": rng.normal(size=6)}
    if head:
        w |= {"head": rng.normal(size=(6, 5)), "head.b": rng.normal(size=5)}
    ids, labels = rng.integers(0, 9, (3, 5)), rng.integers(0, 5, (3, 5))
    labels[0, 3:] = ner.PAD
    weights = np.array([1.0, 2.0, 0.5, 3.0, 1.0]) if head else None
    loss, grad = training.gradients(w, 2, not head, ids, labels, weights)
    if not head:
        model.w = w
        assert np.isclose(training.gradients(w, 2, True, ids[1:2, :-1], ids[1:2, 1:])[0], model.loss(ids[1].tolist()))
    for name, g in grad.items():
        at = tuple(int(rng.integers(n)) for n in g.shape)
        far = []
        for step in (1e-5, -1e-5):
            moved = {k: v.copy() for k, v in w.items()}
            moved[name][at] += step
            far.append(training.gradients(moved, 2, not head, ids, labels, weights)[0])
        assert abs((far[0] - far[1]) / 2e-5 - g[at]) < 2e-5, name


def test_training_lowers_the_loss(spark):
    ids = np.array([1, 2, 3, 4] * 30)
    make = lambda: lm.Transformer.random(5, 6, 16, 2, 1, seed=1)
    model, seen = make(), []
    history = training.train_causal(model, ids, length=6, rows=8, epochs=6, rate=1e-2, after=lambda n, row: seen.append(n))
    assert history[-1]["loss"] < 0.3 < history[0]["loss"] and history[-1]["validation"] < 0.3 and seen == [1, 2, 3, 4, 5, 6]
    assert np.isclose(one(spark, lm.perplexity(F.lit(history[-1]["loss"]))), np.exp(history[-1]["loss"]))
    half, adam = make(), training.AdamW(1e-2)
    training.train_causal(half, ids, length=6, rows=8, epochs=3, adam=adam)
    training.train_causal(half, ids, length=6, rows=8, epochs=6, done=3, adam=adam)  # goes on where it was
    assert all(np.allclose(half.w[k], model.w[k]) for k in model.w)
    with pytest.raises(ValueError, match="needs more text"):
        training.train_causal(make(), ids[:5], length=6)

    tok = bpe.Bpe(("\n", " ", *"abcdefghijklmnopqrstuvwxyz"), ())
    words = [["ana", "va", "a", "roma"], ["eva", "come"], ["luz", "y", "ana"]] * 8
    names = {"ana": "B-PER", "eva": "B-PER", "luz": "B-PER", "roma": "B-LOC"}
    rows = spark.createDataFrame([(i, w, [names.get(x, "O") for x in w]) for i, w in enumerate(words)], "id long, words array<string>, labels array<string>")
    tagger = ner.Tagger.of(lm.Transformer.random(28, 20, 16, 2, 1, seed=2))
    history = training.train_tagger(tagger, training.samples(rows, tok, 20), rows=4, epochs=40, rate=1e-2)
    assert history[-1]["loss"] < 0.1 < history[0]["loss"]
    found = training.evaluated(rows, tok, tagger)
    numbers = F.create_map(*[F.lit(v) for kv in ner.LABELS.items() for v in kv])
    metrics = one_row(A.token_metrics(found.select(F.element_at(numbers, F.col("pred")).alias("pred"), F.element_at(numbers, F.col("gold")).alias("gold"))))
    assert metrics["f1"] > 0.95
    sides = [A.entities(found.select("sentence", "pos", F.col(c).alias("tag"))) for c in ("pred", "gold")]
    assert {r["type"]: r["support"] for r in A.entity_metrics(*sides).collect()} == {None: 40, "PER": 32, "LOC": 8}
    assert [(e["text"], e["type"]) for e in ner.tagged(rows.where("id = 0"), tok, tagger).first()["entities"]] in ([("roma", "LOC")], [("roma", "LOC")])  # persons in lower case go
    again, tok2, about = training.unpacked(training.packed(tagger, tok, {"seq_len": 20, "lr": 1e-2}, history[-1]))
    assert np.array_equal(again.logits([3, 4]), tagger.logits([3, 4])) and tok2 == tok and about["config"]["context_size"] == 20 and about["config"]["learning_rate"] == 1e-2
    assert isinstance(training.unpacked(training.packed(model, tok, {}))[0], lm.Transformer)


def test_interactive_search(spark, tmp_path):
    from textloom import cli

    (tmp_path / "p.html").write_text("<h3>Capitulo I</h3>" + "".join(f"<p>{'molino viento ' * 15} parrafo {i}</p>" for i in range(5)))
    found = cli.Searcher(spark, str(tmp_path / "p.html"), None, 20)
    lines, said = iter(["/help", "/limit 2", "/chapter uno", "molino", "/chapter off", "/mode rag", "molino", "/mode semantic", "viento", "/mode x", "...", "/stats", "salir"]), []
    cli.interactive(found, lambda _: next(lines), said.append)
    assert sum("excerpt" in s for s in said) >= 4 and any("not understood: /mode x" in s for s in said) and any("passages" in s for s in said)
    assert list(lines) == []
    with pytest.raises(FileNotFoundError, match="no source"):
        cli.Searcher(spark, str(tmp_path / "none.html"), None, 20)


def test_cooldown_is_sequential(spark):
    rows = spark.createDataFrame([("u", f"2024-01-01 00:0{m}:00", m) for m in range(8)], "user string, ts string, id long").withColumn("ts", F.to_timestamp("ts"))
    assert sorted(r["id"] for r in trade.allowed_sends(rows, 180).collect()) == [0, 3, 6]


def test_report(spark):
    from textloom.operators import report

    rows = spark.createDataFrame([("l1", 1, 0, "pi", "pi"), ("l1", 1, 1, "o", "o"), ("l2", 2, 0, "o", "pi"), ("l2", 2, 1, "o", "o")], "lote string, sentence long, pos int, a string, b string")
    found = report.tables(rows)
    assert [(r["lote"], r["sentences"]) for r in found["agreement"].collect()] == [("l1", 1), ("l2", 1), (None, 2)]
    assert "<h2>worst</h2>" in report.page(found)


def test_command_line(spark, tmp_path, capsys):
    from textloom import cli

    (tmp_path / "t.txt").write_text("en un lugar")
    assert cli.main(["encode", str(tmp_path / "t.txt")]) == 0
    assert capsys.readouterr().out.strip() == "1821" + "0b" + "2821" + "0b" + "1f281a1425"
    (tmp_path / "p.html").write_text("<h3>Capitulo I</h3>" + "".join(f"<p>{'molino viento ' * 15} parrafo {i}</p>" for i in range(5)))
    assert cli.main(["search", "molino", "--source", str(tmp_path / "p.html"), "--index", str(tmp_path / "i"), "--min-words", "20"]) == 0
    assert "[" in capsys.readouterr().out
    assert cli.main(["stats", "--source", str(tmp_path / "p.html"), "--index", str(tmp_path / "i"), "--min-words", "20"]) == 0


def test_command_line_of_models(spark, tmp_path, capsys):
    from textloom import cli

    def said(*args):
        assert cli.main([str(a) for a in args]) == 0
        return capsys.readouterr().out

    (tmp_path / "c").mkdir()
    (tmp_path / "c/a.txt").write_text("ana va a roma. eva va a roma. " * 8)
    out = said("train-causal", tmp_path / "c", "--output", tmp_path / "m", "--size", 20, "--context", 8, "--width", 8, "--heads", 2, "--layers", 1, "--epochs", 2)
    assert [json.loads(x)["epoch"] for x in out.splitlines()] == [1, 2]
    assert said("generate", tmp_path / "m", "ana ", "--count", 5).startswith("ana ") and said("experiment-generate", tmp_path / "m", "ana", "--count", 2).count("| ana") >= 9
    (tmp_path / "x.conll").write_text("ana B-PER\nva O\n\nroma B-LOC\n")
    assert len(said("train-ner", tmp_path / "m", tmp_path / "x.conll", "--output", tmp_path / "n", "--epochs", 2).splitlines()) == 2
    assert '"n":' in said("eval-ner", tmp_path / "n", tmp_path / "x.conll", "--output", tmp_path / "e") and "entities" in next((tmp_path / "e").glob("part-*")).read_text()
    said("ner", tmp_path / "n", "--text", "ana va")
    assert json.loads(said("analyze-bpe", tmp_path / "c", "--text", "ana va"))["n_chars"] == 6
    with pytest.raises(SystemExit):
        cli.main(["ner", str(tmp_path / "n")])


def test_front_matter_names_a_chapter_until_the_first(spark):
    page = "<h2>Tasa</h2><p>uno dos</p><h2>El Rey</h2><p>tres cuatro</p><h3>Capitulo I</h3><p>cinco seis</p><h3>Segunda parte</h3><p>siete ocho</p>"
    rows = corpus.headed_blocks(corpus.html_blocks(spark.createDataFrame([(1, page)], "id long, html string"))).orderBy("pos").collect()
    assert [r["chapter"] for r in rows if r["tag"] == "p"] == ["Tasa", "Tasa", "Capitulo I", "Segunda parte | Capitulo I"]


def lines_of(text, passage):
    """(place from 1, line) of every place of a passage, by trying each."""
    at = [i for i in range(len(text)) if passage and text.startswith(passage, i)]
    starts = [0, *[i + 1 for i, c in enumerate(text) if c == "\n"]]
    sizes = [len(x) for x in text.split("\n")]
    return [(i + 1, no) for i in at for no, (s, n) in enumerate(zip(starts, sizes)) if s < i + len(passage) and s + n > i]


def test_offset_range_join_searches_every_passage(spark, tmp_path):
    from textloom.plans.retrieval import offset_range_join

    asked = [(i, f"passage number {i} of\nthe benchmark") for i in range(12)] + [(150, "una frase entera aquí")]
    docs = [(0, "x\nthen passage number 3 of\nthe benchmark ends"), (1, "ñ passage number 11 of\nthe benchmark\nand una frase entera aquí"), (2, "nothing")]
    spark.createDataFrame(asked, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = sorted((i, d, no, at) for i, p in asked for d, t in docs for at, no in lines_of(t, p))
    assert {i for i, *_ in want} == {3, 11, 150}
    assert sorted(map(tuple, offset_range_join(spark, str(tmp_path)).collect())) == want


def test_overlapping_lines_give_every_place(spark):
    asked = [(0, "aa"), (1, "word"), (2, "one two three four five"), (3, "\nb c\n"), (4, "."), (5, "\\E q\\Q"), (6, ""), (7, "a b a b a b a"), (8, "two three"), (9, "\n")]
    docs = [(0, "aaaa\n\nword, a \"one two three four five\" and\tone two three four five."), (1, "\nb c\n\nb c\nb c\n"), (2, "x \\E q\\Q y\\E q\\Q"), (3, "é😀 a b a b a b a b a b a"), (4, "swords one two three\nfour"), (5, ""), (6, None)]
    got = corpus.overlapping_lines(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(asked, "item_id long, passage string"))
    want = sorted((i, d, no, at) for i, p in asked for d, t in docs for at, no in lines_of(t or "", p))
    assert sorted(map(tuple, got.select("item_id", "doc_id", "line_no", "at").collect())) == want


def trained_by_hand(rows, size):
    """Vocabulary and encoder of bpe by counting every pair anew."""
    seqs, vocab, merges = [list(t) for _, t in sorted(rows)], sorted(set("".join(t for _, t in rows))), []

    def put(s, a, b):
        r, i = [], 0
        while i < len(s):
            two = s[i : i + 2] == [a, b]
            r.append(a + b if two else s[i])
            i += 1 + two
        return r

    while len(vocab) < size:
        n = {}
        for s in seqs:
            for p in zip(s, s[1:]):
                n[p] = n.get(p, 0) + 1
        if not n:
            break
        a, b = max(n, key=n.get)  # the first seen on ties, as a dict keeps its order
        merges.append((a, b))
        vocab.append(a + b)
        seqs = [put(s, a, b) for s in seqs]

    def encode(text):
        s = [c if c in vocab else vocab[0] for c in text]
        for m in merges:
            s = put(s, *m)
        return s

    return vocab, encode


@pytest.mark.parametrize("runs", [bpe.RUNS, 20])
def test_bpe_queries_train_on_whole_documents(spark, tmp_path, monkeypatch, runs):
    from textloom.plans.models import bpe_encode_stats, bpe_train_k_merges

    monkeypatch.setattr(bpe, "RUNS", runs)

    rng = random.Random(3)
    words = ["".join(rng.choices("aáeinortsñ😀", k=rng.randint(1, 6))) for _ in range(60)] + ["aaaa", "aaaaaaa"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(0, 120)))) for i in rng.sample(range(1000), 40)]
    spark.createDataFrame(docs, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    vocab, encode = trained_by_hand(docs, 300)
    assert [r["token"] for r in bpe_train_k_merges(spark, str(tmp_path)).orderBy("id").collect()] == vocab and len(vocab) == 300
    got = {r["doc_id"]: (r["n_chars"], r["n_tokens"], r["round_trip"]) for r in bpe_encode_stats(spark, str(tmp_path)).collect()}
    assert got == {i: (len(t), len(encode(t)), True) for i, t in docs}


def test_bpe_encoded_equals_encode(spark):
    texts = [(0, "the then then"), (1, "aaaaa aaa")]
    tok = bpe.train(spark.createDataFrame(texts, "id long, text string"), 12)
    rows = spark.createDataFrame([(0, "then xyz aaaa"), (1, ""), (2, None), (3, "aaaaa")], "id long, text string")
    out = bpe.encoded(rows, tok).select("id", "tokens", tok.encode(F.col("text")).alias("same"), "back", tok.decode(tok.encode(F.col("text"))).alias("text")).collect()
    assert len(out) == 4 and all(r["tokens"] == r["same"] and r["back"] == r["text"] for r in out)
    assert "".join(trained_by_hand(texts, 12)[1]("then xyz")) == bpe.encoded(rows.limit(1).select("id", F.lit("then xyz").alias("text")), tok).first()["back"]


def test_lm_windows_counts_the_windows_themselves(spark, tmp_path, monkeypatch):
    from textloom.plans.models import lm_windows

    asked, windows = [], lm.windows
    monkeypatch.setattr(lm, "windows", lambda ids, length: asked.append(length) or windows(ids, length))
    docs = [(0, ""), (1, "a" * 64), (2, "ñ😀" * 40), (3, "x" * 9000)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, lm_windows(spark, str(tmp_path)).collect()))
    assert got == [(0, 0, 0), (1, 0, 57), (2, 16, 72), (3, 8936, 8100)] and asked == [64]
