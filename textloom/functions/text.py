"""Text functions as Spark columns; all stay in the JVM."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that say little (fixed values).
STOPWORDS = ["a", "al", "con", "de", "del", "el", "en", "la", "las", "lo", "los", "por", "para", "que", "se", "un", "una", "unos", "unas", "y"]
#: Verb endings and what takes their place, in order of trial (fixed values).
VERB_ENDINGS = [
    ("ar", ["ando", "aba", "aban", "abas", "ado", "ada", "ados", "adas", "aron"]),
    ("er", ["iendo", "ia", "ian", "ias", "ido", "ida", "idos", "idas", "ieron"]),
]


def _accents() -> tuple[str, str]:
    """Accented letters with their bare ones, then the combining marks, which go."""
    pairs = []
    for n in range(0xC0, 0x250):
        bare = "".join(c for c in unicodedata.normalize("NFD", chr(n)) if unicodedata.category(c) != "Mn")
        if len(bare) == 1 and bare != chr(n):
            pairs.append((chr(n), bare))
    marks = "".join(chr(n) for n in range(0x300, 0x370) if unicodedata.category(chr(n)) == "Mn")
    return "".join(a for a, _ in pairs) + marks, "".join(b for _, b in pairs)


_WITH, _WITHOUT = _accents()


def collapse_spaces(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def normalize(x: Column) -> Column:
    """Lower case, no accents, letters and digits parted by single spaces; null gives the empty text."""
    bare = F.translate(F.lower(F.coalesce(x, F.lit(""))), _WITH, _WITHOUT)
    return F.trim(F.regexp_replace(bare, r"(?U)[^\p{L}\p{N}]+", " "))


def words(x: Column) -> Column:
    """The runs between white space."""
    return F.filter(F.split(F.trim(x), r"(?U)\s+"), lambda w: w != "")


def word_count(x: Column) -> Column:
    return F.size(words(x))


def word_runs(x: Column) -> Column:
    """How many runs of word characters there are: unlike word_count where punctuation stands between."""
    return F.regexp_count(x, F.lit(r"(?U)\w+"))


def sentences(x: Column) -> Column:
    """Parts after . ! ? ; or : that white space follows."""
    return F.split(x, r"(?<=[.!?;:])\s+")


def phrases(x: Column) -> Column:
    """Parts between full stops, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(x, r"\."), lambda p: F.trim(F.regexp_replace(p, r"(?U)^\s+|\s+$", ""))), lambda p: p != "")


def lossless_tokens(x: Column) -> Column:
    """White-space runs, word runs and single other characters, which joined are the text again."""
    return F.regexp_extract_all(x, F.lit(r"(?U)(\s+|\w+|[^\w\s])"), F.lit(1))


def simple_tokens(x: Column) -> Column:
    return F.regexp_extract_all(x, F.lit(r"(?U)(\w+|[^\w\s])"), F.lit(1))


def _singular(t: Column) -> Column:
    n = F.length(t)

    def back(k: int) -> Column:
        return F.substring(t, n - k + 1, F.lit(1))

    return (
        F.when(t.endswith("ces") & (n > 4), F.concat(F.left(t, n - 3), F.lit("z")))
        .when(t.endswith("es") & (n > 4) & ~back(3).isin(*"aeiou"), F.left(t, n - 2))
        .when(t.endswith("s") & (n > 3) & back(2).isin(*"aeiou"), F.left(t, n - 1))
        .otherwise(t)
    )


def _infinitive(t: Column) -> Column:
    # no ending is another's end, so that each pattern has one way to fit
    out = t
    for verb, endings in reversed(VERB_ENDINGS):
        pattern = f"^(.{{3,}})(?:{'|'.join(endings)})$"
        out = F.when(t.rlike(pattern), F.regexp_replace(t, pattern, f"$1{verb}")).otherwise(out)
    return out


def lemma(token: Column) -> Column:
    """A rule-made base form of a normalized token: first the plural goes, then the verb ending."""
    return _infinitive(_singular(token))


def lemma_of(token: str) -> str:
    """lemma() of a single normalized token, without Spark."""
    n = len(token)
    if token.endswith("ces") and n > 4:
        token = token[:-3] + "z"
    elif token.endswith("es") and n > 4 and token[-3] not in "aeiou":
        token = token[:-2]
    elif token.endswith("s") and n > 3 and token[-2] in "aeiou":
        token = token[:-1]
    for verb, endings in VERB_ENDINGS:
        for e in endings:
            if token.endswith(e) and len(token) - len(e) >= 3:
                return token[: -len(e)] + verb
    return token


def tokens_of(base: str) -> list[str]:
    """All tokens whose base form this is; the rules have few ways to it, so that texts can be searched without theirs being made."""
    before = [base] + [base[: -len(verb)] + e for verb, endings in VERB_ENDINGS if base.endswith(verb) for e in endings]
    forms = [f for b in before for f in (b, b + "s", b + "es", b[:-1] + "ces")]
    return sorted({f for f in forms if lemma_of(f) == base})


@lru_cache(8)
def stop_tokens(more: tuple[str, ...] = ()) -> tuple[str, ...]:
    """All tokens whose base form is a stopword, one of these or of another library's list."""
    return tuple(sorted({t for w in {*STOPWORDS, *more} for t in tokens_of(w)}))


def useful_tokens(norm: Column, more: tuple[str, ...] = ()) -> Column:
    """The tokens of a normalized text, as they stand, whose base forms content() keeps, in order; `more`: further stopwords."""
    bare = F.regexp_replace(norm, r"(?<![^ ])\p{Nd}+(?![^ ])", "")
    every = F.filter(F.split(bare, " "), lambda t: t != "")
    useful = F.filter(every, lambda t: ~t.isin(*stop_tokens(more)))
    return F.when(F.size(useful) > 0, useful).otherwise(every)


def lemmas(x: Column) -> Column:
    """The base forms of a text's tokens, in order, without those of digits only."""
    tokens = F.filter(F.split(normalize(x), " "), lambda w: w != "")
    return F.filter(F.transform(F.transform(tokens, _singular), _infinitive), lambda t: (t != "") & ~t.rlike(r"^\p{Nd}+$"))


def content(all_lemmas: Column) -> Column:
    """Those that aren't stopwords, or all where only stopwords are left."""
    useful = F.filter(all_lemmas, lambda t: ~t.isin(*STOPWORDS))
    return F.when(F.size(useful) > 0, useful).otherwise(all_lemmas)


def shorten(x: Column, n: int, keep: int | None = None) -> Column:
    """At most n characters; a longer text ends in three dots after keep (n - 3)."""
    return F.when(F.length(x) > n, F.concat(F.rtrim(F.left(x, F.lit(keep or n - 3))), F.lit("..."))).otherwise(x)


def chapter_label(part: Column, chapter: Column) -> Column:
    both = part.isNotNull() & (part != "") & chapter.isNotNull() & (chapter != "")
    return F.when(both & ~normalize(chapter).contains(normalize(part)), F.concat_ws(" | ", part, chapter)).when(both, chapter).otherwise(F.coalesce(F.nullif(chapter, F.lit("")), F.nullif(part, F.lit(""))))


def cosine(a: Column, b: Column) -> Column:
    """Of two vectors over their shared length; 0 where either has no length."""
    n = F.least(F.size(a), F.size(b))
    x, y = F.slice(a, 1, n), F.slice(b, 1, n)

    def total(v: Column) -> Column:
        return F.aggregate(v, F.lit(0.0), lambda s, e: s + e)

    dot = total(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")))
    size_a, size_b = (F.sqrt(total(F.transform(v, lambda p: p.cast("double") * p.cast("double")))) for v in (a, b))
    return F.when((size_a == 0) | (size_b == 0), F.lit(0.0)).otherwise(dot / (size_a * size_b))


def spelled(normalized: str) -> str:
    """A pattern (Java's) of the texts that are this one when normalized: any case, with accents, other characters between words."""
    forms: dict[str, str] = {}
    for a, b in zip(_WITH, _WITHOUT):
        forms[b.lower()] = forms.get(b.lower(), "") + a + a.upper()[:1] + a.lower()[:1]

    def letter(c: str) -> str:
        own = "".join(dict.fromkeys(c + c.upper()[:1] + forms.get(c, "")))
        return rf"\Q{c}\E" if len(own) == 1 else f"[{own}]"

    return r"[^\p{L}\p{N}]+".join(r"\p{Mn}*".join(map(letter, w)) for w in normalized.split())


def alias(x: Column) -> Column:
    return F.lower(F.trim(F.coalesce(x, F.lit(""))))


def same_alias(a: Column, b: Column) -> Column:
    """Whether two aliases are one, whatever their case; no alias is the empty one."""
    return alias(a) == alias(b)


def own_alias(info: Column) -> Column:
    """The alias in a server's answer (JSON text): its field Alias, a text or the first one with characters in a list."""
    plain = F.trim(F.get_json_object(info, "$.Alias"))
    listed = F.from_json(F.get_json_object(info, "$.Alias"), "array<string>")
    first = F.get(F.filter(F.transform(listed, lambda a: F.trim(a)), lambda a: a.isNotNull() & (a != "")), F.lit(0))
    return F.coalesce(F.when(plain.startswith("["), first).otherwise(F.nullif(plain, F.lit(""))), F.lit("Desconocido"))


def resource(x: Column) -> Column:
    """The letters of a resource's name, lower case, without a plural s after more than three."""
    bare = F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), "[^a-záéíóúñü]+", "")
    return F.when(bare.endswith("s") & (F.length(bare) > 3), F.left(bare, F.length(bare) - 1)).otherwise(bare)


def free_text(x: Column) -> Column:
    return collapse_spaces(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), r"(?U)[^a-záéíóúüñ0-9\s]+", " "))


def label(x: Column) -> Column:
    """An annotator's label: o, pi, pc, li or lc; the slip ps is pi, anything else o."""
    low = F.lower(F.trim(F.coalesce(x, F.lit(""))))
    return F.when(low == "ps", "pi").when(low.isin("pi", "pc", "li", "lc"), low).otherwise("o")


def bio(x: Column) -> Column:
    """A merged label in BIO form; an unknown one is an error."""
    names = {"o": "O", "pi": "B-PER", "pc": "I-PER", "li": "B-LOC", "lc": "I-LOC"}
    low, out = F.lower(F.trim(x)), None
    for k, v in names.items():
        out = F.when(low == k, v) if out is None else out.when(low == k, v)
    return out.otherwise(F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce(x, F.lit("null")))))


def straight_quotes(x: Column) -> Column:
    return F.translate(x, "“”‘’", "\"\"''")


#: Function words that a capital letter doesn't make a name (fixed values).
CAPITALISED = ["The", "A", "An", "And", "But", "Or", "If", "Then", "When", "While", "It", "He", "She", "They", "We", "I", "You", "This", "That", "In", "On", "At", "For", "Of", "To", "From"]


def capitalised_entities(x: Column) -> Column:
    """Distinct runs of capitalised words, in order of first use."""
    found = F.regexp_extract_all(x, F.lit(r"(?U)\b((?:[A-Z][a-z]+)(?:\s+[A-Z][a-z]+)*)\b"), F.lit(1))
    return F.array_distinct(F.filter(found, lambda e: ~e.isin(*CAPITALISED)))
