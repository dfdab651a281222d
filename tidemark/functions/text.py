"""Text normalisation, match keys, tokens and rule-based labels, all as Spark column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the whitespace class, spelled out because \s differs between regex engines.
WHITESPACE = r"[\t\n\f\r ]+"

# Function words per language that decide the language flag.
LANGUAGE_WORDS: dict[str, str] = {
    "en": "the a an and or but is are was were it this that to of in on for with my i you not have has had be as at "
    "so they them very would will can just no do does did its if all one these works work great good",
    "es": "de la que el en y los se del las un por con una su para es al lo como más pero sus le ya este porque esta "
    "muy sin también me hay todo nada mucho bien funciona producto calidad",
    "pt": "de que não um uma para com os no na do da em é muito mas produto bom qualidade",
    "fr": "le la les et est un une des pour pas avec dans ce qui très mais produit",
    "de": "der die das und ist nicht ein eine mit für sehr auf ich es zu aber",
}

# Cue substrings of the keyword annotator.
POSITIVE_CUES = ("good", "great", "love", "excellent")
NEGATIVE_CUES = ("bad", "broke", "terrible", "not ", "stopped")

# The annotation labels.
LABELS = ("POSITIVE", "NEGATIVE", "MIXED", "NEUTRAL", "UNCLEAR")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _filled(c: Column | str) -> Column:
    return F.coalesce(_col(c), F.lit(""))


def text_hash(text: Column | str) -> Column:
    """MD5 of lower-cased text with whitespace runs collapsed and ends trimmed. Null counts as empty."""
    filled = _filled(text)
    # Most texts have single spaces only, which plain searches tell much faster than the pattern.
    runs = F.contains(filled, F.lit("  "))
    for c in "\t\n\f\r":
        runs |= F.contains(filled, F.lit(c))
    return F.md5(F.trim(F.lower(F.when(runs, F.regexp_replace(filled, WHITESPACE, " ")).otherwise(filled))))


def text_len(text: Column | str) -> Column:
    return F.length(_filled(text))


def loose_norm(text: Column | str) -> Column:
    """Letters a-z only: tags become a space, every other run becomes one space, ends trimmed."""
    tagless = F.regexp_replace(F.lower(_filled(text)), "<[^>]*>", " ")
    return F.trim(F.regexp_replace(tagless, "[^a-z]+", " "))


def prefix_key(loose: Column | str, n: int = 120) -> Column:
    """The first n characters of a loose text: the widest of the three match levels."""
    return F.substring(_col(loose), 1, n)


def preview(text: Column | str, n: int = 300) -> Column:
    return F.substring(_col(text), 1, n)


def word_tokens(text: Column | str) -> Column:
    """Lower-cased runs of two or more word characters."""
    return F.regexp_extract_all(F.lower(_filled(text)), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))


def _grams(words: Column, ngrams: tuple[int, ...]) -> Column:
    parts = []
    if 1 in ngrams:
        parts.append(words)
    if 2 in ngrams:
        n = F.greatest(F.size(words) - 1, F.lit(0))
        parts.append(F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda a, b: F.concat(a, F.lit(" "), b)))
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def tokenize_words(text: Column | str, ngrams: tuple[int, ...] = (1, 2)) -> Column:
    """Unigrams and, on request, adjacent pairs joined by a space."""
    words = word_tokens(text)
    if 2 not in ngrams:
        return _grams(words, ngrams)
    # The words are the one element of an array, so that the text is split once and not at every mention of them.
    return F.element_at(F.transform(F.array(words), lambda w: _grams(w, ngrams)), 1)


def language_words(text: Column | str) -> Column:
    """Runs of letters only, lower-cased."""
    return F.regexp_extract_all(F.lower(_filled(text)), F.lit(r"\p{L}+"), F.lit(0))


def _hits(words: Column, lang: str) -> Column:
    listed = F.array(*[F.lit(w) for w in sorted(set(LANGUAGE_WORDS[lang].split()))])
    return F.size(F.filter(words, lambda w: F.array_contains(listed, w)))


def language_flag(text: Column | str) -> Column:
    """True when a text counts as English: short texts pass, others fail only if another language clearly wins."""
    words = language_words(text)
    english = _hits(words, "en")
    other = F.greatest(*[_hits(words, lang) for lang in LANGUAGE_WORDS if lang != "en"])
    return (F.size(words) < 3) | ~((other >= 2) & (other > english))


def keyword_annotator(
    text: Column | str,
    positive: tuple[str, ...] = POSITIVE_CUES,
    negative: tuple[str, ...] = NEGATIVE_CUES,
) -> Column:
    """Rule label from cue substrings: both sides MIXED, one side wins, none NEUTRAL."""
    low = F.lower(_filled(text))

    def any_of(cues: tuple[str, ...]) -> Column:
        hit = F.lit(False)
        for cue in cues:
            hit = hit | low.contains(cue)
        return hit

    pos, neg = any_of(positive), any_of(negative)
    return F.when(pos & neg, "MIXED").when(pos, "POSITIVE").when(neg, "NEGATIVE").otherwise("NEUTRAL")


def parse_label_reply(raw: Column | str, allowed: tuple[str, ...] = LABELS, reason_chars: int = 300) -> Column:
    """Struct (label, reason) from a free-form reply.

    Reasoning blocks are dropped; of the brace-delimited objects the last one that parses and
    carries an allowed label wins. Labels are trimmed and upper-cased.
    """
    body = F.regexp_replace(_filled(raw), r"(?s)<think>.*?</think>", "")
    objects = F.regexp_extract_all(body, F.lit(r"\{[^{}]*\}"), F.lit(0))
    parsed = F.transform(objects, lambda o: F.from_json(o, "label string, reason string"))
    cleaned = F.transform(
        parsed,
        lambda p: F.struct(
            F.upper(F.trim(p["label"])).alias("label"),
            F.substring(F.coalesce(p["reason"], F.lit("")), 1, reason_chars).alias("reason"),
        ),
    )
    valid = F.filter(cleaned, lambda p: p["label"].isin(*allowed))
    return F.try_element_at(valid, F.lit(-1))
