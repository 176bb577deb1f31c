"""Text clean-up, language guess, tokens and labels as native column expressions."""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stop words of the language guess.
FRENCH_STOPS = [
    "le", "la", "les", "des", "un", "une", "et", "ou", "de", "du", "au", "aux", "est", "avec",
    "sans", "pour", "sur", "dans", "pas", "ne", "à", "été", "entre", "proche",
]
ENGLISH_STOPS = [
    "the", "and", "or", "of", "to", "with", "without", "for", "on", "in", "is", "are", "was",
    "were", "near", "soon", "due", "fault", "error", "failure", "leak", "overheating",
]

# Outcome names shown to users.
CRITICAL = "Critique"
NOT_CRITICAL = "Pas critique"

OUTER_SPACE = r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z"
SPACE, NO_SPACE = r"(?U)[\s\x1c-\x1f]", r"(?U)[^\s\x1c-\x1f]"
# What ``clip_text`` leaves something of.
ANY_TEXT = r"(?U)[^\s\x00\x1c-\x1f]"


@cache
def _fold_tables() -> tuple[str, str, list[tuple[str, str]]]:
    """Characters whose compatibility decomposition leaves ASCII behind.

    Returns the one-to-one part as two aligned strings and the rest as pairs. Digits and
    punctuation become blanks later anyway, so they are blank here already, which makes most
    multi-character cases one-to-one."""
    source, target, expand = [], [], []
    for code in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= code <= 0xDFFF:
            continue
        char = chr(code)
        ascii_part = unicodedata.normalize("NFKD", char).encode("ascii", "ignore").decode()
        if not ascii_part:
            continue
        plain = "".join(c if c.isalpha() or c == "_" else " " for c in ascii_part.lower())
        plain = " " if plain.isspace() else plain
        if len(plain) == 1:
            source.append(char)
            target.append(plain)
        else:
            expand.append((char, plain))
    return "".join(source), "".join(target), expand


def _char_class(chars: list[str]) -> str:
    """A regex class of these characters, runs of neighbours as ranges."""
    codes = sorted(map(ord, chars))
    starts = [c for c in codes if c - 1 not in codes]
    ends = [c for c in codes if c + 1 not in codes]
    return "[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in zip(starts, ends)) + "]"


def fold_letters(c: Column) -> Column:
    """Accents stripped, ligatures and unit signs spelled out, other non-ASCII dropped.

    Letters of the folded characters come out in lower case, because ``clean_text`` lowers
    them next. Pure ASCII texts, found by comparing byte and character counts, are left alone,
    and the spelled-out characters are looked for among the non-ASCII ones only."""
    source, target, expand = _fold_tables()
    pairs = F.split(F.lit("\n".join(a + b for a, b in expand)), "\n")  # a character and its spelling each
    rare = F.regexp_replace(c, r"[\x00-\x7F]+", "").rlike(_char_class([a for a, _ in expand]))
    spelled = F.aggregate(
        F.when(rare, pairs).otherwise(F.array().cast("array<string>")), c,
        lambda text, pair: F.replace(text, F.left(pair, F.lit(1)), F.substring(pair, 2, 8)))
    folded = F.regexp_replace(F.translate(spelled, source, target), r"[^\x00-\x7F]+", "")
    return F.when(F.octet_length(c) == F.char_length(c), c).otherwise(folded)


def fold_single(c: Column) -> Column:
    """The first part of ``fold_letters``: characters that one letter or blank stands for."""
    source, target, _ = _fold_tables()
    return F.when(F.octet_length(c) == F.char_length(c), c).otherwise(F.translate(c, source, target))


def clean_text(c: Column) -> Column:
    """Null to empty, accents folded, lower case, anything but letters and ``_`` to one blank."""
    blanked = F.regexp_replace(F.lower(fold_letters(ensure_str(c))), "[^a-z_]+", " ")
    return F.trim(blanked)


def plain_lower(c: Column) -> Column:
    return F.lower(c)


def ensure_str(c: Column, floating: bool = False) -> Column:
    """Null to the empty string, anything else to text; not-a-number of a float column is null."""
    return F.coalesce(F.when(~F.isnan(c), c.cast("string")) if floating else c.cast("string"), F.lit(""))


def guess_language(c: Column) -> Column:
    """``en`` when more distinct English than French stop words stand between single blanks."""
    words = F.split(F.lower(ensure_str(c)), " ")

    def hits(stops: list[str]) -> Column:
        return F.size(F.array_intersect(words, F.array(*[F.lit(w) for w in stops])))

    return F.when(hits(ENGLISH_STOPS) > hits(FRENCH_STOPS), "en").otherwise("fr")


def clip_text(c: Column, max_chars: int | None = None) -> Column:
    """Without NUL characters and outer white space, at most ``max_chars`` long (None: whole)."""
    whole = F.replace(ensure_str(c), F.lit("\x00"), F.lit(""))
    # most texts have no outer space, and the pattern would try every inner one
    ends = F.concat(F.left(whole, F.lit(1)), F.right(whole, F.lit(1)))
    bare = F.when(ends.rlike(SPACE), F.regexp_replace(whole, OUTER_SPACE, "")).otherwise(whole)
    return bare if max_chars is None else F.substring(bare, 1, max_chars)


def decision_label(proba: Column, threshold: float = 0.5) -> Column:
    return F.when(proba >= threshold, CRITICAL).otherwise(NOT_CRITICAL)


def confidence_percent(proba: Column) -> Column:
    return F.round(proba * 100, 1)


def words(cleaned: Column) -> Column:
    """Words of at least two characters of a cleaned text, in order."""
    return F.filter(F.split(cleaned, " "), lambda w: F.char_length(w) >= 2)


def word_ngrams(tokens: Column, low: int = 1, high: int = 2) -> Column:
    """All n-grams of a token array for n in ``low..high``, joined by a blank."""
    parts = []
    for n in range(low, high + 1):
        grams = tokens
        for extra in range(1, n):
            room = F.greatest(F.size(tokens) - extra, F.lit(0))
            grams = F.zip_with(
                F.slice(grams, F.lit(1), room),
                F.slice(tokens, F.lit(1 + extra), room),
                lambda left, right: F.concat(left, F.lit(" "), right),
            )
        parts.append(grams)
    return parts[0] if len(parts) == 1 else F.concat(*parts)
