"""Text and key functions, all built from JVM-side expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"\p{L}+"
# A negated concept name starts with one of these words.
NEGATIONS = ("not", "no", "without")


def norm_name(c: Column) -> Column:
    """Matching key of a name: lower case, every run of other characters to one space, trimmed; null to ''."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c.cast("string"), F.lit(""))), "[^a-z0-9]+", " "))


def norm_id(c: Column) -> Column:
    """Identifier as text: trimmed, a whole number written as a float loses its '.0'; null to ''."""
    return F.regexp_replace(F.trim(F.coalesce(c.cast("string"), F.lit(""))), r"^(\d+)\.0$", "$1")


def first_nonempty(cols: Sequence[Column]) -> Column:
    """First of several columns that is not blank, else ''."""
    filled = [F.when(F.trim(c.cast("string")) != "", c.cast("string")) for c in cols]
    return F.coalesce(*filled, F.lit(""))


def safe_name(c: Column) -> Column:
    """Name fit for a path: runs outside letters, digits, '_', '-', '.' become one '_'."""
    return F.regexp_replace(F.regexp_replace(c.cast("string"), r"[^\w.\-]+", "_"), "^_+|_+$", "")


def words(c: Column) -> Column:
    """Lower-case words (runs of letters of any script) in text order."""
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), 0)


def split_trim(c: Column, sep_regex: str, trim: bool = True) -> Column:
    """Delimited text to an array; blanks around the parts are dropped unless ``trim`` is off."""
    # one split with the blanks in the pattern: no lambda, so equal plans stay comparable and exchanges reusable
    return F.split(F.trim(c), rf"\s*{sep_regex}\s*") if trim else F.split(c, sep_regex)


def term_grams(term: Column, n: int = 3) -> Column:
    """Distinct character n-grams of a term with one blank before and behind it, in order; one pass over its characters."""
    return F.array_distinct(F.regexp_extract_all(F.concat(F.lit(" "), term, F.lit(" ")), F.lit(f"(?s)(?=({'.' * n}))"), 1))


def is_negated(name: Column, negations: Sequence[str] = NEGATIONS) -> Column:
    """True when the name starts with a negation word."""
    low = F.lower(name)
    hit = F.lit(False)
    for word in negations:
        hit = hit | low.startswith(word + " ")
    return hit


# --- fixed values: patterns of bold spans, heading marks, links and bare URLs ---
BOLD = r"\*\*.*?\*\*"
HASHES = "#+"
MARKDOWN_LINK = r"\[([^\]]+)\]\(https?://[^)]+\)"
BARE_URL = r"https?://\S+"


def clean_markdown(c: Column) -> Column:
    """Drop bold spans together with their text, and heading marks; trim."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, BOLD, ""), HASHES, ""))


# A parenthesis that holds only host names.
_HOST = r"[\w.\-]+\.[a-z]{2,}"
HOST_LIST = rf"\(\s*{_HOST}(?:[,\s]\s*{_HOST})*,?\s*\)"


def remove_links(c: Column) -> Column:
    """Markdown link to its label, then bare URLs and parenthesised host lists removed."""
    bare = F.regexp_replace(F.regexp_replace(c, MARKDOWN_LINK, "$1"), BARE_URL, "")
    return F.regexp_replace(bare, HOST_LIST, "")


def domain(url: Column) -> Column:
    """Host part of an http(s) URL, '' when there is none."""
    return F.regexp_extract(url, r"https?://([^/]+)", 1)


def sentence_count(c: Column) -> Column:
    """Number of sentences: pieces between '.', '!', '?' or line ends that hold at least one letter or digit."""
    pieces = F.split(c, r"[.!?\n]+")
    return F.size(F.filter(pieces, lambda s: s.rlike(r"[\p{L}\p{N}]")))


VOWEL_RUN = "[aeiouyàâäáéèêëíìîïóòôöúùûü]+"


def polysyllable_count(c: Column, syllables: int = 3) -> Column:
    """Number of words with at least ``syllables`` runs of vowels (an approximation of syllables).

    One regex pass: a word qualifies when it holds ``syllables`` vowel runs separated by other letters.
    """
    vowel = VOWEL_RUN[:-1]
    other = "[^" + vowel[1:-1] + r"\P{L}]"
    run = rf"{other}*{vowel}+"
    pattern = rf"{run}(?:{other}+{vowel}+){{{syllables - 1}}}{other}*\p{{L}}*"
    return F.regexp_count(F.lower(c), F.lit(pattern))
