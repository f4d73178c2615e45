"""Scalar text expressions: all of them built-in functions, inside one projection."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import SUFFIXES

#: What is neither a letter, a digit, an underscore nor white space, in any script.
_PUNCTUATION = r"[^\p{L}\p{M}\p{N}_\s]"
ARTICLES = ("the", "a", "an")

# Letters that become several letters, and alphabets without a decomposition.
_SEVERAL = {"ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "þ": "th", "Þ": "Th", "ж": "zh", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ю": "iu", "я": "ia"}
_PLAIN_FROM = "øØłŁđĐðÐıабвгдеёзийклмнопрстуфыэъьαβγδεζηικλμνξοπρστυφω"
_PLAIN_TO = "oOlLdDdDiabvgdeeziiklmnoprstufye''abgdeziiklmnxoprstufo"


def _accents() -> tuple[str, str]:
    """Accented letters and the letter each decomposes to."""
    pairs = [(chr(c), unicodedata.normalize("NFKD", chr(c))[0]) for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))]
    pairs = [(a, b) for a, b in pairs if a != b and b.isascii() and b.isalpha()]
    return "".join(a for a, _ in pairs) + _PLAIN_FROM, "".join(b for _, b in pairs) + _PLAIN_TO


_FROM, _TO = _accents()


def squeeze(text: Column) -> Column:
    """Lower case, punctuation to blanks, white space runs to one blank."""
    spaced = F.regexp_replace(F.lower(text), _PUNCTUATION, " ")
    return F.trim(F.regexp_replace(spaced, r"[\s ]+", " "))


def normalize(name: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    """Squeezed name without suffix words wherever they stand, unless nothing would remain; null gives the empty string."""
    plain = squeeze(F.coalesce(name, F.lit("")))
    kept = F.array_join(F.filter(F.split(plain, " "), lambda w: ~w.isin(*suffixes)), " ")
    return F.when(kept == "", plain).otherwise(kept)


def fold(text: Column) -> Column:
    """Transliteration to ASCII letters: accents dropped, Cyrillic and Greek spelled out."""
    for letter, spelled in _SEVERAL.items():
        text = F.replace(text, F.lit(letter), F.lit(spelled))
        if letter.upper() != letter and len(letter.upper()) == 1 and letter.upper() not in _SEVERAL:
            text = F.replace(text, F.lit(letter.upper()), F.lit(spelled.capitalize()))
    upper_from = "".join(c.upper() for c in _PLAIN_FROM if len(c.upper()) == 1 and c.upper() not in _FROM)
    upper_to = "".join(_PLAIN_TO[_PLAIN_FROM.index(c)].upper() for c in _PLAIN_FROM if len(c.upper()) == 1 and c.upper() not in _FROM)
    return F.regexp_replace(F.translate(text, _FROM + upper_from, _TO + upper_to), r"\p{M}+", "")


def blocking_form(name: Column) -> Column:
    """Folded and squeezed name; suffixes stay."""
    return squeeze(fold(F.coalesce(name, F.lit(""))))


def first_token(form: Column) -> Column:
    """First word that is not an article, else empty."""
    return F.coalesce(F.get(F.filter(F.split(form, " "), lambda w: ~w.isin(*ARTICLES) & (w != "")), F.lit(0)), F.lit(""))


def words(text: Column) -> Column:
    return F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def capitals(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^\p{Lu}]", ""))


def jaccard(a: Column, b: Column) -> Column:
    """Of two word arrays; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def is_subset(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0


def pair_key(a: Column, b: Column) -> tuple[Column, Column]:
    """The pair in binary order, so either orientation finds the same row."""
    return F.least(a, b), F.greatest(a, b)


def confidence_level(score: Column) -> Column:
    return F.when(score >= 0.9, "HIGH").when(score >= 0.7, "MEDIUM").otherwise("LOW")


def reasoning(original: Column, canonical: Column, confidence: Column) -> Column:
    matched = F.concat(F.lit("Matched to '"), canonical, F.lit("' with "), F.format_string("%.2f", confidence * 100), F.lit("% confidence"))
    return F.when(original == canonical, "Selected as canonical name").otherwise(matched)


def has_extension(filename: Column, *extensions: str) -> Column:
    ok = F.lit(False)
    for e in extensions:
        ok = ok | F.lower(filename).endswith(e.lower())
    return ok


def contains_text(term: str, *columns: Column) -> Column:
    """Case-insensitive substring of any of the columns."""
    ok = F.lit(False)
    for c in columns:
        ok = ok | F.contains(F.lower(c), F.lit(term.lower()))
    return ok


def percent(value: Column, digits: int = 1) -> Column:
    return F.concat(F.format_string(f"%.{digits}f", value * 100), F.lit("%"))


def thousands(value: Column) -> Column:
    return F.format_number(value, 0)


def display_time(timestamp: Column) -> Column:
    return F.date_format(timestamp, "yyyy-MM-dd HH:mm")


def to_distance(threshold: Column) -> Column:
    """Similarity threshold (a share, or a percentage above 1) as a distance."""
    return 1 - F.when(threshold > 1, threshold / 100).otherwise(threshold)


def fenced_json(content: Column) -> Column:
    """The body of the first fenced block (json or plain), else the whole text."""
    tagged = F.regexp_extract(content, r"(?s)```json(.*?)(?:```|$)", 1)
    plain = F.regexp_extract(content, r"(?s)```(.*?)(?:```|$)", 1)
    return F.trim(F.when(F.contains(content, F.lit("```json")), tagged).when(F.contains(content, F.lit("```")), plain).otherwise(content))
