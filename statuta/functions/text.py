"""Text columns: tokens, keys, cleaning."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from statuta.functions import fixed_values as V

SPACE = r"[\s\p{Z}]+"


def naming(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, also where a lambda uses it per element."""
    return F.transform(F.array(value), body)[0]


def any_of(text: Column, phrases: list[str]) -> Column:
    """True when any phrase occurs in ``text``."""
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(p)) for p in phrases], F.lit(False))


def all_of(text: Column, phrases: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.contains(text, F.lit(p)) for p in phrases], F.lit(True))


def words(text: Column) -> Column:
    """Whitespace words, none empty."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def tokens(text: Column, pattern: str = V.VI_TOKEN_RUNS) -> Column:
    """Lower-case tokens; a text without any falls back to its whitespace words."""
    low = F.lower(text)
    found = F.regexp_extract_all(low, F.lit(pattern), F.lit(0))
    return naming(found, lambda f: F.when(F.size(f) > 0, f).otherwise(words(low)))


def strip(text: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(text, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def collapsed(text: Column) -> Column:
    """White space collapsed, lower case, trimmed: the key of a repeated question."""
    return F.regexp_replace(F.lower(strip(F.coalesce(text, F.lit("")))), SPACE, " ")


def bare_key(text: Column) -> Column:
    """Letters and digits only, lower case."""
    return F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}\p{N}]+", ""))


def dense_key(text: Column, length: int = 200) -> Column:
    """Lower case without white space, first ``length`` characters."""
    return F.left(F.regexp_replace(F.lower(text), SPACE, ""), F.lit(length))


def collapsed_key(text: Column, length: int = 500) -> Column:
    return F.left(collapsed(text), F.lit(length))


def single_pass_spaces(text: Column) -> Column:
    """Carriage returns go; each pair of blanks or of line ends becomes one, once."""
    out = F.replace(text, F.lit("\r"), F.lit(""))
    out = F.replace(out, F.lit("  "), F.lit(" "))
    return strip(F.replace(out, F.lit("\n\n"), F.lit("\n")))


def repaired(text: Column, replacements: list[tuple[str, str]] = V.OCR_REPLACEMENTS) -> Column:
    """Ordered repair of reading errors."""
    out = text
    for pattern, replacement in V.REPAIRS_BEFORE:
        out = F.regexp_replace(out, pattern, replacement)
    for wrong, right in replacements:
        out = F.replace(out, F.lit(wrong), F.lit(right))
        out = F.replace(out, F.lit(wrong.lower()), F.lit(right.lower()))
    for pattern, replacement in V.REPAIRS_AFTER:
        out = F.regexp_replace(out, pattern, replacement)
    return out


def guarded(original: Column, corrected: Column) -> Column:
    """The corrected text where it can be trusted, else the original."""
    n = F.size(words(original))
    length = F.length(original)
    ok = (
        (n > 3)
        & (n <= 400)
        & (F.length(strip(original)) >= 3)
        & (F.length(corrected) >= length * 0.5)
        & (F.length(corrected) <= length * 1.5)
    )
    return F.when(F.coalesce(ok, F.lit(False)), strip(corrected)).otherwise(original)


def tidied(text: Column) -> Column:
    """White space and punctuation rules applied after something was cut out."""
    out = strip(F.regexp_replace(text, SPACE, " "))
    for pattern, replacement in V.TIDY_PATTERNS:
        out = F.regexp_replace(out, pattern, replacement)
    return out


def without_title(text: Column, title: Column) -> tuple[Column, Column]:
    """(text without its title, whether it held it)."""
    held = F.coalesce((text != "") & (title != "") & F.contains(text, title), F.lit(False))
    return F.when(held, tidied(F.replace(text, title, F.lit("")))).otherwise(text), held


def token_estimate(text: Column) -> Column:
    """Rough token count: 1.5 characters each."""
    return F.floor(F.length(text) / F.lit(1.5)).cast("long")


def weird_count(text: Column) -> Column:
    """Number of characters outside the allowed set."""
    return F.length(F.regexp_replace(text, f"[{V.ALLOWED_CHARS}]", "")).cast("long")
