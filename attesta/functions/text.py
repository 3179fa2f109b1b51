"""Normalisers and tokenisers for names and places in Arabic and Latin script, as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ARABIC = r"[؀-ۿ]"
LATIN = "[a-zA-Z]"
#: Alef forms to bare alef, taa marbuta to haa, alef maqsura to yaa.
FOLD_FROM, FOLD_TO = "أإآةى", "اااهي"
#: The marks that the strict normaliser drops besides tatweel.
MARKS = "ًٌٍَُِّْٰـ"
#: Arabic-Indic and Eastern digits, and what they fold to.
DIGITS_FROM, DIGITS_TO = "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹", "01234567890123456789"
#: Compound prefixes, in order; each is set apart where the article follows.
ARABIC_PREFIXES = ("عبد", "ابن", "بن", "ابو", "أبو", "ام", "أم")
ARTICLE = "ال"
#: Ordered compound patterns of English names.
ENGLISH_COMPOUNDS = (
    ("abdulrahman", "abdul rahman"), ("abdulaziz", "abdul aziz"), ("abdulmalik", "abdul malik"), ("abdulkarim", "abdul karim"),
    ("abdullatif", "abdul latif"), ("abdullah", "abd allah"), ("abdallah", "abd allah"), ("abdelmajid", "abd el majid"),
    ("abdelrahman", "abd el rahman"), ("abdul", "abd al"), ("abdel", "abd el"),
)
#: Ordered Latin prefixes; the first two swallow what the next three would split.
LATIN_PREFIXES = (
    (r"\babdul\s*", "abd al "), (r"\babdel\s*", "abd el "), (r"\babdullah\b", "abd allah"), (r"\babdulrahman\b", "abd alrahman"),
    (r"\babdulaziz\b", "abd alaziz"), (r"\bibn\s*", "ibn "), (r"\bbin\s*", "bin "), (r"\babu\s*", "abu "),
)


def replaced(c: Column, steps: list[tuple[str, str]]) -> Column:
    """Regular expressions applied one after another."""
    return reduce(lambda x, s: F.regexp_replace(x, *s), steps, c)


def squeezed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def folded(c: Column) -> Column:
    return F.translate(c, FOLD_FROM, FOLD_TO)


def place_text(c: Column) -> Column:
    return squeezed(F.regexp_replace(folded(F.coalesce(c, F.lit(""))), r"[ً-ٟ]", ""))


def arabic_name(c: Column) -> Column:
    return F.regexp_replace(place_text(c), r"[^a-zA-Z؀-ۿݐ-ݿࢠ-ࣿـ\s\-]", "")


def arabic_strict(c: Column) -> Column:
    bare = F.translate(folded(F.coalesce(c, F.lit(""))), MARKS, "")
    return F.regexp_replace(squeezed(bare), r"[^؀-ۿ\s0-9]", "")


def latin(c: Column) -> Column:
    bare = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"(?U)[^\w\s]", "")
    return squeezed(replaced(bare, [("aa+", "a"), ("oo+", "o"), ("ee+", "i"), ("ii+", "i"), ("uu+", "u")]))


def english_name(c: Column) -> Column:
    bare = F.regexp_replace(squeezed(F.lower(F.coalesce(c, F.lit("")))), r"[^a-z\s\-]", "")
    apart = replaced(bare, [(rf"\b{a}\b", b) for a, b in ENGLISH_COMPOUNDS])
    return squeezed(replaced(apart, [(r"\bal-", "al "), (r"\bel-", "el "), (r"\bal([a-z]{3,})\b", "al $1")]))


def plain_digits(c: Column) -> Column:
    return F.translate(c, DIGITS_FROM, DIGITS_TO)


def tokens(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda t: t != "")


def arabic_tokens(c: Column) -> Column:
    return tokens(replaced(arabic_strict(c), [(f"{p}({ARTICLE})", f"{p} $1") for p in ARABIC_PREFIXES]))


def latin_tokens(c: Column) -> Column:
    return tokens(replaced(latin(c), list(LATIN_PREFIXES)))


def place_tokens(c: Column) -> Column:
    """Trimmed parts between separators, in order, each once."""
    parts = F.transform(F.split(c, "[-–—/،,]"), lambda t: F.trim(t))
    return F.array_distinct(F.filter(parts, lambda t: t != ""))


def same_token_set(a: Column, b: Column) -> Column:
    return (F.size(a) > 0) & (F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b)))


def has_arabic(c: Column) -> Column:
    return F.coalesce(c.rlike(ARABIC), F.lit(False))


def has_latin(c: Column) -> Column:
    return F.coalesce(c.rlike(LATIN), F.lit(False))


def count(c: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(pattern)), F.lit(0))


def text_language(c: Column) -> Column:
    """``ar`` where Arabic letters outnumber Latin ones, else ``en``."""
    return F.when(count(c, ARABIC) > count(c, LATIN), "ar").otherwise("en")


def language_label(code: Column) -> Column:
    """A language's name; an unknown code stays as it is."""
    return F.when(code == "en", "English").when(code == "ar", "Arabic").otherwise(code)


def name_language(c: Column) -> Column:
    """By share of letters: 60 % or more of one script, ``mixed`` in between, ``unknown`` without letters."""
    a, b = count(c, "[؀-ۿݐ-ݿ]"), count(c, LATIN)
    share = a / F.nullif(a + b, F.lit(0))
    return F.when(share.isNull(), "unknown").when(share >= 0.6, "arabic").when(share <= 0.4, "english").otherwise("mixed")


def mostly_digits(c: Column) -> Column:
    return (F.length(c) == 0) | (count(c, r"\p{Nd}") > F.length(c) * 0.5)


def name_parts(c: Column) -> Column:
    """First, second, third and family name: the third if there are three, else the last of four or more."""
    t = tokens(squeezed(c))
    return F.struct(
        F.get(t, F.lit(0)).alias("first"), F.get(t, F.lit(1)).alias("second"), F.get(t, F.lit(2)).alias("third"),
        F.when(F.size(t) >= 4, F.element_at(t, -1)).when(F.size(t) == 3, F.get(t, F.lit(2))).alias("family"),
    )


def split_name(c: Column) -> Column:
    """First, middle (all between), last."""
    t = tokens(squeezed(c))
    n = F.size(t)
    middle = F.when(n > 2, F.array_join(F.slice(t, 2, F.greatest(F.lit(1), n - 2)), " ")).otherwise("")
    return F.struct(F.coalesce(F.get(t, F.lit(0)), F.lit("")).alias("first"), middle.alias("middle"), F.when(n > 1, F.element_at(t, -1)).otherwise("").alias("last"))
