"""Phonetic codes and letter-by-letter romanisation, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import arabic_strict, replaced, squeezed

#: Latin letters of Arabic ones.
LETTERS = {
    "ء": "'", "أ": "a", "إ": "i", "آ": "aa", "ؤ": "o", "ئ": "e", "ا": "a", "ى": "a", "ب": "b", "ت": "t", "ث": "th", "ج": "j",
    "ح": "h", "خ": "kh", "د": "d", "ذ": "dh", "ر": "r", "ز": "z", "س": "s", "ش": "sh", "ص": "s", "ض": "d", "ط": "t", "ظ": "z",
    "ع": "a", "غ": "gh", "ف": "f", "ق": "q", "ك": "k", "ل": "l", "م": "m", "ن": "n", "ه": "h", "ة": "a", "و": "o", "ي": "y",
}
#: Where the name converter differs, and the vowel marks that it spells out.
SPOKEN = LETTERS | {"إ": "e", "ي": "i", "ً": "", "ٌ": "", "ٍ": "", "َ": "a", "ُ": "u", "ِ": "i", "ّ": "", "ْ": ""}


def code(c: Column, y_before_vowel_only: bool = False) -> Column:
    """A metaphone-like code; ``y_before_vowel_only`` drops a Y that no vowel follows."""
    steps = [
        ("[^A-Z]", " "), ("SH", "x"), ("TH", "0"), ("C(?=[EIY])", "s"), ("C", "k"), ("G(?=[EIY])", "j"), ("G", "k"), ("X", "ks"),
        *([("Y(?=[AEIOU])", "y"), ("Y", "")] if y_before_vowel_only else [("Y", "y")]),
        ("^[AEIOU]", "a"), ("[AEIOU]", ""),
    ]
    coded = F.translate(replaced(F.upper(F.coalesce(c, F.lit(""))), steps), "BDQVZ", "PTKFS")
    return F.replace(F.upper(coded), F.lit(" "), F.lit(""))


def _mapped(c: Column, letters: dict[str, str]) -> Column:
    table = F.create_map(*(F.lit(x) for pair in letters.items() for x in pair))
    each = F.transform(F.split(c, ""), lambda ch: F.coalesce(F.try_element_at(table, ch), F.when(ch.rlike(r"^[\x00-\x7F]$"), ch).otherwise("")))
    return F.initcap(squeezed(F.array_join(each, "")))


def arabic_to_latin(c: Column) -> Column:
    return _mapped(arabic_strict(c), LETTERS)


def spoken(c: Column) -> Column:
    return _mapped(F.coalesce(c, F.lit("")), SPOKEN)
