"""Machine-readable zones of passports (two lines of 44), as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dates import mrz_date


_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A letter's value modulo 10; A is 10.
_UNITS = "".join(str(i % 10) for i in range(len(_LETTERS)))


def check_digit(data: Column, length: int) -> Column:
    """Weights 7, 3, 1 over the values of ``length`` characters, modulo 10.

    Only the last digit of a value matters, so characters are mapped to digits. The mapped text is bound
    once, as the only element of an array, and the sum over its places is written out.
    """
    units = F.rpad(F.regexp_replace(F.translate(F.upper(data), _LETTERS, _UNITS), "[^0-9]", "0"), length, "0")

    def total(u: Column) -> Column:
        out = F.lit(0)
        for i in range(length):
            out = out + (F.ascii(F.substring(u, i + 1, 1)) - 48) * (7, 3, 1)[i % 3]
        return (out % 10).cast("string")

    return F.get(F.transform(F.array(units), total), F.lit(0))


def fit(line: Column) -> Column:
    """Padded or cut to 44 characters."""
    return F.rpad(F.upper(F.trim(line)), 44, "<")


def parse(line1: Column, line2: Column, expiry_pivot: int = 40) -> Column:
    """All fields of both lines; null where a line does not have 44 characters."""
    a, b = F.upper(line1), F.upper(line2)
    part = lambda line, begin, n: F.substring(line, begin, n)
    bare = lambda c: F.trim(F.replace(c, F.lit("<"), F.lit("")))
    spaced = lambda c: F.trim(F.replace(F.coalesce(c, F.lit("")), F.lit("<"), F.lit(" ")))
    names = F.split(part(a, 6, 39), "<<")
    surname, given = spaced(F.get(names, F.lit(0))), spaced(F.get(names, F.lit(1)))
    ok = {
        "passport": check_digit(part(b, 1, 9), 9) == part(b, 10, 1),
        "dob": check_digit(part(b, 14, 6), 6) == part(b, 20, 1),
        "expiry": check_digit(part(b, 22, 6), 6) == part(b, 28, 1),
        "composite": check_digit(F.concat(part(b, 1, 10), part(b, 14, 7), part(b, 22, 22)), 39) == part(b, 44, 1),
    }
    valid = ok["passport"] & ok["dob"] & ok["expiry"] & ok["composite"]
    fields = F.struct(
        part(a, 1, 1).alias("document_type"), part(a, 3, 3).alias("issuing_country"), surname.alias("surname"), given.alias("given_names"),
        F.trim(F.concat_ws(" ", given, surname)).alias("full_name"), bare(part(b, 1, 9)).alias("passport_number"), part(b, 11, 3).alias("nationality"),
        mrz_date(part(b, 14, 6)).alias("date_of_birth"), F.when(part(b, 21, 1) == "M", "Male").when(part(b, 21, 1) == "F", "Female").alias("gender"),
        mrz_date(part(b, 22, 6), expiry_pivot).alias("expiry_date"), F.nullif(bare(part(b, 29, 14)), F.lit("")).alias("personal_number"),
        *(v.alias(f"{k}_ok") for k, v in ok.items()), valid.alias("valid"), F.when(valid, 0.99).otherwise(0.85).alias("confidence"),
    )
    return F.when((F.length(line1) == 44) & (F.length(line2) == 44), fields)
