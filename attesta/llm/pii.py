"""Personal data by pattern, checksum and context, in DataFrame functions only.

A regular expression proposes spans of each kind, leftmost and without overlap. Checksums and ranges
confirm them: Luhn for cards, ISO 7064 mod-97 for IBANs, parts of at most 255 for IP addresses, digit
counts for phones. Words near a span raise its score; kinds that are weak by pattern alone (13-digit
cards, phones without a country code, social security numbers) count only if such a word stands close.
E-mail, IP, card and phone of the base contract are always reported.

Where a span begins follows from the lengths of the pieces between matches and of the matches before
it, summed in runs of about the square root of their number, so offsets are code points and a text of very
many matches stays cheap. Context words are looked for within ``near`` code points, no further than
the second match of the kind on either side. The expressions use possessive quantifiers and look at what stands
before a run of characters, which keeps them linear and free of deep recursion on long runs.

Null texts count as empty. Repeated rows, extra columns and empty tables need nothing special: each row
is judged by itself, in one scan without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOCAL, LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits has a valid check digit."""
    def add(total: Column, i: Column) -> Column:
        digit = F.substring(number, F.length(number) - i, F.lit(1)).cast("int")
        twice = digit * 2
        return total + F.when(i % 2 == 0, digit).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(0), F.length(number) - 1), F.lit(0), add) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN without blanks leaves remainder 1."""
    turned = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, F.lit(1), F.lit(4)))

    def add(rest: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code >= 65, rest * 100 + code - 55).otherwise(rest * 10 + code - 48) % 97

    return F.aggregate(F.split(turned, ""), F.lit(0), lambda rest, c: F.when(c == "", rest).otherwise(add(rest, c))) == 1


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    confirm: Callable[[Column], Column]
    words: str  # context words
    base: float  # score by pattern and checksum
    hint: str | None = None  # a text without this character has no match


def parts_fit(m: Column) -> Column:
    return F.forall(F.split(m, r"\."), lambda p: p.rlike("^0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])$"))


def phone_digits(m: Column) -> Column:
    return F.length(digits(m)).between(10, 15)


def always(m: Column) -> Column:
    return F.lit(True)


_RUN = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){%s}+(?![\x20-]?[0-9])"
CARD_WORDS = r"(?:card|visa|mastercard|amex|credit|debit|karte|carte|tarjeta)"
PHONE_WORDS = r"(?:phone|tel|call|mobile|fax|telefon|téléphone|teléfono)"
#: A run of 14 to 19 digits is what the contract's greedy pattern yields there: the look-around only
#: keeps a search from starting inside a longer run.
KINDS = (
    Kind("email", rf"(?:(?<!{LOCAL})|\G){LOCAL}++@{LABEL}++(?:\.{LABEL}++)++", always, r"(?:mail|contact|kontakt|correo)", 0.9, "@"),
    Kind("ip", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", parts_fit, r"(?:\bip\b|address|host|server)", 0.7),
    Kind("card", _RUN % "13,18", lambda m: luhn(digits(m)), CARD_WORDS, 0.8),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", phone_digits, PHONE_WORDS, 0.7, "+"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+(?![A-Za-z0-9])", lambda m: mod97(F.regexp_replace(m, " ", "")), r"(?:iban|konto|account|compte|cuenta)", 0.9),
    Kind("card13", _RUN % "12", lambda m: luhn(digits(m)), CARD_WORDS, 0.3),
    Kind("local_phone", r"(?<![0-9+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])", always, PHONE_WORDS, 0.3),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", always, r"(?:ssn|social|security)", 0.3),
)
BASE = ("email", "ip", "card", "phone")


def running_sums(x: Column) -> Column:
    """The sums of a bound array's first elements: of runs of about the root of its size, then within each."""
    plus = lambda a, b: a + b
    total = lambda part: F.aggregate(part, F.lit(0), plus)
    width = F.ceil(F.sqrt(F.size(x))).cast("int")
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / width).cast("int")), lambda k: F.slice(x, k * width + 1, width))

    def within(r: Column, totals: Column) -> Column:
        add = lambda run, before: F.transform(run, lambda _, j: before + total(F.slice(run, F.lit(1), j + 1)))
        return F.flatten(F.transform(r, lambda run, k: let(total(F.slice(totals, F.lit(1), k)), lambda before: add(run, before))))

    return let(runs, lambda r: let(F.transform(r, total), lambda totals: within(r, totals)))


def matches_of(text: Column, kind: Kind, number: int, near: int) -> Column:
    """Confirmed matches as structs: start, kind's number, end, match, score."""
    empty = F.array().cast("array<string>")
    found = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    if kind.hint:
        found = F.when(F.contains(text, F.lit(kind.hint)), found).otherwise(empty)

    def placed(m: Column, pieces: Column) -> Column:
        """A match begins after the pieces up to it and the matches before it."""
        steps = F.transform(m, lambda _, i: F.length(F.get(pieces, i)) + F.when(i > 0, F.length(F.get(m, i - 1))).otherwise(0))
        left = lambda i: F.coalesce(F.left(F.get(pieces, i), F.lit(near)), F.lit(""))
        right = lambda i: F.coalesce(F.right(F.get(pieces, i), F.lit(near)), F.lit(""))
        other = lambda i: F.coalesce(F.get(m, i), F.lit(""))
        ahead = lambda i: F.when(F.length(F.get(pieces, i)) >= near, right(i)).otherwise(F.right(F.concat(right(i - 1), other(i - 1), F.get(pieces, i)), F.lit(near)))
        behind = lambda i: F.when(F.length(F.get(pieces, i)) >= near, left(i)).otherwise(F.left(F.concat(F.get(pieces, i), other(i), left(i + 1)), F.lit(near)))
        context = lambda i: F.concat(ahead(i), F.lit(" "), behind(i + 1))
        one = lambda x, i, at: F.struct(at.alias("start"), F.lit(number).alias("kind"), (at + F.length(x)).alias("end"), x.alias("match"), context(i).alias("near"))
        return let(steps, lambda s: let(running_sums(s), lambda starts: F.transform(m, lambda x, i: one(x, i, F.get(starts, i)))))

    def scored(s: Column) -> Column:
        score = F.lit(kind.base) + F.when(F.lower(s["near"]).rlike(kind.words), 0.4).otherwise(0.0)
        return F.struct(*(s[c].alias(c) for c in ("start", "kind", "end", "match")), F.least(F.lit(1.0), score).alias("score"))

    kind_type = "array<struct<start:int,kind:int,end:int,match:string,near:string>>"
    spans = let(found, lambda m: F.when(F.size(m) > 0, let(F.split(text, kind.pattern, -1), lambda p: placed(m, p))).otherwise(F.array().cast(kind_type)))
    return F.transform(F.filter(spans, lambda s: kind.confirm(s["match"])), scored)


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", near: int = 40, least_score: float = 0.5) -> DataFrame:
    """``id`` and ``spans`` of every row: structs of start, kind, end, match, score, in order."""
    text = F.coalesce(F.col("_text"), F.lit(""))
    rows = df.select(F.col(id_col), F.col(text_col).alias("_text"))
    each = [matches_of(text, k, i, near) for i, k in enumerate(KINDS)]
    each = [x if k.name in BASE else F.filter(x, lambda s: s["score"] >= least_score) for x, k in zip(each, KINDS, strict=True)]
    names = F.array(*(F.lit(k.name) for k in KINDS))
    named = F.transform(F.array_sort(F.concat(*each)), lambda s: F.struct(F.get(names, s["kind"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["match"].alias("match"), s["score"].alias("score")))
    return rows.select(id_col, named.alias("spans"))


def listed(spans: Column) -> Column:
    """``kind:start:end``, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
