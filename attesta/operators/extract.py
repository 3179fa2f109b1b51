"""Fields from text lines: numbers, dates, names, places, zones. One row for each document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.functions import mrz, text
from attesta.functions.dates import iso, normalise_date

#: Number kinds by pattern, with the confidence of a hit.
NUMBERS = [("national_id", r"^\d{11}$", 1.0)]
#: Label words that no name line has, and issuing-office words.
LABELS = "name|الاسم|address|العنوان|id|رقم|مكان|تاريخ|الميلاد|وتاريخ|ونريخ|date|birth|place|gender|الجنس"
OFFICE = "مصلحة|الأحوال|المدنية|السجل|المدني|الجمهورية|اليمنية|وزارة|ministry|authority|republic|civil|registry|government|حكومة|دولة|مكان|تاريخ|الميلاد|وتاريخ|ونريخ|date|birth|place"
BIRTH = "birth|dob|date of birth|تاريخ الميلاد|ميلاد|المولد"
DATE_NEAR = r"\d{4}\s*[./-]\s*\d{1,2}\s*[./-]\s*\d{1,2}"


def lines_of(dumps: DataFrame, key: str, json_col: str) -> DataFrame:
    """Lines (key, line_no, text, score) of recogniser dumps in either layout: one list of texts and one
    of scores, or a list of [box, [text, score]]. Texts are trimmed, empty ones dropped."""
    texts = F.from_json(F.get_json_object(json_col, "$.rec_texts"), "array<string>")
    scores = F.from_json(F.get_json_object(json_col, "$.rec_scores"), "array<double>")
    flat = F.arrays_zip(texts.alias("text"), scores.alias("score"))
    nested = F.transform(F.from_json(json_col, "array<array<string>>"), lambda r: F.from_json(F.get(r, F.lit(1)), "array<string>"))
    scored = F.transform(nested, lambda r: F.struct(F.get(r, F.lit(0)).alias("text"), F.get(r, F.lit(1)).try_cast("double").alias("score")))
    rows = dumps.select(key, F.posexplode(F.coalesce(flat, scored)).alias("line_no", "l"))
    return rows.select(key, "line_no", F.trim("l.text").alias("text"), F.col("l.score").alias("score")).where("text <> ''")


def first_seen(lines: DataFrame, key: str) -> DataFrame:
    """Each text once for a document, ignoring case: its first line."""
    nth = F.row_number().over(Window.partitionBy(key, F.lower(F.trim("text"))).orderBy("line_no"))
    return lines.withColumn("_nth", nth).where("_nth = 1").drop("_nth")


def in_script(lines: DataFrame, language: str) -> DataFrame:
    """Drop lines that lack the script of an Arabic recogniser."""
    return lines.where(text.has_arabic(F.col("text"))) if language == "ar" else lines


def id_numbers(lines: DataFrame, key: str, kinds: list[tuple[str, str, float]] = NUMBERS) -> DataFrame:
    """Best candidate: pattern confidence, then line score, then earliest line.

    Without any hit of a pattern, any 8 to 15 digits of a line count as ``unknown``.
    """
    plain = text.plain_digits(F.col("text"))
    clean, digits = F.regexp_replace(F.upper(plain), r"[\s\-.]", ""), F.regexp_replace(plain, "[^0-9]", "")
    hit = F.coalesce(*(F.when(clean.rlike(p), F.struct(clean.alias("number"), F.lit(k).alias("kind"), F.lit(c).alias("confidence"))) for k, p, c in kinds))
    loose = F.when(F.length(digits).between(8, 15), F.struct(digits.alias("number"), F.lit("unknown").alias("kind"), F.lit(0.5).alias("confidence")))
    found = lines.select(key, "line_no", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce(hit, loose).alias("c")).where("c IS NOT NULL")
    best = F.struct("c.confidence", "score", (-F.col("line_no")).alias("earlier"))
    top = found.groupBy(key).agg(F.max_by("c", best).alias("c"), F.max(best)["score"].alias("score"))
    return top.select(key, "c.number", "c.kind", F.least(F.lit(1.0), F.greatest(F.col("c.confidence") * 0.9, F.col("score"))).alias("confidence"))


def best_digits(rows: DataFrame, key: str, text_col: str = "text", pos: str = "line_no") -> DataFrame:
    """Digit string of a number field: exactly 11 first, else the longest of 8 or more, else none."""
    digits = rows.select(key, pos, F.regexp_replace(F.col(text_col), "[^0-9]", "").alias("digits")).where(F.length("digits") >= 8)
    best = F.struct((F.length("digits") == 11).alias("whole"), F.length("digits").alias("n"), (-F.col(pos)).alias("earlier"))
    top = digits.groupBy(key).agg(F.max_by("digits", best).alias("digits"))
    return top.select(key, "digits", F.when(F.length("digits") == 11, "valid").otherwise(F.format_string("incomplete_%d_digits", F.length("digits"))).alias("validation"))


def dates_in(c: Column) -> Column:
    """Every date of a text: year first, day first, or eight digits."""
    pieces = lambda p: F.regexp_extract_all(c, F.lit(p), F.lit(0))
    ymd = F.transform(pieces(r"\d{4}[/-]\d{1,2}[/-]\d{1,2}"), lambda s: F.try_to_date(F.replace(s, F.lit("/"), F.lit("-")), "yyyy-M-d"))
    dmy = F.transform(pieces(r"\d{1,2}[/-]\d{1,2}[/-]\d{4}"), lambda s: F.try_to_date(F.replace(s, F.lit("/"), F.lit("-")), "d-M-yyyy"))
    packed = F.transform(pieces(r"\d{8}"), lambda s: F.try_to_date(s, "yyyyMMdd"))
    return F.filter(F.concat(ymd, dmy, packed), lambda d: d.isNotNull())


def issue_and_expiry(lines: DataFrame, key: str, ref: Column, distinct_dates: bool = False) -> DataFrame:
    """The first two dates in time from 1990 to 50 years ahead; lines that are mostly digits are skipped."""
    mostly = (F.length("text") > 10) & (F.regexp_count("text", F.lit(r"\d")) / F.length("text") > 0.8)
    found = lines.where(~mostly).select(key, F.explode(dates_in(F.col("text"))).alias("d"))
    found = found.where((F.year("d") >= 1990) & (F.year("d") <= F.year(ref) + 50))
    listed = F.collect_set("d") if distinct_dates else F.collect_list("d")
    both = found.groupBy(key).agg(F.slice(F.array_sort(listed), 1, 2).alias("ds"))
    return both.select(key, iso(F.get("ds", F.lit(0))).alias("issue_date"), iso(F.get("ds", F.lit(1))).alias("expiry_date"))


def birth_dates(lines: DataFrame, key: str, ref: Column) -> DataFrame:
    """A plausible date on a line about birth or the two after it, else the oldest plausible date."""
    plausible = lambda d: (F.datediff(ref, d) > 0) & (F.datediff(ref, d) / 365.25 <= 100)
    near = Window.partitionBy(key).orderBy("line_no").rowsBetween(0, 2)
    rows = lines.withColumn("_all", F.filter(dates_in(F.col("text")), plausible))
    rows = rows.withColumn("_near", F.when(F.lower("text").rlike(BIRTH), F.get(F.flatten(F.collect_list("_all").over(near)), F.lit(0))))
    found = rows.groupBy(key).agg(F.min_by("_near", F.when(F.col("_near").isNotNull(), F.col("line_no"))).alias("said"), F.min(F.array_min("_all")).alias("oldest"))
    return found.select(key, iso(F.coalesce("said", "oldest")).alias("birth_date"))


def birth_places(lines: DataFrame, key: str) -> DataFrame:
    """Arabic text after a date, before it, or on the next line; the first line that has one."""
    t = F.trim("text")
    dated = t.rlike(DATE_NEAR)
    tidy_front, tidy_back = r"^[-_.\s،,]+", r"[-_.\s،,]+$"
    fits = lambda c: F.when((F.length(c) > 2) & (F.regexp_count(c, F.lit(text.ARABIC)) >= 2), c)
    after = fits(F.trim(F.regexp_replace(F.regexp_extract(t, f"{DATE_NEAR}(.*)$", 1), tidy_front, "")))
    before = fits(F.trim(F.regexp_replace(F.regexp_extract(t, f"^(.*?){DATE_NEAR}", 1), tidy_back, "")))
    next_line = F.lead(t).over(Window.partitionBy(key).orderBy("line_no"))
    below = F.when(~next_line.rlike(DATE_NEAR), fits(F.trim(F.regexp_replace(next_line, tidy_front, ""))))
    rows = lines.select(key, "line_no", F.when(dated, F.coalesce(after, before, below)).alias("place")).where("place IS NOT NULL")
    return rows.groupBy(key).agg(F.min_by("place", "line_no").alias("birth_place"))


def likely_name(c: Column) -> Column:
    words, share = F.size(text.tokens(text.squeezed(c))), F.regexp_count(c, F.lit(r"\d")) / F.greatest(F.length(c), F.lit(1))
    return ((words >= 2) | ((F.length(c) > 5) & (share < 0.3))) & ~F.lower(c).rlike(LABELS)


def names(lines: DataFrame, key: str) -> DataFrame:
    """The longest likely name line of each script, the earliest of equals."""
    rows = lines.where((F.length("text") > 5) & likely_name(F.col("text"))).withColumn("lang", text.text_language(F.col("text")))
    rank = F.struct(F.length("text"), -F.col("line_no"))
    best = lambda lang: F.max_by(F.col("text"), F.when(F.col("lang") == lang, rank)).alias(f"name_{'arabic' if lang == 'ar' else 'english'}")
    return rows.groupBy(key).agg(best("ar"), best("en"))


def without_offices(lines: DataFrame) -> DataFrame:
    return lines.where(~F.lower("text").rlike(OFFICE) & (F.size(text.tokens(text.squeezed(F.col("text")))) <= 6))


def gender_and_nationality(lines: DataFrame, key: str) -> DataFrame:
    """First line with a whole-word gender; nationality by keyword, Yemeni without one."""
    low = F.lower(F.trim("text"))
    gender = F.when(low.rlike(r"(?U)\b(female|أنثى|f)\b"), "Female").when(low.rlike(r"(?U)\b(male|ذكر|m)\b"), "Male")
    nation = F.when(low.rlike("يمني|yemen"), "Yemeni")
    first = lambda v, name: F.coalesce(F.min_by(v, F.when(v.isNotNull(), F.col("line_no")))).alias(name)
    return lines.groupBy(key).agg(first(gender, "gender"), F.coalesce(first(nation, "n"), F.lit("Yemeni")).alias("nationality"))


def quality_of_lines(lines: DataFrame, key: str, numbers: DataFrame) -> DataFrame:
    """Languages, joined text, mean and best score. Readability is the best score, or with a number its
    confidence, but no less than half of the best score."""
    rows = lines.withColumn("lang", text.text_language(F.col("text")))
    per = rows.groupBy(key).agg(
        F.array_sort(F.collect_set("lang")).alias("languages"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), " ").alias("all_text"),
        F.avg("score").alias("mean_score"), F.max("score").alias("best_score"),
    )
    joined = per.join(numbers.select(key, F.col("confidence").alias("_c")), key, "left")
    blended = F.when(F.col("_c").isNotNull(), F.greatest("_c", 0.5 * F.col("best_score"))).otherwise(F.col("best_score"))
    return joined.withColumn("readability", F.least(F.lit(1.0), blended)).drop("_c")


def mrz_routed(lines: DataFrame, key: str) -> DataFrame:
    """One row for each document: its zone ``m`` (of the first two consecutive fitting lines), or ``quarantined``."""
    t = F.upper(F.trim("text"))
    below = F.lead(t).over(Window.partitionBy(key).orderBy("line_no"))
    whole = "^[A-Z0-9<]{44}$"
    rows = lines.withColumn("_t", t).withColumn("_below", below)
    hit = F.col("_t").rlike(whole) & F.col("_below").rlike(whole) & F.col("_t").startswith("P<")
    zone = F.min_by(F.when(hit, F.struct("_t", "_below")), F.when(hit, F.col("line_no")))
    found = rows.groupBy(key).agg(zone.alias("z"))
    return found.select(key, F.when(F.col("z").isNotNull(), mrz.parse(F.col("z._t"), F.col("z._below"))).alias("m"), F.col("z").isNull().alias("quarantined"))


def mrz_zones(lines: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Parsed zones, and the documents that have none."""
    routed = mrz_routed(lines, key)
    return routed.where("NOT quarantined").select(key, "m"), routed.where("quarantined").select(key)


def best_detections(boxes: DataFrame, key: str, pad: float = 0.05) -> DataFrame:
    """The most confident box of each label, clamped to the image, empty ones dropped, padded by 5 %."""
    x1, y1 = F.greatest("x1", F.lit(0)), F.greatest("y1", F.lit(0))
    x2, y2 = F.least("x2", "width"), F.least("y2", "height")
    clamped = boxes.select(key, "label", "confidence", "width", "height", x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2")).where("x2 > x1 AND y2 > y1")
    best = F.min(F.struct((-F.col("confidence")).alias("order"), "x1", "y1", "x2", "y2", "confidence", "width", "height"))
    top = clamped.groupBy(key, "label").agg(best.alias("b")).select(key, "label", *(f"b.{c}" for c in ("confidence", "width", "height", "x1", "y1", "x2", "y2")))
    dx, dy = ((F.col("x2") - F.col("x1")) * pad).cast("int"), ((F.col("y2") - F.col("y1")) * pad).cast("int")
    padded = (F.greatest(F.col("x1") - dx, F.lit(0)), F.greatest(F.col("y1") - dy, F.lit(0)), F.least(F.col("x2") + dx, F.col("width")), F.least(F.col("y2") + dy, F.col("height")))
    return top.select(key, "label", "confidence", *(c.alias(n) for c, n in zip(padded, ("x1", "y1", "x2", "y2"), strict=True)))


def all_detections(boxes: DataFrame, key: str) -> DataFrame:
    """Every box of each label, the most confident first."""
    box = F.struct((-F.col("confidence")).alias("order"), "x1", "y1", "x2", "y2", "confidence")
    return boxes.groupBy(key, "label").agg(F.array_sort(F.collect_list(box)).alias("boxes"))


def field_lines(lines: DataFrame) -> DataFrame:
    """Lines of a field that fit its recogniser: two Arabic letters, or a digit where the label asks for one.

    ``lines`` have ``label``, ``language`` and ``text``.
    """
    digits = F.col("label").isin("DOB", "unique_id", "expiry_data", "issue_date")
    fits = F.when(F.col("language") == "ar", F.regexp_count("text", F.lit(text.ARABIC)) >= 2).otherwise(~digits | F.col("text").rlike(r"\d"))
    return lines.where(fits)


def zone_boxes(boxes: DataFrame, key: str) -> DataFrame:
    """Machine-readable zone boxes from top to bottom, two at most."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy("y1", "x1"))
    return boxes.where("label = 'mrz'").withColumn("nth", nth).where("nth <= 2")


def card_fields(fields: DataFrame, key: str, back_lines: DataFrame | None = None, ref: Column | None = None) -> DataFrame:
    """One row for a card from long rows (key, side, label, text, confidence): front first, else back.

    Dates are normalised, the gender follows from the number; a field's confidence is 0 where it is absent.
    ``back_lines`` are the lines of backs that have no labelled fields: the first two dates among them stand
    in for missing dates of issue and expiry, without confidence.
    """
    labels = {"name": "name_arabic", "DOB": "date_of_birth", "POB": "place_of_birth", "unique_id": "id_number", "issue_date": "issuance_date", "expiry_data": "expiry_date"}
    value = F.nullif(F.trim("text"), F.lit(""))
    pick = lambda label, side: F.max(F.when((F.col("label") == label) & (F.col("side") == side), F.struct(value.alias("v"), "confidence")))
    per = fields.groupBy(key).agg(*(pick(lab, side).alias(f"{name}_{side}") for lab, name in labels.items() for side in ("front", "back")))
    out = []
    for name in labels.values():
        chosen = F.when(F.col(f"{name}_front")["v"].isNotNull(), F.col(f"{name}_front"))
        chosen = F.coalesce(chosen, F.when(F.col(f"{name}_back")["v"].isNotNull(), F.col(f"{name}_back"))) if name in ("issuance_date", "expiry_date") else chosen
        v = F.coalesce(normalise_date(chosen["v"]), chosen["v"]) if "date" in name else chosen["v"]
        out += [v.alias(name), F.coalesce(chosen["confidence"], F.lit(0.0)).alias(f"{name}_confidence")]
    cards = per.select(key, *out)
    if back_lines is not None:
        dated = issue_and_expiry(back_lines, key, F.current_date() if ref is None else ref).select(F.col(key).alias("_back"), F.col("issue_date").alias("_issue"), F.col("expiry_date").alias("_expiry"))
        cards = cards.join(dated, F.col(key) == F.col("_back"), "left")
        cards = cards.withColumns({"issuance_date": F.coalesce("issuance_date", "_issue"), "expiry_date": F.coalesce("expiry_date", "_expiry")}).drop("_back", "_issue", "_expiry")
    digit = F.when(F.col("id_number").rlike(r"^\d{4,}$"), F.substring("id_number", 4, 1))
    return cards.withColumn("gender", F.when(digit == "1", "Male").when(digit == "0", "Female"))


def passport_fields(ocr: DataFrame, zones: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """The zone's value over the printed one, with the confidence of where it came from."""
    z = zones.select(key, "m.*").alias("z")
    joined = ocr.alias("o").join(z, key, "left")
    out = []
    for f in fields:
        out += [F.coalesce(F.col(f"z.{f}").cast("string"), F.col(f"o.{f}")).alias(f), F.when(F.col(f"z.{f}").isNotNull(), F.col("z.confidence")).when(F.col(f"o.{f}").isNotNull(), F.col("o.confidence")).otherwise(0.0).alias(f"{f}_confidence")]
    return joined.select(key, *out)


def passport_issues(rows: DataFrame, ref: Column) -> DataFrame:
    """Add ``issues``: missing number, names, dates, or an expired passport."""
    need = lambda c: F.when(F.coalesce(F.trim(F.col(c)), F.lit("")) == "", F.lit(f"{c} is missing"))
    expired = F.when(F.try_to_date("expiry_date", "yyyy-MM-dd") < ref, "passport has expired")
    form = F.when(~F.col("passport_number").rlike(r"^\d{8,9}$"), F.lit("passport_number is malformed"))
    checks = [need(c) for c in ("passport_number", "surname", "date_of_birth", "expiry_date")] + [form, expired]
    return rows.withColumn("issues", F.filter(F.array(*checks), lambda x: x.isNotNull())).withColumn("ok", F.size("issues") == 0)
