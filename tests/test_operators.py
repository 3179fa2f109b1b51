"""Fixed cases and properties of the library's own operators."""

import datetime as dt
import difflib
import os
import random

import pytest
from pyspark.sql import functions as F

from attesta.functions import dates, mrz, phonetic, similarity, text
from attesta.operators import checks, expiry, extract, forms, names, places, policy, reconcile, registry, romanise, rules, scoring
from attesta.sources import tables


def one(df):
    return df.collect()[0]


def test_record_fields(spark):
    cases = [
        ("id_number", "02000005039", "02000005039", "pass"), ("id_number", "02000005039", "02000005038", "reject"), ("id_number", "  02000005039 ", "02000005039", "pass"),
        ("date_of_birth", "2000-01-05", "2000-01-06", "reject"), ("issuance_date", "2000-01-05", "2000-01-06", "manual_review"), ("gender", None, "Female", "pass"), ("gender", None, "Male", "reject"),
        ("issuance_date", None, None, "manual_review"), ("id_number", None, None, "reject"), ("name_arabic", "مرام راند عبدالمولى السقاف", "مرام رائد عبدالمولى السقاف", "pass"),
        ("place_of_birth", "صنعاء", "عدن", "manual_review"), ("name_english", "Mohammed Ali", "Ali Mohammed", "pass"), ("name_english", "Mohammed Ali", "Zzz Qqq", "reject"),
    ]
    rows = spark.createDataFrame([(i, False, "02000005039", 1.0, f, e, t) for i, (f, e, t, _) in enumerate(cases)], "submission_id int, passport boolean, number string, confidence double, field string, extracted string, typed string")
    found = reconcile.compare_fields(rows.join(rules.field_rules(spark), "field"))
    got = {r.submission_id: r for r in found.collect()}
    assert [got[i].decision for i in range(len(cases))] == [c[3] for c in cases]
    assert got[4].score == 0.5 and got[6].fraud and not got[5].fraud and got[9].score > 0.7


def test_whole_record(spark):
    schema = "submission_id int, id_number string, passport_number string, date_of_birth string, gender string, name_arabic string, name_english string"
    typed = spark.createDataFrame([(1, "02000005039", None, "2000-01-05", "Female", "مرام رائد", None), (2, None, "12345678", "2000-01-05", "Female", "مرام رائد", "Mohamad")], schema)
    extracted = spark.createDataFrame([(1, "02000005039", None, "2000-01-05", "Female", "مرام رائد", "noise"), (2, None, "12345678", "2000-01-05", "Male", "محمد", None)], schema)
    long = reconcile.fields_of(typed, extracted, rules.field_rules(spark), skip_absent=True)
    fields = {(r.submission_id, r.field): r.extracted for r in long.collect()}
    assert (1, "passport_number") not in fields and (1, "name_english") not in fields and fields[2, "name_english"] == "Mhmd"
    got = {r.submission_id: r for r in reconcile.summarise(reconcile.compare_fields(long)).collect()}
    assert got[1].overall_decision == "approved" and got[1].failed_fields == 0 and got[2].overall_decision == "rejected"
    assert got[2].recommendations[0].startswith("High-severity fields failed: ")


@pytest.mark.parametrize("quality,confs,nid,back,want", [(1.0, [0.99, 0.98], True, True, (10, 10, 9.85, 5, 34.85)), (0.5, [0.4, 0.6], True, False, (5, 5, 5, 0, 15))])
def test_document_score(spark, quality, confs, nid, back, want):
    rows = spark.createDataFrame([("a", c, quality, nid, back) for c in confs], "subject string, confidence double, quality double, is_national_id boolean, has_back boolean")
    assert one(scoring.document_scores(rows))[1:] == pytest.approx(want)


def test_face_score(spark):
    rows = spark.createDataFrame([(100.0, 100.0, True), (90.0, 20.0, False)], "face double, confidence double, is_live boolean")
    assert [tuple(r)[3:] for r in scoring.face_liveness_scores(rows).collect()] == [(20.0, 15.0, 35.0), (18.0, 0.0, 18.0)]


def test_policy(spark):
    full = {"doc_authenticity": 1.0, "doc_quality": 1.0, "ocr_confidence": 0.95, "front_back_match": 1.0, "face_match": 0.9, "liveness": 1.0, "id_number_match": 1.0, "name_match": 0.8}
    rows = [("good", k, v) for k, v in full.items()] + [("bad", "face_match", 0.5)]
    found = policy.components(spark.createDataFrame(rows, "subject string, score_key string, raw double"), rules.policy_defaults(spark))
    got = {r.subject: r for r in policy.decide(found).collect()}
    assert got["good"].decision == "APPROVED" and got["good"].total_score == pytest.approx(95.5) and got["bad"].decision == "REJECTED"
    assert found.count() == 36 and policy.wide_log(found).count() == 2
    assert "APPROVED" in policy.result_document(policy.decide(found), found).where("subject = 'good'").first().document
    none = spark.createDataFrame([], "id int, ekyc_max double")
    assert policy.active_config(none).where("component = 'name_matching'").first()["min"] == 7.0


def test_places(spark):
    cases = [("صنعاء", "صنعاء", 0.95, 0.57), ("صنعا", "صنعاء", 0.90, 0.54), ("صنعاء - بني الحارث", "بني الحارث", 0.85, 0.34), ("صنعاء - معين", "صنعاء - بني الحارث", 0.80, 0.48), ("صنعاء", "عدن", 0.95, 0), ("صنعاء", "صنعاء", 0.40, 0.24), ("صنعاء", None, 0.90, 1.0), ("صنعاء", "123456", 0.90, 0), (None, None, 0.9, 0), ("الحديدة", "الحديده", 1.0, 0.6)]
    rows = spark.createDataFrame([(i, e, t, c) for i, (e, t, c, _) in enumerate(cases)], "id int, extracted string, typed string, confidence double")
    got = {r.id: r for r in places.validate(rows).collect()}
    assert [got[i].score for i in range(len(cases))] == pytest.approx([c[3] for c in cases])
    assert got[6].decision == "pass" and got[0].governorate == "صنعاء" and got[0].decision == "manual_review"


def test_romanise(spark):
    rows = spark.createDataFrame([("محمد",), ("فاطمة",), ("عبدالله",), ("نور",), ("جميلة",), ("سميرة",), ("غريب",), (" ",), ("سالم ناصر",)], "a string").withColumn("k", F.monotonically_increasing_id())
    got = {r.a: r for r in romanise.convert(rows, "k", "a").collect()}
    assert [got[a].english for a in ("محمد", "فاطمة", "عبدالله", "نور", "جميلة", "سميرة")] == ["Mohammed", "Fatima", "Abdullah", "Noor", "Jamila", "Samira"]
    assert got["غريب"].method == "phonetic" and got["غريب"].english == "Ghrib" and got[" "].method == "empty" and got["سالم ناصر"].english == "Salem Nasir"


def test_normalisers(spark):
    rows = spark.createDataFrame([("أحمد", "احمد"), ("محمّد", "محمد"), ("فاطمة", "فاطمه"), ("مصطفى", "مصطفي"), ("عبدالله", "عبدالله")], "a string, b string")
    for r in rows.select(text.arabic_strict(F.col("a")).alias("x"), "b", text.arabic_strict(text.arabic_strict(F.col("a"))).alias("twice")).collect():
        assert r.x == r.b == r.twice
    got = one(spark.range(1).select(text.english_name(F.lit("Abdullah  AL-Saqaf")).alias("a"), text.arabic_tokens(F.lit("عبدالله علي")).alias("b"), text.latin_tokens(F.lit("Abdullah bin Noor")).alias("c"), phonetic.arabic_to_latin(F.lit("شيخ علي")).alias("d")))
    assert got.a == "abd al lah al saqaf" and got.b == ["عبد", "الله", "علي"] and got.c == ["abd", "al", "lah", "bin", "nor"] and got.d == "Shykh Aly"


def plain_code(s, before_vowel):
    out, i = [], 0
    s = s.upper()
    single = {"B": "P", "D": "T", "Q": "K", "V": "F", "Z": "S", "X": "KS"}
    while i < len(s):
        c, nxt = s[i], s[i + 1 : i + 2]
        if c in "AEIOU":
            out.append("A" if i == 0 else "")
        elif c in "CG" and nxt and nxt in "EIY":
            out.append("S" if c == "C" else "J")
        elif c in "CG":
            out.append("K")
        elif c in "ST" and nxt == "H":
            out.append("X" if c == "S" else "0")
            i += 1
        elif c == "Y":
            out.append("Y" if not before_vowel or (nxt and nxt in "AEIOU") else "")
        elif "A" <= c <= "Z":
            out.append(single.get(c, c))
        i += 1
    return "".join(out)


def test_codes(spark):

    draw = random.Random(1)
    words = ["".join(draw.choice("AEIOUYCGSTHXKBDQVZLMR -'") for _ in range(draw.randint(0, 9))) for _ in range(1500)]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", phonetic.code(F.col("w")).alias("a"), phonetic.code(F.col("w"), True).alias("b"))
    for r in rows.collect():
        assert (r.a, r.b) == (plain_code(r.w, False), plain_code(r.w, True))


def plain_jaro_winkler(a, b):
    reach, taken = max(max(len(a), len(b)) // 2 - 1, 0), {}
    for i, c in enumerate(a):  # each letter takes the first free equal one within reach
        free = [j for j in range(len(b)) if abs(i - j) <= reach and b[j] == c and j not in taken.values()]
        if free:
            taken[i] = free[0]
    m = len(taken)
    swaps = sum(a[i] != b[j] for i, j in zip(sorted(taken), sorted(taken.values())))
    jaro = (m / len(a) + m / len(b) + (m - swaps / 2) / m) / 3 if m else 0.0
    return jaro + len(os.path.commonprefix([a[:4], b[:4]])) * 0.1 * (1 - jaro)


def test_jaro_winkler(spark):
    draw = random.Random(4)
    word = lambda: "".join(draw.choice("abcdé") for _ in range(draw.randrange(9)))
    rows = [(word(), word()) for _ in range(800)] + [(None, "a"), ("", ""), ("martha", "marhta"), ("dixon", "dicksonx")]
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", F.expr(similarity.jaro_winkler("a", "b")).alias("s")).collect()
    for r in got:
        assert 0 <= r.s <= 1 and (r.s == 1) == (r.a == r.b != "")
        assert r.s == pytest.approx(plain_jaro_winkler(r.a or "", r.b or ""), abs=1e-12)
    assert got[-2].s == pytest.approx(0.9611, abs=1e-4) and got[-1].s == pytest.approx(0.8133, abs=1e-4)


@pytest.mark.parametrize("language", ["english", "arabic"])
def test_fuzzy_scores_equal_those_of_whole_pairs(spark, language):
    """Ratios of distinct strings, put together in the plan, against names compared one pair at a time."""
    draw = random.Random(6)
    word = lambda: "".join(draw.choice("aeiklmnst" if language == "english" else "محدعليسنر") for _ in range(draw.randint(1, 6)))
    name = lambda: " ".join(word() for _ in range(draw.randint(1, 4)))
    rows = {(name(), name()) for _ in range(400)} | {("ali ali", "ali"), ("ali", "ali ali"), ("aa bb", "bb aa cc")}
    df = spark.createDataFrame(sorted(rows), "_a string, _b string")
    spoken = {r.w: r.c for r in spark.createDataFrame([(w,) for w in {w for p in rows for n in p for w in [n, *n.split()]}], "w string").select("w", phonetic.code(F.col("w"), True).alias("c")).collect()}

    def plain(a, b):
        codes = [[spoken[w] for w in n.split()] for n in (a, b)] if language == "english" else [None, None]
        found = similarity.fuzzy(a, b, 0.65 if language == "english" else 0.75, *codes)
        if language == "english":
            found = max(found, similarity.ratio(a, b), similarity.ratio(spoken[a], spoken[b]) if spoken[a] and spoken[b] else 0.0)
        return found

    scored = names.fuzzy_scores(df, language)
    assert {(r._a, r._b): round(r._s, 12) for r in scored.collect()} == {p: round(plain(*p), 12) for p in rows}


def test_name_tiers(spark):
    cases = [("Mohammed Ali", "Mohammed Ali", "exact"), ("Mohammed Ali", "Ali Mohammed", "token_set"), ("Mohammed", "Muhammad", "fuzzy"), ("", "x", "none"), ("Maram Raed Alsqaf", "Alsqaf Maram Raed", "token_set")]
    got = {(r.a, r.b): r for r in names.compare(spark.createDataFrame([c[:2] for c in cases], "a string, b string"), "a", "b", "english").collect()}
    assert [got[c[:2]].name_score_tier for c in cases] == [c[2] for c in cases]
    assert got["Mohammed", "Muhammad"].name_score >= 0.92
    rows = spark.createDataFrame([("البريهي", "البرهي")], "a string, b string")
    assert one(names.compare(rows, "a", "b", "arabic")).name_score == pytest.approx(difflib.SequenceMatcher(None, "البريهي", "البرهي").ratio())


def test_screening_loses_nothing(spark):
    first, last = ["Mohammed", "Muhammad", "Fatima", "Khaled", "Sara"], ["Ali", "Saleh", "Zaid", "Qasim"]
    people = [(i, f"{first[i % 5]} {last[i // 5 % 4]}") for i in range(40)]
    registry_ = spark.createDataFrame(people, "registry_id int, name string")
    asked = spark.createDataFrame([(100, "Mohamed Ali"), (101, "Sarah Saleh"), (102, ""), (103, None)], "query_id int, name string")
    for hot in (10_000, 2):
        got = {(r.query_id, r.registry_id) for r in names.screen(asked, registry_, hot=hot, best_only=False).collect()}
        pairs = asked.join(registry_.withColumnRenamed("name", "other"), how="cross")
        want = {(r.query_id, r.registry_id) for r in names.compare(pairs, "other", "name", "english").where("name_score >= 0.85").collect()}
        assert got == want and len(want) >= 6


def test_two_language_decision(spark):
    rows = spark.createDataFrame([(1, "محمد علي", "محمد علي", "Mohammed Ali", "Mohammed Ali", 1.0), (2, "محمد علي", None, None, "Mhmd Aly", 1.0), (3, None, None, None, None, 1.0), (4, "محمد", "سعيد", None, None, 1.0)], "k int, extracted_ar string, typed_ar string, extracted_en string, typed_en string, confidence double")
    got = {r.k: (r.decision, r.final_score) for r in names.validate(rows).collect()}
    assert got[1] == ("pass", 1.0) and got[2] == ("pass", 1.0) and got[3] == ("manual_review", 0.0) and got[4][0] == "reject"
    same = spark.createDataFrame([("محمد", "Mhmd"), ("محمد", "محمد"), ("Noor", "Nur")], "a string, b string")
    assert {r.a + r.b: round(r.similarity, 3) for r in names.cross_script(same, "a", "b").collect()} == {"محمدMhmd": 1.0, "محمدمحمد": 1.0, "NoorNur": 1.0}


def test_mrz(spark):
    line1 = "P<YEMALARABI<<FAWAZ<HADI<MOHAMMED<<<<<<<<<<<"[:44].ljust(44, "<")
    line2 = "10381272<6YEM8801018M2708218<<<<<<<<<<<<<<08"
    bad = line2[:9] + "7" + line2[10:]
    rows = spark.createDataFrame([(line1, line2), (line1, bad), (line1 + "<", line2), (line1[:43], line2)], "a string, b string")
    got = [r.m for r in rows.select(mrz.parse(F.col("a"), F.col("b")).alias("m")).collect()]
    assert got[0].valid and got[0].surname == "ALARABI" and got[0].given_names == "FAWAZ HADI MOHAMMED" and got[0].passport_number == "10381272" and got[0].gender == "Male"
    assert got[0].date_of_birth == dt.date(1988, 1, 1) and got[0].expiry_date == dt.date(2027, 8, 21) and got[0].confidence == 0.99
    assert not got[1].valid and not got[1].passport_ok and got[1].dob_ok and got[2] is None and got[3] is None
    zones, without = extract.mrz_zones(spark.createDataFrame([(1, 0, "X"), (1, 1, line1.lower()), (1, 2, line2), (2, 0, line2)], "k int, line_no int, text string"), "k")
    assert [r.k for r in zones.collect()] == [1] and [r.k for r in without.collect()] == [2]
    printed = spark.createDataFrame([(1, "99", "A", 0.5), (2, "88", None, 0.5)], "k int, passport_number string, surname string, confidence double")
    got = {r.k: r for r in extract.passport_fields(printed, zones, "k", ["passport_number", "surname"]).collect()}
    assert got[1].passport_number == "10381272" and got[1].passport_number_confidence == 0.99 and got[2].passport_number == "88" and got[2].surname_confidence == 0.0
    boxes = spark.createDataFrame([(1, "mrz", 9, 0), (1, "mrz", 3, 0), (1, "mrz", 5, 0), (1, "photo", 1, 0)], "k int, label string, y1 int, x1 int")
    assert sorted(r.y1 for r in extract.zone_boxes(boxes, "k").collect()) == [3, 5]
    assert one(spark.range(1).select(mrz.fit(F.lit(" p<yem "))))[0] == "P<YEM" + "<" * 39


def test_passport_issues(spark):
    rows = spark.createDataFrame([("12345678", "A", "2000-01-01", "2030-01-01"), ("x", None, "2000-01-01", "2000-01-01")], "passport_number string, surname string, date_of_birth string, expiry_date string")
    got = [len(r.issues) for r in extract.passport_issues(rows, F.lit("2024-01-01").cast("date")).collect()]
    assert got == [0, 3]


def test_expiry(spark):
    ref = F.lit("2024-01-01").cast("date")
    rows = spark.createDataFrame([("2024-12-31",), ("2024-01-31",), ("2023-12-22",), ("2023-09-23",), ("31-12-2027",), ("31/12/2027",), ("2027/12/31",), ("x",), (None,), ("2024-02-30",)], "expiry string")
    got = [(r.status, r.severity, r.expiry_date) for r in expiry.check(rows, ref=ref).collect()]
    assert [g[0] for g in got] == ["valid", "expiring_soon", "expired", "expired", "valid", "valid", "valid", "unknown", "unknown", "unknown"]
    assert [g[1] for g in got[:4]] == ["none", "warning", "warning", "critical"] and {g[2] for g in got[4:7]} == {"2027-12-31"}
    assert one(spark.range(1).select(dates.mrz_date(F.lit("410101")), dates.mrz_date(F.lit("400101")), dates.mrz_date(F.lit("401301")))) == (dt.date(1941, 1, 1), dt.date(2040, 1, 1), None)


def test_forms(spark):
    base = {"id_type": "national_id", "id_number": "02000005039", "passport_number": None, "full_name": None, "name_arabic": "أحمد", "name_english": "Ahmed", "date_of_birth": "1990-05-15", "gender": None, "place_of_birth": None, "issuance_date": "2015-01-01", "expiry_date": "2030-01-01"}
    cases = [{}, {"id_number": "123456"}, {"name_arabic": "أحمد123"}, {"id_type": "passport", "passport_number": "12345678"}, {"id_number": "12345678901"}, {"name_arabic": None, "name_english": None, "full_name": "Ahmed Ali"}, {"date_of_birth": "2016-01-01"}, {"date_of_birth": "15-05-1990"}]
    names_ = list(base)
    rows = spark.createDataFrame([tuple((base | c)[n] for n in names_) + (i,) for i, c in enumerate(cases)], ", ".join(f"{n} string" for n in names_) + ", k int")
    valid, broken = forms.split(forms.validate(rows, F.lit("2024-01-01").cast("date")))
    assert sorted(r.k for r in valid.collect()) == [0, 5]
    got = {r.k: {e.field for e in r.errors} for r in broken.collect()}
    assert got[1] == {"id_number"} and got[3] == {"gender"} and got[4] == {"id_number"} and got[6] == {"date_of_birth"} and got[7] == {"date_of_birth"}


def test_checks(spark):
    rows = spark.createDataFrame([("a", c, m) for c, m, _, _ in checks.LIVENESS] + [("b", "texture", 0.1)], "subject string, check string, value double")
    got = {r.subject: r for r in checks.verdicts(checks.liveness(rows)).collect()}
    assert got["a"].ok and not got["b"].ok and got["b"].failed == ["texture"]
    screen = {"sharpness": 0.5, "moire": 0.34, "screen_grid": 0.40, "texture": 0.5, "halftone": 0.1, "saturation": 0.2}
    rows = spark.createDataFrame([(p, p, c, v) for p in ("front", "passport") for c, v in screen.items()], "subject string, profile string, check string, value double")
    got = {r.subject: r for r in checks.not_a_copy(rows).collect()}
    assert got["front"].original and not got["passport"].original and got["passport"].failed == ["screen capture"]


def test_registry(spark, tmp_path):
    now = spark.createDataFrame([(1, "a", "img", "{\"k\": 1}")], "id int, name string, image string, doc string")
    updates = spark.createDataFrame([(1, "b", None, "{}", 1), (1, "c", None, "{}", 2), (2, "d", "new", "{}", 1)], "id int, name string, image string, doc string, at int")
    state = {r.id: r for r in registry.upsert(now, updates, ["id"], "at", ["image"]).collect()}
    assert state[1].name == "c" and state[1].image == "img" and state[2].image == "new"
    registry.export_csv(now, str(tmp_path / "csv"), ["name", "id", "none"])
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == ["name", "id"]
    assert one(registry.audit_rows(now.select("id"), "x", F.current_timestamp())).metadata == '{"id":1}'
    assert one(registry.with_split_names(now.withColumn("n", F.lit("A B C D")), "n", "english")).middle_name_english == "B C"
    for name in ("a.PNG", "b.jpg", "c.txt"):
        (tmp_path / name).write_bytes(b"123")
    assert sorted(r.length for r in tables.images(spark, str(tmp_path)).collect()) == [3, 3]


def test_sql_functions(spark):
    similarity.register(spark)
    got = spark.sql("SELECT similarity_ratio('abcd', 'bcde') AS r, jaro_winkler('martha', 'marhta') AS j, name_compare('ali saleh', 'saleh ali') AS n").first()
    assert got.r == 0.75 and round(got.j, 3) == 0.961 and got.n.tier == "token_set"


def test_line_fields(spark):
    lines = [(1, 0, "Name: X", 0.9), (1, 1, "مرام رائد السقاف", 0.8), (1, 2, "٠٢٠٠٠٠٠٥٠٣٩", 0.7), (1, 3, "DOB", 0.6), (1, 4, "5/1/2000", 0.6), (1, 5, "2017-05-24 / 2027-05-23", 0.6), (2, 0, "123 456 789", 0.2), (2, 1, "female", 0.1)]
    df = spark.createDataFrame(lines, "k int, line_no int, text string, score double")
    ref = F.lit("2024-01-01").cast("date")
    ids = {r.k: r for r in extract.id_numbers(df, "k").collect()}
    assert ids[1].number == "02000005039" and ids[1].confidence == pytest.approx(0.9) and ids[2].kind == "unknown"
    assert {r.k: r.birth_date for r in extract.birth_dates(df, "k", ref).collect()}[1] == "2000-01-05"
    assert one(extract.issue_and_expiry(df.where("line_no = 5"), "k", ref))[1:] == ("2017-05-24", "2027-05-23")
    assert {r.k: r.name_arabic for r in extract.names(df, "k").collect()}[1] == "مرام رائد السقاف"
    assert {r.k: r.gender for r in extract.gender_and_nationality(df, "k").collect()} == {1: None, 2: "Female"}
    assert extract.in_script(df, "ar").count() == 2 and extract.without_offices(df).count() == 8
    assert {r.k: r.languages for r in extract.quality_of_lines(df, "k", extract.id_numbers(df, "k")).collect()}[1] == ["ar", "en"]


def test_verification_names(spark):
    from attesta.operators import verify

    rows = [("a", None, "Mohammed Ali", None, 1.0), ("b", "Mohamad Aly", "Mohammed Ali", None, 1.0), ("c", "Mhmd Aly", None, "محمد علي", 1.0), ("d", "محمد", "x", None, 0.0), ("e", "Ali Mohammed", "Mohammed Ali", None, 1.0), ("f", "Zzzz Qqqq", "Mohammed Ali", None, None), ("g", "Mohammed Ali Saleh", "Mohammed Ali Qxqx", None, 0.7 + 0.3 * 2 / 3)]
    df = spark.createDataFrame([r[:4] for r in rows], "k string, typed string, name_english string, name_arabic string")
    got = {r.k: r.name_score for r in verify.name_scores(df).collect()}
    assert len(got) == len(rows) and all(got[r[0]] == pytest.approx(r[4]) for r in rows if r[4] is not None) and got["f"] < 0.6


def test_readability_blends_a_number(spark):
    """With a number its confidence counts, but no less than half of the best line."""
    lines = spark.createDataFrame([(1, 0, "12345678901", 0.2), (1, 1, "x", 1.0), (2, 0, "x", 0.7), (3, 0, "123456789", 0.1), (3, 1, "x", 1.0)], "k int, line_no int, text string, score double")
    numbers = spark.createDataFrame([(1, 0.9), (3, 0.3)], "k int, confidence double")
    assert {r.k: r.readability for r in extract.quality_of_lines(lines, "k", numbers).collect()} == {1: 0.9, 2: 0.7, 3: 0.5}


def test_each_rule_of_translations(spark):
    good = [("محمد علي", "Mohammed Ali"), ("نور", "Noora")]
    bad = [("نور", "Nora"), ("نور", "a,e;i.o u"), ("نور", "aklal"), ("نور", "Brrrrrk"), ("Fatima", " Fatima"), ("محمد علي", "Mohammed"), ("نور", " "), ("نور", None), (None, None)]
    df = spark.createDataFrame(good + bad, "s string, t string")
    assert [r.ok for r in df.select(romanise.good_translation(F.col("s"), F.col("t")).alias("ok")).collect()] == [True] * len(good) + [False] * len(bad)
    other = df.select(romanise.good_translation(F.col("s"), F.col("t"), F.lit("ar"), F.lit("fr")).alias("ok")).collect()
    assert [r.ok for r in other] == [True] * (len(good) + 6) + [False] * 3
    words = spark.createDataFrame([("Light",), (" moon ",), ("Noor",), (None,)], "w string")
    assert [r.w for r in romanise.without_common_words(words, "w").collect()] == ["Noor", None]


def test_screening_against_all_pairs(spark):
    """The best name of each query, by comparing every pair that shares a code; a hot code is dealt to salts."""
    draw = random.Random(2)
    make = lambda: " ".join(draw.choice(["omar", "omer", "salem", "saleem", "nasser", "naser", "ali", "aly"]) for _ in range(3))
    held = [(i, make()) for i in range(80)]
    asked = [(1000 + i, make()) for i in range(40)]
    registry_, queries_ = spark.createDataFrame(held, "registry_id int, name string"), spark.createDataFrame(asked, "query_id int, name string")
    every = names.compare(queries_.withColumnRenamed("name", "q").crossJoin(registry_), "name", "q", "english")
    shared = F.arrays_overlap(*(F.transform(text.tokens(F.col(c)), lambda t: phonetic.code(t, True)) for c in ("name", "q")))
    want = {}
    for r in every.where(shared & (F.col("name_score") >= 0.85)).collect():
        want[r.query_id] = max(want.get(r.query_id, (0.0, 0)), (r.name_score, -r.registry_id))
    for hot in (10_000, 20):
        got = {r.query_id: (r.score, -r.registry_id) for r in names.screen(queries_, registry_, hot=hot).collect()}
        assert got == want and len(want) > 20


def test_jdbc_in_ranges(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    spark.range(100).selectExpr("id", "CAST(id AS STRING) AS v").write.jdbc(url, "held")
    df = tables.registry_jdbc(spark, url, "held", "id", 0, 100, 4)
    assert df.rdd.getNumPartitions() == 4 and df.where("id >= 90").count() == 10
