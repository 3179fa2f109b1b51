"""Line extraction over ``documents`` and ``orders``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.functions import text
from attesta.operators import extract as ops

from .names import _PEOPLE as PEOPLE_SQL
from .names import people
from .registry import query, table

_LINES = """SELECT doc_id, CAST(unnest(generate_series(1, len(l))) AS INT) - 1 AS line_no, unnest(l) AS text FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) ||
 [concat('ID 2', lpad(CAST(doc_id AS VARCHAR), CASE WHEN doc_id % 3 = 0 THEN 8 ELSE 10 END, '0')), concat('Issued ', CAST(2000 + doc_id % 20 AS VARCHAR), '-03-1', CAST(doc_id % 10 AS VARCHAR), ' until 05/06/', CAST(2030 + doc_id % 9 AS VARCHAR)), concat('born ', CAST(1950 + doc_id % 50 AS VARCHAR), '/7/8')] AS l FROM documents)"""


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    number = F.concat(F.lit("ID 2"), F.when(F.col("doc_id") % 3 == 0, F.lpad(F.col("doc_id").cast("string"), 8, "0")).otherwise(F.lpad(F.col("doc_id").cast("string"), 10, "0")))
    dates = F.concat(F.lit("Issued "), 2000 + F.col("doc_id") % 20, F.lit("-03-1"), F.col("doc_id") % 10, F.lit(" until 05/06/"), 2030 + F.col("doc_id") % 9)
    born = F.concat(F.lit("born "), 1950 + F.col("doc_id") % 50, F.lit("/7/8"))
    lines = F.concat(F.split(F.coalesce("text", F.lit("")), "\n"), F.array(number, dates, born))
    rows = d.select("doc_id", F.posexplode(lines).alias("line_no", "text"))
    return rows.withColumn("score", (F.col("doc_id") + F.col("line_no")) % 100 / 100.0)


def _numbers(lines: str) -> str:
    """The best number of each document of lines (doc_id, line_no, text, score)."""
    return f"""SELECT doc_id, number, kind, least(1.0, greatest(c * 0.9, score)) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY c DESC, score DESC, line_no) AS nth FROM
(SELECT doc_id, line_no, score, CASE WHEN hit THEN clean ELSE digits END AS number, CASE WHEN hit THEN 1.0 ELSE 0.5 END AS c, CASE WHEN hit THEN 'national_id' ELSE 'unknown' END AS kind FROM
 (SELECT *, regexp_full_match(clean, '[0-9]{{11}}') AS hit FROM (SELECT *, regexp_replace(upper(text), '[\\s\\-.]', '', 'g') AS clean, regexp_replace(text, '[^0-9]', '', 'g') AS digits FROM ({lines}))) WHERE hit OR length(digits) BETWEEN 8 AND 15)) WHERE nth = 1"""


_SCORED = f"SELECT *, (doc_id + line_no) % 100 / 100.0 AS score FROM ({_LINES})"


@query(_numbers(_SCORED))
def extract_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.id_numbers(document_lines(spark, sf_dir), "doc_id")


def _dates(lines: str) -> str:
    """The lines with their dates ``ds``: year first, then day first, then eight digits."""
    part = lambda p, f: f"list_transform(regexp_extract_all(text, '{p}'), lambda s: CAST(try_strptime(replace(s, '/', '-'), '{f}') AS DATE))"
    forms = [("[0-9]{4}[/-][0-9]{1,2}[/-][0-9]{1,2}", "%Y-%m-%d"), ("[0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{4}", "%d-%m-%Y"), ("[0-9]{8}", "%Y%m%d")]
    return f"SELECT *, list_filter({' || '.join(part(*f) for f in forms)}, lambda d: d IS NOT NULL) AS ds FROM ({lines})"


@query(f"""SELECT doc_id, CAST(l[1] AS VARCHAR) AS issue_date, CAST(l[2] AS VARCHAR) AS expiry_date FROM (SELECT doc_id, list_sort(list(d)) AS l FROM
(SELECT doc_id, unnest(ds) AS d FROM ({_dates(_LINES)}) WHERE NOT (length(text) > 10 AND len(regexp_extract_all(text, '[0-9]')) / length(text) > 0.8)) WHERE year(d) BETWEEN 1990 AND 2074 GROUP BY doc_id)""")
def extract_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.issue_and_expiry(document_lines(spark, sf_dir), "doc_id", F.lit("2024-01-01").cast("date"))


@query(f"""WITH d AS (SELECT doc_id, line_no, text, list_filter(ds, lambda d: DATE '2024-01-01' - d > 0 AND (DATE '2024-01-01' - d) / 365.25 <= 100) AS ds FROM
 ({_dates(f"SELECT doc_id, line_no, CASE WHEN doc_id % 2 = 0 THEN regexp_replace(text, '^born', 'dob') ELSE text END AS text FROM ({_LINES})")})),
near AS (SELECT b.doc_id, b.line_no, first(l.ds[1] ORDER BY l.line_no) AS d FROM d b JOIN d l ON l.doc_id = b.doc_id AND l.line_no BETWEEN b.line_no AND b.line_no + 2 WHERE regexp_matches(lower(b.text), '{ops.BIRTH}') AND len(l.ds) > 0 GROUP BY ALL)
SELECT doc_id, CAST(coalesce(s.d, o.d) AS VARCHAR) AS birth_date FROM (SELECT doc_id, min(list_min(ds)) AS d FROM d GROUP BY doc_id) o LEFT JOIN (SELECT doc_id, arg_min(d, line_no) AS d FROM near GROUP BY doc_id) s USING (doc_id)""")
def extract_birth_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = document_lines(spark, sf_dir).withColumn("text", F.when(F.col("doc_id") % 2 == 0, F.regexp_replace("text", "^born", "dob")).otherwise(F.col("text")))
    return ops.birth_dates(lines, "doc_id", F.lit("2024-01-01").cast("date"))


@query(f"""SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, lower(trim(text)) AS t FROM ({_LINES})) GROUP BY doc_id""")
def distinct_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.first_seen(document_lines(spark, sf_dir), "doc_id").groupBy("doc_id").agg(F.count("*").alias("n"))


_OK = "length(text) > 5 AND NOT regexp_matches(lower(text), '" + ops.LABELS + "') AND (len(list_filter(string_split_regex(trim(text), '\\s+'), lambda x: x <> '')) >= 2 OR len(regexp_extract_all(text, '[0-9]')) / length(text) < 0.3)"


@query(f"SELECT doc_id, max_by(text, length(text) * 100000 - line_no) AS name_english FROM ({_LINES}) WHERE {_OK} GROUP BY doc_id")
def extract_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.names(document_lines(spark, sf_dir), "doc_id").select("doc_id", "name_english")


@query("""SELECT o_orderkey AS card, CASE WHEN o_orderkey % 2 = 0 THEN 'عدن' WHEN o_orderkey % 3 = 0 THEN 'تعز' ELSE 'صنعاء' END AS birth_place FROM orders""")
def extract_birth_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    first = F.when(k % 2 == 0, F.lit("1990-01-02 - عدن")).when(k % 3 == 0, F.lit("تعز 1990/1/2")).otherwise(F.lit("1990.1.2"))
    o = table(spark, sf_dir, "orders").select(k.alias("card"), F.posexplode(F.array(F.lit("NAME"), first, F.lit("، صنعاء"))).alias("line_no", "text"))
    return ops.birth_places(o, "card")


@query("""SELECT o_orderkey AS card, CASE CAST(o_orderkey % 3 AS INT) WHEN 0 THEN 'Female' WHEN 1 THEN 'Male' END AS gender, 'Yemeni' AS nationality, ['en'] AS languages, CASE CAST(o_orderkey % 3 AS INT) WHEN 2 THEN 1 ELSE 2 END AS kept FROM orders""")
def extract_gender(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    g = F.when(k % 3 == 0, F.lit("Sex: FEMALE")).when(k % 3 == 1, F.lit("sex Male")).otherwise(F.lit("Ministry of Interior"))
    lines = table(spark, sf_dir, "orders").select(k.alias("card"), F.posexplode(F.array(F.lit("Republican"), g, F.lit("Nasser"))).alias("line_no", "text"), F.lit(0.5).alias("score"))
    found = ops.gender_and_nationality(lines, "card")
    numbers = ops.id_numbers(lines, "card")
    langs = ops.quality_of_lines(lines, "card", numbers).select("card", "languages")
    kept = ops.without_offices(lines.where("text <> 'Republican' OR card % 3 < 0")).groupBy("card").agg(F.count("*").cast("int").alias("kept"))
    return found.join(langs, "card").join(kept, "card")


_VARIED = f"SELECT doc_id, line_no, score, CASE WHEN doc_id % 4 = 0 AND text LIKE 'ID 2%' THEN 'ID none' WHEN doc_id % 5 = 0 AND text LIKE 'born %' THEN 'تاريخ الميلاد' ELSE text END AS text FROM ({_SCORED})"
_ARABIC_LINE = "len(regexp_extract_all(text, '[\\x{0600}-\\x{06FF}]')) > len(regexp_extract_all(text, '[a-zA-Z]'))"


@query(f"""SELECT doc_id, array_to_string(list_sort(list(DISTINCT CASE WHEN {_ARABIC_LINE} THEN 'ar' ELSE 'en' END)), ',') AS languages, md5(string_agg(text, ' ' ORDER BY line_no)) AS all_text, round(avg(score), 6) AS mean_score, max(score) AS best_score,
least(1.0, CASE WHEN any_value(confidence) IS NULL THEN max(score) ELSE greatest(any_value(confidence), 0.5 * max(score)) END) AS readability FROM ({_VARIED}) LEFT JOIN (SELECT doc_id, confidence FROM ({_numbers(_VARIED)})) USING (doc_id) GROUP BY doc_id""")
def line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part of the documents has no number, another an Arabic line."""
    said = F.col("text")
    text_ = F.when((F.col("doc_id") % 4 == 0) & said.startswith("ID 2"), "ID none").when((F.col("doc_id") % 5 == 0) & said.startswith("born "), "تاريخ الميلاد").otherwise(said)
    lines = document_lines(spark, sf_dir).withColumn("text", text_)
    found = ops.quality_of_lines(lines, "doc_id", ops.id_numbers(lines, "doc_id"))
    return found.select("doc_id", F.array_join("languages", ",").alias("languages"), F.md5("all_text").alias("all_text"), F.round("mean_score", 6).alias("mean_score"), "best_score", "readability")


@query("""SELECT o_orderkey AS card, CASE WHEN o_orderkey % 2 = 0 THEN '2020-05-06' WHEN o_orderkey % 3 = 0 THEN '2019-02-01' END AS issuance_date, CASE WHEN o_orderkey % 3 = 0 THEN '2029-02-01' END AS expiry_date,
CASE WHEN o_orderkey % 2 = 0 THEN 0.9 ELSE 0.0 END AS issuance_date_confidence FROM orders""")
def card_back_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third card's back was read as plain lines, which hold both dates; half of the fronts show one."""
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select(k.alias("card"))
    front = o.select("card", F.lit("front").alias("side"), F.lit("issue_date").alias("label"), F.when(F.col("card") % 2 == 0, "2020/5/6").otherwise(" ").alias("text"), F.lit(0.9).alias("confidence"))
    back = o.where("card % 3 = 0").select("card", F.posexplode(F.array(F.lit("Issued 1/2/2019"), F.lit("20190201999 1"), F.lit("until 2029-02-01"))).alias("line_no", "text"))
    return ops.card_fields(front, "card", back, F.lit("2024-01-01").cast("date")).select("card", "issuance_date", "expiry_date", "issuance_date_confidence")


@query(f"SELECT c_custkey, n AS line_no, t AS text FROM (SELECT c_custkey, unnest([0, 1, 2]) AS n, unnest([name, arabic, arabic || ' ' || name]) AS t FROM ({PEOPLE_SQL})) WHERE regexp_matches(t, '[\\x{{0600}}-\\x{{06FF}}]')")
def native_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = people(spark, sf_dir).select("c_custkey", F.posexplode(F.array("name", "arabic", F.concat_ws(" ", "arabic", "name"))).alias("line_no", "text"))
    return ops.in_script(lines, "ar")


@query(f"""SELECT c_custkey, first(t ORDER BY n) AS text, min(n) AS line_no FROM (SELECT c_custkey, unnest([0, 1, 2, 3]) AS n, unnest([arabic, name, upper(name), c_mktsegment]) AS t FROM ({PEOPLE_SQL}) JOIN customer USING (c_custkey)) GROUP BY c_custkey, lower(trim(t))""")
def recogniser_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of an Arabic and an English recogniser, each text once."""
    p = people(spark, sf_dir).join(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_custkey")
    arabic = p.select("c_custkey", F.posexplode(F.array("arabic", "name")).alias("line_no", "text"))
    english = p.select("c_custkey", F.posexplode(F.array(F.upper("name"), F.col("c_mktsegment"))).alias("line_no", "text")).withColumn("line_no", F.col("line_no") + 2)
    return ops.first_seen(arabic.unionByName(english), "c_custkey").select("c_custkey", "text", F.col("line_no").cast("long").alias("line_no"))


@query("""SELECT * FROM (SELECT l_orderkey AS image, l_partkey AS y1, l_suppkey AS x1, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey) AS nth FROM lineitem WHERE l_linenumber % 3 > 0) WHERE nth <= 2""")
def zone_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS image", "CASE WHEN l_linenumber % 3 > 0 THEN 'mrz' ELSE 'photo' END AS label", "l_partkey AS y1", "l_suppkey AS x1")
    return ops.zone_boxes(boxes, "image").select("image", "y1", "x1", F.col("nth").cast("long").alias("nth"))


_P = "CAST(floor(l_extendedprice) AS BIGINT)"


@query(f"""WITH b AS (SELECT l_orderkey AS image, l_returnflag AS label, l_discount AS confidence, greatest(CAST(l_linenumber * 10 - 20 AS BIGINT), 0) AS x1, 0 AS y1, least({_P} % 500, 400) AS x2, least({_P} % 300 + 1, 300) AS y2 FROM lineitem),
t AS (SELECT *, row_number() OVER (PARTITION BY image, label ORDER BY confidence DESC, x1, y1, x2, y2) AS nth FROM b WHERE x2 > x1 AND y2 > y1)
SELECT image, label, confidence, greatest(x1 - CAST(floor((x2 - x1) * 0.05) AS BIGINT), 0) AS x1, least(x2 + CAST(floor((x2 - x1) * 0.05) AS BIGINT), 400) AS x2, least(y2 + CAST(floor((y2 - y1) * 0.05) AS BIGINT), 300) AS y2 FROM t WHERE nth = 1""")
def best_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS image", "l_returnflag AS label", "l_discount AS confidence", "cast(l_linenumber * 10 - 20 as bigint) AS x1", "cast(-5 as bigint) AS y1", f"{_P} % 500 AS x2", f"{_P} % 300 + 1 AS y2", "cast(400 as bigint) AS width", "cast(300 as bigint) AS height")
    return ops.best_detections(rows, "image").select("image", "label", "confidence", "x1", "x2", "y2")


@query("""SELECT o_orderkey AS card, 'Maram' AS name_arabic, '2020-05-06' AS issuance_date, CASE WHEN o_orderkey % 2 = 0 THEN 0.9 ELSE 0.6 END AS issuance_date_confidence,
concat('200', CAST(o_orderkey % 2 AS VARCHAR), '0000001') AS id_number, CASE WHEN o_orderkey % 2 = 1 THEN 'Male' ELSE 'Female' END AS gender, 0.0 AS place_of_birth_confidence FROM orders""")
def card_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    field = lambda side, label, value, conf: F.struct(F.lit(side).alias("side"), F.lit(label).alias("label"), value.alias("text"), F.lit(conf).alias("confidence"))
    number = F.concat(F.lit("200"), F.col("o_orderkey") % 2, F.lit("0000001"))
    rows = F.array(field("front", "name", F.lit(" Maram "), 0.8), field("front", "unique_id", number, 0.7), field("front", "issue_date", F.when(F.col("o_orderkey") % 2 == 0, F.lit("2020/5/6")).otherwise(F.lit(" ")), 0.9), field("back", "issue_date", F.lit("06-05-2020"), 0.6))
    found = ops.card_fields(o.select(F.col("o_orderkey").alias("card"), F.inline(rows)), "card")
    return found.select("card", "name_arabic", "issuance_date", "issuance_date_confidence", "id_number", "gender", "place_of_birth_confidence")


@query("""SELECT o_orderkey AS dump, n AS line_no, CASE n WHEN 0 THEN 'A' ELSE CAST(o_custkey AS VARCHAR) END AS text, CASE n WHEN 0 THEN 0.5 ELSE 0.25 END AS score FROM orders, (SELECT unnest([0, 2]) AS n)""")
def recogniser_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = F.format_string('{"rec_texts": [" A ", "  ", "%d"], "rec_scores": [0.5, 0.1, 0.25]}', "o_custkey")
    old = F.format_string('[[[1], [" A ", 0.5]], [[1], ["", 0.1]], [[2], ["%d", 0.25]]]', "o_custkey")
    dumps = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("dump"), F.when(F.col("o_orderkey") % 2 == 0, new).otherwise(old).alias("json"))
    return ops.lines_of(dumps, "dump", "json")


@query("SELECT p_partkey, CASE CAST(p_partkey % 3 AS INT) WHEN 0 THEN '12345678901' WHEN 1 THEN '123456789' ELSE '123456789012' END AS digits, CASE CAST(p_partkey % 3 AS INT) WHEN 0 THEN 'valid' WHEN 1 THEN 'incomplete_9_digits' ELSE 'incomplete_12_digits' END AS validation FROM part")
def number_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    lines = F.array(F.lit("123456789"), F.when(k % 3 > 0, F.lit("12")).otherwise(F.lit("12345678901")), F.when(k % 3 != 1, F.lit("123 456 789 012")).otherwise(F.lit("x")))
    return ops.best_digits(table(spark, sf_dir, "part").select("p_partkey", F.posexplode(lines).alias("line_no", "text")), "p_partkey")


@query("SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[a-zA-Z]')) AS latin, 'en' AS language FROM documents")
def document_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.count(F.col("text"), text.LATIN).cast("long").alias("latin"), text.text_language(F.coalesce("text", F.lit(""))).alias("language"))
