"""Registry, expiry and travel-document queries over ``customer`` and ``orders``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.functions import mrz
from attesta.operators import expiry, extract
from attesta.operators import registry as ops
from attesta.sources import tables

from .registry import over, query, table

_STATUS = "CASE o_orderstatus WHEN 'F' THEN 'verified' WHEN 'O' THEN 'failed' ELSE 'pending' END"




#: Every fifth order names a document that the registry lacks.
_KEY = "concat(CASE WHEN o_orderkey % 5 = 0 THEN 'N' ELSE 'D' END, o_custkey)"


def updates_of(orders: DataFrame) -> DataFrame:
    return orders.selectExpr("CASE WHEN o_orderkey % 5 = 0 THEN -o_custkey ELSE o_custkey END AS document_id", f"{_KEY} AS document_number", "o_orderpriority AS full_name", "case when o_orderkey % 2 = 0 then o_orderstatus end AS image", "cast(o_orderkey as string) AS transaction_id", "o_orderkey AS at")


_DOCS = "SELECT c_custkey AS document_id, concat('D', c_custkey) AS document_number, c_name AS full_name, concat('img', c_custkey % 7) AS image, CAST(NULL AS VARCHAR) AS transaction_id FROM customer"
_UPD = f"""SELECT * EXCLUDE (nth) FROM (SELECT CASE WHEN o_orderkey % 5 = 0 THEN -o_custkey ELSE o_custkey END AS document_id, {_KEY} AS document_number, o_orderpriority AS full_name, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS image,
CAST(o_orderkey AS VARCHAR) AS transaction_id, row_number() OVER (PARTITION BY {_KEY} ORDER BY o_orderkey DESC) AS nth FROM orders) WHERE nth = 1"""


def state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr("c_custkey AS document_id", "concat('D', c_custkey) AS document_number", "c_name AS full_name", "concat('img', c_custkey % 7) AS image", "cast(null as string) AS transaction_id")


@query(f"""WITH d AS ({_DOCS}), u AS ({_UPD})
SELECT coalesce(u.document_id, d.document_id) AS document_id, coalesce(u.document_number, d.document_number) AS document_number, CASE WHEN u.document_number IS NOT NULL THEN u.full_name ELSE d.full_name END AS full_name,
coalesce(u.image, d.image) AS image, coalesce(u.transaction_id, d.transaction_id) AS transaction_id FROM d FULL JOIN u USING (document_number)""")
def registry_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.upsert(state(spark, sf_dir), updates_of(table(spark, sf_dir, "orders")), ["document_number"], "at", ["document_id", "image", "transaction_id"])


@query(f"""WITH d AS (SELECT * FROM ({_DOCS})), n AS (SELECT * FROM ({_UPD}))
SELECT * FROM d UNION ALL BY NAME SELECT document_id, document_number, full_name, coalesce(image, 'Ordinary') AS image, transaction_id FROM n WHERE document_number NOT IN (SELECT document_number FROM d)""")
def registry_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = ops.newest(updates_of(table(spark, sf_dir, "orders")), ["document_number"], "at")
    return ops.insert_new(state(spark, sf_dir), new, ["document_number"], {"image": "Ordinary"})


@query(f"""WITH d AS ({_DOCS}), u AS ({_UPD})
SELECT d.document_id, d.document_number, coalesce(u.full_name, d.full_name) AS full_name, coalesce(u.image, d.image) AS image, d.transaction_id FROM d LEFT JOIN u USING (document_number)""")
def registry_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = ops.newest(updates_of(table(spark, sf_dir, "orders")), ["document_number"], "at")
    return ops.patch(state(spark, sf_dir), new, ["document_number"], ["full_name", "image"])


@query(f"""WITH d AS (SELECT * FROM ({_DOCS})), u AS ({_UPD})
SELECT d.document_id, document_number, coalesce(u.full_name, d.full_name) AS full_name, coalesce(u.image, d.image) AS image, d.transaction_id FROM d LEFT JOIN u USING (document_number)
UNION ALL BY NAME SELECT * FROM u WHERE document_number NOT IN (SELECT document_number FROM d)""")
def registry_save(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = ops.newest(updates_of(table(spark, sf_dir, "orders")), ["document_number"], "at")
    return ops.save_or_update(state(spark, sf_dir), new, ["document_number"], ["full_name", "image"])


@query("""SELECT 'found' AS kind, count(*) AS n FROM customer WHERE c_custkey IN (SELECT o_custkey * 2 FROM orders)
UNION ALL SELECT 'missing', count(*) FROM (SELECT DISTINCT o_custkey * 2 AS k FROM orders) WHERE k NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'left', count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey * 2 FROM orders)""")
def registry_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") * 2).alias("k"))
    count = lambda df, kind: df.agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n"))
    return count(ops.lookup(c, o, ["k"]), "found").union(count(ops.missing(c, o, ["k"]), "missing")).union(count(ops.delete(c, o, ["k"]), "left"))


@query("""SELECT c_custkey AS key, coalesce(v, c_mktsegment) AS value FROM customer LEFT JOIN (SELECT o_custkey, max_by(o_orderpriority, o_orderkey) AS v FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey
WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""")
def override_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings are set by the newest order of a customer, and removed where one is pending."""
    o = table(spark, sf_dir, "orders")
    held = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("value"))
    given = o.select(F.col("o_custkey").alias("key"), F.col("o_orderpriority").alias("value"), F.col("o_orderkey").alias("at")).join(held.select("key"), "key", "left_semi")
    return ops.delete(ops.upsert(held, given, ["key"], "at", []), o.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("key")), ["key"])


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def csv_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written with a header in the order asked for, without columns that the table lacks, and read back."""
    path = tables.scratch(spark, "csv")
    ops.export_csv(table(spark, sf_dir, "customer"), path, ["c_custkey", "c_name", "absent", "c_acctbal"])
    return spark.read.option("header", True).schema("c_custkey long, c_name string, c_acctbal double").csv(path)


@query("""SELECT 'request' AS event_type, '{"event_id":' || event_id || ',"user_id":' || user_id || '}' AS metadata, strftime(ts, '%Y-%m-%d %H:%M:%S') AS occurred_at FROM events""")
def audit_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Appended in two writes and read back."""
    path, e = tables.scratch(spark, "audit"), table(spark, sf_dir, "events")
    for part in ("event_id % 2 = 0", "event_id % 2 = 1"):
        tables.append(ops.audit_rows(e.where(part).select("event_id", "user_id"), "request", F.lit(None).cast("timestamp")), path)
    rows = tables.registry(spark, path, ["event_type", "metadata"])
    at = e.select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("occurred_at"))
    return rows.withColumn("event_id", F.get_json_object("metadata", "$.event_id").cast("long")).join(at, "event_id").drop("event_id")


@query(f"""SELECT o_orderkey AS id, {_STATUS} AS status, CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS VARCHAR) END AS verified_at FROM orders""")
def verification_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verifications appended one status after another, and read back by chosen columns."""
    path = tables.scratch(spark, "verifications")
    o = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", f"{_STATUS} AS status", "o_orderdate AS at")
    for status in ("verified", "failed", "pending"):
        tables.append(ops.verification_rows(o.where(F.col("status") == status), F.col("at")), path)
    return tables.registry(spark, path, ["id", "status", "verified_at"]).withColumn("verified_at", F.col("verified_at").cast("string"))


@query("SELECT c_custkey, octet_length(encode(c_name)) AS c_name_bytes FROM customer ORDER BY c_custkey LIMIT 5")
def registry_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.sample(table(spark, sf_dir, "customer"), ["c_custkey"], ["c_name"], "c_custkey")


@query(f"""SELECT o_orderkey AS id, o_custkey AS document_id, c_name AS full_name, {_STATUS} AS status, CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS verified_at,
row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS nth FROM customer JOIN orders ON c_custkey = o_custkey""")
def verification_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", "o_custkey AS document_id", f"{_STATUS} AS status", "o_orderdate AS at")
    rows = ops.verification_rows(o, F.col("at"))
    docs = state(spark, sf_dir).select("document_id", "full_name")
    numbered = ops.history(rows, ["document_id"], "at", "id").join(docs, "document_id")
    return numbered.select("id", "document_id", "full_name", "status", "verified_at", F.col("nth").cast("long").alias("nth"))


@query("SELECT o_orderkey AS id, o_orderdate AS verified_at, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) AS rank FROM orders WHERE o_orderstatus = 'F'")
def verified_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verified rows with their place, newest first."""
    o = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", f"{_STATUS} AS status", "o_orderdate AS at")
    return ops.verified_newest_first(ops.verification_rows(o, F.col("at")), "id").select("id", "verified_at", "rank")


@query("""SELECT a.o_orderkey AS document_call, b.o_orderkey AS verify_call, a.o_custkey AS transaction_id FROM (SELECT * FROM orders WHERE o_orderkey % 2 = 0) a JOIN (SELECT * FROM orders WHERE o_orderkey % 2 = 1) b ON a.o_custkey = b.o_custkey AND a.o_orderpriority = b.o_orderpriority""")
def transaction_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_custkey AS transaction_id", "o_orderpriority AS kind")
    a, b = o.where("o_orderkey % 2 = 0").withColumnRenamed("o_orderkey", "document_call"), o.where("o_orderkey % 2 = 1").withColumnRenamed("o_orderkey", "verify_call")
    return a.join(b, ["transaction_id", "kind"]).select("document_call", "verify_call", "transaction_id")


@query("SELECT count(*) AS rows, count(c_name) AS c_name_set, CAST(sum(octet_length(encode(c_name))) AS BIGINT) AS c_name_bytes, count(c_mktsegment) AS c_mktsegment_set, CAST(sum(octet_length(encode(c_mktsegment))) AS BIGINT) AS c_mktsegment_bytes FROM customer")
def registry_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.profile(table(spark, sf_dir, "customer"), ["c_name", "c_mktsegment"])


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CASE WHEN event_id % 2 = 0 THEN CAST(user_id AS VARCHAR) END AS v FROM events")
def hydrate_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").selectExpr("event_id", "props", "case when event_id % 2 = 0 then cast(user_id as string) end AS user")
    return ops.hydrate(e, "props", "k long, v string", {"v": "user"}).select("event_id", "k", "v")


#: Properties of three shapes, and some that are no JSON.
_PROPS = """SELECT event_id, user_id, CASE event_id % 5 WHEN 0 THEN props WHEN 1 THEN concat('{{"detail":{{"k":', CAST(user_id AS {s}), ',"tags":["a",{{"name":"', event_type, '"}}]}}}}')
WHEN 2 THEN concat('{{"k":"', CAST(event_id AS {s}), '","user":{{"name":"', event_type, '","age":', CAST(event_id % 90 AS {s}), '}}}}') WHEN 3 THEN concat('{{"k":', CAST(event_id AS {s})) END AS props FROM events"""
_PROPS_DUCK = _PROPS.replace("{{", "{").replace("}}", "}").replace("{s}", "VARCHAR")


@query(f"""SELECT event_id, CASE WHEN json_valid(props) THEN coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), TRY_CAST(json_extract_string(props, '$.detail.k') AS BIGINT)) END AS k,
CASE WHEN json_valid(props) THEN coalesce(json_extract_string(props, '$.detail.tags[1].name'), json_extract_string(props, '$.user.name')) END AS name, CASE WHEN json_valid(props) THEN TRY_CAST(json_extract_string(props, '$.user.age') AS DOUBLE) END AS age,
props IS NOT NULL AND NOT json_valid(props) AS malformed FROM ({_PROPS_DUCK})""")
def variant_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that stand at different paths, or nowhere, from row to row."""
    rows = over(spark, sf_dir, "events", _PROPS)
    return ops.variant_fields(rows, "props", {"k": ("bigint", ["$.k", "$.detail.k"]), "name": ("string", ["$.detail.tags[1].name", "$.user.name"]), "age": ("double", ["$.user.age"])}).drop("user_id")


@query(f"""SELECT event_id, CASE WHEN json_valid(props) THEN TRY_CAST(json_extract_string(props, '$.k') AS VARCHAR) END AS k, CASE WHEN user_id % 3 = 0 THEN 'u' || user_id WHEN json_valid(props) THEN json_extract_string(props, '$.user.name') END AS name,
CASE WHEN json_valid(props) THEN TRY_CAST(json_extract_string(props, '$.user.age') AS INTEGER) END AS age FROM ({_PROPS_DUCK}) WHERE event_id % 5 = 2""")
def hydrate_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record's nested name, replaced where the row has one of its own."""
    rows = over(spark, sf_dir, "events", _PROPS).where("event_id % 5 = 2").withColumn("own", F.when(F.col("user_id") % 3 == 0, F.concat(F.lit("u"), "user_id")))
    return ops.overlaid(rows, "props", "k string, user struct<name: string, age: int>", {"user.name": "own"}).select("event_id", "record.k", "record.user.name", "record.user.age")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE concat_ws(' ', CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END, 'B', CAST(c_nationkey AS VARCHAR)) END AS full_name FROM customer""")
def full_name_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third has a whole name; of the others some lack a part, as null or empty."""
    k = F.col("c_custkey")
    name = ops.full_name(F.when(k % 3 == 0, F.col("c_name")).when(k % 3 == 1, ""), F.when(k % 2 == 0, F.col("c_mktsegment")), F.lit(""), F.lit("B"), F.col("c_nationkey").cast("string"))
    return table(spark, sf_dir, "customer").select(k, name.alias("full_name"))


@query("SELECT c_nationkey, count(*) > 0 AS listed, true AS sized FROM customer GROUP BY c_nationkey")
def image_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of one kind in a folder tree that also holds others; only names, times and lengths are read."""
    path = tables.scratch(spark, "files")
    c = table(spark, sf_dir, "customer")
    c.write.partitionBy("c_nationkey").parquet(f"{path}/wanted")
    c.select("c_name").write.text(f"{path}/others")
    found = tables.images(spark, path, (".parquet",))
    nation = F.regexp_extract("path", "c_nationkey=([0-9]+)", 1).cast("long")
    return found.groupBy(nation.alias("c_nationkey")).agg((F.count("*") > 0).alias("listed"), (F.min("length") > 0).alias("sized"))


_DAYS = "CAST(o_orderdate AS DATE) + CAST(o_custkey % 4000 AS INT) - DATE '2001-01-01'"


@query(f"""SELECT o_orderkey, {_DAYS} AS days, CASE WHEN {_DAYS} < 0 THEN 'expired' WHEN {_DAYS} <= 90 THEN 'expiring_soon' ELSE 'valid' END AS status, {_DAYS} < 0 AND {_DAYS} >= -30 AS in_grace,
CASE WHEN {_DAYS} < -30 THEN 'critical' WHEN {_DAYS} <= 30 THEN 'warning' WHEN {_DAYS} <= 90 THEN 'info' ELSE 'none' END AS severity FROM orders""")
def document_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.date_format(F.date_add(F.col("o_orderdate").cast("date"), (F.col("o_custkey") % 4000).cast("int")), "dd/MM/yyyy").alias("expiry"))
    return expiry.check(o, ref=F.lit("2001-01-01").cast("date")).select("o_orderkey", "days", "status", "in_grace", "severity")


_VALID = "(o_custkey % 9000 - 500)"


@query(f"""SELECT o_orderkey, {_VALID} > 0 AND o_orderkey % 5 > 0 AS sequence_ok, CASE WHEN {_VALID} > 0 THEN {_VALID} END AS validity_days, CASE WHEN {_VALID} > 0 THEN round({_VALID} / 365.25, 1) END AS validity_years,
CAST(o_orderkey % 5 = 0 AS INT) + CAST({_VALID} <= 0 AS INT) + CAST({_VALID} > 0 AND ({_VALID} / 365.25 < 1 OR {_VALID} / 365.25 > 20) AS INT) AS n_warnings FROM orders""")
def document_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    issue = F.col("o_orderdate").cast("date")
    text = lambda d: F.date_format(d, "yyyy-MM-dd")
    birth = F.date_sub(issue, F.when(F.col("o_orderkey") % 5 == 0, 0).otherwise(9000))
    o = table(spark, sf_dir, "orders").select("o_orderkey", text(issue).alias("issue"), text(F.date_add(issue, (F.col("o_custkey") % 9000 - 500).cast("int"))).alias("expiry"), text(birth).alias("birth"))
    found = expiry.sequence(o, "issue", "expiry", "birth", F.lit("2001-01-01").cast("date"))
    return found.select("o_orderkey", "sequence_ok", "validity_days", "validity_years", F.size("warnings").alias("n_warnings"))


_LINES = """
SELECT c_custkey, rpad(concat('P<YEM', upper(replace(c_mktsegment, ' ', '<')), '<<', upper(replace(replace(c_name, '#', '<'), ' ', '<'))), 44, '<') AS line1, concat(lpad(cast(c_custkey as {s}), 9, '0'), 'C', 'YEM', lpad(cast(c_custkey % 100 as {s}), 2, '0'), '0315', 'D', case when c_custkey % 2 = 0 then 'M' else 'F' end, '300101', 'E', rpad(cast(c_nationkey as {s}), 14, '<'), '<', 'G') AS line2
FROM customer"""


def _digit(x: str) -> str:
    value = "CASE WHEN ascii(x) BETWEEN 48 AND 57 THEN ascii(x) - 48 WHEN ascii(x) BETWEEN 65 AND 90 THEN ascii(x) - 55 ELSE 0 END"
    return f"CAST(list_sum(list_transform(string_split({x}, ''), lambda x, i: ({value}) * [7, 3, 1][(i - 1) % 3 + 1])) % 10 AS VARCHAR)"


def with_digits(df: DataFrame) -> DataFrame:
    """Put computed check digits where C, D, E and G stand; every 13th composite one is wrong."""
    b = F.col("line2")
    part = lambda begin, n: F.substring(b, begin, n)
    filled = df.withColumn("line2", F.concat(part(1, 9), mrz.check_digit(part(1, 9), 9), part(11, 9), mrz.check_digit(part(14, 6), 6), part(21, 7), mrz.check_digit(part(22, 6), 6), part(29, 15), F.lit("G")))
    total = mrz.check_digit(F.concat(part(1, 10), part(14, 7), part(22, 22)), 39)
    last = F.when(F.col("c_custkey") % 13 == 0, ((total.cast("int") + 1) % 10).cast("string")).otherwise(total)
    return filled.withColumn("line2", F.concat(part(1, 43), last))


@query(f"""SELECT c_custkey, upper(c_mktsegment) AS surname, lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS passport_number, CASE WHEN c_custkey % 2 = 0 THEN 'Male' ELSE 'Female' END AS gender,
CAST(CASE WHEN c_custkey % 100 <= 40 THEN 2000 ELSE 1900 END + c_custkey % 100 AS VARCHAR) || '-03-15' AS date_of_birth, CAST(c_nationkey AS VARCHAR) AS personal_number, c_custkey % 13 > 0 AS valid,
CASE WHEN c_custkey % 13 > 0 THEN 0.99 ELSE 0.85 END AS confidence, {_digit("lpad(CAST(c_custkey AS VARCHAR), 9, '0')")} AS digit FROM customer""")
def mrz_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_digits(over(spark, sf_dir, "customer", _LINES))
    found = rows.select("c_custkey", mrz.parse(F.col("line1"), F.col("line2")).alias("m"), F.substring("line2", 10, 1).alias("digit"))
    return found.select("c_custkey", *(f"m.{c}" for c in ("surname", "passport_number", "gender", "personal_number", "valid", "confidence")), F.col("m.date_of_birth").cast("string").alias("date_of_birth"), "digit")


def _zone_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_digits(over(spark, sf_dir, "customer", _LINES))
    return rows.select(F.col("c_custkey").alias("document_id"), F.posexplode(F.array(F.lit("REPUBLIC"), F.lower("line1"), F.when(F.col("c_custkey") % 5 > 0, F.col("line2")).otherwise("TORN"), F.lit("SIGNATURE"))).alias("line_no", "text"))


@query("""SELECT c_custkey AS document_id, lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS passport_number, c_custkey % 13 > 0 AS valid, true AS complete FROM customer WHERE c_custkey % 5 > 0""")
def mrz_from_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zones found among other lines; documents without two fitting lines are quarantined."""
    parsed, _ = extract.mrz_zones(_zone_lines(spark, sf_dir), "document_id")
    return parsed.select("document_id", "m.passport_number", "m.valid", F.col("m.surname").isNotNull().alias("complete"))


@query("SELECT c_custkey AS document_id FROM customer WHERE c_custkey % 5 = 0")
def mrz_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents without two fitting lines."""
    return extract.mrz_zones(_zone_lines(spark, sf_dir), "document_id")[1]


@query("""SELECT c_custkey, CASE WHEN zone THEN upper(c_mktsegment) ELSE 'Printed' END AS surname, CAST(CASE WHEN zone THEN sure ELSE 0.7 END AS DOUBLE) AS surname_confidence, CASE WHEN zone THEN CASE WHEN c_custkey % 2 = 0 THEN 'Male' ELSE 'Female' END END AS gender, CAST(CASE WHEN zone THEN sure ELSE 0.0 END AS DOUBLE) AS gender_confidence,
CASE WHEN zone THEN lpad(CAST(c_custkey AS VARCHAR), 9, '0') ELSE 'P' || c_custkey END AS passport_number FROM (SELECT *, c_custkey % 4 > 0 AS zone, CASE WHEN c_custkey % 13 > 0 THEN 0.99 ELSE 0.85 END AS sure FROM customer)""")
def passport_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The zone over the print; a quarter of the passports have no zone, and no print shows a gender."""
    c = table(spark, sf_dir, "customer")
    zones = with_digits(over(spark, sf_dir, "customer", _LINES)).where("c_custkey % 4 > 0").select("c_custkey", mrz.parse(F.col("line1"), F.col("line2")).alias("m"))
    printed = c.select("c_custkey", F.lit("Printed").alias("surname"), F.lit(None).cast("string").alias("gender"), F.concat(F.lit("P"), "c_custkey").alias("passport_number"), F.lit(0.7).alias("confidence"))
    found = extract.passport_fields(printed, zones, "c_custkey", ["surname", "gender", "passport_number"])
    return found.select("c_custkey", "surname", "surname_confidence", "gender", "gender_confidence", "passport_number")


_PASSPORT = """SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN '12AB' ELSE lpad(CAST(c_custkey AS {s}), 8, '0') END AS passport_number, CASE WHEN c_custkey % 7 > 0 THEN c_name END AS surname,
CASE WHEN c_custkey % 3 = 0 THEN ' ' ELSE '1990-01-01' END AS date_of_birth, CASE WHEN c_custkey % 11 > 0 THEN concat(CAST(2015 + c_custkey % 20 AS {s}), '-06-30') END AS expiry_date FROM customer"""


@query(f"""SELECT c_custkey, concat_ws('; ', CASE WHEN passport_number = '' THEN 'passport_number is missing' END, CASE WHEN surname IS NULL THEN 'surname is missing' END, CASE WHEN trim(date_of_birth) = '' THEN 'date_of_birth is missing' END,
CASE WHEN expiry_date IS NULL THEN 'expiry_date is missing' END, CASE WHEN NOT regexp_full_match(passport_number, '[0-9]{{8,9}}') THEN 'passport_number is malformed' END, CASE WHEN expiry_date < '2024-01-01' THEN 'passport has expired' END) AS issues FROM ({_PASSPORT.replace("{s}", "VARCHAR")})""")
def passport_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract.passport_issues(over(spark, sf_dir, "customer", _PASSPORT), F.lit("2024-01-01").cast("date"))
    return found.select("c_custkey", F.array_join("issues", "; ").alias("issues"))


@query("SELECT c_custkey, left(rpad('P<YEM' || upper(c_name) || repeat(upper(c_mktsegment), CAST(c_custkey % 6 AS INT)), 44, '<'), 44) AS line FROM customer")
def fitted_zone_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit(" p<yem"), F.lower("c_name"), F.repeat(F.lower("c_mktsegment"), (F.col("c_custkey") % 6).cast("int")))
    return table(spark, sf_dir, "customer").select("c_custkey", mrz.fit(raw).alias("line"))
