"""Exact sums, gallery joins, file intake, global ranks, JSON of changing shape, places without a shuffle, split outputs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from attesta.operators import faces, forms, intake, places, reconcile, registry, rules
from attesta.plans import registry as plans

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("parts", [1, 4, 17])
def test_scores_do_not_depend_on_the_order_of_rows(spark, parts):
    """Field scores whose float sums fall on either side of a half, in any order and partitioning."""
    draw = random.Random(parts)
    kinds = {r[1]: r[2] for r in rules.FIELDS}
    rows = [(i, f, kinds[f], k, draw.choice([0.1, 0.2, 0.3, 0.7, 0.95, 1 / 3]), "pass", False) for i in range(60) for k, f in enumerate(kinds)]
    scores = {}
    for i, f, severity, _, score, _, _ in rows:
        scores.setdefault(i, {}).setdefault(severity, []).append(round(score * 10**12))
    draw.shuffle(rows)
    found = spark.createDataFrame(rows, "submission_id int, field string, severity string, ord int, score double, decision string, fraud boolean").repartition(parts)
    for r in reconcile.summarise(found).collect():
        tenths = sum(round(10 * w) * ((sum(s) + len(s) // 2) // len(s)) for severity, w in rules.WEIGHTS for s in [scores[r.submission_id][severity]])
        assert r.overall_score == tenths / 10**13 and r.normalised_score == pytest.approx(tenths / 17 / 10**12, abs=1e-15)
        hundredths = (tenths + 5 * 10**8) // 10**9
        assert r.recommendations[-1] == f"Weighted matching score: {hundredths // 100}.{hundredths % 100:02d}%"


def test_halves_of_a_percentage_go_up(spark):
    got = spark.createDataFrame([(9777500000000,), (9777450000000,), (9777449999999,), (0,), (17000000000000,)], "t long").select(reconcile.percent(F.col("t")).alias("p")).collect()
    assert [r.p for r in got] == ["97.78%", "97.77%", "97.77%", "0.00%", "170.00%"]


@pytest.fixture(scope="module")
def gallery(spark):
    draw = np.random.default_rng(5)
    people = draw.standard_normal((1500, 32))
    seen = people[:300] + 0.45 * draw.standard_normal((300, 32))
    rows = [(i, v.tolist()) for i, v in enumerate(people)] + [(2000, people[0].tolist()), (2001, [0.0] * 32), (2002, None)]
    asked = [(10_000 + i, v.tolist()) for i, v in enumerate(seen)] + [(20_000, [0.0] * 32), (20_001, None)]
    schema = "id long, vector array<double>"
    return spark.createDataFrame(asked, schema).repartition(3), spark.createDataFrame(rows, schema).repartition(4)


def test_recall_of_the_bucketed_join(gallery):
    """Nothing wrong is returned, and at least the promised share of the exact pairs, at the limit as well."""
    exact = {(r.query_id, r.vec_id): r.score for r in faces.similar_exact(*gallery, at_least=0.9, shard_rows=400, block_rows=64).collect()}
    found = {(r.query_id, r.vec_id): r.score for r in faces.similar(*gallery, at_least=0.9, recall=0.95).collect()}
    assert len(exact) > 200 and set(found) <= set(exact) and len(found) >= 0.95 * len(exact)
    assert all(found[p] == pytest.approx(exact[p], abs=1e-9) for p in found)


def test_top_k_over_shards_and_blocks(gallery):
    asked, held = gallery
    got = {}
    for r in faces.top_k(asked, held, k=3, shard_rows=100, block_rows=50).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    vectors = {r.id: np.array(r.vector) for r in held.where("vector IS NOT NULL").collect()}
    for q in asked.where("vector IS NOT NULL").collect():
        n = np.linalg.norm(q.vector)
        score = {i: round(min(1, max(0, (np.dot(q.vector, v) / (n * m) + 1) / 2)), 12) if n * (m := np.linalg.norm(v)) else 0.0 for i, v in vectors.items()}
        want = sorted(score, key=lambda i: (-score[i], i))[:3]
        assert [got[q.id][k][0] for k in (1, 2, 3)] == want
    assert 20_001 not in got


def test_buckets_follow_the_gallery():
    bits = [faces.plan_of(n, 10_000, 0.9, 0.95)[0] for n in (10**3, 10**6, 10**9)]
    assert bits == sorted(bits) and bits[0] < bits[2]


def test_intake_takes_each_file_once(spark, tmp_path):
    folder, ledger = tmp_path / "cards", str(tmp_path / "ledger")
    folder.mkdir()
    for name, content in (("a.PNG", b"\x89PNG\r\n"), ("b.jpg", b"\xff\xd8\xff\xe0"), ("torn.png", b"oops"), ("notes.txt", b"x")):
        (folder / name).write_bytes(content)
    lines = spark.createDataFrame([("a.PNG", 0, "ID 12345678901", 0.8), ("a.PNG", 1, "12345678901", 0.9), ("c.png", 0, "4455-6677-88", 0.5), ("torn.png", 0, "12345678901", 1.0)], "image string, line_no int, text string, score double")
    intake.take(spark, str(folder), lines, ledger, 0, check=True)
    first = {r.image: r for r in intake.ledger_of(spark, ledger).collect()}
    assert {k: (r.status, r.extracted_id, r.id_type, r.new_name, r.error) for k, r in first.items()} == {
        "a.PNG": ("processed", "12345678901", "national_id", "12345678901_id.png", None),
        "b.jpg": ("failed", None, None, None, "No ID found in: b.jpg"),
        "torn.png": ("failed", None, None, None, "Could not read: torn.png"),
    }
    (folder / "c.png").write_bytes(b"II*\0")
    (folder / "b.jpg").write_bytes(b"BM replaced")
    for batch in (1, 2):  # the last intake finds nothing new
        intake.take(spark, str(folder), lines, ledger, batch, check=True)
    done = intake.ledger_of(spark, ledger)
    assert sorted((r.image, r.batch) for r in done.collect()) == [("a.PNG", 0), ("b.jpg", 0), ("b.jpg", 1), ("c.png", 1), ("torn.png", 0)]
    assert tuple(intake.summary(done).first()) == (5, 2, 3)


@pytest.mark.parametrize("rows", [0, 1, 3000])
def test_global_rank(spark, rows):
    draw = random.Random(1)
    values = [(i, draw.choice([None, *range(40)])) for i in range(rows)]
    df = spark.createDataFrame(values, "id int, v int").repartition(5)
    got = sorted(((r.rank, r.id) for r in registry.ranked(df, [F.col("v").desc(), F.col("id")]).collect()))
    want = sorted(values, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert got == [(k + 1, r[0]) for k, r in enumerate(want)]


def test_newest_takes_one_whole_row(spark):
    rows = [("a", 1, "x", None), ("a", 2, None, "p"), ("a", 2, "y", None), ("b", None, "z", "q"), ("b", None, "z", None)]
    got = registry.newest(spark.createDataFrame(rows, "k string, at int, v string, w string"), ["k"], "at")
    assert sorted(map(tuple, got.collect())) == [("a", 2, "y", None), ("b", None, "z", "q")]
    assert "Window" not in plan(got)


def test_json_of_changing_shape(spark):
    rows = [(1, '{"k": 5}'), (2, '{"d": {"k": "6", "t": [1, {"n": "x"}]}}'), (3, '{"k": {"deep": 1}}'), (4, "{"), (5, None), (6, "[]"), (7, '{"k": null, "d": {"k": 8}}')]
    df = spark.createDataFrame(rows, "id int, j string")
    got = {r.id: (r.k, r.n, r.malformed) for r in registry.variant_fields(df, "j", {"k": ("bigint", ["$.k", "$.d.k"]), "n": ("string", ["$.d.t[1].n"])}).collect()}
    assert got == {1: (5, None, False), 2: (6, "x", False), 3: (None, None, False), 4: (None, None, True), 5: (None, None, False), 6: (None, None, False), 7: (8, None, False)}


def test_nested_overlay(spark):
    rows = [(1, '{"a": {"b": "old", "c": 1}, "d": 2}', "new"), (2, '{"a": {"b": "old", "c": 1}}', None), (3, '{"d": 5}', "new")]
    df = spark.createDataFrame(rows, "id int, j string, own string")
    got = {r.id: r.record for r in registry.overlaid(df, "j", "a struct<b: string, c: int>, d int", {"a.b": "own"}).collect()}
    assert (got[1].a.b, got[1].a.c, got[1].d, got[2].a.b, got[3].d) == ("new", 1, 2, "old", 5)


def test_places_need_no_shuffle(spark):
    rows = [(1, "صنعاء - معين", "صنعاء", 1.0), (1, "عدن", "عدن", 0.5), (2, None, "عدن", 1.0), (3, "عدن", None, 1.0)]
    got = places.validate(spark.createDataFrame(rows, "id int, extracted string, typed string, confidence double"))
    assert "Exchange" not in plan(got) and "Join" not in plan(got)
    assert sorted((r.id, r.score, r.governorate) for r in got.collect()) == [(1, 0.3, "عدن"), (1, 0.6, "صنعاء"), (2, 0.0, "عدن"), (3, 1.0, "عدن")]


def test_forms_are_split_in_one_pass(spark, tmp_path):
    good = ("national_id", "20010012345", None, "Maram Raed", None, None, "Female", "Aden", "1990-01-02", None, None)
    bad = ("passport", None, "12", "Maram 1", None, None, None, "Aden", "1990-01-02", None, None)
    names = "id_type id_number passport_number full_name name_arabic name_english gender place_of_birth date_of_birth issuance_date expiry_date".split()
    checked = forms.validate(spark.createDataFrame([good, bad, good], ", ".join(f"{n} string" for n in names)), F.lit("2024-06-01").cast("date"))
    seen = forms.write_split(checked, str(tmp_path / "out"))
    kept = {r.outcome: r["count"] for r in spark.read.parquet(str(tmp_path / "out")).groupBy("outcome").count().collect()}
    assert kept == {"valid": 2, "invalid": 1} and (seen["rows"], seen["invalid"]) == (3, 1)
    told = spark.read.parquet(str(tmp_path / "out/outcome=invalid")).select(F.inline("errors")).collect()
    assert {tuple(r) for r in told} == {("passport_number", "must be 8 digits"), ("gender", "required"), ("name_english", "letters only")} and seen["errors"] == 3


def test_queries_leave_views_alone(spark):
    spark.range(3).createOrReplaceTempView("customer")
    plans.over(spark, SF, "customer", "SELECT c_custkey FROM customer").count()
    assert spark.table("customer").count() == 3
    spark.catalog.dropTempView("customer")
