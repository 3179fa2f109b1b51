"""Policy totals on a limit; what searches of galleries write, and groups of like faces."""

import random
from functools import reduce
from operator import add

import numpy as np
import pytest

from attesta.operators import faces, policy, rules

LEAVES = {r[1]: (r[2], r[5]) for r in rules.POLICY if r[1] and r[6]}
CAPS = {r[0]: r[5] for r in rules.POLICY if r[3] == 1}


def totals(scores: dict[str, float], keys: list[str]) -> tuple[float, dict[str, float]]:
    """The root's points and the categories', added in the order of ``keys``."""
    given = {}
    for key in keys:
        parent, most = LEAVES[key]
        given[parent] = given.get(parent, 0.0) + scores[key] * 100 / 100 * most
    given = {c: min(p, CAPS[c]) for c, p in given.items()}
    return min(reduce(add, given.values()), 100.0), given  # sum() corrects itself


@pytest.mark.parametrize("parts", [1, 5])
def test_points_are_added_in_the_trees_order(spark, parts):
    """Sums of the same points in another order fall on the other side of a limit; rows come in any order."""
    draw, keys, subjects = random.Random(parts), list(LEAVES), []
    while len(subjects) < 300:
        scores = {k: draw.randrange(10_001) / 10_000 for k in keys}
        if len(subjects) >= 200:
            # Document points on their limit of 30, in tenths of a thousandth, where the order of addition decides.
            scores["ocr_confidence"] = (300_000 - 5 * round(1e4 * scores["front_back_match"]) - 10 * round(1e4 * (scores["doc_authenticity"] + scores["doc_quality"]))) / 100_000
            if not 0 <= scores["ocr_confidence"] <= 1 or len({totals(scores, order)[1]["document_verify"] >= 30 for order in (keys, keys[::-1], keys[1:] + keys[:1])}) == 1:
                continue
        subjects.append(scores)
    rows = [(i, k, v) for i, scores in enumerate(subjects) for k, v in scores.items()]
    draw.shuffle(rows)
    found = policy.components(spark.createDataFrame(rows, "subject int, score_key string, raw double").repartition(parts), rules.policy_defaults(spark))
    got = {(r.subject, r.component): r for r in found.collect()}
    for i, scores in enumerate(subjects):
        total, given = totals(scores, keys)
        assert got[i, "ekyc"].points == total
        assert {c: got[i, c].points for c in given} == given
        assert got[i, "document_verify"].passed == (given["document_verify"] >= 30)


def shuffled(spark, run):
    """What ``run`` returns, and the bytes that its stages wrote for others."""
    store, jvm = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jvm
    stages = lambda: store.stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    of = lambda found: {found.apply(i).stageId(): found.apply(i).shuffleWriteBytes() for i in range(found.size())}
    before = of(stages())
    out = run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return out, sum(n for k, n in of(stages()).items() if k not in before)


@pytest.fixture
def large(spark):
    """Tables are joined as large ones are: none is sent to all executors."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def rows_of(spark, ids, vectors, parts):
    return spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, vectors, strict=True)], "id long, vector array<double>").repartition(parts)


def all_pairs(ids, asked, other, held, at_least):
    a, b = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (asked, held))
    score = np.round((a @ b.T + 1) / 2, 12)
    return {(int(ids[i]), int(other[j])): score[i, j] for i, j in zip(*np.nonzero(score >= at_least), strict=True) if ids[i] != other[j]}


def test_exact_search_writes_no_copies(large):
    """Forty shards and forty blocks: each vector is shuffled once, not once for each shard."""
    draw = np.random.default_rng(3)
    held = draw.standard_normal((2000, 24))
    asked = held + 0.9 * draw.standard_normal(held.shape)
    ids, other = np.arange(1000, 3000), np.arange(2000)
    probes, gallery = rows_of(large, ids, asked, 3), rows_of(large, other, held, 4)
    got, written = shuffled(large, lambda: faces.similar_exact(probes, gallery, 0.8, shard_rows=50, block_rows=50).collect())
    want = all_pairs(ids, asked, other, held, 0.8)
    assert len(want) > 1000 and len(got) == len(want) and {(r.query_id, r.vec_id): r.score for r in got} == pytest.approx(want, abs=1e-11)
    assert written < 8 * (asked.nbytes + held.nbytes)


def test_exact_search_by_any_limit(spark):
    """Limits at which all pairs or none are kept; vectors without a length score 0; a row does not find itself."""
    vectors = np.array([[1.0, 0.0], [-1.0, 0.0], [0.6, 0.8], [0.0, 0.0]])
    rows = rows_of(spark, range(4), vectors, 2)
    found = {limit: {(r.query_id, r.vec_id): r.score for r in faces.similar_exact(rows, rows, limit).collect()} for limit in (0.0, 0.5, 0.8, 1.0)}
    assert len(found[0.0]) == 12 and found[0.0][0, 1] == found[0.0][0, 3] == 0.0
    assert found[0.5] == found[0.8] == {(0, 2): 0.8, (2, 0): 0.8} and not found[1.0]


def test_bucketed_join_writes_rows_and_results(large):
    """Pairs that meet in a bucket by chance are never written: about a row for each table, and what is found."""
    draw = np.random.default_rng(4)
    held = draw.standard_normal((2500, 16))
    asked = held[:2000] + 0.6 * draw.standard_normal((2000, 16))
    ids, other = np.arange(10_000, 12_000), np.arange(2500)
    probes, gallery = rows_of(large, ids, asked, 3), rows_of(large, other, held, 4)
    got, written = shuffled(large, lambda: faces.similar(probes, gallery, 0.85, 0.95).collect())
    want = all_pairs(ids, asked, other, held, 0.85)
    found = {(r.query_id, r.vec_id): r.score for r in got}
    assert len(found) == len(got) and set(found) <= set(want) and len(found) >= 0.95 * len(want) > 1000
    assert found == pytest.approx({k: want[k] for k in found}, abs=1e-11)
    tables = faces.plan_of(2500, 2000, 0.85, 0.95)[1]
    assert written < (tables + 4) * 1.5 * (asked.nbytes + held.nbytes) + 100 * len(found)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_full_buckets_are_dealt(spark, kind):
    """A group of like faces, many times what meets in a task, loses no pair; rows do not find themselves."""
    draw = np.random.default_rng(6)
    held = np.concatenate([draw.standard_normal((300, 12)), 0.02 * draw.standard_normal((400, 12)) + draw.standard_normal(12), np.zeros((1, 12))]).astype(np.float32)
    rows = rows_of(spark, range(701), held, 5)
    gallery = rows.selectExpr("id", f"CAST(vector AS array<{kind}>) AS vector").unionByName(spark.createDataFrame([(800, None)], "id long, vector array<double>").selectExpr("id", f"CAST(vector AS array<{kind}>) AS vector"))
    want = all_pairs(np.arange(700), held[:700].astype(float), np.arange(700), held[:700].astype(float), 0.95)
    got = {meet: {(r.query_id, r.vec_id): r.score for r in faces.similar(rows.where("id < 700"), gallery, 0.95, 0.999_999, meet_rows=meet).collect()} for meet in (30, 16384)}
    assert got[30] == got[16384] and set(got[30]) == set(want) and len(want) >= 400 * 399
