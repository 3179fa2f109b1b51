"""Each operator against plain Python on small tables, with nulls, empty texts, ties and repeated rows."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

from attesta.llm import decontaminate, html, knn, langid, lmscore, mixing, nearcopies, oracle, pii, simhash, tokens, warc
from attesta.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, words int, id string"


def lower(t):
    return (t or "").encode().lower().decode()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows and ids, columns with clashing names."""
    rows = [
        (1, None, None, None, None, 1, "x"), (2, "", "en", "s", 0, 1, "x"), (None, "a b c d", "en", "s", 7, 1, None), (3, "a b c d", "en", None, 7, 1, "x"),
        (3, "a b c d", "en", None, 7, 1, "x"), (4, "one", "en", "t", 3, 1, "x"), (5, "the quick brown fox jumps over the lazy dog again " * 400, "en", "t", 1, 1, "x"), (6, "\t\n ", "en", "s", 3, 1, "x"),
    ]
    return spark.createDataFrame(rows, DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


# 1 mixing
def plain_targets(sizes, share=1.5, most=2.0):
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    target, open_, left = {}, set(sizes), share * sum(sizes.values())
    while open_:
        level = left / sum(weights[s] for s in open_)
        full = {s for s in open_ if weights[s] * level > most * sizes[s] + 1e-9}
        if not full:
            return target | {s: weights[s] * level for s in open_}
        for s in full:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def test_mixing(docs):
    rows = mixing.mix(docs, shard_words=2000, group_shards=4).collect()
    size = {}
    for r in rows:
        size[r.source] = size.get(r.source, 0) + r.size
    target = plain_targets(size)
    taken = {}
    for r in rows:
        taken[r.source] = taken.get(r.source, 0) + r.taken
        assert 0 <= r.taken <= 2 * r.size and r.source_size == size[r.source] and abs(r.target - target[r.source]) < 1e-6
    for s, t in target.items():
        assert abs(taken[s] - t) <= max(64, 0.02 * t)
    again = mixing.mix(docs.repartition(5), shard_words=2000, group_shards=4).collect()
    assert sorted((r.doc_id, r.taken) for r in rows) == sorted((r.doc_id, r.taken) for r in again)


def highest(shares, seats):
    """Seats by highest quotients, ties to the first."""
    won = [0] * len(shares)
    for _ in range(seats):
        won[max(range(len(shares)), key=lambda i: (shares[i] / (2 * won[i] + 1), -i))] += 1
    return won


def test_mixing_takes_blocks(spark, docs):
    """Every document's taken words, by dealing blocks one by one and laying out every word."""
    block, most, seed = 16, 2, 7
    options = {"shard_words": 1500, "group_shards": 3}
    got = mixing.mix(docs, **options)
    place = docs.selectExpr("doc_id", f"xxhash64({seed + 1}, doc_id) AS place")
    rows = got.join(place, "doc_id").withColumn("at", F.xxhash64(F.lit(seed + 2), "source", "shard")).collect()
    sources = sorted({(r.source is None, r.source or "", r.source) for r in rows})
    target = {r.source: r.target for r in rows}
    wins = dict(zip([s for *_, s in sources], highest([target[s] for *_, s in sources], round(sum(target.values()) / block)), strict=True))
    want = {}
    for *_, source in sources:
        mine = [r for r in rows if r.source == source]
        size = Counter()
        for r in mine:
            size[r.shard] += r.size
        groups = sorted({k // options["group_shards"] for k in size})
        for g, seats in zip(groups, highest([sum(n for k, n in size.items() if k // options["group_shards"] == g) for g in groups], wins[source]), strict=True):
            shards = sorted(k for k in size if k // options["group_shards"] == g)
            for k, quota in zip(shards, highest([size[k] for k in shards], seats), strict=True):
                n = max(1, -(-size[k] // block))
                line = sorted((r for r in mine if r.shard == k), key=lambda r: (r.place, r.doc_id, r.size))
                start, more = (line[0].at % n, quota % n)
                times = [quota // n + ((j + 1) * more + start) // n - (j * more + start) // n for j in range(n)]
                end = 0
                for r in line:
                    want[r.doc_id] = min(sum(times[w // block] for w in range(end, end + r.size)), most * r.size)
                    end += r.size
    assert {r.doc_id: r.taken for r in rows} == want


def test_mixing_odd(spark, odd):
    rows = mixing.mix(odd).collect()
    assert len(rows) == 8 and sum(r.size for r in rows) == 4 * 3 + 1 + 4000
    assert all(r.taken == 0 for r in rows if r.size == 0)
    assert mixing.mix(empty(spark)).count() == 0
    assert {r.target for r in mixing.mix(odd.where("doc_id = 1")).collect()} == {0.0}


def test_highest_quotients(spark):
    shares = [340, 280, 160, 60, 15, 0]
    df = spark.createDataFrame([(str(i), float(s), 15) for i, s in enumerate(shares)], "party string, share double, seats long")
    got = {r.party: r.quota for r in mixing.apportion(df, [], ["party"], "share", "seats").collect()}
    won = [0] * len(shares)
    for _ in range(15):
        won[max(range(6), key=lambda i: shares[i] / (2 * won[i] + 1))] += 1
    assert [got[str(i)] for i in range(6)] == won


# 2 language-model scores
def plain_scores(rows, wanted):
    """Losses and scores by counting whole words and pairs of words; also the models, to sum them up."""
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    texts = [(i, word.findall(lower(t))) for i, t in rows]
    models = []
    for keep in (lambda i: i in wanted, lambda i: True):
        uni, bi, before = Counter(), Counter(), Counter()
        for i, w in texts:
            if w and keep(i):
                uni.update([*w, "</s>"])
                bi.update(zip(["<s>", *w], [*w, "</s>"]))
                before.update(["<s>", *w])
        models.append((uni, bi, before, uni.total()))
    kinds = set(models[1][0])

    def p(model, h, w):
        uni, bi, before, total = model
        own = (uni[w] + lmscore.PRIOR) / (total + lmscore.PRIOR * len(kinds))
        return (bi[h, w] + lmscore.STRENGTH * own) / (before[h] + lmscore.STRENGTH)

    out = []
    for i, w in texts:
        loss = [-sum(math.log(p(m, h, x)) for h, x in zip(["<s>", *w], [*w, "</s>"])) / (len(w) + 1) if w else 0.0 for m in models]
        out.append((i, len(w), *loss, loss[0] - loss[1]))
    return out, models, kinds, p


@pytest.mark.parametrize("options", [{}, {"block_bytes": 20_000, "bucket_words": 3000}])
def test_lm_score(spark, docs, options):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    wanted = {r.doc_id for r in labels.where("quality = 1").collect()}
    want, models, kinds, p = plain_scores([(r.doc_id, r.text) for r in docs.collect()], wanted)
    got = sorted(tuple(r) for r in lmscore.cross_entropy_difference(docs, labels, **options).collect())
    assert [r[:2] for r in got] == sorted(r[:2] for r in want)
    assert np.allclose([r[2:] for r in got], [r[2:] for r in sorted(want)], rtol=0, atol=1e-9)
    for model in models:  # probabilities sum to one, also after a history that the model has not seen
        for h in ["<s>", "never seen", *list(kinds)[:20]]:
            assert abs(sum(p(model, h, w) for w in kinds) - 1) < 1e-9


def test_lm_score_odd(spark, odd):
    """Nulls, repeated rows, an id on several rows, a long text, no wanted document, empty tables."""
    labels = spark.createDataFrame([(3, 1), (3, 1), (None, 1), (99, 1), (4, None)], "doc_id long, quality int")
    key = lambda r: (r[0] is not None, r)
    for wanted in ({3}, set()):
        marks = labels if wanted else labels.where("doc_id = 99")
        want = sorted(plain_scores([(r.doc_id, r.text) for r in odd.collect()], wanted)[0], key=key)
        got = sorted((tuple(r) for r in lmscore.cross_entropy_difference(odd, marks, block_bytes=100, bucket_words=50).collect()), key=key)
        assert [r[:2] for r in got] == [r[:2] for r in want]
        assert np.allclose([r[2:] for r in got], [r[2:] for r in want], rtol=0, atol=1e-9)
    assert lmscore.cross_entropy_difference(empty(spark), labels).count() == 0
    assert lmscore.cross_entropy_difference(odd, labels.limit(0)).count() == 8


# 3 near duplicates
def plain_fingerprint(t):
    w = re.findall("[^\x20\x09-\x0d]+", lower(t))
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(fps, radius=2):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius and find(i) != find(j):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(fps))]


def test_simhash(docs):
    texts = sorted((r.doc_id, r.text) for r in docs.collect())
    fps = [plain_fingerprint(t) for _, t in texts]
    want = {texts[i][0]: (fps[i], texts[c][0]) for i, c in enumerate(classes(fps))}
    got = {r.doc_id: (r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == want


def test_components_of_a_large_group():
    """Thousands of near copies in one shard, and others apart, as all pairs would link them."""
    draw = np.random.default_rng(9)
    one = np.uint64(draw.integers(0, 1 << 63))
    near = {int(one) ^ sum(1 << int(b) for b in draw.choice(12, draw.integers(0, 7), replace=False)) for _ in range(3000)}
    x = np.array(sorted(near | {int(v) for v in draw.integers(0, 1 << 63, 500)}), np.uint64)
    root = simhash.components_within(x, 2)
    linked = np.bitwise_count(x[:, None] ^ x[None]) <= 2
    label = np.arange(len(x))
    while True:
        new = np.array([label[row].min() for row in linked])
        if (new == label).all():
            break
        label = new
    assert (root == np.array([x.view(np.int64)[label == k].min() for k in label])).all()


def test_links_are_exact(spark):
    draw = np.random.default_rng(5)
    base = draw.integers(0, 2**63, 40, np.uint64)
    flips = [int(b) ^ (1 << int(i)) ^ (1 << int(j)) for b in base for i, j in draw.integers(0, 64, (12, 2))]
    fps = sorted({*map(int, base), *flips})
    df = spark.createDataFrame([(f - 2**64 if f >> 63 else f,) for f in fps], "fp long")
    edges = simhash.connected(simhash.stars(df, 2, leaf_rows=16)).collect()
    root = {r.node: r.root for r in edges}
    order = sorted(fps, key=lambda f: f - 2**64 if f >> 63 else f)
    signed = [f - 2**64 if f >> 63 else f for f in order]
    want = [signed[c] for c in classes(order)]
    assert [root.get(s, s) for s in signed] == want


def test_shards_are_dealt_until_they_fit(spark):
    """A large group of near copies: no shard stays above the bound, and the links are those of all pairs."""
    draw = np.random.default_rng(11)
    one = int(draw.integers(0, 1 << 63))
    spread = [int(b) for b in draw.choice(64, 14, replace=False)]
    near = {one ^ sum(1 << b for b in draw.choice(spread, draw.integers(0, 6), replace=False).tolist()) for _ in range(1500)}
    fps = sorted(near | {int(v) for v in draw.integers(0, 1 << 63, 200)})
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    sizes = [r["count"] for r in simhash.shards_of(df, 2, 128, len(fps)).groupBy("path", "leaf").count().collect()]
    assert max(sizes) <= 128
    root = {r.node: r.root for r in simhash.connected(simhash.stars(df, 2, leaf_rows=128)).collect()}
    want = simhash.components_within(np.array(fps, np.uint64), 2).tolist()  # held against all pairs above
    assert [root.get(s, s) for s in signed] == want


def test_simhash_odd(spark, odd):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == 8 and {r.component_id for r in got if r.fp == 0} == {1}
    assert simhash.near_duplicates(empty(spark)).count() == 0
    assert sorted(r.doc_id for r in simhash.keep_one(odd).collect()) == [1, 3, 4, 5]


KEEP_ONE = [simhash.keep_one, nearcopies.keep_one]


def test_keep_one_decides_on_rows(spark):
    """Reused and null ids: exactly one row of each class stays."""
    rows = [(3, "A"), (5, "A"), (5, "B"), (7, "C"), (7, "D"), (7, "D"), (None, "A"), (None, "E"), (None, "E"), (None, "F")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = [(3, "A"), (5, "B"), (7, "C"), (7, "D"), (None, "E"), (None, "F")]
    for keep in KEEP_ONE:
        assert sorted((tuple(r) for r in keep(df).collect()), key=str) == sorted(want, key=str)


# 4 decontamination
def plain_contamination(docs, items, size=10):
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    spans = {}
    for i, t in items:
        w = word.findall(lower(t))
        for k in range(max(len(w) - size + 1, min(1, len(w)))):
            if i is not None:
                spans.setdefault(tuple(w[k : k + size]), set()).add(str(i))
    out = []
    for i, t in docs:
        w, hit, ids = word.findall(lower(t)), set(), set()
        for n in {len(s) for s in spans}:
            for k in range(len(w) - n + 1):
                if found := spans.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    ids |= found
        out.append((i, len(w), len(hit), sorted(ids)))
    return sorted(out, key=repr)


def test_decontamination(spark, docs, odd):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    extra = spark.createDataFrame([(900, "Fox jumps over"), (901, "b c"), (902, None), (903, "..."), (None, "quick brown"), (900, "fox jumps over")], bench.schema)
    items = bench.unionByName(extra)
    both = docs.unionByName(odd.select(docs.columns))
    want = plain_contamination([(r.doc_id, r.text) for r in both.collect()], [(r.item_id, r.text) for r in items.collect()])
    got = decontaminate.contamination(both, items, table_bits=16)
    assert sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in got.collect()), key=repr) == want
    assert any(r[2] for r in want)
    assert decontaminate.contamination(empty(spark), items).count() == 0
    assert {r.n_hit for r in decontaminate.contamination(odd, items.limit(0)).collect()} == {0}
    kept = decontaminate.drop_contaminated(both, items)
    assert kept.count() == sum(not r[2] for r in want)


def test_winnowing_guarantee():
    draw = np.random.default_rng(2)
    words = draw.integers(0, 2**63, 300, np.uint64)
    kept = set(decontaminate.winnow(decontaminate.gram_hashes(words, 5), 6).tolist())
    assert all(kept & set(range(i, i + 6)) for i in range(300 - 9))


# 5 main text
def test_html():
    page = (
        '<html><head><title>T</title><style>p{}</style></head><body><header><a href=/>Home</a></header><nav><ul><li><a href=/a>A</a></ul></nav><div class="cookie-notice">We use cookies</div>'
        '<script>var t="</p><p>no";</script><article class=post><h1>Title &amp; more</h1><p>First  <b>bold</b><br>line &#233;.<p>Short.</p><aside>Related</aside><form>Mail</form><!-- <p>x</p> -->'
        '<ul><li>Point</li></ul></article><div id="comments"><p>I disagree with all of this, said a reader at great length.</p></div><footer>&copy; x</footer>'
    )
    assert html.extract(page) == "Title & more\n\nFirst bold line é.\n\nShort.\n\nPoint"
    assert html.extract(None) == html.extract("") == html.extract("<p> </p>") == ""
    long = "A sentence that is long enough to count as text on its own, twice over. " * 2
    plain = f"<div><a href=1>Menu one</a></div><div><a href=2>Menu two</a></div><h2>Head</h2><p>{long}</p><p>Yes.</p><p>{long}</p><div><a href=3>Next</a></div>"
    assert html.extract(plain) == f"Head\n\n{long.strip()}\n\nYes.\n\n{long.strip()}"


def test_html_layouts():
    page = '<body class="no-nav"><div class="page has-sidebar"><article><div class="article-header"><h1>Head</h1></div><p>Body text.</p></article><div class="sidebar">Side</div></div></body>'
    assert html.extract(page) == "Head\n\nBody text."


def test_html_goes_through_the_distribution():
    """The pages' text does not hang on the article's mark; stretches are those of all window sums."""
    pages = [r["html"] for r in pq.read_table("/root/testdata/sf0.01/pages.parquet", columns=["html"]).to_pylist()]
    for page in pages:
        bare = page.replace("<article", "<div").replace("</article", "</div")
        assert bare != page and html.extract(bare) == html.extract(page) != ""
    draw = random.Random(3)
    for _ in range(500):
        weight = [draw.choice([0, 0, 0, 5, 30, 90]) for _ in range(draw.randrange(14))]
        held = [sum(weight[k] for k in range(i, min(i + 3, len(weight)))) for i in range(len(weight))]
        alive = [w > 0 or h >= 80 for w, h in zip(weight, held)]
        want = []
        for i in range(len(weight)):
            for j in range(i + 1, len(weight) + 1):
                run = all(alive[i:j]) and (i == 0 or not alive[i - 1]) and (j == len(weight) or not alive[j])
                if run and any(weight[k] and held[k] >= 80 for k in range(i, j)):
                    heavy = [k for k in range(i, j) if weight[k]]
                    want.append((heavy[0], heavy[-1] + 1))
        heavy = [k for k, w in enumerate(weight) if w]
        assert html.sums(weight) == held and html.stretches(weight) == (want or ([(heavy[0], heavy[-1] + 1)] if heavy else []))


def test_html_broken_markup():
    """Megabytes of broken markup take seconds, and text before and after it stays."""
    odd = ["a <b ", '<a href="x ', '<a c="> " ', "<p it's>x", "<div>", "</ul>", "<!x ", "<!-- ", "<", '<a b="x>', "<script>", "</script "]
    for part in odd:
        began = time.perf_counter()
        got = html.extract("<p>Before it.</p>" + part * (1_000_000 // len(part)))
        assert got.startswith("Before it.") and time.perf_counter() - began < 10
    assert html.extract('<p title="a > b" id=x>One</p><p data-id="nav" title=don\'t>Two</p>') == "One\n\nTwo"
    assert html.extract('<p>One</p><p title="two>Two</p><p>Three</p>') == "One\n\nTwo\n\nThree"


def test_html_table(spark):
    pages = spark.createDataFrame([(1, "u", None, 1), (None, None, "<p>Hello</p>", 2), (1, "u", None, 1)], "page_id long, url string, html string, text int")
    assert sorted(r.text for r in html.main_text(pages).collect()) == ["", "", "Hello"]
    assert html.main_text(pages.limit(0)).count() == 0


# 6 languages
def test_language(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    from pyspark.sql import functions as F

    out = langid.held_out(F.col("doc_id"))
    model = langid.train(docs.where(~out), per_language=100)
    got = langid.predict(docs.where(out & F.col("lang").isNotNull()), model, carry=["doc_id", "lang"]).collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.98 and np.mean([r.rejected for r in got]) < 0.01
    assert all(0 <= r.score <= 1 for r in got)
    strange = {r.doc_id: r for r in langid.predict(odd, model).collect()}
    assert strange[1].lang_pred == strange[2].lang_pred == strange[6].lang_pred == "und" and strange[1].rejected
    assert model.judge("xqzj kvwx qqzx zzkq wvxq jjqz xkqv zqwx " * 20)[3]
    assert langid.train(docs.limit(0)).languages == [] and langid.predict(empty(spark), model).count() == 0


def test_kneser_ney_sums_to_one():
    model = langid.estimate(["a"], 2, [langid_counts("abracadabra", n) for n in (1, 2)])
    letters = np.array([[ord(c)] for c in "abrcd "], np.uint32)
    for h in "abrcd":
        total = sum(np.exp(model._rows(np.array([[ord(h), c[0]]], np.uint32), 2)[0, 0]) for c in letters)
        assert 0.8 < total <= 1.0 + 1e-9


def langid_counts(text, n):
    s = langid.symbols(text)
    w, c = np.unique(np.lib.stride_tricks.sliding_window_view(s, n), axis=0, return_counts=True)
    return w, np.zeros(len(w), np.int64), c.astype(float)


# 7 top-k
def test_top_k(spark):
    draw = np.random.default_rng(3)
    rows = [(i, [float(x) for x in draw.normal(size=6)], 1) for i in range(400)]
    rows += [(400 + i, rows[7][1], 1) for i in range(30)] + [(500, None, 1), (501, [float("nan")] * 6, 1), (502, [None] * 6, 1), (503, [float("inf")] + [0.0] * 5, 1), (None, [1.0] * 6, 1), (550, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, shard int")
    whole = {i: np.floor(256 * np.array(v)).astype(np.int64) for i, v, _ in rows if i is not None and v and None not in v and np.isfinite(v).all()}
    want = []
    for q in sorted(i for i in whole if i % 50 == 0):
        best = sorted(((-int(whole[q] @ whole[c]), c) for c in whole if c != q))[:5]
        want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(best)]
    got = knn.top_k(df, shard_rows=60, block_rows=4).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == want
    assert knn.top_k(df.limit(0)).count() == 0


def test_top_k_repeated_ids(spark):
    """Every row is a candidate, and rows that share a query's id all ask: held against the query's SQL."""
    import duckdb

    draw = np.random.default_rng(8)
    held = pa.table({"vec_id": [int(x) for x in draw.integers(0, 120, 700)] + [50, 1, 1, 2, 3, 3], "embedding": [[float(x) for x in draw.normal(size=5)] for _ in range(706)]})
    df = spark.createDataFrame(list(zip(*held.to_pydict().values(), strict=True)), "vec_id long, embedding array<double>")
    base = duckdb.connect()
    for part, rows in (("vec_id >= 0", df), ("vec_id IN (50, 1, 2, 3)", df.where("vec_id IN (50, 1, 2, 3)"))):
        base.execute(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM held WHERE {part}")
        want = sorted(base.execute(oracle.OP7).fetchall())
        got = knn.top_k(rows, shard_rows=50, block_rows=3).select("query_id", "rank", "vec_id", "score").collect()
        assert sorted(map(tuple, got)) == want and len(want) >= 5


def test_top_k_grid(spark):
    """Several stripes of blocks and groups of trees, vectors of two lengths and scores beyond doubles' whole numbers: held against all pairs."""
    draw = np.random.default_rng(12)
    rows = [(i, draw.integers(-9, 9, 3 + 2 * (i % 2)).astype(float).tolist()) for i in range(300)]
    rows += [(300 + i, (draw.integers(-99, 99, 4) * 1e4).tolist()) for i in range(60)]
    rows += [(350 + 50 * i, (draw.integers(-99, 99, 4) * 1e4).tolist()) for i in range(1, 9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = [(i, np.floor(256 * np.array(v)).astype(np.int64)) for i, v in rows]
    want = []
    for q, x in whole:
        best = sorted((-int(x @ y), c) for c, y in whole if c != q and len(x) == len(y)) if q % 5 == 0 else []
        want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(best[:5])]
    got = knn.top_k(df, every=5, shard_rows=20, block_rows=6, cell_trees=1, stripe_blocks=3).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == sorted(want)


# 8 WARC
def test_arc_versions():
    import io

    for version in "12":
        data = warc.arc_head(version, "19970102030405") + b"".join(warc.arc_record(version, f"http://x/{i}", "19970102030405", b"HTTP/1.0 200 OK\r\nX-Page-Id: 7\r\n\r\nbody\n" * (i + 1)) for i in range(3))
        got = list(warc.read_arc(io.BytesIO(data)))
        assert [h["URL"] for h, _ in got] == ["http://x/0", "http://x/1", "http://x/2"] and len(got[2][1]) == 3 * len(got[0][1])
    record = warc.from_arc(*got[0])
    assert record["date"] == "1997-01-02T03:04:05Z" and record["page_id"] == 7 and record["payload"] == b"body\n"


def test_warc(spark):
    big = "<p>é</p>\r\n\r\nWARC/1.1\r\n" * 100
    rows = [(1, "http://a/ b", big, 0), (2, None, big, 0), (3, "u", "small", 0), (4, "u", "small", 0), (5, "u", None, 0), (6, "u", big + "x", 0), (7, "u", big, 0)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    got = {r.page_id: r for r in warc.archive(df).collect()}
    assert len(got) == 7
    for i, _, text, _ in rows:
        data = (text or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
        assert (got[i].record_type, got[i].refers_to) == (("revisit", 7) if i in (1, 2) else ("response", None))
    assert got[1].uri == "http://a/ b"
    assert warc.archive(df.limit(0)).count() == 0


def test_warc_odd_ids_and_long_pages(spark, tmp_path):
    """Null and repeated page ids, and a page above 100 MB; files bounded in bytes, one gzip member a record."""
    import gzip

    big = "z" * 1500
    rows = [(None, "u", big, 0), (3, "u", big, 0), (3, "u", big, 0), (1, "u", big, 0), (None, "v", "w" * 2000, 0), (None, "v", "w" * 2000, 0)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, payload int")
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.archive(df).collect()), key=str)
    assert got == sorted([(None, 1500, "revisit", 3), (3, 1500, "response", None), (3, 1500, "response", None), (1, 1500, "revisit", 3)] + [(None, 2000, "response", None)] * 2, key=str)
    long = spark.range(2).selectExpr("id AS page_id", "'u' AS url", "repeat('<p>ten by</p>', 8500000) AS html")
    one, two = sorted(warc.archive(long).collect(), key=lambda r: r.page_id)
    assert (one.record_type, one.refers_to, two.record_type) == ("revisit", 1, "response") and one.payload_bytes == two.payload_bytes == 13 * 8_500_000
    many = spark.range(0, 300, 1, 1).selectExpr("id AS page_id", "'u' AS url", "sha2(CAST(id AS STRING), 512) AS html")
    warc.write(warc.with_revisits(warc.convert(warc.pages_as_arc(many))), str(tmp_path / "w"), file_bytes=20_000)
    files = [p.read_bytes() for p in (tmp_path / "w").glob("part-*")]
    assert 2 < len(files) and max(map(len, files)) < 21_000
    for data in files:
        first = zlib.decompressobj(31)
        assert first.decompress(data).count(b"WARC/1.1") == 1 and first.unused_data
        assert gzip.decompress(data).endswith(warc.END)
    assert warc.read(spark, str(tmp_path / "w")).count() == 300


# 9 token files
def test_tokens(spark, docs, odd):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_path())
    strange = spark.createDataFrame([(7, "a  b \n c <|endoftext|> é x", None, None, None)], docs.schema)
    both = docs.unionByName(odd.select(docs.columns)).unionByName(strange)
    rows = sorted(((r.doc_id, r.text, r.h) for r in both.selectExpr("doc_id", "text", "xxhash64(text) AS h").collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
    want, start = [], 0
    for i, t, _ in rows:
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = tokens.token_index(both, tokenizer_path(), shard_tokens=5000).collect()
    assert sorted((tuple(r) for r in got), key=lambda r: r[1]) == want
    assert tokens.token_index(empty(spark), tokenizer_path()).count() == 0


def test_added_tokens():
    """A text that quotes an added token gets the ids that the library gives by default."""
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_path())
    marker = "<|endoftext|>"
    texts = ["foo <|endoftext|> bar", marker, marker * 2, f"a{marker}b c", f" {marker} ", f"x  {marker}  y\n {marker}", f"one two {marker}\tthree  é", "<|endo ftext|> <|endoftext", "plain words", ""]
    want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert want[0] == [21943, 220, 50256, 2318]
    encoder = tokens.Encoder(tokenizer_path())
    for _ in range(2):  # the second time from memory
        ids, sizes = encoder.encode(pa.array(texts))
        assert [part.tolist() for part in np.split(ids, np.cumsum(sizes)[:-1])] == want


def test_white_space_is_cut_as_the_library_cuts_it(monkeypatch):
    """Any mix of spaces, other white space and pieces, with a memory that is forgotten over and over."""
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokens, "REMEMBERED", 2000)
    plain, encoder, draw = Tokenizer.from_file(tokenizer_path()), tokens.Encoder(tokenizer_path()), random.Random(6)
    parts = [*"    ", "  ", "\n", " \n", "\t", "\u3000", "\u00a0", "\x0b", "\x85", "\x1c", "a", "'s", "é", "12", "日本", "🙂", "<|endoftext|>", "...", "Foo"]
    for _ in range(20):
        texts = ["".join(draw.choices(parts, k=draw.randrange(12))) for _ in range(300)] + [None]
        ids, sizes = encoder.encode(pa.array(texts))
        want = [plain.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert [part.tolist() for part in np.split(ids, np.cumsum(sizes)[:-1])] == want


def test_wavelet_matrix():
    ids = (np.random.default_rng(4).zipf(1.4, 3000) % 1000).astype("<u2")
    m = tokens.WaveletMatrix.build(ids, 10)
    content = tokens.pack(ids, [1, None], [1000, 2000], 10, part=0, seq=0) + tokens.CLOSE.encode()
    head, doc_ids, lengths, back = tokens.unpack(content)
    assert (back.decode() == ids).all() and doc_ids == [1, None] and lengths.tolist() == [1000, 2000]
    for i in (0, 1, 511, 512, 513, 2999):
        assert m.access(i) == back.access(i) == ids[i]
    for t in (1, 2, 3, 999):
        at = np.flatnonzero(ids == t)
        assert m.count(t) == len(at) and m.count(t, 100, 900) == ((at >= 100) & (at < 900)).sum()
        assert [m.occurrence(t, j) for j in range(min(5, len(at)))] == at[:5].tolist()
    assert m.count(5000) == 0


# 10 personal data
BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(re.sub("[^0-9]", "", m)) <= 19 and plain_luhn(re.sub("[^0-9]", "", m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(re.sub("[^0-9]", "", m)) <= 15),
]


def plain_luhn(s):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(s))) % 10 == 0


def plain_spans(t):
    found = [(m.start(), k, m.end()) for k, (_, p, ok) in enumerate(BASE) for m in re.finditer(p, t or "") if ok(m[0])]
    return [(BASE[k][0], a, b) for a, k, b in sorted(found)]


TRICKY = [
    None, "", "a@b.c_d@e.f x..@y.z a@b a@b.", "é 😀 me@x.org, 1.2.3.4.5.6.7.8 256.1.1.1 000.1.02.255", "4111 1111-1111 1111 and 4111111111111111 2", "1" * 5000, "12 " * 3000, "9-" * 4000 + "9",
    "+1 (168) 555-5254 +49.30.1234567. ++4912345678901", "%" * 20000 + "@", "a" * 20000, "IBAN GB82 WEST 1234 5698 7654 32 ok", "ssn 123-45-6789, 123-45-6789", "+1" + " " * 3000 + "234567890",
    "378282246310005 4222222222222 card 4222222222222",
]


def test_pii(spark, docs):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TRICKY)], "doc_id long, text string, spans int")
    both = df.select("doc_id", "text").union(docs.select("doc_id", "text").where("doc_id >= 100"))
    texts = {r.doc_id: r.text for r in both.collect()}
    for r in pii.find(both).collect():
        assert [(s.kind, s.start, s.end) for s in r.spans if s.kind in pii.BASE] == plain_spans(texts[r.doc_id])
        assert all((texts[r.doc_id] or "")[s.start : s.end] == s.match and 0 < s.score <= 1 for s in r.spans)
    scores = {(r.doc_id, s.kind): s.score for r in pii.find(df).collect() for s in r.spans}
    assert scores[14, "card13"] == 0.7 and scores[3, "email"] == 0.9
    extra = {r.doc_id: [s.kind for s in r.spans if s.kind not in pii.BASE] for r in pii.find(df).collect()}
    assert extra[11] == ["iban"] and extra[12] == ["ssn", "ssn"] and extra[14] == ["card13"]
    assert pii.find(df.limit(0)).count() == 0


def test_pii_many_matches(spark):
    """A text with very many matches, and its offsets as running sums, in seconds."""
    text = "".join(f"é{i} a{i}@b.org 1.2.3.{i % 256} " for i in range(50_000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.perf_counter()
    got = pii.find(df).first().spans
    assert time.perf_counter() - began < 60
    assert [(s.kind, s.start, s.end) for s in got if s.kind in pii.BASE] == plain_spans(text)
