import numpy as np
import pyarrow as pa
import pytest

from veldt.llm import quality as q
from veldt.llm import toxicity as x
from veldt.llm.common import table

SF = "/root/testdata/sf0.01"


def test_ranking_learns_from_pairs():
    rng = np.random.default_rng(0)
    z = rng.normal(size=(400, 3))
    y = (z[:, 0] - z[:, 1] > 0).astype(int)
    r = q.fit(z, y, pairs=5000)
    assert ((r.score(z) >= q.CUT) == y).mean() > 0.97 and r.weights[0] > 0 > r.weights[1]
    assert (q.fit(z, np.ones(400)).score(z) == pytest.approx(q.CUT))


def test_quality_held_out(spark):
    rows = q.op3_quality(spark, SF).join(table(spark, SF, "labels"), "doc_id").where("held_out").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.93
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)


def test_quality_hard_rows(spark, docs, empty):
    labels = spark.createDataFrame([(5, 1), (4, 0), (2, 0), (None, 1), (7, None), (8, 7)], "doc_id long, quality int")
    rows = q.score(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] in (1, 2)}) == 1
    assert q.score(empty, labels).count() == 0
    assert all(r["score"] == pytest.approx(0.7) for r in q.score(docs, labels.limit(0)).collect())


def test_stems_are_seen():
    texts = pa.array(["vilefoo bar", "vilebaz", "village", None, ""])
    _, h = x.token_sets(pa.array(["vileother"]))
    assert x.presence(texts, np.sort(h)).sum(1).tolist()[:2] == [1.0, 1.0]
    assert x.presence(texts, np.sort(h)).sum(1).tolist()[2:] == [0.0, 0.0, 0.0]


def test_chain_feeds_earlier_probabilities():
    rng = np.random.default_rng(1)
    d = rng.normal(size=(600, 2))
    first = (d[:, 0] > 0).astype(float)
    second = ((d[:, 0] > 0) & (d[:, 1] > 0)).astype(float)
    chain = x.train(np.zeros(0, np.uint64), np.zeros((600, 0)), d, np.stack([first, second], 1), np.arange(600) % x.FOLDS)
    assert len(chain.models[1].weights) == len(chain.models[0].weights) + 1
    p = chain.predict((d - chain.mean) / chain.scale)
    assert ((p[:, 1] > chain.threshold) == second).mean() > 0.93


def test_toxicity_finds_labelled(spark):
    got = x.op6_toxicity(spark, "/root/testdata/sf0.1").join(table(spark, "/root/testdata/sf0.1", "labels"), "doc_id").groupBy("toxic", "rejected").count().collect()
    n = {(r["toxic"], r["rejected"]): r["count"] for r in got}
    assert n[1, True] / (n[1, True] + n[1, False]) > 0.9 and n.get((0, True), 0) / n[0, False] < 0.01


def test_toxicity_hard_rows(spark, docs, empty):
    labels = spark.createDataFrame([(5, 1, 0), (4, 0, 1), (None, 1, 1), (7, None, 0)], "doc_id long, quality int, toxic int")
    chain = x.learn(docs, labels)
    assert x.score(docs, chain, ["doc_id"]).count() == docs.count()
    assert x.score(empty, chain, ["doc_id"]).count() == 0
    none = x.learn(docs, labels.limit(0))
    assert x.score(docs, none, ["doc_id"]).where("rejected").count() == 0
    assert x.drop_toxic(docs, labels.limit(0)).columns == docs.columns


@pytest.mark.parametrize("positive", [4, 9, 10, 30])
def test_toxicity_rejects_at_every_label_count(positive):
    rng = np.random.default_rng(4)
    n = 200
    y = np.zeros((n, 2))
    y[:positive] = 1
    d = rng.normal(size=(n, 2))
    d[:positive, 0] += 12
    chain = x.train(np.zeros(0, np.uint64), np.zeros((n, 0)), d, y, np.arange(n) % x.FOLDS)
    p = chain.predict(np.hstack([(d - chain.mean) / chain.scale]))
    assert ((p[:, 1] > chain.threshold) == (y[:, 1] == 1)).mean() > 0.98 and (p[:positive, 1] > chain.threshold).all()


def test_toxicity_threshold_needs_both_kinds_out_of_fold():
    p, fold = np.array([0.9, 0.8, 0.2, 0.1]), np.array([0, 1, 0, 1])
    assert x.threshold(p, np.array([1, 0, 0, 0]), fold) == 2.0 and x.threshold(p, np.zeros(4), fold) == 2.0
    assert x.threshold(p, np.array([1, 1, 0, 0]), np.zeros(4)) == 2.0
    assert x.threshold(p, np.array([1, 1, 0, 0]), fold) == 0.5


def test_toxicity_held_out(spark):
    """Labels of a fifth of the documents are kept from learning; recall and precision are measured there."""
    docs, labels = (table(spark, "/root/testdata/sf0.1", n) for n in ("documents", "labels"))
    held = "crc32(cast(doc_id as string)) % 5 = 2"
    chain = x.learn(docs, labels.where(f"not ({held})"))
    got = x.score(docs, chain, ["doc_id"]).join(labels.where(held), "doc_id").groupBy("toxic", "rejected").count().collect()
    n = {(r["toxic"], r["rejected"]): r["count"] for r in got}
    hits = n.get((1, True), 0)
    assert hits / (hits + n.get((1, False), 0)) >= 0.9 and hits / (hits + n.get((0, True), 0)) >= 0.9


def test_repeated_ids_learn_once(spark):
    rows = [(i, f"text number {i} vile{i % 7}" if i % 3 else f"plain text {i}") for i in range(60) for _ in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 2), int(i % 3 > 0)) for i in range(60)], "doc_id long, quality int, toxic int")
    one, many = x.learn(df.distinct(), labels), x.learn(df, labels)
    assert np.array_equal(one.vocabulary, many.vocabulary) and one.threshold == many.threshold


def test_bradley_terry_weights_are_the_loss_minimum():
    """The weights against plain gradient steps on the same pairs' logistic loss."""
    rng = np.random.default_rng(3)
    z = rng.normal(size=(200, 2))
    y = (z[:, 0] + rng.normal(size=200) > 0).astype(int)
    r = q.fit(z, y, pairs=3000, seed=5)
    s = (z - r.mean) / r.scale
    draw = np.random.default_rng(5)
    d = s[draw.choice(np.flatnonzero(y == 1), 3000)] - s[draw.choice(np.flatnonzero(y == 0), 3000)]
    w = np.zeros(2)
    for _ in range(4000):
        w += 0.5 * (d.T @ (1 / (1 + np.exp(d @ w))) / len(d) - q.RIDGE * w)
    assert np.allclose(w, r.weights, atol=1e-4)
    raw = s @ r.weights
    best = max(((raw[y == 1] >= t).mean() + (raw[y == 0] < t).mean()) for t in raw)
    assert (raw[y == 1] >= r.threshold).mean() + (raw[y == 0] < r.threshold).mean() >= best - 0.02


def _all_pairs(n=300, seed=6):
    rng = np.random.default_rng(seed)
    z = rng.normal(size=(n, 3)) * [1, 5, 30] + [0, 2, -4]
    return z, (z[:, 0] + z[:, 1] / 5 + rng.normal(size=n) > 0.4).astype(int)


def test_quality_learns_from_all_pairs():
    """The weights are where the loss of every pair, written out, is least; drawn pairs missed it. The threshold is the best of all scores."""
    x, y = _all_pairs()
    r = q.fit(x, y)
    z = (x - r.mean) / r.scale
    d = (z[y == 1][:, None] - z[y == 0][None]).reshape(-1, 3)
    slope = q.RIDGE * r.weights - d.T @ (1 / (1 + np.exp(d @ r.weights))) / len(d)
    assert np.abs(slope).max() < 1e-9
    raw = z @ r.weights
    best = max((raw[y == 1] >= t).mean() + (raw[y == 0] < t).mean() for t in raw)
    assert (raw[y == 1] >= r.threshold).mean() + (raw[y == 0] < r.threshold).mean() == pytest.approx(best, abs=1e-12)


@pytest.mark.parametrize("far", [1, 40])
def test_pair_sums_equal_written_out_pairs(far):
    from veldt.llm import pairwise as p

    x, y = _all_pairs(80)
    w = far * np.array([0.7, -0.2, 0.1])
    got = p.loss_of(p.moments(x, y, w))
    d = (x[y == 1][:, None] - x[y == 0][None]).reshape(-1, 3)
    h = 1 / (1 + np.exp(d @ w))
    assert got.loss == pytest.approx(np.logaddexp(0, -(d @ w)).mean(), rel=1e-11) and got.pairs == len(d)
    assert np.allclose(got.slope, -(d.T @ h) / len(d), rtol=0, atol=1e-10)
    bend = p.curvature(x, y, w, got.curves)[0] / got.pairs - got.cross - got.cross.T
    assert np.allclose(bend, (d * (h * (1 - h))[:, None]).T @ d / len(d), rtol=0, atol=1e-9)


def test_quality_table_fits_as_arrays_do(spark):
    x, y = _all_pairs()
    x = x.astype(np.float32).astype(float)
    rows = spark.createDataFrame([(int(k), [float(v) for v in r]) for k, r in zip(y, x)], "y int, x array<float>").repartition(7)
    a, b = q.fit(x, y), q.fit_table(rows)
    assert np.allclose(a.weights, b.weights, atol=1e-9) and a.threshold == pytest.approx(b.threshold, abs=1e-9) and np.allclose(a.scale, b.scale)
    again = q.fit_table(rows)
    assert np.array_equal(b.weights, again.weights) and b.threshold == again.threshold
    assert not q.fit_table(rows.where("y = 1")).weights.any()


def test_quality_learns_from_every_label(spark):
    """No row of a large labels table is left out of learning, on the driver and beyond it."""
    docs = spark.range(21_000).selectExpr("id as doc_id", "concat(repeat('ab ', int(id % 7) + 1), repeat('!', int(id % 11))) as text")
    labels = spark.range(21_000).selectExpr("id as doc_id", "int(id % 11 < 5) as quality")
    seen = []
    with pytest.MonkeyPatch.context() as m:
        m.setattr(q, "fit_table", lambda rows: seen.append(rows.count()) or q._undecided(len(q.NAMES)))
        q.score(docs, labels).count()
    assert seen == [21_000]
    few, kinds = docs.limit(900), labels.limit(900)
    features = q.with_features(few, ["doc_id"])
    a, b = q.learn(features, kinds), q.learn(features, kinds, local=0)
    assert np.allclose(a.weights, b.weights, atol=1e-6) and a.threshold == pytest.approx(b.threshold, abs=1e-6)
