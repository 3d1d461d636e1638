import pytest

from veldt.llm import mixing as m


def test_targets_share_out_the_excess():
    assert m.targets([10, 100, 1000], [1, 2, 3], 1110) == [30.0, 300.0, 780.0]
    assert m.targets([0, 5], [1, 2], 5) == [0.0, 5.0]


def test_hard_rows(spark, docs):
    rows = m.taken_words(docs).collect()
    assert len(rows) == docs.count()
    by = {}
    for r in rows:
        assert 0 <= r["taken"] <= 3 * r["size"]
        by.setdefault((r["source_size"], r["target"]), []).append(r)
    for (size, target), group in by.items():
        assert abs(sum(r["taken"] for r in group) - target * len({1}) * sum(r["size"] for r in group) / max(size, 1)) <= max(1, 0.51 * (sum(r["size"] for r in group) // max(size, 1)))
    assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, m.taken_words(docs.repartition(3)).collect()), key=repr)


def test_empty(spark, empty):
    assert m.taken_words(empty).count() == 0


def test_slots_are_spread(spark):
    plan = m.quotas([("a", 3200), ("b", 3200), ("c", 6400)])
    rows = m.schedule(spark, plan).collect()
    assert len(rows) == len({r["slot"] for r in rows}) == sum(q.slots for q in plan)
    for s, q in enumerate(plan):
        mine = sorted(r["slot"] for r in rows if r["s"] == s)
        assert sorted(r["rank"] for r in rows if r["s"] == s) == list(range(q.slots))
        gap = max(b - a for a, b in zip(mine, mine[1:], strict=False))
        assert gap <= 3 * len(rows) / q.slots + 2
        assert sum(r["take"] for r in rows if r["s"] == s) == q.words


def test_mix_takes_each_word_of_a_pass_once(spark):
    docs = spark.createDataFrame([(i, "w " * (i % 50), "ab"[i % 2]) for i in range(400)], "doc_id long, text string, source string")
    taken, every, plan = m.mix(docs)
    seen = {}
    for r in taken.collect():
        seen.setdefault((r["source"], r["doc_id"]), 0)
        seen[(r["source"], r["doc_id"])] += r["high"] - r["low"]
    for q in plan:
        assert sum(v for (s, _), v in seen.items() if s == q.source) == q.words
    assert every.count() == 400


@pytest.mark.parametrize("n", [0, 1, 5])
def test_points_have_low_discrepancy(n):
    import numpy as np

    p = np.sort(m._points(n * 100, 1000).astype(float) / 2**64)
    assert np.abs(p - (np.arange(1000) + 0.5) / 1000).max() < 0.005
