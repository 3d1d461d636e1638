import hashlib
import re

from veldt.llm import decontaminate as m

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({c: c + 32 for c in range(65, 91)})
PASSAGE = "Alpha beta gamma, delta; EPSILON zeta eta theta iota kappa lambda mu nu xi."
ITEMS = [(10, PASSAGE), (9, "Straße 東京 ok"), (3, None), (4, " .,"), (2, PASSAGE), (None, "only null id words")]


def brute(text, items, n=10):
    w = WORDS.findall((text or "").translate(LOWER))
    hit, found = set(), set()
    for i, t in items:
        x = WORDS.findall((t or "").translate(LOWER))
        k = min(n, len(x))
        grams = {tuple(x[a : a + k]) for a in range(len(x) - k + 1)} if k else set()
        for a in range(len(w) - k + 1 if k else 0):
            if tuple(w[a : a + k]) in grams:
                hit |= set(range(a, a + k))
                found.add("" if i is None else str(i))
    return len(w), len(hit), sorted(found)


def test_against_brute_force(spark, docs):
    texts = ["x " + PASSAGE.upper() + " y", "alpha beta gamma delta epsilon zeta eta theta iota", "a straße 東京 ok b STRASSE", "only null ID words", "only  null-id:words", PASSAGE * 3, None, ""]
    rows = [(100 + i, t, None, 1) for i, t in enumerate(texts)]
    df = docs.unionByName(spark.createDataFrame(rows, docs.schema))
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    for limit in (m.BLOCK_BYTES, 200):
        got = m.scan(df, items, df.columns, limit=limit).collect()
        assert len(got) == df.count()
        for r in got:
            n, hits, found = brute(r["text"], ITEMS)
            assert (r["n_words"], r["n_hit"], r["items"]) == (n, hits, found), r["text"]


def test_removal(spark):
    df = spark.createDataFrame([(1, "Before. " + PASSAGE + " After."), (2, "clean"), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame(ITEMS[:1], "item_id long, text string")
    assert [r["doc_id"] for r in m.drop_documents(df, items).orderBy("doc_id").collect()] == [2, 3]
    spans = {r["doc_id"]: r["text"] for r in m.drop_spans(df, items).collect()}
    assert spans == {1: "Before. . After.", 2: "clean", 3: None}


def test_empty(spark, docs, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert m.scan(docs, none, ["doc_id"]).where("n_hit > 0").count() == 0
    assert m.scan(empty, spark.createDataFrame(ITEMS, "item_id long, text string"), ["doc_id"]).count() == 0


def test_query_digest(spark, sf):
    r = m.op5_decontamination(spark, sf).where("n_items = 0").first()
    assert r["items_sha256"] == hashlib.sha256(b"").hexdigest() and not r["contaminated"]
