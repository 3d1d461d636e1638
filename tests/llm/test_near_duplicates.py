import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from veldt.llm import minhash, simhash
from veldt.llm.components import components

W = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({c: c + 32 for c in range(65, 91)})


def fingerprint(text, k=4):
    w = W.findall((text or "").translate(LOWER))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_equal_brute_force(docs):
    texts = [r["text"] for r in docs.collect()]
    assert simhash.fingerprints(pa.array(texts)).tolist() == [fingerprint(t) for t in texts]


def test_covering_masks_collide_within_the_radius():
    rng = np.random.default_rng(0)
    masks = simhash.masks(4)
    assert len(masks) == 31
    for _ in range(2000):
        flips = sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False))
        assert any(not flips & m for m in masks)


def near(rng, n):
    """Fingerprints in clusters, chains and alone."""
    out = []
    for _ in range(n):
        x = int(rng.integers(0, 1 << 63)) * 2 + int(rng.integers(0, 2))
        out.append(x)
        for _ in range(int(rng.integers(0, 6))):
            for b in rng.choice(64, rng.integers(1, 6), replace=False):
                x ^= 1 << int(b)
            out.append(x)
    return sorted(set(out))


def classes(fps, radius):
    root = {x: x for x in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                root[find(a)] = find(b)
    return {frozenset(y for y in fps if find(y) == find(x)) for x in fps}


@pytest.mark.parametrize("bucket", [4096, 3])
def test_links_connect_what_brute_force_connects(spark, bucket):
    fps = near(np.random.default_rng(3), 60)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    roots = {r["node"]: r["root"] for r in components(simhash.link(df, 4, bucket)).collect()}
    got = {}
    for x in signed:
        got.setdefault(roots.get(x, x), set()).add(x & (1 << 64) - 1)
    assert {frozenset(v) for v in got.values()} == classes(fps, 4)


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (5, 5), (200, 203), (203, 201)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 61)) and got[101] == 100 and got[201] == got[203] == 200
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_simhash_hard_rows(spark, docs, empty):
    got = simhash.classes(docs).collect()
    assert len(got) == docs.count()
    by = {r["doc_id"]: r["component_id"] for r in got}
    assert by[1] == by[2] == by[3] == 1 and by[5] == by[6] == 5 and by[None] is None
    assert simhash.classes(empty).count() == 0


def similar(a, b, k=5):
    def sets(t):
        w = W.findall((t or "").translate(LOWER))
        return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}

    x, y = sets(a), sets(b)
    return len(x & y) / len(x | y)


def corpus():
    rng = np.random.default_rng(11)
    vocabulary = ["".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(3000)]
    texts = []
    for _ in range(40):
        base = [vocabulary[i] for i in rng.integers(0, 3000, 120)]
        texts.append(" ".join(base))
        for edits in (1, 2, 12):
            new = list(base)
            for i in rng.integers(0, 120, edits):
                new[i] = vocabulary[rng.integers(0, 3000)]
            texts.append(" ".join(new))
    return texts


def test_verified_classes_keep_one_of_each_group(spark, docs, empty):
    texts = corpus()
    df = spark.createDataFrame([(i, t, "s", None) for i, t in enumerate(texts)], docs.schema)
    kept = {r["doc_id"] for r in simhash.keep_first(df).collect()}
    expected = set()
    for g in range(0, len(texts), 4):
        group = list(range(g, g + 4))
        alone = [i for i in group if not any(similar(texts[i], texts[j]) >= 0.8 for j in group if j < i)]
        expected |= set(alone)
    assert kept == expected
    hard = simhash.keep_first(docs)
    assert hard.columns == docs.columns
    ids = [r["doc_id"] for r in hard.collect()]
    # the null, empty and blank texts are equal sequences of no words; only equal texts are copies without shingles
    assert 5 in ids and 6 not in ids and None in ids and len(ids) == len(set(ids))
    assert simhash.keep_first(empty).count() == 0


def test_similar_forest_is_exact():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 40, rng.integers(1, 30))) for _ in range(60)]
    ids = np.arange(60)
    edges = simhash.similar_forest(ids, sets, 0.5)
    root = list(range(60))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        assert len(np.intersect1d(sets[a], sets[b])) >= 0.5 * len(np.union1d(sets[a], sets[b])) - 1e-9
        root[find(a)] = find(b)
    for i in range(60):
        for j in range(i):
            if len(np.intersect1d(sets[i], sets[j])) >= 0.5 * len(np.union1d(sets[i], sets[j])):
                assert find(i) == find(j)


def test_minhash_estimates_jaccard():
    texts = corpus()
    s = minhash.sign(pa.array(texts))
    err = [(s[i] == s[j]).mean() - similar(texts[i], texts[j]) for i in range(0, 160, 4) for j in range(i + 1, i + 4)]
    assert abs(np.mean(err)) < 0.02 and np.abs(err).max() < 0.2


def test_edited_pairs_with_the_next(spark, docs, empty):
    rows = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    got = sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in minhash.edited(docs).collect()), key=repr)
    want = []
    for k, (i, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        n = len(t) // 4
        want.append((i, len(t), hashlib.sha256((t[: len(t) - n] + nxt[:n]).encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    assert minhash.edited(empty).count() == 0
    by = {r["doc_id"]: r for r in minhash.edited(docs).collect()}
    assert by[5]["fingerprint"] == by[6]["fingerprint"] and by[5]["near_next"] == 1.0


def test_minhash_classes(spark, docs):
    texts = corpus()
    df = spark.createDataFrame([(i, t, "s", None) for i, t in enumerate(texts)], docs.schema)
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(df).collect()}
    for g in range(0, len(texts), 4):
        for j in (1, 2):
            if similar(texts[g], texts[g + j]) >= 0.85:
                assert got[g + j] == g
        assert all(got[i] // 4 == g // 4 for i in range(g, g + 4))


def block_edits(rng, n=40, size=300):
    """(base, copy) texts whose copies have a passage appended, their end cut off or their end replaced, at a similarity of 0.8 to 0.87."""
    vocabulary = ["".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(5000)]
    pairs = {"appended": [], "truncated": [], "replaced": []}
    for kind, made in pairs.items():
        for _ in range(n):
            base, other = ([vocabulary[i] for i in rng.integers(0, 5000, size)] for _ in range(2))
            share = rng.uniform(0.14, 0.19) if kind != "replaced" else rng.uniform(0.075, 0.1)
            k = int(size * share)
            new = {"appended": base + other[: int(k * 1.2)], "truncated": base[: size - k], "replaced": base[: size - k] + other[:k]}[kind]
            made.append((" ".join(base), " ".join(new)))
    return pairs


@pytest.mark.parametrize("kind", ["appended", "truncated", "replaced"])
def test_copies_with_a_block_edit_are_found(spark, docs, kind):
    pairs = [(a, b) for a, b in block_edits(np.random.default_rng(8))[kind] if similar(a, b) >= 0.8]
    assert len(pairs) > 20
    df = spark.createDataFrame([(2 * i + j, t, "s", None) for i, p in enumerate(pairs) for j, t in enumerate(p)], docs.schema)
    assert {r["doc_id"] for r in simhash.keep_first(df).collect()} == {2 * i for i in range(len(pairs))}


def linked_classes(sets, least=0.8):
    """The smallest index that links of at least this similarity reach, by brute force."""
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common >= least * (len(sets[i]) + len(sets[j]) - common):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(sets))]


def test_minhash_classes_of_copies_about_the_threshold(spark, docs):
    rng = np.random.default_rng(17)
    vocabulary = ["".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(5000)]
    texts = []
    for members in (10, 40, 120):
        base = [vocabulary[i] for i in rng.integers(0, 5000, 300)]
        for _ in range(members):
            new = list(base)
            for i in rng.choice(300, 4, replace=False):
                new[i] = vocabulary[rng.integers(0, 5000)]
            texts.append(" ".join(new))
    df = spark.createDataFrame([(i, t, "s", None) for i, t in enumerate(texts)], docs.schema)
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(df).collect()}
    words = [t.split() for t in texts]
    want = linked_classes([{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in words])
    assert [got[i] for i in range(len(texts))] == want
    assert 3 < len(set(want)) < len(texts)


def test_minhash_bucket_of_thousands_is_searched_whole(spark, docs):
    base = "alpha bravo charlie delta echo foxtrot golf hotel"
    # every text is like the last one only (4 of 5 shingles; 4 of 6 among each other), and shares all its bands with the others
    texts = [f"{base} x{i}" for i in range(4500)] + [base]
    df = spark.createDataFrame([(i, t, "s", None) for i, t in enumerate(texts)], docs.schema)
    got = minhash.near_duplicates(df).groupBy("class_id").count().collect()
    assert [(r["class_id"], r["count"]) for r in got] == [(0, len(texts))]


def test_minhash_classes_keep_every_row(spark, docs, empty):
    a, b, alone = (" ".join(f"{c}{i}" for i in range(60)) for c in "abc")
    rows = [(None, a), (None, alone), (7, a + " more"), (7, b), (8, b + " more"), (3, a), (3, a)]
    df = spark.createDataFrame([(i, t, "s", None) for i, t in rows], docs.schema)
    got = sorted(((r["doc_id"], r["class_id"]) for r in minhash.near_duplicates(df).collect()), key=repr)
    assert got == sorted([(None, 3), (None, None), (7, 3), (7, 7), (8, 7), (3, 3), (3, 3)], key=repr)
    assert minhash.near_duplicates(docs).count() == docs.count() and minhash.near_duplicates(empty).count() == 0


def minima(text, k=5):
    """Signature by definition, from the same word hashes."""
    of, h = minhash.shingles(pa.array([text]))
    return [min((int(a) * int(x) + int(b)) % (1 << 64) for x in h) & 0xFFFF for a, b in zip(minhash._A, minhash._B, strict=True)]


def test_signatures_equal_brute_force(spark, sf, docs):
    texts = [r["text"] for r in docs.collect() if len(r["text"] or "") < 10_000] + [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").limit(20).collect()]
    assert minhash.sign(pa.array(texts)).tolist() == [minima(t) for t in texts]


@pytest.mark.parametrize("size", [1_000, 20_000, 400_000])
def test_unrelated_texts_are_unlike_at_every_length(size):
    rng = np.random.default_rng(size)
    s = minhash.sign(pa.array([" ".join(map(str, rng.integers(0, 1 << 40, size))) for _ in range(2)]))
    assert (s[0] == s[1]).mean() < 0.02


def test_query_classes_equal_brute_force(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    words = [W.findall((r["text"] or "").translate(LOWER)) for r in rows]
    want = linked_classes([{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in words])
    got = {r["doc_id"]: r["class_id"] for r in minhash.op8_minhash(spark, sf).collect()}
    assert [got[r["doc_id"]] for r in rows] == [rows[i]["doc_id"] for i in want]


def test_clashing_columns_do_not_matter(spark):
    names = ["place", "key", "node", "root", "fp", "__place", "__n", "band", "id"]
    df = spark.createDataFrame([(i, "the same words stand here again " * 3, *["x"] * len(names)) for i in range(3)], "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    kept = simhash.keep_first(df)
    assert kept.columns == df.columns and [r["doc_id"] for r in kept.collect()] == [0]
    assert {r["component_id"] for r in simhash.classes(df).collect()} == {0}
    assert {r["class_id"] for r in minhash.near_duplicates(df).collect()} == {0}


def test_recall_of_near_duplicates_against_all_rows(spark):
    """Rows whose id is divisible by 100 against all rows of a table: the links that brute force finds, and those that the classes have."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    rows = [(r["doc_id"], W.findall((r["text"] or "").translate(LOWER))) for r in docs.collect()]
    sets = {i: {hash(tuple(w[k : k + 5])) for k in range(max(1, len(w) - 4))} for i, w in rows}
    holders = {}
    for i in sets:
        if i % 100 == 0:
            for x in sets[i]:
                holders.setdefault(x, []).append(i)
    links = []
    for j, held in sets.items():
        common = {}
        for x in held:
            for i in holders.get(x, ()):
                common[i] = common.get(i, 0) + 1
        links += [(i, j) for i, n in common.items() if i != j and n >= 0.8 * (len(sets[i]) + len(held) - n)]
    assert len(links) > 20
    named = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(docs).collect()}
    assert all(named[i] == named[j] for i, j in links)
    key = {r["doc_id"]: r["key"] for r in docs.selectExpr("doc_id", "md5(coalesce(text, '')) as key").collect()}
    found = {r["key"]: r["class_id"] for r in simhash.similar_classes(docs).collect()}
    assert all(found[key[i]] == found[key[j]] for i, j in links)
