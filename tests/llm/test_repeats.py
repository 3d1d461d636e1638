import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from veldt.llm import repeats as m


def brute(texts, length):
    seen = {}
    data = [(t or "").encode() for t in texts]
    for b in data:
        for p in range(len(b) - length + 1):
            seen[b[p : p + length]] = seen.get(b[p : p + length], 0) + 1
    out = []
    for b in data:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = True
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def check(spark, texts, ids=None, **more):
    ids = ids or list(range(len(texts)))
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
    got = sorted((repr(r[0]), *r[1:]) for r in map(tuple, m.removed(df, **more).collect()))
    assert got == sorted((repr(i), *x) for i, x in zip(ids, brute(texts, more.get("length", 200)), strict=True))


def test_planted(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randint(1, 9)))
    base = " ".join(word() for _ in range(300))
    texts = [base, base, base[:700] + "X" + base[700:], base[100:299], base[100:300], "z" * 1000, "ab" * 150, None, "", base[50:260] * 3]
    texts += [" ".join(word() for _ in range(100)) + base[i : i + 150 + i] + " ".join(word() for _ in range(30)) for i in range(0, 200, 9)]
    texts += ["common line that every text has, sixty-four bytes and more of it so that its rank is shared. " + " ".join(word() for _ in range(40)) for _ in range(30)]
    check(spark, texts)
    check(spark, texts, held=2)


def test_same_id_and_null_ids(spark):
    t = "".join(chr(97 + i * i % 23) for i in range(500))
    check(spark, [t, t[:100], t[::-1], None, t], [1, 1, None, None, 2])


def test_parts_of_long_texts(spark, monkeypatch):
    rng = random.Random(5)
    a = "".join(rng.choice("abcdefgh") for _ in range(9000))
    monkeypatch.setattr(m, "PART", 1000)
    df_texts = [a, "q" + a[3000:7000], a[:10] * 30]
    data = [t.encode() for t in df_texts]
    found = []
    for b in data:
        buf, at = np.frombuffer(b, np.uint8), np.array([0, len(b)])
        starts = []
        for base, part, offsets in m._parts(buf, at, 200):
            _, lo, n, _, _, _ = m.records(part, offsets, 200, 64)
            starts += [base + s + i for s, k in zip(lo.tolist(), n.tolist(), strict=True) for i in range(k)]
        found.append(starts)
    assert [sorted(s) for s in found] == [list(range(len(b) - 199)) for b in data]


@pytest.mark.parametrize("seed", range(3))
def test_records_cover_every_string_with_equal_anchors(seed):
    rng = np.random.default_rng(seed)
    buf = rng.integers(97, 97 + 2 + seed, 3000).astype(np.uint8)
    at = np.array([0, 0, 150, 1400, 3000])
    text, lo, n, dx, rank, whole = m.records(buf, at, 200, 64)
    starts = np.concatenate([np.arange(a, a + k) for a, k in zip(lo, n, strict=True)])
    assert starts.tolist() == [*range(150, 1201), *range(1400, 2801)]


def test_empty(spark, empty, docs):
    assert m.removed(empty).count() == 0
    rows = m.removed(docs, with_text=True).collect()
    assert len(rows) == docs.count() and all(len(r["kept"]) == r["n_bytes"] - r["n_removed"] for r in rows)


def test_texts_of_one_id_with_equal_crc_stay_apart(spark):
    rng = random.Random(9)
    shared = "".join(rng.choice("abcdefghij ") for _ in range(250))
    seen, pair = {}, None
    for i in range(400_000):
        text = f"{i:06d}" + "klmnop" * 42 + f"{i:06d}" if i % 2 else shared + f"{i:08d}"
        other = seen.setdefault(zlib.crc32(text.encode()), text)
        if other != text and (other.startswith(shared)) != (text.startswith(shared)):
            pair = [other, text]
            break
    assert pair
    check(spark, [*pair, shared + "x", shared + "y"], [None, None, 1, 1])


def test_rounds_end_strings_that_are_alone_with_their_pair(spark):
    rng = np.random.default_rng(4)
    word = lambda: "".join(chr(97 + c) for c in rng.integers(0, 26, 8))
    line = " ".join(word() for _ in range(9))  # 80 bytes that all texts share, between others
    texts = [" ".join(word() for _ in range(40)) + line + " ".join(word() for _ in range(40)) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = m._find(df.selectExpr("unhex(md5(text)) as place", "text"), 200, 32)
    ranks = found.groupBy("rank").count().where("count > 1")
    kinds = found.join(ranks.select("rank"), "rank").groupBy("rank", "whole").agg(F.count("*").alias("times"), F.min(F.struct("place", "pack", "at0", "at1")).alias("r")).select("rank", "whole", "times", "r.*")
    before = kinds.select(F.sum(m._n())).first()[0]
    after = m._doubled(kinds, 200, 32).select(F.sum(m._n())).first()[0]
    assert before > 0 and after < before
    check(spark, texts)
    assert m.offsets(200, 32) == [32, 64, 128] and m.offsets(200, 64) == [64, 128]


def test_rows_repeated_often(spark):
    t = "".join(chr(97 + i * i % 23) for i in range(300))
    check(spark, [t] * 50 + [t[:250] + "other end"] * 3 + ["only here" * 40], [None] * 25 + [7] * 25 + [1, 2, 3] + [None], held=1)


def test_whole_table_against_brute_force(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(map(tuple, m.op4_repeats(spark, sf).collect()))
    assert got == sorted((r["doc_id"], *x) for r, x in zip(rows, brute([r["text"] for r in rows], 200), strict=True))


def test_no_join_is_broadcast(spark, monkeypatch):
    """By their files' sizes all these tables look small enough for the driver, salted sixteenfold or not."""
    plans, cut = [], m.cut
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(m, "cut", lambda df, tag: plans.append(plan(df)) or cut(df, tag))
    rng = random.Random(6)
    a, b = ("".join(rng.choice("abcdefgh ") for _ in range(400)) for _ in range(2))
    texts = [a, a, a[:300] + b[:150], b, b[100:330] + "end", None]
    out = m.removed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), held=1)
    plans.append(plan(out))
    assert sum("SortMergeJoin" in p for p in plans) >= 5 and not any("Broadcast" in p for p in plans)
    check(spark, texts, held=1)
