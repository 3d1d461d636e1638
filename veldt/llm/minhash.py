"""MinHash fingerprints of documents, and near duplicates by bands.

A text's shingles are its runs of SHINGLE words (runs of characters other than space, \\t \\n \\v \\f \\r; a shorter text is
one shingle, a text without words has one of its own). PERMUTATIONS universal hashes, (a x + b) mod 2^64 with odd a,
are minimised over the shingles in numpy; the fingerprint is the hex of the low 16 bits of each minimum. The likeness
of two fingerprints is the share of equal minima, an estimate of the shingle sets' Jaccard similarity whatever the texts' lengths: minima of
different shingles have equal low bits once in 65,536.

near_duplicates() takes texts that share a band of PER_BAND minima as candidates (joined in Spark) and compares all pairs of a component of
candidates by the exact Jaccard similarity.

edited() pairs each document with the next one in the order of their ids, with a single shuffle of the texts by ranges of ids: the
first text of each range is sent to the range before too. Ids are numbers.

Nulls: a null text is empty. Null ids come first, then ids in ascending order; repeated ids are ordered by their
text. An empty table gives no rows, a single document is its own next. Extra columns are ignored. near_duplicates() keeps
texts apart where they share an id, and a null id is a class's only where it has no other.
"""

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldt.llm.bands import edges
from veldt.llm.common import cut, salted, small_batches, table
from veldt.llm.components import components
from veldt.llm.simhash import verified
from veldt.llm.textops import NOT_SPACE, STEP, map_text, raw, windows, word_hash, words

PERMUTATIONS = 128
SHINGLE = 5
SIMILAR = 0.8
#: Minima of a band: two texts of similarity s share one of the 32 bands with 1 - (1 - s^4)^32, all but 5e-8 at 0.8.
PER_BAND = 4
#: Bytes of text that a range of ids should hold, by the input files' size, and ranges at most (their edges are on the driver).
RANGE_BYTES = 64 << 20
MAX_RANGES = 20_000
_rng = np.random.default_rng(20240611)
_A = _rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2)
_ROWS = 1 << 15


def shingles(texts: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Text and hash of each shingle, ordered by text; every text has one at least."""
    buf, at = raw(texts)
    start, end, doc = words(buf, at, NOT_SPACE)
    h = word_hash(buf, start, end)
    first, many = windows(h, doc, size)
    n = np.bincount(doc, minlength=len(texts))
    few = np.flatnonzero(n < size)
    low = np.searchsorted(doc, few, "left")
    alone = np.array([_one(h[a : a + k]) for a, k in zip(low.tolist(), n[few].tolist(), strict=True)], np.uint64)
    of = np.concatenate([doc[first], few])
    both = np.concatenate([many, alone])
    order = np.argsort(of, kind="stable")
    return of[order], both[order]


def _one(h: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(h.tobytes(), digest_size=8).digest(), "little")


def signatures(of: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """The low 16 bits of n x PERMUTATIONS minima over each text's shingles. Whole hashes are compared: cut to 16 bits first, the minima of
    long texts would all be near nought and alike."""
    out = np.full((n, PERMUTATIONS), 0xFFFFFFFFFFFFFFFF, np.uint64)
    for low in range(0, len(of), _ROWS):
        part, doc = hashes[low : low + _ROWS], of[low : low + _ROWS]
        edge = np.flatnonzero(np.diff(doc, prepend=-1))
        found = np.empty((len(edge), PERMUTATIONS), np.uint64)
        for k in range(PERMUTATIONS):
            found[:, k] = np.minimum.reduceat(part * _A[k] + _B[k], edge)
        rows = doc[edge]
        out[rows] = np.minimum(out[rows], found)
    return (out & np.uint64(0xFFFF)).astype(np.uint16)


def sign(texts: pa.Array) -> np.ndarray:
    return signatures(*shingles(texts), len(texts))


def as_text(signature: np.ndarray) -> list[str]:
    data = signature.astype(">u2").tobytes().hex()
    width = 4 * PERMUTATIONS
    return [data[i : i + width] for i in range(0, len(data), width)]


def fingerprints(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The kept columns and fingerprint."""
    return map_text(docs, keep, lambda t: [pa.array(as_text(sign(t)), pa.string())], [("fingerprint", "string", pa.string())])


def edit(text: str, following: str) -> str:
    """The last quarter (rounded down) of the code points replaced by as many, or all, of the following text's first."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def edited(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Per document: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, and key (the text's MD5)."""
    spark = docs.sparkSession
    small_batches(spark)
    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_column}`").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # ranges of ids by quantiles; only their number follows from the estimated size
    bytes_ = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if bytes_ < 1 << 60:
        ranges = max(ranges, min(MAX_RANGES, bytes_ // RANGE_BYTES))
    cuts = rows.agg(F.percentile_approx("id", [(i + 1) / ranges for i in range(max(1, ranges - 1))], max(10_000, 10 * ranges)).alias("q")).first()["q"]
    limits = np.array(sorted(set(cuts or ())))

    @F.pandas_udf("long")
    def of(ids: pd.Series) -> pd.Series:
        found = np.zeros(len(ids), np.int64)
        ok = ids.notna().to_numpy()
        found[ok] = np.searchsorted(limits, ids[ok].to_numpy(limits.dtype), "left")
        return pd.Series(found)

    rows = rows.withColumn("part", of("id"))
    firsts = {r["part"]: r["id"] for r in rows.groupBy("part").agg(F.min(F.struct(F.col("id").isNotNull().alias("k"), "id")).alias("m")).select("part", F.col("m.id").alias("id")).collect()}
    used = sorted(firsts)
    if not used:
        return spark.createDataFrame([], f"`{id_column}` {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, key string")
    # the rows with the first id of a range also go to the range before, where they sort last; the very first to the last range
    again = spark.createDataFrame([(firsts[p], p, used[i - 1]) for i, p in enumerate(used)], f"id {kind}, part long, again long").withColumnRenamed("id", "f").withColumnRenamed("part", "g")
    rows = rows.join(F.broadcast(again), (F.col("part") == F.col("g")) & F.col("id").eqNullSafe(F.col("f")), "left")
    places = F.array_compact(F.array(F.struct(F.col("part").alias("to"), F.lit(0).alias("guest")), F.when(F.col("again").isNotNull(), F.struct(F.col("again").alias("to"), F.lit(1).alias("guest")))))
    dealt = rows.select("id", "text", F.explode(places).alias("p")).select("p.to", "p.guest", "id", "text")
    dealt = dealt.repartitionById(len(limits) + 1, F.col("to").cast("int")).sortWithinPartitions("to", "guest", F.col("id").asc_nulls_first(), "text")

    def run(batches):
        return _compare(_pairs(batches), id_column, pa_kind)

    pa_kind = docs.select(F.col(f"`{id_column}`")).limit(0).toArrow().schema.field(0).type
    return dealt.mapInArrow(run, f"`{id_column}` {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, key string")


def _pairs(batches):
    """(id, text, next text) of every host row of sorted (range, guest, id, text) rows. Of a range's guests only the first counts."""
    last, told = None, None
    for b in batches:
        for to, guest, i, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if guest:
                if last is not None and last[0] == to:
                    yield last[1], last[2], text
                    last = None
                continue
            if last is not None:
                yield last[1], last[2], text
            last = (to, i, text)
    if last is not None:
        yield last[1], last[2], last[2]


def _compare(pairs, id_column: str, kind: pa.DataType):
    def made(held):
        ids = [h[0] for h in held]
        texts, nexts = [h[1] for h in held], [h[2] for h in held]
        new = [edit(a, b) for a, b in zip(texts, nexts, strict=True)]
        # a next text is mostly the following row's own
        known = {}
        todo = []
        for t in (*texts, *new, *nexts):
            if t not in known:
                known[t] = len(todo)
                todo.append(t)
        found = np.concatenate([sign(pa.array(todo[i : i + 256], pa.large_string())) for i in range(0, len(todo), 256)])
        s, e, x = (found[[known[t] for t in ts]] for ts in (texts, new, nexts))
        near = [(s == o).mean(1) for o in (e, x)]
        cols = [pa.array(ids, kind), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in new]), pa.array(as_text(s)), pa.array(as_text(e)), pa.array(near[0]), pa.array(near[1]), pa.array([hashlib.md5(t.encode()).hexdigest() for t in texts])]
        return pa.RecordBatch.from_arrays(cols, [id_column, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "key"])

    held, size = [], 0
    for p in pairs:
        held.append(p)
        size += len(p[1])
        if size > STEP or len(held) >= 2000:
            yield made(held)
            held, size = [], 0
    if held:
        yield made(held)


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", similar: float = SIMILAR) -> DataFrame:
    """Per document: id and class_id, the smallest id reachable over verified links; null where no text of the class has an id.

    Distinct texts that share a band of minima over their shingles are candidates; inside a component of candidates every pair of
    shingle sets that can be so like is held against the Jaccard similarity, a link if it is at least similar."""
    rows = docs.select(F.col(f"`{id_column}`").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("key", F.md5("text"))
    signed = cut(fingerprints(rows, ["id", "key"]), "signatures")
    return with_classes(rows, signed, similar).select(F.col("id").alias(id_column), "class_id")


def with_classes(rows: DataFrame, signed: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """signed (id, key, fingerprint and more) with class_id. rows: id, text and key of the same documents."""
    width = 4 * PER_BAND
    band = F.transform(F.sequence(F.lit(0), F.lit(PERMUTATIONS // PER_BAND - 1)), lambda k: F.xxhash64(k, F.substring("fingerprint", k * width + 1, F.lit(width))))
    firsts = signed.groupBy("key").agg(F.min("fingerprint").alias("fingerprint"), F.min(F.struct(F.col("id").isNull().alias("none"), "id")).alias("least"), F.count("*").alias("n"))
    texts = cut(firsts.select("key", "least", "n", band.alias("bands"), F.monotonically_increasing_id().alias("node")), "texts")
    classes = verified(rows, texts, components(edges(texts)), _sets, similar).select("key", F.col("class_least").alias("class_id"))
    # texts alone are their own class; of the rest a key may hold a third of all rows
    others = cut(classes.join(texts.select("key", "n", F.col("least.id").alias("own")), "key").where("n > 1 or not (class_id <=> own)").select("key", F.struct("class_id").alias("c")), "classes")
    found = salted(signed, others, ["key"], ["id"], "left")
    return found.withColumn("class_id", F.when(F.col("c").isNotNull(), F.col("c.class_id")).otherwise(F.col("id"))).drop("c")


def _sets(texts: pa.Array) -> list:
    """The sorted hashes of each text's distinct shingles."""
    of, h = shingles(texts)
    h = h.view(np.int64)
    order = np.lexsort((h, of))
    of, h = of[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    at = np.zeros(len(texts) + 1, np.int32)
    np.cumsum(np.bincount(of[new], minlength=len(texts)), out=at[1:])
    return [pa.ListArray.from_arrays(pa.array(at), pa.array(h[new]))]


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document its digest columns, and class_id: the smallest doc_id of its verified near duplicates."""
    docs = table(spark, sf_dir, "documents")
    made = cut(edited(docs), "edited").withColumnRenamed("doc_id", "id")
    rows = docs.select(F.col("doc_id").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("key", F.md5("text"))
    out = with_classes(rows, made).withColumnRenamed("id", "doc_id")
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "class_id")
