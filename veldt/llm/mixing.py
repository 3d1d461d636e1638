"""Mixing sources to target weights by a low-discrepancy schedule.

A source's documents, shuffled by the hash of their ids, make one stream of words, cut into blocks of
equal size (documents may straddle blocks; the last block of a source may be short). Slot i of the
schedule is the i-th golden-ratio point, i * phi mod 1 in 64-bit fixed point, and the cumulative weights
say which source it falls to; a source's slots are ranked, and rank r takes block r mod n, in its
(r div n)-th pass over the source. Ranks past a source's quota fall away, the few that the
points leave short are appended, and the quota's last slot takes part of its block, so each source gives
its target to the word.

Ranking needs no global sort: chunks of the schedule are counted per source, the counts summed up, and
each chunk ranked from there. So are the offsets in a stream, by buckets of the shuffle hash.

Nulls: a null text has no words; null is a source of its own, ordered last; null ids are ordinary rows.
Repeated rows each get their own place in the stream. Documents without words take nothing, an empty
table gives no rows, columns other than doc_id, text and source are not read.
The list of sources is a recipe and is held by the driver: more than MAX_SOURCES of them is an error.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veldt.llm.common import WORD, cut, same_names, table

#: Words of a block.
BLOCK = 32
#: Passes over a source at most.
PASSES = 3
#: Slots that are ranked together.
CHUNK = 1 << 19
#: Buckets of the shuffle hash: 16 ** 3.
BUCKET_DIGITS = 3
MAX_SOURCES = 200_000
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Quota:
    source: str | None
    size: int
    weight: int
    target: float
    words: int
    blocks: int
    slots: int
    last: int


def targets(sizes: list[int], weights: list[int], total: int, passes: int = PASSES) -> list[float]:
    """Shares of total by weight, none above passes times its size: the excess goes to the others by
    weight, until none is above."""
    capped = [False] * len(sizes)
    while True:
        rest = total - sum(passes * s for s, c in zip(sizes, capped, strict=True) if c)
        weight = sum(w for w, c in zip(weights, capped, strict=True) if not c)
        share = [float(passes * s) if c else w * rest / weight for s, w, c in zip(sizes, weights, capped, strict=True)]
        over = [not c and x > passes * s for x, s, c in zip(share, sizes, capped, strict=True)]
        if not any(over):
            return share
        capped = [a or b for a, b in zip(capped, over, strict=True)]


def quotas(sources: list[tuple[str | None, int]], block: int = BLOCK) -> list[Quota]:
    """Sources in the order of their code points, null last, weighing 1, 2, 3 and so on, share all words."""
    sources = sorted(sources, key=lambda x: (x[0] is None, x[0] or ""))
    sizes = [s for _, s in sources]
    weights = [i % 3 + 1 for i in range(len(sources))]
    found = []
    for (name, size), weight, target in zip(sources, weights, targets(sizes, weights, sum(sizes)) if sources else [], strict=True):
        words = min(int(np.floor(target + 0.5)), PASSES * size)
        blocks = -(-size // block)
        full, rest = divmod(words, size) if size else (0, 0)
        slots = full * blocks + -(-rest // block)
        last = rest - (-(-rest // block) - 1) * block if rest else (size - (blocks - 1) * block if size else 0)
        found.append(Quota(name, size, weight, target, words, blocks, slots, last))
    return found


def entries(docs: DataFrame) -> DataFrame:
    """A row for each distinct (doc_id, source, size), with the number of its copies."""
    docs = same_names(docs, "doc_id", "source", "text").select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    return cut(docs.groupBy("doc_id", "source", "size").agg(F.count("*").alias("copies")), "entries")


def stream(rows: DataFrame) -> DataFrame:
    """A row for each document: its number among equal ones and its offset in the stream of its source."""
    rows = rows.withColumn("key", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = rows.withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS)).withColumn("s", F.struct("source"))
    words = F.col("size") * F.col("copies")
    past = Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("s", "bucket").agg(F.sum(words).alias("w")).select("s", "bucket", F.coalesce(F.sum("w").over(past), F.lit(0)).alias("base"))
    inside = Window.partitionBy("s", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum(words).over(inside), F.lit(0))).join(base, ["s", "bucket"])
    rows = rows.select("doc_id", "source", "size", (F.col("base") + F.col("inside")).alias("first"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"))
    return rows.select("doc_id", "source", "size", "copy", (F.col("first") + F.col("copy") * F.col("size")).alias("at"))


def pieces(placed: DataFrame, sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """What each document has in each block: source number s, block, and words [low, high) of the block."""
    rows = placed.where("size > 0").withColumn("k", F.struct("source")).join(sources.select("k", "s"), "k")
    rows = rows.select("s", "doc_id", "source", "size", "copy", "at", F.explode(F.expr(f"sequence(at div {block}, (at + size - 1) div {block})")).alias("block"))
    base = F.col("block") * block
    return rows.select("s", "block", "doc_id", "source", "size", "copy", (F.greatest("at", base) - base).alias("low"), (F.least(F.col("at") + F.col("size"), base + block) - base).alias("high"))


def numbered(spark: SparkSession, plan: list[Quota]) -> DataFrame:
    """The sources as a table: k struct<source>, number s, source_size, target."""
    rows = [((q.source,), i, q.size, q.target) for i, q in enumerate(plan)]
    return spark.createDataFrame(rows, "k struct<source:string>, s int, source_size long, target double")


def _points(low: int, n: int) -> np.ndarray:
    return (np.arange(low + 1, low + n + 1, dtype=np.uint64)) * _GOLDEN


def schedule(spark: SparkSession, plan: list[Quota]) -> DataFrame:
    """A row for each slot: slot, source number s, rank, block and the words [0, take) of the block."""
    n = sum(q.slots for q in plan)
    sums, edge = 0, []
    for q in plan:
        sums += q.slots
        edge.append((sums << 64) // max(n, 1))
    edges = np.array([min(e, (1 << 64) - 1) for e in edge[:-1]], np.uint64)
    slots, blocks, last, sizes = (np.array(x, np.int64) for x in ([q.slots for q in plan], [max(q.blocks, 1) for q in plan], [q.last for q in plan], [q.size for q in plan]))
    k = len(plan)

    def falls(chunk: int) -> np.ndarray:
        low = chunk * CHUNK
        return np.searchsorted(edges, _points(low, min(CHUNK, n - low)), "right")

    def count(batches):
        for b in batches:
            for chunk in b.column(0).to_pylist():
                c = np.bincount(falls(chunk), minlength=k)
                yield pa.RecordBatch.from_pydict({"chunk": np.full(k, chunk), "s": np.arange(k, dtype=np.int32), "n": c})

    def row(slot, s, rank):
        block = rank % blocks[s]
        take = np.where(rank == slots[s] - 1, last[s], np.minimum(BLOCK, sizes[s] - block * BLOCK))
        return pa.RecordBatch.from_pydict({"slot": slot, "s": s.astype(np.int32), "rank": rank, "block": block, "take": take})

    def rank(batches):
        for b in batches:
            for chunk, first in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                s = falls(chunk)
                base = np.zeros(k, np.int64)
                base[[x["s"] for x in first]] = [x["base"] for x in first]
                order = np.argsort(s, kind="stable")
                counts = np.bincount(s, minlength=k)
                nth = np.arange(len(s)) - np.repeat(np.cumsum(counts) - counts, counts)
                ranks = np.empty(len(s), np.int64)
                ranks[order] = nth + base[s[order]]
                keep = ranks < slots[s]
                slot = chunk * CHUNK + np.flatnonzero(keep)
                if len(slot):
                    yield row(slot, s[keep], ranks[keep])

    chunks = -(-n // CHUNK)
    shape = "slot long, s int, rank long, block long, take long"
    if not n:
        return spark.createDataFrame([], shape)
    ids = spark.range(0, chunks, 1, min(chunks, 4096))
    counts = cut(ids.mapInArrow(count, "chunk long, s int, n long"), "slots")
    past = Window.partitionBy("s").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("chunk", "s", F.coalesce(F.sum("n").over(past), F.lit(0)).alias("base"))
    ranked = bases.groupBy("chunk").agg(F.collect_list(F.struct("s", "base")).alias("first")).mapInArrow(rank, shape)
    got = {r["s"]: r["n"] for r in counts.groupBy("s").agg(F.sum("n").alias("n")).collect()}
    short = [(s, got.get(s, 0), q.slots) for s, q in enumerate(plan) if got.get(s, 0) < q.slots]
    if not short:
        return ranked

    def append(batches):
        for b in batches:
            for s, low, high, at in zip(*(c.to_pylist() for c in b.columns), strict=True):
                r = np.arange(low, high)
                yield row(at + np.arange(len(r)), np.full(len(r), s), r)

    at, rows = n, []
    for s, low, high in short:
        rows.append((s, low, high, at))
        at += high - low
    return ranked.unionByName(spark.createDataFrame(rows, "s int, low long, high long, at long").mapInArrow(append, shape))


def mix(docs: DataFrame) -> tuple[DataFrame, DataFrame, list[Quota]]:
    """The mix (slot, doc_id, source, size, copy, and the block's words [low, high) that are taken), every
    document (doc_id, source, size, copy), and the quotas."""
    spark = docs.sparkSession
    rows = entries(docs)
    sources = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("size")).limit(MAX_SOURCES + 1).collect()
    if len(sources) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    plan = quotas([(r["source"], r["size"]) for r in sources])
    taken = schedule(spark, plan).join(pieces(stream(rows), numbered(spark, plan)), ["s", "block"]).where("low < take")
    taken = taken.select("slot", "doc_id", "source", "size", "copy", "low", F.least("high", "take").alias("high"))
    every = rows.select("doc_id", "source", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"))
    return taken, every, plan


def taken_words(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, size, source_size, target (of its source) and taken."""
    taken, every, plan = mix(docs)
    key = ("doc_id", "source", "size", "copy")
    # a struct, since null ids and sources must meet their like
    sums = taken.groupBy(F.struct(*key).alias("k")).agg(F.sum(F.col("high") - F.col("low")).alias("taken"))
    rows = every.select(F.struct(*key).alias("d"), F.struct("source").alias("k")).join(sums.withColumnRenamed("k", "d"), "d", "left")
    rows = rows.join(numbered(docs.sparkSession, plan), "k")
    return rows.select("d.doc_id", "d.size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken_words(table(spark, sf_dir, "documents"))


OP2_SQL = """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
    md5(coalesce(doc_id::VARCHAR, '')) AS k, row_number() OVER () AS n FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM d GROUP BY source),
o AS (
  SELECT *, 3 * source_size / w AS edge, row_number() OVER (ORDER BY 3 * source_size / w, source) AS i FROM s),
p AS (
  SELECT *, (SELECT sum(source_size) FROM s) - coalesce(sum(3 * source_size) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    sum(w) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight FROM o),
f AS (SELECT min(i) AS i FROM p WHERE 3 * source_size * weight >= w * rest),
t AS (
  SELECT p.source, p.source_size,
    CASE WHEN p.i < f.i THEN (3 * p.source_size)::DOUBLE
      ELSE (p.w * (SELECT q.rest FROM p q WHERE q.i = f.i))::DOUBLE / (SELECT q.weight FROM p q WHERE q.i = f.i)::DOUBLE END AS target FROM p, f),
c AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, least(floor(t.target + 0.5), 3 * t.source_size)::BIGINT AS words,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size, d.n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
  CASE WHEN source_size = 0 THEN 0 ELSE
    (words // source_size) * size + greatest(0, least(pos + size, words % source_size) - pos) END::BIGINT AS taken
FROM c
"""
