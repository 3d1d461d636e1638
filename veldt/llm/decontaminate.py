"""Benchmark decontamination with a broadcast hash set of the test items' word windows.

Words are runs of ASCII letters (in lower case), digits and characters outside ASCII. An item's windows
are its runs of N consecutive words, or all its words where it has fewer. The hashes of all windows of the
training texts are looked up in the set; what hits is verified word by word against the item. A word
inside any verified window is hit.

The set is broadcast, so it is bounded: items are dealt into blocks of at most BLOCK_BYTES of text by the hash of
their ids, and each block is read and scanned on its own, the hits of the blocks before it carried along. (A
single item beyond the bound is a block of its own.) A worker indexes a block once, whatever the number of its tasks.

Nulls: a null text or item has no words; items with a null id are named by the empty string. Equal items are
reported each by its id, an id once. Repeated documents are repeated in the result, empty tables give no hits or no rows. Very long
texts are scanned whole. Other columns are kept as asked; one with the name of a column that scan() makes gives way to it, while
drop_documents() and drop_spans() return all columns as they were, whatever their names.
"""

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldt.llm.common import cut, hide, table
from veldt.llm.textops import _LOWER, ALNUM, map_text, raw, windows, word_hash, words

N = 10
BLOCK_BYTES = 16 << 20
_SIEVE = 20


class Windows:
    """The windows of some items: sorted hashes by length, and from there the items' words."""

    def __init__(self, items: list[tuple[str, str | None]], n: int):
        self.names = [name for name, _ in items]
        buf, at = raw(pa.array([t for _, t in items], pa.string()))
        self.start, self.end, self.doc = words(buf, at, ALNUM)
        self.data = _LOWER[buf].tobytes()
        hashes, count = word_hash(buf, self.start, self.end), np.bincount(self.doc, minlength=len(items))
        self.hashes, self.first, self.sieves = {}, {}, {}
        for size in np.unique(np.minimum(count[count > 0], n)).tolist():
            # items of n words or more have windows, shorter ones are one window
            own = np.arange(len(hashes)) if size == n else np.flatnonzero(count[self.doc] == size)
            at_word, h = windows(hashes[own], self.doc[own], size)
            order = np.argsort(h, kind="stable")
            self.hashes[size], self.first[size] = h[order], own[at_word[order]]
            self.sieves[size] = np.zeros(1 << _SIEVE, bool)
            self.sieves[size][h >> np.uint64(64 - _SIEVE)] = True
        self.known: dict[tuple[int, int], dict[bytes, set[str]]] = {}

    def items_of(self, size: int, h) -> dict[bytes, set[str]]:
        """The windows with this hash and the items of each."""
        key = (size, int(h))
        if (found := self.known.get(key)) is None:
            found = self.known[key] = {}
            low, high = (int(np.searchsorted(self.hashes[size], h, side)) for side in ("left", "right"))
            for i in self.first[size][low:high].tolist():
                text = b" ".join(self.data[self.start[j] : self.end[j]] for j in range(i, i + size))
                found.setdefault(text, set()).add(self.names[self.doc[i]])
        return found

    def scan(self, texts: pa.Array):
        """Words of each text, its hit byte spans [first, last) and the items found, as lists by text."""
        buf, at = raw(texts)
        start, end, doc = words(buf, at, ALNUM)
        n_words = np.bincount(doc, minlength=len(texts))
        hashes = word_hash(buf, start, end)
        hit = np.zeros(len(start) + 1, np.int64)
        items: dict[int, set[str]] = {}
        for size in self.hashes:
            first, h = windows(hashes, doc, size)
            maybe = np.flatnonzero(self.sieves[size][h >> np.uint64(64 - _SIEVE)])
            if not len(maybe):
                continue
            place = np.searchsorted(self.hashes[size], h[maybe])
            place[place == len(self.hashes[size])] = 0
            sure = maybe[self.hashes[size][place] == h[maybe]]
            for i, key in zip(first[sure].tolist(), h[sure], strict=True):
                found = self.items_of(size, key).get(b" ".join(buf[start[j] : end[j]].tobytes().lower() for j in range(i, i + size)))
                if found:
                    hit[i] += 1
                    hit[i + size] -= 1
                    items.setdefault(int(doc[i]), set()).update(found)
        return n_words, start, end, doc, np.cumsum(hit)[:-1] > 0, items, at


#: The index that this worker made last: the block's number and the windows.
_made: list = [None, None]


def _worker_windows(number: str, shared, n: int) -> Windows:
    if _made[0] != number:
        _made[:] = [number, Windows(shared.value, n)]
    return _made[1]


def _blocks(benchmark: DataFrame, limit: int):
    """The items in blocks, each a list that fits the limit (or has a single item) and is read when it is its turn."""
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    weight = F.octet_length("text") + F.octet_length("id") + 64
    size = rows.agg(F.coalesce(F.sum(weight), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-2 * size // limit)) if size > limit else 1
    block = lambda: F.pmod(F.xxhash64("id", "text"), F.lit(blocks))
    # equal items count once, so a block of one item cannot be parted; any other block that is too large can
    while blocks > 1 and rows.distinct().groupBy(block()).agg(F.sum(weight).alias("n"), F.count("*").alias("k")).where((F.col("n") > limit) & (F.col("k") > 1)).limit(1).count():
        blocks *= 2
    for b in range(blocks):
        yield b + 1 < blocks, [(r["id"], r["text"]) for r in (rows.distinct().where(block() == b) if blocks > 1 else rows.distinct()).collect()]


def scan(docs: DataFrame, benchmark: DataFrame, keep: list[str], n: int = N, limit: int = BLOCK_BYTES) -> DataFrame:
    """The kept columns, n_words, hits (array of the first and last byte of each hit word), n_hit and items (ids, sorted as strings).
    With more blocks than one the text is carried from one to the next, and dropped at the end unless kept."""
    spark = docs.sparkSession
    keep = [k for k in keep if k.lower() not in ("n_words", "hits", "n_hit", "items")]
    carry, past = docs, []
    fields = [("__words", "bigint", pa.int64()), ("__first", "array<bigint>", pa.list_(pa.int64())), ("__last", "array<bigint>", pa.list_(pa.int64())), ("__items", "array<string>", pa.list_(pa.string()))]
    out = None
    for more, items in _blocks(benchmark, limit):
        shared, number = spark.sparkContext.broadcast(items), uuid.uuid4().hex

        def fn(texts, shared=shared, number=number):
            n_words, start, end, doc, hit, found, at = _worker_windows(number, shared, n).scan(texts)
            which = np.flatnonzero(hit)
            per = np.zeros(len(texts) + 1, np.int32)
            np.cumsum(np.bincount(doc[which], minlength=len(texts)), out=per[1:])
            lists = [pa.ListArray.from_arrays(pa.array(per), pa.array(x[which] - at[doc[which]])) for x in (start, end)]
            return [pa.array(n_words), *lists, pa.array([sorted(found.get(i, ())) for i in range(len(texts))], pa.list_(pa.string()))]

        kept = list(dict.fromkeys([*keep, *(["text"] if more else []), *past]))
        out = map_text(carry, kept, fn, fields)
        hits, ids = F.arrays_zip(F.col("__first").alias("first"), F.col("__last").alias("last")), F.col("__items")
        if past:
            hits, ids = F.array_union("__hits", hits), F.array_union("__ids", ids)
        out = out.select(*(F.col(f"`{k}`") for k in kept if k not in past), "__words", hits.alias("__hits"), ids.alias("__ids"))
        past = ["__hits", "__ids"]
        if more:
            carry = cut(out.drop("__words"), "hits")
            shared.destroy()
    return out.select(*(F.col(f"`{k}`") for k in keep), F.col("__words").alias("n_words"), F.array_sort("__hits").alias("hits"), F.size("__hits").cast("long").alias("n_hit"), F.array_sort("__ids").alias("items"))


def drop_documents(docs: DataFrame, benchmark: DataFrame, n: int = N) -> DataFrame:
    """The documents without a hit, their columns as they were."""
    hidden, back = hide(docs)
    return back(scan(hidden, benchmark, hidden.columns, n).where("n_hit = 0"))


def drop_spans(docs: DataFrame, benchmark: DataFrame, n: int = N) -> DataFrame:
    """The documents, without the text from the first to the last word of each run of hit words."""
    hidden, back = hide(docs)
    columns = hidden.columns
    rows = scan(hidden, benchmark, columns, n)

    def run(batches):
        for b in batches:
            texts, hits = b.column("text").to_pylist(), b.column("hits").to_pylist()
            out = []
            for t, spans in zip(texts, hits, strict=True):
                if t is None or not spans:
                    out.append(t)
                    continue
                data, kept, at = t.encode(), [], 0
                runs: list[list[int]] = []
                for s in spans:
                    # two hit words belong to a run if no other word stands between them
                    if runs and not ALNUM[np.frombuffer(data[runs[-1][1] : s["first"]], np.uint8)].any():
                        runs[-1][1] = s["last"]
                    else:
                        runs.append([s["first"], s["last"]])
                for first, last in runs:
                    kept.append(data[at:first])
                    at = last
                out.append((b"".join(kept) + data[at:]).decode())
            cols = [pa.array(out, pa.string()) if c == "text" else b.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays(cols, columns)

    return back(rows.select(*columns, "hits").mapInArrow(run, hidden.schema))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    return rows.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP5_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS n, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
g AS (
  SELECT DISTINCT item, least(10, len(w)) AS size, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS g
  FROM (SELECT *, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM g),
x AS (
  SELECT n, i, size, array_to_string(w[i : i + size - 1], ' ') AS g
  FROM (SELECT n, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)),
h AS (SELECT x.n, x.i, x.size, g.item FROM x JOIN g USING (size, g)),
c AS (SELECT n, count(DISTINCT p) AS n_hit FROM (SELECT n, unnest(range(i, i + size)) AS p FROM h) GROUP BY n),
t AS (SELECT n, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT n, item FROM h) GROUP BY n)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (n) LEFT JOIN t USING (n)
"""
