"""Repeated byte strings by distributed prefix doubling on sparse suffixes.

A byte is removed if some string of LENGTH bytes that covers it starts anywhere else too, in any text (matches stay
inside a text, the same text included, overlaps count). Ranking the suffix of every byte would shuffle some twenty times the
text, so only suffixes at anchors are ranked:

Every string of LENGTH bytes chooses as its anchor the position whose 8 bytes hash lowest (the leftmost of equals) among
its first LENGTH - FIRST + 1 positions. The choice depends on the string alone, so equal strings have their anchors at the same
distance d, and the FIRST bytes from there are equal. Neighbouring strings mostly share an anchor; they are one record: its
suffix's rank, the ranks at the offsets FIRST, 2 FIRST and so on, a hash of all the bytes that its strings cover, and where.

Round 0 ranks the suffixes by FIRST bytes; records alone with their rank end. Each further round doubles the length: suffixes are
ranked by the pair of their rank and the rank at that offset, and where a pair is alone, those strings of its record
that reach so far end, and the record with its last string.
What is left is ranked at LENGTH: records that are equal as a whole are settled, all their strings repeat. Where a rank of FIRST bytes has
several kinds of records, the strings of one record of each kind are ranked by (rank, d, hash of the string); those not alone repeat. Ranks of up to
HELD kinds are searched where they lie; of larger ones every string becomes a row that is summed up like any other key.

Ranks are 64-bit hashes, always compared together with the rank before, so two strings must collide twice to be mistaken.
Rounds are sums over keys (combined before the shuffle), and joins whose keys are salted, so a passage that a third of
all texts hold fills no single task. They ask for sorted joins: Spark sizes these tables by their compressed files, which tell neither the copies of
a salted group nor the rows and spans that come of them, and would broadcast what the driver cannot hold. A record knows its text by 128 bits of its id and all its bytes.

Nulls: a null text is empty; null ids are ordinary. Equal rows repeat each other, several texts under one id stay apart. Texts under LENGTH bytes keep
everything, an empty table gives no rows, other columns are ignored. Long texts are cut into overlapping parts.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldt.llm.common import cut, discard, place_of, salted, small_batches, table
from veldt.llm.textops import _grown, mix, raw, steps

LENGTH = 200
FIRST = 32
#: Kinds of records of a rank that are searched in one place.
HELD = 4_096
#: Strings that one part of a long text starts, at most.
PART = 1 << 22
_POSITION = np.uint64((1 << 24) - 1)
_TABLE = np.random.default_rng(20240617).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Hashes:
    """Mixed hashes of any slices of some bytes."""

    def __init__(self, buf: np.ndarray):
        self.power, self.inverse = _grown(len(buf) + 1)
        self.total = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(_TABLE[buf] * self.power[: len(buf)], out=self.total[1:])

    def of(self, start: np.ndarray, end: np.ndarray, salt=0) -> np.ndarray:
        return mix(mix((self.total[end] - self.total[start]) * self.inverse[start]) + np.asarray(salt).astype(np.uint64))


def grams(buf: np.ndarray) -> np.ndarray:
    """A hash of the 8 bytes from each position (fewer positions by 7)."""
    out = np.empty(max(len(buf) - 7, 0), np.uint64)
    data = buf.tobytes()
    for k in range(min(8, len(out))):
        out[k::8] = np.frombuffer(data, "<u8", count=len(range(k, len(out), 8)), offset=k)
    return mix(out + np.uint64(0x9E3779B97F4A7C15))


def anchors(buf: np.ndarray, width: int) -> np.ndarray:
    """The anchor of each window of width positions: the lowest hash's, the leftmost of equals."""
    g = grams(buf)
    low = (g & ~_POSITION) | np.arange(len(g), dtype=np.uint64)
    span = 1
    while 2 * span <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < width:
        low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
    return (low & _POSITION).astype(np.int64)


def records(buf: np.ndarray, at: np.ndarray, length: int, first: int, h: Hashes | None = None):
    """text, lo (first string's start in buf), n (strings), dx (anchor - lo), rank, whole of each record. h: the hashes of buf, if known."""
    starts = len(buf) - length + 1
    if starts <= 0:
        return [np.zeros(0, np.int64)] * 4 + [np.zeros(0, np.uint64)] * 2
    where = anchors(buf, length - first + 1)[:starts]
    p = np.arange(starts)
    text = np.searchsorted(at, p, "right") - 1
    ok = p + length <= at[text + 1]
    new = ok.copy()
    new[1:] &= ~(ok[:-1] & (where[1:] == where[:-1]) & (text[1:] == text[:-1]))
    last = ok.copy()
    last[:-1] &= new[1:] | ~ok[1:]
    lo, hi = np.flatnonzero(new), np.flatnonzero(last)
    x = where[lo]
    h = h or Hashes(buf)
    return text[lo], lo, hi - lo + 1, x - lo, h.of(x, x + first), h.of(lo, hi + length, ((x - lo) << 20) + (hi - lo))


def offsets(length: int, first: int) -> list[int]:
    """The lengths that doubling reaches before the whole: each is also the offset of the next round's second rank."""
    out = [first]
    while 2 * out[-1] < length:
        out.append(2 * out[-1])
    return out


def reach(length: int, size: int) -> int:
    """A record with n strings has one that goes size bytes past its anchor if n >= dx - reach; without those, dx - reach - 1 are left."""
    return length - size - 1


def ranks_at_offsets(h: Hashes, lo: np.ndarray, n: np.ndarray, dx: np.ndarray, length: int, first: int) -> list[np.ndarray]:
    """For each round the rank of the bytes from the offset to twice it past the anchor; 0 where no string of the record goes so far."""
    out = []
    for offset in offsets(length, first)[:-1]:
        ok = np.flatnonzero(n >= dx - reach(length, 2 * offset))
        x = lo[ok] + dx[ok]
        rank = np.zeros(len(lo), np.uint64)
        rank[ok] = h.of(x + offset, x + 2 * offset)
        out.append(rank)
    return out


def _parts(buf: np.ndarray, at: np.ndarray, length: int):
    """(offset in its text, bytes, offsets) of a step's texts; a long text alone, in overlapping parts."""
    if len(at) == 2 and len(buf) > PART + length:
        for a in range(0, len(buf) - length + 1, PART):
            part = buf[a : a + PART + length - 1]
            yield a, part, np.array([0, len(part)])
    else:
        yield 0, buf, at


def _pack(lo, n, dx):
    return (lo << 20) + (n << 10) + dx


def _unpack(pack):
    return pack >> 20, pack >> 10 & 1023, pack & 1023


def _find(docs: DataFrame, length: int, first: int) -> DataFrame:
    """place, pack (lo, n and dx), rank, whole, and the ranks at the offsets (at0, at1 and so on) of every record."""
    more = [f"at{k}" for k in range(len(offsets(length, first)) - 1)]

    def run(batches):
        for whole in batches:
            for part in steps(whole, 1):
                buf, at = raw(part.column(1))
                for base, b, a in _parts(buf, at, length):
                    if len(b) < length:
                        continue
                    h = Hashes(b)
                    text, lo, n, dx, rank, all_ = records(b, a, length, first, h)
                    if len(text):
                        numbers = [_pack(lo - a[text] + base, n, dx), *(x.view(np.int64) for x in (rank, all_, *ranks_at_offsets(h, lo, n, dx, length, first)))]
                        yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(text)), *map(pa.array, numbers)], ["place", "pack", "rank", "whole", *more])

    return docs.mapInArrow(run, "place binary, " + ", ".join(f"{c} bigint" for c in ("pack", "rank", "whole", *more)))


def _lo():
    return F.shiftright("pack", 20)


def _n():
    return F.shiftright("pack", 10).bitwiseAND(F.lit(1023))


def _dx():
    return F.col("pack").bitwiseAND(F.lit(1023))


def _doubled(kinds: DataFrame, length: int, first: int) -> DataFrame:
    """The kinds (rank, whole, times, place, pack and ranks at offsets) without the strings that end in a round of doubling."""
    pair = ["rank"]
    for k, offset in enumerate(offsets(length, first)[:-1]):
        limit = reach(length, 2 * offset)
        pair.append(f"at{k}")
        ranked = kinds.where(_n() >= _dx() - limit).groupBy(*pair).agg(F.sum("times").alias("all"), F.min(F.struct("rank", "whole")).alias("r"))
        alone = ranked.where("all = 1").select("r.rank", "r.whole", F.lit(True).alias("alone"))
        left = F.when(F.col("alone"), _dx() - limit - 1).otherwise(_n())
        # the key is a kind's own, so none is hot
        kinds = kinds.join(alone.hint("merge"), ["rank", "whole"], "left").withColumn("left", left).where("left > 0")
        kinds = kinds.withColumn("pack", F.shiftleft(_lo(), 20) + F.shiftleft(F.col("left"), 10) + _dx()).drop("alone", "left")
    return kinds.select("rank", "whole", "times", "place", "pack")


def _slices(rows: DataFrame, length: int) -> DataFrame:
    """rank, times, wide, place, pack and bytes of the wanted records. Input: place, text, wanted array<struct<pack,rank,times,wide>>."""
    names = ["rank", "times", "wide", "place", "pack", "bytes"]
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.int64(), pa.binary()]

    def run(batches):
        for b in batches:
            out, size = [], 0
            for place, text, wanted in zip(*(b.column(i) for i in range(3)), strict=True):
                data, place = memoryview(text.as_buffer()), place.as_py()
                for pack, rank, times, wide in zip(*(wanted.values.field(k).to_pylist() for k in range(4)), strict=True):
                    lo, n, _ = _unpack(pack)
                    out.append((rank, times, wide, place, pack, bytes(data[lo : lo + n + length - 1])))
                    size += n + length
                    if size > 1 << 22:
                        yield batch(out)
                        out, size = [], 0
            if out:
                yield batch(out)

    def batch(out):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return rows.mapInArrow(run, "rank bigint, times bigint, wide boolean, place binary, pack bigint, bytes binary")


def _strings(t: pa.Table, length: int):
    """record, d, h and start of every string of some slices."""
    lo, n, dx = _unpack(t["pack"].to_numpy())
    buf, at = raw(t["bytes"].combine_chunks())
    rec = np.repeat(np.arange(len(n)), n)
    nth = np.arange(len(rec)) - np.repeat(np.cumsum(n) - n, n)
    start = at[rec] + nth
    h = np.empty(len(rec), np.uint64)
    for a in range(0, len(buf), PART):
        here = slice(*np.searchsorted(start, [a, a + PART]))
        if here.stop > here.start:
            h[here] = Hashes(buf[a : a + PART + length]).of(start[here] - a, start[here] - a + length)
    return rec, dx[rec] - nth, h, lo[rec] + nth


def _match(slices: DataFrame, length: int) -> DataFrame:
    """Of slices sorted by rank: place, low and high of each run of strings that repeat, in records that stand for one place only."""

    def search(t):
        rec, d, h, p = _strings(t, length)
        rank, times = t["rank"].to_numpy()[rec], t["times"].to_numpy()[rec]
        order = np.lexsort((h, d, rank))
        new = np.ones(len(order), bool)
        new[1:] = (h[order][1:] != h[order][:-1]) | (d[order][1:] != d[order][:-1]) | (rank[order][1:] != rank[order][:-1])
        total = np.add.reduceat(times[order], np.flatnonzero(new))
        twice = np.empty(len(order), bool)
        twice[order] = (total > 1)[np.cumsum(new) - 1]
        ok = np.flatnonzero(twice & (times == 1))
        if len(ok):
            first = np.ones(len(ok), bool)
            first[1:] = (rec[ok][1:] != rec[ok][:-1]) | (p[ok][1:] != p[ok][:-1] + 1)
            last = np.append(first[1:], True)
            yield pa.RecordBatch.from_arrays([t["place"].take(pa.array(rec[ok[first]])).combine_chunks(), pa.array(p[ok[first]]), pa.array(p[ok[last]])], ["place", "low", "high"])

    def run(batches):
        rest = None
        for b in batches:
            t = pa.Table.from_batches([b])
            t = t if rest is None else pa.concat_tables([rest, t])
            ranks = t["rank"].to_numpy()
            whole = int(np.searchsorted(ranks, ranks[-1], "left")) if len(ranks) else 0
            if whole:
                yield from search(t.slice(0, whole))
            rest = t.slice(whole)
        if rest is not None and rest.num_rows:
            yield from search(rest)

    return slices.mapInArrow(run, "place binary, low bigint, high bigint")


def _spelled(slices: DataFrame, length: int) -> DataFrame:
    """rank, d, h, t (times), place and low of every string of the slices, wherever they lie."""

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 2000):
                t = pa.Table.from_batches([b.slice(i, 2000)])
                rec, d, h, p = _strings(t, length)
                of = pa.array(rec)
                cols = [t["rank"].take(of), pa.array(d.astype(np.int32)), pa.array(h.view(np.int64)), t["times"].take(of), t["place"].take(of), pa.array(p)]
                yield pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in cols], ["rank", "d", "h", "t", "place", "low"])

    return slices.mapInArrow(run, "rank bigint, d int, h bigint, t bigint, place binary, low bigint")


def repeats(docs: DataFrame, id_column: str = "doc_id", length: int = LENGTH, first: int = FIRST, held: int = HELD) -> tuple[DataFrame, DataFrame]:
    """The texts (id, place, text), and the runs of starts of repeated strings per text: place, spans array<struct<low,high>>."""
    spark = docs.sparkSession
    small_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.col(f"`{id_column}`").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = texts.select("id", place_of(F.col("id"), F.col("text")).alias("place"), "text")
    found = cut(_find(texts.select("place", "text"), length, first), "records")
    ranks = cut(found.groupBy("rank").agg(F.count("*").alias("n")).where("n > 1").select("rank"), "ranks")
    alive = cut(salted(found, ranks.hint("merge"), ["rank"], ["place", "pack"]), "alive")
    discard(found)
    discard(ranks)
    sample = F.min(F.struct("place", "pack", *(c for c in alive.columns if c.startswith("at")))).alias("r")
    kinds = cut(alive.groupBy("rank", "whole").agg(F.count("*").alias("times"), sample).select("rank", "whole", "times", "r.*"), "kinds")
    equal = kinds.where("times > 1").select("rank", "whole")
    open_ = cut(_doubled(kinds, length, first), "open")
    # ranks of one kind, which then stands in several places, and of kinds that all do, need no search
    several = open_.groupBy("rank").agg(F.count("*").alias("k"), F.min("times").alias("least")).where("k > 1 and least = 1").select("rank", (F.col("k") > held).alias("wide"))
    wanted = salted(open_, several.hint("merge"), ["rank"], ["whole"]).groupBy("place").agg(F.collect_list(F.struct("pack", "rank", "times", "wide")).alias("wanted"))
    slices = cut(_slices(texts.select("place", "text").join(wanted.hint("merge"), "place").select("place", "text", "wanted"), length), "slices")
    matched = cut(_match(slices.where("not wide").repartition(parts, "rank").sortWithinPartitions("rank"), length), "matched")
    strings = cut(_spelled(slices.where("wide"), length), "strings")
    discard(slices)
    twice = strings.groupBy("rank", "d", "h").agg(F.sum("t").alias("all")).where("all > 1").select("rank", "d", "h")
    settled = salted(alive, equal.hint("merge"), ["rank", "whole"], ["place", "pack"]).select("place", _lo().alias("low"), (_lo() + _n() - 1).alias("high"))
    spelled = salted(strings.where("t = 1"), twice.hint("merge"), ["rank", "d", "h"], ["place", "low"]).select("place", "low", F.col("low").alias("high"))
    # equal rows have the same spans, which count once
    lists = cut(settled.unionByName(matched).unionByName(spelled).groupBy("place").agg(F.collect_set(F.struct("low", "high")).alias("spans")), "spans")
    for done in (alive, kinds, open_, matched, strings):
        discard(done)
    return texts, lists


def removed(docs: DataFrame, id_column: str = "doc_id", length: int = LENGTH, with_text: bool = False, **more) -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans, kept_sha256, and kept (the remaining bytes) if asked for."""
    texts, lists = repeats(docs, id_column, length, **more)
    rows = texts.join(lists.hint("merge"), "place", "left").select("id", "text", "spans")
    names = [id_column, "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_text else [])]

    def run(batches):
        for b in batches:
            out = []
            for text, spans in zip(b.column(1), b.column(2), strict=True):
                data = text.as_buffer()
                if spans.is_valid and len(spans.values):
                    low, high = (spans.values.field(k).to_numpy() for k in range(2))
                    change = np.zeros(len(data) + 1, np.int32)
                    np.add.at(change, low, 1)
                    np.add.at(change, high + length, -1)
                    gone = np.cumsum(change[:-1]) > 0
                    kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                    n = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                else:
                    kept, n = memoryview(data), 0
                out.append((len(data), len(data) - len(kept), n, hashlib.sha256(kept).hexdigest(), bytes(kept) if with_text else None))
            cols = [pa.array(c) for c in list(zip(*out, strict=True))[: 5 if with_text else 4]] if out else []
            if out:
                yield pa.RecordBatch.from_arrays([b.column(0), *cols], names)

    kind = docs.schema[id_column].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_column}` {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + (", kept binary" if with_text else ""))


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed(table(spark, sf_dir, "documents"))
