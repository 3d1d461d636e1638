"""SimHash near-duplicates with covering locality-sensitive hashing.

A text's fingerprint: bit i is set if it is set in over half the XXH64 hashes of its word shingles.
Covering: the 64 bit positions are mapped to vectors of RADIUS + 1 bits, and table v (every vector
but zero) keeps the positions whose vector is orthogonal to v flipped out. Any RADIUS positions leave
some v orthogonal to all of theirs, so two fingerprints that differ there only agree on all that v keeps: every pair
within the radius collides in some table. The map is balanced, so that each table keeps about half of the bits.

Only distinct fingerprints are dealt into tables, so exact copies cost nothing. Within a bucket of a table no pairs
are emitted: a search outwards from one member after the other yields the edges of a spanning forest of the
bucket's links, from which components() finds the classes. Buckets beyond BUCKET members are dealt into blocks, and each
pair of blocks is searched by a task of its own, so no task holds more than two blocks.

Nulls: a null text is empty; a text without words has fingerprint zero, linked like any other. Null ids are never a
component's id unless it has no other. Repeated rows are repeated in the result, an empty table gives none.
"""

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veldt.llm import bands
from veldt.llm.common import cut, discard, hide, salted, table
from veldt.llm.components import components, least_of
from veldt.llm.textops import NOT_SPACE, map_text, mix, raw, windows, word_hash, words

BITS = 64
SHINGLE = 4
SEED = 42
RADIUS = 4
#: Fingerprints of a bucket that are searched in one place (a megabyte); linked ones leave the search at once, so only the
#: unlinked ones of a bucket cost time with their square.
BUCKET = 1 << 17
#: Shingles in the sets of a candidate class that are searched in one place (sixteen megabytes).
SETS = 1 << 21
#: The texts of candidates are fetched in so many passes over the documents, each shuffling its share of them.
PASSES = 4
#: Candidates that are verified have so many fingerprints of their distinct words, under different hashes; RADIUS bits in one suffice.
FINGERPRINTS = 6
#: Members of a run that a task holds at once.
HELD = 1 << 20
_SPACE_OUT = np.arange(256, dtype=np.uint8)
_SPACE_OUT[65:91] += 32


def fingerprints(texts: pa.Array, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """The fingerprint of each text, as unsigned 64-bit numbers."""
    buf, at = raw(texts)
    out = np.zeros(len(texts), np.uint64)
    start, end, doc = words(buf, at, NOT_SPACE)
    if not len(start):
        return out
    # the words with one space after each: a shingle is then a slice
    size = end - start
    new = np.zeros(len(start) + 1, np.int64)
    np.cumsum(size + 1, out=new[1:])
    flat = np.full(new[-1], 32, np.uint8)
    take = np.ones(len(buf), bool)
    take[:] = NOT_SPACE[buf]
    place = np.arange(len(buf))[take] + np.repeat(new[:-1] - start, size)
    flat[place] = _SPACE_OUT[buf[take]]
    data = memoryview(flat.tobytes())
    first = np.searchsorted(doc, np.arange(len(texts)), "left")
    last = np.searchsorted(doc, np.arange(len(texts)), "right")
    n = last - first
    digest = xxhash.xxh64_intdigest
    many = np.flatnonzero(doc[: len(doc) - shingle + 1] == doc[shingle - 1 :]) if len(doc) >= shingle else np.zeros(0, np.int64)
    few = np.flatnonzero((n > 0) & (n < shingle))
    low = np.concatenate([new[many], new[first[few]]])
    high = np.concatenate([new[many + shingle], new[last[few]]]) - 1
    of = np.concatenate([doc[many], few])
    hashes = np.fromiter((digest(data[a:b], seed) for a, b in zip(low.tolist(), high.tolist(), strict=True)), np.uint64, len(low))
    order = np.argsort(of, kind="stable")
    hashes, of = hashes[order], of[order]
    edge = np.flatnonzero(np.diff(of, prepend=-1))
    for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(of)], strict=True):
        out[of[a]] = _majority(hashes[a:b])
    return out


def _majority(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes, counted in steps of bounded memory."""
    count = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = np.ascontiguousarray(hashes[i : i + (1 << 16)]).astype("<u8")
        count += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits((2 * count > len(hashes)).astype(np.uint8), bitorder="little")
    return int(bits.view("<u8")[0])


def with_fingerprints(docs: DataFrame, keep: list[str], shingle: int = SHINGLE) -> DataFrame:
    """The kept columns and fp, the fingerprint as a signed long of the same bits."""
    return map_text(docs, keep, lambda t: [pa.array(fingerprints(t, shingle).view(np.int64))], [("fp", "bigint", pa.int64())])


def masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """The covering masks: one for each non-zero vector of radius + 1 bits, keeping the positions whose
    vectors have an odd product with it."""
    k = radius + 1
    vector = [i % ((1 << k) - 1) + 1 for i in range(bits)]
    return [sum(1 << i for i in range(bits) if (vector[i] & v).bit_count() % 2) for v in range(1, 1 << k)]


def _distance(one, many: np.ndarray) -> np.ndarray:
    # of signed numbers bitwise_count would count the absolute value's bits
    return np.bitwise_count((many ^ one).view(np.uint64))


def forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among distinct fingerprints. A member that has been reached is
    compared with those not yet reached only."""
    rest, edges = fps, []
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            near = _distance(at, rest) <= radius
            if near.any():
                found = rest[near]
                edges += [(int(at), int(x)) for x in found]
                queue += list(found)
                rest = rest[~near]
    return edges


def _runs(batches, width: int):
    """(keys, values, first of each run) of sorted batches, no run cut in two unless it is longer than HELD:
    then its parts come one by one."""
    keys, fps = None, None
    for b in batches:
        k = np.stack([b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(width)])
        f = b.column(width).to_numpy(zero_copy_only=False)
        if not len(f):
            continue
        if fps is not None:
            k, f = np.concatenate([keys, k], 1), np.concatenate([fps, f])
        edge = np.concatenate([[0], np.flatnonzero((k[:, 1:] != k[:, :-1]).any(0)) + 1])
        whole = edge[-1] if len(f) - edge[-1] <= HELD else len(f)
        if whole:
            yield k[:, :whole], f[:whole], edge[edge < whole]
        keys, fps = (k[:, whole:], f[whole:]) if whole < len(f) else (None, None)
    if fps is not None:
        yield keys, fps, np.zeros(1, np.int64)


def _search(keys, fps, first, radius: int, bucket: int):
    """Edges of the runs of up to bucket members, as arrays of table number, a and b; and the longer runs as slices."""
    last = np.append(first[1:], len(fps))
    size = last - first
    pair = first[size == 2]
    near = _distance(fps[pair], fps[pair + 1]) <= radius
    t, a, b = [keys[0, pair[near]]], [fps[pair[near]]], [fps[pair[near] + 1]]
    for x, y in zip(first[(size > 2) & (size <= bucket)].tolist(), last[(size > 2) & (size <= bucket)].tolist(), strict=True):
        if edges := forest(fps[x:y], radius):
            u, v = zip(*edges, strict=True)
            t.append(np.full(len(u), keys[0, x]))
            a.append(np.array(u, np.int64))
            b.append(np.array(v, np.int64))
    return np.concatenate(t), np.concatenate(a), np.concatenate(b), list(zip(first[size > bucket].tolist(), last[size > bucket].tolist(), strict=True))


def link(fps: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """a, b: edges that connect all pairs of distinct fingerprints (column fp) within the radius, through a
    spanning forest of each bucket. Where there is a column k as well, fingerprints of different k are kept apart and edges have
    their k."""
    spark = fps.sparkSession
    signed = [m - (1 << 64) if m >> 63 else m for m in masks(radius)]
    apart, own = len(signed), "k" in fps.columns
    number = F.col("k") * apart if own else F.lit(0)
    dealt = fps.select("fp", F.explode(F.array(*(F.lit(i) for i in range(apart)))).alias("i"), number.alias("n")).select((F.col("n") + F.col("i")).cast("int").alias("t"), "fp")
    # a bucket's key follows from the table and the fingerprint, so it is not shuffled
    key = F.col("fp").bitwiseAND(F.element_at(F.array(*map(F.lit, signed)), F.col("t") % apart + 1))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def search(batches):
        """Edges (t is -1), and the members of buckets that are too large."""
        past = None
        for keys, fps, first in _runs(batches, 2):
            if past is not None and tuple(keys[:, 0]) == past:  # a further part of a long run
                n = first[1] if len(first) > 1 else len(fps)
                yield _rows(keys[0, :n], keys[1, :n], fps[:n], fps[:n])
                keys, fps, first = keys[:, n:], fps[n:], first[1:] - n
            if not len(fps):
                continue
            t, a, b, long = _search(keys, fps, first, radius, bucket)
            past = None
            for x, y in long:
                yield _rows(keys[0, x:y], keys[1, x:y], fps[x:y], fps[x:y])
                past = tuple(keys[:, x]) if y == len(fps) else None
            yield _rows(np.full(len(a), -1), t // apart, a, b)

    first = cut(dealt.repartition(parts, "t", key).select("t", key.alias("key"), "fp").sortWithinPartitions("t", "key").mapInArrow(search, "t int, key long, a long, b long"), "links")
    names = [F.col("key").cast("int").alias("k"), "a", "b"] if own else ["a", "b"]
    edges = first.where("t < 0").select(*names)
    large = first.where("t >= 0").select("t", "key", F.col("a").alias("fp"))
    sizes = large.groupBy("t", "key").agg(F.count("*").alias("n"))
    if sizes.limit(1).count() == 0:
        return edges
    meet = _blocked(large, ["t", "key"], sizes, bucket, "fp").select("t", "key", "i", "j", "fp")

    def blocks(batches):
        for keys, fps, first in _runs(batches, 4):
            t, a, b, _ = _search(keys, fps, first, radius, 1 << 62)
            yield _rows(np.full(len(a), -1), t // apart, a, b)

    more = meet.repartition(parts, "t", "key", "i", "j").sortWithinPartitions("t", "key", "i", "j").mapInArrow(blocks, "t int, key long, a long, b long")
    return edges.union(cut(more.select(*names), "links"))


def _rows(t, key, a, b) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"t": pa.array(t.astype(np.int32)), "key": pa.array(key, pa.int64()), "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def classes(docs: DataFrame, id_column: str = "doc_id", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """Per document: its id, fp and component_id, the smallest id reachable over links within the radius."""
    prints = cut(with_fingerprints(docs, [id_column], shingle), "prints")
    distinct = prints.groupBy("fp").agg(F.min(F.col(f"`{id_column}`")).alias("least"))
    roots = components(link(distinct.select("fp"), radius))
    known = cut(least_of(distinct.select(F.col("fp").alias("node"), F.col("least").alias("own")), roots, "own").select(F.col("node").alias("fp"), F.col("least").alias("component_id")), "known")
    return prints.join(known, "fp").select(id_column, "fp", "component_id")


def _blocked(rows: DataFrame, keys: list[str], sizes: DataFrame, limit: int, member: str) -> DataFrame:
    """Every pair of a group's rows meets in some (keys, i, j): groups of up to limit in size (n) in one place, larger ones
    in one for each pair of their blocks."""
    blocks = F.when(F.col("n") <= limit, F.lit(1)).otherwise(F.ceil(F.col("n") / F.lit(limit / 2))).cast("long")
    rows = salted(rows, sizes.withColumn("blocks", blocks), keys, [member])
    rows = rows.withColumn("i", F.pmod(F.xxhash64(member), F.col("blocks"))).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return rows.withColumns({"i": F.least("i", "j"), "j": F.greatest("i", "j")}).drop("blocks", "n")


def similar_forest(ids: np.ndarray, sets: list[np.ndarray], similar: float) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the pairs of (sorted) sets whose Jaccard similarity is at least similar; empty sets are alike.

    With its elements from the rarest to the commonest, a set of n shares one of its first n - similar n + 1 with every set that is so like it:
    only sets that do, and have not been reached, are compared, so elements that all sets share bring no comparisons."""
    size = np.array([len(x) for x in sets])
    none = np.flatnonzero(size == 0)
    edges = [(int(ids[none[0]]), int(ids[y])) for y in none[1:]]
    owner = np.repeat(np.arange(len(sets)), size)
    if not len(owner):
        return edges
    _, element, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.lexsort((element, times[element], owner))
    at = np.cumsum(size) - size
    first = np.arange(len(order)) - at[owner] < (size - np.ceil(similar * size - 1e-9) + 1)[owner]
    rare, of = element[order][first], owner[first]
    of_at = np.searchsorted(of, np.arange(len(sets) + 1))
    by = np.argsort(rare, kind="stable")
    listed, lists = rare[by], of[by]
    open_ = size > 0
    for start in range(len(sets)):
        if not open_[start]:
            continue
        open_[start] = False
        queue = [start]
        while queue:
            x = queue.pop()
            probe = rare[of_at[x] : of_at[x + 1]]
            low, high = np.searchsorted(listed, probe, "left"), np.searchsorted(listed, probe, "right")
            n = high - low
            maybe = np.zeros(len(sets), bool)
            maybe[lists[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())]] = True
            rest = np.flatnonzero(maybe & open_ & (size >= similar * size[x] - 1e-9) & (similar * size <= size[x] + 1e-9))
            # whole sets, some megabytes at a time
            for some in np.array_split(rest, max(1, int(size[rest].sum() >> 19))):
                if not len(some):
                    continue
                held = np.concatenate([sets[y] for y in some])
                place = np.minimum(np.searchsorted(sets[x], held), size[x] - 1)
                common = np.bincount(np.repeat(np.arange(len(some)), size[some])[sets[x][place] == held], minlength=len(some))
                near = some[common >= similar * (size[some] + size[x] - common) - 1e-9]
                open_[near] = False
                edges += [(int(ids[x]), int(ids[y])) for y in near]
                queue += near.tolist()
    return edges


def word_fingerprints(texts: pa.Array, n: int = FINGERPRINTS) -> np.ndarray:
    """n fingerprints of each text's distinct words (A-Z as a-z), a column each, under hashes mixed from one; zeros without words."""
    buf, at = raw(texts)
    start, end, doc = words(buf, at, NOT_SPACE)
    h = word_hash(buf, start, end)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    h, doc = h[new], doc[new]
    size = np.bincount(doc, minlength=len(texts))
    out = np.zeros((len(texts), n), np.uint64)
    for k in range(n):
        count = np.zeros((len(texts), BITS), np.int64)
        for i in range(0, len(h), 1 << 17):
            d = doc[i : i + (1 << 17)]
            g = mix(h[i : i + (1 << 17)] + np.uint64((k + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
            edge = np.flatnonzero(np.diff(d, prepend=-1))
            count[d[edge]] += np.add.reduceat(np.unpackbits(g.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), edge, axis=0, dtype=np.int64)
        out[:, k] = np.packbits((2 * count > size[:, None]).astype(np.uint8), axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def candidates(texts: DataFrame, radius: int = RADIUS) -> DataFrame:
    """node, root: components of texts (node, fps array, bands array) that are within the radius in any of their fingerprints, or share a band."""
    every = texts.select("node", F.posexplode("fps").alias("k", "fp"))
    first = cut(every.groupBy("k", "fp").agg(F.min("node").alias("rep"), F.count("*").alias("n")), "first")
    edges = link(first.select("k", "fp"), radius)
    for side in ("a", "b"):
        edges = edges.join(first.select("k", F.col("fp").alias(side), F.col("rep").alias(f"{side}_rep")), ["k", side])
    same = salted(every, first.where("n > 1").select("k", "fp", "rep"), ["k", "fp"], ["node"]).where("node <> rep").select(F.col("node").alias("a"), F.col("rep").alias("b"))
    return components(edges.select(F.col("a_rep").alias("a"), F.col("b_rep").alias("b")).union(same).union(bands.edges(texts)))


def similar_classes(docs: DataFrame, id_column: str = "doc_id", shingle: int = 5, similar: float = 0.8, radius: int = RADIUS) -> DataFrame:
    """Per distinct text: key (its MD5), least (struct of null flag and smallest id), class_id (the key of its class's first text).

    Candidates are the components of texts that are within the radius in one of several SimHash fingerprints of their distinct words, or that share a band of minima
    over their word shingles; inside each, pairs whose word shingle sets have at least the Jaccard similarity are linked, and classes are what links connect."""
    keyed = docs.select(F.col(f"`{id_column}`").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("key", F.md5("text"))

    def prints(texts):
        f = word_fingerprints(texts).view(np.int64)
        return [pa.ListArray.from_arrays(pa.array(np.arange(len(f) + 1, dtype=np.int32) * f.shape[1]), pa.array(f.ravel())), bands.keys(shingle_sets(texts, shingle)[0])]

    made = map_text(keyed, ["id", "key"], prints, [("fps", "array<bigint>", pa.list_(pa.int64())), bands.FIELD])
    texts = cut(made.groupBy("key").agg(F.min("fps").alias("fps"), F.min("bands").alias("bands"), F.min(F.struct(F.col("id").isNull().alias("none"), "id")).alias("least")).withColumn("node", F.monotonically_increasing_id()), "prints")
    return verified(keyed, texts, candidates(texts, radius), lambda t: shingle_sets(t, shingle), similar).select("key", "least", "class_id")


def verified(keyed: DataFrame, texts: DataFrame, roots: DataFrame, sets_of, similar: float) -> DataFrame:
    """Per distinct text: key, least, class_id (the key of its class's first text) and class_least (that text's id), where classes
    are what pairs of sets with at least the Jaccard similarity connect inside the candidate components.

    keyed: id, text and key of each row; texts: key, least and node of each distinct text; roots: components of nodes; sets_of makes the
    texts' sorted sets of hashes."""
    spark = keyed.sparkSession
    every = roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
    members = cut(texts.select("node", "key", F.col("least.id").alias("id")).join(every, "node"), "members")
    at = _place(F.col("id"), F.col("key"))
    made = []
    for k in range(PASSES):
        own = F.pmod(F.xxhash64("place"), F.lit(PASSES)) == k
        wanted = members.select(at.alias("place"), "root", "node").where(own)
        found = keyed.select(at.alias("place"), "text").where(own).join(wanted.hint("merge"), "place").dropDuplicates(["place"])
        made.append(cut(map_text(found, ["root", "node"], sets_of, [("h", "array<bigint>", pa.list_(pa.int64()))]), "sets"))
    sets = reduce(DataFrame.union, made)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    meet = _blocked(sets, ["root"], sets.groupBy("root").agg(F.sum(F.size("h") + 1).alias("n")), SETS, "node").select("root", "i", "j", "node", "h")

    def search(batches):
        for ids, held in _groups(batches):
            if edges := similar_forest(ids, held, similar):
                a, b = zip(*edges, strict=True)
                yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    links = meet.repartition(parts, "root", "i", "j").sortWithinPartitions("root", "i", "j", "node").mapInArrow(search, "a long, b long")
    nodes = components(links)
    for done in (members, *made):
        discard(done)
    named = least_of(texts.select("node", "key", F.col("least").alias("own"), F.struct("least", "key").alias("first")), nodes, "first")
    return named.select("key", F.col("own").alias("least"), F.col("least.key").alias("class_id"), F.col("least.least.id").alias("class_least"))


def _place(doc_id, key):
    """One column that equal texts (by their key) with equal ids share, null ids too: what is joined by it stays dealt by it."""
    return F.md5(F.concat(key, F.coalesce(F.concat(F.lit("="), doc_id.cast("string")), F.lit("-"))))


def shingle_sets(texts: pa.Array, size: int) -> list:
    """The sorted hashes of each text's distinct word shingles (A-Z as a-z; a shorter text is one shingle)."""
    buf, at = raw(texts)
    start, end, doc = words(buf, at, NOT_SPACE)
    h = word_hash(buf, start, end)
    first, many = windows(h, doc, size)
    n = np.bincount(doc, minlength=len(texts))
    few = np.flatnonzero((n < size) & (n > 0))
    low = np.searchsorted(doc, few, "left")
    alone = np.array([windows(h[a : a + k], doc[a : a + k], k)[1][0] for a, k in zip(low.tolist(), n[few].tolist(), strict=True)], np.uint64)
    of, both = np.concatenate([doc[first], few]), np.concatenate([many, alone]).view(np.int64)
    order = np.lexsort((both, of))
    of, both = of[order], both[order]
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (both[1:] != both[:-1])
    ends = np.zeros(len(texts) + 1, np.int32)
    np.cumsum(np.bincount(of[new], minlength=len(texts)), out=ends[1:])
    return [pa.ListArray.from_arrays(pa.array(ends), pa.array(both[new]))]


def _groups(batches):
    """(ids, sets) of each run of equal (root, i, j)."""
    key, ids, sets = None, [], []
    for b in batches:
        lists = b.column(4)
        at, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
        for r, (k, node) in enumerate(zip(zip(*(b.column(c).to_pylist() for c in range(3)), strict=True), b.column(3).to_pylist(), strict=True)):
            if k != key:
                if len(ids) > 1:
                    yield np.array(ids), sets
                key, ids, sets = k, [], []
            ids.append(node)
            sets.append(flat[at[r] : at[r + 1]].copy())
    if len(ids) > 1:
        yield np.array(ids), sets


def keep_first(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """One document of each class of similar_classes(): of its first text (smallest id, null ids last) the row that is first by all
    columns."""
    first = similar_classes(docs, id_column).where(F.col("key") == F.col("class_id")).select(_place(F.col("least.id"), F.col("key")).alias("__place"))
    hidden, back = hide(docs, "")
    columns = hidden.columns
    text, doc_id = (F.col(columns[docs.columns.index(c)]) for c in ("text", id_column))
    keyed = hidden.withColumn("__place", _place(doc_id, F.md5(F.coalesce(text.cast("string"), F.lit("")))))
    order = Window.partitionBy("__place").orderBy(*columns)
    return back(keyed.join(first, "__place", "left_semi").withColumn("__n", F.row_number().over(order)).where("__n = 1"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = classes(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
