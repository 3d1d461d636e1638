"""Candidates for a Jaccard similarity: sets of hashes that agree in a band of minima.

PER_BAND * BANDS universal hashes, (a x + b) mod 2^64 with odd a, upper 32 bits kept, are minimised over each set; a band is PER_BAND
of them. Two sets of similarity s agree in one band at least with 1 - (1 - s^PER_BAND)^BANDS, whatever elements differ: all but 5e-8 at 0.8.

edges() links all members of a band's bucket to its first one, so a bucket costs as many edges as it has members, however large
it is; nothing is compared here. Empty sets have no bands, an empty table gives no edges.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldt.llm.common import cut
from veldt.llm.textops import mix

BANDS = 32
PER_BAND = 4
#: The field that map_text makes of keys().
FIELD = ("bands", "array<bigint>", pa.list_(pa.int64()))
_rng = np.random.default_rng(20261126)
_A = _rng.integers(0, 1 << 63, BANDS * PER_BAND, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, BANDS * PER_BAND, dtype=np.uint64) * np.uint64(2)


def keys(sets: pa.ListArray) -> pa.ListArray:
    """BANDS keys of each set of hashes; a band's number is mixed into its key."""
    at, flat = sets.offsets.to_numpy().astype(np.int64), sets.values.to_numpy().view(np.uint64)
    some = at[1:] > at[:-1]
    edge = at[:-1][some]
    out = np.empty((len(edge), BANDS), np.uint64)
    if len(edge):
        for band in range(BANDS):
            key = np.full(len(edge), band + 1, np.uint64)
            for k in range(band * PER_BAND, (band + 1) * PER_BAND):
                key = mix(key * _A[0] + np.minimum.reduceat((flat * _A[k] + _B[k]) >> np.uint64(32), edge))
            out[:, band] = key
    ends = np.zeros(len(some) + 1, np.int32)
    np.cumsum(some * BANDS, out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(out.view(np.int64).ravel()))


def edges(texts: DataFrame) -> DataFrame:
    """a, b: for each bucket of texts (node, bands) an edge from every other member to the smallest one."""
    every = texts.select("node", F.explode("bands").alias("band"))
    first = cut(every.groupBy("band").agg(F.min("node").alias("rep"), F.count("*").alias("n")).where("n > 1").drop("n"), "bands")
    return every.join(first, "band").where("node <> rep").select(F.col("node").alias("a"), F.col("rep").alias("b"))
