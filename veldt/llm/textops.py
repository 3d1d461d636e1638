"""Vectorised text kernels on Arrow batches: bytes, words and rolling hashes, never a Python call per word.

Hashes are 64-bit. A word's hash is a polynomial in its (lower-cased) bytes, read off a running sum, and
then mixed; callers that need certainty compare the bytes of what collides.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldt.llm.common import small_batches

#: Bytes of text that one step works on; a longer text is a step of its own.
STEP = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = _BYTE[_LOWER]
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

#: Bytes that are not white space (space, \t \n \v \f \r).
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False
#: ASCII digits and letters and every byte of a character outside ASCII.
ALNUM = np.zeros(256, bool)
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    ALNUM[_a:_b] = True


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _INV)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _powers[i] = np.cumprod(p)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and the n + 1 offsets of their ends; null counts as empty."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, at - at[0]


def words(buf: np.ndarray, at: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, byte after the last, and text of each maximal run of the table's bytes within a text."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    on = table[buf]
    new = on.copy()
    new[1:] &= ~on[:-1]
    edge = at[:-1][at[:-1] < len(buf)]
    new[edge] = on[edge]
    start = np.flatnonzero(new)
    last = on.copy()
    last[:-1] &= ~on[1:]
    edge = at[1:][at[1:] > 0] - 1
    last[edge] = on[edge]
    end = np.flatnonzero(last) + 1
    return start, end, np.searchsorted(at, start, "right") - 1


def word_hash(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A mixed hash of each word, A-Z counting as a-z."""
    power, inverse = _grown(len(buf) + 1)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * power[: len(buf)], out=total[1:])
    return mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))


def prefix_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, lengths) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length: the words that are longer, and a mixed hash of their first so many bytes. A prefix never
    has the hash of a whole word."""
    power, inverse = _grown(len(buf) + 1)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * power[: len(buf)], out=total[1:])
    out = []
    for n in lengths:
        which = np.flatnonzero(end - start > n)
        s = start[which]
        out.append((which, mix((total[s + n] - total[s]) * inverse[s] + np.uint64(n + (1 << 32)))))
    return out


def windows(hashes: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and hash of each n consecutive words of one text."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = hashes[:m].copy()
    for j in range(1, n):
        h *= np.uint64(_BASE)
        h += hashes[j : j + m]
    ok = np.flatnonzero(doc[:m] == doc[n - 1 : n - 1 + m])
    return ok, mix(h[ok])


def steps(batch: pa.RecordBatch, text_at: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of STEP bytes of text or one row."""
    _, at = raw(batch.column(text_at))
    low = 0
    while low < batch.num_rows:
        high = max(low + 1, int(np.searchsorted(at, at[low] + STEP, "right")) - 1)
        yield batch.slice(low, high - low)
        low = high


def map_text(df: DataFrame, keep: list[str], fn: Callable[[pa.Array], list], fields: list[tuple[str, str, pa.DataType]], text: str = "text", text_out: bool = False) -> DataFrame:
    """The kept columns of every row and the new fields that fn makes of a slice's texts (one array each).
    text_out: fn's first array replaces the text column, where keep has it. A kept column with the name of a new field gives way to it."""
    small_batches(df.sparkSession)
    taken = {f[0].lower() for f in fields}
    keep = [k for k in keep if k.lower() not in taken]
    names = [*keep, *(f[0] for f in fields)]
    order = [k for k in keep if k != text]
    source = df.select(*(F.col(f"`{k}`") for k in order), F.col(f"`{text}`").cast("string").alias("__text"))

    def run(batches):
        for whole in batches:
            for part in steps(whole, whole.num_columns - 1):
                texts = part.column(part.num_columns - 1)
                made = fn(texts)
                col = {k: part.column(i) for i, k in enumerate(order)} | {text: texts}
                if text_out:
                    col[text], made = made[0], made[1:]
                col |= {f[0]: m if isinstance(m, pa.Array) else pa.array(m, f[2]) for f, m in zip(fields, made, strict=True)}
                yield pa.RecordBatch.from_arrays([col[n] for n in names], names)

    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    kinds[text] = "string"
    schema = ", ".join([f"`{k}` {kinds[k]}" for k in keep] + [f"`{n}` {t}" for n, t, _ in fields])
    return source.mapInArrow(run, schema)
