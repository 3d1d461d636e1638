"""Dense surface features of texts: shares of character classes and figures on words."""

import numpy as np
import pyarrow as pa

from veldt.llm.textops import ALNUM, NOT_SPACE, raw, word_hash, words

_GROUPS = (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n\r", b"\t\x0b\x0c", b".", b",;:", b"!", b"?", b"|", b"#$%&*", b"()[]{}<>", b"\"'`", b"@/\\^_~+=-")
_CLASS = np.full(256, len(_GROUPS), np.int64)
for _i, _g in enumerate(_GROUPS):
    _CLASS[list(_g)] = _i
_CLASS[128:] = len(_GROUPS) + 1
K = len(_GROUPS) + 2
NAMES = [*(f"class{i}" for i in range(K)), *(f"root{i}" for i in range(K)), "word_length", "repeats", "distinct", "caps", "symbol_words", "lines", "log_words"]


def dense(texts: pa.Array) -> np.ndarray:
    """A row of float features per text; an empty text has zeros."""
    buf, at = raw(texts)
    n = len(texts)
    out = np.zeros((n, len(NAMES)))
    size = np.diff(at)
    of = np.repeat(np.arange(n), size)
    counts = np.bincount(of * K + _CLASS[buf], minlength=n * K).reshape(n, K)
    share = counts / np.maximum(size, 1)[:, None]
    out[:, :K] = share
    out[:, K : 2 * K] = np.sqrt(share)
    start, end, doc = words(buf, at, NOT_SPACE)
    if len(start):
        m = np.maximum(np.bincount(doc, minlength=n), 1)
        core, cend, cdoc = words(buf, at, ALNUM)
        h = word_hash(buf, core, cend)
        k = np.maximum(np.bincount(cdoc, minlength=n), 1)
        same = np.zeros(len(h), bool)
        same[1:] = (h[1:] == h[:-1]) & (cdoc[1:] == cdoc[:-1])
        order = np.lexsort((h, cdoc))
        new = np.ones(len(h), bool)
        new[1:] = (h[order][1:] != h[order][:-1]) | (cdoc[order][1:] != cdoc[order][:-1])
        first_upper = (buf[start] >= 65) & (buf[start] <= 90) & (end - start > 1) & (buf[np.minimum(start + 1, len(buf) - 1)] >= 65) & (buf[np.minimum(start + 1, len(buf) - 1)] <= 90)
        out[:, 2 * K + 0] = np.bincount(doc, end - start, n) / m
        out[:, 2 * K + 1] = np.bincount(cdoc, same, n) / k
        out[:, 2 * K + 2] = np.bincount(cdoc[order], new, n) / np.power(k, 0.75)
        out[:, 2 * K + 3] = np.bincount(doc, first_upper, n) / m
        out[:, 2 * K + 4] = np.bincount(doc, _CLASS[buf[end - 1]] == 11, n) / m
        out[:, 2 * K + 5] = counts[:, 4] / m
        out[:, 2 * K + 6] = np.log1p(np.bincount(doc, minlength=n))
    return out
