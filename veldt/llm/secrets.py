"""Secret scans: patterns, and character Markov models of random strings against ordinary identifiers.

Base patterns (whole matches, leftmost and non-overlapping per kind, too short ones dropped): assign, access, hex.
Beside them, every run of 20 or more characters of ``A-Za-z0-9+/_-`` with a digit is scored by two
character bigram models, one trained on labelled random strings, one on labelled identifiers; runs
whose log-likelihood ratio per character passes a threshold are spans of kind ``markov``, unless they
touch a base span. The models are trained on the driver from samples (given, or made by labelled_samples).

Offsets are code points, end exclusive. A null text is empty, repeated rows are repeated in the result, an empty table gives no rows; other
columns are kept or ignored as asked. Texts are scanned whole, with byte masks first, so that
regular expressions see only texts which hold a keyword.
"""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldt.llm.common import hide, table
from veldt.llm.textops import map_text, raw, words

KINDS = ("assign", "access", "hex", "markov")
ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
LEAST = {"assign": 6, "access": 20, "hex": 24, "markov": 20}
#: Nats per character by which the random model must be ahead.
AHEAD = 0.35
ALPHABET = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
MASK = "[secret]"

_HEX, _RUN = np.zeros(256, bool), np.zeros(256, bool)
_HEX[list(b"0123456789abcdef")] = True
_RUN[list(ALPHABET)] = True
_CODE = np.full(256, -1, np.int64)
_CODE[list(ALPHABET)] = np.arange(len(ALPHABET))

#: Words that ordinary identifiers are made of.
IDENTIFIER_WORDS = """
account action address amount array average batch before block board body buffer build button cache calculate
callback cancel category change channel check child class clean client close code collection color column command
commit component config connection container content context control convert count create current custom data
database date default delete description device directory display document domain download element enable encode
error event example execute export factory field file filter final first folder format frame function generate
global graph group handle handler header height history index initial input insert instance integer interface
internal item iterator kernel language last layer length level library limit line list listener load local
location logger manager map matrix memory message method metric minimum model module monitor move name network
node number object offset option order output package page parameter parent parse path pattern payload pending
position prefix previous print private process product profile project property protocol provider public query
queue random range read record reference region register remove render report request reset resource response
result return route row sample schedule schema scope search section select sequence server service session setting
shape size sort source stack start state status stream string style submit suffix summary support system table
target task template text thread time title total transaction transform tree trigger type update upload user
valid value vector version view visible width window worker write
""".split()


def labelled_samples(n: int = 4000, seed: int = 7) -> tuple[list[str], list[str]]:
    """n random strings (hex, base 36, base 62, base 64) and n identifiers (camel, snake, kebab case and paths, some numbered)."""
    rng = np.random.default_rng(seed)
    kinds = ("0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", ALPHABET.decode())
    strings = ["".join(kinds[i % 4][j] for j in rng.integers(0, len(kinds[i % 4]), rng.integers(20, 48))) for i in range(n)]
    names = []
    for i in range(n):
        parts = [IDENTIFIER_WORDS[j] for j in rng.integers(0, len(IDENTIFIER_WORDS), rng.integers(3, 7))]
        if rng.random() < 0.3:
            parts.append(str(rng.integers(0, 2100)))
        names.append((parts[0] + "".join(map(str.capitalize, parts[1:])), "_".join(parts), "-".join(parts), "/".join(parts), "".join(parts), "_".join(parts).upper())[i % 6])
    return strings, names


def train(samples: list[str]) -> np.ndarray:
    """Log-probabilities of each character after each (the last row: of the first), with add-one-half smoothing."""
    k = len(ALPHABET)
    counts = np.full((k + 1, k), 0.5)
    for s in samples:
        c = _CODE[np.frombuffer(s.encode(), np.uint8)]
        c = c[c >= 0]
        if len(c):
            counts[k, c[0]] += 1
            np.add.at(counts, (c[:-1], c[1:]), 1)
    return np.log(counts / counts.sum(1, keepdims=True))


def ratio(random: np.ndarray, ordinary: np.ndarray) -> np.ndarray:
    return random - ordinary


def ahead(table_: np.ndarray, run: bytes) -> float:
    """Nats per character by which the random model is ahead on this run."""
    c = _CODE[np.frombuffer(run, np.uint8)]
    return float(table_[-1, c[0]] + table_[c[:-1], c[1:]].sum()) / len(c)


def scanner(table_: np.ndarray, least: float = AHEAD):
    """A function from an array of texts to the spans of each (first byte, end byte, kind number), sorted, the
    bytes of all texts and their offsets."""

    def scan(texts: pa.Array):
        buf, at = raw(texts)
        found: list[list[tuple[int, int, int]]] = [[] for _ in range(len(texts))]
        data = buf.tobytes()
        lower = data.lower()
        suspects = set()
        for word in KEYWORDS:
            i = lower.find(word)
            while i >= 0:
                suspects.add(i)
                i = lower.find(word, i + 1)
        for d in np.unique(np.searchsorted(at, sorted(suspects), "right") - 1).tolist():
            for m in ASSIGN.finditer(data, at[d], at[d + 1]):
                if m.end(2) - m.start(2) >= LEAST["assign"]:
                    found[d].append((m.start() - at[d], m.end() - at[d], 0))
        suspects = []
        i = data.find(b"AKIA")
        while i >= 0:
            suspects.append(i)
            i = data.find(b"AKIA", i + 1)
        for d in np.unique(np.searchsorted(at, suspects, "right") - 1).astype(int).tolist():
            for m in ACCESS.finditer(data, at[d], at[d + 1]):
                if m.end() - m.start() >= LEAST["access"]:
                    found[d].append((m.start() - at[d], m.end() - at[d], 1))
        for kind, mask in ((2, _HEX), (3, _RUN)):
            start, end, doc = words(buf, at, mask)
            for i in np.flatnonzero(end - start >= LEAST[KINDS[kind]]).tolist():
                s, e, d = int(start[i]), int(end[i]), int(doc[i])
                if kind == 3:
                    run = data[s:e]
                    if not any(48 <= c < 58 for c in run) or ahead(table_, run) < least:
                        continue
                    if any(a < e - at[d] and s - at[d] < b for a, b, _ in found[d]):
                        continue
                found[d].append((s - at[d], e - at[d], kind))
        for spans in found:
            spans.sort(key=lambda x: (x[0], x[2], x[1]))
        return found, data, at

    return scan


def _points(data: bytes, base: int, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The spans in code points."""
    if not spans:
        return []
    edge = sorted({x for s in spans for x in s[:2]})
    points, n, last = {}, 0, 0
    for e in edge:
        n += len(data[base + last : base + e].decode())
        points[e], last = n, e
    return [(points[a], points[b], k) for a, b, k in spans]


def models(samples: tuple[list[str], list[str]] | None = None) -> np.ndarray:
    strings, names = samples or labelled_samples()
    return ratio(train(strings), train(names))


def scan_table(docs: DataFrame, keep: list[str], samples=None, least: float = AHEAD) -> DataFrame:
    """The kept columns and spans array<struct<kind,first,end>>, sorted by first, then kind as listed."""
    scan = scanner(models(samples), least)
    kind = pa.struct([("kind", pa.string()), ("first", pa.int64()), ("end", pa.int64())])

    def fn(texts):
        found, data, at = scan(texts)
        return [pa.array([[{"kind": KINDS[k], "first": int(a), "end": int(b)} for a, b, k in _points(data, int(at[i]), [tuple(map(int, s)) for s in spans])] for i, spans in enumerate(found)], pa.list_(kind))]

    return map_text(docs, keep, fn, [("spans", "array<struct<kind:string,first:bigint,end:bigint>>", pa.list_(kind))])


def redact(docs: DataFrame, samples=None, least: float = AHEAD, mask: str = MASK) -> DataFrame:
    """The documents with every span (overlapping ones as one) replaced by the mask; a null text stays null.
    n_chars, where there is such a column, follows the text."""
    scan = scanner(models(samples), least)

    def fn(texts):
        found, data, at = scan(texts)
        out = []
        for i, (t, spans) in enumerate(zip(texts, found, strict=True)):
            if not spans:
                out.append(t.as_py())
                continue
            whole, kept, last = data[at[i] : at[i + 1]], [], 0
            merged: list[list[int]] = []
            for a, b, _ in spans:
                if merged and a < merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            for a, b in merged:
                kept += [whole[last:a], mask.encode()]
                last = b
            out.append((b"".join(kept) + whole[last:]).decode())
        return [pa.array(out, pa.string())]

    hidden, back = hide(docs)
    out = map_text(hidden, hidden.columns, fn, [], text_out=True)
    if "n_chars" in docs.columns:
        n_chars = hidden.columns[docs.columns.index("n_chars")]
        out = out.withColumn(n_chars, F.when(F.col("text").isNull(), F.col(n_chars)).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return back(out)


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the numbers of base spans, a digest of them, and all spans."""
    rows = scan_table(table(spark, sf_dir, "documents"), ["doc_id"])
    text = F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["first"], s["end"]))
    base = F.filter("spans", lambda s: s["kind"] != "markov")
    return rows.select(
        "doc_id",
        *(F.size(F.filter("spans", _is(k))).cast("long").alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(F.array_join(F.transform(base, lambda s: F.concat_ws(":", s["kind"], s["first"], s["end"])), ","), 256).alias("base_sha256"),
        F.array_join(text, ",").alias("spans"),
    )


def _is(kind: str):
    return lambda s: s["kind"] == kind
