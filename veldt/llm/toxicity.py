"""Toxicity by a classifier chain.

Categories are predicted one after the other; each category's linear model sees the features and the probabilities of
the categories before it. In training those are out-of-fold predictions: FOLDS models, each fitted without a fold, predict that
fold, so a later model sees earlier probabilities as wrong as they will be. The chain follows CATEGORIES, the label
columns that there are: a low-quality text first, then a toxic one.

Features: the presence of up to VOCABULARY words or stems that a category's labels depend on most (chi-squared over the documents of
the sample), and the surface features. Words, means and scales are chosen again without each fold, so nothing of a fold has a part in
its prediction. Weights are fitted with an L1 penalty, so that only telling ones keep a weight. A document is rejected if
its last probability passes the threshold: the one with the best F1 out of fold, drawn towards 0.5 as by DRAW more labels of the rarer kind.

Labels are a bounded sample (SAMPLE rows, those whose hashed ids come first); its texts are written once, word counts are made in Spark and the
fitting is on the driver. Every document is scored on its whole text.

Nulls: a null text is empty; null labels are not used; documents without id are scored and learn nothing; of several texts under
one id the first in order learns. Without labels of both kinds a category's probability is the label's share (0 without any). Unless both
kinds of the last category are in two folds at least, no probability out of fold can be held against a label: rejected is null then, drop_toxic() warns and
keeps all. Repeated rows are repeated, an empty table gives none. Kept columns with the name of a column made here give way to
it; drop_toxic() returns all columns as they were.
"""

import warnings
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veldt.llm.common import cut, discard, hide, table
from veldt.llm.features import dense
from veldt.llm.textops import ALNUM, map_text, prefix_hashes, raw, word_hash, words

#: (name, label column, the label's value that counts as 1), in the order of the chain.
CATEGORIES = (("low_quality", "quality", 0), ("toxic", "toxic", 1))
SAMPLE = 10_000
VOCABULARY = 400
#: Bytes of the stems that count beside whole words.
STEMS = (4, 5, 6, 7, 8)
FOLDS = 5
PENALTY = 5e-4
LEAST_DOCS = 5
#: Labels that the threshold's way towards an even chance is worth.
DRAW = 5
#: A threshold that no probability passes: there is no decision.
UNDECIDED = 2.0


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weights + self.bias, -500, 500)))


@dataclass(frozen=True)
class Chain:
    vocabulary: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    models: tuple[Model, ...]
    threshold: float

    def features(self, texts: pa.Array) -> np.ndarray:
        return np.hstack([presence(texts, self.vocabulary), (dense(texts) - self.mean) / self.scale])

    def predict(self, x: np.ndarray) -> np.ndarray:
        for m in self.models:
            x = np.hstack([x, m.predict(x)[:, None]])
        return x[:, -len(self.models) :]


def tokens(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(text, hash) of all words, then of the prefixes of each length: a stem counts whatever follows it."""
    buf, at = raw(texts)
    start, end, doc = words(buf, at, ALNUM)
    return [(doc, word_hash(buf, start, end)), *((doc[w], h) for w, h in prefix_hashes(buf, start, end, STEMS))]


def token_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Text and hash of each distinct word or stem of each text, ordered by text."""
    doc, h = (np.concatenate(x) for x in zip(*tokens(texts), strict=True))
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return doc[new], h[new]


def presence(texts: pa.Array, vocabulary: np.ndarray) -> np.ndarray:
    """1 where a text has a word or stem of the (sorted) vocabulary."""
    out = np.zeros((len(texts), len(vocabulary)))
    if len(vocabulary):
        sieve = np.zeros(1 << 16, bool)
        sieve[vocabulary >> np.uint64(48)] = True
        for doc, h in tokens(texts):
            maybe = np.flatnonzero(sieve[h >> np.uint64(48)])
            place = np.searchsorted(vocabulary, h[maybe])
            place[place == len(vocabulary)] = 0
            ok = vocabulary[place] == h[maybe]
            out[doc[maybe[ok]], place[ok]] = 1
    return out


def fit(x: np.ndarray, y: np.ndarray, penalty: float = PENALTY, rounds: int = 300) -> Model:
    """Logistic loss with an L1 penalty, by accelerated proximal steps; the classes weigh alike."""
    n, width = x.shape
    share = y.mean() if n else 0.0
    if share in (0.0, 1.0):
        return Model(np.zeros(width), 500.0 if share else -500.0)
    each = np.where(y == 1, 0.5 / share, 0.5 / (1 - share)) / n
    x1 = np.hstack([x, np.ones((n, 1))])
    top = np.ones(width + 1)
    for _ in range(20):
        top = x1.T @ (each * (x1 @ top))
        top /= np.linalg.norm(top)
    step = 4 / (np.linalg.norm(x1.T @ (each * (x1 @ top))) * 1.05)
    w = v = np.zeros(width + 1)
    t = 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x1 @ v, -500, 500)))
        new = v - step * (x1.T @ (each * (p - y)))
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - step * penalty, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v = new + (t - 1) / t2 * (new - w)
        w, t = new, t2
    return Model(w[:-1], float(w[-1]))


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The middle between two probabilities at which F1 is best; above 1 without positive labels."""
    if not y.any() or y.all():
        return 2.0
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    last = np.append(p[order][1:] < p[order][:-1], True)
    i = int(np.argmax(np.where(last, f1, -1)))
    return float((p[order][i] + (p[order][i + 1] if i + 1 < len(p) else 0)) / 2)


def _standard(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and scale of the columns."""
    return (x.mean(0), np.maximum(x.std(0), 1e-4)) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))


def train(vocabulary: np.ndarray, words_x: np.ndarray, dense_x: np.ndarray, labels: np.ndarray, fold: np.ndarray, chosen: list[np.ndarray] | None = None) -> Chain:
    """labels: a column per category. fold: 0 to FOLDS - 1, equal for equal documents. vocabulary: the words of the columns of words_x. chosen: the
    columns that were chosen without each fold and, last, from all documents; all columns if not given."""
    chosen = chosen or [np.arange(words_x.shape[1])] * (FOLDS + 1)
    standard = [_standard(dense_x[fold != f]) for f in range(FOLDS)] + [_standard(dense_x)]

    def features(k: int, rows: np.ndarray) -> np.ndarray:
        # one fold's columns of some rows at a time: the driver holds no second copy of the sample
        mean, scale = standard[k]
        return np.hstack([words_x[np.ix_(rows, chosen[k])], (dense_x[rows] - mean) / scale, earlier[rows]])

    models, p = [], np.zeros(len(fold))
    earlier = np.zeros((len(fold), 0))
    for k in range(labels.shape[1]):
        y = labels[:, k]
        p = np.zeros(len(fold))
        for f in range(FOLDS):
            out, rest = np.flatnonzero(fold == f), np.flatnonzero(fold != f)
            if len(out):
                p[out] = fit(features(f, rest), y[rest]).predict(features(f, out))
        models.append(fit(features(FOLDS, np.arange(len(fold))), y))
        earlier = np.hstack([earlier, p[:, None]])
    mean, scale = standard[FOLDS]
    return Chain(vocabulary[chosen[FOLDS]] if len(vocabulary) else vocabulary, mean, scale, tuple(models), threshold(p, labels[:, -1], fold))


def threshold(p: np.ndarray, y: np.ndarray, fold: np.ndarray) -> float:
    """The best by probabilities out of fold, drawn towards a half as the labels are few; UNDECIDED where those of a fold come from one kind of
    labels only."""
    if min(len(np.unique(fold[y == kind])) for kind in (0, 1)) < 2:
        return UNDECIDED
    rare = min((y == 1).sum(), (y == 0).sum())
    return float((rare * best_threshold(p, y) + DRAW * 0.5) / (rare + DRAW))


def learn(docs: DataFrame, labels: DataFrame, categories=CATEGORIES, limit: int = SAMPLE, size: int = VOCABULARY) -> Chain:
    known = F.lit(True)
    for _, column, _ in categories:
        known = known & F.col(f"`{column}`").isNotNull()
    names = [f"y{i}" for i in range(len(categories))]
    ys = [(F.col(f"`{column}`") == value).cast("int").alias(y) for y, (_, column, value) in zip(names, categories, strict=True)]
    sample = labels.where(known & F.col("doc_id").isNotNull()).select("doc_id", *ys).distinct().orderBy(F.xxhash64("doc_id"), "doc_id", *names).limit(limit)
    found = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id")
    texts = cut(found.groupBy("doc_id", *names).agg(F.min("text").alias("text")).withColumn("fold", F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int")), "labelled")

    def hashed(batch):
        doc, h = token_sets(batch)
        at = np.zeros(len(batch) + 1, np.int32)
        np.cumsum(np.bincount(doc, minlength=len(batch)), out=at[1:])
        return [pa.ListArray.from_arrays(pa.array(at), pa.array(h.view(np.int64)))]

    # documents with a word, and positive ones, in all folds but one each, and in all
    parts = [F.col("fold") != f for f in range(FOLDS)] + [F.lit(True)]
    sums = [F.sum(F.when(p, c).otherwise(0)).alias(f"{n}_{k}") for k, p in enumerate(parts) for n, c in (("n", F.lit(1)), *((y, F.col(y)) for y in names))]
    totals = texts.agg(*sums).first()
    seen = map_text(texts, [*names, "fold"], hashed, [("h", "array<bigint>", pa.list_(pa.int64()))])
    counts = seen.select(*names, "fold", F.explode("h").alias("h")).groupBy("h").agg(*sums)
    gains = []
    for k in range(len(parts)):
        n, df = totals[f"n_{k}"] or 0, F.col(f"n_{k}")
        for y in names:
            ones = totals[f"{y}_{k}"] or 0
            if ones not in (0, n):
                expected = df * F.lit(ones / n)
                gain = F.pow(F.col(f"{y}_{k}") - expected, 2) / (expected * F.lit(1 - ones / n)) * F.lit(n) / (F.lit(n) - df + 1)
                gains.append(F.struct(F.lit(k).alias("k"), F.lit(y).alias("y"), F.when(df >= LEAST_DOCS, gain).alias("g")))
    chosen: list[set[int]] = [set() for _ in parts]
    if gains:
        rank = F.row_number().over(Window.partitionBy("k", "y").orderBy(F.col("g").desc(), "h"))
        best = counts.select("h", F.explode(F.array(*gains)).alias("x")).select("h", "x.*").where("g is not null")
        for r in best.withColumn("rank", rank).where(F.col("rank") <= size // len(names)).select("k", "h").collect():
            chosen[r["k"]].add(r["h"])
    vocabulary = np.sort(np.array(sorted(set().union(*chosen)), np.int64).view(np.uint64))

    def rows(batch):
        x, d = presence(batch, vocabulary), dense(batch)
        return [pa.array([np.packbits(r.astype(bool)).tobytes() for r in x], pa.binary()), pa.array([r.astype(np.float32).tobytes() for r in d], pa.binary())]

    got = map_text(texts, ["doc_id", "fold", *names], rows, [("words", "binary", pa.binary()), ("dense", "binary", pa.binary())]).toArrow()
    discard(texts)
    got = got.sort_by([("doc_id", "ascending"), ("words", "ascending"), ("dense", "ascending")])
    width = len(dense(pa.array([""]))[0])
    m = got.num_rows
    words_x = np.unpackbits(np.frombuffer(b"".join(got["words"].to_pylist()), np.uint8).reshape(m, -1), axis=1)[:, : len(vocabulary)] if m and len(vocabulary) else np.zeros((m, len(vocabulary)), np.uint8)
    dense_x = np.frombuffer(b"".join(got["dense"].to_pylist()), np.float32).reshape(m, width).astype(float)
    y = np.array([got[c].to_numpy() for c in names], float).T.reshape(m, len(names))
    columns = [np.searchsorted(vocabulary, np.sort(np.array(sorted(c), np.int64).view(np.uint64))) for c in chosen]
    return train(vocabulary, words_x, dense_x, y, got["fold"].to_numpy(), columns)


def score(docs: DataFrame, chain: Chain, keep: list[str], categories=CATEGORIES) -> DataFrame:
    """The kept columns, a probability per category, and rejected (null where there is no threshold)."""
    names = [c[0] for c in categories]

    def fn(texts):
        p = chain.predict(chain.features(texts))
        return [*(pa.array(p[:, k]) for k in range(len(names))), pa.array(p[:, -1] > chain.threshold) if chain.threshold < UNDECIDED else pa.nulls(len(p), pa.bool_())]

    return map_text(docs, keep, fn, [*((f"p_{c}", "double", pa.float64()) for c in names), ("rejected", "boolean", pa.bool_())])


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the chain, learned from these documents' labels, does not reject."""
    chain = learn(docs, labels)
    if chain.threshold >= UNDECIDED:
        warnings.warn("both kinds of toxicity labels are needed in two folds at least: no document is rejected", stacklevel=2)
    hidden, back = hide(docs)
    return back(score(hidden, chain, hidden.columns).where(~F.coalesce("rejected", F.lit(False))))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document its probabilities and the decision."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, learn(docs, table(spark, sf_dir, "labels")), ["doc_id"])
