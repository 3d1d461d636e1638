"""Token counts under a unigram vocabulary, by dynamic programming that shares prefixes.

A pre-token is a run of characters other than space, \\t \\n \\v \\f \\r, with the word mark before it. Its tokens are the pieces of the
segmentation with the highest sum of scores (of equal sums the one with the fewest pieces); a character that no
piece covers counts as its UTF-8 bytes, each at a score below all pieces. The count of a text is the sum over its pre-tokens.

The best score and count at a position depend on the prefix up to it alone. The distinct new pre-tokens of a slice of
texts are therefore walked as a trie, in sorted order: what the next one shares with the one before is kept, only
the rest is computed, and the count at its end is stored. Stored counts are reused by later slices in the same worker; the
store holds KEEP pre-tokens and is emptied when full, and pre-tokens of over LONG bytes are not stored.

The vocabulary is a file whose path is a parameter; its pieces are read by the driver and sent to the workers (MAX_PIECES at most).
Scores follow the pieces' order: -log(rank + 2). Nulls: a null text has no tokens; repeated rows are repeated, an empty
table gives no rows, other columns are not read.
"""

import math
import os

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from veldt.llm.common import table
from veldt.llm.textops import map_text, raw

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
KEEP = 800_000
LONG = 200
MAX_PIECES = 2_000_000


def load(path: str) -> dict[str, float]:
    """Scores of the pieces of a sentencepiece model file, without control, unknown and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    usual = [model.id_to_piece(i) for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    if len(usual) > MAX_PIECES:
        raise ValueError(f"more than {MAX_PIECES} pieces")
    return {p: -math.log(r + 2) for r, p in enumerate(usual)}


class Counter:
    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.tails = {p[i:] for p in scores for i in range(len(p))}
        self.byte = min(scores.values(), default=0.0) - 10
        self.known: dict[bytes, int] = {}

    def walk(self, words: list[str]) -> list[int]:
        """Counts of sorted words; a position's score is computed once for all words that share the prefix."""
        scores, tails, byte = self.scores, self.tails, self.byte
        best, count = [0.0], [0]
        out, last = [], ""
        for word in words:
            shared = len(os.path.commonprefix((last, word)))
            del best[shared + 1 :], count[shared + 1 :]
            for j in range(shared + 1, len(word) + 1):
                n = len(word[j - 1].encode())
                top, least = best[j - 1] + n * byte, count[j - 1] + n
                i = j - 1
                while i >= 0 and (piece := word[i:j]) in tails:
                    if (s := scores.get(piece)) is not None:
                        s += best[i]
                        c = count[i] + 1
                        if s > top or s == top and c < least:
                            top, least = s, c
                    i -= 1
                best.append(top)
                count.append(least)
            out.append(count[-1])
            last = word
        return out

    def count(self, texts: pa.Array) -> tuple[list[int], list[int]]:
        """Pre-tokens and tokens of each text."""
        buf, at = raw(texts)
        data = buf.tobytes()
        split = [data[a:b].split() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        if len(self.known) > KEEP:
            self.known.clear()
        new = set().union(*split).difference(self.known)
        extra = {}
        order = sorted((MARK + w.decode(), w) for w in new)
        for (_, w), n in zip(order, self.walk([x for x, _ in order]), strict=True):
            (self.known if len(w) <= LONG else extra)[w] = n
        if extra:
            return [len(ws) for ws in split], [sum(extra[w] if w in extra else self.known[w] for w in ws) for ws in split]
        get = self.known.__getitem__
        return [len(ws) for ws in split], [sum(map(get, ws)) for ws in split]


_counter: list = [None, None]


def _worker_counter(path: str, shared) -> Counter:
    """The counter of this worker, kept from task to task."""
    if _counter[0] != path:
        _counter[:] = [path, Counter(shared.value)]
    return _counter[1]


def count_tokens(docs: DataFrame, keep: list[str], path: str = VOCABULARY) -> DataFrame:
    """The kept columns, n_words and n_tokens."""
    shared = docs.sparkSession.sparkContext.broadcast(load(path))

    def fn(texts):
        words, tokens = _worker_counter(path, shared).count(texts)
        return [pa.array(words, pa.int64()), pa.array(tokens, pa.int64())]

    return map_text(docs, keep, fn, [("n_words", "bigint", pa.int64()), ("n_tokens", "bigint", pa.int64())])


def op7_token_counts(spark: SparkSession, sf_dir: str, path: str = VOCABULARY) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), ["doc_id"], path)
