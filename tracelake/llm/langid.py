"""Language identification by segmentation-marginalised unigrams.

A language is a distribution over the pieces of a fixed public vocabulary. A word's probability sums over all ways to cut it into
pieces, by a forward pass over its bytes; a text's is the product over its words (runs of letters, lower-cased, at most 24 letters
each; a longer run counts as several). Every piece of the vocabulary counts, however long. Piece probabilities come from expectation
maximisation over all words of a bounded sample of labelled distinct texts, smoothed towards the mean of the languages. The sample holds
the `docs_per_lang` texts of lowest hash of every language, fewer where languages are so many that it would pass `SAMPLE_TEXTS`, but at
least one: every label is learnt. The model is pieces times languages, 0.4 MB a language. Prediction uses the text alone, all of it.

Defined results: null text or text without a letter is `und` with score 0; with no labelled rows every text is `und`;
a tie goes to the first language by name; repeated rows are predicted alike; other columns pass.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import load_ranks, public_vocabulary, slices
from .common import remainder, table, widened

DOCS_PER_LANG = 120
SAMPLE_TEXTS = 24_000
RUN = 24
ROUNDS = 3
#: Probabilities are carried times 2^8 for each byte, so that long words stay in range.
_BYTE = 2.0**8
#: A task keeps the scores of so many words, or of fewer where that would pass so many numbers in all.
MEMO_WORDS = 300_000
MEMO_NUMBERS = 8_000_000
#: Words that meet in one forward pass.
BATCH = 4096
_LETTERS = re.compile(rf"[^\W\d_]{{1,{RUN}}}")


def letter_runs(text: str) -> list[str]:
    return _LETTERS.findall(text.lower())


class Pieces:
    """The vocabulary's pieces by bytes; every single byte is one, so every word has a segmentation."""

    def __init__(self, tokens: list[bytes]):
        held = {t for t in tokens if t and not t.isspace()} | {bytes([b]) for b in range(256)}
        self.index = {t: i for i, t in enumerate(sorted(held))}
        self.sizes = np.array([len(t) for t in sorted(held)])
        self.widest = int(self.sizes.max())

    def spans(self, words: list[bytes]) -> np.ndarray:
        """For words of one length n: piece numbers [word, end, size], or the number of pieces (probability 0) where there is none."""
        n, get, none = len(words[0]), self.index.get, len(self.index)
        widest = min(n, self.widest)
        ids = [get(w[e - s : e], none) for w in words for e in range(1, n + 1) for s in range(1, min(e, widest) + 1)]
        out = np.full((len(words), n + 1, widest + 1), none, np.int32)
        ends = [e for e in range(1, n + 1) for _ in range(min(e, widest))]
        lens = [s for e in range(1, n + 1) for s in range(1, min(e, widest) + 1)]
        out[:, ends, lens] = np.array(ids, np.int32).reshape(len(words), -1)
        return out


def _by_length(words: list[bytes]) -> Iterator[tuple[int, list[int]]]:
    """Places of words of one length, at most BATCH at a time."""
    by: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        by.setdefault(len(w), []).append(i)
    for n, at in by.items():
        for i in range(0, len(at), BATCH):
            yield n, at[i : i + BATCH]


def forward(spans: np.ndarray, prob: np.ndarray) -> np.ndarray:
    """Scaled forward sums [word, position, language]; prob has a last row of zeros."""
    m, n, widest = spans.shape[0], spans.shape[1] - 1, spans.shape[2] - 1
    alpha = np.zeros((m, n + 1, prob.shape[1]))
    alpha[:, 0] = 1.0
    for e in range(1, n + 1):
        for s in range(1, min(e, widest) + 1):
            alpha[:, e] += alpha[:, e - s] * prob[spans[:, e, s]]
    return alpha


def train(texts: dict[str, list[str]], pieces: Pieces, rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """Languages by name and scaled piece probabilities [piece + 1, language]."""
    langs = sorted(texts)
    none = len(pieces.index)
    prob = np.ones((none + 1, len(langs)))
    scale = _BYTE ** pieces.sizes
    prob[:none] *= (scale / none)[:, None]
    prob[none] = 0
    for _ in range(rounds):
        counts = np.zeros((none + 1, len(langs)))
        for k, lang in enumerate(langs):
            own = [(w.encode("utf-8", "surrogatepass"), c) for w, c in Counter(w for t in texts[lang] for w in letter_runs(t)).items()]
            for n, at in _by_length([w for w, _ in own]):
                spans = pieces.spans([own[i][0] for i in at])
                weight = np.array([own[i][1] for i in at], float)
                p = prob[:, k : k + 1]
                a = forward(spans, p)[:, :, 0]
                b = np.zeros_like(a)
                b[:, n] = 1.0
                for e in range(n, 0, -1):
                    for s in range(1, min(e + 1, spans.shape[2])):
                        b[:, e - s] += b[:, e] * p[spans[:, e, s], 0]
                for e in range(1, n + 1):
                    for s in range(1, min(e + 1, spans.shape[2])):
                        share = weight * a[:, e - s] * p[spans[:, e, s], 0] * b[:, e] / np.maximum(a[:, n], 1e-300)
                        np.add.at(counts[:, k], spans[:, e, s], share)
        counts = counts[:none]
        mean = counts.sum(1, keepdims=True) + 0.01
        mean /= mean.sum()
        prior = 0.02 * counts.sum(0, keepdims=True) + 10.0
        p = (counts + prior * mean) / (counts.sum(0, keepdims=True) + prior)
        prob[:none] = p * scale[:, None]
    return langs, prob


class Scorer:
    """Log probabilities of texts by language, with a bounded memo of words."""

    def __init__(self, pieces: Pieces, prob: np.ndarray):
        self.pieces, self.prob = pieces, prob
        self.memo: dict[str, int] = {}
        self.rows = np.zeros((0, prob.shape[1]))
        self.most = min(MEMO_WORDS, MEMO_NUMBERS // prob.shape[1])

    def _learn(self, words: list[str]) -> None:
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        got = np.zeros((len(words), self.prob.shape[1]))
        for n, at in _by_length(raw):
            total = forward(self.pieces.spans([raw[j] for j in at]), self.prob)[:, n]
            got[at] = np.log(np.maximum(total, 1e-300)) - n * np.log(_BYTE)
        for w in words:
            self.memo[w] = len(self.memo)
        self.rows = np.concatenate([self.rows, got])

    def score(self, texts: list[str]) -> list[np.ndarray | None]:
        """A vector by language for each text, None for one without a letter."""
        runs = [letter_runs(t) for t in texts]
        if len(self.memo) > self.most:
            self.memo, self.rows = {}, self.rows[:0]
        new = list(set().union(*runs).difference(self.memo))
        if new:
            self._learn(new)
        get = self.memo.__getitem__
        return [self.rows[list(map(get, r))].sum(0) if r else None for r in runs]


def labelled_sample(docs: DataFrame, docs_per_lang: int = DOCS_PER_LANG, sample_texts: int = SAMPLE_TEXTS) -> dict[str, list[str]]:
    """For each language its distinct texts of lowest hash: `docs_per_lang`, or its share of `sample_texts` if that is less, at least one.

    Copies count once, so no language is left out for having few texts. The window's group limit keeps that many hashes of a language
    in each task before any of them meet.
    """
    labelled = docs.filter("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text", F.xxhash64("text").alias("h"))
    hashes = labelled.select("lang", "h").distinct()
    most = max(1, min(docs_per_lang, sample_texts // max(1, labelled.agg(F.countDistinct("lang")).head()[0])))
    lowest = hashes.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).filter(F.col("r") <= most).drop("r")
    out: dict[str, list[str]] = {}
    for r in labelled.join(F.broadcast(lowest), ["lang", "h"]).dropDuplicates(["lang", "h"]).orderBy("lang", "h").collect():
        out.setdefault(r["lang"], []).append(r["text"])
    return out


def predict(docs: DataFrame, sample: dict[str, list[str]], vocabulary: str) -> DataFrame:
    """`docs` with lang_pred and score (posterior of the predicted language, languages being equally likely beforehand)."""
    docs = docs.drop("lang_pred", "score")
    if not sample:
        return docs.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0)})
    pieces = Pieces(load_ranks(vocabulary))
    langs, prob = train(sample, pieces)
    # Pieces times languages: grows with the label names, not with the documents.
    model = docs.sparkSession.sparkContext.broadcast((pieces, langs, prob))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, langs, prob = model.value
        scorer = Scorer(pieces, prob)
        for batch in batches:
            names, scores = [], []
            for part in slices(batch.column("text").to_pylist()):
                for v in scorer.score(part):
                    if v is None:
                        names.append("und")
                        scores.append(0.0)
                    else:
                        best = int(v.argmax())
                        names.append(langs[best])
                        scores.append(float(1.0 / np.exp(np.maximum(v - v[best], -700)).sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, widened(docs.schema, "lang_pred string, score double"))


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", remainder(F.col("doc_id"), 4) == 2)
    sample = labelled_sample(docs.filter(~F.col("held_out")))
    out = predict(docs.select("doc_id", "held_out", "text"), sample, public_vocabulary()[0])
    return out.select("doc_id", "held_out", "lang_pred", "score")
