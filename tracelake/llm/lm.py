"""LM scoring by a log-bilinear model trained with noise-contrastive estimation.

Counts of all words of all training documents are a table. The most frequent `TOP` words (and the end token) are classes of their
own; all other words, known or not, fall into `TAILS` classes by a hash of their last three bytes. Two levels are learnt:

Classes: class trigrams of all training documents are counted, and on the whole table, every count weighing in every step, the
driver trains in numpy a log-bilinear model (context vector = sum of position matrices times embeddings; score = context . output +
bias) by noise-contrastive estimation, the noise in expectation instead of drawn; one batched matrix product then gives the
log-probabilities of every class in every context, normalised.

Words: each word of a tail class met at least `OWN` times has an output vector and bias of its own, so the parameters grow with the
training vocabulary. Its counts after each class (a distributed table of all training documents) against the expected noise
(its share of its class) make a noise-contrastive objective over the class model's newer-context vectors that no other word enters,
so tasks solve words apart. Within the class a word's probability is (c + 1) exp(x . theta) / Z, unseen words sharing one place of
weight 1; Z, by context class and word class, is summed over all words, so this level is normalised too.

Words beyond the `HOT` most frequent ones meet their counts and vectors in a shuffled join, so what is broadcast has a fixed size,
and no frequent word travels.

Defined results: null text is the empty text, one end token; a null doc_id hashes as the empty text; without training documents
N and V are 0 and classes are uniform; repeated rows are scored alike; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import remainder, stored, table

TOP = 64
TAILS = 32
CLASSES = TOP + TAILS
HOT = 300_000
DIM = 24
NOISE = 10
STEPS = 700
#: Words that a task holds before it passes their counts on, and tokens that it counts by class at once.
FLUSH_WORDS = 100_000
FLUSH_TOKENS = 500_000
FLUSH_ROWS = 30_000
#: A word seen less often has no vector of its own, only its count.
OWN = 5
RIDGE = 1.0
WORD_STEPS = 10
#: The end token; words are never empty.
END = b""


def tokens(text: bytes | None) -> list[bytes]:
    """A-Z lower-cased words between \\x20 and \\x09-\\x0D, then the end (bytes.lower and bytes.split do just that)."""
    words = (text or b"").lower().split()
    words.append(END)
    return words


def tail_class(word: bytes) -> int:
    return TOP + zlib.crc32(word[-3:]) % TAILS


def word_counts(training: DataFrame) -> DataFrame:
    """(word, c) over all rows of `training`; summed within tasks before the shuffle, in bounded memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], names=["word", "n"])
            held.clear()
            return b

        for batch in batches:
            for text in batch.column("text"):
                held.update(tokens(text.as_py()))
                if len(held) > FLUSH_WORDS:
                    yield out()
        yield out()

    rows = training.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "word binary, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("c"))


class Hot:
    """The most frequent words: number, count, class."""

    def __init__(self, rows: list[tuple[bytes, int]]):
        rows = sorted(rows, key=lambda r: (r[0] != END, -r[1], r[0]))
        self.number = {bytes(w): i for i, (w, _) in enumerate(rows)}
        self.count = np.array([c for _, c in rows] or [0], np.int64)
        self.cls = np.array([i if i < TOP else tail_class(bytes(w)) for i, (w, _) in enumerate(rows)] or [0], np.int64)

    def classes(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers (-1: not hot) and classes."""
        get = self.number.get
        ids = np.array([get(w, -1) for w in words], np.int64)
        cls = self.cls[ids]
        for i in np.flatnonzero(ids < 0).tolist():
            cls[i] = tail_class(words[i])
        return ids, cls


def contexts(cls: np.ndarray) -> np.ndarray:
    """The number of the two-class context before each token; CLASSES stands before the start."""
    before = np.concatenate([[CLASSES, CLASSES], cls])
    return before[:-2] * (CLASSES + 1) + before[1:-1]


def class_counts(training: DataFrame, hot) -> DataFrame:
    """Partial counts of both levels: (g, n) class trigrams, g = context * CLASSES + class, and (word, h, n) tail words after class h."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((CLASSES + 1) ** 2 * CLASSES, np.int64)
        table_ = hot.value
        by_number = list(table_.number)
        rare: Counter = Counter()
        keys: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            k, n = np.unique(np.concatenate([*keys, np.zeros(0, np.int64)]), return_counts=True)
            words = [by_number[i] for i in (k // (CLASSES + 1)).tolist()] + [w for w, _ in rare]
            h = np.concatenate([k % (CLASSES + 1), np.array([h for _, h in rare], np.int64)])
            n = np.concatenate([n, np.array(list(rare.values()), np.int64)])
            keys.clear()
            rare.clear()
            return pa.RecordBatch.from_arrays([pa.nulls(len(h), pa.int64()), pa.array(words, pa.binary()), pa.array(h), pa.array(n)], names=["g", "word", "h", "n"])

        seen: list[np.ndarray] = []
        size = 0

        def counted() -> None:
            g, n = np.unique(np.concatenate([*seen, np.zeros(0, np.int64)]), return_counts=True)
            total[g] += n
            seen.clear()

        for batch in batches:
            for text in batch.column("text"):
                words = tokens(text.as_py())
                ids, cls = table_.classes(words)
                ctx = contexts(cls)
                seen.append(ctx * CLASSES + cls)
                h = ctx % (CLASSES + 1)
                at = (ids >= 0) & (cls >= TOP)
                keys.append(ids[at] * (CLASSES + 1) + h[at])
                size += len(words)
                at = np.flatnonzero(ids < 0)
                rare.update(zip([words[i] for i in at.tolist()], h[at].tolist()))
                if len(rare) > FLUSH_WORDS or size > FLUSH_TOKENS:
                    counted()
                    yield out()
                    size = 0
        counted()
        yield out()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.nulls(len(at), pa.binary()), pa.nulls(len(at), pa.int64()), pa.array(total[at])], names=["g", "word", "h", "n"])

    return training.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "g long, word binary, h long, n long")


def fit(g: np.ndarray, n: np.ndarray, steps: int = STEPS, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """From class trigram counts: natural-log class probabilities [context, class], and the vectors of the newer context class.

    Each step takes the gradient over the whole table; a context's noise is its count times the noise distribution.
    """
    rng = np.random.default_rng(seed)
    size = CLASSES + 1
    emb = rng.normal(0, 0.1, (size, DIM))
    mats = np.stack([np.eye(DIM) * s for s in (0.5, 1.0)])  # the older and the newer context word
    unigram = np.bincount(g % CLASSES, n, CLASSES) + 1.0
    noise = unigram / unigram.sum()
    log_kn = np.log(NOISE * noise)
    params = {"e": emb, "m": mats, "q": rng.normal(0, 0.1, (CLASSES, DIM)), "b": np.log(noise)}
    params = {k: v.astype(np.float32) for k, v in params.items()}
    if len(g):
        seen, row = np.unique(g // CLASSES, return_inverse=True)
        data = np.bincount(row * CLASSES + g % CLASSES, n, len(seen) * CLASSES).reshape(-1, CLASSES) / n.sum()
        both = (data + NOISE * data.sum(1, keepdims=True) * noise).astype(np.float32)
        data = data.astype(np.float32)
        h1, h2 = np.eye(size, dtype=np.float32)[seen // size], np.eye(size, dtype=np.float32)[seen % size]
        log_kn = log_kn.astype(np.float32)
        state = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in params.items()}
        for step in range(1, steps + 1):
            v = (params["e"] @ params["m"][0])[seen // size] + (params["e"] @ params["m"][1])[seen % size]
            err = both / (1 + np.exp(-np.clip(v @ params["q"].T + (params["b"] - log_kn), -30, 30))) - data
            dv = err @ params["q"]
            d1, d2 = h1.T @ dv, h2.T @ dv
            grads = {"e": d1 @ params["m"][0].T + d2 @ params["m"][1].T, "m": np.stack([params["e"].T @ d1, params["e"].T @ d2]), "q": err.T @ v, "b": err.sum(0)}
            rate = 0.03 * min(1.0, 2 * (1 - step / (steps + 1)))
            for k, d in grads.items():
                a, s = state[k]
                a += 0.1 * (d - a)
                s += 0.001 * (d * d - s)
                params[k] -= rate * (a / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    params = {k: v.astype(float) for k, v in params.items()}
    old, new = params["e"] @ params["m"][0], params["e"] @ params["m"][1]
    v = (old[:, None, :] + new[None, :, :]).reshape(size * size, DIM)
    scores = v @ params["q"].T + params["b"]
    scores -= scores.max(1, keepdims=True)
    return scores - np.log(np.exp(scores).sum(1, keepdims=True)), new


def train(g: np.ndarray, n: np.ndarray, steps: int = STEPS, seed: int = 7) -> np.ndarray:
    """Natural-log class probabilities [context, class] of the trained model, from class trigram counts."""
    return fit(g, n, steps, seed)[0]


class Within:
    """What the word level shares: x, a row per context class with a last column of ones, and how often each class follows each."""

    def __init__(self, new: np.ndarray, g: np.ndarray, n: np.ndarray):
        size = CLASSES + 1
        self.x = np.concatenate([new, np.ones((size, 1))], 1)
        self.follows = np.bincount(g // CLASSES % size * CLASSES + g % CLASSES, n, size * CLASSES).reshape(size, CLASSES)
        share = self.follows / np.maximum(self.follows.sum(0), 1)
        # Curvature of a word's objective for each occurrence, at theta = 0 and noise counts as expected.
        self.axes = [np.linalg.eigh((self.x * share[:, [c]]).T @ self.x * NOISE / (1 + NOISE)) for c in range(CLASSES)]
        self.share = share

    def solve(self, counts: np.ndarray, cls: int) -> np.ndarray:
        """theta [word, DIM + 1] of words of one class from their counts [word, context class]; the best met, 0 at worst."""
        c = counts.sum(1, keepdims=True)
        noise = NOISE * c * self.share[:, cls]
        both = counts + noise
        values, axes = self.axes[cls]
        scale = 0.5 / (c * np.maximum(values, 0) + RIDGE)
        theta = best = np.zeros((len(counts), DIM + 1))
        best_loss = np.full(len(counts), np.inf)
        for step in range(WORD_STEPS + 1):
            delta = np.clip(theta @ self.x.T - np.log(NOISE), -30, 30)
            loss = (both * np.log1p(np.exp(delta)) - counts * delta).sum(1) + RIDGE / 2 * (theta * theta).sum(1)
            better = loss < best_loss
            best = np.where(better[:, None], theta, best)
            best_loss = np.where(better, loss, best_loss)
            if step < WORD_STEPS:
                down = (both / (1 + np.exp(-delta)) - counts) @ self.x + RIDGE * theta
                theta = theta - np.clip(down @ axes * scale, -2, 2) @ axes.T
        return best.astype(np.float32)


def word_vectors(parts: DataFrame, shared) -> DataFrame:
    """(word, c, theta) of all tail words, theta null under `OWN` occurrences; and rows without word, whose theta are sums for Z."""
    size = CLASSES + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        within = shared.value
        extra = np.zeros((size, CLASSES))
        for batch in batches:
            words, c = batch.column("word").to_pylist(), batch.column("c").to_numpy()
            theta: list[bytes | None] = [None] * len(words)
            pairs = batch.column("pairs")
            ends = pairs.offsets.to_numpy() - pairs.offsets[0].as_py()
            h, n = (a.to_numpy() for a in pairs.flatten().flatten())
            cls = np.array([tail_class(w) for w in words], np.int64)
            for t in np.unique(cls[c >= OWN]).tolist():
                at = np.flatnonzero((c >= OWN) & (cls == t))
                counts = np.zeros((len(at), size))
                for k, i in enumerate(at.tolist()):
                    counts[k, h[ends[i] : ends[i + 1]]] = n[ends[i] : ends[i + 1]]
                got = within.solve(counts, t)
                extra[:, t] += ((c[at] + 1.0) @ np.expm1(got @ within.x.T))
                for i, v in zip(at.tolist(), got):
                    theta[i] = v.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(c), pa.array(theta, pa.binary())], names=["word", "c", "theta"])
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.binary()), pa.array([0]), pa.array([extra.tobytes()], pa.binary())], names=["word", "c", "theta"])

    # Parts are summed within tasks already, so they are dealt by word once for both sums.
    d = parts.repartition("word").groupBy("word", "h").agg(F.sum("n").alias("n"))
    d = d.groupBy("word").agg(F.sum("n").alias("c"), F.collect_list(F.struct("h", "n")).alias("pairs"))
    return d.mapInArrow(run, "word binary, c long, theta binary")


def most_frequent(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """The end token and at most `most` words: all from the lowest count step that leaves no more than that. Steps are 1/16 of a power of two."""
    step = F.floor(F.log2("c") * 16)
    least, held = None, 0
    for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("n")).orderBy(F.desc("step")).collect():  # 1024 steps at most
        held += r.n
        if held > most:
            break
        least = r.step
    top = counts.filter((F.col("word") == F.lit(END)) | (F.lit(False) if least is None else step >= F.lit(least))).toArrow()
    return list(zip(top.column("word").to_pylist(), top.column("c").to_pylist()))


def score_documents(docs: DataFrame, training: DataFrame, hot_words: int = HOT) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row of `docs` (doc_id, held_out, text)."""
    sc = docs.sparkSession.sparkContext
    counts = stored(word_counts(training), "word-counts")
    n_all, v_all = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    hot_rows = most_frequent(counts, hot_words)
    hot = sc.broadcast(Hot(hot_rows))
    cls = (F.crc32(F.substring("word", -3, 3)) % TAILS).alias("t")
    mass = {r.t: (r.n, r.v) for r in counts.groupBy(cls).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()}
    within = np.zeros(CLASSES)
    first = [(bytes(w), c) for w, c in hot_rows if hot.value.number[bytes(w)] < TOP]
    for t in range(TAILS):
        n, v = mass.get(t, (0, 0))
        own = [c for w, c in first if tail_class(w) == TOP + t]
        within[TOP + t] = np.log10(n - sum(own) + v - len(own) + 1)
    parts = stored(class_counts(training, hot), "class-counts")
    grams = parts.filter("word IS NULL").groupBy("g").agg(F.sum("n").alias("n")).toArrow()
    g, n = grams.column("g").to_numpy(), grams.column("n").to_numpy()
    # In a task, where numpy has the threads of one executor; the table has a fixed size.
    table_ = sc.broadcast((g, n))
    log_p, new = sc.parallelize([0], 1).map(lambda _: fit(*table_.value)).first()
    log_p = (log_p / np.log(10)).astype(np.float32)
    shared = Within(new, g, n)
    vectors = stored(word_vectors(parts.filter("word IS NOT NULL").select("word", "h", "n"), sc.broadcast(shared)), "word-vectors")
    # log10 Z [context class, class]: the classes' counts without vectors, and what the vectors change.
    z = np.tile(10.0**within, (CLASSES + 1, 1))
    for (extra,) in vectors.filter("word IS NULL").select("theta").toLocalIterator():
        z += np.frombuffer(extra).reshape(z.shape)
    log_z = np.log10(z)
    # Vectors of hot words, one for each number; all others are joined.
    theta = np.zeros((max(len(hot_rows), 1), DIM + 1), np.float32)
    least = F.lit(min((c for _, c in hot_rows), default=0))
    for row in vectors.filter((F.col("c") >= least) & F.col("word").isNotNull() & F.col("theta").isNotNull()).select("word", "theta").toLocalIterator():
        if (i := hot.value.number.get(bytes(row.word), -1)) >= 0:
            theta[i] = np.frombuffer(row.theta, np.float32)
    x = shared.x.astype(np.float32) / np.float32(np.log(10))
    model = sc.broadcast((log_p, log_z, theta, x))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        log_p, log_z, theta, x = model.value
        table_ = hot.value
        log_c = np.log10(table_.count + 1.0)
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            head: list[tuple] = []
            rare: list[tuple] = []
            for doc, held, text in zip(batch.column("doc_id").to_pylist(), batch.column("held_out").to_pylist(), batch.column("text")):
                words = tokens(text.as_py())
                ids, cls = table_.classes(words)
                known = ids >= 0
                base = float(log_c[ids[known]].sum())
                ctx = contexts(cls)
                score = float(log_p[ctx, cls].sum(dtype=np.float64))
                h = ctx % (CLASSES + 1)
                at = known & (cls >= TOP)
                i = ids[at]
                score += float((log_c[i] - log_z[h[at], cls[at]] + np.einsum("ij,ij->i", theta[i], x[h[at]])).sum())
                head.append((row, doc, held, len(words), int(known.sum()), base, score))
                at = np.flatnonzero(~known)
                for (w, k), n in Counter(zip([words[i] for i in at.tolist()], h[at].tolist())).items():
                    rare.append((row, w, k, n))
                row += 1
                if len(rare) > FLUSH_ROWS:
                    yield _rows(head, rare)
                    head, rare = [], []
            yield _rows(head, rare)

    schema = "row long, doc_id long, held_out boolean, word binary, h long, n long, known long, base double, score double"
    scored = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", F.col("text").cast("binary").alias("text")).mapInArrow(run, schema), "scored")

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, log_z, _, x = model.value
        for batch in batches:
            row, h, t, n, c, theta = (batch.column(k) for k in ("row", "h", "t", "n", "c", "theta"))
            h, t, n, c = (k.to_numpy() for k in (h, t, n, c))
            log_c1 = np.log10(c + 1.0)
            own = np.flatnonzero(theta.is_valid().to_numpy(zero_copy_only=False))
            tilt = np.zeros(len(h))
            v = np.frombuffer(b"".join(theta.drop_null().to_pylist()), np.float32).reshape(-1, DIM + 1)
            tilt[own] = np.einsum("ij,ij->i", v, x[h[own]])
            score = n * (log_c1 + tilt - log_z[h, t])
            yield pa.RecordBatch.from_arrays([row, pa.array(np.where(c > 0, n, 0)), pa.array(n * log_c1), pa.array(score)], names=["row", "known", "base", "score"])

    t = (F.crc32(F.substring("word", -3, 3)) % TAILS + TOP).cast("long").alias("t")
    rare = scored.filter("word IS NOT NULL").select("row", "word", "h", "n").join(vectors.filter("word IS NOT NULL"), "word", "left")
    rare = rare.select("row", "h", t, "n", F.coalesce("c", F.lit(0)).cast("long").alias("c"), "theta").mapInArrow(inside, "row long, known long, base double, score double")
    rare = rare.select("row", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("boolean").alias("held_out"), F.lit(0).cast("long").alias("n"), "known", "base", "score")
    whole = scored.filter("word IS NULL").drop("word", "h").unionByName(rare)
    sums = whole.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.sum("n").alias("n_tokens"), F.sum("known").alias("n_known"), F.sum("base").alias("b"), F.sum("score").alias("score"))
    base = F.col("b") - F.col("n_tokens") * float(np.log10(n_all + v_all + 1))
    return sums.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n_all).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def _rows(head: list[tuple], rare: list[tuple]) -> pa.RecordBatch:
    """Document rows (word null), then their rare words."""
    h = list(zip(*head)) if head else [()] * 7
    r = list(zip(*rare)) if rare else [()] * 4
    k = len(r[0])
    none = [None] * k
    cols = [
        (pa.int64(), [*h[0], *r[0]]), (pa.int64(), [*h[1], *none]), (pa.bool_(), [*h[2], *none]), (pa.binary(), [*[None] * len(h[0]), *r[1]]), (pa.int64(), [*[None] * len(h[0]), *r[2]]),
        (pa.int64(), [*h[3], *r[3]]), (pa.int64(), [*h[4], *none]), (pa.float64(), [*h[5], *none]), (pa.float64(), [*h[6], *none]),
    ]
    return pa.RecordBatch.from_arrays([pa.array(v, t) for t, v in cols], names=["row", "doc_id", "held_out", "word", "h", "n", "known", "base", "score"])


def op5_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", remainder(F.col("doc_id"), 7) == 2)
    return score_documents(docs, docs.filter(~F.col("held_out")))
