"""Byte-level BPE encoding and decoding by merge replay.

The text is split by the tokenizer's pattern; the distinct pieces of each slice of the corpus that the process has not met form one
word table, held as one run of tokens. An index from mergeable pair (named by the rank of what it makes) to positions in that table
lets merges be applied in rank order to all words at once: a wave takes each word's lowest pair at all its places, leftmost first,
and looks up new pairs for the touched neighbours only. Words already replayed stay in a bounded memo of the worker process, which
outlives a task.

Defined results: null text is the empty text (no ids); special tokens are ordinary text; every string round-trips exactly; very
long pieces (no white space or punctuation for pages) go through the same index by a heap of ranks, one pair at a time; repeated
rows give equal ids; other columns pass.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, widened

#: Words whose ids a worker process keeps between slices; beyond them the older half goes.
MEMO_WORDS = 400_000
#: Characters of text whose words are replayed together.
SLICE_CHARS = 4_000_000
#: Longer pieces are replayed one pair at a time.
LONG_PIECE = 512
_NONE = np.iinfo(np.int64).max


def load_ranks(path: str) -> list[bytes]:
    """Tokens by rank from a file of base64 token and rank per line."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    tokens: list[bytes] = [b""] * (max(int(r) for _, r in pairs) + 1)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


class MergeReplay:
    """All pairs of tokens that make a token, and their replay over word tables."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.ranks = {t: i for i, t in enumerate(tokens) if t}
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        get = self.ranks.get
        self.pairs = {(a, b): r for r, t in enumerate(tokens) for k in range(1, len(t)) if (a := get(t[:k])) is not None and (b := get(t[k:])) is not None}
        keys = np.array([a << 32 | b for a, b in self.pairs] or [0], np.int64)
        order = np.argsort(keys)
        self.keys, self.made = keys[order], np.array(list(self.pairs.values()) or [_NONE], np.int64)[order]
        self.bytes_made = self._made(np.repeat(self.single, 256), np.tile(self.single, 256))

    def _made(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of what each pair makes, _NONE where it makes nothing; -1 stands beyond a word's end."""
        key = (a << 32) | b
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.made[at], _NONE)

    def encode(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word as little-endian 32-bit integers: a word that is a token is that token; others by all merges in rank order."""
        out = [b""] * len(words)
        short: list[int] = []
        long: list[int] = []
        for w, word in enumerate(words):
            if (whole := self.ranks.get(word)) is not None:
                out[w] = whole.to_bytes(4, "little")
            elif word:
                (short if len(word) <= LONG_PIECE else long).append(w)
        if short:
            ids, ends, odd = self._waves([words[w] for w in short])
            begin = 0
            for w, end in zip(short, ends):
                out[w] = ids[begin:end]
                begin = end
            long += [short[i] for i in odd]
        for w, ids in zip(long, self._in_turn([words[w] for w in long])):
            out[w] = np.array(ids, "<u4").tobytes()
        return out

    def _waves(self, words: list[bytes]) -> tuple[bytes, list[int], list[int]]:
        """All words' ids in one run, where each word's end, and the numbers of the words that have to go one pair at a time.

        Those are words where, of several equal pairs merged in one wave, one brings up a lower pair before the next one's turn.
        """
        data = np.frombuffer(b"".join(words), np.uint8)
        sizes = np.array([len(w) for w in words])
        ends, n = np.cumsum(sizes), len(data)
        owner = np.repeat(np.arange(len(words)), sizes)
        # Position n stands for "none" on either side.
        tok = np.append(self.single[data], -1)
        nxt, prv = np.arange(1, n + 2), np.arange(-1, n)
        nxt[ends - 1] = n
        prv[ends - sizes] = n
        made = np.full(n + 1, _NONE)
        made[: n - 1] = self.bytes_made[data[:-1].astype(np.int64) * 256 + data[1:]]
        made[ends - 1] = _NONE
        live = np.ones(n, bool)
        odd: set[int] = set()
        index = np.flatnonzero(made < _NONE)
        while len(index):
            own, rank = owner[index], made[index]
            begin = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            low = np.repeat(np.minimum.reduceat(rank, begin), np.diff(np.append(begin, len(own))))
            at = index[rank == low]
            chained = np.append(False, nxt[at[:-1]] == at[1:])
            if chained.any():  # overlapping equal pairs: every other one, from the left
                i = np.arange(len(at))
                at = at[(i - np.maximum.accumulate(np.where(chained, 0, i))) % 2 == 0]
            rank, gone = made[at], nxt[at]
            after = nxt[gone]
            old = tok[after]
            tok[at] = rank
            live[gone] = False
            nxt[at] = after
            prv[after] = at
            before = prv[at]
            fresh = made[before] == _NONE
            made[gone] = _NONE
            right, left = self._made(rank, tok[after]), self._made(tok[before], rank)
            made[at] = right
            made[before] = left
            made[n] = _NONE
            own = owner[at]
            several = np.append(own[1:] == own[:-1], False) | np.append(False, own[1:] == own[:-1])
            if several.any():
                lower = several & ((right < rank) | (left < rank) | (self._made(rank, old) < rank))
                for w in np.unique(own[lower]).tolist():
                    odd.add(w)
                    made[ends[w] - sizes[w] : ends[w]] = _NONE
            more = before[fresh & (made[before] < _NONE)]
            index = index[made[index] < _NONE]
            if len(more):
                index = np.sort(np.concatenate([index, more]), kind="stable")
        counts = np.bincount(owner[live], minlength=len(words))
        return tok[:n][live].astype("<u4").tobytes(), (np.cumsum(counts) * 4).tolist(), sorted(odd)

    def _in_turn(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word by all merges in rank order, leftmost first, one pair at a time."""
        tok: list[int] = []
        owner: list[int] = []
        starts: list[int] = []
        single = self.single.tolist()
        for w, word in enumerate(words):
            starts.append(len(tok))
            tok += [single[b] for b in word]
            owner += [w] * len(word)
        n = len(tok)
        nxt = [i + 1 if i + 1 < n and owner[i + 1] == owner[i] else -1 for i in range(n)]
        prv = [i - 1 if i and owner[i - 1] == owner[i] else -1 for i in range(n)]
        made = [-1] * n  # rank of the pair that starts here
        index: dict[int, list[int]] = {}
        def rank(a: int, b: int) -> int:
            return self.pairs.get((a, b), -1)

        for i in range(n):
            if nxt[i] >= 0 and (r := rank(tok[i], tok[i + 1])) >= 0:
                made[i] = r
                index.setdefault(r, []).append(i)
        heap = list(index)
        heapq.heapify(heap)
        while heap:
            r = heapq.heappop(heap)
            late: list[int] = []
            ahead: set[int] = set()  # words in which a lower rank has come up: it goes first
            for p in sorted(index.pop(r, ())):
                if made[p] != r:
                    continue
                if owner[p] in ahead:
                    late.append(p)
                    continue
                q = nxt[p]
                tok[p], made[q] = r, -1
                after, before = nxt[q], prv[p]
                nxt[p] = after
                made[p] = -1
                if after >= 0:
                    prv[after] = p
                    if (m := rank(r, tok[after])) >= 0:
                        made[p] = m
                        if m not in index:
                            index[m] = []
                            heapq.heappush(heap, m)
                        index[m].append(p)
                        if m < r:
                            ahead.add(owner[p])
                if before >= 0:
                    made[before] = m = rank(tok[before], r)
                    if m >= 0:
                        if m not in index:
                            index[m] = []
                            heapq.heappush(heap, m)
                        index[m].append(before)
                        if m < r:
                            ahead.add(owner[p])
            if late:
                if r not in index:
                    heapq.heappush(heap, r)
                index.setdefault(r, []).extend(late)
        out = []
        for i in starts:
            ids = []
            while i >= 0:
                ids.append(tok[i])
                i = nxt[i]
            out.append(ids)
        return out


def decode(ids: list[int], tokens: list[bytes]) -> bytes:
    return b"".join([tokens[i] for i in ids])


class Encoder:
    """Whole texts to ids as little-endian unsigned 32-bit integers, with the memo of a worker process."""

    def __init__(self, tokens: list[bytes], pattern: str):
        import regex

        self.replay, self.split = MergeReplay(tokens), regex.compile(pattern).findall
        self.memo: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        pieces = [self.split(t) for t in texts]
        memo = self.memo
        if len(memo) > MEMO_WORDS:
            for word in list(islice(memo, len(memo) // 2)):
                del memo[word]
        new = list(set().union(*pieces).difference(memo))
        memo.update(zip(new, self.replay.encode([w.encode("utf-8") for w in new])))
        get = memo.__getitem__
        return [b"".join(map(get, p)) for p in pieces]


_ENCODERS: dict[tuple, Encoder] = {}


def encoder_of(key: tuple, tokens: list[bytes], pattern: str) -> Encoder:
    """The worker process's encoder for a vocabulary: one at a time, kept from task to task."""
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(tokens, pattern)
    return _ENCODERS[key]


def slices(texts: list[str | None], most: int = SLICE_CHARS) -> Iterator[list[str]]:
    """Consecutive texts (null: empty) of about `most` characters together; a longer text is a slice of its own."""
    held: list[str] = []
    size = 0
    for t in texts:
        t = t or ""
        if held and size + len(t) > most:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t)
    if held:
        yield held


def broadcast_ranks(spark: SparkSession, ranks_path: str, pattern: str):
    """The broadcast vocabulary and the key that tells it from any other."""
    tokens = load_ranks(ranks_path)
    digest = hashlib.sha256(b"".join(len(t).to_bytes(4, "little") + t for t in tokens)).hexdigest()
    return spark.sparkContext.broadcast(tokens), (digest, pattern)


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """`docs` with token_ids (binary, little-endian unsigned 32-bit) and decoded (binary): what decoding the ids gives.

    The rank file is read by the driver and broadcast: its size is fixed and does not grow with the data.
    """
    tokens, key = broadcast_ranks(docs.sparkSession, ranks_path, pattern)
    docs = docs.drop("token_ids", "decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(key, tokens.value, pattern)
        for batch in batches:
            at = 0
            for part in slices(batch.column("text").to_pylist()):
                ids = encoder.encode(part)
                back = [decode(np.frombuffer(x, "<u4").tolist(), tokens.value) for x in ids]
                own = batch.slice(at, len(part))
                at += len(part)
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(ids, pa.binary()), pa.array(back, pa.binary())], names=[*own.schema.names, "token_ids", "decoded"])

    return docs.mapInArrow(run, widened(docs.schema, "token_ids binary, decoded binary"))


def token_digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Per document the contract's digests; ids and decoded bytes are digested where they arise, so neither is moved."""
    tokens, key = broadcast_ranks(docs.sparkSession, ranks_path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(key, tokens.value, pattern)
        for batch in batches:
            n, sha, back = [], [], []
            for part in slices(batch.column("text").to_pylist()):
                for ids in encoder.encode(part):
                    n.append(len(ids) // 4)
                    sha.append(hashlib.sha256(ids).hexdigest())
                    back.append(hashlib.sha256(decode(np.frombuffer(ids, "<u4").tolist(), tokens.value)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(sha), pa.array(back)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def public_vocabulary() -> tuple[str, str]:
    """Path of the rank file and the pattern that the contract names."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(table(spark, sf_dir, "documents"), *public_vocabulary())
