"""Sharding, prefix trie and periodic runs against brute force: nulls, empties, long texts, ties, repeats, clashing names, empty tables."""

import collections
import random
import re
import zlib
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from tests.llm.test_llm import TEXTS, sha
from tests.oracle import compare, duck
from tracelake.llm import queries, runs, shards, sql, trie

SCHEMA = "doc_id long, text string, size string, _whole int, runs int"


def write(spark, path, docs):
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    return str(path)


# Shards


def held(rows, count, limit):
    """Every record is there once, slots are gapless from 0, and sizes are near equal."""
    by = collections.defaultdict(list)
    for r in rows:
        assert r.size == len((r.text or "").encode()) + 8 and r.text_crc32 == zlib.crc32((r.text or "").encode())
        by[r.shard].append(r)
    assert len(rows) == count and set(by) <= set(range(24))
    for v in by.values():
        assert sorted(r.slot for r in v) == list(range(len(v)))
    sizes = [sum(r.size for r in by[s]) for s in range(24)]
    assert max(sizes) <= limit * sum(sizes) / 24, sizes
    return by


def test_shards_on_hot_copies_and_large_records(spark):
    rng = random.Random(3)
    own = [" ".join(rng.choice("abcdefgh") * 3 for _ in range(rng.randrange(1, 60))) for _ in range(4000)]
    texts = own + own[:300] + ["a copy of one text " * 4] * 2500 + ["x" * 9000, None, None, "", "é" * 3000]
    docs = spark.createDataFrame([(i, t, "own", 1, 2) for i, t in enumerate(texts)], SCHEMA)
    for how in ({}, {"rows_a_range": 40}):
        out = shards.sharded(docs, **how)
        assert out.columns == ["doc_id", "text", "_whole", "runs", "size", "text_crc32", "shard", "slot"]
        by = held(out.collect(), len(texts), 1.04)
        assert {r.doc_id for v in by.values() for r in v} == set(range(len(texts)))
        where = collections.defaultdict(set)
        for s, v in by.items():
            for r in v:
                where[r.text].add(s)
        assert all(len(where[t]) == 1 for t in own) and len(where["a copy of one text " * 4]) > 1


def test_shards_on_repeated_rows_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "same")] * 50 + [(None, None)] * 5 + [(None, "same")] * 5, "doc_id long, text string")
    by = held(shards.sharded(docs).collect(), 60, 24)
    assert sum(len(v) for v in by.values()) == 60
    assert shards.sharded(docs.limit(0)).collect() == []
    assert len(shards.sharded(docs.limit(1)).collect()) == 1


def test_shard_parts():
    assert shards.emptiest([5, 4, 3, 3], 2) == [0, 1, 1, 0]
    assert shards.rooms(6, [0, 0, 9]) == [3, 3, 0] and shards.rooms(7, [1, 0, 1]) == [2, 3, 2]
    assert shards.splitters([(k, 1) for k in range(100)], 4) == [24, 49, 74] and shards.splitters([], 4) == []
    assert shards.range_count(10) == 192 and shards.range_count(10**13) == shards.MAX_RANGES


def test_op11_against_its_law(spark, tmp_path):
    """Shard and slot recomputed by a plain loop over the records in order of Spark's hashes, the only thing taken over."""
    rng = random.Random(8)
    texts = [None, ""] + [" ".join(rng.choice(["ab", "cde", "f"]) for _ in range(rng.randrange(40))) for _ in range(1500)] + ["z" * 4000] * 2
    sf = write(spark, tmp_path, list(enumerate(texts)))
    rows = queries.queries()["op11_shards"](spark, sf).collect()
    size = {i: len((t or "").encode()) + 8 for i, t in enumerate(texts)}
    hashes = spark.read.parquet(f"{sf}/documents.parquet").withColumn("text", F.coalesce("text", F.lit(""))).withColumn("h1", F.xxhash64("text"))
    keys = {r.doc_id: (r.h1, r.h2) for r in hashes.select("doc_id", "h1", F.xxhash64(F.lit(1), "doc_id", "h1").alias("h2")).collect()}
    total = sum(size.values())
    big = max(1, total // (24 * 64))
    large = sorted((i for i in size if size[i] > big), key=lambda i: (-size[i], keys[i]))
    load, shard = [0] * 24, {}
    for i in large:
        shard[i] = min(range(24), key=lambda s: (load[s], s))
        load[shard[i]] += size[i]
    ends, at, first = np.cumsum(shards.rooms(total - sum(load), load)), 0, {}
    for i in sorted((i for i in size if size[i] <= big), key=keys.get):
        f = first.setdefault(keys[i][0], at)
        shard[i] = min(23, int(np.searchsorted(np.round(ends[:-1]), f + (at - f) // big * big, "right")))
        at += size[i]
    order = sorted(size, key=lambda i: (size[i] <= big, *((-size[i],) if size[i] > big else ()), keys[i]))
    got = {r.doc_id: r for r in rows}
    assert {i: r.shard for i, r in got.items()} == shard
    for s in range(24):
        mine = [i for i in order if shard[i] == s]
        small = [i for i in mine if size[i] <= big]
        assert [got[i].slot for i in small] == list(range(len(mine) - len(small), len(mine)))
        assert sorted(got[i].slot for i in mine) == list(range(len(mine)))
    assert all(r.law == "bytes" and r.grown_shard is None and r.size == size[r.doc_id] for r in rows)


# Trie


def conversations(spark, rows, path=None):
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, depth string")
    if path:
        df.write.parquet(f"{path}/conversations.parquet")
    return df


def brute_trie(convs):
    """convs: {conv_id: [(role, text)]}."""
    nodes = collections.defaultdict(list)
    for c, t in convs.items():
        for d in range(len(t) + 1):
            nodes[tuple(t[:d])].append(c)
    out = set()
    for p, members in nodes.items():
        below = [q for q in nodes if q[: len(p)] == p]
        leaf = lambda q: not any(len(x) == len(q) + 1 and x[:-1] == q for x in nodes)
        saved = sum((len(nodes[q]) - 1) * len(q[-1][1].encode()) for q in below if q)
        ends = ",".join(map(str, sorted(c for c in members if len(convs[c]) == len(p))))
        up = min(nodes[p[:-1]]) if p else None
        out.add((min(members), len(p), up, len(members), sum(len(q) == len(p) + 1 for q in below), sum(leaf(q) for q in below), saved, sha(ends)))
    return out


def turns_of(rows):
    convs = collections.defaultdict(list)
    for c, t, role, text, _ in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        convs[c].append((role or "", text or ""))
    return convs


def rebuilt_of(convs):
    out = {}
    for c, t in convs.items():
        h = zlib.crc32(b"%d" % c) % 9
        out[c] = convs.get(c - c % 5, [])[:h] + t[h:]
    return out


def small_conversations():
    rng = random.Random(2)
    rows = [(c, k, rng.choice(["user", None]), rng.choice(["a", "b", None, "é"]), "x") for c in range(60) for k in range(rng.randrange(1, 12))]
    rows += [(7000 + c, k, "user", f"common {k}", "x") for c in range(40) for k in range(1 + c % 9)]  # growing copies of one conversation
    rows += [(9999, None, "system", "first", "x"), (None, 1, "user", "of no conversation", "x"), (90001, 5, None, None, "x")]
    return rows


def test_trie_as_it_is_with_small_blocks(spark):
    rows = small_conversations() + [(50000, k, "user", f"t{k % 7}", "x") for k in range(300)] + [(50001, k, "user", f"t{k % 7}", "x") for k in range(250)]
    turns, sizes = trie.numbered(conversations(spark, rows))
    got = trie.trie(turns, sizes, block=16)
    assert {tuple(r) for r in got.collect()} == brute_trie(turns_of(rows))


def test_op12_against_brute_force_and_sql(spark, tmp_path):
    rows = small_conversations()
    conversations(spark, rows, tmp_path)
    got = queries.queries()["op12_trie"](spark, str(tmp_path))
    assert {tuple(r) for r in got.collect()} == brute_trie(rebuilt_of(turns_of(rows)))
    compare(spark, str(tmp_path), lambda *_: got, sql.PREFIX_TRIE, duck_of(tmp_path))


def duck_of(path):
    con = duck(str(path))
    con.execute(f"CREATE OR REPLACE VIEW conversations AS SELECT * FROM read_parquet('{path}/conversations.parquet/*.parquet')")
    return con


def test_trie_of_nothing_and_of_repeated_rows(spark):
    empty = conversations(spark, [])
    assert trie.prefix_trie(empty).collect() == []
    rows = [(1, 0, "user", "again", "x")] * 3 + [(2, 0, "user", "again", "x")]
    assert {tuple(r) for r in trie.prefix_trie(conversations(spark, rows)).collect()} == brute_trie(turns_of(rows))


# Runs


def brute_runs(words):
    n, out = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i > s and i - s + q >= max(6, 4 * q):
                out.setdefault((s, i - s + q), q)
            i = max(i, s + 1)
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def brute_digest(words):
    found = brute_runs(words)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    own = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return len(found), *own, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(kept)


def test_runs_of_random_words():
    rng = random.Random(1)
    for _ in range(400):
        ids = [rng.randrange(rng.choice([1, 2, 3, 40])) for _ in range(rng.randrange(250))]
        for _ in range(rng.randrange(4)):
            a = rng.randrange(len(ids) + 1)
            ids[a:a] = ids[a : a + rng.randrange(1, 30)] * rng.randrange(1, 8)
        x, want = np.array(ids, np.int32), brute_runs(ids)
        assert runs.runs_of(x) == want
        parts = rng.randrange(1, 6)
        assert runs.merged([r for k in range(parts) for r in runs.runs_of(x, *runs.lag_range(len(ids), k, parts))]) == want


def run_texts():
    rng = random.Random(4)
    loop = " ".join(f"v{k}" for k in range(31))
    more = ["na " * 70, f"intro {loop} {loop} {loop} {loop} {loop} end", "a b a b a b a b \x1c\x1c \x85", "a\x0bb\x0ca b a b a b", "x " * 5, "x " * 6, " ".join(rng.choice("ab") for _ in range(900))]
    return dict(enumerate([*TEXTS.values(), *more, *more]))


def planted(i, words):
    h = zlib.crc32(b"%d" % i)
    if h % 10 or not words:
        return words
    a, g = h // 10 % len(words), h // 10
    p = 1 + (len(words) - a) // (3 + g % 8)
    return [words[a + (k - a) % p] if k >= a else words[k] for k in range(len(words))]


def test_op13_against_brute_force(spark, tmp_path):
    texts = run_texts()
    sf = write(spark, tmp_path, [(i, t) for i, t in texts.items()])
    want = {i: brute_digest(planted(i, re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t in texts.items()}
    rows = queries.queries()["op13_runs"](spark, sf).collect()
    assert {r.doc_id: tuple(r)[1:] for r in rows} == want and len(rows) == len(texts)
    assert any(w[0] and i < len(TEXTS) for i, w in want.items())
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    long = runs.with_runs(docs, runs.digest, runs.DIGEST, runs.planted, range_bytes=150)
    assert {r.doc_id: tuple(r)[2:] for r in long.collect()} == want


def test_collapse_keeps_columns_and_null_ids(spark):
    docs = spark.createDataFrame([(None, "a a a a a a a b", "own", 1, 2), (None, None, "own", 1, 2), (3, "", None, 1, 2)], SCHEMA)
    out = runs.collapse_runs(docs)
    assert out.columns == ["doc_id", "text", "size", "_whole", "runs", "collapsed_text"]
    got = {(r.doc_id, r.text): (r.runs, r.collapsed_text, r.size) for r in out.collect()}
    assert got[None, None] == ([], "", "own") and got[3, ""] == ([], "", None)
    assert [tuple(x) for x in got[None, "a a a a a a a b"][0]] == [(0, 7, 1)] and got[None, "a a a a a a a b"][1] == "a b"
    assert runs.collapse_runs(docs.limit(0)).collect() == []
