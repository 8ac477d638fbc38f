"""The corpus operators against brute force: nulls, empty and long texts, ties, repeated rows, extra columns, empty tables."""

import base64
import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelake.llm import bpe, chat, decontaminate, html_text, langid, lines, lm, neardup, quality, repeats

WORDS = [f"w{i}" for i in range(400)] + ["été", "Ünder", "x#y", "THE", "naïve"]


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def texts():
    rng = random.Random(5)
    prose = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    base = prose(120)
    long_line = "a shared line that is long enough to count"
    near = base.split()
    near[3] = "changed"
    out = [None, "", " \n\t", base, base, " ".join(near), f"{long_line}\nown {prose(30)}", f"x {prose(12)}\n  {long_line.upper()} ", f"{long_line}\n{long_line}\n{prose(8)}", prose(3000), "one", "one", "!!! ???", "Mentpa " * 80, prose(60) + base[:420] + prose(20)]
    return out + [prose(rng.randrange(1, 90)) for _ in range(25)]


TEXTS = dict(enumerate(texts()))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", f"s{i % 3}", "kept-col", 1) for i, t in TEXTS.items()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, kept string, n_words int")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, 1 if i % 2 else None, 0) for i in range(20)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def brute_hits(text, items):
    fold = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    w, hit, found = fold(text), set(), set()
    for i, t in items:
        for win in decontaminate.item_windows(fold(t)):
            for p in range(len(w) - len(win) + 1):
                if tuple(w[p : p + len(win)]) == win:
                    hit.update(range(p, p + len(win)))
                    found.add(str(i))
    return len(w), len(hit), sorted(found)


def test_runs_of_one_byte_or_period_are_one_node(spark):
    """Megabytes of one byte give one node and one span; what is removed agrees with the definition where a run borders other text."""
    x = np.frombuffer(b"a" * 2_000_000, np.uint8)
    rows = repeats.anchored(x, np.array([0]), np.array([len(x)]))
    assert len(rows) == 8 and all(len(r) <= 2 for r in rows) and sum(rows[-1]) > 1_900_000
    rng = random.Random(11)
    noise = lambda n: "".join(rng.choice("bcdefghij") for _ in range(n))
    texts = {0: noise(300) + "a" * 700 + noise(300), 1: noise(250) + "xyz" * 250 + noise(250), 2: "a" * 201, 3: "q" * 200, 4: noise(200) + "a" * 199, 5: "pq" * 400, 6: noise(900)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    k, raw = repeats.LENGTH, {i: t.encode() for i, t in texts.items()}
    seen = collections.Counter(t[p : p + k] for t in raw.values() for p in range(len(t) - k + 1))
    for r in repeats.remove_repeats(docs).collect():
        t = raw[r.doc_id]
        gone = {q for p in range(len(t) - k + 1) if seen[t[p : p + k]] > 1 for q in range(p, p + k)}
        assert r.kept_bytes == bytes(c for q, c in enumerate(t) if q not in gone), r.doc_id
    assert repeats.with_spans(spark.createDataFrame([(1, "a" * 300_000)], "doc_id long, text string")).selectExpr("size(removed) AS n").first().n <= 3


def test_a_line_rare_at_first_and_frequent_later_is_told(spark):
    """It is settled by three documents of the first batch; its count of later batches still makes it one of the broadcast keys."""
    line = "a line that nearly every document holds"
    texts = {i: line if i > 996 or i < 700 and i % 2 else f"own line number {i} of this document" for i in range(1000)}
    keys = lines.document_keys(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    runs = lines.LineRuns(often=50)
    for b in range(4):
        runs.add(keys.filter(f"doc_id >= {750 - 250 * b} AND doc_id < {1000 - 250 * b}"))
    got = runs.settled().collect()
    assert len(got) == 1 and got[0].n > 50 and got[0].top == 999


def test_decontaminate(spark, docs, empty):
    items = [(1, " ".join(TEXTS[3].split()[10:30])), (2, "one"), (3, None), (4, "?!"), (5, " ".join(TEXTS[9].split()[500:512])), (11, "one")]
    b = spark.createDataFrame(items, "item_id long, text string")
    want = {i: brute_hits(t, items) for i, t in TEXTS.items()}
    for how in ({}, {"max_windows": 1}):
        got = {r.doc_id: r for r in decontaminate.find_hits(docs, b, **how).collect()}
        assert {i: (r.n_words, r.n_hit, r.item_ids) for i, r in got.items()} == want
        assert all(sum(x.end - x.start for x in r.hit_runs) == r.n_hit for r in got.values())
    left = decontaminate.decontaminate(docs, b)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {i for i, w in want.items() if not w[1]}
    assert decontaminate.find_hits(empty, b).count() == 0
    assert decontaminate.find_hits(docs, b.limit(0)).filter("n_hit > 0").count() == 0


def test_lines(spark, docs, empty):
    key = lambda s: s.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    held = collections.defaultdict(set)
    for i, t in TEXTS.items():
        for x in (t or "").split("\n"):
            if len(key(x)) >= 20:
                held[key(x)].add(i)
    for r in lines.with_kept_text(docs).unionByName(lines.with_kept_text(docs, hot_share=1)).unionByName(lines.with_kept_text(docs, hot_share=20)).collect():
        own = (TEXTS[r.doc_id] or "").split("\n")
        kept = [x for x in own if len(held[key(x)]) < 3 or max(held[key(x)]) == r.doc_id]
        assert (r._kept_text, r._n_lines, r._n_dropped) == ("\n".join(kept), len(own), len(own) - len(kept))
    # An id far from all others is the last holder of its line.
    far = spark.createDataFrame([(i, "a line of twenty characters and more") for i in (1, 2, 3, 4, 5, 6, 10**15, None)], "doc_id long, text string")
    assert {r.doc_id: r._n_dropped for r in lines.with_kept_text(far).collect()} == {None: 1, 10**15: 0} | {i: 1 for i in range(1, 7)}
    assert lines.dedup_lines(docs).columns == docs.columns
    assert lines.dedup_lines(empty).count() == 0
    again = lines.dedup_lines(docs.unionByName(docs)).count()
    assert again == 2 * len(TEXTS)


def test_quality(docs, labels, empty):
    word = re.compile(r"[^\x20\x09-\x0D]+")
    for r in quality.judge(docs.drop("kept"), labels).collect():
        t = TEXTS[r.doc_id] or ""
        w = word.findall(t)
        n = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        rep = {k for i in range(len(w) - 4) if n[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
        full = [x for x in t.split("\n") if word.search(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(full) - len(set(full)), len(rep))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(w) < 10 or 100 * len(rep) > 20 * len(w))
        assert not (r.kept and r.base_failed)
    good = quality.keep_good(docs, labels)
    assert good.columns == docs.columns and 0 < good.count() < len(TEXTS)
    assert quality.judge(empty, labels).count() == 0
    assert all(r.ratio == 0 for r in quality.judge(docs, labels.limit(0)).select("ratio").collect())


def pairs_of(size, percent):
    fold = lambda t: (t or "").encode().lower().split()
    sets = {}
    for i, t in TEXTS.items():
        w = fold(t)
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    up = {i: i for i in sets}
    for a, b in itertools.combinations(sets, 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            lo, hi = sorted((up[a], up[b]))
            up = {k: lo if v == hi else v for k, v in up.items()}
    return sets, up


@pytest.mark.parametrize("size", [2, 5])
def test_neardup(docs, size):
    sets, up = pairs_of(size, 80)
    for r in neardup.near_duplicates(docs, shingle=size).collect():
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), up[r.doc_id], up[r.doc_id] == r.doc_id)


@pytest.mark.parametrize("reach", [1, neardup.REACH])
def test_neardup_crowd(spark, reach):
    """One family of texts whose similarities lie around the threshold, and a crowd of close copies: nothing hides behind the reach."""
    rng = random.Random(11)
    rows = []
    for family, most in ((0, 2), (1, 9), (2, 14)):
        base = [rng.choice(WORDS) for _ in range(110)]
        for _ in range(50):
            w = list(base)
            for _ in range(rng.randrange(1, most)):
                w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(w)))
    sets = [set(zip(t.split(), t.split()[1:])) for _, t in rows]
    root = list(range(len(rows)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i, j in itertools.combinations(range(len(rows)), 2):
        common = len(sets[i] & sets[j])
        if 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    assert len({find(i) for i in root}) > 20
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=2, reach=reach)
    assert {r.doc_id: r.component_id for r in got.collect()} == {i: find(i) for i in range(len(rows))}


def test_neardup_edges(spark, docs, empty):
    assert neardup.near_duplicates(empty).count() == 0
    left = neardup.keep_one(docs)
    assert sorted(left.columns) == sorted(docs.columns)
    d = spark.createDataFrame([(None, "a b c"), (7, "a b c"), (7, "a b c"), (9, None)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.component_id) for r in neardup.near_duplicates(d, shingle=2).collect()) == [(0, 7), (7, 7), (7, 7), (9, 9)]


def test_repeats(spark, docs, empty):
    k, seen = repeats.LENGTH, collections.Counter()
    raw = {i: (t or "").encode() for i, t in TEXTS.items()}
    for x in raw.values():
        seen.update(x[p : p + k] for p in range(len(x) - k + 1))
    for r in repeats.remove_repeats(docs.drop("kept")).collect():
        x = raw[r.doc_id]
        gone = {q for p in range(len(x) - k + 1) if seen[x[p : p + k]] > 1 for q in range(p, p + k)}
        assert r.kept_bytes == bytes(c for q, c in enumerate(x) if q not in gone), r.doc_id
        assert sum(s.hi - s.lo for s in r.removed_spans) == len(gone)
        assert all(a.hi < b.lo for a, b in itertools.pairwise(r.removed_spans))
    assert repeats.remove_repeats(empty).count() == 0
    twice = spark.createDataFrame([(1, "q" * 150 + "r" * 150)] * 2 + [(2, "q" * 150 + "r" * 149)], "doc_id long, text string")
    assert [len(r.kept_bytes) for r in repeats.remove_repeats(twice).collect()] == [0, 0, 0]


def test_long_text_in_segments(monkeypatch):
    rng = np.random.default_rng(1)
    text = rng.integers(97, 123, 5000).astype(np.uint8).tobytes()
    monkeypatch.setattr(repeats, "BLOCK", 700)
    starts = []
    for _, data, begins, ends, offsets in repeats._segments([text]):
        piece, lo, hi, *_ = repeats.anchored(data, begins, ends)
        for p, a, b in zip(piece, lo, hi):
            starts += range(a - begins[p] + offsets[p], b - begins[p] + offsets[p] + 1)
    assert starts == list(range(len(text) - repeats.LENGTH + 1))


def test_lm(docs, empty):
    d = docs.select("doc_id", "text").withColumn("held_out", F.col("doc_id") % 7 == 2)
    count = collections.Counter()
    for i, t in TEXTS.items():
        if i % 7 != 2:
            count.update(lm.tokens((t or "").encode()))
    total = sum(count.values())
    for hot in (lm.HOT, 5):
        for r in lm.score_documents(d, d.filter("NOT held_out"), hot).collect():
            w = lm.tokens((TEXTS[r.doc_id] or "").encode())
            assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(count[x] > 0 for x in w), total)
            assert r.base_score == pytest.approx(sum(np.log10((count[x] + 1) / (total + len(count) + 1)) for x in w))
            assert r.score < 0
    e = empty.select("doc_id", "text").withColumn("held_out", F.lit(False))
    assert lm.score_documents(e, e).count() == 0


def test_lm_is_normalised_and_learns():
    g = np.array([lm.CLASSES * (lm.CLASSES + 1) * lm.CLASSES + lm.CLASSES * lm.CLASSES + 3, 3 * lm.CLASSES + 4])
    p = lm.train(g, np.array([5, 5]), steps=80)
    assert np.allclose(np.exp(p).sum(1), 1) and p[3, 4] > p[:, 4].mean()


def test_lm_uses_the_whole_trigram_table_and_learns_own_words(spark):
    # A trigram of one occurrence among 10^9 was never drawn; with its gradient it moves its class.
    size = lm.CLASSES + 1
    g = np.array([(5 * size + 6) * lm.CLASSES + 7, (8 * size + 9) * lm.CLASSES + 10])
    n = np.array([10**9, 1])
    assert not np.array_equal(lm.train(g, n, steps=20), lm.train(g[:1], n[:1], steps=20))
    # Two tail words of one class and one count, each after its own word: the counts alone cannot tell them apart.
    a, b = [w for w in (f"z{i}q" for i in range(3000)) if lm.tail_class(w.encode()) == lm.TOP][:2]
    rng = random.Random(2)
    filler = [f"f{i}" for i in range(lm.TOP + 2)]
    rows = [(i, " ".join([*filler, *(f"f0 {a}" if rng.random() < 0.5 else f"f1 {b}" for _ in range(60))])) for i in range(12)]
    rows += [(100, f"f0 {a}"), (101, f"f0 {b}"), (102, f"f1 {b}"), (103, f"f1 {a}")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("held_out", F.col("doc_id") >= 100)
    for hot in (lm.HOT, 66):
        got = {r.doc_id: r.score for r in lm.score_documents(d, d.filter("NOT held_out"), hot).collect()}
        assert got[100] > got[101] + 0.3 and got[102] > got[103] + 0.3


def test_chat(spark):
    rows = [(1, 0, "system", None, 9), (1, 1, "user", "a <b> ### \\", 9), (1, 2, "assistant", "</turn>\n### user: x", 9), (1, 3, "assistant", "", 9), (1, 4, "user", "tail", 9), (2, 0, "user", "only", 9), (None, 0, "assistant", "n", 9), (3, None, None, "t", 9), (3, 0, "we:ird\n", "z", 9)]
    c = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, example int")
    ex = chat.expand(c)
    got = {r.conv_id: r for r in chat.read_back(ex).collect()}
    assert len(got) == 4
    for conv in got:
        turns = [(r[2] or "", r[3] or "") for r in rows if r[0] == conv]
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[conv].turns_sha256 == sha("".join(f"{r}\n{t}\n" for r, t in turns)) and got[conv].n_turns == len(turns)
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), sha(loss))
    assert ex.filter("conv_id = 1").count() == 3
    assert chat.read_back(chat.expand(c.limit(0))).count() == 0


def test_bpe(docs, empty):
    import tiktoken

    path, pattern = bpe.public_vocabulary()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    want = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    for r in bpe.encode_documents(docs, path, pattern).collect():
        t = TEXTS[r.doc_id] or ""
        assert np.frombuffer(r.token_ids, "<u4").tolist() == want.encode_ordinary(t) and r.decoded == t.encode()
    assert bpe.token_digests(empty, path, pattern).count() == 0


def test_bpe_random_bytes():
    import tiktoken

    path, pattern = bpe.public_vocabulary()
    tokens = bpe.load_ranks(path)
    want = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdeèéth n中🙂") for _ in range(rng.randrange(1, 60))) for _ in range(400)]
    assert bpe.Encoder(tokens, pattern).encode(words) == [np.array(want.encode_ordinary(w), "<u4").tobytes() for w in words]


def test_bpe_waves_equal_one_pair_at_a_time():
    """A vocabulary whose later merges have lower ranks than earlier ones, overlapping pairs, and words in the odd case."""
    import tiktoken

    rng = random.Random(8)
    for _ in range(60):
        made = {bytes([b]) for b in range(256)}
        longer = set()
        while len(longer) < 40:
            longer.add(bytes(rng.choice(b"ab") for _ in range(rng.randrange(2, 6))))
        ranks = [*sorted(made), *rng.sample(sorted(longer), 40)]
        want = tiktoken.Encoding("own", pat_str=r"\S+", mergeable_ranks={t: i for i, t in enumerate(ranks)}, special_tokens={})
        words = list({bytes(rng.choice(b"abab c"[:5]) for _ in range(rng.randrange(1, 40))).replace(b" ", b"a") for _ in range(200)})
        assert bpe.MergeReplay(ranks).encode(words) == [np.array(want.encode_ordinary(w.decode()), "<u4").tobytes() for w in words]


def test_bpe_long_pieces_and_a_small_memo(monkeypatch):
    import tiktoken

    path, pattern = bpe.public_vocabulary()
    tokens = bpe.load_ranks(path)
    want = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    monkeypatch.setattr(bpe, "MEMO_WORDS", 3)
    encoder = bpe.Encoder(tokens, pattern)
    rng = random.Random(4)
    for text in ("ab" * 4000, "".join(rng.choice("etaoin") for _ in range(30_000)), "a b c d e f g h i j", "", "a b c d e f g h i j"):
        assert encoder.encode([text]) == [np.array(want.encode_ordinary(text), "<u4").tobytes()]


def test_langid(spark, docs, empty):
    path, _ = bpe.public_vocabulary()
    sample = {"en": ["the cat sat on the mat with the hat", "this is the house"], "de": ["der hund und die katze", "das ist ein haus und ein garten"]}
    d = spark.createDataFrame([(1, "the house", 1), (2, "und der garten", 1), (3, None, 1), (4, "123 !!", 1), (5, "a" * 300, 1)], "doc_id long, text string, score int")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(d, sample, path).collect()}
    assert (got[1][0], got[2][0], got[3], got[4]) == ("en", "de", ("und", 0.0), ("und", 0.0)) and 0 <= got[5][1] <= 1
    assert {r.lang_pred for r in langid.predict(d, langid.labelled_sample(empty), path).collect()} == {"und"}


def test_langid_sample_counts_copies_once(spark):
    few = [(f"l{k}", f"text {i % 3} of l{k}") for k in range(8) for i in range(900)]
    many = [("en", f"own text {i}") for i in range(400)] + [("en", "hot")] * 3000
    d = spark.createDataFrame(few + many, "lang string, text string")
    got = langid.labelled_sample(d, docs_per_lang=20)
    assert {k: set(v) for k, v in got.items() if k != "en"} == {f"l{k}": {f"text {i} of l{k}" for i in range(3)} for k in range(8)}
    assert len(got["en"]) == len(set(got["en"])) == 20 and all(len(v) == 3 for k, v in got.items() if k != "en")
    assert got == langid.labelled_sample(d.repartition(3), docs_per_lang=20)
    shared = langid.labelled_sample(d, docs_per_lang=20, sample_texts=18)
    assert len(shared) == 9 and all(len(v) == 2 for v in shared.values())
    assert all(len(v) == 1 for v in langid.labelled_sample(d, sample_texts=3).values())


def test_langid_learns_every_label_and_long_pieces():
    pieces = langid.Pieces([b"th", b"internationalisation"])
    langs, prob = langid.train({f"l{k:03d}": [f"word{chr(97 + k % 26)}{chr(97 + k // 26)} internationalisation"] for k in range(250)}, pieces, rounds=1)
    assert len(langs) == 250 and pieces.widest == 20
    scorer = langid.Scorer(pieces, prob)
    scorer.most = 1
    a, b = scorer.score(["internationalisation"])[0], scorer.score(["th", "internationalisation"])[1]
    assert np.allclose(a, b) and np.isfinite(a).all()


def test_forward_sums_all_segmentations():
    pieces = langid.Pieces([b"ab", b"abc", b"bc"])
    prob = np.random.default_rng(0).random((len(pieces.index) + 1, 2))
    prob[-1] = 0
    def brute(w):
        return np.ones(2) if not w else sum((prob[pieces.index[w[:k]]] * brute(w[k:]) for k in range(1, len(w) + 1) if w[:k] in pieces.index), np.zeros(2))
    for w in (b"a", b"abcab", b"zabc"):
        assert np.allclose(langid.forward(pieces.spans([w]), prob)[0, -1], brute(w))


@pytest.mark.parametrize(
    "page, want",
    [
        (None, ""), ("", ""), ("plain", "plain"),
        ("<body><nav>menu</nav><article><h1>T &amp; U</h1><p>a\n  b<br>c<p>d</article><footer>f</footer>", "T & U\n\na b c\n\nd"),
        ("<article>A<aside>no</aside>B<div class=comments><p>hey</p></div><p>C</article><div>longer text outside than the article has</div>", "A\n\nB\n\nC"),
        ("<body><div id=sidebar>x</div><div class='content'><p>long text here</p><ul><li>a<li>b</ul></div><div>foot</div>", "long text here\n\na\n\nb"),
        ("<article><script>var t='</p>';</script><p>x</p><form>f</form><style>p{}</style><!-- c --></article>", "x"),
    ],
)
def test_html(page, want):
    assert html_text.main_text(page) == want


def test_html_stretches_cross_containers():
    prose = [f"{c} " + "running words of the article " * 5 + c for c in "abcd"]
    parts = "".join(f"<div><p>{x}</p></div>" for x in prose[:2]) + "<div>short</div>" + "".join(f"<section><p>{x}</p></section>" for x in prose[2:])
    links = "<div>" + "".join(f"<p><a href=/{i}>a long headline of another page number {i} to click</a></p>" for i in range(40)) + "</div>"
    assert html_text.main_text(f"<body>{links}{parts}{links}") == "\n\n".join([*prose[:2], "short", *prose[2:]])
    assert html_text.main_text("<main>one</main><p>x</p><article>two</article>") == "one\n\ntwo"


@pytest.mark.parametrize(
    "inner",
    ['<div style="overflow:hidden">words</div>', "<p>see <a href='/hidden/x'>words</a> here</p>", '<p title="a hidden gem">words</p>', '<div data-id="notice">words</div>', '<h2 id="related-work">words</h2>', "<p class=share>words</p>", "<div data-note='id=menu'>words</div>"],
)
def test_html_attribute_values_hide_nothing(inner):
    assert "words" in html_text.main_text(f"<article><p>a</p>{inner}<div hidden>gone</div><div CLASS='x related'>gone</div><p aria-hidden=true>gone</p></article>")
    assert "gone" not in html_text.main_text(f"<article><p>a</p>{inner}<div hidden>gone</div><div CLASS='x related'>gone</div><p aria-hidden=true>gone</p></article>")


def test_html_table(spark):
    p = spark.createDataFrame([(1, "u", "<p>x</p>", 5), (2, None, None, 5)], "page_id long, url string, html string, text int")
    assert [(r.text, r.n_chars) for r in html_text.extract(p).orderBy("page_id").collect()] == [("x", 1), ("", 0)]
    assert html_text.extract(p.limit(0)).count() == 0


def test_pipeline_against_brute_force(spark):
    import corpus_pipeline
    from tracelake.llm.common import table

    sf = "/root/testdata/sf0.001"
    docs = table(spark, sf, "documents")
    items = [(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()]
    kept = corpus_pipeline.one_of_each_group(spark, docs, sf)
    clean = corpus_pipeline.without_benchmark(spark, kept, sf)
    assert clean.columns[0] == "doc_id" and sorted(clean.columns) == sorted(docs.columns)
    rows = {r.doc_id: r.text for r in kept.collect()}
    assert {r.doc_id for r in clean.collect()} == {i for i, t in rows.items() if not brute_hits(t, items)[1]}
    out = corpus_pipeline.run(spark, sf)
    assert 0 < out.count() <= clean.count() and out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_remainder(spark):
    from tracelake.llm.common import remainder

    assert spark.range(50).select("id", remainder(F.col("id"), 7).alias("r")).filter("r < 0").count() == 0
    assert all(r.r == zlib.crc32(str(r.id).encode()) % 7 for r in spark.range(50).select("id", remainder(F.col("id"), 7).alias("r")).collect())


CLASHES = "lost _lost _kept _kept_text _n_lines _n_dropped k1 k2 removed n_hit item_ids hit_runs _row _h _words ratio n lo hi h m r s component set_key".split()


def test_own_columns_come_back_as_they_were(spark, docs, labels, empty):
    """Extra columns with the names that operators use inside: every operator that returns documents leaves them alone."""
    d = docs.withColumns({c: F.lit(f"own-{c}") for c in CLASHES})
    b = spark.createDataFrame([(1, " ".join(TEXTS[9].split()[500:512]))], "item_id long, text string")
    gone = {"repeats": repeats.remove_repeats(d), "lines": lines.dedup_lines(d), "near": neardup.keep_one(d), "bench": decontaminate.decontaminate(d, b), "joined": decontaminate.decontaminate(d, b, max_windows=1), "good": quality.keep_good(d, labels)}
    for name, out in gone.items():
        assert set(d.columns) <= set(out.columns) and len(set(out.columns)) == len(out.columns), name
        rows = out.select("doc_id", "kept", "n_words", *CLASHES).collect()
        assert rows and all(r.kept == "kept-col" and r.n_words == 1 and all(r[c] == f"own-{c}" for c in CLASHES) for r in rows), name


def test_chat_memory_is_linear(spark):
    """2,000 turns of 500 characters: the examples are 500 MB together, a task holds one of them."""
    rows = [(1, i, "assistant" if i % 2 else "user", "x" * 500) for i in range(2000)]
    r = chat.read_back(chat.expand(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).first()
    assert (r.n_turns, r.loss_chars) == (2000, 500_000)


def test_repeats_of_passages_in_another_order(spark):
    rng = random.Random(6)
    prose = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passages = [prose(300 + 37 * i) for i in range(8)]
    data = [(1, prose(150).join(passages)), (2, prose(90).join(reversed(passages))), (3, passages[2] + prose(500) + passages[5])]
    raw = {i: t.encode() for i, t in data}
    k = repeats.LENGTH
    seen = collections.Counter(x[p : p + k] for x in raw.values() for p in range(len(x) - k + 1))
    d = spark.createDataFrame(data, "doc_id long, text string")
    for r in repeats.remove_repeats(d).collect():
        x = raw[r.doc_id]
        gone = {q for p in range(len(x) - k + 1) if seen[x[p : p + k]] > 1 for q in range(p, p + k)}
        assert r.kept_bytes == bytes(c for q, c in enumerate(x) if q not in gone)


def test_pair_hashes_hold_what_they_hash_once(spark):
    """The filter of keep_good brings the hashes of all words in place of their column: inside a lambda they would be computed for each word."""
    d = spark.createDataFrame([("a b c",), ("a",), ("",)], "t string")
    out = quality.pair_hashes(quality.word_hashes(quality.words_of(F.col("t"))))
    assert d.select(out.alias("p"))._jdf.queryExecution().analyzed().toString().count("split(") == 1
    assert [len(r[0]) for r in d.select(out).collect()] == [2, 0, 0]
