"""The registered opN_ queries as a whole: against DuckDB where SQL can express them, else against brute force on a small folder."""

import base64
import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest

from tests.llm.test_llm import TEXTS, sha
from tests.oracle import compare, duck
from tracelake.llm import bpe, html_text, langid, lm, quality, queries, repeats


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    compare(spark, sf, queries.queries()[name], queries.oracle_sql()[name], duck(sf))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """documents and labels with nulls, empty, long and repeated texts, and an own column in the way of every operator."""
    top = str(tmp_path_factory.mktemp("tables"))
    rows = [(i, t, ["en", "fr", None][i % 3], f"s{i % 3}", len(t or ""), 7) for i, t in TEXTS.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, lost int").write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(20)] + [(None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    return top


def test_op4_digests(spark, folder):
    k, raw = repeats.LENGTH, {i: (t or "").encode() for i, t in TEXTS.items()}
    seen = collections.Counter(x[p : p + k] for x in raw.values() for p in range(len(x) - k + 1))
    for r in queries.queries()["op4_repeats"](spark, folder).collect():
        x = raw[r.doc_id]
        gone = {q for p in range(len(x) - k + 1) if seen[x[p : p + k]] > 1 for q in range(p, p + k)}
        want = (len(x), len(gone), sum(q - 1 not in gone for q in gone), sha(bytes(c for q, c in enumerate(x) if q not in gone)))
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want


def test_op10_digests(spark, folder):
    import tiktoken

    path, pattern = bpe.public_vocabulary()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    want = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    for r in queries.queries()["op10_bpe"](spark, folder).collect():
        ids = want.encode_ordinary(TEXTS[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha((TEXTS[r.doc_id] or "").encode()))


def test_op9_ratio_and_verdict(spark, folder):
    """The ratio recomputed from the words, with Spark's hash as the only thing taken over."""
    word = re.compile(r"[^\x20\x09-\x0D]+")
    grams = {}
    for i, t in TEXTS.items():
        w = word.findall(t or "")
        grams[i] = [(x,) for x in w] + list(zip(w, w[1:]))
    every = sorted({g for v in grams.values() for g in v})
    words = sorted({x for g in every for x in g})
    h1 = {r.w: r.h for r in spark.createDataFrame([(w,) for w in words], "w string").selectExpr("w", "xxhash64(w) AS h").collect()}
    two = spark.createDataFrame([(g[0], g[1], h1[g[0]], h1[g[1]]) for g in every if len(g) == 2], "a string, b string, x long, y long").selectExpr("a", "b", "xxhash64(x, y) AS h")
    bucket = {(w,): h % quality.BUCKETS for w, h in h1.items()} | {(r.a, r.b): r.h % quality.BUCKETS for r in two.collect()}
    raw, trusted = collections.Counter(), collections.Counter()
    for i, v in grams.items():
        raw.update(bucket[g] for g in v)
        if i < 20 and i % 2:
            trusted.update(bucket[g] for g in v)
    share = sum(trusted.values()) / sum(raw.values())
    weight = {b: math.log((trusted[b] + quality.PRIOR) / (raw[b] * share + quality.PRIOR)) for b in raw}
    for r in queries.queries()["op9_quality"](spark, folder).collect():
        ratio = sum(weight[bucket[g]] for g in grams[r.doc_id]) / (len(grams[r.doc_id]) + quality.LENGTH_PRIOR)
        assert r.ratio == pytest.approx(ratio, abs=1e-9)
        assert r.kept == (not r.base_failed and ratio >= quality.THRESHOLD)


def test_op1_on_held_out_documents(spark):
    import pyarrow.parquet as pq

    sf = "/root/testdata/sf0.001"
    lang = {r["doc_id"]: (r["lang"], r["text"]) for r in pq.read_table(f"{sf}/documents.parquet").to_pylist()}
    right = asked = 0
    for r in queries.queries()["op1_langid"](spark, sf).collect():
        want, text = lang[r.doc_id]
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not text or not any(c.isalpha() for c in text))
        if r.held_out and want and r.lang_pred != "und":
            asked += 1
            right += r.lang_pred == want
    assert asked > 20 and right >= 0.9 * asked


def test_op5_beats_the_base_on_held_out_documents(spark):
    rows = queries.queries()["op5_lm"](spark, "/root/testdata/sf0.01").collect()
    for held in (True, False):
        mine = [r for r in rows if r.held_out == held]
        assert sum(r.score for r in mine) > sum(r.base_score for r in mine)
    assert all(math.isfinite(r.score) and r.score < 0 for r in rows)


def test_op2_window_sums_by_hand():
    """Stretches from sums taken one by one, on random lines of random parts."""
    rng = np.random.default_rng(3)
    differ = 0
    for _ in range(300):
        lines, part = [], 0
        for _ in range(rng.integers(1, 25)):
            part += int(rng.random() < 0.3)
            n = int(rng.choice([3, 20, 60, 200]))
            lines.append(("x" * n, part, False, int(rng.choice([0, 0, n]))))
        got = html_text.main_lines(lines, 3)
        counts = [len(t) - k for t, _, _, k in lines]
        if not any(counts):
            counts = [len(t) for t, *_ in lines]
        windows = [[j for j in range(max(i - 2, 0), i + 1)] for i in range(len(lines))] + [[len(lines) - 2, len(lines) - 1], [len(lines) - 1]]
        windows += [[i, i + 1] for i in range(len(lines) - 1)] + [[i] for i in range(len(lines))]
        whole = [w for w in windows if min(w) >= 0 and len({lines[j][1] for j in w}) == 1]
        # beside a part's border a window holds what it can of the part
        ok = [w for w in whole if len(w) == 3 or lines[w[0]][1] != (lines[w[0] - 1][1] if w[0] else None) or w[-1] == len(lines) - 1 or lines[w[-1] + 1][1] != lines[w[0]][1]]
        sums = [sum(counts[j] for j in w) for w in ok]
        level = min(html_text.DENSE, max(sums) / 2)
        live = sorted({j for w, v in zip(ok, sums) if v >= level for j in w})
        runs = [[live[0]]]
        for j in live[1:]:
            runs[-1].append(j) if j - runs[-1][-1] <= 4 else runs.append([j])
        best = max(runs, key=lambda r: (sum(counts[r[0] : r[-1] + 1]), -r[0]))
        assert got == list(range(best[0], best[-1] + 1))
        differ += got != html_text.main_lines(lines, 1)
    assert differ > 20


def test_op2_hostile_pages_take_linear_time():
    import time

    for page in ("<p title=\"" * 90_000, "<div>" * 180_000, "<p><td>" + "<div>x" * 150_000, "<a href='" * 100_000, "<b>x" * 200_000, "<" * 900_000, "</p>" * 200_000):
        began = time.time()
        html_text.main_text(page)
        assert time.time() - began < 20
    deep = "<div>" * 2000 + "<p>inner</p>" + "</div>" * 2000 + "<p>outer</p>"
    assert html_text.main_text(deep) == "inner\n\nouter"
    assert html_text.main_text("<p title=don't>it's<p>two") == "it's\n\ntwo"


def test_pipeline_stage_by_stage(spark, folder, tmp_path):
    """Every stage of run() against brute force on what its predecessor kept: nulls, empty, long and repeated texts, an own column `lost`."""
    import itertools

    import tiktoken

    import corpus_pipeline
    from tests.llm.test_llm import brute_hits

    items = [(1, " ".join(TEXTS[9].split()[500:512])), (2, "w1 w2 w3"), (3, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, texts, seen = docs.columns, dict(TEXTS), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert sorted(docs.columns) == sorted(columns)
        rows = docs.collect()
        assert all(r.lost == 7 for r in rows) and len({r.doc_id for r in rows}) == len(rows)
        seen[name] = {r.doc_id: r.text for r in rows}
        docs = spark.createDataFrame(rows, docs.schema)
    good = {r.doc_id for r in quality.judge(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")).filter("kept").collect()}
    assert seen["quality"] == {i: texts[i] for i in good} and 5 < len(good) < len(texts)

    key = lambda s: s.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    held = collections.defaultdict(set)
    for i, t in seen["quality"].items():
        for x in (t or "").split("\n"):
            if len(key(x)) >= 20:
                held[key(x)].add(i)
    want = {i: t and "\n".join(x for x in t.split("\n") if len(held[key(x)]) < 3 or max(held[key(x)]) == i) for i, t in seen["quality"].items()}
    assert seen["lines"] == want

    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w := t.encode().lower().split()) >= 5 else {tuple(w)} if w else set() for i, t in want.items()}
    up = {i: i for i in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            lo, hi = sorted((up[a], up[b]))
            up = {k: lo if v == hi else v for k, v in up.items()}
    one = {i: t for i, t in want.items() if up[i] == i}
    assert seen["near_duplicates"] == one and len(one) < len(want)
    clean = {i: t for i, t in one.items() if not brute_hits(t, items)[1]}
    assert seen["decontamination"] == clean and len(clean) < len(one)

    path, pattern = bpe.public_vocabulary()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, folder).collect()}
    ids = {i: encoding.encode_ordinary(t) for i, t in clean.items()}
    assert got == {i: (len(x), sha(np.array(x, "<u4").tobytes()), sha(clean[i].encode())) for i, x in ids.items()}


def test_pipeline_of_empty_tables(spark, folder, tmp_path):
    import corpus_pipeline

    for name in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


PROSE = "Some words of an article that go on for a while and hold enough text to be a line of prose."
BODY = f"<p>{PROSE} {PROSE}</p><p>{PROSE}</p>"
MAIN = f"{PROSE} {PROSE}\n\n{PROSE}"


@pytest.mark.parametrize(
    "page, want",
    [
        (f"<body><form><div><article>{BODY}</article></div></form></body>", MAIN),
        (f"<body><form><div>{BODY}</div></form></body>", MAIN),
        (f"<body><div class='content has-sidebar'><article>{BODY}</article><div class=sidebar>{PROSE}</div></div></body>", MAIN),
        (f"<body><div class='with-menu'>{BODY}</div></body>", MAIN),
        (f"<body><div id='modal-root'><main>{BODY}</main></div></body>", MAIN),
        (f"<article>{BODY}<div class='related-work'><p>{PROSE}</p></div><section id=notice-of-intent>{PROSE}</section></article>", f"{MAIN}\n\n{PROSE}\n\n{PROSE}"),
        (f"<article>{BODY}<div class='related-posts'>{PROSE}</div><ul class=share-buttons><li>{PROSE}</ul></article>", MAIN),
        (f"<div>{BODY * 6}</div><nav>x</nav><article>one line</article>", None),
        (f"<main>{BODY}</main><section><article><a href=x>{PROSE}</a></article><article>{PROSE}</article></section>", MAIN),
        (f"<article>{BODY}</article><ol class=discussion><li>{BODY * 3}</ol>", MAIN),
        (f"<article>{BODY}</article><div id=comments>{BODY * 9}</div>", MAIN),
        (f"<div><article>{BODY}</article></div><div class=comments><article>{BODY * 9}</article></div>", MAIN),
    ],
)
def test_marked_wrappers_keep_the_article(page, want):
    got = html_text.main_text(page)
    assert got == want if want else got.startswith("\n\n".join([MAIN] * 6))


def test_window_changes_results_on_given_pages(spark):
    """Without article elements, on pages of the test tables, it is the window's width that joins an article's short lines."""
    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("html").collect()
    plain = [re.sub(r"</?(article|main)\b", lambda m: m[0].replace(m[1], "section"), r.html or "") for r in rows]
    assert sum(html_text.main_text(x, 1) != html_text.main_text(x, 8) for x in plain) > 0
