"""Nearest neighbours over blocks of queries and slices of vectors, against all pairs."""

from tracelake.operators import vectors


def test_blocks_and_slices_give_the_same_neighbours(spark, monkeypatch):
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 2)
    monkeypatch.setattr(vectors, "SLICE", 60)
    v = lambda i: [0.0, 0.0, 0.0] if i == 7 else [float(i % 5), float(i % 3 - 1), 1.0]
    rows = [(i, v(i), None if i == 9 else i % 4) for i in range(500)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    dot = lambda a, b: sum(x * y for x, y in zip(a, b)) / sum(x * x for x in a) ** 0.5 / sum(x * x for x in b) ** 0.5
    want = {q: [n for _, n in sorted(((round(dot(v(q), v(i)), 9), i) for i in range(500) if i not in (q, 7)), reverse=True)[:16]] for q in range(0, 500, 100)}
    got = {}
    for r in sorted(vectors.nearest(d).collect(), key=lambda r: (r["query"], r["rank"])):
        got.setdefault(r["query"], []).append(r["neighbour"])
    assert got == want
    assert vectors.nearest(d.limit(0)).count() == 0


def test_every_vector_is_a_query(spark, monkeypatch):
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 90)
    monkeypatch.setattr(vectors, "SLICE", 150)
    # copies of a vector, more than are looked for; two rows of one id; one of norm 0
    v = lambda i: [0.0, 0.0, 0.0] if i == 7 else [1.0, 2.0, 3.0] if i % 3 == 0 else [float(i % 17), float(i % 29 - 14), 1.0]
    ids = [*range(400), 11, 12]
    d = spark.createDataFrame([(i, v(i), i % 5) for i in ids], "vec_id long, embedding array<float>, label int")
    dot = lambda a, b: sum(x * y for x, y in zip(a, b)) / sum(x * x for x in a) ** 0.5 / sum(x * x for x in b) ** 0.5
    want = {q: sorted(((round(dot(v(q), v(i)), 9), i) for i in ids if i not in (q, 7)), reverse=True)[:16] for q in range(400) if q not in (7, 11, 12)}
    got = {}
    for r in sorted(vectors.nearest_of_all(d).collect(), key=lambda r: (r["query"], r["rank"])):
        got.setdefault(r["query"], []).append((round(r["score"], 9), r["neighbour"]))
    assert {q: x for q, x in got.items() if q not in (11, 12)} == want and set(got) == set(want) | {11, 12}
    assert vectors.cost_median(d).count() == 399
