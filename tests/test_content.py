"""Small cases of content columns and of the writers."""

from pyspark.sql import functions as F

from tracelake.functions import content as c
from tracelake.operators import content as ops
from tracelake.sources import lines, sinks


def one(spark, json, column):
    return spark.createDataFrame([(json,)], "j string").select(F.try_parse_json("j").alias("v")).select(column(F.col("v")).alias("x")).first().x


def test_content_of_odd_shapes_is_empty(spark):
    for json in (None, "null", "5", "{}", "[]", '[null, 3, "a", {"type": "text"}, {"type": "text", "text": 5}]', "broken"):
        assert one(spark, json, c.content_text) == ""
        assert one(spark, json, c.item_text) == ""
    assert one(spark, '[{"type":"text","text":""},{"type":"text"},{"type":"text","text":"a"}]', c.system_text) == "\n\na"


def test_keys_ignore_marks_and_nothing_else(spark):
    key = lambda j: one(spark, j, c.content_key)
    marked = '[{"type":"tool_result","content":[{"type":"text","cache_control":{"ttl":"1h"},"text":"a"}]},4]'
    assert key(marked) == key('[{"content":[{"text":"a","type":"text"}],"type":"tool_result"},4]')
    assert len({key(j) for j in ('"a"', '["a"]', '[{"t":"a"}]', '[{"t":["a"]}]', '[{"t":5}]', '[{"t":"5"}]', "null")}) == 7


def test_paths(spark):
    d = spark.createDataFrame([("a/../../b", "/w"), ("../../..", "/w"), ("'x y.py'", "c:\\p\\"), ("D:/q/./r", "/w"), (None, "/w"), ("", "/w")], "p string, cwd string")
    assert [r.x for r in d.select(c.absolute(F.col("p"), F.col("cwd")).alias("x")).collect()] == ["/b", "/", "/c:/p/x y.py", "/D:/q/r", None, "/w"]


def test_an_action_that_is_no_string_gives_the_text(spark):
    assert one(spark, '{"content":"t","extra":{"actions":[{"command":["a"]},{"command":"b"}]}}', c.action_text) == "t"
    assert one(spark, '{"content":"t","tool_calls":[{"function":{"arguments":"{\\"query\\":7}"}}]}', c.action_text) == "t"
    assert one(spark, '{"content":"t","tool_calls":[{"function":{"arguments":"{\\"x\\":7}"}}]}', c.action_text) == '{"x":7}'
    assert one(spark, "{}", c.action_text) == ""


def test_a_payload_is_taken_once(spark):
    schema = "project long, tool string, id long, at long"
    staged = spark.createDataFrame([(1, "x", 1, 0, "v"), (1, "x", 2, 10, "v"), (2, "x", 3, 0, "v"), (3, "x", 4, 0, "w"), (4, "x", 5, 0, None)], f"{schema}, version string")
    asks = spark.createDataFrame([(1, "x", 7, 10), (1, "x", 8, 11), (2, "x", 9, 5000), (3, "x", 10, 1), (4, "x", 11, 1)], schema)
    assert {(r.id, r.ask) for r in ops.taken_payloads(staged, asks, "v").collect()} == {(1, None), (2, 7), (3, None), (4, None), (5, None)}


def test_means_and_empty_tables(spark):
    d = spark.createDataFrame([(1, [1.0, 3.0], [9.0]), (1, [3.0, 5.0], [9.0])], "conv long, v array<double>, state array<double>")
    assert ops.pooled(d).first().pooled == [2.0, 4.0, 9.0]
    assert ops.pooled(d.limit(0)).count() == 0
    assert ops.lifetime(spark.createDataFrame([], "blocked long, tokens long, loops long")).first().blocked == 0


def test_lines_append_and_read_back(spark, tmp_path):
    path = f"file://{tmp_path}/ledger"
    rows = spark.createDataFrame([("a", 1, 5, 3), ("b", 2, None, 4)], "request_id string, session_id long, counterfactual_input_tokens long, billed_input_tokens long").select(F.lit(lines.LEDGER_VERSION).alias("contract_version"), "*")
    sinks.append_lines(rows, path)
    sinks.append_lines(rows.limit(0), path)
    sinks.append_lines(rows.filter("request_id = 'a'"), path)
    text = lines.text_lines(spark, path)
    assert not any("counterfactual" in r.line for r in text.collect() if '"b"' in r.line)
    assert sorted(map(tuple, lines.ledger(text).collect())) == [("a", 1, 5, 3), ("a", 1, 5, 3), ("b", 2, None, 4)]


def test_a_stream_writes_each_row_once(spark, tmp_path):
    source, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    for k in range(2):
        spark.createDataFrame([(k,)], "k long").write.mode("append").parquet(source)
        stream = spark.readStream.schema("k long").parquet(source)
        assert sinks.stream_lines(stream, out, f"file://{tmp_path}/check").awaitTermination(60)
    assert sorted(r.value for r in spark.read.text(out).collect()) == ['{"k":0}', '{"k":1}']


def test_exports_replace_their_sessions_only(spark, tmp_path):
    path = f"file://{tmp_path}/exports"
    schema = "session string, base string, lo long, hi long"
    sinks.replace_exports(spark.createDataFrame([("s", "f", 1, 2), ("s", "g", 1, 2), ("t", "f", 3, 4)], schema), spark.createDataFrame([("s",), ("t",)], "session string"), path)
    sinks.replace_exports(spark.createDataFrame([("s", "h", 5, 6)], schema), spark.createDataFrame([("s",)], "session string"), path)
    assert {(r.session, r.base) for r in sinks.exported(spark, path).collect()} == {("s", "h"), ("t", "f")}
    sinks.replace_exports(spark.createDataFrame([], schema), spark.createDataFrame([("t",)], "session string"), path)
    assert {r.session for r in sinks.exported(spark, path).collect()} == {"s"}


def test_bodies_are_kept_as_they_came(spark, tmp_path):
    path = f"file://{tmp_path}/bodies"
    sinks.record_bodies(spark.createDataFrame([("c", 1, ' {"a" : 1} '), ("c", 2, None)], "conv string, turn long, body string"), path)
    assert {(r.turn, r.body) for r in spark.read.parquet(path).collect()} == {(1, ' {"a" : 1} '), (2, None)}
