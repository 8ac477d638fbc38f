"""What tool calls read and edit, whether that is in context already, and what the re-read gate decides.

Calls are (session, seq, tool, cmd, path, lo, hi, cwd): tool is bash (a cmd), read (a path and lines) or edit (a path). Files are
(session, path, seq, identity, ends): from `seq` on, that file has that identity, and `ends` are the bytes up to each line's end.
Curator rows are (session, base, seq, dropped, served): from `seq` on, those lines of the file of that base name (lower case) are
dropped from what the model sees, or were served to it again; each row stands for all before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import commands as C
from ..functions import lexer as X
from ..functions.text import one_of
from .dealt import dealt, parts
from .shell import judged_once

#: Where the made-up calls are run.
CWD = "/Repo/a"


def derived_calls(lineitem: DataFrame) -> DataFrame:
    """Compound, piped and quoted commands over files, one of fourteen forms for each order line."""
    s = lambda c: F.col(c).cast("string")
    ext = lambda c: F.get(F.array(*[F.lit(x) for x in ("py", "ts", "md", "Rs", "gz")]), (F.col(c) % 5).cast("int"))
    d = lineitem.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_suppkey").alias("session"), ((F.col("l_partkey") + F.col("l_linenumber")) % 14).cast("int").alias("form"), F.col("l_orderkey").alias("step"), F.col("l_linenumber").cast("long").alias("ln"),
        F.col("l_quantity").cast("long").cast("string").alias("n"), (F.col("l_quantity").cast("long") + 9).cast("string").alias("m"),
        F.concat(F.lit("src/f"), (F.col("l_partkey") % 40).cast("string"), F.lit("."), ext("l_partkey")).alias("p"), F.concat(F.lit("../tests/g"), (F.col("l_suppkey") % 40).cast("string"), F.lit("."), ext("l_suppkey")).alias("q"),
    )
    forms = [
        "cat {p}; head -n {n} {q}", "cat {p} | sed -n '{n},{m}p' | nl", 'cat "{p}" && tail -{n} {q}', "cat {p} | grep -n foo", "sed -n '{n},{m}p' {p} > /repo/out.md", "awk 'NR>={n} && NR<={m}' {p}", "awk 'NR=={n}' ./{p}",
        "echo 'a; cat {q}' ; nl {p} 2>&1 | tail -n {n}", "python -m pytest {p} | tail -40", "cat {p} <<EOF\ncat {q}\nEOF", "sed -i 's/a/b/' {p} && git checkout -- {q}", "tee {q} < {p} | cat", "less {p} {q} | head -{n}; more {p}", "cat 'it | {p}' /tmp/{q} >> {p}",
    ]

    def filled(form: str) -> Column:
        parts = [x for y in form.split("{") for x in (y.split("}") if "}" in y else [y, None][:1])]
        plain, out = form, []
        for x in parts:
            if x in ("p", "q", "n", "m") and plain.startswith("{" + x + "}"):
                out.append(s(x))
                plain = plain[3:]
            else:
                out.append(F.lit(x))
                plain = plain[len(x) :]
        return F.concat(*out)

    return d.withColumn("cmd", one_of(F.col("form"), [filled(f) for f in forms]))


def _each(d: DataFrame, elements: Column, name: str) -> DataFrame:
    """`d` without its last column and with `elements` of it, none null. An outer generator: for an inner one the optimizer infers that its
    array is neither null nor empty and computes the array once more for each of the two, on both sides of a join."""
    return d.select(*d.columns[:-1], elements).filter(F.col(name).isNotNull())


def shell_reads(calls: DataFrame) -> DataFrame:
    """One row for each file that a command reads."""
    rows = _each(judged_once(calls.select("id", "cmd"), ["cmd"], rs=X.shell_reads(F.col("cmd"), F.lit(CWD))).select("id", "rs"), F.explode_outer("rs").alias("r"), "r")
    return rows.select("id", *[F.col(f"r.{c}").alias(c) for c in ("path", "lo", "hi", "tail")])


def shell_edits(calls: DataFrame) -> DataFrame:
    """What each command edits: the base names of source files, and whether it may change any file."""
    d = judged_once(calls.select("id", "cmd"), ["cmd"], edited=F.array_join(X.shell_edits(F.col("cmd")), ","), mutates=X.mutates_all(F.col("cmd")))
    return d.select("id", "edited", "mutates").filter("edited <> '' OR mutates")


def derived_actions(lineitem: DataFrame) -> DataFrame:
    """Actions that write scripts by here-documents, to scratch files or not, or edit files by words and redirections."""
    s = lambda c: F.col(c).cast("string")
    d = lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), ((F.col("l_partkey") + F.col("l_linenumber")) % 7).cast("int").alias("form"), s("l_partkey").alias("p"), s("l_suppkey").alias("q"))
    forms = [
        "cat > /tmp/fix.py <<'EOF'\nopen('src/A%p.py', 'w')\n  EOF ; tee lib/b%q.py", "cat > src/new%p.py <<EOF\nopen('src/c%q.py','w')\nEOF", 'python /tmp/x.py >> /tmp/log%p.py > "tests/d%q.py"', "echo 1 > tmp/e%p.py; sed -i s/x/y/ pkg/F%q.PY other/f%q.rs",
        'cat >> "/tmp/run" <<-END\nstr_replace src/g%p.py\nno end', "ls src/h%p.py > out%q.txt > k/l%p.go", "apply_patch conftest.py src/m%p.c lib/test_n%q.py lib/m%p.c",
    ]
    filled = lambda x: F.replace(F.replace(F.lit(x), F.lit("%p"), F.col("p")), F.lit("%q"), F.col("q"))
    return d.select("id", one_of(F.col("form"), [filled(x) for x in forms]).alias("action"))


def action_edits(actions: DataFrame) -> DataFrame:
    """One row for each source file that an action edits. Hardly any action comes twice, so each is judged where it stands."""
    return _each(actions.select("id", X.action_edits(F.col("action")).alias("files")), F.posexplode_outer("files").alias("n", "file"), "file")


def range_tokens(ends: Column, lo: Column, hi: Column, tail: Column) -> Column:
    """A quarter of the bytes of the lines lo..hi, or of the last `tail` lines, by the running byte counts of the file's lines; no file: 0."""
    n = F.coalesce(F.size(ends), F.lit(0)).cast("long")
    first = F.when(tail.isNotNull(), F.greatest(n - tail, F.lit(0))).otherwise(F.greatest(lo, F.lit(1)) - 1)
    last = F.when(tail.isNotNull(), n).otherwise(F.greatest(first, hi))
    upto = lambda k: F.coalesce(F.get(ends, (F.least(k, n) - 1).cast("int")), F.lit(0))
    return F.floor((upto(last) - upto(first)) / 4).cast("long")


def call_targets(calls: DataFrame) -> DataFrame:
    """(session, seq, path, lo, hi, tail) of every file that a call reads."""
    cwd = F.col("cwd")
    one = X.tool_range(F.col("path"), F.col("lo"), F.when(F.col("hi").isNotNull(), F.col("hi") - F.coalesce("lo", F.lit(1)) + 1), cwd)
    by_cmd = judged_once(calls.filter("tool = 'bash'").select("session", "seq", "cmd", "cwd"), ["cmd", "cwd"], rs=X.shell_reads(F.col("cmd"), cwd)).select("session", "seq", "rs")
    by_path = calls.filter("tool = 'read'").select("session", "seq", F.filter(F.array(one), lambda r: r.isNotNull()).alias("rs"))
    return _each(by_cmd.unionByName(by_path), F.explode_outer("rs").alias("r"), "r").select("session", "seq", "r.*")


def _as_of(rows: DataFrame, facts: DataFrame, key: list[str], names: list[str]) -> DataFrame:
    """`rows` with the columns `names` of the last fact of the same key at or before their seq; null where there is none.

    Facts and rows of a key lie in one order, so no row meets more than one fact.
    """
    own = [c for c in rows.columns if c not in key + ["seq"]]
    kind = {f.name: f.dataType for f in rows.schema.fields}
    fact = F.struct(*names)
    one = rows.select(*key, "seq", F.lit(1).alias("_what"), F.struct(*own).alias("_own"), F.lit(None).alias("_fact"))
    two = facts.select(*key, "seq", F.lit(0).alias("_what"), F.lit(None).alias("_own"), fact.alias("_fact"))
    w = Window.partitionBy(*key).orderBy("seq", "_what").rowsBetween(Window.unboundedPreceding, 0)
    d = one.unionByName(two).withColumn("_fact", F.last("_fact", ignorenulls=True).over(w)).filter("_what = 1")
    return d.select(*key, "seq", *[F.col(f"_own.{c}").cast(kind[c]).alias(c) for c in own], *[F.col(f"_fact.{c}").alias(c) for c in names])


def with_files(targets: DataFrame, files: DataFrame) -> DataFrame:
    """`targets` with the identity of the file at that time and the tokens of the range; null and 0 where there is no such file."""
    d = _as_of(targets, files, ["session", "path"], ["identity", "ends"])
    return d.withColumn("tokens", range_tokens(F.col("ends"), F.col("lo"), F.col("hi"), F.col("tail"))).drop("ends")


def is_elided(lo: Column, hi: Column, dropped: Column, served: Column) -> Column:
    """Whether the lines lo..hi meet dropped lines that no single served range covers as far as they are asked for."""
    gap = lambda d: (F.greatest(lo, d["lo"]) <= F.least(hi, d["hi"])) & ~F.exists(served, lambda s: (s["lo"] <= F.greatest(lo, d["lo"])) & (s["hi"] >= F.least(hi, d["hi"])))
    return F.coalesce(F.exists(dropped, gap), F.lit(False))


def elided_ranges(requests: DataFrame, curated: DataFrame, n: int | None = None) -> DataFrame:
    """(key, id, elided): whether a request (key, id, lo, hi) meets dropped lines that no single served range covers as far as they are asked for.

    `curated` is (key, kind, lo, hi) with kind dropped or served. A sweep over first lines: at each, `cover` is the furthest end of the
    served ranges begun so far. Dropped lines that begin before the request leave a gap if their furthest end and the request's lie
    beyond the cover at its first line; of those that begin inside it the first that its own cover does not reach decides, as the cover
    only grows. So the rows stay as many as the input's, whatever overlaps. `n`: partitions.
    """
    null = F.lit(None).cast("long")
    rank = F.when(F.col("kind") == "served", 0).otherwise(2)
    d = requests.select("key", "lo", "hi", "id", F.lit(1).alias("rank")).unionByName(curated.select("key", "lo", "hi", null.alias("id"), rank.alias("rank")))
    d = dealt(d, n, "key")
    up = Window.partitionBy("key").orderBy("lo", "rank").rowsBetween(Window.unboundedPreceding, 0)
    end = lambda r: F.coalesce(F.max(F.when(F.col("rank") == r, F.col("hi"))).over(up), F.lit(-1))
    d = d.withColumns({"cover": end(0), "before": end(2)})
    gap = F.when((F.col("rank") == 2) & (F.col("cover") < F.col("hi")) & (F.col("lo") <= F.col("hi")), F.struct("lo", "cover"))
    down = Window.partitionBy("key").orderBy(F.col("lo").desc(), F.col("rank").desc()).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("next", F.last(gap, ignorenulls=True).over(down)).filter("rank = 1")
    left = (F.col("before") >= F.col("lo")) & (F.col("cover") < F.least("hi", "before"))
    inside = (F.col("next.lo") <= F.col("hi")) & (F.col("next.cover") < F.col("hi"))
    return d.select("key", "id", ((F.col("lo") <= F.col("hi")) & F.coalesce(left | inside, F.lit(False))).alias("elided"))


def gate_rows(calls: DataFrame, files: DataFrame, curated: DataFrame, overrides: DataFrame) -> DataFrame:
    """The rows of the gate's step function, one for each call: its targets with identity, tokens and elision, what it edits, and
    whether it repeats a command whose result is elided (`overrides`: session, seq, cmd; from `seq` on)."""
    targets = with_files(call_targets(calls), files).withColumn("base", F.lower(C.basename(F.col("path"))))
    targets = _as_of(targets, curated, ["session", "base"], ["dropped", "served"])
    targets = targets.withColumn("elided", is_elided(F.col("lo"), F.col("hi"), F.col("dropped"), F.col("served")))
    ask = F.struct("path", "lo", "hi", F.coalesce("tail", F.lit(-1)).alias("tail"), F.coalesce("identity", F.lit(-1)).alias("identity"), "tokens", F.coalesce("elided", F.lit(False)).alias("elided"))
    per_call = targets.groupBy("session", "seq").agg(F.array_sort(F.collect_list(ask)).alias("targets"))
    cmd = F.col("cmd")
    d = judged_once(calls, ["cmd"], norm=C.norm_cmd(F.coalesce(cmd, F.lit(""))), cmd_edits=X.shell_edits(cmd), any_file=X.mutates_all(cmd)).join(per_call, ["session", "seq"], "left")
    first = overrides.groupBy("session", C.norm_cmd(F.col("cmd")).alias("norm")).agg(F.min("seq").alias("since"))
    d = d.join(first, ["session", "norm"], "left")
    edit = F.when(F.col("tool") == "bash", F.col("cmd_edits")).when(F.col("tool") == "edit", F.array(X.absolute(F.col("path"), F.col("cwd"))))
    return d.select(
        "session", "seq", "tool", "norm", F.to_json(F.coalesce("targets", F.array())).alias("targets"), F.to_json(F.coalesce(edit, F.array())).alias("edits"),
        ((F.col("tool") == "bash") & F.col("any_file")).alias("mutates"), F.coalesce((F.col("norm") != "") & (F.col("since") <= F.col("seq")), F.lit(False)).alias("override"),
    )


def derived_session(lineitem: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Calls, files, curator rows and overrides from order lines: every fourth call a structured read, every seventh line an edit; each
    file has 200 lines of 40 bytes and changes once; every fifth line cuts lines of a file, every tenth serves some of them again."""
    seq = F.row_number().over(Window.partitionBy("session").orderBy("step", "ln", "id", "cmd")).cast("long")
    d = derived_calls(lineitem).withColumn("seq", seq)
    lo = F.col("n").cast("long")
    tool = F.when(F.col("ln") == 7, "edit").when(F.col("ln") == 4, "read").otherwise("bash")
    named = F.when(tool != "bash", F.col("p"))
    calls = d.select("session", "seq", tool.alias("tool"), F.when(tool == "bash", F.col("cmd")).alias("cmd"), named.alias("path"), F.when(tool == "read", lo).alias("lo"), F.when(tool == "read", lo + 30).alias("hi"), F.lit(CWD).alias("cwd"))
    paths = call_targets(calls).select("session", "path").distinct()
    ends = F.transform(F.sequence(F.lit(1), F.lit(200)), lambda k: (k * 40).cast("long"))
    files = paths.select("session", "path", F.explode(F.array(F.lit(0), F.lit(60))).alias("seq")).select("session", "path", F.col("seq").cast("long").alias("seq"), F.col("seq").cast("long").alias("identity"), ends.alias("ends"))
    one = lambda a, b: F.array(F.struct(a.alias("lo"), b.alias("hi")))
    none = F.array().cast("array<struct<lo:bigint,hi:bigint>>")
    cut = d.filter("ln = 5 AND id % 3 = 0").select("session", F.lower(C.basename(F.col("p"))).alias("base"), "seq", one(lo, lo + 20).alias("dropped"), F.when(F.col("id") % 2 == 0, one(lo - 1, lo + 30)).otherwise(none).alias("served"))
    overrides = d.filter("form = 8 AND seq % 5 = 0").select("session", "seq", "cmd")
    return calls, files, cut, overrides


def derived_elisions(lineitem: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests and curator rows of one key for each supplier, from order lines: a third dropped, a third served, the rest asked for."""
    d = lineitem.select(F.col("l_suppkey").alias("key"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_partkey") * 7 % 5000).alias("lo"), (F.col("l_orderkey") % 6).alias("kind"), F.col("l_quantity").cast("long").alias("n"))
    d = d.withColumn("hi", F.col("lo") + F.when(F.col("kind") == 2, F.col("n") * 6).otherwise(F.col("n")) - 3)
    curated = d.filter("kind IN (0, 2)").select("key", F.when(F.col("kind") == 0, "dropped").otherwise("served").alias("kind"), "lo", "hi")
    return d.filter("kind NOT IN (0, 2)").select("key", "id", "lo", "hi"), curated


def elisions(lineitem: DataFrame) -> DataFrame:
    return elided_ranges(*derived_elisions(lineitem), parts(lineitem))
