"""What shell commands read, and observations cut to chunks by the command that made them. A row is (id, cmd, ...)."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import commands as C
from ..functions.text import chunk_key, fingerprint, human_tokens, one_of, salted_id, splitlines, token_estimate

WINDOW_LINES = 40
ATOM_LINES = 10


def derived_shell(lineitem: DataFrame) -> DataFrame:
    """Commands over files from order lines, one of seven forms each."""
    ext = F.element_at(F.array(*[F.lit(x) for x in (".py", ".ts", ".md", ".Txt", "", ".tar.gz", "_test.py")]), (F.col("l_suppkey") % 7 + 1).cast("int"))
    top = F.element_at(F.array(*[F.lit(x) for x in ("src", "tests", "Docs", "lib")]), (F.col("l_partkey") % 4 + 1).cast("int"))
    d = lineitem.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_suppkey").alias("conv"), F.col("l_orderkey").alias("step"), F.col("l_quantity").cast("long").alias("lo"), (F.col("l_extendedprice").cast("long") % 50 * 100_000 + 100).alias("tokens"),
        F.concat(F.lit("/Repo/"), top, F.lit("/plan-"), (F.col("l_partkey") % 50).cast("string"), ext).alias("path"), (F.col("l_linenumber") % 7).cast("long").alias("form"),
    )
    lo, hi = F.col("lo").cast("string"), (F.col("lo") + 9).cast("string")
    forms = [
        F.concat(F.lit("sed -n '"), lo, F.lit(","), hi, F.lit("p' "), F.col("path"), F.lit(" | head -5")), F.concat(F.lit("cat  "), F.col("path"), F.lit(";\tls")), F.concat(F.lit("head -n "), lo, F.lit(" "), F.col("path"), F.lit(" && tail -3 \""), F.col("path"), F.lit("\"")),
        F.concat(F.lit("grep -n foo "), F.col("path")), F.concat(F.lit("awk 'NR>="), lo, F.lit(" && NR<="), hi, F.lit("' "), F.col("path")), F.concat(F.lit("sed -n "), lo, F.lit("p "), F.col("path")), F.lit("python -m pytest tests"),
    ]
    return d.withColumn("cmd", one_of(F.col("form"), forms))


def judged_once(d: DataFrame, keys: list[str], **columns: Column) -> DataFrame:
    """`d` with `columns` that follow from `keys` alone: each distinct value of the keys is judged once and joined back, null to null."""
    once = d.select(*keys).distinct().select(*[F.col(k).alias(f"_{k}") for k in keys], *[c.alias(name) for name, c in columns.items()])
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return d.join(once.hint("shuffle_hash"), same).drop(*[f"_{k}" for k in keys])


def command_fields(d: DataFrame) -> DataFrame:
    """Each command's file, first line and trust, and each path's class."""
    c, p = F.col("cmd"), F.col("path")
    d = judged_once(
        d, ["cmd", "path"], first_file=C.first_file(c), base=C.sed_base(c), trusted=C.coords_trusted(c), norm=C.norm_cmd(c), norm_path=C.path_norm(p), ext=C.ext_class(C.basename(p)), is_test=C.is_test_path(p),
        planning=C.planning_doc(p), n_paths=F.size(C.path_tokens(c)), fp=fingerprint(c), own=chunk_key(F.lit(""), F.lit("read"), c), salted=salted_id(F.lit("salt"), c),
    )
    key = F.concat(F.coalesce(F.col("conv").cast("string"), F.lit("")), F.when(F.col("conv").isNull(), F.substring("own", 2, 1 << 30)).otherwise(F.col("own")))
    return d.select("id", "first_file", "base", "trusted", "norm", F.col("norm_path").alias("path"), "ext", "is_test", "planning", "n_paths", human_tokens(F.col("tokens")).alias("label"), "fp", key.alias("key"), "salted")


def command_targets(d: DataFrame) -> DataFrame:
    """One row for each file range that a command reads."""
    return d.select("id", F.posexplode(C.read_targets(F.col("cmd"))).alias("n", "t")).select("id", "n", F.col("t.path").alias("path"), F.col("t.lo").alias("lo"), F.col("t.hi").alias("hi"))


def command_reads(d: DataFrame) -> DataFrame:
    """One row for each file that a command names, with its line range; no bounds: the whole file."""
    return d.select("id", F.posexplode(C.parse_reads(F.col("cmd"))).alias("n", "t")).select("id", "n", F.col("t.file").alias("file"), F.col("t.lo").alias("lo"), F.col("t.hi").alias("hi"))


def patch_hunks(lines: DataFrame) -> DataFrame:
    """(id, file, lo, hi) of the original side of each hunk, from (id, line_no, line): the latest `+++ b/` line names the file."""
    w = Window.partitionBy("id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    file = C.basename(F.trim(F.nullif(F.regexp_extract("line", r"^\+\+\+ b/(.+)$", 1), F.lit(""))))
    hunk = r"^@@ -(\d+)(?:,(\d+))? \+\d+(?:,\d+)? @@"
    lo, n = (F.nullif(F.regexp_extract("line", hunk, k), F.lit("")).try_cast("long") for k in (1, 2))
    d = lines.withColumn("file", F.last(file, ignorenulls=True).over(w)).withColumn("lo", lo).withColumn("n", n).filter("lo IS NOT NULL AND file IS NOT NULL")
    return d.select("id", "file", "lo", (F.col("lo") + F.greatest(F.lit(1), F.coalesce("n", F.lit(1))) - 1).alias("hi"))


def derived_patch(lineitem: DataFrame) -> DataFrame:
    """Lines of one diff for each order: a file line, a hunk, context; the first line of all is a hunk without a file."""
    o = lineitem.select(F.col("l_orderkey").alias("id"), F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_quantity")).alias("k"), F.col("l_partkey").alias("p"), F.col("l_quantity").cast("long").alias("q"))
    s = lambda c: F.col(c).cast("string")
    lines = F.array(F.concat(F.lit("@@ -"), s("q"), F.lit(" +1 @@")), F.concat(F.lit("+++ b/src/f"), s("p"), F.lit(".py ")), F.concat(F.lit("@@ -"), s("q"), F.lit(","), (F.col("p") % 3).cast("string"), F.lit(" +7,2 @@ def f")), F.lit(" context @@ -1 +1 @@"))
    return o.select("id", F.posexplode(lines).alias("i", "line"), "k").select("id", (F.col("k") * 4 + F.col("i")).alias("line_no"), "line")


def derived_observations(documents: DataFrame) -> DataFrame:
    """A document's text as the output of a read, a search or another command."""
    kind = F.col("doc_id") % 3
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.when((kind == 1) & (i % 3 == 0), F.concat(F.lit("src/f"), i.cast("string"), F.lit(".py:"), (i + 5).cast("string"), F.lit(": "), x)).otherwise(x))
    cmd = F.when(kind == 0, F.concat(F.lit("sed -n '"), F.col("doc_id").cast("string"), F.lit(",99999p' /r/doc.py"))).when(kind == 1, F.lit("grep -rn word src")).otherwise(F.lit("python run.py"))
    return documents.filter("text IS NOT NULL").select(F.col("doc_id").alias("id"), cmd.alias("cmd"), F.array_join(lines, "\n").alias("obs"))


def chunk_observations(d: DataFrame, window: int = WINDOW_LINES, atom: int | None = ATOM_LINES) -> DataFrame:
    """(id, kind, file, lo, hi, text, n) of observations (id, cmd, obs).

    A read gives atoms of `atom` lines with content, numbered as lines of the file; a search one chunk for each result line and
    windows of the lines between them; anything else windows of `window` lines. Windows without content go; an observation that
    would have no chunk at all is one chunk. Without `atom` a read gives windows of `window` lines as they come, blank ones too.
    """
    search, read = F.col("cmd").rlike(C.SEARCH_VERBS), F.col("cmd").rlike(C.READ_VERBS)
    d = d.withColumns({"kind": F.when(search, "grep").when(read, "read").otherwise("other"), "base": C.sed_base(F.col("cmd")), "first": C.first_file(F.col("cmd"))})
    full = d.select("id", "kind", "base", "first", F.posexplode(splitlines(F.col("obs"))).alias("i", "line")).withColumn("has", F.col("line").rlike(r"[^\s]"))
    by_line = Window.partitionBy("id").orderBy("i")
    upto = by_line.rowsBetween(Window.unboundedPreceding, 0)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]), "\n")

    atoms = full.filter("kind = 'read'" if atom is None else "kind = 'read' AND has")
    atoms = atoms.withColumn("g", F.floor(F.col("i") / window) if atom is None else F.floor((F.row_number().over(by_line) - 1) / atom))
    atoms = atoms.groupBy("id", "g").agg(F.first("first").alias("file"), F.min(F.col("base") + F.col("i")).alias("lo"), F.max(F.col("base") + F.col("i")).alias("hi"), text.alias("text"), F.min("i").alias("at"))
    atoms = atoms.select("id", F.lit("read").alias("kind"), "file", "lo", "hi", "text", "at")

    hits = full.filter("kind = 'grep'").withColumn("hit", C.grep_candidate(F.col("line")))
    runs = hits.withColumn("run", F.count("hit").over(upto)).filter("hit IS NULL")
    runs = runs.withColumn("g", F.floor((F.row_number().over(Window.partitionBy("id", "run").orderBy("i")) - 1) / window))
    plain = full.filter("kind = 'other'").select("id", "i", "line", "has", F.lit(-1).cast("long").alias("run"), F.floor(F.col("i") / window).alias("g"))
    windows = runs.select("id", "i", "line", "has", "run", "g").unionByName(plain).groupBy("id", "run", "g").agg(text.alias("text"), F.max("has").alias("has"), F.min("i").alias("at")).filter("has")
    none = F.lit(None).cast("long")
    windows = windows.select("id", F.lit("other").alias("kind"), F.lit(None).cast("string").alias("file"), none.alias("lo"), none.alias("hi"), "text", "at")
    found = hits.filter("hit IS NOT NULL").select("id", F.lit("grep").alias("kind"), F.col("hit.file").alias("file"), F.col("hit.line").alias("lo"), F.col("hit.line").alias("hi"), F.col("line").alias("text"), F.col("i").alias("at"))

    cut = atoms.unionByName(windows).unionByName(found)
    # Every line with content is in a chunk, and without atoms every line of a read is; so the text tells alone whether there is one.
    lines = splitlines(F.col("obs"))
    content = F.exists(lines, lambda x: x.rlike(r"[^\s]"))
    chunked = content if atom is not None else F.when(F.col("kind") == "read", F.size(lines) > 0).otherwise(content)
    bare = d.filter(~F.coalesce(chunked, F.lit(False))).select("id", F.when(F.col("kind") == "read", "read").otherwise("other").alias("kind"), F.when(F.col("kind") == "read", F.col("first")).alias("file"), none.alias("lo"), none.alias("hi"), F.col("obs").alias("text"), F.lit(0).alias("at"))
    return cut.unionByName(bare).withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("at")).cast("long") - 1).drop("at")


def observation_chunks(documents: DataFrame, **how) -> DataFrame:
    d = chunk_observations(derived_observations(documents), **how)
    return d.select("id", "n", "kind", "file", "lo", "hi", token_estimate(F.col("text")).alias("tokens"), F.sha2("text", 256).alias("sha"))


def fold(calls: DataFrame, tau_q: int, min_tokens: int = 10) -> DataFrame:
    """The decisions of the context fold, from chunks (conv, gi, step, owner, cmd, tokens, score_q) of observations; cmd null: no call.

    A chunk is a candidate if its score is below the threshold and its run of neighbouring candidates of one owner has
    `min_tokens`. The override valve: a call whose output was cut is served in full when it comes again, whatever its scores, and
    counts as never cut from then on. So in each (conv, cmd) the steps that would be cut alternate, cut first, and a step that would
    not begins anew: a position within a run of such steps, no replay; a step is insisted on if the one before it was cut.
    """
    below = calls.withColumn("cut", F.col("score_q") < tau_q)
    runs = below.filter("cut").withColumn("run", F.col("gi") - F.row_number().over(Window.partitionBy("conv", "owner").orderBy("gi")))
    mass = F.sum("tokens").over(Window.partitionBy("conv", "owner", "run"))
    would = runs.withColumn("mass", mass).filter(F.col("mass") >= min_tokens).select("conv", "gi", F.lit(True).alias("would"))
    d = calls.join(would, ["conv", "gi"], "left").withColumn("would", F.coalesce("would", F.lit(False)))
    s = d.groupBy("conv", "cmd", "step", "owner").agg(F.max("would").alias("w"))
    by_step = Window.partitionBy("conv", "cmd").orderBy("step", "owner")
    s = s.withColumn("anew", F.sum(F.when(F.col("w"), 0).otherwise(1)).over(by_step))
    nth = F.row_number().over(Window.partitionBy("conv", "cmd", "anew", "w").orderBy("step", "owner"))
    s = s.withColumn("was_cut", F.col("w") & (nth % 2 == 1))
    s = s.select("conv", "step", "owner", (F.col("cmd").isNotNull() & F.coalesce(F.lag("was_cut").over(by_step), F.lit(False))).alias("insisted"))
    d = d.join(s, ["conv", "step", "owner"])
    return d.select("conv", "gi", "step", "insisted", (F.col("would") & ~F.col("insisted")).alias("cut"))
