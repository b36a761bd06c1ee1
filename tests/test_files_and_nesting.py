"""The data source and its two-phase writer, the table function, nested spans, JSON paths and concatenation in parts."""

import io
import os
import random
import tarfile

import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as X
from quillspark.operators import rows as R
from quillspark.plans import api
from quillspark.sinks import files as sink
from quillspark.sources.files import FilesWriter, register_files, shares, zipped


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "in/sub").mkdir(parents=True)
    (tmp_path / "in/a.json").write_bytes(b"[1]")
    (tmp_path / "in/_hidden").write_bytes(b"no")
    (tmp_path / "in/sub/m.zip").write_bytes(zipped({f"dir/m{k}.json": b"[2]" * (k + 1) for k in range(30)} | {"empty": b""}))
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as t:
        for k in range(3):
            info = tarfile.TarInfo(f"t{k}.txt")
            info.size = 5
            t.addfile(info, io.BytesIO(b"tar-%d" % k))
    (tmp_path / "in/t.tar.gz").write_bytes(out.getvalue())
    return tmp_path


def test_files_and_members_are_read(spark, folder):
    register_files(spark)
    whole = spark.read.format("quill").load(str(folder / "in")).collect()
    assert {os.path.basename(r["path"]) for r in whole} == {"a.json", "m.zip", "t.tar.gz"} and all(r["member"] is None and r["length"] == len(r["content"]) for r in whole)
    df = spark.read.format("quill").option("archives", "true").option("partitionBytes", "200").load(f"file://{folder}/in")
    found = {(os.path.basename(r["path"]), r["member"]): bytes(r["content"]) for r in df.collect()}
    want = {("a.json", None): b"[1]", ("m.zip", "empty"): b""} | {("m.zip", f"dir/m{k}.json"): b"[2]" * (k + 1) for k in range(30)} | {("t.tar.gz", f"t{k}.txt"): b"tar-%d" % k for k in range(3)}
    assert found == want
    assert df.select(F.spark_partition_id()).distinct().count() > 4  # an archive's members are dealt out
    one = spark.read.format("quill").option("pathGlobFilter", "*.json").load(str(folder / "in"))
    assert [bytes(r["content"]) for r in one.collect()] == [b"[1]"]
    assert api.convert(one).first()["output"] == "- 1\n\n"
    os.makedirs(folder / "none")
    assert spark.read.format("quill").load(str(folder / "none")).collect() == []
    with pytest.raises(Exception, match="FileNotFound"):
        spark.read.format("quill").load(str(folder / "nowhere")).collect()


def test_shares_are_bounded_by_bytes():
    made = shares([(("a", f"m{k}"), size) for k, size in enumerate([5, 5, 5, 40, 1, 1, 9])], 10)
    assert [s.size for s in made] == [10, 5, 40, 2, 9] and [i for s in made for i in s.items] == [("a", f"m{k}") for k in range(7)]


def test_a_task_that_fails_midway_leaves_no_file(spark, tmp_path):
    register_files(spark)
    bad = F.when(F.col("id") == 390, F.raise_error(F.lit("midway")).cast("string")).otherwise(F.concat(F.lit("text "), F.col("id").cast("string")))
    rows = spark.range(400).repartition(6, "id").select(F.concat("id", F.lit(".txt")).alias("output_name"), bad.alias("output"))
    with pytest.raises(Exception, match="midway"):
        rows.write.format("quill").mode("append").save(str(tmp_path / "out"))
    assert [p for p in os.listdir(tmp_path / "out") if not p.startswith("_")] == []
    good = rows.filter("output_name <> '390.txt'")
    good.write.format("quill").mode("append").save(str(tmp_path / "out"))
    names = [p for p in os.listdir(tmp_path / "out") if not p.startswith("_")]
    assert len(names) == 399 and (tmp_path / "out/7.txt").read_text() == "text 7"
    data = spark.createDataFrame([("7.txt", bytearray(b"\x00\xff")), ("new", None)], "output_name string, output_data binary")
    data.write.format("quill").mode("overwrite").save(str(tmp_path / "out"))
    assert {p: (tmp_path / "out" / p).read_bytes() for p in os.listdir(tmp_path / "out") if not p.startswith("_")} == {"7.txt": b"\x00\xff", "new": b""}


@pytest.mark.parametrize("name", ["../x", "", "..", "a/b"])
def test_names_that_lead_elsewhere_are_refused(spark, tmp_path, name):
    register_files(spark)
    with pytest.raises(Exception, match="not a file's name"):
        spark.createDataFrame([(name, "x")], "output_name string, output string").write.format("quill").mode("append").save(str(tmp_path / "out"))


def test_a_name_of_two_rows_fails_before_anything_is_moved(spark, tmp_path):
    """Whether one task has both rows or two tasks have one each; an attempt that does not count leaves nothing."""
    from pyspark.sql import Row

    register_files(spark)
    for parts in (1, 2):
        rows = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("a", "4")], "output_name string, output string").repartition(parts)
        with pytest.raises(Exception, match="two rows have the name a"):
            rows.write.format("quill").mode("append").save(str(tmp_path / "out"))
        assert [p for p in os.listdir(tmp_path / "out") if not p.startswith("_")] == []
    w = FilesWriter({"path": str(tmp_path / "again")}, False)
    w.write(iter([Row(output_name="x", output="lost attempt")]))
    kept = w.write(iter([Row(output_name="x", output="kept")]))
    w.commit([kept, None])
    assert os.listdir(tmp_path / "again") == ["x"] and (tmp_path / "again/x").read_text() == "kept"


def test_blocks_as_a_table_function(spark):
    api.register_sql(spark)
    df = spark.createDataFrame([(1, b"# A\n\nx\n", "markdown-docx"), (2, b'{"a":1}', "json"), (3, None, "json"), (4, b"[1", "json")], "id int, data binary, format string")
    df.createOrReplaceTempView("quill_inputs")
    found = spark.sql("SELECT id, b.* FROM quill_inputs, LATERAL blocks(data, format) AS b").collect()
    assert {r["id"] for r in found if r["error"]} >= {3, 4} and [r["kind"] for r in found if r["id"] == 2] == ["table"] or [r["kind"] for r in found if r["id"] == 2] == ["kv"]
    mine = api.document_blocks(df.filter("id = 2").withColumnRenamed("data", "content").drop("format"), path=None, format="json").collect()
    assert [(r["block_id"], r["kind"], r["md"]) for r in mine] == [(r["block_id"], r["kind"], r["md"]) for r in found if r["id"] == 2]


def scanned(s):
    """By character: two openings go one deeper, two closings, when inside, one up; what is inside is left out."""
    out, depth, k = [], 0, 0
    while k < len(s):
        two = s[k : k + 2]
        if two == "{{":
            depth, k = depth + 1, k + 2
        elif two == "}}" and depth:
            depth, k = depth - 1, k + 2
        else:
            out += [s[k]] if not depth else []
            k += 1
    return "".join(out)


def test_nested_spans_against_a_scan(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choice("{{{}}}ab\n") for _ in range(rng.randint(0, 60))) for _ in range(600)] + [None, "", "{{" * 50 + "x" + "}}" * 50 + "y", "}}}} {{ never closed", "é{{ß}}日"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id int, text string").repartition(3)
    found = {r["id"]: r["text"] for r in R.without_nested(df, ["id"], "text").collect()}
    assert found == {k: None if t is None else scanned(t) for k, t in enumerate(texts)}
    plan = R.without_nested(df, ["id"], "text")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "ArrowEval" not in plan


def test_tags_with_their_spans_go(spark):
    cases = {"a<ref>x</ref>b": "ab", "a<ref name=q/>b": "ab", "a<ref name=q>x<br/>y</ref>b<ref>c": "abc", "a<ref": "a", "a<ref>\nx\n</ref>": "a", "<references/>x": "x", "no": "no", "": ""}
    df = spark.createDataFrame(list(cases.items()), "text string, want string")
    assert [r for r in df.select("text", "want", X.strip_tag(F.col("text"), "ref").alias("found")).collect() if r["want"] != r["found"]] == []


def test_json_paths_at_any_depth(spark):
    deep = "[" * 12 + "1" + "]" * 12
    df = spark.createDataFrame([(1, '{"a":[1,{"b":null}],"c":"x","d":{"e":{}}}'), (2, None), (3, "[1.5,"), (4, "true"), (5, deep), (6, '"q"'), (7, '{"k":1,"k":2}')], "id int, js string")
    found = R.json_paths(df, ["id"], "js").collect()
    assert {(r["path"], r["kind"], r["value"]) for r in found if r["id"] == 1} == {("$", "object", None), ("$.a", "array", None), ("$.a[0]", "number", "1"), ("$.a[1]", "object", None), ("$.a[1].b", "null", None), ("$.c", "string", "x"), ("$.d", "object", None), ("$.d.e", "object", None)}
    assert [tuple(r) for r in found if r["id"] in (2, 3, 7)] and not any(r["id"] == 2 for r in found) and {r["kind"] for r in found if r["id"] in (3, 7)} == {"invalid"}
    assert sorted(r["path"] for r in found if r["id"] == 5) == ["$" + "[0]" * k for k in range(13)]
    assert R.json_paths(df.limit(0), ["id"], "js").collect() == []


def test_json_paths_are_one_pass_over_the_texts(spark, sf_dir):
    """A text is not parsed again for each of its levels; strings that hold brackets are no levels."""
    from quillspark.queries import QUERIES

    plan = QUERIES["json_paths_events"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 1 and "Union" not in plan
    df = spark.createDataFrame([(1, '["[[{\\"[", "\\\\", [[[1.0]]]]'), (2, "[" * 300)], "id int, js string")
    assert R.json_paths(df, ["id"], "js").filter("kind = 'number'").collect() == [(1, "$[2][0][0][0]", "number", "1")]
    assert R.json_paths(df, ["id"], "js").filter("id = 2").collect() == [(2, "$", "invalid", None)]


def test_parts_follow_each_other(spark):
    """One key with nearly all texts: no task has more than its share of them, and the parts make the whole."""
    rows = spark.range(3000).selectExpr("CASE WHEN id % 50 = 0 THEN NULL WHEN id % 51 = 0 THEN 'few' ELSE 'most' END AS key", "id", "CASE WHEN id % 9 <> 0 THEN repeat(concat('é', id), 5) END AS output").repartition(5)
    parts = sink.concatenated_parts(rows, "id", "output", "key", part_bytes=1000, ranges=8)
    found = parts.collect()
    whole = {r["key"]: r["document"] for r in sink.concatenated(rows, "id", "output", "key").collect()}
    for key, want in whole.items():
        mine = sorted((r for r in found if r["key"] == key), key=lambda r: r["part"])
        assert "".join(r["document"] for r in mine) == want
        at = 0
        for r in mine:
            assert r["start"] == at and r["start"] // 1000 == r["part"]
            at += len(r["document"].encode())
    assert len(found) > 60 and max(len(r["document"].encode()) for r in found) < 1200
    assert sink.concatenated_parts(rows.limit(0), "id", "output", "key").collect() == []
    assert sink.concatenated_parts(rows, "id", "output").agg(F.sum(F.octet_length("document"))).first()[0] == len(sink.concatenated(rows, "id").first()["document"].encode())
    spark.catalog.clearCache()


def test_latex_escapes_of_texts_with_the_stand_in(spark):
    table = {"&": "\\&", "%": "\\%", "$": "\\$", "#": "\\#", "_": "\\_", "{": "\\{", "}": "\\}", "~": "\\textasciitilde{}", "^": "\\textasciicircum{}", "\\": "\\textbackslash{}"}
    rng = random.Random(3)
    texts = ["".join(rng.choice("\\{}~^&%$#_ab\ue000é") for _ in range(30)) for _ in range(300)] + ["", "plain", "\ue000", "\\", "\\{}"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.latex_escape(F.col("t")).alias("x"))
    assert all(r["x"] == "".join(table.get(c, c) for c in r["t"]) for r in df.collect())


def fenced_by_scan(lines):
    import re

    out, state = [], ""
    for line in lines:
        m = re.fullmatch("( {0,3})(`{3,}|~{3,})(.*)", line)
        mark = m[2] if m and (m[2][0] == "~" or "`" not in m[3]) else ""
        out.append(bool(state or mark))
        if not state:
            state = mark
        elif mark and not m[3].strip(" \t\r") and mark[0] == state[0] and len(mark) >= len(state):
            state = ""
    return out


@pytest.mark.parametrize("chunk", [4096, 7])
def test_fences_against_a_scan(spark, chunk):
    """Also where a document is cut into many chunks, and these into chunks again."""
    rng = random.Random(10)
    kinds = ["```", "````", "`````", "~~~", "~~~~", "``` py", "~~~ ~ x", "``` a`b", "    ```", "  ~~~", "# head", "text", "", "``", "```  \t"]
    texts = {k: [rng.choice(kinds) for _ in range(n)] for k, n in enumerate([0, 1, 2, 5, 30, 60, 500, 80])}
    rows = [(k, n, line) for k, lines in texts.items() for n, line in enumerate(lines)] + [(None, n, line) for n, line in enumerate(texts[4])]
    df = spark.createDataFrame(rows, "doc int, n int, line string").repartition(3)
    found = {}
    for r in R.fenced(df, ["doc"], "n", "line", chunk=chunk).collect():
        found.setdefault(r["doc"], {})[r["n"]] = r["fenced"]
    assert {k: [v[n] for n in range(len(v))] for k, v in found.items()} == {k: fenced_by_scan(x) for k, x in [*texts.items(), (None, texts[4])] if x}
    assert R.fenced(df.limit(0), ["doc"], "n", "line").collect() == []


def test_a_heading_in_a_fence_starts_no_chapter(spark):
    lines = ["# one", "```", "# not", "```", "#two", "# three", "~~~~", "# no", "~~~", "# no", "~~~~", " # four", "    # code"]
    df = spark.createDataFrame(list(enumerate(lines)), "n int, line string").withColumn("doc", F.lit(1))
    assert [r["chapter"] for r in R.chapters(df, ["doc"], "n", "line").orderBy("n").collect()] == [1, 1, 1, 1, 1, 2, 2, 2, 2, 2, 2, 3, 3]


def test_texts_of_markup_by_the_tags_around_them(spark):
    html = """<HTML><body class=x><!-- <td>no</td> --><script>if (a < b) {"<td>"}</script><table id="t1"><tr><td data-id='1'>a<br>b</td><td> </td></tr><tr><td data-id="2"><b>c</b> &amp;</td></tr></table></body></HTML></td>end<td data-id=3>open"""
    df = spark.createDataFrame([(1, html), (2, None), (3, ""), (4, "bare")], "id int, m string").repartition(2)
    out = R.markup_texts(df, ["id"], "m", ["html", "body", "table", "tr", "td"], "data-id")
    found = {tuple(r) for r in out.drop("pos").collect()}
    cell = "html/body/table/tr/td"
    assert found == {(1, cell, "1", "a"), (1, cell, "1", "b"), (1, cell, "2", "c"), (1, cell, "2", " &amp;"), (1, "", None, "end"), (1, "td", "", "open"), (4, "", None, "bare")}
    assert R.markup_texts(df.filter("id = 2"), ["id"], "m", ["td"]).collect() == []
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "ArrowEval" not in plan


def test_first_prefix_against_a_scan(spark):
    rng = random.Random(12)
    rules = [(bytes(rng.choices(b"ab", k=rng.randrange(2, 6))), *((at, bytes(rng.choices(b"ab", k=2))) if (at := rng.choice([None, 3, 7])) else (None, None)), k, f"r{k}") for k in range(40)]
    data = [bytes(rng.choices(b"ab", k=rng.randrange(0, 12))) for _ in range(300)] + [None, b"", b"\x00\xff"]
    table = spark.createDataFrame([(bytearray(p), at, None if m is None else bytearray(m), k, v) for p, at, m, k, v in rules], "prefix binary, more_at int, more binary, priority int, value string")
    df = spark.createDataFrame([(k, None if d is None else bytearray(d)) for k, d in enumerate(data)], "value int, d binary").repartition(3)

    def scan(d):
        fits = (v for p, at, m, _, v in rules if d.startswith(p) and (at is None or d[at - 1 : at - 1 + len(m)] == m))
        return next(fits, None) if d is not None and len(d) >= 2 else None

    found = {r["value"]: r["format"] for r in R.first_prefix(df, ["value"], "d", table, least=2).collect()}
    assert found == {k: scan(d) for k, d in enumerate(data)} and len(set(found.values())) > 15
    assert all(r["format"] is None for r in R.first_prefix(df, ["value"], "d", table.limit(0)).collect())
    assert R.first_prefix(df.limit(0), ["value"], "d", table).collect() == []
    many = spark.range(1, 80).selectExpr("encode(repeat('a', int(id)), 'UTF-8') AS prefix", "int(null) AS more_at", "binary(null) AS more", "id AS priority", "'x' AS value")
    with pytest.raises(ValueError):
        R.first_prefix(df, ["value"], "d", many)
