"""Detection, conversion of DataFrames, relational operators, sinks, streaming and the driver's contract."""

import os
import re

import pytest
from pyspark.sql import functions as F

from quillspark import fixtures
from quillspark.functions import detect as D
from quillspark.functions import text as X
from quillspark.operators import rows as R
from quillspark.plans import api
from quillspark.sinks import files as sink


@pytest.fixture(scope="module")
def documents(spark):
    rows = [("d/a.json", b'{"a":1}'), ("b.md", b"# T\n\nx\n"), ("c", b"%PDF-1.4 broken"), ("e.JSON", b"{"), (None, b"xx"), ("f", fixtures.docx("<w:p><w:r><w:t>hi</w:t></w:r></w:p>")), ("g.rst", None)]
    return spark.createDataFrame([(p, None if d is None else bytearray(d)) for p, d in rows], "path string, content binary")


def test_detection(spark):
    rows = [("x.XLSX", b""), ("a.tar.gz", b"\x1f\x8b\x08\x00"), (".json", b""), ("noext", b"BM it is"), ("doc", fixtures.docx("")), ("s", fixtures.packed({"ppt/slides/slide1.xml": ""})), ("w", fixtures.packed({"a": "", "xl/w": ""})), ("m", fixtures.packed({"mimetype": ""})), ("z", fixtures.packed({"a": ""})), ("broken", b"PK\x03\x04...."), ("t", b"abc"), (None, b"SQLite format 3\x00")]
    df = spark.createDataFrame([(p, bytearray(d)) for p, d in rows], "path string, content binary")
    found = [r[0] for r in df.select(D.detect(F.col("path"), F.col("content"))).collect()]
    assert found == ["excel", "tar", None, "image", "word", "powerpoint", "excel", "epub", "zip", None, None, "sqlite"]


def test_convert_permissive_and_failfast(documents):
    found = {r["path"]: r for r in api.convert(documents).collect()}
    assert found["d/a.json"]["output"].startswith("| Key | Value |") and found["d/a.json"]["ext"] == "md"
    assert bytes(found["b.md"]["output_data"])[:2] == b"PK" and found["b.md"]["ext"] == "docx"
    assert found["f"]["format"] == "word" and found["f"]["output"] == "hi\n"
    assert all(found[p]["error"] and found[p]["output"] is None for p in ("e.JSON", None, "g.rst"))
    with pytest.raises(Exception, match="json"):
        api.convert(documents.filter("path IN ('d/a.json', 'e.JSON')"), mode="FAILFAST").collect()
    with pytest.raises(ValueError):
        api.convert(documents, mode="LAX")


def test_targets_are_for_markdown(documents):
    found = {r["path"]: r for r in api.convert(documents, to="latex").collect()}
    assert found["b.md"]["output"].startswith("\\documentclass") and found["b.md"]["ext"] == "tex"
    assert "Markdown input only" in found["d/a.json"]["error"]


def test_blocks_and_rendering(documents):
    some = documents.filter("path IN ('d/a.json', 'f')")
    found = api.document_blocks(some)
    assert {(r["path"], r["kind"]) for r in found.collect()} == {("d/a.json", "kv"), ("f", "para")}
    again = {r["path"]: r["output"] for r in api.render(found, "path").collect()}
    assert again == {r["path"]: r["output"] for r in api.convert(some).collect()}


def test_spread_moves_small_inputs_alone(spark):
    cores = spark.sparkContext.defaultParallelism
    assert api.spread(spark.range(10, numPartitions=1)).rdd.getNumPartitions() == cores
    many = spark.range(10, numPartitions=cores + 3)
    assert api.spread(many) is many


def test_sql_functions(spark):
    api.register_sql(spark)
    assert spark.sql("SELECT quill_convert(CAST('[1]' AS BINARY), 'json').text AS x").first()["x"] == "- 1\n\n"


def test_files_in_and_out(spark, tmp_path):
    os.makedirs(tmp_path / "in/sub")
    (tmp_path / "in/a.json").write_text("[1]")
    (tmp_path / "in/sub/a.yaml").write_text("x: 1")
    (tmp_path / "in/b.md").write_text("# T\n")
    out = api.convert(api.read_files(spark, str(tmp_path / "in")))
    sink.write_files(out, str(tmp_path / "out"))
    assert sorted(os.listdir(tmp_path / "out")) == ["a.md", "b.docx"]
    assert (tmp_path / "out/a.md").read_text() == "| Key | Value |\n|---|---|\n| x | 1 |\n\n"
    joined = sink.concatenated(out.filter("ext = 'md'"), "path").first()["document"]
    assert joined == "- 1\n\n\n---\n\n| Key | Value |\n|---|---|\n| x | 1 |\n\n"
    names = spark.createDataFrame([("/x/a.b.c", "md"), ("/x/.hidden", "md"), ("y", "tex"), ("", "md")], "path string, ext string")
    assert [r["output_name"] for r in sink.output_names(names).collect()] == ["a.b.md", ".hidden.md", "y.tex", "output.md"]


def test_stream(spark, tmp_path):
    from quillspark.streaming.convert import convert_stream, read_file_stream, start

    (tmp_path / "in").mkdir()
    for name, text in (("a.json", "[1]"), ("copy.json", "[1]"), ("b.json", "[2]")):
        (tmp_path / f"in/{name}").write_text(text)
    seen = []
    stream = convert_stream(read_file_stream(spark, str(tmp_path / "in")), watermark="1 hour")
    query = start(stream, str(tmp_path / "checkpoint"), lambda df, k: seen.extend(r["output"] for r in df.collect()), available_now=True)
    query.awaitTermination(120)
    assert sorted(seen) == ["- 1\n\n", "- 2\n\n"]


def test_text_functions(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).first()["x"]
    assert value(X.lines_of(F.lit("a\r\nb\n"))) == ["a", "b"] and value(X.lines_of(F.lit(""))) == [] and value(X.lines_of(F.lit("\n\n"))) == ["", ""]
    assert value(X.trim_white(F.lit("\t a b \n"))) == "a b"
    assert [value(X.number_label(F.lit(x))) for x in (1.0, 0.1, 1e21, 1.5e-7, -123456789.125, 12345678.5)] == ["1", "0.1", "1000000000000000000000", "0.00000015", "-123456789.125", "12345678.5"]
    assert value(X.latex_escape(F.lit("\\{}~^&"))) == r"\textbackslash{}\{\}\textasciitilde{}\textasciicircum{}\&"
    assert value(X.wiki_marks(F.lit("'''''a''''' ''b'' <br>"))) == "***a*** *b*   \n"
    assert value(X.wiki_url_links(F.lit("[http://a.b c d] [https://e.f]"))) == "[c d](http://a.b) [https://e.f](https://e.f)"
    assert value(X.fit_width(F.array(F.lit("a")), F.lit(3))) == ["a", "", ""] and value(X.fit_width(F.array(F.lit("a")), F.lit(0))) == []
    assert value(X.min_indent(F.array(F.lit("  a"), F.lit(""), F.lit("   b")))) == 2
    assert value(X.capitalised(F.lit("note"))) == "Note" and value(X.heading_underline(F.lit(4))) == "^" and value(X.heading_style(F.lit(9))) == "Heading6"
    assert value(X.member_label(F.lit("l"))) == "symlink" and value(X.is_blank_row(F.array(F.lit(""), F.lit("")))) and value(X.filled_text(F.array(F.lit("a"), F.lit(""), F.lit("b")))) == "a  b"
    assert value(X.is_gzip(F.lit(b"\x1f\x8b1"))) and value(X.is_svg(F.lit(b"<?xml x"))) and not value(X.is_svg(F.lit(b"<html>")))
    assert value(X.size_label(F.lit(5 << 30), ("KB", "MB"))) == "5120.0 MB"


def test_cells_of_long_runs_of_blanks(spark):
    """The time of a trim follows the text's length, not the square of a run's."""
    import time

    rows = [(0, f"| a{' ' * 400_000}b |\u2003"), (1, "\x85|\u3000x\xa0y\u2028|:-|\x0b |"), (2, "|--|:-:|"), (3, "a |"), (4, "||"), (5, "|")]
    df = spark.createDataFrame(rows, "id int, line string")
    cells = X.table_cells(F.col("line"))
    began = time.time()
    found = {r["id"]: (r["cells"], r["rule"]) for r in df.select("id", cells.alias("cells"), X.is_separator_row(cells).alias("rule")).collect()}
    assert time.time() - began < 20
    assert found == {0: ([f"a{' ' * 400_000}b"], False), 1: (["x\xa0y", ":-", ""], False), 2: (["--", ":-:"], True), 3: (None, None), 4: ([""], False), 5: (None, None)}


def test_first_match_takes_the_first(spark):
    left = spark.createDataFrame([(1,), (2,)], "id int")
    right = spark.createDataFrame([(1, 2, "late"), (1, 1, "early")], "id int, place int, href string")
    assert [tuple(r) for r in R.first_match(left, right, "id", "place").collect()] == [(1, "early")]
    assert R.first_match(left, right, "id", "place", "left").count() == 2


def test_windows_stay_within_documents(spark, sf_dir):
    """No window without a partition: a plan with SinglePartition would put a whole table into one task."""
    from quillspark.queries import QUERIES

    for name in ("block_islands", "same_name_runs", "ordered_counter", "chapter_split", "strip_repeated_lines", "heading_rank_first_seen", "md_concat_docs"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "SinglePartition" not in plan, name


@pytest.mark.parametrize("name", ["documents_to_json_ast", "documents_to_html", "page_blocks"])
def test_documents_go_to_python_a_few_at_a_time(spark, sf_dir, name):
    """An Arrow batch is 10,000 documents, and all that is made of them, at once."""
    from quillspark.queries import QUERIES

    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan


@pytest.mark.parametrize("name", ["documents_to_latex", "documents_to_text", "documents_to_docx", "documents_to_epub", "page_to_markdown", "page_headings", "page_link_lists"])
def test_documents_go_to_python_a_few_at_a_time_whatever_is_set(spark, sf_dir, name):
    """The queries that share the step of documents_to_html, in a session that prefers Arrow."""
    from quillspark.queries import QUERIES

    flag = "spark.sql.execution.pythonUDF.arrow.enabled"
    before = spark.conf.get(flag)
    try:
        spark.conf.set(flag, "true")
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(flag, before)
    assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan


def test_columns_and_filters_reach_the_scan(spark, sf_dir):
    from quillspark.queries import QUERIES

    plan = QUERIES["page_to_markdown"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<page_id:bigint,url:string,html:string>" in plan and "hashpartitioning" not in plan
    plan = QUERIES["md_pipe_escape_documents"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
    plan = QUERIES["semi_skip_missing"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: \[IsNotNull\(doc_id\)\], ReadSchema: struct<doc_id:bigint,n_chars:", plan)


# The driver's contract


def _normal(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, list | tuple):
        return tuple(map(_normal, v))
    return str(v)


def _names():
    from quillspark.queries import ORACLES

    return sorted(ORACLES)


@pytest.fixture(scope="module")
def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for name in sorted(os.listdir(sf_dir)):
        path = f"{sf_dir}/{name}" + ("/*.parquet" if os.path.isdir(f"{sf_dir}/{name}") else "")
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", _names())
def test_queries_give_what_sql_gives(spark, sf_dir, duck, name):
    from quillspark.queries import ORACLES, QUERIES

    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(tuple(_normal(r[c]) for c in columns) for r in df.collect())
    result = duck.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted(tuple(_normal(r[names.index(c)]) for c in columns) for r in result.fetchall())
    assert got == want


@pytest.mark.parametrize("name", ["lateral_page_headings", "page_headings"])
def test_headings_with_cut_references_are_what_sql_gives(spark, tmp_path, name):
    import duckdb

    from quillspark.queries import ORACLES, QUERIES

    html = "<html><head><title>{0}</title></head><body><ul><li><a href='x'>y</a></li></ul><h1>{0}</h1></body></html>"
    rows = [(k, "http://a.org/", html.format(s)) for k, s in enumerate(("of.&amp;&amp;&amp", "a &ltb &lt;", " &quot", "&amp;lt; & &&"))]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert sorted(map(tuple, QUERIES[name](spark, str(tmp_path)).collect())) == sorted(con.execute(ORACLES[name]).fetchall())


def test_headings_cut_at_any_place_are_what_sql_gives(spark, tmp_path):
    import duckdb

    from quillspark.queries import ORACLES, QUERIES

    whole = "a&amp;&quot;&lt;b&gt;&amp;lt;c &amp;quot;&amp;&amp;amp;d"
    html = "<html><head><title>{0}</title></head><body><p>x</p><h1>{1}</h1></body></html>"
    rows = [(k, "http://a.org/", html.format(whole[:k], whole[-k:])) for k in range(1, len(whole) + 1)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS FROM '{tmp_path}/pages.parquet/*.parquet'")
    got = sorted(map(tuple, QUERIES["page_headings"](spark, str(tmp_path)).collect()))
    assert len(got) == 2 * len(rows) and got == sorted(con.execute(ORACLES["page_headings"]).fetchall())


@pytest.mark.parametrize("name", ["lateral_page_headings", "page_headings"])
def test_headings_of_odd_pages_are_what_sql_gives(spark, tmp_path, name):
    import duckdb

    from quillspark.queries import ORACLES, QUERIES

    head = "<title>T</title>"
    pages = [
        None, "", "<p>x</p><h1>A</h1>", "<h1>A</h1>", "<title></title><h1>A</h1>", "<title> </title><title>U</title><h1>U</h1>",  # without a title
        head, f"{head}<h1>T</h1><p>x</p>", f"{head}<h1>T</h1><h1>T</h1>", f'{head}<meta name="author" content="me"><h1> T </h1>', "<title> T &amp; U </title><h1>T &amp; U</h1>",  # the first heading repeats the title
        f"{head}<title>U</title><h1>A</h1>", f"{head}<h1>A</h1><h2>B</h2><h6>C</h6>", f"{head}<h1></h1><h1> </h1><p>x</p><h1></h1>", "<h1></h1>", f"{head}<h1></h1><h1>T</h1>",
        f"{head}<ul><li>x</li><h1></h1></ul><h1>A</h1>", f"{head}<![x[y]]><h1>A</h1>", f"{head}<table><tr><td><h1>A</h1><h1></h1></td></tr></table>",
    ]
    spark.createDataFrame([(k, "http://a.org/", html) for k, html in enumerate(pages)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert sorted(map(repr, map(tuple, QUERIES[name](spark, str(tmp_path)).collect()))) == sorted(map(repr, con.execute(ORACLES[name]).fetchall()))


def test_queries_without_sql_run(spark, sf_dir):
    from quillspark.queries import ORACLES, QUERIES

    for name in sorted(set(QUERIES) - set(ORACLES)):
        rows = QUERIES[name](spark, sf_dir).collect()
        assert rows and not any("error" in r.asDict() and r["error"] for r in rows), name


def test_entry(spark, monkeypatch):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["page_id", "url", "output", "error"]
    monkeypatch.setattr(__spark_entry__, "_llm", lambda: None)
    assert not any(n.startswith("op") or n == "pipeline" for n in [*__spark_entry__.queries(), *__spark_entry__.oracle_sql()])


def test_nothing_else_imports_the_pipeline_operators():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for folder, _, names in os.walk(f"{root}/quillspark"):
        for name in names:
            if name.endswith(".py") and not folder.endswith("/llm"):
                with open(f"{folder}/{name}") as f:
                    assert "quillspark.llm" not in f.read(), name


def test_command_line(spark, tmp_path, capfdbinary):
    from quillspark.plans.cli import main

    for name, text in (("b.json", "[1]"), ("a.yaml", "x: 1"), ("m.md", "# T\n"), ("bad.json", "{")):
        (tmp_path / name).write_text(text)
    assert main([str(tmp_path / "b.json"), str(tmp_path / "a.yaml")], spark) == 0
    assert capfdbinary.readouterr().out == b"- 1\n\n\n---\n\n| Key | Value |\n|---|---|\n| x | 1 |\n\n"
    assert main([str(tmp_path / "m.md"), "--to", "org"], spark) == 0
    assert capfdbinary.readouterr().out == b"* T\n\n"
    assert main([str(tmp_path / "b.json"), "--to", "org"], spark) == 1
    assert main([str(tmp_path / "bad.json"), str(tmp_path / "m.md"), "--output-dir", str(tmp_path / "out"), "--permissive"], spark) == 1
    assert os.listdir(tmp_path / "out") == ["m.docx"]


def test_concatenation_in_parts(spark, tmp_path):
    rows = spark.range(500).selectExpr("id", "concat('text ', id) AS output").repartition(7)
    sink.write_concatenated(rows, str(tmp_path / "all"), "id", parts=3)
    parts = sorted(p for p in os.listdir(tmp_path / "all") if p.startswith("part-"))
    whole = "".join((tmp_path / "all" / p).read_text() for p in parts)
    assert len(parts) > 1 and whole == "\n---\n\n".join(f"text {k}" for k in range(500)) + "\n"


def test_a_grid_has_so_many_columns_at_most(spark):
    from quillspark.operators.rows import densify

    cells = spark.createDataFrame([("a", "x", "1"), ("b", "y", "2"), ("b", None, "3")], "r string, c string, v string")
    assert {(x["r"], x["c"], x["v"]) for x in densify(cells.filter("c IS NOT NULL"), "r", "c", "v").collect()} == {("a", "x", "1"), ("a", "y", ""), ("b", "x", ""), ("b", "y", "2")}
    with pytest.raises(ValueError, match="more than 1 columns"):
        densify(cells, "r", "c", "v", most=1)
