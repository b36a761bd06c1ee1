"""Inline Markdown as a table of nodes, against trees that the texts were made of and against a scan with a stack."""

import random

from quillspark.functions import text as X
from quillspark.operators import nodes as N

TARGETS = {"text": N.PLAIN, "latex": N.LATEX}
ESCAPES = {"latex": X.latex_escape}


def rendered(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string").repartition(3)
    out = {r["id"]: (r["text"], r["latex"]) for r in N.inline_rendered(df, ["id"], "t", TARGETS, ESCAPES).collect()}
    return [out[k] for k in range(len(texts))]


def test_inline_forms(spark):
    cases = {
        "plain": ("plain", "plain"),
        "a **b *c* d** e": ("a b c d e", "a \\textbf{b \\textit{c} d} e"),
        "***x*** `a*b`": ("x a*b", "\\textbf{\\textit{x}} \\texttt{a*b}"),
        "[l ~~**m**~~](u)": ("l m", "\\href{u}{l \\sout{\\textbf{m}}}"),
        "*a **b* c**": ("*a **b* c**", "*a **b* c**"),
        "2 * 3 * 4 *": ("2 * 3 * 4 *", "2 * 3 * 4 *"),
        "\\*no\\* *yes*": ("*no* yes", "*no* \\textit{yes}"),
        "[open *x* ](y z": ("[open x ](y z", "[open \\textit{x} ](y z"),
        "[a] [b](c) d](e)": ("[a] b d](e)", "[a] \\href{c}{b} d](e)"),
        "one  \ntwo ![alt](i) three\\\nfour `": ("one two  three four `", "one two  three four `"),
        "*a [b*](c)": ("*a [b*](c)", "*a [b*](c)"),
        "50% _x_ *{y}*": ("50% _x_ {y}", "50\\% \\_x\\_ \\textit{\\{y\\}}"),
        "": ("", ""),
        "****": ("****", "****"),
        "[](x)": ("", "\\href{x}{}"),
    }
    found = rendered(spark, [*cases, None])
    assert dict(zip([*cases, None], found, strict=True)) == cases | {None: ("", "")}


def test_texts_made_of_trees(spark):
    rng = random.Random(8)

    def tree(depth, used):
        """Markdown, text and LaTeX of some nodes; no kind lies within itself."""
        md, text, latex = "", "", ""
        for _ in range(rng.randrange(1, 4)):
            kinds = [k for k in ("**", "*", "~~", "[") if k not in used and not ({k, *used} >= {"*", "**"})] if depth else []
            kind = rng.choice([*kinds, "word", "code"])
            if kind == "word":
                a = b = c = rng.choice(["some", "é", "words here"])
            elif kind == "code":
                a, b, c = "`k*[`", "k*[", "\\texttt{k*[}"
            else:
                a, b, c = tree(depth - 1, {*used, kind})
                if kind == "[":
                    if "[" in a:
                        continue
                    a, c = f"[{a}](to)", f"\\href{{to}}{{{c}}}"
                else:
                    a, c = f"{kind}{a}{kind}", {"**": "\\textbf{", "*": "\\textit{", "~~": "\\sout{"}[kind] + c + "}"
            md, text, latex = f"{md}{a}, ", f"{text}{b}, ", f"{latex}{c}, "
        return md + "w", text + "w", latex + "w"

    made = [tree(4, set()) for _ in range(300)]
    assert rendered(spark, [m for m, _, _ in made]) == [(t, x) for _, t, x in made]
    assert max(m.count("~~") + m.count("[") for m, _, _ in made) > 4


def test_nodes_nest_whatever_the_text(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choice(["*", "**", "***", "~~", "[", "](u)", "a", " ", "`", "\\", "\n", "![x](y)"]) for _ in range(rng.randrange(40))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    nodes = {}
    for r in N.inline_nodes(df, ["id"], "t").collect():
        nodes.setdefault(r["id"], []).append(r)
    assert len(nodes) == len(texts)
    for some in nodes.values():
        stack = []
        for n in sorted(some, key=lambda r: r["lo"]):
            while stack and stack[-1]["hi"] < n["lo"]:
                stack.pop()
            assert not stack or n["hi"] < stack[-1]["hi"] or n["lo"] == n["hi"]
            stack = stack if n["lo"] == n["hi"] else [*stack, n]
            assert n["depth"] == len(stack) + (n["lo"] == n["hi"])
    assert N.inline_nodes(df.limit(0), ["id"], "t").collect() == []


def test_headings_and_items_and_plan(spark):
    lines = ["# a #", "####### no", "  - x", "- y ", "3) z", "#no", "text", "    + deep", "##", "-no", ""]
    df = spark.createDataFrame(list(enumerate(lines)), "n int, line string")
    found = [(r["n"], r["kind"], r["level"], r["content"]) for r in N.headings_and_items(df, "line").orderBy("n").collect()]
    assert found == [(0, "heading", 1, "a"), (2, "item", 2, "x"), (3, "item", 1, "y"), (4, "item", 1, "z"), (7, "item", 3, "deep"), (8, "heading", 2, "")]
    plan = N.inline_rendered(df.repartition(3), ["n"], "line", TARGETS, ESCAPES)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_texts_are_dealt_out_before_they_are_tokens(spark, sf_dir):
    """Tasks are not put together by their bytes before these grow: one exchange of so many parts, no other and no join."""
    from quillspark.queries import QUERIES

    plan = QUERIES["heading_and_item_texts"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "REPARTITION_BY_NUM" in plan and "Join" not in plan
    df = spark.createDataFrame([(k, t) for k, t in enumerate(("a **b *c* d**", "", "[l](u)"))], "id int, t string")
    dealt = N.inline_rendered(df, ["id"], "t", TARGETS, ESCAPES, parts=5)
    assert sorted(dealt.collect()) == sorted(N.inline_rendered(df, ["id"], "t", TARGETS, ESCAPES).collect())
