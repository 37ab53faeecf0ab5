from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
import pytest
from pyspark.sql import functions as F

from texmill.functions import brackets, text as fn
from texmill.operators import batching, integrity, validate


def value(spark, x, make, *more):
    return spark.createDataFrame([(x, *more)], ", ".join(["x string", *(f"y{i} string" for i in range(len(more)))])).select(make).first()[0]


X, Y = F.col("x"), F.col("y0")


@pytest.mark.parametrize("given_, want", [("https://x/abs/2301.07041v2", "2301.07041v2"), ("hep-th/9901001", "hep-th/9901001"), ("foo", None)])
def test_paper_id(spark, given_, want):
    assert value(spark, given_, fn.paper_id(X)) == want


def test_comments(spark):
    text = "a % c\n%x\n  \nb \\% d\n%!TEX on\n\\begin{verbatim}\n50% stays\n\\end{verbatim}\n  % gone\nz%"
    assert value(spark, text, fn.remove_comments(X)) == "a\n\nb \\% d\n%!TEX on\n\\begin{verbatim}\n50% stays\n\\end{verbatim}\nz"


def test_abstract(spark):
    long = "x" * 2001
    assert value(spark, f"\\begin{{abstract}}\n% no\n{long}\n\\end{{abstract}}", fn.abstract(X)) == "x" * 2000 + "..."
    assert value(spark, "none", fn.abstract(X)) is None


def test_escape(spark):
    assert value(spark, "50% \\% & [[A%_1]] #", fn.escape_specials(X)) == "50\\% \\% \\& [[A%_1]] \\#"


def test_line_ends(spark):
    assert value(spark, "a\r\nb\n\n\nc[[SL]]", fn.encode_line_ends(X)) == "a[[SL]]b[[PL]][[SL]]c[[SL_RAW]]"
    c = value(spark, "a\r\nb\n\n\nc", fn.line_break_counts(X))
    assert (c["soft"], c["paragraph"]) == (2, 1)


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from(["a", "\n", "[[SL]]", "[[PL]]", "[[SL_RAW]]", "[[PL_RAW]]", " "]), max_size=12))
def test_line_ends_return(spark, parts):
    text = "".join(parts)
    assert value(spark, text, fn.decode_line_ends(fn.encode_line_ends(X))) == text


@pytest.mark.parametrize("text, want", [(" [[MATH_1]] ", True), ("[[MATH_1]] [[CITE_2]]", False), ("", False)])
def test_only_placeholder(spark, text, want):
    assert value(spark, text, fn.only_placeholder(X)) is want


def test_clean_length(spark):
    assert value(spark, "See [[CITE_1]] ok", fn.clean_length(X)) == 7


@pytest.mark.parametrize("line, want", [("\\partial x", True), ("A & B \\\\", False), ("\\\\", True), ("[[LABEL_1]] x", False), ("[x]", True), ("words", False), ("  & x", True)])
def test_structural(spark, line, want):
    assert value(spark, line, fn.structural_line(X)) is want


def test_long_texts_do_not_exhaust_the_matcher(spark):
    assert value(spark, "\\%" * 100_000 + "{", F.size(brackets.brace_tokens(X))) == 2


@pytest.mark.parametrize("text, want", [("\\[ x", [(1, "[", "unmatched opener")]), ("\\{ a \\}", []), ("(]", [(1, "]", "unmatched closer")]), ("{]", [(1, "]", "mismatched")]), ("a}{b{c}d}{e", [(1, "}", "unmatched closer"), (9, "{", "unmatched opener")])])
def test_unbalanced(spark, text, want):
    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    assert sorted(tuple(r)[1:] for r in brackets.unbalanced(df).collect()) == sorted(want)


def naive(text):
    out, stack, i = [], [], 0
    while i < len(text):
        if text[i] == "\\":
            i += 2 if text[i + 1 : i + 2] in ("{", "}", "\\") else 1
            while i < len(text) and text[i - 1] != "{" and text[i].isalpha() and text[i - 1 : i] in ("\\",) + tuple("ab"):
                i += 1
            continue
        if text[i] in "{[":
            stack.append(i)
        elif text[i] in "}]":
            stack.pop() if stack else out.append(i)
        i += 1
    return sorted(out + stack)


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text("{}[] x", max_size=14))
def test_matcher_against_a_stack(spark, text):
    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    found = brackets.unbalanced(df).where("problem <> 'mismatched'")
    assert sorted(r.pos for r in found.collect()) == naive(text)


def test_environments_nest(spark):
    text = "\\begin{align}a\\begin{align}b\\end{align}\\end{align} \\begin{align}c"
    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    assert [(r.first, r.stop) for r in brackets.environments(df, ["align"]).collect()] == [(0, text.index(" "))]


@pytest.mark.parametrize("sizes, want", [([900, 900, 300, 100, 1900, 50], [0, 0, 1, 1, 2, 2]), ([0, 2100, 0, 50], [0, 1, 2, 2])])
def test_greedy(spark, sizes, want):
    assert spark.range(1).select(batching.batch_numbers(F.array(*map(F.lit, sizes)))).first()[0] == want


@pytest.mark.parametrize("reply, n, want", [("[1] a\n[2] b", 2, ["a", "b"]), ("[1] a\n[2] b", 3, []), ("[2] b [1] a\nc", 2, ["a\nc", "b"]), ("[1] a [1] b", 2, []), ("[1] see [12]", 1, []), ("", 1, [])])
def test_reply(spark, reply, n, want):
    assert value(spark, reply, batching.parse_reply(X, F.lit(n))) == want


def test_backoff(spark):
    got = spark.createDataFrame([(k, a) for k in ("generic", "rate_limit", "timeout") for a in range(4)], "k string, a int").select(batching.backoff(F.col("k"), F.col("a"))).collect()
    assert [r[0] for r in got] == [1, 2, 4, 8, 5, 5, 9, 27, 10, 10, 10, 16]


def test_repair(spark):
    pairs = spark.createDataFrame([("c", "[[MATH_1]] s", "[[MTH_1]] x [[CITE_9]]"), ("d", "src", "[[CITE_9]]"), ("e", "[[A_1]]", "t")], "chunk_id string, source string, translation string")
    valid = spark.createDataFrame([("[[CITE_9]]",), ("[[MATH_1]]",)], "placeholder string")
    got = {r.chunk_id: r for r in integrity.repaired(pairs, valid).collect()}
    assert got["c"].translation == "[[MATH_1]] x "
    assert sorted(i.type for i in got["c"].issues) == ["hallucination", "typo_fixed"]
    assert got["d"].translation == "src"
    assert [(i.type, i.bad) for i in got["e"].issues] == [("missing", "[[A_1]]")]


def test_mismatch_and_alignment(spark):
    m = value(spark, "{A}}B}", validate.first_brace_mismatch(X, Y), "{A}B}")
    assert (m["index"], m["expected"], m["got"], m["source_off"], m["translated_off"]) == (3, "}", "T", 3, 3)
    assert value(spark, "{A}}B}", validate.aligned_braces(X, Y), "{A}B}") == "{A}}B}"


def test_pair_checks(spark):
    df = spark.createDataFrame([("a", "\\cite{a,b} \\ref{x}", "\\cite{b,a}  \\ref{y}"), ("m", "$x$ and more", "x$ and more"), ("s", "0123456789", "1"), ("l", "0123456789", "0" * 16), ("f", "0123456789", "0" * 15), ("n", None, "$")], "doc_id string, original string, translated string")
    got = {}
    for r in validate.pair_findings(df).collect():
        got.setdefault(r.doc_id, []).append((r.check, r.severity))
    assert got["a"] == [("citations", "error"), ("citations", "error"), ("references", "error")]
    assert got["m"] == [("math", "error"), ("math", "error")]
    assert got["s"] == got["l"] == [("length", "warning")]
    assert "f" not in got and "n" not in got


def test_first_error_and_config(spark):
    assert value(spark, "x\n! Undefined\nl.1\nl.2\nl.3\nl.4\nl.5", fn.first_tex_error(X)) == "! Undefined\nl.1\nl.2\nl.3\nl.4"
    assert [tuple(value(spark, v, fn.config_value(X))) for v in ("TRUE", "3", "0.5", "x")] == [("bool", "true"), ("int", "3"), ("float", "0.5"), ("string", "x")]
