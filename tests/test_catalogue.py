"""Every query that has SQL gives the same rows as another engine on the same tables."""

import collections
import hashlib
import re

import duckdb
import pytest

from texmill.plans import catalogue
from texmill.plans import fixtures as fx

DATA = "/root/testdata/sf0.001"
TABLES = "documents conversations pages labels events benchmark".split()


@pytest.fixture(scope="module")
def engine():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def rows(columns, data):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(round(r[i], 9) if isinstance(r[i], float) else r[i] for i in at) for r in data], key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_same_rows(spark, engine, name):
    df = catalogue.queries()[name](spark, DATA)
    other = engine.sql(catalogue.oracle_sql()[name])
    assert sorted(df.columns) == sorted(other.columns)
    assert rows(df.columns, df.collect()) == rows(list(other.columns), other.fetchall())


def test_every_query_is_registered_once():
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())
    assert len(catalogue.queries()) >= 60


def test_entry_module():
    import __spark_entry__ as e

    assert set(catalogue.queries()) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())


def digest(text):
    return hashlib.md5(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """The tables with texts that the SQL of some queries can't follow."""
    at, c = tmp_path_factory.mktemp("odd"), duckdb.connect()
    texts = ["a % b & c # d", "x \\% y \\& z % w \\\\ #", "See one\nand See two $a_1$ and $$b$$", "[[MATH_1]] & [[a % b]] # [ %", "cost $5 \\cite{k} and $ % gone $", ""]
    c.execute("create table d as select * from (values " + ",".join(["(?::bigint, ?, 'en', 's')"] * len(texts)) + ") t(doc_id, text, lang, source)", [v for i, t in enumerate(texts) for v in (i, t)])
    turns = [(0, 0, "plain"), (0, 1, "see [x] here"), (1, 0, "it says [1] twice"), (1, 1, "b"), (2, 0, "[ open"), (3, 0, "[y]"), (4, 1, "[7] far")]
    c.execute("create table v as select * from (values " + ",".join(["(?::bigint, ?::int, ?)"] * len(turns)) + ") t(conv_id, turn, text)", [v for t in turns for v in t])
    c.sql(f"copy d to '{at}/documents.parquet'")
    c.sql(f"copy v to '{at}/conversations.parquet'")
    c.sql("create view documents as select * from d")
    return str(at), texts, turns, c.sql(fx.TEX).fetchall()


def test_escapes_and_places_of_all_texts(spark, odd):
    at, texts, _, tex = odd
    want = ["a \\% b \\& c \\# d", "x \\% y \\& z \\% w \\\\ \\#", texts[2], "[[MATH_1]] \\& [[a % b]] \\# [ \\%", "cost $5 \\cite{k} and $ \\% gone $", ""]
    assert sorted(map(tuple, catalogue.queries()["escape_specials"](spark, at).collect())) == [(i, digest(t)) for i, t in enumerate(want)]
    places = [(i, t[: t.index("See ")].count("\n") + 1, len(t[: t.index("See ")].split("\n")[-1]) + 1) for i, t in tex]
    assert sorted(map(tuple, catalogue.queries()["line_and_column"](spark, at).collect())) == sorted(places)


def test_replies_of_all_turns(spark, odd):
    at, _, turns, _ = odd
    per, want = collections.defaultdict(list), []
    for c, t, text in turns:
        per[c].append((t, text))
    for c, of in per.items():
        reply = "\n".join(f"[{i}] {text}" for i, (_, text) in enumerate(of, 1)) + ("\n[99] more" if c % 4 == 3 else "")
        if [int(n) for n in re.findall(r"\[(\d+)\]", reply)] == list(range(1, len(of) + 1)):
            want += [(c, t, digest(text.strip())) for t, text in of]
    assert sorted(map(tuple, catalogue.queries()["batch_reply_parse"](spark, at).collect())) == want and len(want) == 3


def test_stored_placeholders_of_all_documents(spark, odd):
    got = {(int(r.doc_id), r.kind): r.n for r in catalogue.queries()["stored_placeholders"](spark, odd[0]).collect()}
    assert [got.get((0, k)) for k in ("MATH", "CITE", "REF", "LABEL")] == [1, 1, 1, 1]
    assert [got.get((2, k)) for k in ("MATH", "CITE", "REF", "LABEL")] == [3, 1, 1, 1]
    assert [got.get((4, k)) for k in ("MATH", "CITE", "REF", "LABEL")] == [2, 1, 1, 1]  # the cite of the text is inside the math


def bracket_walk(text):
    """(pos, bracket) of those that count: a backslash hides a brace or backslash after it, or goes with a command."""
    at = 0
    while at < len(text):
        if text[at] == "\\":
            at += 1
            if at < len(text) and text[at] in "{}\\":
                at += 1
            continue
        if text[at] in "{}[]":
            yield at, text[at]
        at += 1


def test_brackets_of_whole_documents(spark, engine):
    pairs, wrong = [], []
    for doc, text in engine.sql(fx.TEX).fetchall():
        stack = []
        for pos, c in bracket_walk(text):
            if c in "{[":
                stack.append((pos, c))
            elif not stack:
                wrong.append((doc, pos, c, "unmatched closer"))
            else:
                at, opener = stack.pop()
                pairs.append((doc, at, pos))
                if opener + c not in ("{}", "[]"):
                    wrong.append((doc, pos, c, "mismatched"))
        wrong += [(doc, *x, "unmatched opener") for x in stack]
    assert sorted(map(tuple, catalogue.queries()["brace_match_pairs"](spark, DATA).collect())) == sorted(pairs)
    assert sorted(map(tuple, catalogue.queries()["brace_balance"](spark, DATA).collect())) == sorted(wrong)
    assert {x[3] for x in wrong} == {"unmatched closer", "unmatched opener"}


def test_brace_structure_of_whole_pairs(spark, engine):
    def tokens(text):
        out, at = [], 0
        for pos, c in [*((p, c) for p, c in bracket_walk(text) if c in "{}"), (len(text), "<EOF>")]:
            if pos > at:
                out.append(("T", at))
            out.append((c, pos))
            at = pos + 1
        return out

    want = []
    for doc, a, b in engine.sql(fx.PAIRS).fetchall():
        for i, (x, y) in enumerate(zip(tokens(a), tokens(b))):
            if x[0] != y[0]:
                want.append((doc, i, x[0], y[0], x[1], y[1]))
                break
    assert sorted(map(tuple, catalogue.queries()["brace_structure_mismatch"](spark, DATA).collect())) == sorted(want) and want


def test_inline_math_of_whole_documents(spark, odd):
    got = {int(r.doc_id): r.n for r in catalogue.queries()["inline_math_spans"](spark, odd[0]).collect()}
    assert got == {0: 1, 1: 1, 2: 3, 3: 1, 4: 2, 5: 1}
