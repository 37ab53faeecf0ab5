import gzip
import io
import tarfile

import pytest
from pyspark.sql import functions as F

from texmill.operators import glossary, parse, prompts, providers, rebuild
from texmill.plans.translate import Options, translate_chunks, translate_documents
from texmill.sources import papers, settings

TEX = r"""\documentclass{article}
\title{On $x$ things}
\begin{document}
\author{A. Author}
\begin{abstract}
We say what \cite{a,b} said, at some length, for a test.
\end{abstract}
\section{First steps} trailing words after the heading that are long enough
This paragraph is long enough to be a chunk, with $a+b$ and \ref{q}\footnote{A note that says something}.

short one

\begin{figure}\includegraphics[width=1cm]{f.png}\caption[s]{A caption with {nested} braces}\label{q}\end{figure}
\begin{equation}e = mc^2 \label{e}\end{equation}
\begin{align}a\begin{align}b\end{align}\end{align}
\begin{verbatim}
\caption{not this} 100%
\end{verbatim}
\begin{itemize}
\item one thing that is listed \url{http://x}
\end{itemize}
Display \[ y \] and \( z \) and line\\[2pt] break with many words around it.
\end{document}
"""


def parsed(spark, tex=TEX):
    return parse.parse(spark.createDataFrame([("d", tex)], "doc_id string, tex string"))


def test_kinds_and_contexts(spark):
    rows = parsed(spark).collect()
    assert {r.context for r in rows if r.kind == "placeholder"} == {"AUTHOR", "ENV", "MATH", "CITE", "REF", "LABEL", "URL", "GRAPHICS"}
    chunks = {r.context: r.content for r in rows if r.kind == "chunk"}
    assert set(chunks) == {"title", "caption", "section", "itemize", "abstract", "footnote", "paragraph"}
    assert chunks["title"] == "On $x$ things" and chunks["caption"] == "A caption with {nested} braces"
    assert not any("not this" in r.content for r in rows if r.kind == "chunk")


def test_ids_are_stable(spark):
    assert sorted(map(tuple, parsed(spark).collect()), key=repr) == sorted(map(tuple, parsed(spark).collect()), key=repr)


@pytest.mark.parametrize("text, kept", [("P \\$5, $a+b$, $$x\n\n y$$ end $z", ["$a+b$", "$z"]), ("no math", []), ("$$a$$ $b$", ["$$a$$", "$b$"])])
def test_inline_math(text, kept):
    doc = parse.Parsed("d")
    parse.inline_math(doc, text)
    assert [o for _, o in doc.placeholders] == kept


def test_round_trip(spark):
    got = rebuild.rebuild(parsed(spark)).first().tex
    assert " ".join(got.split()) == " ".join(TEX.split()).replace("100%", "100%")
    assert rebuild.leftovers(rebuild.rebuild(parsed(spark))).count() == 0


def test_translated_text_is_escaped_before_placeholders_return(spark):
    rows = parsed(spark)
    chunks = rows.where("kind = 'chunk'").select(F.col("id").alias("chunk_id"), F.concat(F.lit("50% "), "content").alias("translation"))
    out = rebuild.rebuild(rows, chunks).first()
    assert "50\\% A note" in out.tex and "\\cite{a,b}" in out.tex and "50\\% On $x$" in out.tex
    assert all(out.tex.split("\n")[n - 1] for n in out.start_lines.values())


def test_empty_and_odd_documents(spark):
    df = spark.createDataFrame([("a", ""), ("b", None), ("c", "no markup"), ("e", "\\title{open \\begin{align} $"), ("f", "[[MATH_1]] {{CHUNK_ab}}")], "doc_id string, tex string")
    out = {r.doc_id: r.tex for r in rebuild.rebuild(parse.parse(df)).collect()}
    assert out == {"a": "", "c": "no markup", "e": "\\title{open \\begin{align} $", "f": "[[MATH_1]] {{CHUNK_ab}}"}


def chunks(spark):
    rows = [("d", 0, "p", "[[MATH_1]]"), ("d", 1, "s1", "short one"), ("d", 2, "s2", "short\ntwo"), ("d", 3, "l", "long " * 80), ("e", 0, "x", "bad one")]
    return spark.createDataFrame(rows, "doc_id string, ord int, chunk_id string, content string")


def test_chunks_end_to_end_and_resume(spark, tmp_path):
    state = str(tmp_path / "state")
    first = {r.chunk_id: r for r in translate_chunks(chunks(spark), None, None, Options(providers.Offline(fail_on="bad"), state=state, tries=1)).collect()}
    assert first["p"].translation == "[[MATH_1]]" and first["s2"].translation == "T:short\ntwo" and first["s1"].batched and not first["l"].batched
    assert first["x"].skipped and first["x"].translation == "bad one" and "refused" in first["x"].skip_reason
    again = {r.chunk_id: r for r in translate_chunks(chunks(spark), None, None, Options(providers.Offline(fail_on="o", mark="Z:"), state=state, tries=1)).collect()}
    assert again["s1"].translation == "T:short one" and again["x"].skipped and set(again) == set(first)
    third = {r.chunk_id: r for r in translate_chunks(chunks(spark), None, None, Options(providers.Offline(mark="Z:"), state=state, tries=1)).collect()}
    assert third["x"].translation == "Z:bad one" and third["l"].translation.startswith("T:")


def test_failed_batches_go_chunk_by_chunk(spark):
    got = {r.chunk_id: r for r in translate_chunks(chunks(spark), None, None, Options(providers.Offline(fail_on="[2] "), tries=1)).collect()}
    assert got["s1"].translation == "T:short one" and not got["s1"].skipped and not got["s1"].batched


def test_stateful_provider(spark):
    got = translate_chunks(chunks(spark), None, None, Options(providers.Offline(stateful=True), tries=1)).collect()
    assert len(got) == 5 and not any(r.skipped for r in got)


def test_documents_end_to_end(spark):
    terms = spark.createDataFrame(glossary.rows_of({"caption": "legend"}), glossary.COLUMNS)
    tables = translate_documents(spark.createDataFrame([("d", TEX)], "doc_id string, tex string"), terms)
    assert "T:A note" in tables["documents"].first().tex
    assert tables["issues"].count() == 0
    assert tables["verdicts"].count() == 1


@pytest.mark.parametrize("text, hits", [("brain", []), ("让AI来", ["AI"]), ("ai x", ["AI"]), ("C++x", []), ("use C++, ok", ["C++"]), (None, []), ("", [])])
def test_glossary(spark, text, hits):
    terms = spark.createDataFrame(glossary.rows_of({"AI": "x", "C++": "y"}), glossary.COLUMNS)
    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    assert sorted(r.term for r in glossary.hits(df, terms).collect()) == hits


def test_long_glossaries_go_in_blocks(spark):
    terms = spark.createDataFrame(glossary.rows_of({f"w{i}": "x" for i in range(30)}), glossary.COLUMNS)
    df = spark.createDataFrame([(1, "w3 w17x w29"), (2, "W0")], "doc_id int, text string")
    want = [(1, "w29"), (1, "w3"), (2, "w0")]
    assert sorted((r.doc_id, r.term) for r in glossary.hits(df, terms, block=7).collect()) == want == sorted((r.doc_id, r.term) for r in glossary.hits(df, terms).collect())


def test_glossary_merge_keeps_places(spark):
    got = settings.load_glossary(spark, {"a": "1", "b": "2"}, {"b": {"target": "3"}, "c": "4"}).collect()
    assert [(r.term, r.target) for r in got] == [("a", "1"), ("b", "3"), ("c", "4")]


def test_prompt_and_messages(spark):
    one = spark.range(1).select(prompts.system_prompt(hints=F.create_map(F.lit("t"), F.lit("x")), context=F.lit("ctx"), stateful=True).alias("s"))
    said = one.first().s
    assert "- t: x" in said and "ctx" in said and prompts.CONSISTENCY in said
    e = F.array(F.struct(F.lit("a").alias("source"), F.lit("b").alias("target")), F.struct(F.lit(" ").alias("source"), F.lit("b").alias("target")))
    m = spark.range(1).select(prompts.messages(F.lit("s"), e, F.lit("u")).alias("m")).first().m
    assert [x.role for x in m] == ["system", "user", "assistant", "user"]


def test_providers():
    with pytest.raises(ValueError):
        providers.provider("nobody")
    assert providers.provider("anthropic", model="m").body([{"role": "system", "content": "s"}])["system"][0]["cache_control"]
    now = [0.0]
    held = providers.VariantContexts(lambda v: f"{v}{now[0]}", 300, lambda: now[0])
    assert held.get("a") == ("a0.0", False) and held.get("a")[1]
    now[0] = 301
    assert not held.get("a")[1]


def archive(files):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as t:
        for name, text in files.items():
            info = tarfile.TarInfo(name)
            info.size = len(text)
            t.addfile(info, io.BytesIO(text.encode()))
    return out.getvalue()


def test_paper_sources(spark, tmp_path):
    body = {"main.tex": "\\input{sec/a}\n% \\input{no}\n\\bibliographystyle{s}\n\\bibliography{x, y}", "sec/a.tex": "A \\input{b} \\input{a}", "sec/b.tex": "B", "y.bbl": "z", "../evil.tex": "no"}
    (tmp_path / "2301.00001.tar.gz").write_bytes(archive(body))
    (tmp_path / "2301.00002.gz").write_bytes(gzip.compress(b"\\documentclass{a} one"))
    (tmp_path / "2301.00003.tex").write_bytes(b"% plain")
    files = papers.extracted(papers.archives(spark, str(tmp_path)))
    assert {(r.paper_id, r.path) for r in files.collect()} == {("2301.00001", p) for p in ("main.tex", "sec/a.tex", "sec/b.tex", "y.bbl")} | {("2301.00002", "paper.tex"), ("2301.00003", "paper.tex")}
    mains = papers.main_files(files)
    got = {r.paper_id: r.tex for r in papers.flattened(files, mains).collect()}
    assert got["2301.00001"] == "A B \\input{a}\n% \\input{no}\n\\input{x.bbl}\n\\input{y.bbl}"
    reach = papers.include_closure(papers.include_edges(files), mains.select("paper_id", "path"))
    assert {(r.path, r.depth) for r in reach.where("paper_id = '2301.00001'").collect()} == {("main.tex", 0), ("sec/a.tex", 1), ("sec/b.tex", 2)}


def test_settings(tmp_path):
    p = tmp_path / "s.json"
    settings.set_value(str(p), "llm.temperature", "0.5")
    assert settings.load_settings(str(p))["llm"]["temperature"] == 0.5
    with pytest.raises(ValueError):
        settings.load_settings(None, models=[])
    (tmp_path / "r.json").write_text('{"rules": [{"id": "a", "description": "d", "pattern": "x"}, {"id": "b"}, {"id": "c", "description": "d", "pattern": "("}]}')
    assert [r["id"] for r in settings.rule_list(str(tmp_path / "r.json"))] == ["a"]


@pytest.mark.parametrize(
    "families, want",
    [
        (["Noto Sans CJK SC", "Arial"], ("Noto Serif CJK SC", "Noto Sans CJK SC", "Noto Sans Mono CJK SC")),  # no group has a main font
        (["SimSun", "SimHei", "Noto Sans CJK SC", "FangSong"], ("SimSun", "SimHei", "FangSong")),  # all from one group
        (["source han serif sc bold", "FandolSong"], ("source han serif sc bold",) * 3),
        (["FandolSong", "FandolHei"], ("FandolSong", "FandolHei", "FandolHei")),
        ([], ("Noto Serif CJK SC", "Noto Sans CJK SC", "Noto Sans Mono CJK SC")),
    ],
)
def test_fonts(spark, families, want):
    assert tuple(settings.pick_fonts(spark.createDataFrame([(f,) for f in families], "family string")).first()) == want


def test_includes_in_circles_end(spark):
    """Two files that ask for each other twice, a chain of 60 files, and a file that several reach."""
    edges = [("p", "a", "b"), ("p", "a", "b"), ("p", "b", "a"), ("p", "b", "a"), ("p", "b", "c"), ("p", "a", "c"), ("p", "a", None)] + [("q", f"f{i}", f"f{i + 1}") for i in range(60)]
    got = papers.include_closure(spark.createDataFrame(edges, "paper_id string, parent string, child string"), spark.createDataFrame([("p", "a"), ("q", "f55"), ("r", "alone")], "paper_id string, path string"))
    assert {tuple(r) for r in got.collect()} == {("p", "a", 0), ("p", "b", 1), ("p", "c", 1), ("r", "alone", 0)} | {("q", f"f{55 + i}", i) for i in range(6)}


def test_replies_are_kept_as_waves_finish(spark, tmp_path):
    """A run that breaks off leaves its replies; the next asks only for the rest; chunks keep their order."""
    from texmill.plans import translate

    rows = [("d", k, f"c{k}", f"text {k} " + "x" * 400) for k in range(9)]
    table = spark.createDataFrame(rows, "doc_id string, ord int, chunk_id string, content string")
    state = str(tmp_path / "state")
    whole, calls = translate.providers.complete, []

    def breaks(requests, *a, **k):
        n = requests.count()
        if sum(calls) + n > 6:
            raise RuntimeError("killed")
        calls.append(n)
        return whole(requests, *a, **k)

    options = translate.Options(state=state, work=str(tmp_path / "work"), wave=2, tries=1)
    translate.providers.complete = breaks
    try:
        with pytest.raises(RuntimeError):
            translate.translate_chunks(table, options=options)
        kept = spark.read.parquet(f"{state}.replies").where("reply is not null").count()
        assert kept == sum(calls) > 0
        first, calls[:] = kept, []
        translate.providers.complete = lambda requests, *a, **k: calls.append(requests.count()) or whole(requests, *a, **k)
        got = translate.translate_chunks(table, options=options).orderBy("ord").collect()
    finally:
        translate.providers.complete = whole
    assert first + sum(calls) == 9 and [r.chunk_id for r in got] == [f"c{k}" for k in range(9)] and not any(r.skipped for r in got)


def test_the_bound_on_calls_is_one_for_all_tasks(spark):
    requests = spark.createDataFrame([(str(k), [{"role": "user", "content": str(k)}]) for k in range(40)], "request_id string, messages array<struct<role:string,content:string>>").repartition(20)
    got = providers.complete(requests, providers.Offline(), concurrency=3)
    assert got.count() == 40 and got.rdd.getNumPartitions() <= 3


def test_contexts_are_made_once_and_given_up(monkeypatch):
    sent = []

    def send(self, url, body):
        sent.append(url.rsplit("example", 1)[1])
        if "context/chat" in url and body["context_id"] == "gone":
            raise RuntimeError("no such context")
        return {"id": "made"} if url.endswith("create") else {"choices": [{"message": {"content": " ok "}}], "usage": {"total_tokens": 1}}

    monkeypatch.setattr(providers.Http, "_send", send)
    p = providers.provider("ark", model="m", url="http://example/chat/completions")
    asked = [{"role": "system", "content": "s"}, {"role": "user", "content": "u"}]
    assert p._post(asked).text == p._post(asked).text == "ok"
    assert sent == ["/context/create", "/context/chat/completions", "/context/chat/completions"]
    contexts, key = p._contexts(), next(iter(p._contexts().held))
    contexts.held[key] = ("gone", contexts.held[key][1])
    assert p._post(asked).text == "ok" and sent[3:] == ["/context/chat/completions", "/context/create", "/context/chat/completions"]
    contexts.make = lambda prompt: "gone"
    contexts.drop(key)
    sent.clear()
    assert p._post(asked).text == "ok" and sent == ["/context/chat/completions"] * 2 + ["/chat/completions"]


def test_translated_documents_as_files(spark, tmp_path):
    from texmill.plans.translate import Options, translate_documents

    given = spark.createDataFrame([("d", TEX), ("e", TEX.replace("long", "very long"))], "doc_id string, tex string")
    tables = translate_documents(given, options=Options(work=str(tmp_path / "work")))
    made = {r.doc_id: r.tex for r in tables["documents"].collect()}
    assert all("xeCJK" in t for t in made.values())
    rebuild.written(tables["documents"], str(tmp_path / "tex"))
    for i, t in made.items():
        held = "".join(p.read_text() for p in (tmp_path / "tex" / f"doc_id={i}").glob("part-*"))
        assert held == t + "\n"
    meta = tables["meta"].first()
    assert meta.total_chunks == tables["results"].count() and meta.total_seconds >= 0
    assert tables["last_calls"].groupBy("doc_id").count().where("count > 1").isEmpty()


def test_experiment(spark):
    from texmill.plans.experiment import temperature_experiment

    out = temperature_experiment(spark, providers.Offline(), "say it", [0.0, 0.5, 1.0], repeats=3)
    assert out["responses"].count() == 9 and {r.unique_texts for r in out["metrics"].collect()} == {1}
    assert out["effect"].first().verdict == "IGNORED"


def test_probe(spark):
    from texmill.plans.experiment import concurrency_probe

    out = concurrency_probe(spark, providers.Offline(fail_on="bad"), "a bad one", calls=7, concurrency=3)
    assert tuple(out["tally"].first()) == (7, 0, 7, None)
    out = concurrency_probe(spark, providers.Offline(), "fine", calls=7, concurrency=3)
    assert tuple(out["tally"].first())[:3] == (7, 7, 0) and out["calls"].where("seconds < 0 or error is not null").isEmpty()


def test_bytes_that_are_no_text(spark, tmp_path):
    (tmp_path / "2301.00009.gz").write_bytes(gzip.compress(b"% caf\xe9"))
    found = papers.archives(spark, str(tmp_path))
    assert papers.extracted(found).first().content == "% caf\ufffd" and papers.extracted(found, strict=True).first().content is None
    assert bytes(papers.members(found).first().data) == b"% caf\xe9"


def test_counts_failures_and_tallies(spark):
    from texmill.operators import analytics

    calls = spark.createDataFrame([("a", True, 1.0), ("a", False, 9.0), ("b", True, 2.0), ("z", True, 4.0)], "model string, ok boolean, seconds double")
    assert [tuple(r) for r in analytics.counts_in_order(calls, ["b", "none", "a"]).collect()] == [(0, "b", 1, 0), (1, "none", 0, 0), (2, "a", 1, 1)]
    assert tuple(analytics.tally(calls).first()) == (4, 3, 1, 2.3333)
    reports = spark.createDataFrame([("2", False, "bad"), ("1", None, None), ("3", True, None)], "paper_id string, parsed boolean, error string")
    assert [tuple(r) for r in analytics.parse_failures(reports).collect()] == [("1", "unknown"), ("2", "bad")]
    values = [1e12, *range(500), 3.0, 3.0, -7.5]
    rows = spark.createDataFrame([(float(v),) for v in values], "x double")
    for nth in (1, 5, 6, 7, 250, len(values)):
        assert analytics.nth_smallest(rows, "x", lambda n, nth=nth: nth, slots=8, few=3).first().value == sorted(values)[nth - 1]
    assert analytics.nth_smallest(rows.limit(0), "x", lambda n: 1).count() == 0


def test_long_and_short_lists_find_the_same(spark, monkeypatch):
    from texmill.operators import glossary, validate

    texts = spark.createDataFrame([(1, "The C++ and the lstm; LSTMs. \u0130x"), (2, None), (3, ""), (4, "a  b 12345 |")], "doc_id long, text string")
    terms = spark.createDataFrame([(k, t, t.upper(), None, None, 0, None) for k, t in enumerate(("the", "C++", "LSTM", "and the", "zzz"))], glossary.COLUMNS)
    rules = spark.createDataFrame([(k, f"r{k}", "d", "error", p, None, None) for k, p in enumerate(("  +", "[0-9]{5,}", "[|]", "(?i)the"))], "ord int, id string, description string, severity string, pattern string, replacement string, trigger string")
    short = sorted(map(repr, glossary.hits(texts, terms).collect())), sorted(map(repr, validate.rule_findings(texts, rules).collect()))
    monkeypatch.setattr(glossary, "LITERALS", 0)
    monkeypatch.setattr(validate, "LITERALS", 0)
    assert short == (sorted(map(repr, glossary.hits(texts, terms).collect())), sorted(map(repr, validate.rule_findings(texts, rules).collect())))
    assert len(short[0]) == 4 and len(short[1]) == 5
    assert [r.term for r in glossary.get(terms, "C++").collect()] == ["C++"] and glossary.get(terms, "c++").isEmpty()


def test_files_beside_a_document(tmp_path):
    from texmill.operators import compiling

    compiling.place(str(tmp_path / "in"), {"fig/a.png": b"1", "../out.txt": b"2", "/abs.txt": b"3", ".hidden": b"4", "b/.git/x": b"5", "refs.bbl": b"6"})
    assert sorted(str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*") if p.is_file()) == ["in/fig/a.png", "in/refs.bbl"]
    compiling.settle_bibliography(str(tmp_path / "in"))
    assert (tmp_path / "in" / "main.bbl").read_bytes() == b"6"
    assert isinstance(compiling.installed_fonts(), list)


def test_stream(spark, tmp_path):
    from texmill.streaming.translate import translate_stream

    chunks(spark).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        translate_stream(spark, str(tmp_path / "in"), str(tmp_path / "state"), str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "state")).count() == 5


def test_state_and_data_source(spark, tmp_path):
    from texmill.sources import state
    from texmill.sources.datasource import Papers

    state.save_parser_state(parsed(spark), str(tmp_path / "s"))
    names = {r.placeholder for r in state.load_valid_placeholders(spark, str(tmp_path / "s")).collect()}
    assert names == {r.id for r in parsed(spark).where("kind = 'placeholder'").collect()}
    calls = spark.createDataFrame([("m", True), ("n", False)], "model string, ok boolean")
    state.append_results(calls, str(tmp_path / "r"), "model")
    assert tuple(state.append_results(calls, str(tmp_path / "r"), "model").first()) == (4, 2, 2, 2)
    (tmp_path / "2301.00001.tar.gz").write_bytes(archive({"main.tex": "x"}))
    spark.dataSource.register(Papers)
    got = spark.read.format("papers").option("ids", "2301.00001, 2301.00002").option("cache", str(tmp_path)).load()
    assert [(r.paper_id, r.path) for r in papers.extracted(got).collect()] == [("2301.00001", "main.tex")]


def test_compiling_without_an_engine(spark):
    from texmill.operators import compiling

    row = compiling.compiled(spark.createDataFrame([("d", "x")], "doc_id string, tex string")).first()
    assert row.success or row.error
    assert [c[0] for c in compiling.passes("e", "bibtex")] == ["e", "bibtex", "e", "bibtex", "e", "e"]
