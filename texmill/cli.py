"""Command line: translate, validate, config show|set, glossary add, ping."""

from __future__ import annotations

import argparse
import asyncio
import json
from pathlib import Path

from texmill.operators import providers
from texmill.sources import settings


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("texmill").config("spark.sql.session.timeZone", "UTC").config("spark.speculation", "false").getOrCreate()


def _provider(s: dict) -> providers.Provider:
    llm = s["llm"]
    if llm["sdk"] in (None, "offline"):
        return providers.Offline()
    return providers.provider(llm["sdk"], model=llm["models"], url=llm["endpoint"] or "", key_variable=llm["key_variable"] or "", temperature=llm["temperature"])


def translate(a, s) -> int:
    from texmill.operators.compiling import compiled, installed_fonts
    from texmill.operators.rebuild import written
    from texmill.plans.translate import Options, translate_documents
    from texmill.sources import papers
    from texmill.sources.state import save_report

    spark, beside = _session(), None
    if a.source.endswith(".tex"):
        docs = spark.createDataFrame([(Path(a.source).stem, Path(a.source).read_text(encoding="utf-8"))], "doc_id string, tex string")
    else:
        files = papers.extracted(papers.archives(spark, a.source))
        docs = papers.flattened(files, papers.main_files(files)).withColumnRenamed("paper_id", "doc_id")
        beside = papers.members(papers.archives(spark, a.source)).withColumnRenamed("paper_id", "doc_id")
    terms = settings.load_glossary(spark, None, a.glossary) if a.glossary else None
    t = s["translation"]
    examples = [r.asDict() for r in settings.load_examples(spark, t["examples_path"]).select("source", "target").collect()]
    given = s["fonts"]
    fonts = settings.pick_fonts(spark.createDataFrame([(n,) for n in installed_fonts()], "family string")).first() if given["auto_detect"] else {}
    cjk = tuple(given[k] or (fonts[k] if fonts else settings.FONT_GROUPS[0][k][0]) for k in ("main", "sans", "mono"))
    options = Options(_provider(s), t["batch_short_threshold"], t["batch_max_chars"], a.concurrency, style=t["custom_system_prompt"], examples=examples, state=f"{a.output}/state", work=f"{a.output}/work", cjk=cjk, protected=tuple(s["parser"]["extra_protected_environments"]))
    tables = translate_documents(docs, terms, options)
    for name in ("documents", "issues", "findings", "verdicts", "last_calls"):
        tables[name].write.mode("overwrite").parquet(f"{a.output}/{name}")
    save_report(tables["meta"], f"{a.output}/meta")
    written(tables["documents"], f"{a.output}/tex")
    if a.pdf:
        out = compiled(tables["documents"], beside, s["compilation"]["timeout"])
        out.write.mode("overwrite").parquet(f"{a.output}/pdf")
    tables["verdicts"].show(truncate=False)
    return 0


def validate(a, _) -> int:
    from texmill.operators.validate import brace_findings, pair_findings

    spark = _session()
    text = Path(a.file).read_text(encoding="utf-8")
    original = Path(a.original).read_text(encoding="utf-8") if a.original else None
    row = spark.createDataFrame([(a.file, original, text)], "doc_id string, original string, translated string")
    found = pair_findings(row).collect() + brace_findings(row, column="translated").collect()
    for f in found:
        print(f"{f.severity}: {f.check}: {f.message}")
    return int(any(f.severity == "error" for f in found))


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="texmill", description=__doc__)
    p.add_argument("--settings")
    sub = p.add_subparsers(required=True)
    t = sub.add_parser("translate")
    t.add_argument("source", help="a .tex file or a folder of archives")
    t.add_argument("--output", default="output")
    t.add_argument("--glossary")
    t.add_argument("--concurrency", type=int, default=50)
    t.add_argument("--pdf", action="store_true", help="compile the documents where a TeX engine is installed")
    for flag in ("sdk", "model", "endpoint"):
        t.add_argument(f"--{flag}")
    t.set_defaults(run=translate)
    v = sub.add_parser("validate")
    v.add_argument("file")
    v.add_argument("--original")
    v.set_defaults(run=validate)
    c = sub.add_parser("config").add_subparsers(required=True)
    c.add_parser("show").set_defaults(run=lambda a, s: print(json.dumps(s, indent=2)) or 0)
    one = c.add_parser("set")
    one.add_argument("key")
    one.add_argument("value")
    one.set_defaults(run=lambda a, s: settings.set_value(a.settings or "settings.json", a.key, a.value) and 0)
    g = sub.add_parser("glossary").add_subparsers(required=True).add_parser("add")
    g.add_argument("file")
    g.add_argument("term")
    g.add_argument("target")

    def add(a, _) -> int:
        held = json.loads(Path(a.file).read_text(encoding="utf-8")) if Path(a.file).exists() else {}
        Path(a.file).write_text(json.dumps(held | {a.term: a.target}, indent=2, ensure_ascii=False), encoding="utf-8")
        return 0

    g.set_defaults(run=add)
    sub.add_parser("ping").set_defaults(run=lambda a, s: print(asyncio.run(_provider(s).ping())) or 0)
    a = p.parse_args(argv)
    flags = {"sdk": getattr(a, "sdk", None), "models": getattr(a, "model", None), "endpoint": getattr(a, "endpoint", None)}
    return a.run(a, settings.load_settings(a.settings, **flags))


if __name__ == "__main__":
    raise SystemExit(main())
