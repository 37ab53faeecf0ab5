"""The whole way: sources to chunks, chunks to translations, translations to documents and findings."""

from __future__ import annotations

import datetime
import logging
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from texmill.functions import text as fn
from texmill.operators import batching, glossary, integrity, parse, prompts, providers, rebuild, validate
from texmill.sources.scratch import fresh_path, stored

RESULT = "chunk_id string, doc_id string, source string, translation string, batched boolean, skipped boolean, skip_reason string, usage string, source_soft long, source_paragraph long, decoded_soft long, decoded_paragraph long, ord long"
REPLIES = "key string, reply string, usage string, error string, tries int"
log = logging.getLogger(__name__)


@dataclass
class Options:
    provider: providers.Provider = field(default_factory=providers.Offline)
    short: int = batching.SHORT
    batch_chars: int = batching.BATCH_CHARS
    concurrency: int = 50  # calls at once, over all tasks
    wave: int = 2000  # requests between two writes of replies: a run that is killed loses at most those
    tries: int = 5
    per_call: float = 150.0
    base_delay: float = 1.0
    style: str | None = None
    protected: tuple[str, ...] = ()  # environments to protect besides the known ones
    examples: list[dict] = field(default_factory=list)
    state: str | None = None  # folder of results that are never asked for again; replies are kept in the folder of that name and .replies
    work: str | None = None  # folder for results of the calls; else beside the checkpoints
    cjk: tuple[str, str, str] | None = ("Noto Serif CJK SC", "Noto Sans CJK SC", "Noto Sans Mono CJK SC")  # fonts to put in; None: none


def _stored(df: DataFrame, options: Options) -> DataFrame:
    """Calls are paid for: what they need and give is written before anything branches from it."""
    return stored(df, "translate", options.work)


def _held(spark, path: str | None, schema: str) -> DataFrame | None:
    """The table that a folder holds, or None where there is no folder yet."""
    if not path:
        return None
    try:
        table = spark.read.schema(schema).parquet(path)
        table.schema  # noqa: B018  looks the folder up
        return table
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in (error.getCondition() or ""):
            raise
        return None


def results(spark, path: str | None) -> DataFrame | None:
    """Results that a state folder holds, or None."""
    return _held(spark, path, RESULT)


def _examples(options: Options):
    if not options.examples:
        return F.expr("cast(array() as array<struct<source:string,target:string>>)")
    return F.array(*(F.struct(F.lit(e["source"]).alias("source"), F.lit(e["target"]).alias("target")) for e in options.examples))


def translate_chunks(chunks: DataFrame, terms: DataFrame | None = None, abstracts: DataFrame | None = None, options: Options | None = None) -> DataFrame:
    """Results of all chunks (doc_id, ord, chunk_id, content): one row each, in RESULT's columns; ord restores their order.

    Replies are written as waves of requests finish, and one that was given is never asked for again. Chunks with a stored result are not asked for again. A chunk that is one placeholder is its own translation;
    short ones go in numbered batches, long ones alone; a batch with a bad reply goes again chunk by chunk; what
    still fails keeps its source and says why.
    """
    options = options or Options()
    spark = chunks.sparkSession
    held = results(spark, options.state)
    todo = batching.pending(chunks, held) if held is not None else chunks
    todo = _stored(todo.select("doc_id", "ord", "chunk_id", "content", batching.route(F.col("content"), options.short).alias("way")), options)

    wanted = todo.where("way <> 'placeholder'")
    docs = wanted.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "content"))), lambda x: x["content"]), " ").alias("text"))
    hints = glossary.hints(docs, terms).select("doc_id", "hints") if terms is not None else docs.select("doc_id", F.expr("cast(map() as map<string,string>)").alias("hints"))
    known = hints.join(abstracts.select("doc_id", "abstract"), "doc_id", "left") if abstracts is not None else hints.withColumn("abstract", F.lit(None).cast("string"))
    style = F.lit(options.style) if options.style else None
    system = lambda batch: prompts.system_prompt(style, F.col("hints"), prompts.merged_context(F.lit(None).cast("string"), F.col("abstract"), batch), options.provider.stateful)
    known = _stored(known.select("doc_id", system(False).alias("alone"), system(True).alias("in_batch")), options)

    coded = wanted.withColumn("coded", fn.encode_line_ends(F.col("content")))
    short = coded.where("way = 'short'")
    numbers = batching.greedy_batches(short, "doc_id", "ord", "content", options.batch_chars)
    batched = short.join(numbers, ["doc_id", "ord"]).groupBy("doc_id", "batch").agg(F.array_sort(F.collect_list(F.struct("ord", "chunk_id", "coded"))).alias("of"))
    batches = batched.select("doc_id", F.concat_ws(":", F.lit("b"), "doc_id", "batch").alias("request_id"), F.col("of.ord")[0].alias("ord"), F.col("of.chunk_id").alias("ids"), batching.numbered(F.col("of.coded")).alias("user"))
    longs = coded.where("way = 'long'").select("doc_id", F.concat(F.lit("c:"), "chunk_id").alias("request_id"), "ord", F.array("chunk_id").alias("ids"), F.col("coded").alias("user"))
    first = _stored(batches.unionByName(longs), options)
    answered = _ask(first, known, options)

    said = F.when(F.col("request_id").startswith("b:"), batching.parse_reply(F.col("reply"), F.size("ids"))).otherwise(F.when(F.col("reply").isNotNull(), F.array("reply")))
    read = _stored(first.join(answered, "request_id", "left").withColumn("said", said), options)
    failed = read.where("request_id like 'b:%' and coalesce(size(said), 0) <= 0").select(F.explode("ids").alias("chunk_id"))
    again = coded.join(failed, "chunk_id").select("doc_id", F.concat(F.lit("c:"), "chunk_id").alias("request_id"), "ord", F.array("chunk_id").alias("ids"), F.col("coded").alias("user"))
    again = _stored(again, options)
    second = again if again.isEmpty() else again.join(_ask(again, known, options), "request_id", "left")
    if again.isEmpty():
        second = again.withColumns({c: F.lit(None).cast(t) for c, t in (("reply", "string"), ("usage", "string"), ("error", "string"), ("tries", "int"))})
    second = second.withColumn("said", F.when(F.col("reply").isNotNull(), F.array("reply")))

    one = lambda df: df.select(F.explode(F.arrays_zip("ids", F.coalesce("said", F.expr("cast(array() as array<string>)")).alias("said"))).alias("x"), F.col("request_id").startswith("b:").alias("batched"), "usage", "error").select(F.col("x.ids").alias("chunk_id"), F.col("x.said").alias("said"), "batched", "usage", "error")
    done = one(read.where("not (request_id like 'b:%' and coalesce(size(said), 0) <= 0)")).unionByName(one(second))
    decoded = fn.decode_line_ends(F.col("said"))
    source, target = fn.line_break_counts(F.col("content")), fn.line_break_counts(decoded)
    asked = wanted.join(done, "chunk_id", "left").select(
        "chunk_id",
        "doc_id",
        F.col("content").alias("source"),
        F.coalesce(decoded, F.col("content")).alias("translation"),
        F.coalesce("batched", F.lit(False)).alias("batched"),
        F.col("said").isNull().alias("skipped"),
        F.when(F.col("said").isNull(), F.coalesce(fn.short_error(F.col("error")), F.lit("no answer"))).alias("skip_reason"),
        "usage",
        source["soft"].alias("source_soft"),
        source["paragraph"].alias("source_paragraph"),
        target["soft"].alias("decoded_soft"),
        target["paragraph"].alias("decoded_paragraph"),
        F.col("ord").cast("long").alias("ord"),
    )
    through = todo.where("way = 'placeholder'").selectExpr(
        "chunk_id", "doc_id", "content as source", "content as translation", "false as batched", "false as skipped", "cast(null as string) as skip_reason", "cast(null as string) as usage",
        "0L as source_soft", "0L as source_paragraph", "0L as decoded_soft", "0L as decoded_paragraph", "cast(ord as bigint) as ord",
    )
    new = _stored(asked.unionByName(through), options)
    if options.state:
        new.where("not skipped").write.mode("append").parquet(options.state)
    if held is None:
        return new
    return new.where("skipped").unionByName(results(spark, options.state).join(chunks.select("chunk_id"), "chunk_id", "left_semi").dropDuplicates(["chunk_id"]))


def _ask(requests: DataFrame, known: DataFrame, options: Options) -> DataFrame:
    """Replies to requests (doc_id, request_id, ord, user), in waves; those that the state holds are not asked for.

    A reply belongs to all that was asked: provider, model, prompts and text (and, of a stateful provider, the unit).
    """
    spark, p = requests.sparkSession, options.provider
    chosen = F.when(F.col("request_id").startswith("b:"), F.col("in_batch")).otherwise(F.col("alone"))
    ready = requests.join(known, "doc_id").withColumn("system", chosen)
    asked = prompts.messages(F.col("system"), _examples(options), F.col("user"))
    unit = [F.col("request_id")] if p.stateful else []
    key = F.sha2(F.to_json(F.struct(F.lit(p.name).alias("p"), F.lit(p.model).alias("m"), asked.alias("x"), *unit)), 256)
    ready = _stored(ready.select("doc_id", "request_id", "ord", "system", "user", asked.alias("messages"), key.alias("key")), options)
    folder = f"{options.state.rstrip('/')}.replies" if options.state else fresh_path(spark, "replies", options.work)
    held = _held(spark, folder, REPLIES)
    todo = ready if held is None else ready.join(held.where("reply is not null").select("key").distinct(), "key", "left_anti")
    todo = todo if p.stateful else todo.dropDuplicates(["key"])
    n = todo.count()
    waves = -(-n // options.wave)
    todo = _stored(todo.withColumn("wave", F.pmod(F.xxhash64("doc_id" if p.stateful else "key"), F.lit(max(1, waves)))), options)
    limits = {"tries": options.tries, "per_call": options.per_call, "base_delay": options.base_delay}
    for w in range(waves):
        wave = todo.where(F.col("wave") == w)
        if p.stateful:
            replies = providers.complete_in_order(wave.select("doc_id", "ord", F.col("key").alias("request_id"), "system", "user"), p, **limits)
        else:
            replies = providers.complete(wave.select(F.col("key").alias("request_id"), "messages"), p, options.concurrency, **limits)
        replies.withColumnRenamed("request_id", "key").select("key", "reply", "usage", "error", "tries").write.mode("append").parquet(folder)
        log.info("wave %d of %d is answered", w + 1, waves)
    got = _held(spark, folder, REPLIES) if n or held is not None else spark.createDataFrame([], REPLIES)
    best = got.groupBy("key").agg(F.max_by(F.struct("reply", "usage", "error", "tries"), F.struct(F.col("reply").isNotNull(), "tries")).alias("r"))
    return _stored(ready.select("request_id", "key").join(best, "key").select("request_id", "r.*"), options)


def translate_documents(docs: DataFrame, terms: DataFrame | None = None, options: Options | None = None, key: str = "doc_id", column: str = "tex") -> dict[str, DataFrame]:
    """Tables of a translation of docs: parsed, results, issues, documents, findings, verdicts, meta, last_calls.

    Fonts for CJK go into the preamble before parsing, unless options.cjk is None.
    """
    options, started = options or Options(), datetime.datetime.now(datetime.UTC)
    named = docs.select(F.col(key).cast("string").alias("doc_id"), F.col(column).alias("tex"))
    source = named if options.cjk is None else named.withColumn("tex", fn.inject_cjk(fn.remove_comments(fn.unify_line_ends(F.col("tex"))), *options.cjk))
    parsed = _stored(parse.parse(source, options.protected), options)
    chunks = parsed.where("kind = 'chunk' and context <> 'protected'").select("doc_id", "ord", F.col("id").alias("chunk_id"), "content")
    abstracts = named.select("doc_id", fn.abstract(F.col("tex")).alias("abstract"))
    found = translate_chunks(chunks, terms, abstracts, options)
    valid = parsed.where("kind = 'placeholder'").select(F.col("id").alias("placeholder"))
    fixed = _stored(integrity.repaired(found.select("chunk_id", "source", "translation"), valid), options)
    made = _stored(rebuild.rebuild(parsed, fixed.select("chunk_id", "translation")), options)
    pairs = named.select("doc_id", fn.remove_comments(F.col("tex")).alias("original")).join(made.select("doc_id", F.col("tex").alias("translated")), "doc_id")
    lines = made.select("doc_id", F.explode("start_lines").alias("chunk_id", "start_line"))
    texts = validate.pair_findings(pairs)
    braces = validate.chunk_brace_findings(fixed.join(lines, "chunk_id", "left").select("doc_id", "chunk_id", "source", "translation", "start_line").withColumn("both", F.struct("doc_id", "chunk_id")), "both")
    findings = texts.unionByName(braces.select("both.doc_id", F.lit("chunk_braces").alias("check"), F.lit("error").alias("severity"), F.concat_ws(" ", F.lit("Line"), "line", F.lit("expected"), "expected", F.lit("got"), "got").alias("message")))
    issues = fixed.select("chunk_id", F.explode("issues").alias("i")).select("chunk_id", "i.*")
    meta = run_meta(found, options.provider.model, started, datetime.datetime.now(datetime.UTC))
    calls = found.where("usage is not null").select("doc_id", "ord", providers.usage_meta(F.col("usage"), options.provider.name).alias("u")).select("doc_id", "ord", "u.*")
    last = latest_per(calls, "doc_id", "ord")
    return {"parsed": parsed, "results": found, "issues": issues, "documents": made, "findings": findings, "verdicts": validate.verdict(named, findings), "meta": meta, "last_calls": last}


def run_meta(found: DataFrame, model: str, started, finished) -> DataFrame:
    """One row on a run: model, chunks, skipped ones, start, end, seconds."""
    row = found.agg(F.count("*").alias("total_chunks"), F.count_if("skipped").alias("skipped_chunks"))
    return row.select(F.lit(model).alias("model"), "total_chunks", "skipped_chunks", F.lit(started).alias("started_at"), F.lit(finished).alias("finished_at"), F.lit(round((finished - started).total_seconds(), 2)).alias("total_seconds"))


def latest_per(rows: DataFrame, key: str, at: str) -> DataFrame:
    """The last row of each key, as a session's last call has its cache figures."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(at)))).where("_r = 1").drop("_r")
