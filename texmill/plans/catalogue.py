"""One registered query per operator, and the SQL that gives the same rows on another engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from texmill.functions import brackets, text as fn
from texmill.operators import analytics, batching, glossary, integrity, parse, prompts, providers, rebuild, validate
from texmill.plans import fixtures as fx
from texmill.sources import papers

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
B = "chr(92)"
BLANKS = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tex(spark, sf_dir):
    return fx.made(spark, sf_dir, fx.TEX)


def _pairs(spark, sf_dir):
    return fx.made(spark, sf_dir, fx.PAIRS)


# Sources


@query("SELECT page_id, nullif(coalesce(nullif(regexp_extract(s, '[0-9]{4}\\.[0-9]{4,5}(v[0-9]+)?'), ''), regexp_extract(s, '[a-z-]+(\\.[A-Z]{2})?/[0-9]{7}')), '') AS paper_id FROM (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN concat('https://x/abs/', CAST(2000 + page_id % 90 AS STRING), '.', CAST(10000 + page_id % 1000 AS STRING), 'v', CAST(page_id % 9 AS STRING)) WHEN page_id % 3 = 1 THEN concat('hep-th/', CAST(9900000 + page_id AS STRING)) ELSE url END AS s FROM pages) t")
def paper_ids(spark, sf_dir):
    made = "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN concat('https://x/abs/', CAST(2000 + page_id % 90 AS STRING), '.', CAST(10000 + page_id % 1000 AS STRING), 'v', CAST(page_id % 9 AS STRING)) WHEN page_id % 3 = 1 THEN concat('hep-th/', CAST(9900000 + page_id AS STRING)) ELSE url END AS s FROM pages"
    return fx.made(spark, sf_dir, made).select("page_id", fn.paper_id(F.col("s")).alias("paper_id"))


@query(f"""WITH f AS ({fx.FILES}), r AS (SELECT paper_id, path, size, list_position(['main.tex','paper.tex','arxiv.tex','ms.tex','article.tex'], lower(regexp_extract(path, '([^/]+)$', 1))) AS place,
    contains(regexp_replace(left(content, 5000), '%[^\\n]*', '', 'g'), concat({B}, 'documentclass')) AS classed FROM f WHERE path LIKE '%.tex'),
  k AS (SELECT *, CASE WHEN place > 0 THEN 0 WHEN classed THEN 1 ELSE 2 END AS rank FROM r)
  SELECT paper_id, path, CASE rank WHEN 0 THEN 'name' WHEN 1 THEN 'documentclass' ELSE 'largest' END AS method FROM (
    SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY rank, CASE WHEN rank = 0 THEN place END, CASE WHEN rank = 2 THEN -size END, path) AS n FROM k) WHERE n = 1""")
def main_file_rank(spark, sf_dir):
    return papers.main_files(fx.made(spark, sf_dir, fx.FILES))


@query(f"""WITH RECURSIVE f AS ({fx.FILES}),
  e AS (SELECT paper_id, path AS parent, unnest(regexp_extract_all(content, '(input|include)\\{{([^}}]*)\\}}', 2)) AS name FROM f),
  c AS (SELECT e.paper_id, parent, coalesce(max(CASE WHEN f.path = name THEN f.path END), max(f.path)) AS child FROM e JOIN f ON f.paper_id = e.paper_id AND f.path IN (name, concat(name, '.tex')) GROUP BY e.paper_id, parent, name),
  r(paper_id, path, depth) AS (SELECT paper_id, path, 0 FROM f WHERE path IN ('paper.tex', 'ms.tex', 'zeta.tex') UNION ALL SELECT c.paper_id, c.child, r.depth + 1 FROM r JOIN c ON c.paper_id = r.paper_id AND c.parent = r.path WHERE r.depth < 32)
  SELECT paper_id, path, min(depth) AS depth FROM r GROUP BY paper_id, path""")
def include_closure(spark, sf_dir):
    files = fx.made(spark, sf_dir, fx.FILES)
    roots = files.where(F.col("path").isin("paper.tex", "ms.tex", "zeta.tex")).select("paper_id", "path")
    return papers.include_closure(papers.include_edges(files), roots)


@query(f"""WITH f AS ({fx.FILES}), k AS (SELECT paper_id, bool_or(path IN ('refs.bib')) AS bib, bool_or(path IN ('main.bbl')) AS bbl FROM f GROUP BY paper_id)
  SELECT paper_id AS id, CASE WHEN NOT bib AND bbl THEN 'input' ELSE 'keep' END AS decision, CASE WHEN NOT bib AND bbl THEN concat({B}, 'input{{refs.bbl}}', chr(10), {B}, 'input{{main.bbl}}') ELSE concat({B}, 'bibliography{{refs,main}}') END AS text FROM k""")
def bibliography_decision(spark, sf_dir):
    files = fx.made(spark, sf_dir, fx.FILES).select(F.col("paper_id").alias("dir"), F.col("path").alias("name"))
    commands = files.select(F.col("dir").alias("id"), "dir").distinct().withColumn("names", F.lit("refs, main"))
    return papers.bibliography_decisions(commands, files)


@query(f"""WITH f AS ({fx.FILES}), c AS (SELECT paper_id, path, CASE lower(regexp_extract(path, '(\\.[^./]+)$', 1)) WHEN '.tex' THEN 'tex' WHEN '.bib' THEN 'bib' WHEN '.png' THEN 'image' ELSE 'other' END AS k FROM f)
  SELECT paper_id, count(*) AS n_files, count(*) FILTER (WHERE k = 'tex') AS n_tex, count(*) FILTER (WHERE k = 'bib') AS n_bib, count(*) FILTER (WHERE k = 'image') AS n_image, count(*) FILTER (WHERE k = 'style') AS n_style, count(*) FILTER (WHERE k = 'other') AS n_other, bool_or(contains(path, '/')) AS has_subdirs FROM c GROUP BY paper_id""")
def file_structure_profile(spark, sf_dir):
    return analytics.file_structure(fx.made(spark, sf_dir, fx.FILES)).drop("extensions")


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'gz' WHEN page_id % 3 = 1 THEN 'tex' ELSE 'unknown' END AS kind FROM pages")
def archive_kinds(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages")
    content = F.when(F.col("page_id") % 3 == 0, F.unhex(F.lit("1F8B0800"))).when(F.col("page_id") % 3 == 1, F.lit("\\documentclass{x}").cast("binary")).otherwise(F.lit("plain").cast("binary"))
    return pages.select("page_id", fn.archive_kind(content).alias("kind"))


@query(f"""WITH f AS ({fx.FILES}), r AS (SELECT paper_id, path, list_position(['main.tex','paper.tex','arxiv.tex'], lower(regexp_extract(path, '([^/]+)$', 1))) AS place, contains(content, concat({B}, 'documentclass')) AS classed FROM f WHERE path LIKE '%.tex'),
  k AS (SELECT *, CASE WHEN place > 0 THEN 0 WHEN classed THEN 1 ELSE 2 END AS rank FROM r)
  SELECT paper_id, path, CASE rank WHEN 0 THEN 'name' WHEN 1 THEN 'documentclass' ELSE 'first' END AS method FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY rank, CASE WHEN rank = 0 THEN place END, path) AS n FROM k) WHERE n = 1""")
def main_file_survey(spark, sf_dir):
    return papers.main_files(fx.made(spark, sf_dir, fx.FILES), papers.MAIN_NAMES[:3], whole=True)


@query(f"WITH f AS ({fx.FILES}) SELECT paper_id, lower(regexp_extract(path, '(\\.[^./]+)$', 1)) AS ext, count(*) AS n FROM f GROUP BY ALL")
def extension_map(spark, sf_dir):
    return analytics.file_structure(fx.made(spark, sf_dir, fx.FILES)).select("paper_id", F.explode("extensions").alias("ext", "n"))


@query(f"WITH f AS ({fx.FILES}) SELECT CASE lower(regexp_extract(path, '(\\.[^./]+)$', 1)) WHEN '.tex' THEN 'tex' WHEN '.bib' THEN 'bib' WHEN '.png' THEN 'image' ELSE 'other' END AS kind, count(*) AS n FROM f GROUP BY 1")
def member_classes(spark, sf_dir):
    return analytics.histogram(fx.made(spark, sf_dir, fx.FILES).select(fn.member_class(F.col("path")).alias("kind")), "kind")


@query("SELECT 'SimSun' AS main, 'SimHei' AS sans, 'FangSong' AS mono")
def font_choice(spark, sf_dir):
    from texmill.sources.settings import pick_fonts

    return pick_fonts(spark.range(1).select(F.explode(F.array(*map(F.lit, ("Arial", "Noto Sans CJK SC", "SimSun", "SimHei", "FangSong")))).alias("family")))


# Text functions


@query("SELECT page_id, CASE page_id % 3 WHEN 0 THEN concat('https://api', CAST(page_id AS STRING)) ELSE concat('https://api', CAST(page_id AS STRING), '/v2') END AS endpoint FROM pages")
def endpoint_normalise(spark, sf_dir):
    host = F.concat(F.lit("https://api"), F.col("page_id").cast("string"))
    url = F.when(F.col("page_id") % 3 == 0, F.concat(host, F.lit("/v1/chat/completions"))).when(F.col("page_id") % 3 == 1, F.concat(host, F.lit("/v2/messages/"))).otherwise(F.concat(host, F.lit("/v2/")))
    return _table(spark, sf_dir, "pages").select("page_id", fn.endpoint(url).alias("endpoint"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_id ELSE 0 END AS n, left(concat('failed ', repeat('x ', 150)), 240) AS error FROM events")
def safe_values(spark, sf_dir):
    raw = F.when(F.col("event_id") % 2 == 0, F.col("event_id").cast("string")).otherwise("many")
    return _table(spark, sf_dir, "events").select("event_id", fn.safe_int(raw).alias("n"), fn.short_error(F.concat(F.lit(" failed  "), F.repeat(F.lit("x "), 150))).alias("error"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN concat('! Undefined ', CAST(event_id AS STRING), chr(10), 'l.1', chr(10), 'l.2', chr(10), 'l.3', chr(10), 'l.4') WHEN 1 THEN 'x Fatal error y' END AS error FROM events")
def tex_errors(spark, sf_dir):
    e = F.col("event_id")
    log = F.when(e % 3 == 0, F.concat(F.lit("start\n! Undefined "), e.cast("string"), F.lit("\nl.1\nl.2\nl.3\nl.4\nl.5"))).when(e % 3 == 1, "a\nx Fatal error y\nb").otherwise("fine")
    return _table(spark, sf_dir, "events").select("event_id", fn.first_tex_error(log).alias("error"))


@query("SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'biber' WHEN 1 THEN 'bibtex' END AS tool FROM pages")
def bibliography_tools(spark, sf_dir):
    p = F.col("page_id")
    tex = F.when(p % 3 == 0, "\\usepackage[style=x]{biblatex}").when(p % 3 == 1, "\\bibliography{a}").otherwise("none")
    return _table(spark, sf_dir, "pages").select("page_id", fn.bibliography_tool(tex).alias("tool"))


@query("SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'bool' WHEN 1 THEN 'int' WHEN 2 THEN 'float' ELSE 'string' END AS kind, CASE page_id % 4 WHEN 0 THEN 'true' WHEN 1 THEN CAST(page_id AS STRING) WHEN 2 THEN concat(CAST(page_id AS STRING), '.5') ELSE 'words' END AS value FROM pages")
def config_values(spark, sf_dir):
    p = F.col("page_id")
    raw = F.when(p % 4 == 0, "True").when(p % 4 == 1, p.cast("string")).when(p % 4 == 2, F.concat(p.cast("string"), F.lit(".5"))).otherwise("words")
    return _table(spark, sf_dir, "pages").select("page_id", fn.config_value(raw).alias("v")).select("page_id", "v.kind", "v.value")


_CLEANED = f"""t AS ({fx.TEX}), l AS (SELECT doc_id, list_transform(string_split(tex, chr(10)), lambda x: {{'line': x, 'cut': CASE WHEN left(ltrim(x), 1) = '%' THEN NULL ELSE rtrim(regexp_replace(regexp_replace(x, '^%.*$', ''), '([^' || repeat({B}, 2) || '])%.*$', concat({B}, '1'))) END}}) AS ls FROM t),
  cleaned AS (SELECT doc_id, array_to_string(list_transform(list_filter(ls, lambda x: x.cut IS NOT NULL AND (trim(x.cut) <> '' OR trim(x.line) = '')), lambda x: x.cut), chr(10)) AS clean FROM l)"""


@query(f"WITH {_CLEANED} SELECT doc_id, md5(clean) AS digest FROM cleaned")
def strip_comments(spark, sf_dir):
    return _tex(spark, sf_dir).select("doc_id", F.md5(fn.remove_comments(F.col("tex"))).alias("digest"))


@query(f"""WITH t AS ({fx.TEX}), p AS (SELECT doc_id, tex, instr(tex, concat({B}, 'begin{{document}}')) AS i FROM t)
  SELECT doc_id, md5(left(tex, CAST(i + 15 AS INTEGER))) AS preamble, md5(substring(tex, CAST(i + 16 AS INTEGER))) AS body FROM p""")
def split_preamble(spark, sf_dir):
    parts = fn.split_document(F.col("tex"))
    return _tex(spark, sf_dir).select("doc_id", F.md5(parts["preamble"]).alias("preamble"), F.md5(parts["body"]).alias("body"))


@query("SELECT doc_id, concat('On ', lang, ' and ', source, '.') AS abstract FROM documents WHERE text IS NOT NULL")
def abstract_extract(spark, sf_dir):
    return _tex(spark, sf_dir).select("doc_id", fn.abstract(F.col("tex")).alias("abstract"))


@query(f"""WITH t AS ({fx.TEX}) SELECT doc_id, md5(replace(replace(tex, concat({B}, 'usepackage[utf8]{{inputenc}}', chr(10)), ''), concat({B}, 'documentclass{{article}}', chr(10)),
  concat({B}, 'documentclass{{article}}', chr(10), chr(10), '% CJK support', chr(10), {B}, 'usepackage{{xeCJK}}', chr(10), {B}, 'setCJKmainfont{{Noto Serif CJK SC}}', chr(10), {B}, 'setCJKsansfont{{Noto Sans CJK SC}}', chr(10), {B}, 'setCJKmonofont{{Noto Sans Mono CJK SC}}', chr(10)))) AS digest FROM t""")
def cjk_support(spark, sf_dir):
    return _tex(spark, sf_dir).select("doc_id", F.md5(fn.inject_cjk(F.col("tex"))).alias("digest"))


#: A sign that has no backslash before it gets one; twice, since a match takes the sign before it along.
_ESCAPED = lambda x: f"regexp_replace({x}, '(^|[^' || {B} || {B} || '])([%&#])', {B} || '1' || {B} || {B} || {B} || '2', 'g')"


@query(f"SELECT doc_id, md5({_ESCAPED(_ESCAPED('text'))}) AS digest FROM documents WHERE text IS NOT NULL")
def escape_specials(spark, sf_dir):
    return _table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.md5(fn.escape_specials(F.col("text"))).alias("digest"))


@query(f"WITH t AS ({fx.TEX}) SELECT doc_id, md5(replace(replace(tex, chr(10) || chr(10), '[[PL]]'), chr(10), '[[SL]]')) AS encoded, true AS returns FROM t")
def line_end_codec(spark, sf_dir):
    coded = fn.encode_line_ends(F.col("tex"))
    return _tex(spark, sf_dir).select("doc_id", F.md5(coded).alias("encoded"), (fn.decode_line_ends(coded) == F.col("tex")).alias("returns"))


@query(f"WITH t AS ({fx.TEX}), c AS (SELECT doc_id, length(tex) - length(replace(tex, chr(10), '')) AS n, (length(tex) - length(replace(tex, chr(10) || chr(10), ''))) // 2 AS p FROM t) SELECT doc_id, CAST(n - 2 * p AS BIGINT) AS soft, CAST(p AS BIGINT) AS paragraph FROM c")
def line_break_counts(spark, sf_dir):
    return _tex(spark, sf_dir).select("doc_id", fn.line_break_counts(F.col("tex")).alias("c")).select("doc_id", "c.*")


@query(f"WITH u AS (SELECT chunk_id, CASE WHEN chunk_id % 3 = 0 THEN concat(' [[MATH_', CAST(chunk_id AS STRING), ']] ') ELSE source END AS s FROM ({fx.UNITS}) x) SELECT chunk_id FROM u WHERE chunk_id % 3 = 0")
def placeholder_only(spark, sf_dir):
    units = fx.made(spark, sf_dir, fx.UNITS)
    text = F.when(F.col("chunk_id") % 3 == 0, F.concat(F.lit(" [[MATH_"), F.col("chunk_id").cast("string"), F.lit("]] "))).otherwise(F.col("source"))
    return units.where(fn.only_placeholder(text)).select("chunk_id")


@query("SELECT doc_id, CAST(floor(length(text) / 2.5) AS BIGINT) AS openai, CAST(floor(length(text) / 3.5) AS BIGINT) AS anthropic FROM documents WHERE text IS NOT NULL")
def token_estimate(spark, sf_dir):
    return _table(spark, sf_dir, "documents").where("text is not null").select("doc_id", fn.token_estimate(F.col("text")).alias("openai"), fn.token_estimate(F.col("text"), "anthropic").alias("anthropic"))


@query(f"""WITH t AS ({fx.TEX}), l AS (SELECT doc_id, unnest(string_split(tex, chr(10))) AS x FROM t)
  SELECT doc_id, count(*) FILTER (WHERE regexp_matches(trim(x, {BLANKS}), '^(' || repeat({B}, 2) || '(begin' || {B} || '{{|end' || {B} || '{{|section|title|label)|%|&|' || {B} || '[([^' || {B} || '[]|$)|' || {B} || '](([^' || {B} || ']])|$))')) AS structural FROM l GROUP BY doc_id""")
def structural_lines(spark, sf_dir):
    lines = _tex(spark, sf_dir).select("doc_id", F.explode(F.split("tex", "\n", -1)).alias("x"))
    return lines.groupBy("doc_id").agg(F.count_if(fn.structural_line(F.col("x"))).alias("structural"))


@query(f"""WITH t AS (SELECT doc_id, left(tex, CAST(instr(tex, 'See ') - 1 AS INTEGER)) AS b FROM ({fx.TEX}) x)
  SELECT doc_id, CAST(len(string_split(b, chr(10))) AS BIGINT) AS line, CAST(length(list_last(string_split(b, chr(10)))) + 1 AS BIGINT) AS col FROM t""")
def line_and_column(spark, sf_dir):
    """Place of the first 'See ' of every document."""
    place = fn.line_and_column(F.col("tex"), (F.instr("tex", "See ") - 1).cast("int"))
    return _tex(spark, sf_dir).select("doc_id", place.alias("p")).select("doc_id", "p.*")


# Brackets


@query(f"""WITH t AS ({fx.TEX}), s AS (SELECT doc_id, regexp_replace(regexp_replace(tex, {B} || {B} || '[{{}}' || {B} || {B} || ']', '__', 'g'), {B} || {B} || '[a-zA-Z]*', '', 'g') AS x FROM t)
  SELECT doc_id, CAST(length(x) - length(replace(x, '{{', '')) AS BIGINT) AS opens, CAST(length(x) - length(replace(x, '}}', '')) AS BIGINT) AS closes FROM s""")
def brace_counts(spark, sf_dir):
    """Openers and closers that count, on every document."""
    found = brackets.brackets(_tex(spark, sf_dir), column="tex")
    return found.groupBy("doc_id").agg(F.count_if(F.col("bracket") == "{").alias("opens"), F.count_if(F.col("bracket") == "}").alias("closes"))


_BRACKETS = f"""x AS (SELECT doc_id, regexp_extract_all(tex, {B} || {B} || '[{{}}' || {B} || {B} || ']|' || {B} || {B} || {B} || 'p{{L}}*|[{{}}' || {B} || '[' || {B} || ']]|[^' || {B} || {B} || '{{}}' || {B} || '[' || {B} || ']]+') AS l FROM ({fx.TEX}) t),
  y AS (SELECT doc_id, unnest(l) AS c, generate_subscripts(l, 1) AS i FROM x), z AS (SELECT doc_id, c, CAST(sum(length(c)) OVER (PARTITION BY doc_id ORDER BY i) - length(c) AS BIGINT) AS pos FROM y),
  b AS (SELECT doc_id, c, pos, c IN ('{{', '[') AS opens FROM z WHERE c IN ('{{', '}}', '[', ']')),
  d AS (SELECT *, sum(CASE WHEN opens THEN 1 ELSE -1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS s FROM b),
  m AS (SELECT *, least(0, min(s) OVER (PARTITION BY doc_id ORDER BY pos)) AS low FROM d),
  w AS (SELECT *, NOT opens AND low < coalesce(lag(low) OVER (PARTITION BY doc_id ORDER BY pos), 0) AS stray FROM m),
  k AS (SELECT *, CASE WHEN stray THEN -1 WHEN opens THEN s - low ELSE s - low + 1 END AS level FROM w),
  p AS (SELECT *, CASE WHEN opens THEN lead(pos) OVER (PARTITION BY doc_id, level ORDER BY pos) END AS close FROM k)"""


@query(f"""WITH {_BRACKETS}
  SELECT doc_id, pos, c AS bracket, 'unmatched closer' AS problem FROM p WHERE stray UNION ALL SELECT doc_id, pos, c, 'unmatched opener' FROM p WHERE opens AND close IS NULL
  UNION ALL SELECT q.doc_id, q.pos, q.c, 'mismatched' FROM p JOIN p q ON q.doc_id = p.doc_id AND q.pos = p.close WHERE concat(p.c, q.c) NOT IN ('{{}}', '[]')""")
def brace_balance(spark, sf_dir):
    """Brackets in error of every document."""
    return brackets.unbalanced(_tex(spark, sf_dir), column="tex")


@query(f"""WITH t AS ({fx.TEX}) SELECT doc_id, 'abstract' AS env, CAST(instr(tex, concat({B}, 'begin{{abstract}}')) - 1 AS BIGINT) AS first, CAST(instr(tex, concat({B}, 'end{{abstract}}')) + 13 AS BIGINT) AS stop FROM t""")
def environment_spans(spark, sf_dir):
    return brackets.environments(_tex(spark, sf_dir), ["abstract", "align*", "verbatim"], column="tex")


_TOKENS = lambda c: f"regexp_extract_all({c}, '(?s)(?:[^{{}}' || {B} || {B} || ']+|' || {B} || {B} || '(?:.|$))+|[{{}}]')"


@query(f"""WITH t AS ({fx.PAIRS}), l AS (SELECT doc_id, length(original) AS n, {_TOKENS('original')} AS l FROM t), r AS (SELECT doc_id, length(translated) AS n, {_TOKENS('translated')} AS l FROM t),
  a AS (SELECT doc_id, n, i, CASE WHEN c IN ('{{', '}}') THEN c ELSE 'T' END AS kind, sum(length(c)) OVER (PARTITION BY doc_id ORDER BY i) - length(c) AS off FROM (SELECT doc_id, n, unnest(l) AS c, generate_subscripts(l, 1) AS i FROM l) x),
  b AS (SELECT doc_id, n, i, CASE WHEN c IN ('{{', '}}') THEN c ELSE 'T' END AS kind, sum(length(c)) OVER (PARTITION BY doc_id ORDER BY i) - length(c) AS off FROM (SELECT doc_id, n, unnest(l) AS c, generate_subscripts(l, 1) AS i FROM r) x),
  j AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.i, b.i) AS i, coalesce(a.kind, '<EOF>') AS expected, coalesce(b.kind, '<EOF>') AS got, a.off AS ao, b.off AS bo FROM a FULL JOIN b ON a.doc_id = b.doc_id AND a.i = b.i),
  f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r FROM j WHERE expected <> got)
  SELECT f.doc_id, CAST(f.i - 1 AS BIGINT) AS index, expected, got, CAST(coalesce(ao, l.n) AS BIGINT) AS source_off, CAST(coalesce(bo, r.n) AS BIGINT) AS translated_off FROM f JOIN l ON l.doc_id = f.doc_id JOIN r ON r.doc_id = f.doc_id WHERE f.r = 1""")
def brace_structure_mismatch(spark, sf_dir):
    """The first difference in brace structure of every pair of texts."""
    pairs = fx.made(spark, sf_dir, fx.PAIRS)
    return pairs.select("doc_id", validate.first_brace_mismatch(F.col("original"), F.col("translated")).alias("m")).where("m is not null").select("doc_id", "m.*")


@query(f"WITH {_BRACKETS} SELECT doc_id, pos, close FROM p WHERE close IS NOT NULL")
def brace_match_pairs(spark, sf_dir):
    """Openers with their closers of every document."""
    found = brackets.matched(brackets.brackets(_tex(spark, sf_dir), column="tex"), F.col("bracket").isin("{", "["), ["doc_id"])
    return found.where("close is not null").select("doc_id", "pos", F.col("close").cast("long").alias("close"))


# Chunks, routing and batches


@query("SELECT conv_id, CAST(turn AS BIGINT) AS turn, CASE WHEN length(text) < 300 THEN 'short' ELSE 'long' END AS way FROM conversations WHERE text IS NOT NULL")
def short_long_split(spark, sf_dir):
    return _table(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "turn", batching.route(F.col("text")).alias("way"))


@query("SELECT way, count(*) AS chunks, count(DISTINCT conv_id) AS docs FROM (SELECT conv_id, CASE WHEN turn % 5 = 4 THEN 'placeholder' WHEN length(text) < 300 THEN 'short' ELSE 'long' END AS way FROM conversations WHERE text IS NOT NULL) GROUP BY way")
def chunk_route_counts(spark, sf_dir):
    turns = _table(spark, sf_dir, "conversations").where("text is not null")
    content = F.when(F.col("turn") % 5 == 4, F.concat(F.lit("[[ENV_"), F.col("turn").cast("string"), F.lit("]]"))).otherwise(F.col("text"))
    return turns.groupBy(batching.route(content).alias("way")).agg(F.count("*").alias("chunks"), F.count_distinct("conv_id").alias("docs"))


_BATCHES = """WITH RECURSIVE o AS (SELECT conv_id, turn, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations WHERE text IS NOT NULL),
  b(conv_id, turn, i, batch, used) AS (SELECT conv_id, turn, i, 0, n FROM o WHERE i = 1
    UNION ALL SELECT o.conv_id, o.turn, o.i, CASE WHEN b.used + o.n > 2000 THEN b.batch + 1 ELSE b.batch END, CASE WHEN b.used + o.n > 2000 THEN o.n ELSE b.used + o.n END FROM b JOIN o ON o.conv_id = b.conv_id AND o.i = b.i + 1)"""


@query(f"{_BATCHES} SELECT conv_id, turn, CAST(batch AS BIGINT) AS batch FROM b")
def greedy_batches(spark, sf_dir):
    return batching.greedy_batches(_table(spark, sf_dir, "conversations").where("text is not null"), "conv_id", "turn")


@query(f"{_BATCHES} SELECT count(DISTINCT (conv_id, batch)) AS batches, count(*) AS units, max(n) AS largest FROM (SELECT conv_id, batch, count(*) OVER (PARTITION BY conv_id, batch) AS n FROM b) x")
def batch_stats(spark, sf_dir):
    per = greedy_batches(spark, sf_dir).groupBy("conv_id", "batch").agg(F.count("*").alias("n"))
    return per.agg(F.count("*").alias("batches"), F.sum("n").alias("units"), F.max("n").alias("largest"))


@query("SELECT conv_id, md5(string_agg(concat('[', CAST(i AS STRING), '] ', text), chr(10) ORDER BY i)) AS digest FROM (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations WHERE text IS NOT NULL) x GROUP BY conv_id")
def batch_numbered_text(spark, sf_dir):
    per = _table(spark, sf_dir, "conversations").where("text is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("x"))
    return per.select("conv_id", F.md5(batching.numbered(F.col("x.text"))).alias("digest"))


@query(f"""WITH c AS (SELECT conv_id, conv_id % 4 = 3 OR bool_or(regexp_matches(text, {B} || '[[0-9]+' || {B} || ']')) AS bad FROM conversations WHERE text IS NOT NULL GROUP BY conv_id)
  SELECT t.conv_id, CAST(turn AS BIGINT) AS turn, md5(trim(trim(text, {BLANKS}))) AS digest FROM conversations t JOIN c ON c.conv_id = t.conv_id WHERE text IS NOT NULL AND NOT bad""")
def batch_reply_parse(spark, sf_dir):
    """Numbered replies made of every turn; a turn that holds a number in brackets makes its reply a bad one."""
    per = _table(spark, sf_dir, "conversations").where("text is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("x"))
    reply = F.concat(batching.numbered(F.col("x.text")), F.when(F.col("conv_id") % 4 == 3, "\n[99] more").otherwise(""))
    parsed = per.select("conv_id", "x", batching.parse_reply(reply, F.size("x")).alias("said")).where("size(said) > 0")
    return parsed.select("conv_id", F.explode(F.arrays_zip(F.col("x.turn").alias("turn"), "said")).alias("z")).select("conv_id", "z.turn", F.md5(F.trim("z.said")).alias("digest"))


@query("SELECT d.doc_id FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE l.doc_id IS NULL")
def resume_anti_join(spark, sf_dir):
    return batching.pending(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), "doc_id").select("doc_id")


@query("SELECT k AS kind, CAST(a AS INTEGER) AS attempt, CAST(CASE k WHEN 'timeout' THEN greatest(10, 2 ** (a + 1)) WHEN 'rate_limit' THEN greatest(5, 3 ** a) ELSE 2 ** a END AS DOUBLE) AS seconds FROM (SELECT unnest(['timeout', 'rate_limit', 'generic']) AS k) x, (SELECT unnest([0, 1, 2, 3]) AS a) y")
def backoff_schedule(spark, sf_dir):
    kinds = spark.range(1).select(F.explode(F.array(*map(F.lit, ("timeout", "rate_limit", "generic")))).alias("kind"))
    tries = kinds.select("kind", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("attempt"))
    return tries.withColumn("seconds", batching.backoff(F.col("kind"), F.col("attempt")))


@query(f"""WITH t AS ({fx.TEX}), l AS (SELECT doc_id, unnest(string_split(tex, chr(10))) AS x, generate_subscripts(string_split(tex, chr(10)), 1) AS i FROM t),
  k AS (SELECT doc_id, i, x, trim(x, {BLANKS}) = '' OR regexp_matches(trim(x, {BLANKS}), '^(' || repeat({B}, 2) || '(begin' || {B} || '{{|end' || {B} || '{{|documentclass|section|title|label)|%|&|' || {B} || '[([^' || {B} || '[]|$)|' || {B} || '](([^' || {B} || ']])|$))') AND NOT regexp_matches(x, '^' || repeat({B}, 2) || 'documentclass') AS stop FROM l),
  g AS (SELECT doc_id, i, x, stop, sum(CASE WHEN stop THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM k)
  SELECT doc_id, count(DISTINCT island) AS islands, count(*) AS lines FROM g WHERE NOT stop GROUP BY doc_id""")
def paragraph_islands(spark, sf_dir):
    """Runs of lines that are neither blank nor structural, as gaps and islands."""
    from pyspark.sql import Window

    lines = _tex(spark, sf_dir).select("doc_id", F.posexplode(F.split("tex", "\n", -1)).alias("i", "x"))
    stop = (fn.strip(F.col("x")) == "") | fn.structural_line(F.col("x"))
    island = F.sum(stop.cast("int")).over(Window.partitionBy("doc_id").orderBy("i"))
    return lines.select("doc_id", stop.alias("stop"), island.alias("island")).where("not stop").groupBy("doc_id").agg(F.count_distinct("island").alias("islands"), F.count("*").alias("lines"))


@query(f"WITH u AS ({fx.UNITS}) SELECT chunk_id, CAST(length(trim(regexp_replace(source, {B} || '[' || {B} || '[[A-Z_]+_[0-9]+' || {B} || ']' || {B} || ']', '', 'g'))) AS BIGINT) AS clean FROM u")
def clean_lengths(spark, sf_dir):
    return fx.made(spark, sf_dir, fx.UNITS).select("chunk_id", fn.clean_length(F.col("source")).alias("clean"))


@query()
def inline_math_spans(spark, sf_dir):
    """Dollar math that the parser takes out of every document."""
    rows = parse.parse(_tex(spark, sf_dir)).where("kind = 'placeholder' and context = 'MATH'")
    return rows.where(F.startswith("content", F.lit("$"))).groupBy("doc_id").agg(F.count("*").alias("n"))


@query(fx.CONSTRUCTS_SQL)
def parsed_constructs(spark, sf_dir):
    """What the parser makes of titles, authors, captions, graphics, environments, math, sections, lists, footnotes and paragraphs."""
    rows = parse.parse(fx.made(spark, sf_dir, fx.CONSTRUCTS)).where("kind <> 'template'")
    said = F.regexp_replace("content", fn.CHUNK_TOKEN, "{{CHUNK}}")
    return rows.select("doc_id", "kind", "context", F.md5(said).alias("digest"))


# Glossary


def _glossary(spark):
    return spark.createDataFrame([(k, t, x, None, None, 0, None) for k, (t, x) in enumerate(fx.GLOSSARY)], glossary.COLUMNS)


_HITS = f"SELECT d.doc_id, g.term, g.target FROM documents d JOIN ({fx.GLOSSARY_SQL}) g ON regexp_matches(d.text, concat('(?i)(^|[^0-9A-Za-z_])', replace(g.term, '+', '[+]'), '($|[^0-9A-Za-z_])'))"


@query(_HITS)
def glossary_hits(spark, sf_dir):
    return glossary.hits(_table(spark, sf_dir, "documents"), _glossary(spark)).select("doc_id", "term", "target")


@query(f"WITH h AS ({_HITS}) SELECT d.doc_id, count(h.term) AS n_terms, count(h.term) > 0 AS had_terms, coalesce(string_agg(h.term, ',' ORDER BY h.term), '') AS terms FROM documents d LEFT JOIN h ON h.doc_id = d.doc_id GROUP BY d.doc_id")
def glossary_coverage(spark, sf_dir):
    found = glossary.hints(_table(spark, sf_dir, "documents"), _glossary(spark))
    return found.select("doc_id", "n_terms", "had_terms", F.array_join(F.array_sort(F.map_keys("hints")), ",").alias("terms"))


@query(f"SELECT conv_id, string_agg(term, ',' ORDER BY term) AS terms FROM (SELECT c.conv_id, g.term FROM (SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS t FROM conversations GROUP BY conv_id) c JOIN ({fx.GLOSSARY_SQL}) g ON regexp_matches(c.t, concat('(?i)(^|[^0-9A-Za-z_])', replace(g.term, '+', '[+]'), '($|[^0-9A-Za-z_])'))) x GROUP BY conv_id")
def glossary_doc_union(spark, sf_dir):
    turns = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), " ").alias("t"))
    found = glossary.hits(turns, _glossary(spark), "t")
    return found.groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_list("term")), ",").alias("terms"))


@query(f"WITH g AS ({fx.GLOSSARY_SQL}) SELECT term, CASE WHEN term IN ('the', 'is') THEN upper(term) ELSE target END AS target FROM g UNION ALL SELECT 'new', 'NEW'")
def glossary_merge(spark, sf_dir):
    over = spark.createDataFrame(glossary.rows_of({"is": "IS", "the": {"target": "THE"}, "new": "NEW", "bad": 3}), glossary.COLUMNS)
    return glossary.merged(_glossary(spark), over).select("term", "target")


@query(f"SELECT d.doc_id, g.term FROM documents d JOIN ({fx.GLOSSARY_SQL}) g ON contains(lower(d.text), lower(g.term))")
def glossary_contained(spark, sf_dir):
    return glossary.contained(_table(spark, sf_dir, "documents"), _glossary(spark)).select("doc_id", "term")


# Placeholders


_PH = f"{B} || '[' || {B} || '[[A-Z_]+_[0-9]+' || {B} || ']' || {B} || ']'"
_BAD = f"u AS ({fx.UNITS}), bad AS (SELECT DISTINCT chunk_id, source, unnest(regexp_extract_all(translation, {_PH})) AS bad FROM u), sp AS (SELECT * FROM bad WHERE NOT contains(source, bad))"


@query(f"WITH {_BAD} SELECT chunk_id, bad FROM sp")
def placeholder_spurious(spark, sf_dir):
    return integrity.spurious(fx.made(spark, sf_dir, fx.UNITS))


@query(f"""WITH {_BAD}, v AS ({fx.VALID}), own AS (SELECT DISTINCT chunk_id, unnest(regexp_extract_all(source, {_PH})) AS own FROM u),
  d AS (SELECT sp.chunk_id, sp.bad, own.own, levenshtein(sp.bad, own.own) AS d, row_number() OVER (PARTITION BY sp.chunk_id, sp.bad ORDER BY levenshtein(sp.bad, own.own), own.own) AS r FROM sp JOIN own ON own.chunk_id = sp.chunk_id)
  SELECT chunk_id, bad, CASE WHEN bad NOT IN (SELECT placeholder FROM v) AND d <= 2 THEN 'typo_fixed' ELSE 'hallucination' END AS type, CASE WHEN bad NOT IN (SELECT placeholder FROM v) AND d <= 2 THEN own END AS fixed_to FROM d WHERE r = 1""")
def placeholder_typo_repair(spark, sf_dir):
    return integrity.verdicts(fx.made(spark, sf_dir, fx.UNITS), fx.made(spark, sf_dir, fx.VALID))


@query(f"WITH u AS ({fx.UNITS}), s AS (SELECT DISTINCT chunk_id, translation, unnest(regexp_extract_all(source, {_PH})) AS missing FROM u) SELECT chunk_id, missing FROM s WHERE NOT contains(translation, missing)")
def placeholder_missing(spark, sf_dir):
    return integrity.missing(fx.made(spark, sf_dir, fx.UNITS))


@query(f"""SELECT chunk_id, CASE WHEN chunk_id % 5 = 0 THEN concat('T: [[MATH_', CAST(chunk_id AS STRING), ']] [[CITE_', CAST(chunk_id + 1 AS STRING), ']]') WHEN chunk_id % 5 = 1 THEN concat('T: [[MATH_', CAST(chunk_id AS STRING), ']] [[CITE_', CAST(chunk_id + 1 AS STRING), ']] ')
  WHEN chunk_id % 5 = 3 THEN source ELSE translation END AS translation FROM ({fx.UNITS}) u""")
def placeholder_repaired_text(spark, sf_dir):
    return integrity.repaired(fx.made(spark, sf_dir, fx.UNITS), fx.made(spark, sf_dir, fx.VALID)).select("chunk_id", "translation")


@query("SELECT doc_id, CAST(doc_id AS STRING) AS chunk_id, 'paragraph' AS context FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def orphan_chunks(spark, sf_dir):
    chunks = _table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("chunk_id"), F.lit("paragraph").alias("context"))
    refs = _table(spark, sf_dir, "labels").select("doc_id", F.col("doc_id").cast("string").alias("chunk_id"))
    return integrity.orphans(chunks, refs)


@query("SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY role, turn) AS n FROM conversations")
def placeholder_numbering(spark, sf_dir):
    spans = _table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("pos"), F.col("role").alias("pass"))
    return integrity.numbered_tokens(spans, "conv_id").select("conv_id", F.col("pos").alias("turn"), F.col("pass").alias("role"), "n")


# Checks


_CMD = lambda c, x: f"list_distinct(regexp_extract_all({x}, {B} || {B} || '{c}' || {B} || '{{([^}}]+)' || {B} || '}}', 1))"


@query(f"""WITH p AS ({fx.PAIRS}), c AS (SELECT doc_id, {_CMD('cite', 'original')} AS co, {_CMD('cite', 'translated')} AS ct, {_CMD('ref', 'original')} AS ro, {_CMD('ref', 'translated')} AS rt FROM p)
  SELECT doc_id, len(list_filter(co, lambda x: NOT list_contains(ct, x))) AS missing_cites, len(list_filter(ct, lambda x: NOT list_contains(co, x))) AS extra_cites, len(list_filter(ro, lambda x: NOT list_contains(rt, x))) AS missing_refs FROM c""")
def cite_ref_check(spark, sf_dir):
    a = validate.arguments
    o, t = F.col("original"), F.col("translated")
    n = lambda x, y, c: F.size(F.array_except(a(x, c), a(y, c))).cast("long")
    return _pairs(spark, sf_dir).select("doc_id", n(o, t, "cite").alias("missing_cites"), n(t, o, "cite").alias("extra_cites"), n(o, t, "ref").alias("missing_refs"))


@query(f"""WITH p AS ({fx.PAIRS}), c AS (SELECT doc_id, length(replace(original, concat({B}, '$'), '')) - length(replace(replace(original, concat({B}, '$'), ''), '$', '')) AS o, length(replace(translated, concat({B}, '$'), '')) - length(replace(replace(translated, concat({B}, '$'), ''), '$', '')) AS t FROM p)
  SELECT doc_id, CAST(o AS BIGINT) AS original, CAST(t AS BIGINT) AS translated, t % 2 = 1 AS odd, o <> t AS differ FROM c""")
def math_delim_check(spark, sf_dir):
    o, t = validate.dollar_count(F.col("original")), validate.dollar_count(F.col("translated"))
    return _pairs(spark, sf_dir).select("doc_id", o.alias("original"), t.alias("translated"), (t % 2 == 1).alias("odd"), (o != t).alias("differ"))


@query(f"WITH p AS ({fx.PAIRS}) SELECT doc_id, CASE WHEN length(translated) / length(original) < 0.2 THEN 'short' WHEN length(translated) / length(original) > 1.5 THEN 'long' ELSE 'fine' END AS ratio FROM p")
def length_ratio_check(spark, sf_dir):
    ratio = F.length("translated") / F.length("original")
    return _pairs(spark, sf_dir).select("doc_id", F.when(ratio < validate.LEAST_RATIO, "short").when(ratio > validate.MOST_RATIO, "long").otherwise("fine").alias("ratio"))


_PAIR_LISTS = ", ".join(f"list_sort({_CMD(c, x)}) AS {n}" for c, x, n in (("cite", "original", "co"), ("cite", "translated", "ct"), ("ref", "original", "ro"), ("ref", "translated", "rt")))
_DOLLARS = lambda x: f"length(replace({x}, concat({B}, '$'), '')) - length(replace(replace({x}, concat({B}, '$'), ''), '$', ''))"


@query(f"""WITH p AS ({fx.PAIRS}), c AS (SELECT *, {_PAIR_LISTS}, {_DOLLARS('original')} AS o, {_DOLLARS('translated')} AS t, length(translated) / length(original) AS r FROM p),
  f AS (SELECT *, list_filter(co, lambda x: NOT list_contains(ct, x)) AS lost, list_filter(ct, lambda x: NOT list_contains(co, x)) AS more, list_filter(ro, lambda x: NOT list_contains(rt, x)) AS refs FROM c)
  SELECT doc_id, 'citations' AS "check", 'error' AS severity, concat('Missing citations: ', array_to_string(lost, ', ')) AS message FROM f WHERE len(lost) > 0
  UNION ALL SELECT doc_id, 'citations', 'error', concat('Unexpected citations: ', array_to_string(more, ', ')) FROM f WHERE len(more) > 0
  UNION ALL SELECT doc_id, 'references', 'error', concat('Missing references: ', array_to_string(refs, ', ')) FROM f WHERE len(refs) > 0
  UNION ALL SELECT doc_id, 'math', 'error', 'Odd number of math delimiters' FROM f WHERE t % 2 = 1
  UNION ALL SELECT doc_id, 'math', 'error', concat('Math delimiters differ: ', CAST(o AS STRING), ' and ', CAST(t AS STRING)) FROM f WHERE o <> t
  UNION ALL SELECT doc_id, 'length', 'warning', 'Translation is very short' FROM f WHERE r < 0.2
  UNION ALL SELECT doc_id, 'length', 'warning', 'Translation is very long' FROM f WHERE r > 1.5""")
def pair_findings(spark, sf_dir):
    return validate.pair_findings(_pairs(spark, sf_dir))


def _rules(spark):
    rows = [(k, i, i, s, p, r, None) for k, (i, s, p, r) in enumerate(fx.RULES)]
    return spark.createDataFrame(rows, "ord int, id string, description string, severity string, pattern string, replacement string, trigger string")


_FOUND = f"SELECT doc_id, id, severity, unnest(regexp_extract_all(text, pattern)) AS m FROM documents, ({fx.RULES_SQL}) r WHERE regexp_matches(text, pattern)"


@query(f"SELECT doc_id, id, severity, count(*) AS n FROM ({_FOUND}) f GROUP BY doc_id, id, severity")
def rule_findings(spark, sf_dir):
    found = validate.rule_findings(_table(spark, sf_dir, "documents"), _rules(spark))
    return found.groupBy("doc_id", "id", "severity").agg(F.count("*").alias("n"))


@query(f"""WITH r AS ({fx.RULES_SQL}), x AS (SELECT doc_id, id, regexp_extract_all(text, pattern) AS m, list_transform(string_split_regex(text, pattern), lambda g: length(g)) AS g FROM documents, r WHERE regexp_matches(text, pattern))
  SELECT doc_id, id, unnest(list_transform(range(1, len(m) + 1), lambda i: CAST(list_sum(g[1:i]) + coalesce(list_sum(list_transform(m[1:i - 1], lambda y: length(y))), 0) AS INTEGER))) AS location FROM x""")
def rule_places(spark, sf_dir):
    return validate.rule_findings(_table(spark, sf_dir, "documents"), _rules(spark)).select("doc_id", "id", "location")


@query(f"""WITH d AS (SELECT doc_id, concat('{{', lang, ' ', text) AS t FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL AND doc_id % 2 = 1)
  SELECT doc_id, CAST(2 AS BIGINT) AS index, '}}' AS expected, '<EOF>' AS got, CAST(len(string_split(t, chr(10))) + doc_id % 50 AS BIGINT) AS line, CAST(length(list_last(string_split(t, chr(10)))) + 1 AS BIGINT) AS col FROM d""")
def chunk_brace_places(spark, sf_dir):
    """Chunks of every text in which the translation of odd documents has lost a brace."""
    source = F.concat(F.lit("{"), "lang", F.lit("} "), "text")
    lost = F.concat(F.lit("{"), "lang", F.lit(" "), "text")
    chunks = _table(spark, sf_dir, "documents").select("doc_id", source.alias("source"), F.when(F.col("doc_id") % 2 == 1, lost).otherwise(source).alias("translation"), (F.col("doc_id") % 50 + 1).alias("start_line"))
    return validate.chunk_brace_findings(chunks, "doc_id").drop("snippet")


@query(f"WITH f AS ({_FOUND}) SELECT d.doc_id, count(f.m) FILTER (WHERE severity = 'error') = 0 AS valid, count(f.m) FILTER (WHERE severity = 'error') AS n_errors, count(f.m) FILTER (WHERE severity = 'warning') AS n_warnings FROM documents d LEFT JOIN f ON f.doc_id = d.doc_id GROUP BY d.doc_id")
def rule_verdict(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return validate.verdict(docs, validate.rule_findings(docs, _rules(spark)))


@query("SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '  +', ' ', 'g'), '[0-9]{5,}', 'N', 'g'), '[|]', '/', 'g')) AS digest FROM documents WHERE text IS NOT NULL")
def auto_fix(spark, sf_dir):
    rules = [{"pattern": p, "replacement": r} for _, _, p, r in fx.RULES]
    return _table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.md5(validate.auto_fix(F.col("text"), rules)).alias("digest"))


@query("SELECT doc_id, concat('{A}}B}', CASE WHEN doc_id % 2 = 0 THEN 'x' ELSE '' END) AS fixed FROM documents")
def brace_alignment(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    t = F.concat(F.lit("{A}B}"), F.when(F.col("doc_id") % 2 == 0, "x").otherwise(""))
    return docs.select("doc_id", validate.aligned_braces(F.lit("{A}}B}"), t).alias("fixed"))


# Analytics


@query(f"""WITH c AS ({fx.CALLS}), s AS (SELECT list_sort(list(latency_ms)) AS l FROM c WHERE ok)
  SELECT count(*) AS total, count(*) FILTER (WHERE ok) AS success, count(*) FILTER (WHERE NOT ok) AS failed, round(count(*) FILTER (WHERE ok) / count(*), 4) AS success_rate, round(avg(latency_ms) FILTER (WHERE ok), 2) AS latency_avg, (SELECT round(l[CAST(floor(0.95 * (len(l) - 1)) AS BIGINT) + 1], 2) FROM s) AS latency_p95 FROM c""")
def probe_summary(spark, sf_dir):
    return analytics.probe_summary(fx.made(spark, sf_dir, fx.CALLS))


@query(f"WITH c AS ({fx.CALLS}) SELECT error, count(*) AS n FROM c WHERE error IS NOT NULL GROUP BY error ORDER BY n DESC, error LIMIT 8")
def error_top8(spark, sf_dir):
    return analytics.histogram(fx.made(spark, sf_dir, fx.CALLS).where("error is not null"), "error", top=8)


@query(f"WITH c AS ({fx.CALLS}), m AS (SELECT model, round(avg(latency_ms), 4) AS latency, count(*) AS calls FROM c WHERE ok GROUP BY model) SELECT model, latency, calls, row_number() OVER (ORDER BY latency, model) AS rank FROM m")
def latency_leaderboard(spark, sf_dir):
    return analytics.leaderboard(fx.made(spark, sf_dir, fx.CALLS), "model")


@query("""WITH t AS (SELECT role, text FROM conversations WHERE length(text) > 0), m AS (SELECT role, max(c) AS most_common FROM (SELECT role, text, count(*) AS c FROM t GROUP BY role, text) x GROUP BY role),
  k AS (SELECT role, sum(length(s)) AS tokens FROM (SELECT role, replace(replace(replace(text, ' ', ''), '，', ''), '。', '') AS s FROM t) y GROUP BY role), d AS (SELECT role, count(DISTINCT ch) AS types FROM (SELECT role, unnest(string_split(replace(replace(replace(text, ' ', ''), '，', ''), '。', ''), '')) AS ch FROM t) z WHERE ch <> '' GROUP BY role),
  b AS (SELECT role, count(*) AS n, count(DISTINCT text) AS unique_texts, min(length(text)) AS min_length, max(length(text)) AS max_length, round(avg(length(text)), 2) AS avg_length, round(stddev_pop(length(text)), 2) AS std_length FROM t GROUP BY role)
  SELECT b.*, most_common, round(most_common / n, 4) AS exact_match_ratio, round(types / tokens, 4) AS type_token_ratio FROM b JOIN m USING (role) JOIN k USING (role) JOIN d USING (role)""")
def diversity_metrics(spark, sf_dir):
    return analytics.diversity(_table(spark, sf_dir, "conversations"), "role")


@query("""WITH s AS (SELECT conv_id, turn, list_distinct(list_filter(string_split(regexp_replace(text, '[ ，。' || chr(10) || ']', '', 'g'), ''), lambda c: c <> '')) AS s FROM conversations WHERE length(text) > 0),
  p AS (SELECT a.conv_id, avg(len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s)))) AS o FROM s a JOIN s b ON a.conv_id = b.conv_id AND a.turn < b.turn GROUP BY a.conv_id), n AS (SELECT conv_id, count(*) AS n FROM s GROUP BY conv_id)
  SELECT n.conv_id, round(CASE WHEN n < 2 THEN 1.0 ELSE coalesce(o, 0.0) END, 4) AS avg_char_overlap FROM n LEFT JOIN p ON p.conv_id = n.conv_id""")
def pairwise_jaccard(spark, sf_dir):
    return analytics.mean_overlap(_table(spark, sf_dir, "conversations"), "conv_id", "turn")


_HEAT = "SELECT CAST(user_id % 4 AS DOUBLE) / 4 AS temperature, CAST(avg(value) AS DOUBLE) AS exact_match_ratio FROM events WHERE value IS NOT NULL GROUP BY user_id % 4"


@query(f"""WITH g AS ({_HEAT}), c AS (SELECT count(*) AS n, CASE WHEN count(*) > 2 THEN coalesce(corr(temperature, 1 - exact_match_ratio), 0) ELSE 0 END AS r, arg_min(exact_match_ratio, temperature) AS cold, arg_max(exact_match_ratio, temperature) AS hot FROM g)
  SELECT round(r, 6) AS r, CASE WHEN n < 2 THEN 'INSUFFICIENT' WHEN r > 0.5 AND hot < cold THEN 'WORKS' WHEN r < -0.5 THEN 'REVERSED' WHEN abs(r) < 0.3 THEN 'IGNORED' ELSE 'INCONCLUSIVE' END AS verdict FROM c""")
def temperature_effect(spark, sf_dir):
    return analytics.temperature_effect(fx.made(spark, sf_dir, _HEAT))


@query(f"""WITH c AS ({fx.USAGE}), s AS (SELECT count(*) FILTER (WHERE has_usage) AS requests, count(*) FILTER (WHERE has_usage AND cache_hit) AS hits, count(*) FILTER (WHERE has_usage AND NOT cache_hit) AS misses, count(*) FILTER (WHERE NOT has_usage) AS missing_usage,
  CAST(sum(CASE WHEN has_usage THEN coalesce(cached, 0) ELSE 0 END) AS BIGINT) AS cached_total, CAST(sum(CASE WHEN has_usage THEN prompt ELSE 0 END) AS BIGINT) AS prompt_total, CAST(sum(CASE WHEN has_usage THEN completion ELSE 0 END) AS BIGINT) AS completion_total, CAST(sum(CASE WHEN has_usage THEN tokens ELSE 0 END) AS BIGINT) AS tokens_total FROM c)
  SELECT *, round(hits / requests * 100, 1) AS hit_rate FROM s""")
def cache_stats(spark, sf_dir):
    return analytics.cache_stats(fx.made(spark, sf_dir, fx.USAGE))


@query(f"WITH c AS ({fx.USAGE}) SELECT mode, count(*) AS n FROM c WHERE has_usage AND mode <> '' GROUP BY mode")
def cache_mode_histogram(spark, sf_dir):
    return analytics.count_map(fx.made(spark, sf_dir, fx.USAGE), "mode").select(F.explode("counts").alias("mode", "n"))


@query(f"WITH f AS ({fx.FILES}), m AS (SELECT paper_id, bool_or(path IN ('main.tex', 'paper.tex', 'ms.tex')) AS named, bool_or(path = 'refs.bib') AS has_bib FROM f GROUP BY paper_id) SELECT count(*) AS papers, count(*) FILTER (WHERE named) AS named_n, round(count(*) FILTER (WHERE named) / count(*), 4) AS named_rate, count(*) FILTER (WHERE named) >= 8 AS named_pass, count(*) FILTER (WHERE has_bib) AS has_bib_n, round(count(*) FILTER (WHERE has_bib) / count(*), 4) AS has_bib_rate, count(*) FILTER (WHERE has_bib) >= 6 AS has_bib_pass FROM m")
def paper_rollup(spark, sf_dir):
    files = fx.made(spark, sf_dir, fx.FILES).groupBy("paper_id").agg(F.bool_or(F.col("path").isin("main.tex", "paper.tex", "ms.tex")).alias("named"), F.bool_or(F.col("path") == "refs.bib").alias("has_bib"))
    return analytics.paper_rollup(files, {"named": 8, "has_bib": 6})


@query(f"WITH f AS ({fx.FILES}), r AS (SELECT paper_id, CASE WHEN bool_or(path IN ('main.tex', 'paper.tex', 'ms.tex')) THEN 'name' WHEN bool_or(path IN ('zeta.tex', 'alpha.tex')) THEN 'documentclass' ELSE 'largest' END AS method FROM f GROUP BY paper_id) SELECT method, count(*) AS n FROM r GROUP BY method")
def method_histogram(spark, sf_dir):
    return analytics.histogram(papers.main_files(fx.made(spark, sf_dir, fx.FILES)), "method")


@query("SELECT doc_id, t AS term FROM (SELECT doc_id, text, unnest(['the', 'und', 'que']) AS t FROM documents WHERE text IS NOT NULL) x WHERE NOT contains(text, t)")
def expected_terms(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").where("text is not null")
    return analytics.expected_terms(docs.select("doc_id", F.array(*map(F.lit, ("the", "und", "que"))).alias("expected"), F.col("text").alias("translation")), "doc_id")


# Prompts and calls


@query("SELECT conv_id, CAST(turn AS BIGINT) AS turn, CAST(2 * (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) AS BIGINT) AS n_messages FROM conversations")
def history_prefix(spark, sf_dir):
    units = _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("source"), F.lit("ok").alias("translation"))
    return prompts.history(units, "conv_id", "turn").select("conv_id", "turn", F.size("history").cast("long").alias("n_messages"))


@query("SELECT event_id, event_id % 3 = 0 AS cache_hit, CASE WHEN event_id % 3 = 0 THEN event_id % 100 + 1 ELSE 0 END AS cached, event_id % 500 AS prompt FROM events")
def usage_meta(spark, sf_dir):
    events = _table(spark, sf_dir, "events")
    e = F.col("event_id")
    usage = F.to_json(F.struct((e % 500).alias("prompt_tokens"), F.struct(F.when(e % 3 == 0, e % 100 + 1).otherwise(0).alias("cached_tokens")).alias("prompt_tokens_details")))
    m = providers.usage_meta(usage, "any")
    return events.select("event_id", m["cache_hit"].alias("cache_hit"), m["cached_tokens"].alias("cached"), m["prompt_tokens"].alias("prompt"))


@query("SELECT doc_id, concat('Context:', CASE WHEN doc_id % 2 = 0 THEN concat(chr(10), 'Abstract: ', lang) ELSE '' END) AS context FROM documents WHERE lang IS NOT NULL")
def merged_context(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").where("lang is not null")
    return docs.select("doc_id", prompts.merged_context(F.lit("Context:"), F.when(F.col("doc_id") % 2 == 0, F.col("lang"))).alias("context"))


@query(f"SELECT doc_id, concat('{prompts.DEFAULT_STYLE}', chr(10), chr(10), '{prompts.FIXED_RULES}', CASE WHEN doc_id % 2 = 0 THEN concat(chr(10), chr(10), 'Glossary:', chr(10), '- ', lang, ': x') ELSE '' END, chr(10), chr(10), 'Context:', chr(10), lang) AS prompt FROM documents WHERE lang IS NOT NULL")
def system_prompts(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").where("lang is not null")
    hints = F.when(F.col("doc_id") % 2 == 0, F.create_map(F.col("lang"), F.lit("x"))).otherwise(F.expr("cast(map() as map<string,string>)"))
    return docs.select("doc_id", prompts.system_prompt(hints=hints, context=F.col("lang")).alias("prompt"))


@query("SELECT conv_id, CAST(turn AS BIGINT) AS turn, 'system user assistant user' AS roles, md5(text) AS last FROM conversations WHERE text IS NOT NULL")
def message_lists(spark, sf_dir):
    examples = F.array(*(F.struct(F.lit(a).alias("source"), F.lit(b).alias("target")) for a, b in (("a", "b"), (" ", "c"))))
    turns = _table(spark, sf_dir, "conversations").where("text is not null").withColumn("m", prompts.messages(F.lit("s"), examples, F.col("text")))
    return turns.select("conv_id", "turn", F.array_join(F.col("m.role"), " ").alias("roles"), F.md5(F.element_at("m", -1)["content"]).alias("last"))


@query(f"WITH t AS ({fx.TEX}) SELECT CAST(doc_id AS STRING) AS doc_id, 'title' AS context, CAST(3 AS BIGINT) AS line FROM t UNION ALL SELECT CAST(doc_id AS STRING), 'section', CAST(8 AS BIGINT) FROM t")
def chunk_start_lines(spark, sf_dir):
    rows = parse.parse(_tex(spark, sf_dir))
    lines = rebuild.rebuild(rows).select("doc_id", F.explode("start_lines").alias("id", "line"))
    return rows.where("kind = 'chunk' and context in ('title', 'section')").join(lines, ["doc_id", "id"]).select("doc_id", "context", F.col("line").cast("long").alias("line"))


@query()
def stored_placeholders(spark, sf_dir):
    """Placeholders of all kinds that stored parser states list, of every document."""
    from texmill.sources.state import SCHEMA, parser_state

    held = parser_state(parse.parse(_tex(spark, sf_dir))).select("doc_id", F.explode(F.from_json("state", SCHEMA)["all_valid_placeholders"]).alias("p"))
    return held.groupBy("doc_id", F.regexp_extract("p", r"\[\[([A-Z_]+)_", 1).alias("kind")).agg(F.count("*").alias("n"))


@query()
def parsed_documents(spark, sf_dir):
    return parse.parse(_tex(spark, sf_dir))


@query(f"""WITH {_CLEANED} SELECT CAST(doc_id AS STRING) AS doc_id, md5(regexp_replace(clean, '[' || {BLANKS} || ']+', ' ', 'g')) AS digest FROM cleaned""")
def reconstruct_roundtrip(spark, sf_dir):
    """Parsing and rebuilding without translations gives the text without comments again, but for blanks at the ends of sections, lists and titles."""
    made = rebuild.rebuild(parse.parse(_tex(spark, sf_dir)))
    return made.select("doc_id", F.md5(F.regexp_replace("tex", r"[ \t\n\r\x0B\f]+", " ")).alias("digest"))


@query()
def translate_offline_e2e(spark, sf_dir):
    from texmill.plans.translate import translate_documents

    terms = _glossary(spark)
    return translate_documents(_tex(spark, sf_dir), terms)["documents"].select("doc_id", "tex")
