"""Document views made from the tables by SQL that Spark and other engines read alike; no backslash in a literal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

B, N = "chr(92)", "chr(10)"
ID = "CAST(doc_id AS STRING)"

#: doc_id, tex: a small article around each text, damaged in known ways by doc_id.
TEX = f"""SELECT doc_id, concat(
  {B}, 'documentclass{{article}}', {N}, '% made from ', source, {N}, {B}, 'usepackage[utf8]{{inputenc}}', {N}, {B}, 'title{{Document ', {ID}, '}}', {N},
  {B}, 'begin{{document}}', {N}, {B}, 'begin{{abstract}}', {N}, '% hidden', {N}, 'On ', lang, ' and ', source, '.', {N}, {B}, 'end{{abstract}}', {N},
  {B}, 'section{{', source, '}}', {N}, text, ' % a note', {N}, 'About 50', {B}, '% of it & more # here', {N}, {N},
  'See ', {B}, 'cite{{', lang, ',base}} and ', {B}, 'ref{{s', {ID}, '}} with $x_{{', {ID}, '}}$.', {N}, {B}, 'label{{s', {ID}, '}}', {N}, '% a line to drop', {N},
  CASE WHEN doc_id % 7 = 0 THEN 'open {{ here' WHEN doc_id % 7 = 1 THEN 'close }} here' WHEN doc_id % 7 = 2 THEN 'odd ( ] here' ELSE '' END, {N}, {B}, 'end{{document}}') AS tex
  FROM documents WHERE text IS NOT NULL"""

#: doc_id, original, translated: the article and a damaged copy of it.
PAIRS = f"""SELECT doc_id, tex AS original, CASE
  WHEN doc_id % 6 = 0 THEN replace(tex, concat({B}, 'cite{{'), concat({B}, 'mycite{{'))
  WHEN doc_id % 6 = 1 THEN replace(tex, ',base}}', ',other}}')
  WHEN doc_id % 6 = 2 THEN concat(tex, ' $')
  WHEN doc_id % 6 = 3 THEN left(tex, 40)
  WHEN doc_id % 6 = 4 THEN replace(concat(tex, tex), concat({B}, 'ref{{'), concat({B}, 'other{{'))
  ELSE concat('T:', tex) END AS translated FROM ({TEX}) t"""

_LINES = f"replace(replace(text, chr(13) || {N}, {N}), chr(13), {N})"
_verbatim = lambda text: f"{B}, 'begin{{verbatim}}', {N}, {text}, {N}, {B}, 'caption{{not ', {ID}, '}}', {N}, {B}, 'end{{verbatim}}'"
#: doc_id, tex: an article of every construct that the parser knows, with the text as a verbatim one.
CONSTRUCTS = f"""SELECT doc_id, concat(
  {B}, 'documentclass{{article}}', {N}, {B}, 'begin{{document}}', {N}, {B}, 'title{{T ', {ID}, '}}', {N}, {B}, 'author{{A ', {ID}, ' ', {B}, 'and {{B}}}}', {N},
  {B}, 'begin{{figure}}', {N}, {B}, 'includegraphics[width=1cm]{{f', {ID}, '.png}}', {N}, {B}, 'caption[s]{{Cap {{', {ID}, '}} of ', source, '}}', {N}, {B}, 'captionof{{table}}{{Of ', {ID}, '}}', {N}, {B}, 'end{{figure}}', {N},
  {_verbatim('text')}, {N},
  {B}, 'begin{{equation}}x_{{', {ID}, '}}', {B}, 'end{{equation}}', {N}, {B}, 'begin{{itemize}}', {N}, {B}, 'item thing ', {ID}, ' of ', lang, {N}, {B}, 'end{{itemize}}', {N},
  {B}, 'section{{S ', {ID}, '}}', {N}, 'Words of paragraph ', {ID}, ' that run on for long enough', {B}, 'footnote{{Note ', {ID}, ' here}}.', {N}, {N},
  'Display ', {B}, '[ y_{{', {ID}, '}} ', {B}, '] and ', {B}, '( z ', {B}, ') and $m_{{', {ID}, '}}$ and line', {B}, {B}, '[2pt] end of it all.', {N}, {B}, 'end{{document}}') AS tex
  FROM documents WHERE text IS NOT NULL"""
#: doc_id, kind, context, digest of all chunks and placeholders of CONSTRUCTS.
CONSTRUCTS_SQL = f"""SELECT {ID} AS doc_id, x.kind, x.context, md5(x.said) AS digest FROM (SELECT doc_id, unnest([
  {{'kind': 'chunk', 'context': 'title', 'said': concat('T ', {ID})}}, {{'kind': 'placeholder', 'context': 'AUTHOR', 'said': concat({B}, 'author{{A ', {ID}, ' ', {B}, 'and {{B}}}}')}},
  {{'kind': 'chunk', 'context': 'caption', 'said': concat('Cap {{', {ID}, '}} of ', source)}}, {{'kind': 'chunk', 'context': 'caption', 'said': concat('Of ', {ID})}},
  {{'kind': 'placeholder', 'context': 'GRAPHICS', 'said': concat({B}, 'includegraphics[width=1cm]{{f', {ID}, '.png}}')}},
  {{'kind': 'placeholder', 'context': 'ENV', 'said': concat({_verbatim(_LINES)})}}, {{'kind': 'placeholder', 'context': 'ENV', 'said': concat({B}, 'begin{{equation}}x_{{', {ID}, '}}', {B}, 'end{{equation}}')}},
  {{'kind': 'placeholder', 'context': 'MATH', 'said': concat({B}, '[ y_{{', {ID}, '}} ', {B}, ']')}}, {{'kind': 'placeholder', 'context': 'MATH', 'said': concat({B}, '( z ', {B}, ')')}}, {{'kind': 'placeholder', 'context': 'MATH', 'said': concat('$m_{{', {ID}, '}}$')}},
  {{'kind': 'chunk', 'context': 'itemize', 'said': concat({B}, 'item thing ', {ID}, ' of ', lang)}}, {{'kind': 'chunk', 'context': 'section', 'said': concat('S ', {ID})}}, {{'kind': 'chunk', 'context': 'footnote', 'said': concat('Note ', {ID}, ' here')}},
  {{'kind': 'chunk', 'context': 'paragraph', 'said': concat('Words of paragraph ', {ID}, ' that run on for long enough', '{{{{CHUNK}}}}.')}},
  {{'kind': 'chunk', 'context': 'paragraph', 'said': concat('Display [[MATH_5]] and [[MATH_6]] and [[MATH_4]] and line', {B}, {B}, '[2pt] end of it all.')}}]) AS x FROM documents WHERE text IS NOT NULL) y"""

#: chunk_id, source, translation: units with placeholders that the translation keeps, misspells, invents or loses.
UNITS = f"""SELECT doc_id AS chunk_id, concat('See [[MATH_', {ID}, ']] and [[CITE_', CAST(doc_id + 1 AS STRING), ']] in ', lang) AS source,
  CASE WHEN doc_id % 5 = 0 THEN concat('T: [[MTH_', {ID}, ']] [[CITE_', CAST(doc_id + 1 AS STRING), ']]')
  WHEN doc_id % 5 = 1 THEN concat('T: [[MATH_', {ID}, ']] [[CITE_', CAST(doc_id + 1 AS STRING), ']] [[REF_', CAST(doc_id + 2 AS STRING), ']]')
  WHEN doc_id % 5 = 2 THEN concat('T: [[MATH_', {ID}, ']]')
  WHEN doc_id % 5 = 3 THEN concat('[[UNKNOWN_THING_', {ID}, ']]')
  ELSE concat('T: [[CITE_', CAST(doc_id + 1 AS STRING), ']] [[MATH_', {ID}, ']]') END AS translation FROM documents WHERE doc_id IS NOT NULL"""
#: placeholder: those that are valid in some document.
VALID = f"SELECT concat('[[REF_', {ID}, ']]') AS placeholder FROM documents UNION SELECT concat('[[MATH_', {ID}, ']]') FROM documents UNION SELECT concat('[[CITE_', {ID}, ']]') FROM documents"

#: paper_id, path, size, content: four kinds of paper folders by page.
FILES = f"""SELECT page_id AS paper_id, path, CAST(length(path) * 10 + page_id % 7 AS BIGINT) AS size,
    CASE WHEN path LIKE '%body.tex' THEN concat('% ', {B}, 'documentclass{{x}}', {N}, 'body') WHEN path LIKE '%.tex' THEN concat({B}, 'documentclass{{a}}', {N}, {B}, 'input{{sec/body}}', {N}, {B}, 'include{{missing}}') ELSE 'x' END AS content
  FROM (SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'paper.tex' WHEN page_id % 4 = 1 THEN 'ms.tex' WHEN page_id % 4 = 2 THEN 'zeta.tex' ELSE 'body.tex' END AS path FROM pages
        UNION ALL SELECT page_id, 'sec/body.tex' FROM pages UNION ALL SELECT page_id, 'alpha.tex' FROM pages WHERE page_id % 3 = 0
        UNION ALL SELECT page_id, 'refs.bib' FROM pages WHERE page_id % 2 = 0 UNION ALL SELECT page_id, 'fig/a.png' FROM pages WHERE page_id % 5 = 0 UNION ALL SELECT page_id, 'main.bbl' FROM pages WHERE page_id % 3 = 1) f"""

#: ok, latency_ms, error, model: events as calls.
CALLS = "SELECT event_id, event_type <> 'error' AND event_id % 9 <> 0 AS ok, value AS latency_ms, CASE WHEN event_id % 9 = 0 THEN concat('error ', CAST(event_id % 13 AS STRING)) END AS error, event_type AS model FROM events WHERE value IS NOT NULL"
#: events as provider calls with usage.
USAGE = """SELECT event_id, user_id, event_id % 10 <> 0 AS has_usage, event_id % 3 = 0 AS cache_hit, CASE WHEN event_id % 3 = 0 THEN event_id % 100 END AS cached,
  event_id % 500 AS prompt, event_id % 70 AS completion, event_id % 500 + event_id % 70 AS tokens, CASE WHEN event_id % 4 = 0 THEN '' ELSE event_type END AS mode FROM events"""

GLOSSARY = [("the", "le"), ("of", "de"), ("AI", "IA"), ("C++", "C plus"), ("nd", "et"), ("is", "est"), ("de", "of"), ("que", "that")]
GLOSSARY_SQL = "SELECT * FROM (VALUES " + ", ".join(f"('{t}', '{x}')" for t, x in GLOSSARY) + ") AS g(term, target)"
#: Rules as (id, severity, pattern, replacement).
RULES = [("double_blank", "warning", "  +", " "), ("digits", "error", "[0-9]{5,}", "N"), ("bar", "warning", "[|]", "/")]
RULES_SQL = "SELECT * FROM (VALUES " + ", ".join(f"('{i}', '{s}', '{p}', '{r}')" for i, s, p, r in RULES) + ") AS r(id, severity, pattern, replacement)"

TABLES = ("documents", "conversations", "pages", "labels", "events", "benchmark")


def views(spark: SparkSession, sf_dir: str, *tables: str) -> None:
    for t in tables or TABLES:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)


def made(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A view's rows, over the tables that it names."""
    views(spark, sf_dir, *(t for t in TABLES if f"FROM {t}" in sql))
    return spark.sql(sql)
