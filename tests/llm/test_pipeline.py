"""The pipeline's stages on a small table, each judged on its own input."""

import re

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")
DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, kept = docs.columns, [docs.count()]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontaminate", "secret_scan", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA).cache()
        kept.append(docs.count())
        assert docs.columns == columns and docs.dtypes == spark.read.parquet(f"{DATA}/documents.parquet").dtypes, name
    assert kept[0] > kept[1] > kept[2] and kept[3] == kept[4] > 0
    assert not any(re.search(r'token = "[0-9a-fA-F]{40}"', r.text, re.I) for r in docs.collect())
    assert docs.where(F.length("text") != F.col("n_chars")).count() == 0
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert pieces.select("doc_id").distinct().count() == kept[4]


def test_run_twice_gives_the_same(spark):
    a, b = (sorted(map(tuple, corpus_pipeline.run(spark, DATA).drop("sequence_id", "offset").collect())) for _ in range(2))
    assert a == b and a


ODD = "doc_id long, text string, lang string, source string, n_chars long, n long, t long, kept string, key string, score double, _t int"


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """A folder of tables with nulls, repeated and clashing rows, an empty benchmark and no labels; and its documents."""
    at = tmp_path_factory.mktemp("odd")
    said = lambda k, n=40: " ".join(f"w{(7 * k + j * j) % 97}of{k}" for j in range(n))
    rows = [(1, said(1)), (1, said(1)), (1, said(2)), (2, said(2)), (3, said(2) + " more"), (None, said(3)), (None, said(3)), (None, None), (4, None), (5, ""), (6, " \n"), (7, "x" * 50_000), (8, 'token = "' + "4f" * 20 + '" ' + said(8))]
    docs = spark.createDataFrame([(*r, None, "s", None, 1, 1, "x", "k", 0.5, 1) for r in rows], ODD)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, said(8)), (2, None), (None, said(3))], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at), docs


def test_stages_on_odd_rows(spark, odd):
    at, docs = odd
    stages = dict(corpus_pipeline.STAGES)

    def ids(df):
        assert df.columns == docs.columns and df.dtypes == docs.dtypes
        return sorted((str(r.doc_id), (r.text or "")[:12]) for r in df.collect())

    every = ids(docs)
    assert ids(stages["quality"](spark, docs, at)) == [x for x in every if x[1].strip()]
    near = ids(stages["near_dedup"](spark, docs, at))
    assert [i for i, _ in near].count("1") == 2 and not {"2", "3"} & {i for i, _ in near}  # id 1 has two texts; its second is in 2 and 3
    assert [i for i, _ in near].count("None") == 3 and {"4", "5", "6", "7", "8"} <= {i for i, _ in near}
    clean = ids(stages["decontaminate"](spark, docs, at))
    assert [i for i, _ in clean].count("None") == 1 and "8" not in {i for i, _ in clean} and len(clean) == len(every) - 3
    safe = stages["secret_scan"](spark, docs, at).collect()
    assert len(safe) == len(every) and [r.text[:19] for r in safe if r.doc_id == 8] == ['token = "[SECRET]" ']
    pieces = stages["packing"](spark, docs.where("doc_id is not null"), at)
    assert pieces.select("doc_id").distinct().count() == 8


def test_stages_on_an_empty_table(spark, odd):
    at, docs = odd
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, at).count() == 0, name


def test_stages_keep_what_brute_force_keeps(spark):
    """Near-duplicates, contamination and secrets of whole small tables by definition, each stage on its own input."""
    documents = spark.read.parquet(f"{DATA}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    rows = {r.doc_id: r.text for r in documents.collect()}
    sets = {}
    for i, text in rows.items():
        w = (text or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    group = {i: i for i in rows}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in sorted(rows):
        for b in sorted(rows):
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                group[max(x, y)] = min(x, y)
    kept = {i for i in rows if find(i) == i}
    assert {r.doc_id for r in stages["near_dedup"](spark, documents, DATA).collect()} == kept

    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda t: word.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    windows = {tuple(w[k : k + 13]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect() if (w := words(r.text)) for k in range(max(1, len(w) - 12))}
    clean = set()
    for i, text in rows.items():
        w, hit = words(text), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
        if not hit or 20 * len(hit) < len(w):
            clean.add(i)
    assert {r.doc_id for r in stages["decontaminate"](spark, documents, DATA).collect()} == clean and len(clean) < len(rows)


def test_queries_are_registered():
    import __spark_entry__ as e

    names = set(e.queries())
    assert "pipeline" in names and {re.match(r"op(\d+)_", n)[1] for n in names if re.match(r"op\d+_", n)} == set(map(str, range(1, 11)))
