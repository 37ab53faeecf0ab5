"""Repeated passages against a brute-force version, and with repeated rows, null ids and odd texts."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from texmill.llm import substring_dedup

WORDS = substring_dedup.REACH


def said(rng, n, vocabulary=5000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def brute(texts, n=51):
    """Texts (by place) that share n words in a row with another text."""
    held = {}
    for k, t in enumerate(texts):
        w = tuple((t or "").split())
        for i in range(len(w) - n + 1):
            held.setdefault(w[i : i + n], set()).add(k)
    return {k for of in held.values() if len(of) > 1 for k in of}


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, _t string, _cuts int")


@pytest.fixture(scope="module")
def texts():
    """Passages of 45 to 70 words and more, copies, near copies, runs of a word, runs of three words, line breaks."""
    rng, out = random.Random(17), []
    for n in [*range(45, 70), 51, 51, 51, 52, 50, 50, 130, 400]:
        passage = said(rng, n)
        for _ in range(rng.choice((2, 2, 3))):
            out.append(" ".join(said(rng, rng.randrange(0, 60)) + passage + said(rng, rng.randrange(0, 60))))
    for _ in range(6):  # stitched: every part stands elsewhere, no 51 words of it together
        parts = [said(rng, 26) for _ in range(3)]
        out += [" ".join(sum(parts, []))] + [" ".join(said(rng, 9) + p + said(rng, 9)) for p in parts]
    base = said(rng, 150)
    out += [" ".join(base), " ".join(base), " ".join(base[:70] + ["new"] + base[71:]), "\n".join(base[40:95])]
    out += [" ".join(["na"] * n) for n in (50, 51, 60, 300)] + [" ".join(["a", "b", "c"] * n) for n in (16, 17, 40)] + ["x " + " ".join(["b", "c", "a"] * 30)]
    out += [" ".join(said(rng, rng.randrange(3, 200))) for _ in range(60)] + ["é　ﬁ " * 40 + "end", "z" * 70_000]
    return out


def test_documents_with_repeats_are_those_of_brute_force(spark, texts):
    rows = [(k, t, None, None) for k, t in enumerate(texts)] + [(9000, None, None, None), (9001, "", None, None), (9002, " \n", None, None)]
    spans = substring_dedup.repeated_spans(table(spark, rows)).collect()
    assert {r.doc_id for r in spans} == brute(texts)
    for r in spans:
        cut = texts[r.doc_id].encode()[r.first_byte : r.first_byte + r.n_bytes].decode()
        assert len(cut.split()) == r.n_words >= 51 and r.other_doc != r.doc_id and r.original == (r.other_doc > r.doc_id)


def test_every_long_span_is_found_nearly_whole(spark):
    rng = random.Random(3)
    passage = said(rng, 400)
    rows = [(k, " ".join(said(rng, 30) + passage + said(rng, 30)), None, None) for k in range(3)]
    for r in substring_dedup.repeated_spans(table(spark, rows)).collect():
        assert 370 <= r.n_words <= 400 and r.original == (r.doc_id == 0)


def test_repeated_rows_and_null_ids(spark):
    rng = random.Random(4)
    passage = " ".join(said(rng, 70))
    of = [(k, " ".join(said(rng, 20)) + " " + passage + " " + " ".join(said(rng, 20)), None, None) for k in range(3)]
    once = sorted(map(tuple, substring_dedup.repeated_spans(table(spark, of)).collect()))
    assert len(once) == 3
    assert sorted(map(tuple, substring_dedup.repeated_spans(table(spark, of * 2)).collect())) == once
    assert sorted(map(tuple, substring_dedup.repeated_spans(table(spark, of + of[1:2])).collect())) == once
    assert substring_dedup.repeated_spans(table(spark, [of[0], of[0]])).count() == 0
    unnamed = [(None, *r[1:]) for r in of]
    got = substring_dedup.repeated_spans(table(spark, unnamed)).collect()
    assert len(got) == 3 and all(r.doc_id is None and r.other_doc is None for r in got) and len({r.text_hash for r in got}) == 3
    one_id = [(5, *r[1:]) for r in of] + [(5, "a clean text of this id", None, None)]
    assert {(r.doc_id, r.other_doc) for r in substring_dedup.repeated_spans(table(spark, one_id)).collect()} == {(5, 5)}
    assert substring_dedup.repeated_spans(table(spark, [])).count() == 0


def test_taking_repeats_out(spark):
    rng = random.Random(5)
    passage = " ".join(said(rng, 70))
    rows = [(k, f"ü head{k} " + passage + f" tail{k}", None, k) for k in range(3)] + [(7, None, None, None), (8, "one", "x", 1), (1, "another text of id 1", None, None)]
    docs = table(spark, rows)
    out = substring_dedup.without_repeats(docs, substring_dedup.repeated_spans(docs))
    assert out.columns == docs.columns
    left = sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)
    by = {t: i for i, t in left if t}
    assert rows[0][1] in by and (7, None) in left and (8, "one") in left and (1, "another text of id 1") in left
    short = [t for i, t in left if i in (1, 2) and t and "head" in t]
    assert len(short) == 2 and all(len(t.split()) < 40 and t.startswith("ü head") for t in short)


def test_hot_keys_are_looked_up_at_the_map_side(spark, monkeypatch):
    rng = random.Random(6)
    line = " ".join(said(rng, 56))
    rows = [(k, " ".join(said(rng, 12, 10**9)) + "\n" + line + "\n" + " ".join(said(rng, 12, 10**9)), None, None) for k in range(200)]
    monkeypatch.setattr(substring_dedup, "HOT", 300)
    got = substring_dedup.repeated_spans(table(spark, rows)).collect()
    assert {r.doc_id for r in got} == set(range(200)) and [r.doc_id for r in got if r.original] == [0]


def test_chunks_do_not_depend_on_neighbours():
    rng = random.Random(2)
    texts = [" ".join(said(rng, rng.randrange(0, 90), 60)) for _ in range(30)] + [None, "", "aaaa " * 400, "  \t"]
    c = substring_dedup.Chunker()
    text, *fields = c.chunks(texts)
    for i, t in enumerate(texts):
        _, *own = c.chunks([t])
        for x, y in zip(fields, own, strict=True):
            assert x[text == i].tolist() == y.tolist()


def test_keys_to_search_around_cover_every_window():
    rng = np.random.default_rng(8)
    for _ in range(40):
        h = rng.integers(0, 1 << 40, 400)
        cut = np.flatnonzero([all(h[i] <= h[j] for j in range(max(0, i - WORDS), min(400, i + WORDS + 1))) for i in range(400)])
        stop = np.append(cut, 400)[np.searchsorted(cut, cut + 8)]
        begin = int(rng.integers(60, 200))
        end = begin + int(rng.integers(51, 160))
        inside = (cut > begin + WORDS) & (stop + WORDS < end)  # what a passage from begin to end makes repeated
        word, till = cut[inside], stop[inside]
        at = np.flatnonzero(inside)
        before, after = cut[at] - cut[at - 1], np.minimum(stop[np.minimum(at + 1, len(stop) - 1)] - stop[at], 63)
        n = rng.integers(2, 9, len(word))
        of = substring_dedup.wanted_keys(word, till, np.minimum(before, 63), after, n, [], 51)
        for x in range(begin, end - 50):
            assert any(word[i] >= x and till[i] <= x + 51 for i in of)


def test_clashing_columns(spark):
    rows = [(k, " ".join(["w%d" % j for j in range(60)]) + f" {k}", "x", 1) for k in range(2)]
    docs = table(spark, rows).withColumns({n: F.lit(1) for n in ("key", "t", "id", "place", "group", "low", "high", "n")})
    spans = substring_dedup.repeated_spans(docs)
    assert spans.count() == 2 and substring_dedup.without_repeats(docs, spans).columns == docs.columns
