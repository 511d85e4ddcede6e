"""Stages decide for rows: repeated and null ids lose nothing, and copies of all kinds go."""

from collections import Counter

import corpus_pipeline
from weftgraph.llm import exact_dedup, langid, mixing, near_dedup

from test_pipeline import SCHEMA, shingles

ODD = [(5, "same text here"), (9, "Same text here"), (5, "a unique other text"), (None, "same text here"), (None, "another unique one"), (None, "another unique one"), (7, "twice"), (7, "twice"), (8, None), (3, "")]


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], SCHEMA)


def test_exact_copies_by_row(spark):
    got = Counter((r.doc_id, r.text) for r in corpus_pipeline.drop_exact_copies(spark, table(spark, ODD), "").collect())
    assert got == Counter([(9, "Same text here"), (5, "a unique other text"), (None, "another unique one"), (7, "twice"), (8, None)])


def test_near_copies_by_row(spark):
    base = " ".join(f"w{i}" for i in range(100))
    rows = [*ODD, (50, base), (41, base + " tail"), (50, "this text shares nothing with the others of its id"), (None, "x " + base), (None, "no id and no copy of anything at all")]
    got = Counter((r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, table(spark, rows), "").collect())
    want = Counter([
        (5, "same text here"), (5, "a unique other text"), (None, "another unique one"), (7, "twice"), (8, None), (3, ""), (41, base + " tail"),
        (50, "this text shares nothing with the others of its id"), (None, "no id and no copy of anything at all"),
    ])
    assert got == want


def test_mixing_by_row(spark):
    rows = [(None if i % 3 == 0 else i % 7, f"text {i} " + "w " * (i % 9), "en", ["a", "b", None][i % 3], i) for i in range(400)]
    docs = spark.createDataFrame(rows, SCHEMA)
    plan = mixing.mixed(docs).collect()
    words = Counter()
    for r in plan:
        words[r.source] += r.taken
    for r in plan:
        assert abs(words[r.source] - r.target) <= 12 and r.taken <= 2 * r.size  # within about a document
    out = corpus_pipeline.mix_sources(spark, docs, "").collect()
    times = Counter((r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in out)
    assert set(times) <= set(rows) and max(times.values()) <= 2
    taken = Counter()
    for (_, text, _, source, _), n in times.items():
        taken[source] += n * len(text.split())
    assert taken == words


def test_language_stage_writes_what_it_predicts(spark):
    en, de = "the cat and the dog of the house ", "der hund und die katze in dem haus "
    rows = [(i, (en if i % 2 else de) * 5, "en" if i % 2 else "de", "a", 1) for i in range(60)] + [(100, de * 3, "en", "a", 1), (101, "\u65e5\u672c\u8a9e\u306e\u6587", "en", "a", 1), (102, None, "en", "a", 1), (103, "12 !", "de", "a", 1), (104, en, None, "a", 1)]
    got = {r.doc_id: r.lang for r in corpus_pipeline.identify_language(spark, spark.createDataFrame(rows, SCHEMA), "").collect()}
    assert got[100] == "de" and got[104] == "en" and not {102, 103} & set(got) and len(got) >= 62


def test_many_languages_in_rounds(spark, monkeypatch):
    words = {f"l{k:02d}": " ".join(chr(97 + k % 26) + chr(97 + j % 26) + chr(97 + (k // 26 + j) % 26) for j in range(26)) for k in range(40)}
    docs = spark.createDataFrame([(i, words[g], g) for i, g in enumerate(list(words) * 4)], "doc_id long, text string, lang string")
    whole = {r.doc_id: (r.lang_pred, r.score) for r in langid.languages(docs).collect()}
    monkeypatch.setattr(langid, "LANGUAGES", 7)
    assert {r.doc_id: (r.lang_pred, r.score) for r in langid.languages(docs).collect()} == whole and len({g for g, _ in whole.values()}) > 3 * 7


def test_more_columns_and_clashing_names(spark):
    rows = [(i, f"text {i // 2} of some words and more", i, "r", 1) for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row long, digest string, id long")
    out = exact_dedup.without_copies(docs)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [1, 3, 5, 7, 9]
    out = near_dedup.without_near_copies(docs)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [0, 2, 4, 6, 8]
    assert shingles("a b") == {("a", "b")}
