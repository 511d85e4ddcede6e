"""Profiles and out-of-place distances against Counters of strings."""

import random
from collections import Counter

import numpy as np

from weftgraph.llm import langid


def grams(text):
    low = "".join(c if c.isalpha() else " " for c in f" {text} ".lower())
    low = " " + " ".join(low.split()) + " " if low.strip() else " "
    out = Counter(c for c in low if c != " ")
    out.update(low[i : i + 2] for i in range(len(low) - 1))
    out.update(low[i : i + 3] for i in range(len(low) - 2) if low[i + 1] != " ")
    return out


def code(gram):
    out = 0
    for c in gram:
        out = out << 21 | (1 if c == " " else ord(c))
    return out


def ranked(counts, most):
    return sorted(counts, key=lambda g: (-counts[g], code(g)))[:most]


def texts(seed, n):
    rng = random.Random(seed)
    letters = {"xa": "abcdeé", "xb": "abcdßü", "xc": "жзиаbc", "xd": "語言学abc"}
    out = []
    for i in range(n):
        lang = rng.choice(list(letters))
        out.append((i, " ".join("".join(rng.choice(letters[lang]) for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(1, 40))), lang))
    return out


def test_grams_are_those_of_strings():
    samples = ["aa b", "", "  ", "12 . 3", "Éa-ÉA", "a", "ab1cd\n\te", "語言 x", "a" * 50, "\U0001d552b \U00010400"]
    group, found, n = langid.gram_counts(samples, np.arange(len(samples)))
    for i, text in enumerate(samples):
        got = dict(zip(found[group == i].tolist(), n[group == i].tolist(), strict=True))
        assert got == {code(g): k for g, k in grams(text).items()}, text
    assert (np.lexsort((found, group)) == np.arange(len(group))).all()


def test_profiles_and_predictions(spark):
    rows = texts(1, 150) + [(500, None, "xa"), (501, "123 !", "xb"), (502, "abc", None), (503, "", None)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, score string")
    total = {}
    for i, text, lang in rows:
        if text is not None and lang is not None:
            total.setdefault(lang, Counter()).update(grams(text))
    profiles = {lang: {g: r for r, g in enumerate(ranked(c, langid.PROFILE))} for lang, c in total.items() if c}
    learned = langid.learn_profiles(docs)
    got = {}
    for r in learned.collect():
        got.setdefault(r.lang, {})[r.gram] = r["rank"]
    assert got == {lang: {code(g): r for g, r in p.items()} for lang, p in profiles.items()}

    want = {}
    for i, text, _ in rows:
        own = ranked(grams(text or ""), langid.DOCUMENT)
        if not own or not any(c.isalpha() for c in text or ""):
            want[i] = ("und", 0.0)
            continue
        away = {lang: sum(abs(p[g] - r) if g in p else langid.PROFILE for r, g in enumerate(own)) for lang, p in profiles.items()}
        best = min(sorted(away), key=away.get)
        want[i] = (best, 1 - away[best] / (len(own) * langid.PROFILE))
    for most in (64, 3):
        langid.LANGUAGES, before = most, langid.LANGUAGES
        try:
            found = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs, learned).collect()}
        finally:
            langid.LANGUAGES = before
        assert {i: x[0] for i, x in found.items()} == {i: x[0] for i, x in want.items()}
        assert all(abs(found[i][1] - want[i][1]) < 1e-9 for i in want)


def test_nothing_taught(spark):
    docs = spark.createDataFrame([(2, "abc def", None), (3, None, "xa"), (4, "12", "xb")], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in langid.languages(docs).collect()} == {"und"}
    assert langid.languages(docs.where("false")).count() == 0
