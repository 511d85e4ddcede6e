"""Empty tables, clashing names, very long texts and nothing to learn from; what operators learn, against brute force."""

import math
from collections import Counter, defaultdict

import pytest

from weftgraph.llm import html_extract, lm, mixing

PAGE = "page_id long, url string, html string"


def page(i):
    return f'<body><div class="top">Acme {i % 2}</div><div class="body"><h1>head {i}</h1>{"".join(f"<p>story {i} {j}</p>" for j in range(i % 4))}</div><div class="foot">same words</div></body>'


def test_empty_table_of_pages(spark):
    out = html_extract.extract(spark.createDataFrame([], PAGE))
    assert out.columns == ["page_id", "url", "text", "n_chars"] and out.collect() == []


def test_pages_with_clashing_columns_repeats_and_nulls(spark):
    rows = [(i, f"http://h{i % 2}.example/{i}", page(i)) for i in range(40)] + [(3, "http://h1.example/3", page(3)), (None, None, None), (50, None, ""), (51, "no host", page(1))]
    plain = Counter(map(tuple, html_extract.extract(spark.createDataFrame(rows, PAGE)).collect()))
    more = [(*r, "x", 7, [1], 0.5, b"d", -1) for r in rows]
    clashing = spark.createDataFrame(more, PAGE + ", host string, path long, low array<long>, importance double, digest binary, seen long")
    assert Counter(map(tuple, html_extract.extract(clashing).collect())) == plain and sum(plain.values()) == len(rows)
    assert plain[(None, None, "", 0)] == 1 and plain[(50, None, "", 0)] == 1 and max(plain.values()) == 2


def test_very_long_page(spark):
    said = [f"paragraph {i} of a very long page" for i in range(40_000)]
    html = "<body><nav>menu</nav><article>" + "".join(f"<p>{x}" for x in said) + "</article></body>"
    got = html_extract.extract(spark.createDataFrame([(1, "http://a.example/", html)], PAGE)).collect()
    assert got[0].text == "\n".join(said) and got[0].n_chars == len(got[0].text)


def test_importance_is_the_entropy_of_styles_and_contents(spark):
    rows = [(f"h{i % 3}", page(i)) for i in range(30)] + [("h0", page(0))] * 5 + [("h1", None)]
    seen = defaultdict(Counter)
    for host, html in {r for r in rows if r[1] is not None}:
        for path, kind, value in html_extract.style_counts(html):
            seen[host, path, kind][value] += 1
    want = {}
    for (host, path, _), counts in seen.items():
        n = sum(counts.values())
        share = -sum(k / n * math.log(k / n) for k in counts.values()) / math.log(n) if n > 1 else 1.0
        old = want.get((host, path), (0, 0.0))
        want[host, path] = (max(n, old[0]), max(share, old[1]))
    got = {(r.host, r.path): (r.seen, r.importance) for r in html_extract.site_style_trees(spark.createDataFrame(rows, "host string, html string")).collect()}
    assert got.keys() == want.keys()
    for key, (n, share) in want.items():
        assert got[key][0] == n and got[key][1] == pytest.approx(share, abs=1e-9)
    assert min(s for _, s in got.values()) == pytest.approx(0) and max(s for _, s in got.values()) == pytest.approx(1)


def test_no_row_teaches_the_model(spark):
    docs = spark.createDataFrame([(1, "some words of a text", False), (2, None, None), (3, "", False)], "doc_id long, text string, train boolean")
    got = {r.doc_id: (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in lm.language_model_scores(docs, "train").collect()}
    assert got == {1: (6, 0, 0, 0.0, 0.0), 2: (1, 0, 0, 0.0, 0.0), 3: (1, 0, 0, 0.0, 0.0)}


def test_model_beats_the_base_on_unseen_texts(spark):
    words = [f"w{i}" for i in range(40)]
    text = lambda i: " ".join(words[(i * 7 + j * (1 + i % 3)) % 40] for j in range(30))
    docs = spark.createDataFrame([(i, text(i), i % 5 != 0) for i in range(300)], "doc_id long, text string, train boolean")
    rows = lm.language_model_scores(docs, "train", carry=("doc_id", "train")).collect()
    counts = Counter(w for i in range(300) if i % 5 for w in [*text(i).split(), None])
    n, v = sum(counts.values()), len(counts)
    for r in rows:
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in [*text(r.doc_id).split(), None]))
    unseen = [r for r in rows if not r.train]
    assert len(unseen) == 60 and sum(r.score for r in unseen) > 0.8 * sum(r.base_score for r in unseen)


def test_source_of_equal_texts_meets_its_target(spark):
    """One source is hundreds of copies of one text under ids of their own, another has other texts."""
    rows = [(i, "the same text of seven words here", "hot") for i in range(600)] + [(1000 + i, f"text {i} " + "w " * (i % 5), "cold") for i in range(300)]
    plan = mixing.mixed(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    taken, targets = Counter(), {}
    for r in plan:
        assert r.taken <= 2 * r.size
        taken[r.source] += r.taken
        targets[r.source] = r.target
    assert len(plan) == len(rows) and all(abs(taken[s] - t) <= 14 for s, t in targets.items())
