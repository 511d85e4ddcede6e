"""Edge cases and brute force for every operator on small tables."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from weftgraph.llm import bpe, exact_dedup, html_extract, langid, lm, mixing, near_dedup, suffix_dedup, topk, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, block string"
LONG = " ".join(f"w{i % 977}" for i in range(30_000))
BASE = " ".join(f"word{i}" for i in range(200))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [
        (0, BASE, "en"), (1, BASE + " tail", "en"), (2, BASE.upper(), "en"), (3, None, "en"), (4, "", None), (5, " \t\n", "de"), (6, "one two", "de"), (7, "ONE TWO", "de"), (8, LONG, "fr"),
        (9, LONG, "fr"), (None, BASE, "en"), (None, None, None), (10, "12 34 !!", "en"), (11, "der die und das " * 9, "de"), (12, "the and of to in " * 9, "en"), (13, "der und die das", "de"), (13, "der und die das", "de"),
        (14, "x" + BASE[100:400] + "y", "en"), (15, "日本語 テキスト é ñ 😀", "fr"),
    ]
    return spark.createDataFrame([(i, t, g, f"s{(i or 0) % 3}" if i != 5 else None, 1, "a", "b") for i, t, g in rows], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_near_duplicates(docs, empty):
    got = near_dedup.near_duplicates(docs).collect()
    assert len(got) == docs.count() and near_dedup.near_duplicates(empty).count() == 0
    sets = {}
    for r in docs.where("doc_id is not null").collect():
        w = words(r.text)
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    label = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if a != b and sets[a] & sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), label[r.doc_id], label[r.doc_id] == r.doc_id)


def test_mixing(docs, empty):
    got = mixing.mixed(docs).collect()
    assert len(got) == docs.count() and mixing.mixed(empty).count() == 0
    total = sum(len(words(r.text)) for r in docs.collect())
    target = {r.source: r.target for r in got}
    size = {r.source: r.source_size for r in got}
    assert abs(sum(target.values()) - 1.5 * total) < 1e-6 * total and all(target[s] <= 2 * size[s] + 1e-9 for s in target)
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    assert sorted(map(str, mixing.mixed(docs).collect())) == sorted(map(str, got))


def test_water_filling_against_repeated_clamping(spark):
    sizes, weights = [1000, 10, 300, 0, 50, 7], [5, 2, 1, 5, 2, 1]
    want, held = [0.0] * 6, set()
    while True:
        left = 1.5 * sum(sizes) - sum(2 * sizes[i] for i in held)
        w = sum(weights[i] for i in range(6) if i not in held)
        want = [2.0 * sizes[i] if i in held else left * weights[i] / w for i in range(6)]
        over = {i for i in range(6) if i not in held and want[i] > 2 * sizes[i]}
        if not over:
            break
        held |= over
    df = spark.createDataFrame([(f"s{i}", sizes[i], weights[i]) for i in range(6)], "source string, source_size long, weight int")
    got = {r.source: r.target for r in mixing.water_filled(df, 1.5, 2.0).collect()}
    assert all(abs(got[f"s{i}"] - want[i]) < 1e-6 for i in range(6))


def test_language_model(docs, empty):
    rows = docs.selectExpr("doc_id", "text", "coalesce(doc_id % 5 <> 2, false) as train")
    got = lm.language_model_scores(rows, "train").collect()
    assert lm.language_model_scores(empty.selectExpr("doc_id", "text", "true as train"), "train").count() == 0
    c = Counter(w for r in rows.where("train").collect() for w in [*words(r.text), "\0"])
    n, v = sum(c.values()), len(c)
    want = {r.doc_id: sum(np.log10((c[w] + 1) / (n + v + 1)) for w in [*words(r.text), "\0"]) for r in rows.collect() if r.doc_id is not None}
    for r in got:
        if r.doc_id is not None:
            assert r.train_tokens == n and abs(r.base_score - want[r.doc_id]) < 1e-6 * max(1, abs(want[r.doc_id])) and r.score <= 0


def test_model_probabilities_sum_to_one():
    table = lm.train(np.array([[5.0, 1, 0], [0, 4, 2], [3, 0, 0]]), np.array([0.5, 0.3, 0.2]), width=4, steps=40)
    assert np.allclose((10 ** table.astype(np.float64)).sum(axis=1), 1, atol=1e-4)


def test_suffix_removal(docs, empty):
    got = {(r.doc_id, r.n_bytes): r for r in suffix_dedup.remove_repeats(docs).collect()}
    assert suffix_dedup.remove_repeats(empty).count() == 0
    rows = sorted((r.doc_id, (r.text or "").encode()) for r in docs.where("doc_id is not null").collect())
    first = {}
    for i, t in rows:
        for k in range(len(t) - 49):
            first.setdefault(t[k : k + 50], i)
    for i, t in rows:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - 49):
            if first[t[k : k + 50]] < i:
                gone[k : k + 50] = True
        r = got[i, len(t)]
        kept = hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()
        assert (r.n_removed, r.n_spans, r.kept_sha256) == (int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), kept)


def test_suffix_order_is_a_sort():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 99, 900).astype(np.uint8)
    data[500:700] = data[:200]
    starts = np.arange(850)
    order = suffix_dedup.suffix_order(data, suffix_dedup.extensions(data, starts, 50), starts)
    assert order.tolist() == sorted(range(850), key=lambda i: (data[i : i + 50].tobytes(), i))


def test_language_id(docs, empty):
    got = langid.languages(docs).collect()
    assert len(got) == docs.count() and langid.languages(empty).count() == 0
    by = {r.doc_id: r for r in got}
    assert by[3].lang_pred == by[4].lang_pred == by[5].lang_pred == by[10].lang_pred == "und" and by[11].lang_pred == "de" and by[12].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in got) and by[6].held_out == (zlib.crc32(b"6") % 4 == 2)


def test_gram_counts():
    _, code, n = langid.gram_counts(["aa b"], np.zeros(1, np.int64))
    # Of " aa b " the letters a, a, b; " a", "aa", "a ", " b", "b "; " aa", "aa ", " b ".
    assert n.sum() == 3 + 5 + 3 and len(code) == 10 and sorted(n.tolist()) == [1] * 9 + [2]


def test_html():
    page = (
        '<html><head><title>t</title></head><body><header>site</header><nav><a>menu</a></nav><div class="cookie-notice">ok?</div><article><h1>A &amp; B</h1><p>one\n two<p>three <b>x</b>'
        '<aside>ad</aside><div class="comments"><p>me too</p></div><script>if (a < b) "</p>"</script></article><footer>f</footer></body>'
    )
    assert html_extract.main_text(page) == "A & B\none two\nthree x"
    assert html_extract.main_text("") == "" and html_extract.main_text("<p>a<br>b</p>c <") == "a b\nc <" and html_extract.main_text("<div") in ("", "<div")


def test_html_style_tree(spark):
    body = lambda i: f'<body><div class="top">Acme News</div><div class="body"><p>story {i} {i * 7} text</p></div><div class="low">All rights</div></body>'
    pages = spark.createDataFrame([(i, "http://a.example/%d" % i, body(i)) for i in range(20)] + [(99, None, None)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.extract(pages).collect()}
    assert got[3] == "story 3 21 text" and got[99] == ""


def test_bpe(docs, empty):
    P = pytest.importorskip("public_tokenizers")
    tiktoken = pytest.importorskip("tiktoken")
    path = P.path("byte_bpe_50k.tiktoken")
    ranks = {e: i for i, e in enumerate(bpe.read_ranks(path))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in bpe.encoded(docs, path, P.PATTERN).where("doc_id is not null").collect():
        assert r.ids == enc.encode_ordinary(texts[r.doc_id]) and bytes(r.decoded) == texts[r.doc_id].encode()
    own = bpe.codec(path, P.PATTERN)
    for t in ("  a  b ", "a\n\n b\t c  ", " \u00a0x", "it's we'll", "\x1c \x1d a", "a  ", " "):
        assert own.encode([t])[0] == enc.encode_ordinary(t)
    assert bpe.encoding_digests(empty, path, P.PATTERN).count() == 0


def test_exact_duplicates(docs, empty):
    got = exact_dedup.exact_duplicates(docs).collect()
    assert len(got) == docs.count() and exact_dedup.exact_duplicates(empty).count() == 0
    by = {r.doc_id: r for r in got}
    assert (by[6].keep_id, by[6].kept, by[7].kept, by[6].group_size) == (7, False, True, 2)
    assert by[3].keep_id == 4 and by[3].group_size == 3 and by[0].keep_id == 2


def test_cuckoo_index():
    index = exact_dedup.CuckooIndex(2)
    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(5000)]
    for i, k in enumerate(keys):
        index.insert(k, i)
    assert len(index) == 5000 and all(index.get(k) == i for i, k in enumerate(keys))
    assert all(index.delete(k) for k in keys[::2]) and index.get(keys[0]) is None and index.get(keys[1]) == 1 and not index.delete(keys[0]) and len(index) == 2500


def test_warc(spark, tmp_path):
    big = "<p>" + "é" * 2000
    pages = spark.createDataFrame([(1, "http://a/1", big), (2, None, big), (3, "u\nv", None), (4, "x", "s"), (5, "y", "s"), (None, "z", big)], "page_id long, url string, html string")
    got = {r.page_id: r for r in warc.read_archives(warc.write_archives(pages)).collect()}
    assert len(got) == 6 and got[2].record_type == "response" and bytes(got[2].payload).decode() == big
    assert (got[1].record_type, got[1].refers_to, got[1].payload_bytes) == ("revisit", 2, 4003) and got[4].record_type == got[5].record_type == "response" and got[3].payload_bytes == 0
    for zip64 in (False, True):
        p = tmp_path / f"{zip64}.zip"
        with open(p, "wb") as f:
            w = warc.ZipWriter(f, zip64)
            for i in range(50):
                w.add(f"{i}.warc", bytes([i]) * i)
            w.close()
        with open(p, "rb") as f:
            r = warc.ZipReader(f, p.stat().st_size)
            assert [d for _, d in r.read(list(r.members()))] == [bytes([i]) * i for i in range(50)]
        import zipfile

        assert zipfile.ZipFile(p).testzip() is None


@pytest.mark.parametrize("zip64", [False, True])
def test_warc_members_and_indexes(tmp_path, zip64):
    """Records come back from WARC files by their indexes, without one by walking, and damage is found."""
    import io
    import json
    import zipfile

    made = [warc.record("response", f"http://h.example.org:80/ü {i}", bytes([65 + i % 26]) * (i * 37), i, i * 37, "d", None) for i in range(200)]
    file = io.BytesIO()
    writer = warc.WarcWriter(file, zip64, member_bytes=20_000)
    for i, data in enumerate(made):
        writer.add(f"http://h.example.org:80/ü {i}", "d", data)
    writer.close()
    whole = file.getvalue()
    assert list(warc.ZipReader(file, len(whole)).records()) == made
    other = zipfile.ZipFile(file)
    assert other.testzip() is None
    names = other.namelist()
    assert len(names) > 10 and {n.split("/")[0] for n in names} == {"archive", "indexes"}
    for n in names:
        if n.startswith("indexes/"):
            for line in other.read(n).decode().splitlines():
                key, _, place = line.split(" ", 2)
                place = json.loads(place)
                at, size = int(place["offset"]), int(place["length"])
                assert key.startswith("org,example,h)/") and other.read("archive/" + place["filename"])[at : at + size] in made

    bare = io.BytesIO()
    plain = warc.ZipWriter(bare, zip64)
    plain.add("archive/a.warc", *made[:100])
    plain.add("notes.txt", b"x")
    plain.add("archive/b.warc", *made[100:])
    plain.close()
    assert list(warc.ZipReader(bare, len(bare.getvalue())).records()) == made

    at = whole.index(b"C" * 37 * 2)
    broken = io.BytesIO(whole[:at] + b"x" + whole[at + 1 :])
    with pytest.raises(ValueError):
        list(warc.ZipReader(broken, len(whole)).records())


def test_warc_names_the_response(spark):
    """Empty tables, clashing columns, and the standard fields of revisits."""
    schema = "page_id long, url string, html string, digest string, size long, first long"
    none = warc.read_archives(warc.write_archives(spark.createDataFrame([], schema)))
    assert none.count() == 0
    big = "é" * 70_000
    rows = [(1, "http://a/1", big), (9, None, big), (9, "http://a/9", big), (None, None, big), (None, None, None)]
    done = warc.write_archives(spark.createDataFrame([(*r, "x", 0, 0) for r in rows], schema))
    got = sorted((str(r.page_id), r.url, r.record_type, r.refers_to, r.payload_bytes) for r in warc.read_archives(done).collect())
    assert got == sorted([("1", "http://a/1", "revisit", 9, 140_000), ("9", "", "response", None, 140_000), ("9", "http://a/9", "response", None, 140_000), ("None", "", "revisit", 9, 140_000), ("None", "", "response", None, 0)])
    raw = []
    for r in done.collect():
        files, path = warc._open(r.archive)
        with files.open_input_file(path) as f:
            raw += [warc.parsed(x)[0] for x in warc.ZipReader(f, files.get_file_info(path).size).records()]
    ids = {f["warc-record-id"] for f in raw if f["warc-target-uri"] == "http://a/9"}
    assert {f["warc-refers-to"] for f in raw if f["warc-type"] == "revisit"} == ids and len(ids) == 1


def test_top_products(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=8)], 0) for i in range(120)] + [(120, None, 0), (121, [None] * 8, 0), (122, [float("nan")] * 8, 0), (123, rows0 := [0.5] * 8, 0), (124, rows0, 0)]
    got = topk.top_inner_products(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    v = {i: np.floor(256 * np.array(x, np.float32).astype(np.float64)) for i, x, _ in rows if x and None not in x and np.isfinite(x).all()}
    want = []
    for q in (0, 50, 100):
        best = sorted((-int(v[q] @ v[c]), c) for c in v if c != q)[:5]
        want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(best)]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == sorted(want)
    none = topk.top_inner_products(spark.createDataFrame([], "vec_id long, embedding array<float>, label int"))
    assert none.count() == 0
