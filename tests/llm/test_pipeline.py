import hashlib
import random
import re

import corpus_pipeline
from weftgraph.llm import near_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components(texts):
    sets = {i: shingles(t) for i, t in texts.items()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            c = len(sets[a] & sets[b])
            if a < b and c and 100 * c >= 85 * len(sets[a] | sets[b]):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {i: find(i) for i in sets}


def drifting(families, members, seed=3):
    """Families in which every text changes a few words of the one before, so that the ends are not alike."""
    rng = random.Random(seed)
    out = []
    for f in range(families):
        w = [f"w{rng.randrange(5000)}" for _ in range(120)]
        for _ in range(members):
            w = list(w)
            w[rng.randrange(len(w))] = f"f{f}x{rng.randrange(10**6)}"
            out.append(" ".join(w))
    rng.shuffle(out)
    return dict(enumerate(out, 1))


def test_lists_in_small_blocks_and_many_packs(spark, monkeypatch):
    texts = drifting(4, 40)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").cache()
    want = components(texts)
    assert len(set(want.values())) > 1
    for block, pack in ((1024, 4096), (7, 4096), (1024, 20), (7, 20)):
        monkeypatch.setattr(near_dedup, "BLOCK", block)
        monkeypatch.setattr(near_dedup, "_PACK", pack)
        got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs).collect()}
        assert got == want, (block, pack)


def test_pipeline_stages(spark, tmp_path):
    texts = drifting(3, 6)
    rows = [(i, t, "en", "a" if i % 3 else None, len(t)) for i, t in texts.items()]
    rows += [(100 + i, t.upper(), "en", "b", len(t)) for i, t in list(texts.items())[:5]]
    rows += [(200, None, None, None, None), (201, "", "en", "b", 0), (202, "12 34 !", None, "b", 7), (203, "a short text", None, None, 12)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.createDataFrame(rows, SCHEMA)
    text = {r[0]: r[1] for r in rows}
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["language_id", "exact_dedup", "near_dedup", "mixing", "byte_bpe"]

    known = steps["language_id"](spark, docs, str(tmp_path))
    assert known.columns == list(corpus_pipeline.COLUMNS)
    left = {r.doc_id for r in known.collect()}
    assert left == {i for i, t in text.items() if re.search("[A-Za-z]", t or "")}

    single = steps["exact_dedup"](spark, known, str(tmp_path))
    last = {}
    for i in sorted(left):
        last[text[i].lower()] = i
    assert sorted(r.doc_id for r in single.collect()) == sorted(last.values())

    apart = steps["near_dedup"](spark, single, str(tmp_path))
    label = components({i: text[i] for i in last.values()})
    assert sorted(r.doc_id for r in apart.collect()) == sorted(set(label.values()))

    mixed = [r.doc_id for r in steps["mixing"](spark, apart, str(tmp_path)).collect()]
    assert mixed and set(mixed) <= set(label.values()) and max(mixed.count(i) for i in mixed) <= 2

    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in out) == sorted(mixed)
    assert all(r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest() and r.n_tokens > 0 for r in out)


def test_pipeline_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
