"""Tables live as long as a result reads them, whoever else is at work."""

import threading

import corpus_pipeline
import pytest

from weftgraph.llm import exact_dedup, storage

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, name, n=60):
    return spark.createDataFrame([(i, f"{name} text {i % 7}", "xa", name, 5) for i in range(n)], SCHEMA)


def test_two_results_alive(spark):
    a = corpus_pipeline.drop_exact_copies(spark, documents(spark, "one"), "")
    b = corpus_pipeline.drop_near_copies(spark, documents(spark, "two words more than five words"), "")
    c = corpus_pipeline.mix_sources(spark, documents(spark, "three"), "")
    assert b.count() == 7 and a.count() == 7 and c.count() >= 60 and a.count() == 7


def test_two_threads(spark):
    out, errors = {}, []

    def work(name):
        try:
            for k in range(3):
                out[name, k] = sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, documents(spark, f"{name} {k} with some more words"), "").collect())
        except Exception as e:
            errors.append(e)

    threads = [threading.Thread(target=work, args=(n,)) for n in ("one", "two")]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors and set(map(tuple, out.values())) == {tuple(range(7))} and len(out) == 6


def test_scopes(spark):
    with storage.scope() as outer:
        a = storage.stored(spark.range(3), "a")
        with storage.scope() as inner:
            b, c = storage.stored(spark.range(4), "b"), storage.stored(spark.range(5), "c")
            inner.delete(spark, b)
        assert len(inner.folders) == 1 and len(outer.folders) == 2
        assert a.count() == 3 and b.count() == 4
        with pytest.raises(Exception):
            c.count()
    outer.delete(spark)
    with pytest.raises(Exception):
        a.count()
    storage.stored(spark.range(2), "d")  # outside of scopes nothing is tracked
    assert not outer.folders


@pytest.mark.parametrize("files", [1 << 16, 0])
def test_numbers(spark, tmp_path, monkeypatch, files):
    monkeypatch.setattr(storage, "FILES", files)
    spark.range(0, 1000, 1, 7).selectExpr("id as doc_id", "id as ROW").write.parquet(str(tmp_path / "t"))
    scan = spark.read.parquet(str(tmp_path / "t"))
    for df in (scan, scan.where("doc_id > 5").select("ROW", "doc_id"), scan.union(scan), scan.limit(20), scan.join(spark.range(3), scan.doc_id >= 0).drop("id"), spark.range(9).selectExpr("id as doc_id", "id as ROW")):
        rows, name = storage.numbered(df)
        assert name == "row_" and rows.columns == [*df.columns, "row_"]
        first = {(r.doc_id, r.row_) for r in rows.collect()}
        assert len(first) == df.count() == len({n for _, n in first}) and first == {(r.doc_id, r.row_) for r in rows.repartition(3).collect()}
        assert rows.select(*df.columns).exceptAll(df).count() == 0


def test_copies_of_files(spark, tmp_path):
    documents(spark, "x", 90).repartition(5).write.parquet(str(tmp_path / "d"))
    kept = exact_dedup.without_copies(spark.read.parquet(str(tmp_path / "d")))
    assert sorted(r.doc_id for r in kept.collect()) == list(range(83, 90))
