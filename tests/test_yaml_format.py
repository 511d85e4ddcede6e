"""The data source of YAML documents: batches, planned partitions, error rows, and a stream that starts again."""

import json

import pytest

from weftgraph.sources.yaml_format import FORMAT, YamlDataSource, register
from weftgraph.sources.yaml_source import SPEC, discover, read_specs

A = "openapi: 3.0.0\ninfo: {title: T, version: '1'}\nexternalDocs: {url: u}\ncomponents:\n  schemas:\n    A: {type: object}\n    B: {enum: [yes, 8e-01, 2020-01-01]}\n"


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in/sub").mkdir(parents=True)
    for name, text in {"TS1_A": A, "bad": "a: [", "none": "", "bare": "paths: {}\n", "keys": "components: {schemas: {1: {2: x}}}\n", "sub/TS1_A": "components: null\n"}.items():
        (tmp_path / f"in/{name}.yaml").write_text(text)
    (tmp_path / "in/bytes.yaml").write_bytes(b"title: \xff\xfe\xfd\n")
    (tmp_path / "in/note.yml").write_text("not read")
    return tmp_path / "in"


def test_a_batch_gives_the_rows_of_the_files(spark, folder):
    register(spark)
    read = spark.read.format(FORMAT).load(str(folder))
    assert read.schema.simpleString() == spark.createDataFrame([], SPEC).schema.simpleString()
    got = {(r.doc.rsplit("/in/", 1)[-1], r.schema): r for r in read.collect()}
    a, b = got["TS1_A", "A"], got["TS1_A", "B"]
    assert (a.ordinal, a.title, a.version, a.url, a.has_header, a.error) == (0, "T", "1", "u", True, None) and b.ordinal == 1
    assert json.loads(b.spec) == {"enum": [True, "8e-01", "2020-01-01"]}
    assert {k[0] for k, r in got.items() if r.error} == {"bad", "none", "keys", "bytes", "sub/TS1_A"} and got["bare", None].error is None
    assert spark.read.format(FORMAT).option("strict", "false").load(str(folder)).where("doc = 'none' and error is null").count() == 1
    # The same rows as those of the other reader.
    other = read_specs(spark, discover(spark, [str(folder)]))
    key = lambda df: sorted(map(str, df.selectExpr("doc", "schema", "ordinal", "spec", "title", "has_header", "split(error, ':')[0]").collect()))
    assert key(read) == key(other)


def test_one_file_an_empty_folder_and_wrong_paths(spark, folder, tmp_path):
    register(spark)
    load = lambda p: spark.read.format(FORMAT).load(str(p)).count()
    (tmp_path / "empty").mkdir()
    assert load(folder / "TS1_A.yaml") == 2 and load(tmp_path / "empty") == 0
    for wrong, said in (("missing", "does not exist"), ("in/note.yml", "neither")):
        with pytest.raises(Exception, match=said):
            load(tmp_path / wrong)


def test_partitions_by_bytes(folder):
    sizes = {str(p): p.stat().st_size for p in folder.rglob("*.yaml")}
    parts = YamlDataSource({"path": str(folder), "partitionBytes": "40"}).reader(None).partitions()
    assert sorted(f for p in parts for f, _ in p.files) == sorted(sizes) and len(parts) > 2
    assert all(len(p.files) == 1 or sum(sizes[f] for f, _ in p.files) <= 40 for p in parts)


def test_offsets_name_the_same_files_ever_after(folder, tmp_path):
    options = {"path": str(folder), "log": str(tmp_path / "log")}
    files = lambda ps: sorted(f for p in ps for f, _ in p.files)
    one = YamlDataSource(options).streamReader(None)
    zero, first = one.initialOffset(), one.latestOffset()
    before = files(one.partitions(zero, first))
    assert len(before) == 7 and one.latestOffset() == first
    (folder / "new.yaml").write_text(A)
    two = YamlDataSource(options).streamReader(None)  # started again
    second = two.latestOffset()
    assert second == {"entry": 2} and files(two.partitions(first, second)) == [str(folder / "new.yaml")] and files(two.partitions(zero, first)) == before
    assert list(two.partitions(second, second)) == []
    with pytest.raises(ValueError):
        YamlDataSource({"path": str(folder)}).streamReader(None)


def test_a_stream_reads_every_file_once(spark, folder, tmp_path):
    register(spark)

    def run():
        source = spark.readStream.format(FORMAT).option("log", str(tmp_path / "log")).load(str(folder))
        out = source.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start(str(tmp_path / "out"))
        assert out.awaitTermination(120)
        return spark.read.parquet(str(tmp_path / "out"))

    assert run().where("error is not null").count() == 5
    n = run().count()
    (folder / "TS2_B.yaml").write_text(A)
    assert run().count() == n + 2
