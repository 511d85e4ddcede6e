"""What is written as N-Triples is read back equal, escapes, blank nodes and all; lines that are none are told."""

from test_turtle import triples

from weftgraph.sources.sinks import parsed_ntriples, read_ntriples, write_ntriples

COLUMNS = ["graph", "s", "s_kind", "p", "o", "o_kind", "o_dt"]


def test_written_graphs_are_read_back(spark, tmp_path):
    t = triples(spark).cache()
    write_ntriples(t, str(tmp_path / "nt"))
    back = read_ntriples(spark, str(tmp_path / "nt"))
    assert back.where("error is not null").count() == 0
    one, two = t.select(*COLUMNS), back.select(*COLUMNS)
    assert one.exceptAll(two).count() == 0 == two.exceptAll(one).count() and one.count() > 100


def test_lines_of_other_writers(spark):
    lines = ['<a> <b> "x\\\\n\\ty \\"q\\" \\u00e9 \\\\\\\\"@en-GB .', "_:x1 <p>\t_:bzz . # said", '<a><b>"1"^^<http://t>.', "", "  # nothing", "<a> <b> .", '<a> <b> "open .', '<a> <b> "" .']
    rows = parsed_ntriples(spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "n int, line string")).orderBy("n").collect()
    assert [(r.n, r.s, r.s_kind, r.p, r.o, r.o_kind, r.o_dt) for r in rows if r.error is None] == [
        (0, "a", "iri", "b", 'x\\n\ty "q" é \\\\', "literal", None), (1, "_:x1", "bnode", "p", "_:bzz", "bnode", None), (2, "a", "iri", "b", "1", "literal", "http://t"), (7, "a", "iri", "b", "", "literal", None),
    ]
    assert [r.n for r in rows if r.error is not None] == [5, 6]
