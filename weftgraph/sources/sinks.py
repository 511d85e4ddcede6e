"""Triples out and in: N-Triples lines and Parquet anywhere, Turtle by subjects and blank-node trees."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.naming import DASH, OWL, RDF, RDFS, SH, XSD, file_label, file_stem, main_namespace
from .document_sink import write_files

STANDARD = {"rdf": RDF, "rdfs": RDFS, "xsd": XSD, "owl": OWL, "sh": SH, "dash": DASH}


def _escaped(x: Column) -> Column:
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def blank_label(x: Column) -> Column:
    """A node path as a blank-node label: characters N-Triples lacks become x and their code."""
    return F.concat(F.lit("_:b"), F.lower(F.hex(F.substring(x, 3, 1 << 20))))


def ntriples(triples: DataFrame) -> DataFrame:
    """(graph, doc, line), a line for each triple; fully distributed."""
    term = lambda v, k: F.when(k == "iri", F.concat(F.lit("<"), v, F.lit(">"))).otherwise(blank_label(v))
    literal = F.concat(F.lit('"'), _escaped(F.col("o")), F.lit('"'), F.coalesce(F.concat(F.lit("^^<"), F.col("o_dt"), F.lit(">")), F.lit("")))
    o = F.when(F.col("o_kind") == "literal", literal).otherwise(term(F.col("o"), F.col("o_kind")))
    return triples.select("graph", "doc", F.concat(term(F.col("s"), F.col("s_kind")), F.lit(" <"), F.col("p"), F.lit("> "), o, F.lit(" .")).alias("line"))


_NT_IRI, _NT_BLANK = r"<[^<>\"{}|^`\\\x00-\x20]*>", r"_:[^\s<>\"]+"
_NT_LINE = rf"^\s*({_NT_IRI}|{_NT_BLANK})\s*({_NT_IRI})\s*(.*)$"
_NT_NODE = rf"^({_NT_IRI}|{_NT_BLANK})\s*\.\s*(?:#.*)?$"
#: From the first quote to the last one: a pattern of escapes would go as deep as a text is long.
_NT_LITERAL = rf'^("(.*)")(?:\^\^({_NT_IRI})|@[A-Za-z0-9-]+)?\s*\.\s*(?:#[^"]*)?$'


def parsed_ntriples(lines: DataFrame, column: str = "line") -> DataFrame:
    """The columns of lines, but for the line, with s, s_kind, p, o, o_kind, o_dt and error: a row for each line that is neither empty nor a comment.

    Expressions of the JVM alone, so that files are split anywhere between lines. error has
    a line that is no triple. Blank nodes that `ntriples` wrote get their paths back;
    language tags are dropped, as the model has none.
    """
    text = F.col(column)
    part = lambda x, pattern, i: F.nullif(F.regexp_extract(x, pattern, i), F.lit(""))
    inside = lambda x: F.substring(x, F.lit(2), F.length(x) - 2)
    rows = lines.where(~F.trim(text).startswith("#") & (F.trim(text) != "")).withColumns({f"_{n}": part(text, _NT_LINE, i) for i, n in ((1, "s"), (2, "p"), (3, "rest"))})
    c, literal = F.col, F.col("_rest").startswith('"')
    rows = rows.withColumns({"_node": F.when(~literal, part(c("_rest"), _NT_NODE, 1)), "_text": F.when(literal, part(c("_rest"), _NT_LITERAL, 1)), "_dt": F.when(literal, part(c("_rest"), _NT_LITERAL, 3))})
    plain = F.replace(F.replace(inside(c("_text")), F.lit("\\\\"), F.lit("")), F.lit('\\"'), F.lit(""))
    good = F.coalesce(c("_node").isNotNull() | ~plain.contains('"'), F.lit(False))

    def node(x: Column) -> Column:
        code = F.regexp_extract(x, "^_:b((?:[0-9a-f][0-9a-f])++)$", 1)
        path = F.concat(F.lit("_:"), F.decode(F.unhex(code), "UTF-8"))
        return F.when(x.startswith("<"), inside(x)).when(code != "", path).otherwise(x)

    kind = lambda x: F.when(x.startswith("<"), "iri").otherwise("bnode")
    # Escapes are those of JSON.
    value = F.when(~c("_text").contains("\\"), inside(c("_text"))).otherwise(F.get(F.from_json(F.concat(F.lit("["), c("_text"), F.lit("]")), "array<string>", {"allowUnquotedControlChars": "true"}), F.lit(0)))
    own = {
        "s": node(c("_s")), "s_kind": kind(c("_s")), "p": inside(c("_p")), "o": F.when(literal, value).otherwise(node(c("_node"))), "o_kind": F.when(literal, "literal").otherwise(kind(c("_node"))),
        "o_dt": inside(c("_dt")),
    }
    return rows.select(*(x for x in lines.columns if x != column), *(F.when(good, x).alias(n) for n, x in own.items()), F.when(~good, text).alias("error"))


def read_ntriples(spark: SparkSession, path: str) -> DataFrame:
    """(graph, s, s_kind, p, o, o_kind, o_dt, error) of what `write_ntriples` wrote; graph only if the files are in its folders."""
    return parsed_ntriples(spark.read.text(path), "value")


def write_ntriples(triples: DataFrame, path: str) -> None:
    ntriples(triples).select("graph", "line").write.mode("overwrite").partitionBy("graph").text(path)


def write_parquet(triples: DataFrame, path: str) -> None:
    triples.write.mode("overwrite").partitionBy("graph").parquet(path)


#: Where the files of each graph go, by the name of the document.
FILES = {"rdf": "rdf/{}_rdf.ttl", "shacl": "shacl/{}_shacl.ttl", "owl": "{}.ttl"}


def turtle_file(graph: Column, doc: Column) -> Column:
    """The file of a document's graph."""
    out = F.lit(None)
    for g, pattern in FILES.items():
        before, after = pattern.split("{}")
        out = F.when(graph == g, F.concat(F.lit(before), file_stem(doc), F.lit(after))).otherwise(out)
    return out


def write_turtle(lines: DataFrame, path: str) -> None:
    """Write lines(graph, doc, place, text) as rdf/<name>_rdf.ttl, shacl/<name>_shacl.ttl or <name>.ttl, a file each.

    The lines of a document go through one task, which writes them as they come, so that
    none is too long. A file that is there is replaced. Documents must have names of their own.
    """
    write_files(lines.select(turtle_file(F.col("graph"), F.col("doc")).alias("file"), "place", "text"), path)


_LOCAL = r"[A-Za-z_][A-Za-z0-9_\-]*"
_LITERAL = (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"))


def _short(x: Column) -> Column:
    """An IRI with a prefix, the document's own (label, space) or a standard one, else in brackets."""
    out = F.concat(F.lit("<"), x, F.lit(">"))
    spaces = [(F.lit(p), F.lit(u)) for p, u in STANDARD.items()]
    for label, space in [*spaces, (F.col("label"), F.col("space"))]:  # the document's own first
        local = F.substring(x, F.length(space) + 1, F.length(x))
        out = F.when(F.startswith(x, space) & local.rlike(f"^{_LOCAL}$"), F.concat(label, F.lit(":"), local)).otherwise(out)
    return out


def _object(o: Column, kind: Column, dt: Column) -> Column:
    text = o
    for x, y in _LITERAL:
        text = F.replace(text, F.lit(x), F.lit(y))
    bare = ((dt == XSD + "integer") & o.rlike(r"^[+-]?\d+$")) | ((dt == XSD + "boolean") & o.isin("true", "false"))
    literal = F.when(bare, o).otherwise(F.concat(F.lit('"'), text, F.lit('"'), F.when(dt.isNotNull(), F.concat(F.lit("^^"), _short(dt))).otherwise("")))
    return F.when(kind == "literal", literal).when(o == RDF + "nil", "()").otherwise(_short(o))


def _body(pairs: Column, depth: str = "    ") -> Column:
    """(p, predicate, object) of one subject as Turtle: its type first, then by predicate; objects in order."""
    ordered = F.array_sort(F.array_distinct(F.transform(pairs, lambda x: F.struct((x["p"] != RDF + "type").alias("late"), x["p"].alias("p"), x["predicate"].alias("predicate")))))
    said = lambda k: F.concat(k["predicate"], F.lit(" "), F.array_join(F.array_sort(F.transform(F.filter(pairs, lambda x: x["p"] == k["p"]), lambda x: x["object"])), ", "))
    return F.array_join(F.transform(ordered, said), " ;\n" + depth)


#: Triples of whole schemas that a task turns into text at once, about.
_HELD = 20_000


def _batched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Triples of blank nodes in the order of their schemas, in portions that end where a schema ends."""
    held: list[pd.DataFrame] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += len(batch)
        if rows >= _HELD:
            whole = pd.concat(held, ignore_index=True)
            key = ["graph", "doc", "tree"]
            first = int((whole[key] == whole[key].iloc[-1]).all(axis=1).to_numpy().argmax())  # of the last schema, which may go on
            if first:
                yield whole.iloc[:first]
            held, rows = [whole.iloc[first:]], len(whole) - first
    if rows:
        yield pd.concat(held, ignore_index=True)


def _trees(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for portion in _batched(batches):
        for (graph, doc), rows in portion.groupby(["graph", "doc"], sort=False):
            yield _texts(graph, doc, rows)


def _texts(graph: str, doc: str, pdf: pd.DataFrame) -> pd.DataFrame:
    """The blank nodes of whole schemas to the texts of those that no other of them holds: as an object of a subject, and as a statement."""
    by: dict[str, dict[str, tuple[str, list[tuple]]]] = defaultdict(dict)
    incoming: dict[str, int] = defaultdict(int)
    for s, p, predicate, o, kind, text in zip(*(pdf[c] for c in ("s", "p", "predicate", "o", "o_kind", "object")), strict=True):
        by[s].setdefault(p, (predicate, []))[1].append((o, kind, text))
        if kind == "bnode":
            incoming[o] += 1

    def label(x: str) -> str:
        return "_:b" + x[2:].encode().hex()

    def term(x: tuple, depth: int) -> str:
        o, kind, text = x
        if kind != "bnode":
            return text
        if incoming[o] > 1 or o not in by:
            return label(o)
        return held(o, depth)

    def held(o: str, depth: int) -> str:
        items, at = [], o
        while at in by and set(by[at]) == {RDF + "first", RDF + "rest"} and len(by[at][RDF + "first"][1]) == len(by[at][RDF + "rest"][1]) == 1:
            items.append(by[at][RDF + "first"][1][0])
            at = by[at][RDF + "rest"][1][0][0]
        if items and at == RDF + "nil":
            return "( " + " ".join(term(i, depth + 1) for i in items) + " )"
        return "[ " + body(o, depth + 1) + " ]"

    def body(s: str, depth: int) -> str:
        order = sorted(by[s], key=lambda p: (p != RDF + "type", p))
        return (" ;\n" + "    " * depth).join(by[s][p][0] + " " + ", ".join(sorted(term(o, depth) for o in by[s][p][1])) for p in order)

    rows = [(graph, doc, s, held(s, 1) if not incoming[s] else label(s), (f"[] {body(s, 1)}" if not incoming[s] else f"{label(s)} {body(s, 1)}") + " .\n") for s in by if incoming[s] != 1]
    return pd.DataFrame(rows, columns=["graph", "doc", "node", "held", "statement"])


def turtle_lines(triples: DataFrame, prefix: str, base: str | None = None) -> DataFrame:
    """(graph, doc, place, text): each graph of each document as Turtle, in the order of place; nothing holds a whole document.

    Prefixes that are used come first, then subjects by IRI, then blank nodes that no
    subject holds. Blank nodes are nested within one schema, by which they are grouped;
    one that several hold has a label.
    """
    c = F.col
    named = triples.withColumn("label", file_label(c("doc"))).withColumn("space", main_namespace(c("doc"), prefix, base))
    predicate = F.when(c("p") == RDF + "type", "a").otherwise(_short(c("p")))
    terms = named.withColumns({"predicate": predicate, "object": F.when(c("o_kind") != "bnode", _object(c("o"), c("o_kind"), c("o_dt")))})
    blank = terms.where("s_kind = 'bnode'")
    schema = F.substring_index(F.substring(c("s"), F.length("doc") + 5, F.length("s")), "/", 1)  # behind _:doc#/
    shape = "graph string, doc string, node string, held string, statement string"
    trees = blank.select("graph", "doc", "s", "p", "predicate", "o", "o_kind", "object", schema.alias("tree")).repartition("graph", "doc", "tree").sortWithinPartitions("graph", "doc", "tree").mapInPandas(_trees, shape)
    own = terms.where("s_kind = 'iri'").select("graph", "doc", "s", "p", "predicate", "o", "o_kind", "object", _short(c("s")).alias("subject"))
    held = own.where("o_kind = 'bnode'").join(trees.select("graph", "doc", c("node").alias("o"), "held"), ["graph", "doc", "o"], "left")
    label = F.concat(F.lit("_:b"), F.lower(F.hex(F.substring("o", 3, 1 << 20))))
    whole = own.where("o_kind <> 'bnode'").unionByName(held.withColumn("object", F.coalesce("held", label)).drop("held"))
    subjects = whole.groupBy("graph", "doc", "s").agg(F.any_value("subject").alias("subject"), F.collect_list(F.struct("p", "predicate", "object")).alias("pairs"))
    subjects = subjects.select("graph", "doc", F.struct(F.lit(1).alias("part"), c("s").alias("key")).alias("place"), F.concat(c("subject"), F.lit(" "), _body(c("pairs")), F.lit(" .\n")).alias("text"))
    loose = trees.join(held.select("graph", "doc", c("o").alias("node")).distinct(), ["graph", "doc", "node"], "left_anti")
    loose = loose.select("graph", "doc", F.struct(F.lit(2).alias("part"), c("node").alias("key")).alias("place"), c("statement").alias("text"))
    shorts = F.array_compact(F.array(F.when(c("s_kind") == "iri", _short(c("s"))), F.when(predicate != "a", predicate), F.when(c("o_kind") == "iri", _short(c("o"))), F.when(c("o_kind") == "literal", F.when(~c("object").rlike(r'^(true|false|[+-]?\d+)$'), _short(c("o_dt"))))))
    used = terms.select("graph", "doc", "label", "space", F.explode(shorts).alias("x")).where("x not like '<%'").select("graph", "doc", "label", "space", F.substring_index("x", ":", 1).alias("prefix")).distinct()
    uri = F.coalesce(F.when(c("prefix") == c("label"), c("space")), F.try_element_at(F.create_map(*(F.lit(x) for pair in STANDARD.items() for x in pair)), c("prefix")))
    head = used.select("graph", "doc", F.struct(F.lit(0).alias("part"), c("prefix").alias("key")).alias("place"), F.concat(F.lit("@prefix "), c("prefix"), F.lit(": <"), uri, F.lit("> .\n")).alias("text"))
    # An empty line before each statement.
    return head.unionByName(subjects.unionByName(loose).withColumn("text", F.concat(F.lit("\n"), "text")))


def turtle_documents(triples: DataFrame, prefix: str, base: str | None = None) -> DataFrame:
    """(graph, doc, content): each graph of each document as one text, for documents that are no longer than a row may be."""
    lines = turtle_lines(triples, prefix, base).groupBy("graph", "doc").agg(F.array_sort(F.collect_list(F.struct("place", "text"))).alias("lines"))
    return lines.select("graph", "doc", F.array_join(F.transform("lines", lambda x: x["text"]), "").alias("content"))


_TOKEN = re.compile(
    r'''(?:\s|#[^\n]*\n)*(@prefix|<[^>]*>|"""(?:[^"\\]|\\.|"(?!""))*"""|"(?:[^"\\\n]|\\.)*"|\^\^|@[a-zA-Z\-]+|[+-]?(?:\d+\.?\d*[eE][+-]?\d+|\d*\.\d+|\d+(?!\w))|'''
    r'''[\[\]();,.]|_:[A-Za-z0-9]+|[A-Za-z_]?[\w\-]*:(?:[\w\-.]*[\w\-])?|\w[\w\-]*)''',
    re.S,
)
_PREFIX = re.compile(r"@prefix ([^:]*): <([^>]*)>")
_ESCAPE = re.compile(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", re.S)


def parse_turtle(text: str, spaces: dict[str, str] | None = None) -> list[tuple]:
    """The triples of Turtle as `turtle` and other writers have it; blank nodes are numbered in order.

    Long strings, decimals, doubles and comments are read; base IRIs are not. spaces:
    prefixes known before, as statements of a longer text need them.
    """
    tokens, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if m is None:
            raise ValueError(f"no Turtle at {text[at:at + 40]!r}")
        tokens.append(m[1])
        at = m.end()
    spaces = dict(spaces or {})
    out: list[tuple] = []
    pos = count = 0
    undo = {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f"}

    def fresh() -> str:
        nonlocal count
        count += 1
        return f"_:n{count}"

    def expand(x: str) -> str:
        if x.startswith("<"):
            return x[1:-1]
        p, _, local = x.partition(":")
        return spaces[p] + local

    def term() -> tuple:
        nonlocal pos
        x = tokens[pos]
        pos += 1
        if x == "[":
            node = fresh()
            if tokens[pos] != "]":
                body(node, "bnode", "]")
            pos += 1
            return node, "bnode", None
        if x == "(":
            items = []
            while tokens[pos] != ")":
                items.append(term())
            pos += 1
            cells = [fresh() for _ in items]
            for i, item in enumerate(items):
                out.append((cells[i], "bnode", RDF + "first", *item))
                out.append((cells[i], "bnode", RDF + "rest", *((cells[i + 1], "bnode", None) if i + 1 < len(cells) else (RDF + "nil", "iri", None))))
            return (cells[0], "bnode", None) if cells else (RDF + "nil", "iri", None)
        if x.startswith('"'):
            inside = x[3:-3] if x.startswith('"""') else x[1:-1]
            value = _ESCAPE.sub(lambda m: chr(int(m[1][1:], 16)) if len(m[1]) > 1 else undo.get(m[1], m[1]), inside)
            if pos < len(tokens) and tokens[pos] == "^^":
                pos += 2
                return value, "literal", expand(tokens[pos - 1])
            if pos < len(tokens) and tokens[pos].startswith("@") and tokens[pos] != "@prefix":
                pos += 1  # language tags are dropped, the model has none
            return value, "literal", None
        if re.fullmatch(r"[+-]?\d+", x):
            return x, "literal", XSD + "integer"
        if re.fullmatch(r"[+-]?[\d.]+(?:[eE][+-]?\d+)?", x):
            return x, "literal", XSD + ("double" if "e" in x.lower() else "decimal")
        if x in ("true", "false"):
            return x, "literal", XSD + "boolean"
        return (x, "bnode", None) if x.startswith("_:") else (expand(x), "iri", None)

    def body(s: str, kind: str, stop: str) -> None:
        nonlocal pos
        while tokens[pos] != stop:
            p = RDF + "type" if tokens[pos] == "a" else expand(tokens[pos])
            pos += 1
            while True:
                out.append((s, kind, p, *term()))
                if tokens[pos] != ",":
                    break
                pos += 1
            if tokens[pos] == ";":
                pos += 1

    while pos < len(tokens):
        if tokens[pos] == "@prefix":
            spaces[tokens[pos + 1].rstrip(":")] = tokens[pos + 2][1:-1]
            pos += 4
            continue
        s = term()
        body(s[0], s[1], ".")
        pos += 1
    return out


def read_turtle_lines(lines: DataFrame) -> DataFrame:
    """(graph, doc, read): the number of triples that the lines of `turtle_lines` hold, read statement by statement with the prefixes of their document.

    No task holds a document: a statement is a subject with the blank nodes it holds. The prefixes of all documents, a few each, go beside them in a join.
    """
    c = F.col
    part = c("place.part")
    heads = lines.where(part == 0).groupBy("graph", "doc").agg(F.array_join(F.collect_list("text"), "").alias("head"))

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        spaces: dict[str, dict[str, str]] = {}
        for b in batches:
            rows = []
            for graph, doc, head, text in b.itertuples(index=False):
                if head not in spaces:
                    spaces[head] = dict(_PREFIX.findall(head))
                rows.append((graph, doc, len(parse_turtle(text, spaces[head]))))
            x = pd.DataFrame(rows, columns=["graph", "doc", "read"])
            yield x.groupby(["graph", "doc"], as_index=False)["read"].sum()

    said = lines.where(part > 0).join(heads, ["graph", "doc"], "left").select("graph", "doc", F.coalesce("head", F.lit("")).alias("head"), "text")
    read = said.mapInPandas(counted, "graph string, doc string, read long")
    return read.groupBy("graph", "doc").agg(F.sum("read").alias("read"))
