"""Shapes as checks of tables: an extension, since converters of schemas write shapes and leave it to others to evaluate them.

A class is a table, an instance a row, a property the column of that name (or a field of
a struct). The shapes of the classes asked for become columns of truth values, all of
them in one pass over a table; references to classes are left joins with the distinct
keys of their tables.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from functools import reduce
from operator import and_, or_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.naming import RDF, SH, XSD

#: Triples of shapes that may be compiled at a time: they become expressions of a plan, which is the driver's.
MOST = 100_000
_NUMERIC = {XSD + x for x in ("integer", "double", "float", "decimal")}


class Table(NamedTuple):
    """The instances of a class; key is the column that references give, and by which rows are named."""

    rows: DataFrame
    key: str


class _Check(NamedTuple):
    path: str
    check: str
    holds: Column
    value: Column


def _local(iri: str) -> str:
    return iri.rsplit("#", 1)[-1].rsplit("/", 1)[-1]


def _all(xs: list[Column]) -> Column:
    return reduce(and_, (F.coalesce(x, F.lit(False)) for x in xs), F.lit(True))


def _of_datatype(v: Column, t: T.DataType, datatype: str) -> Column:
    """Whether a value is one of an XSD datatype: by the type of its column, texts by how they are spelled."""
    name, text = _local(datatype), isinstance(t, T.StringType)
    if name == "integer":
        return F.lit(True) if isinstance(t, T.IntegralType) else v.rlike(r"^[+-]?[0-9]+$") if text else v == F.floor(v) if isinstance(t, T.NumericType) else F.lit(False)
    if name in ("double", "float", "decimal"):
        return F.lit(True) if isinstance(t, T.NumericType) else v.try_cast("double").isNotNull() if text else F.lit(False)
    if name == "boolean":
        return F.lit(True) if isinstance(t, T.BooleanType) else v.isin("true", "false", "1", "0") if text else F.lit(False)
    if name == "dateTime":
        return F.lit(True) if isinstance(t, (T.TimestampType, T.TimestampNTZType)) else v.contains("T") & v.try_cast("timestamp").isNotNull() if text else F.lit(False)
    if name == "date":
        return F.lit(True) if isinstance(t, T.DateType) else v.rlike(r"^\d{4}-\d\d-\d\d") & v.try_cast("date").isNotNull() if text else F.lit(False)
    return F.lit(text)


def _among(v: Column, t: T.DataType, terms: list[tuple[str, str, str | None]]) -> Column:
    """Whether a value is one of a list: numbers by what they are, all else by spelling."""
    if isinstance(t, T.NumericType):
        return v.cast("double").isin(*(float(x) for x, _, dt in terms if dt in _NUMERIC))
    dt = XSD + "boolean" if isinstance(t, T.BooleanType) else None
    return v.cast("string").isin(*(x for x, _, d in terms if d == dt or (dt is None and d == XSD + "string")))


class _Compiler:
    def __init__(self, triples: list, tables: dict[str, Table], rows: DataFrame) -> None:
        self.tables, self.schema = tables, rows.schema
        self.of: dict[str, dict[str, list]] = defaultdict(lambda: defaultdict(list))
        for r in sorted(triples):
            self.of[r.s][r.p].append((r.o, r.o_kind, r.o_dt))
        self.links: dict[tuple[str, str], str] = {}  # (column, class) to the column that says whether the key is there

    def listed(self, cell: str) -> list:
        out = []
        while cell != RDF + "nil":
            out += self.of[cell][RDF + "first"]
            cell = self.of[cell][RDF + "rest"][0][0]
        return out

    def link(self, v: Column | None, at: str, iri: str) -> Column:
        if iri not in self.tables:
            raise ValueError(f"no table is given for {iri}")
        if v is None or "/" in at or "[" in at:
            raise ValueError(f"references are checked in columns alone, not in {at or 'rows'}")
        return F.col(self.links.setdefault((at, iri), self.fresh(f"_link{len(self.links)}")))

    def fresh(self, name: str) -> str:
        """A name that no column of the table has."""
        while name.lower() in {n.lower() for n in self.schema.names}:
            name = "_" + name
        return name

    def checks(self, shape: str, v: Column | None, t: T.DataType, at: str) -> list[_Check]:
        """Of a value that is there, or of the row itself (v null)."""
        out: list[_Check] = []
        text = F.lit(None).cast("string") if v is None else F.to_json(v) if isinstance(t, (T.StructType, T.ArrayType, T.MapType)) else v.cast("string")
        literal: Callable[[Column], Column] = lambda ok: F.lit(False) if v is None else ok
        number = lambda x: literal(v.try_cast("double") if isinstance(t, T.StringType) else v.cast("double")) if isinstance(t, (T.NumericType, T.StringType)) else F.lit(None).cast("double")
        add = lambda check, ok: out.append(_Check(at, check, ok, text))
        for p, objects in self.of[shape].items():
            for o, kind, dt in objects:
                name = _local(p).rstrip("_")
                if p == SH + "property":
                    out += self.property(o, v, t, at)
                elif not p.startswith(SH):
                    continue
                elif name == "datatype":
                    add(name, literal(_of_datatype(v, t, o)) if v is not None else F.lit(False))
                elif name in ("minLength", "maxLength"):
                    add(name, literal(F.char_length(text) >= int(o) if name == "minLength" else F.char_length(text) <= int(o)))
                elif name == "pattern":
                    add(name, literal(text.rlike(o)))
                elif name == "minInclusive":
                    add(name, number(v) >= float(o) if v is not None else F.lit(False))
                elif name == "maxInclusive":
                    add(name, number(v) <= float(o) if v is not None else F.lit(False))
                elif name == "in":
                    add(name, _among(v, t, self.listed(o)) if v is not None else F.lit(False))
                elif name == "class":
                    add(name, self.link(v, at, o))
                elif name == "node":
                    add(name, F.lit(isinstance(t, T.ArrayType)))
                elif name == "nodeKind":
                    add(name, text.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") if isinstance(t, T.StringType) else F.lit(v is None))
                elif name in ("or", "xone", "and"):
                    each = [_all([c.holds for c in self.checks(m, v, t, at)]) for m, _, _ in self.listed(o)]
                    true = reduce(lambda a, b: a + b, (x.cast("int") for x in each), F.lit(0))
                    add(name, reduce(or_, each, F.lit(False)) if name == "or" else _all(each) if name == "and" else true == 1)
        return out

    def property(self, shape: str, v: Column | None, t: T.DataType, at: str) -> list[_Check]:
        path, kind, _ = self.of[shape][SH + "path"][0]
        least, most = ([int(o) for o, _, _ in self.of[shape][SH + p]] for p in ("minCount", "maxCount"))
        if kind == "bnode":  # the path from a list to its items
            if not isinstance(t, T.ArrayType):
                return []
            inner = lambda x: _all([c.holds for c in self.checks(shape, x, t.elementType, at + "[]")])
            text = F.to_json(v)
            counts = [_Check(at + "[]", n, ok, F.size(v).cast("string")) for n, ok in (*(("minCount", F.size(v) >= k) for k in least), *(("maxCount", F.size(v) <= k) for k in most))]
            return [*counts, _Check(at + "[]", "items", F.forall(v, lambda x: x.isNotNull() & inner(x)), text)]
        name = _local(path)
        fields = self.schema if v is None else t if isinstance(t, T.StructType) else T.StructType([])
        found = next((f for f in fields.fields if f.name == name), None)
        x = F.lit(None).cast("string") if found is None else (F.col(f"`{name}`") if v is None else v.getField(name))
        here = f"{at}/{name}" if at else name
        # A value that is null is none; checks of values hold where there is none.
        one = x.isNotNull().cast("int")
        counts = [_Check(here, "minCount", one >= k, F.lit(None).cast("string")) for k in least] + [_Check(here, "maxCount", one <= k, F.lit(None).cast("string")) for k in most]
        of_value = [] if found is None else self.checks(shape, x, found.dataType, here)
        return counts + [c._replace(holds=x.isNull() | F.coalesce(c.holds, F.lit(False))) for c in of_value]


def violations(shapes: DataFrame, tables: dict[str, Table], known: dict[str, Column] | None = None) -> DataFrame:
    """(class, focus, path, check, value) for every check that a row of a table fails.

    shapes: triples of documents as the conversion gives them; those of the documents that
    have a target among the classes of tables are compiled, at most MOST. A class without
    a shape has no checks. A null value is none: it fails minCount and nothing else, as a
    column that is not there does. A row fails each check at most once for each shape;
    equal rows fail by themselves. Lists are columns of arrays: their items are checked
    together (check items), the bounds of their length apart (path with []). Numbers are
    compared as doubles. A reference to a class without a table, and one inside a struct
    or list, is a ValueError. known: for a class, which of its rows references may lead
    to, if not all.
    """
    classes = list(tables)
    targets = shapes.where((F.col("p") == SH + "targetClass") & F.col("o").isin(*classes))
    used = shapes.where("graph = 'shacl'").join(targets.select("doc").distinct(), "doc", "left_semi")
    triples = used.select("s", "p", "o", "o_kind", "o_dt").distinct().limit(MOST + 1).collect()
    if len(triples) > MOST:
        raise ValueError(f"the shapes have more than {MOST} triples: take the documents that matter")
    out = []
    for iri, (rows, key) in tables.items():
        compiler = _Compiler(triples, tables, rows)
        nodes = sorted({r.s for r in triples if r.p == SH + "targetClass" and r.o == iri})
        checks = [c for n in nodes for c in compiler.checks(n, None, rows.schema, "")]
        row = lambda c: F.struct(F.lit(c.path).alias("path"), F.lit(c.check).alias("check"), c.value.alias("value"))
        failed = [F.when(~F.coalesce(c.holds, F.lit(False)), row(c)) for c in checks]
        if not failed:
            failed = [F.lit(None).cast("struct<path:string,check:string,value:string>")]
        for (column, of), flag in compiler.links.items():
            there = tables[of].rows.where(known[of]) if known and of in known else tables[of].rows
            own = compiler.fresh("_key")
            keys = there.select(F.col(f"`{tables[of].key}`").alias(own)).where(F.col(own).isNotNull()).distinct().withColumn(flag, F.lit(True))
            rows = rows.join(keys, F.col(f"`{column}`") == F.col(own), "left").drop(own)
        found = rows.select(F.lit(iri).alias("class"), F.col(f"`{key}`").cast("string").alias("focus"), F.explode(F.array(*failed)).alias("x")).where("x is not null")
        out.append(found.select("class", "focus", "x.path", "x.check", "x.value"))
    return reduce(DataFrame.unionByName, out)
