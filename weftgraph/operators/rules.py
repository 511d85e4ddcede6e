"""Rules from schema nodes to triples: one pass, every node exploding the triples it stands for.

A rule is a value (`Rule`) that declares its graph, its predicates and the kinds of nodes it
holds on; `apply_rules` takes the rules that can make what is wanted and reads only nodes of
their kinds. `shacl_rules` and `owl_rules` are the built-in ones; others may join them. A triple is (graph, doc, s, s_kind, p, o, o_kind, o_dt). Blank nodes are paths of schema
nodes behind "_:", the same in every run. A graph is a set: `graph_set` drops repeats.
"""

from __future__ import annotations

from collections.abc import Collection, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.naming import (
    DASH, OWL, PREFIX, RDF, RDFS, SH, XSD, file_label, format_name, human_label, is_object_ref, is_object_uri_owl, main_namespace, namespace, number_datatype,
    owl_datatype, owl_namespace, ref_datatype, resolve_ref, resolve_ref_owl, split_badly, string_datatype,
)

_STRUCTS = "array<struct<graph:string,s:string,s_kind:string,p:string,o:string,o_kind:string,o_dt:string>>"
TRIPLE = ("graph", "doc", "s", "s_kind", "p", "o", "o_kind", "o_dt")
# Texts of the notes and comments.
NOTE = "Note: This property is {} in OpenAPI - "
NOTES = {
    "read_only": NOTE.format("readOnly") + "consider access control in implementation",
    "write_only": NOTE.format("writeOnly") + "consider access control in implementation",
    "nullable": NOTE.format("nullable") + "null vs absent semantics not preserved in RDF",
    "discriminator": "Note: Uses OpenAPI discriminator - consider OWL union classes for full polymorphic semantics",
    "combinator": "Note: Uses OpenAPI {} - complex logical constraints partially supported in SHACL",
    "deprecated": "Note: This schema is deprecated in OpenAPI",
}
OPERATOR = {"anyOf": "or_", "oneOf": "xone", "allOf": "and_"}
CLASSES = ("object", "array", "string", "integer", "number", "anyOf", "oneOf", "allOf")


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x).cast("string")


def _t(graph: str, s: Column, s_kind: str, p: str, o, o_kind: str, dt=None) -> Column:
    return F.struct(F.lit(graph).alias("graph"), _c(s).alias("s"), F.lit(s_kind).alias("s_kind"), _c(p).alias("p"), _c(o).alias("o"), F.lit(o_kind).alias("o_kind"), _c(dt).alias("o_dt"))


@dataclass(frozen=True)
class Rule:
    """What schema nodes say in a graph.

    triples is a struct as `triple` makes it, or with many an array of them, null on nodes
    where the rule does not hold. All of them are of the graph and the predicates declared;
    nodes of other kinds than those declared (None: any) are not asked. It may use the columns of `flatten`
    and those `shacl_nodes` or `owl_nodes` add.
    """

    name: str
    graph: str
    predicates: tuple[str, ...]
    triples: Column
    kinds: tuple[str, ...] | None = None
    many: bool = False
    #: Whether triples is null on nodes of other kinds by itself, so that the kind need not be asked once more.
    checked: bool = False


def triple(graph: str, s: Column, p: str, o: Column | str, o_kind: str = "iri", o_dt: Column | str | None = None, s_kind: str = "iri") -> Column:
    """A triple for a rule of one's own; kinds are iri, bnode and literal."""
    return _t(graph, s, s_kind, p, o, o_kind, o_dt)


def plan_rules(rules: Sequence[Rule], predicates: Collection[str] | None = None, graphs: Collection[str] | None = None) -> tuple[list[Rule], set[str] | None]:
    """The rules that can make triples of these predicates and graphs (None: of any), and the kinds of nodes they need (None: all)."""
    names = [r.name for r in rules]
    if len(set(names)) < len(names):
        raise ValueError(f"rules of one name: {sorted(n for n in set(names) if names.count(n) > 1)}")
    wanted = [r for r in rules if (graphs is None or r.graph in graphs) and (predicates is None or not set(predicates).isdisjoint(r.predicates))]
    return wanted, None if any(r.kinds is None for r in wanted) else {k for r in wanted for k in r.kinds}


def apply_rules(nodes: DataFrame, rules: Sequence[Rule], predicates: Collection[str] | None = None, graphs: Collection[str] | None = None, along: Sequence[str] = ()) -> DataFrame:
    """The triples of these predicates and graphs that rules make of nodes, with repeats; no other rule is worked out, no node of other kinds exploded.

    Triples that a rule makes beside its declared graph and predicates are kept where all are wanted. along are columns of
    a node that its triples have, too.
    """
    chosen, kinds = plan_rules(rules, predicates, graphs)
    nodes = nodes if kinds is None else nodes.where(F.col("kind").isin(*sorted(kinds)))
    held = [(r.many, r.triples if r.checked or r.kinds is None or set(r.kinds) == kinds else F.when(F.col("kind").isin(*r.kinds), r.triples)) for r in chosen]
    out = _exploded(nodes, [t for many, t in held if not many], [t for many, t in held if many], along)
    out = out if predicates is None else out.where(F.col("p").isin(*predicates))
    return out if graphs is None else out.where(F.col("graph").isin(*graphs))


def _exploded(nodes: DataFrame, single: list[Column], many: list[Column], along: Sequence[str] = ()) -> DataFrame:
    none = F.array().cast(_STRUCTS)
    # Triples that do not hold are null and go behind the explode: a filter of the array would be interpreted, with all that is in it.
    every = F.concat(F.array(*single).cast(_STRUCTS) if single else none, *[F.coalesce(m, none) for m in many])
    # A column of its own in front of the explode is compiled; the explode's argument would be interpreted. An inner explode would bring a filter of the array along.
    return nodes.select("doc", *along, every.alias("every")).select("doc", *along, F.explode_outer("every").alias("t")).where("t is not null").select("t.graph", "doc", "t.s", "t.s_kind", "t.p", "t.o", "t.o_kind", "t.o_dt", *along)


def _cells(graph: str, base: Column, values: Column, item) -> Column:
    """first and rest of every cell of an RDF list; item gives (object, its kind, its datatype)."""
    cell = lambda i: F.concat(F.lit("_:"), base, F.lit("/cell"), i.cast("string"))
    last = F.size(values) - 1

    def both(x: Column, i: Column) -> Column:
        o, kind, dt = item(x)
        rest = F.when(i == last, F.lit(RDF + "nil")).otherwise(cell(i + 1))
        first = F.struct(F.lit(graph).alias("graph"), cell(i).alias("s"), F.lit("bnode").alias("s_kind"), F.lit(RDF + "first").alias("p"), o.alias("o"), kind.alias("o_kind"), dt.alias("o_dt"))
        after = F.struct(F.lit(graph).alias("graph"), cell(i).alias("s"), F.lit("bnode").alias("s_kind"), F.lit(RDF + "rest").alias("p"), rest.alias("o"), F.when(i == last, "iri").otherwise("bnode").alias("o_kind"), F.lit(None).cast("string").alias("o_dt"))
        return F.array(first, after)

    return F.flatten(F.transform(values, both))


def list_item(x: Column) -> tuple[Column, Column, Column]:
    """What an enumeration value becomes in a list: an IRI, a typed literal or a plain one."""
    lex, dt = x["lex"], x["dt"]
    text = dt.isin("string", "null")
    iri = text & (lex.startswith("http://") | lex.startswith("https://") | lex.startswith("urn:"))
    named = text & ~iri & (lex.startswith("xsd:") | lex.contains("XMLSchema"))
    known = F.when(lex.contains("string"), "string").when(lex.contains("integer"), "integer").when(lex.contains("double"), "double").when(lex.contains("boolean"), "boolean").when(lex.contains("float"), "float")
    xsd = F.when(known.isNotNull(), F.concat(F.lit(XSD), known)).otherwise(F.replace(lex, F.lit("xsd:"), F.lit(XSD)))
    return F.when(named, xsd).otherwise(lex), F.when(iri | named, "iri").otherwise("literal"), F.when(~text, F.concat(F.lit(XSD), dt))


def shacl_triples(
    nodes: DataFrame, prefix: str = PREFIX, compat: bool = True, base: str | None = None, predicates: Collection[str] | None = None, graphs: Collection[str] | None = None, more: Sequence[Rule] = (), along: Sequence[str] = (),
) -> DataFrame:
    """The vocabulary (graph rdf) and the shapes (graph shacl) of schema nodes, with repeats.

    With predicates or graphs, only the rules that make triples of these are worked out;
    more are rules beside the built-in ones; along are columns of a node that its triples have, too.

    compat keeps the predicate names or_ and booleans without a datatype; otherwise they
    are or, and booleans have theirs. base replaces the namespaces of the documents
    themselves; references to other files keep those made of the prefix.
    """
    return apply_rules(shacl_nodes(nodes, prefix, base), [*shacl_rules(prefix, compat), *more], predicates, graphs, along)


def shacl_nodes(nodes: DataFrame, prefix: str = PREFIX, base: str | None = None) -> DataFrame:
    """Nodes with what many rules need as columns of their own: _main, the document's namespace, _owner and _prop, the IRIs of
    the schema and of the name, _uri, _object and _word of the reference, and _datatype."""
    c = F.col
    nodes = nodes.withColumn("_main", main_namespace(c("doc"), prefix, base))
    main = c("_main")
    name = lambda x: F.concat(main, format_name(x))
    uri = lambda ref: F.get(F.transform(F.array(ref), lambda r: F.when(r.isNotNull(), resolve_ref(r, main, prefix))), F.lit(0))
    return nodes.withColumns({
        "_owner": name(c("schema")), "_prop": name(c("name")), "_uri": uri(c("ref")), "_object": is_object_ref(c("ref")), "_word": ref_datatype(c("ref")),
        "_datatype": F.when(c("kind") == "string", string_datatype(c("format"))).otherwise(number_datatype(c("kind"), c("format"))),
    })


def shacl_rules(prefix: str = PREFIX, compat: bool = True) -> list[Rule]:
    """The rules of vocabulary and shapes, over `shacl_nodes`."""
    c = F.col
    main, owner, prop, uri, datatype = c("_main"), c("_owner"), c("_prop"), c("_uri"), c("_datatype")
    on, shape = F.concat(F.lit("_:"), c("carrier")), F.concat(F.lit("_:"), c("shape"))
    kept = c("kept") & c("error").isNull()
    top = c("role") == "schema"
    is_class = kept & ((top & c("kind").isin(*CLASSES)) | (c("kind") == "object"))
    rdf = lambda name, cond, s, p, o, kind="iri", dt=None, on=None: Rule(name, "rdf", (p,), F.when(cond, _t("rdf", s, "iri", p, o, kind, dt)), on, checked=True)
    sh = lambda name, cond, s, p, o, kind="iri", dt=None, on=None: Rule(name, "shacl", (p,), F.when(cond, _t("shacl", s, "bnode", p, o, kind, dt)), on, checked=True)
    described = c("description").isNotNull()
    comment = RDFS + "comment"
    combined = c("kind").isin("anyOf", "oneOf", "allOf")
    spelled = F.when(c("kind") == "anyOf", "or_").when(c("kind") == "oneOf", "xone").otherwise("and_")
    scalar = c("kind").isin("string", "integer", "number")
    text = kept & (c("kind") == "string") & c("carrier").isNotNull()
    plain = text & (datatype == XSD + "string")
    number = kept & c("kind").isin("integer", "number") & c("carrier").isNotNull()
    item = c("role") == "items"
    ref_range = F.when(c("_object"), uri).otherwise(c("_word"))
    ranged = (
        F.when(c("kind") == "ref", ref_range).when(c("kind") == "boolean", F.lit(XSD + "boolean")).when(c("type") == "boolean", F.lit(XSD + "boolean"))
        .when(c("kind") == "object", F.lit(RDFS + "Resource")).when((c("kind") == "array") & c("item_ref").isNotNull(), resolve_ref(c("item_ref"), main, prefix))
        .when(scalar, datatype).otherwise(F.lit(XSD + "string"))
    )
    path = F.concat(F.lit("_:"), c("node_id"), F.lit("/path"))
    integer = XSD + "integer"
    vocabulary = kept & c("vocabulary")
    nil = RDF + "nil"
    unions, strings, numbers = ("anyOf", "oneOf", "allOf"), ("string",), ("integer", "number")
    singles = [
        rdf("class", is_class, owner, RDF + "type", RDFS + "Class", on=CLASSES),
        rdf("class description", is_class & described & ~combined, owner, comment, c("description"), "literal", on=CLASSES),
        rdf("union note", kept & top & combined, owner, comment, F.concat(F.lit("Note: Uses OpenAPI "), spelled, F.lit(" - complex logical constraints partially supported in SHACL")), "literal", on=unions),
        *(rdf(f"{flag} note", kept & (c("kind") == "object") & c(flag), owner, comment, NOTES[flag], "literal", on=("object",)) for flag in ("read_only", "write_only", "nullable", "discriminator", "deprecated")),
        *(rdf(f"{k} note", kept & (c("kind") == "object") & F.array_contains("combinators", k), owner, comment, NOTES["combinator"].format(k), "literal", on=("object",)) for k in ("allOf", "anyOf", "oneOf")),
        rdf("property", vocabulary, prop, RDF + "type", RDF + "Property"),
        rdf("domain", vocabulary, prop, RDFS + "domain", owner),
        rdf("range", vocabulary, prop, RDFS + "range", ranged),
        rdf("property description", vocabulary & described, prop, comment, c("description"), "literal"),
        sh("shape", kept & c("shape").isNotNull(), shape, RDF + "type", F.concat(F.lit(SH), c("own_kind"))),
        sh("target class", kept & c("target"), F.when(c("kind").isin("object", "nodeshape"), shape).otherwise(on), SH + "targetClass", owner),
        sh("property shape", kept & c("parent_shape").isNotNull(), F.concat(F.lit("_:"), c("parent_shape")), SH + "property", shape, "bnode"),
        sh("path", kept & c("path"), shape, SH + "path", prop),
        sh("required", kept & c("path") & c("required"), shape, SH + "minCount", "1", "literal", integer),
        sh("at most one", kept & c("max_one"), shape, SH + "maxCount", "1", "literal", integer),
        sh("fewest items", kept & item & c("min_items").isNotNull(), shape, SH + "minCount", c("min_items"), "literal", integer),
        sh("most items", kept & item & c("max_items").isNotNull(), shape, SH + "maxCount", c("max_items"), "literal", integer),
        sh("shape description", kept & c("describe") & described, F.coalesce(shape, on), comment, c("description"), "literal"),
        sh("reference to a class", kept & (c("kind") == "ref") & c("carrier").isNotNull() & c("_object"), on, SH + "class", uri, on=("ref",)),
        sh("reference to a datatype", kept & (c("kind") == "ref") & c("carrier").isNotNull() & ~c("_object"), on, SH + "datatype", c("_word"), on=("ref",)),
        sh("primitive branch", kept & (c("kind") == "datatype"), on, SH + "datatype", F.concat(F.lit(XSD), c("type")), on=("datatype",)),
        sh("list", kept & (c("kind") == "array") & c("carrier").isNotNull(), on, SH + "node", DASH + "ListShape", on=("array",)),
        sh("datatype", text | number, on, SH + "datatype", datatype, on=strings + numbers),
        sh("datatype description", (text | number) & described, on, comment, c("description"), "literal", on=strings + numbers),
        sh("pattern", plain & c("pattern").isNotNull(), on, SH + "pattern", c("pattern"), "literal", on=strings),
        sh("shortest", plain & c("min_length").isNotNull(), on, SH + "minLength", c("min_length"), "literal", integer, on=strings),
        sh("longest", plain & c("max_length").isNotNull(), on, SH + "maxLength", c("max_length"), "literal", integer, on=strings),
        sh("enumeration", text & (F.size("enum") > 0), on, SH + "in", F.concat(F.lit("_:"), c("node_id"), F.lit("/enum/cell0")), "bnode", on=strings),
        sh("empty enumeration", text & (F.size("enum") == 0), on, SH + "in", nil, on=strings),
        sh("least", number & c("minimum").isNotNull(), on, SH + "minInclusive", c("minimum"), "literal", F.concat(F.lit(XSD), c("minimum_dt")), on=numbers),
        sh("greatest", number & c("maximum").isNotNull(), on, SH + "maxInclusive", c("maximum"), "literal", F.concat(F.lit(XSD), c("maximum_dt")), on=numbers),
    ]
    defaults, default_on, boolean = kept & c("default_on").isNotNull(), F.concat(F.lit("_:"), c("default_on")), c("kind") == "boolean"
    if compat:
        singles.append(sh("default", defaults, default_on, SH + "nodeKind", SH + "IRI"))
    else:
        singles += [sh("default", defaults & ~boolean, default_on, SH + "nodeKind", SH + "IRI"), sh("boolean", defaults & boolean, default_on, SH + "datatype", XSD + "boolean", on=("boolean",))]
    listing = F.concat(F.lit(SH), c("list_predicate") if compat else F.rtrim(c("list_predicate"), F.lit("_")))
    union = F.when(c("list_on").isNotNull(), _t("shacl", F.concat(F.lit("_:"), c("list_on")), "bnode", listing, F.concat(F.lit("_:"), c("node_id"), F.lit("/cell0")), "bnode"))
    singles.append(Rule("union", "shacl", tuple(SH + (x if compat else x.rstrip("_")) for x in OPERATOR.values()), union))
    step = lambda part: F.concat(path, F.lit(part))
    listed = F.when(kept & c("list_path"), F.array(
        _t("shacl", shape, "bnode", SH + "path", path, "bnode"), _t("shacl", path, "bnode", RDF + "first", step("/many"), "bnode"), _t("shacl", step("/many"), "bnode", SH + "zeroOrMorePath", RDF + "rest", "iri"),
        _t("shacl", path, "bnode", RDF + "rest", step("/cell1"), "bnode"), _t("shacl", step("/cell1"), "bnode", RDF + "first", RDF + "first", "iri"), _t("shacl", step("/cell1"), "bnode", RDF + "rest", nil, "iri"),
    ))
    member = lambda x: (F.concat(F.lit("_:"), x), F.lit("bnode"), F.lit(None).cast("string"))
    enums = F.when(text, _cells("shacl", F.concat(c("node_id"), F.lit("/enum")), c("enum"), list_item))
    members = F.when(c("list_on").isNotNull(), _cells("shacl", c("node_id"), c("members"), member))
    cell = (RDF + "first", RDF + "rest")
    lists = [
        Rule("list path", "shacl", (SH + "path", SH + "zeroOrMorePath", *cell), listed, many=True),
        Rule("enumeration cells", "shacl", cell, enums, strings, many=True, checked=True),
        Rule("union cells", "shacl", cell, members, many=True),
    ]
    return singles + lists


def _owl_enum() -> Column:
    return (F.col("type") == "string") & F.col("enum").isNotNull()


def _owl_union() -> Column:
    """Whether a schema is a union for the ontology: oneOf, whatever stands beside it, unless it is an object or an enumeration."""
    return F.coalesce(F.array_contains("combinators", "oneOf"), F.lit(False)) & ~F.coalesce(F.col("type") == "object", F.lit(False)) & ~F.coalesce(_owl_enum(), F.lit(False))


def owl_triples(nodes: DataFrame, base: str = PREFIX, predicates: Collection[str] | None = None, more: Sequence[Rule] = ()) -> DataFrame:
    """The ontology (graph owl) of the schema nodes of `flatten` in mode owl, with repeats.

    With predicates, only the rules that make triples of these are worked out; more are
    rules beside the built-in ones. A property whose reference leads nowhere gives none;
    see reference_errors.
    """
    return apply_rules(owl_nodes(nodes, base), [*owl_rules(base), *more], predicates)


def owl_nodes(nodes: DataFrame, base: str = PREFIX) -> DataFrame:
    """Nodes with what many rules need as columns of their own: _main, the document's namespace, _me and _label of the name, _union,
    _lost, whether the property's reference leads nowhere, and _target, where it leads."""
    c = F.col
    nodes = nodes.withColumn("_main", owl_namespace(c("doc"), base))
    main = c("_main")
    uri = lambda x: F.concat(main, format_name(x))
    return nodes.withColumns({
        "_me": uri(c("name")), "_label": human_label(format_name(c("name"))), "_union": _owl_union(), "_lost": F.coalesce(_lost_owl(), F.lit(False)),
        "_target": F.when(c("kind") == "ref", resolve_ref_owl(c("ref"), main, base)).when((c("kind") == "array") & c("item_ref").isNotNull(), resolve_ref_owl(c("item_ref"), main, base)),
    })


def owl_rules(base: str = PREFIX) -> list[Rule]:
    """The rules of the ontology, over `owl_nodes`."""
    c = F.col
    main = c("_main")
    uri = lambda x: F.concat(main, format_name(x))
    o = lambda name, cond, s, p, x, kind="iri", dt=None, on=None: Rule(name, "owl", (p,), F.when(cond, _t("owl", s, "iri", p, x, kind, dt)), on, checked=True)
    good = c("error").isNull()
    top = (c("role") == "schema") & good
    own = (c("role") == "property") & c("owl_owner").isNotNull() & good & ~c("_lost")
    me, label, target = c("_me"), c("_label"), c("_target")
    enum, union = top & _owl_enum(), top & c("_union")
    inline = own & (c("kind") == "object")
    a_class = (top & (c("kind") == "object")) | inline
    any_class = a_class | enum | union
    ranged = F.coalesce(target, F.when(inline, me), F.when(c("kind") == "array", owl_datatype(c("item_type"))), F.when(c("type").isin("integer", "number", "boolean"), owl_datatype(c("type"))), F.lit(XSD + "string"))
    is_object = F.when(target.isNotNull(), is_object_uri_owl(target)).otherwise(inline)
    many = F.coalesce(c("type") == "array", F.lit(False))
    options = F.filter(F.transform("one_of", lambda x: resolve_ref_owl(x, main, base)), lambda x: x.isNotNull())
    kind = F.when(is_object, F.lit(OWL + "ObjectProperty")).otherwise(F.lit(OWL + "DatatypeProperty"))
    singles = [
        o("class", any_class, me, RDF + "type", OWL + "Class"),
        o("class label", any_class, me, RDFS + "label", label, "literal"),
        o("class description", a_class & c("description").isNotNull(), me, RDFS + "comment", c("description"), "literal", on=("object",)),
        o("enumeration comment", enum, me, RDFS + "comment", F.concat(F.lit("Enumeration of "), label, F.lit(" values.")), "literal"),
        o("union comment", union, me, RDFS + "comment", F.concat(F.lit("Represents a resource that can be one of several types related to "), label, F.lit(".")), "literal"),
        o("one of", enum | (union & (F.size(options) > 0)), me, OWL + "oneOf", F.concat(F.lit("_:"), c("node_id"), F.lit("/owl/cell0")), "bnode"),
        o("property", own, me, RDF + "type", kind),
        o("domain", own, me, RDFS + "domain", uri(c("owl_owner"))),
        o("range", own, me, RDFS + "range", ranged),
        o("property label", own, me, RDFS + "label", label, "literal"),
        o("property comment", own, me, RDFS + "comment", F.concat(F.lit("Property representing the "), label, F.lit(".")), "literal"),
        o("required", own & c("required"), me, OWL + "minCardinality", "1", "literal", XSD + "integer"),
        o("functional", own & c("required") & ~many & ~is_object, me, RDF + "type", OWL + "FunctionalProperty"),
        o("at most one", own & c("required") & ~many & is_object, me, OWL + "maxCardinality", "1", "literal", XSD + "integer"),
    ]
    # Values go by what YAML 1.1 makes of them: True, False, None.
    said = lambda x: F.when(x["dt"] == "boolean", F.initcap(x["lex"])).when(x["dt"] == "null", "None").otherwise(x["lex"])
    value = lambda x: F.concat(main, format_name(said(x)))

    def individual(x: Column) -> Column:
        return F.array(
            _t("owl", value(x), "iri", RDF + "type", OWL + "NamedIndividual", "iri"), _t("owl", value(x), "iri", RDFS + "label", said(x), "literal"),
            _t("owl", value(x), "iri", RDFS + "comment", F.concat(F.lit("Indicates that the "), label, F.lit(" value is "), said(x), F.lit(".")), "literal"),
        )

    cell = F.concat(c("node_id"), F.lit("/owl"))
    iri = lambda x: (x, F.lit("iri"), F.lit(None).cast("string"))
    return singles + [
        Rule("individuals", "owl", (RDF + "type", RDFS + "label", RDFS + "comment"), F.when(enum, F.flatten(F.transform("enum", individual))), many=True),
        Rule("enumeration cells", "owl", (RDF + "first", RDF + "rest"), F.when(enum, _cells("owl", cell, c("enum"), lambda x: iri(value(x)))), many=True),
        Rule("union cells", "owl", (RDF + "first", RDF + "rest"), F.when(union, _cells("owl", cell, options, iri)), many=True),
    ]


def _lost_owl() -> Column:
    """Whether a property needs a reference that the ontology cannot resolve."""
    ref = F.when(F.col("kind") == "ref", F.col("ref")).when(F.col("kind") == "array", F.col("item_ref"))
    return resolve_ref_owl(ref, F.lit(""), "").isNull() & ref.isNotNull()


def reference_errors(nodes: DataFrame, mode: str = "shacl") -> DataFrame:
    """(doc, error): references that fail their documents.

    Shapes fail on a reference into a file (.yaml#) that does not name one of its schemas;
    the ontology on that in a property, the items of one or a oneOf of a schema, and in
    the former two on any reference that is neither to a schema here nor to one of a file.
    """
    c = F.col
    if mode == "owl":
        own = (c("role") == "property") & c("owl_owner").isNotNull() & _lost_owl()
        ref = F.when(own, F.coalesce(F.when(c("kind") == "ref", c("ref")), c("item_ref")))
        option = F.get(F.filter("one_of", split_badly), F.lit(0))
        ref = F.coalesce(ref, F.when((c("role") == "schema") & _owl_union(), option))
    else:
        ref = F.when((c("kind") == "ref") & c("carrier").isNotNull() & split_badly(c("ref")), c("ref"))
    return nodes.select("doc", F.concat(F.lit("ValueError: cannot resolve the reference "), ref).alias("error")).where("error is not null")


def owl_header(headers: DataFrame, base: str = PREFIX) -> DataFrame:
    """headers(doc, title, version, description, url) to the triples that describe each document."""
    main = owl_namespace(F.col("doc"), base)
    title = F.coalesce("title", F.lit("Unknown"))
    cls = F.concat(main, format_name(F.replace(title, F.lit(" "), F.lit(""))))
    one = F.concat(cls, F.lit("Instance"))
    t = lambda s, p, x, kind="iri": _t("owl", s, "iri", p, x, kind)

    def attribute(name: str, kind: str, label: str, comment: str, value: Column) -> list[Column]:
        me = F.concat(main, F.lit(name))
        return [t(me, RDF + "type", OWL + kind), t(me, RDFS + "domain", cls), t(me, RDFS + "range", XSD + "string"), t(me, RDFS + "label", label, "literal"), t(me, RDFS + "comment", comment, "literal"), t(one, me, value, "literal")]

    url = [F.when(F.col("url").isNotNull(), x) for x in attribute("url", "DatatypeProperty", "URL", "The URL for external documentation related to the document.", F.col("url"))]
    rows = [
        t(cls, RDF + "type", OWL + "Class"), t(cls, RDFS + "label", title, "literal"), t(cls, RDFS + "comment", F.concat(F.lit("Class representing the "), title, F.lit(" document metadata.")), "literal"),
        *attribute("version", "FunctionalProperty", "Version", "The version of the document.", F.coalesce("version", F.lit("Unknown"))),
        *attribute("description", "DatatypeProperty", "Description", "A description of the document.", F.coalesce("description", F.lit(""))), *url, t(one, RDF + "type", cls),
    ]
    return _exploded(headers, rows, [])


def graph_set(triples: DataFrame) -> DataFrame:
    """A graph holds a triple once."""
    return triples.dropDuplicates(["graph", "doc", "s", "p", "o", "o_kind", "o_dt"])


def prefixes(nodes: DataFrame, prefix: str = PREFIX, external: Sequence[str] = (), mode: str = "shacl") -> DataFrame:
    """(doc, prefix, uri): the standard ones, the document's own, those of files it refers to and of the external files given."""
    standard = {"rdf": RDF, "rdfs": RDFS, "xsd": XSD} | ({"owl": OWL} if mode == "owl" else {"sh": SH, "dash": DASH})
    fixed = F.array(*(F.struct(F.lit(k).alias("prefix"), F.lit(v).alias("uri")) for k, v in standard.items()))
    own = F.array(F.struct(file_label(F.col("doc")).alias("prefix"), main_namespace(F.col("doc"), prefix).alias("uri")))
    stems = [F.lit(x.rsplit("/", 1)[-1].removesuffix(".yaml")) for x in external]
    more = [F.struct(format_name(F.concat(x, F.lit(".yaml"))).alias("prefix"), namespace(x, prefix).alias("uri")) for x in stems]
    file = lambda ref: F.when(F.col(ref).contains(".yaml#"), F.regexp_replace(F.substring_index(ref, "#", 1), r"\.yaml$", ""))
    # Nodes are read once, and documents and their files worked out where each pair is left once.
    pairs = nodes.select("doc", F.explode(F.array(file("ref"), file("item_ref"))).alias("file")).distinct()
    stem = F.col("file")
    outside = F.when(stem.isNotNull(), F.array(F.struct(format_name(F.concat(stem, F.lit(".yaml"))).alias("prefix"), namespace(stem, prefix).alias("uri")))).otherwise(F.array())
    every = F.concat(fixed, own, *([F.array(*more)] if more else []), outside)
    return pairs.select("doc", F.explode(every).alias("x")).select("doc", "x.prefix", "x.uri").distinct()
