"""Names, namespaces and references as Column expressions; nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
XSD = "http://www.w3.org/2001/XMLSchema#"
OWL = "http://www.w3.org/2002/07/owl#"
SH = "http://www.w3.org/ns/shacl#"
DASH = "http://datashapes.org/dash#"
#: Default namespace prefix of generated documents; a parameter everywhere.
PREFIX = "http://example.org/models/"
SCHEMAS = "#/components/schemas/"
_EXTENSION = r"^((?:.*/)?[^/]*[^./][^/]*)\.[^./]*$"


def format_name(name: Column) -> Column:
    """The name up to its last dot (a leading dot stays), dashes as underscores."""
    return F.translate(F.regexp_replace(name, _EXTENSION, "$1"), "-", "_")


def human_label(name: Column) -> Column:
    return F.translate(name, "_", " ")


def namespace(stem: Column, prefix: str = PREFIX) -> Column:
    """TS<digits>_<rest> has a folder of its own, any other stem goes under rdf/."""
    number, rest = F.regexp_extract(stem, r"^(TS\d*)_(.*)", 1), F.regexp_extract(stem, r"^(TS\d*)_(.*)", 2)
    return F.when(stem.rlike(r"^TS\d*_"), F.concat(F.lit(prefix), number, F.lit("/"), rest, F.lit("#"))).otherwise(F.concat(F.lit(prefix + "rdf/"), stem, F.lit("#")))


def file_stem(doc: Column) -> Column:
    """The name of a document without its folders."""
    return F.regexp_replace(doc, "^.*/", "")


def main_namespace(doc: Column, prefix: str = PREFIX, base: str | None = None) -> Column:
    """A document's own namespace: the given base for all documents, or else that of its name."""
    return namespace(file_stem(doc), prefix) if base is None else F.lit(base)


def file_label(doc: Column) -> Column:
    """The prefix of a document's namespace."""
    return format_name(F.concat(file_stem(doc), F.lit(".yaml")))


def owl_namespace(doc: Column, base: str = PREFIX) -> Column:
    return F.concat(F.lit(base.rstrip("/") + "/"), file_label(doc), F.lit("#"))


def owl_external_namespace(stem: Column, base: str = PREFIX) -> Column:
    return F.concat(F.lit(base.rstrip("/") + "/"), stem, F.lit("#"))


def _last(ref: Column) -> Column:
    return F.element_at(F.split(ref, "/"), -1)


def _file(ref: Column) -> Column:
    return F.regexp_replace(F.substring_index(ref, "#", 1), r"\.yaml$", "")


def split_badly(ref: Column) -> Column:
    """Whether a reference into a file does not name exactly one of its schemas."""
    return ~ref.startswith(SCHEMAS) & ref.contains(".yaml#") & (F.size(F.split(ref, SCHEMAS)) != 2)


def resolve_ref(ref: Column, main: Column, prefix: str = PREFIX) -> Column:
    """URI of a reference; one that leads nowhere gets a name of its own in the main namespace.

    Null, an error of the document, for a reference into a file that names no schema.
    """
    external = F.concat(namespace(_file(ref), prefix), format_name(F.element_at(F.split(ref, SCHEMAS), -1)))
    lost = F.concat(main, F.lit("UnresolvedRef_"), format_name(F.translate(ref, "/#", "__")))
    return (
        F.when(ref.startswith(SCHEMAS), F.concat(main, format_name(_last(ref))))
        .when(split_badly(ref), F.lit(None))
        .when(ref.contains(".yaml#"), external)
        .otherwise(lost)
    )


def resolve_ref_owl(ref: Column, main: Column, base: str = PREFIX) -> Column:
    """URI of a reference in the ontology mode; null if it leads nowhere, which fails the document."""
    external = F.concat(owl_external_namespace(_file(ref), base), format_name(F.element_at(F.split(ref, SCHEMAS), -1)))
    return F.when(ref.startswith(SCHEMAS), F.concat(main, format_name(_last(ref)))).when(ref.contains(".yaml#") & ~split_badly(ref), external)


def is_object_ref(ref: Column) -> Column:
    """A reference is to an object unless its last segment names a primitive somewhere."""
    return ~F.lower(_last(ref)).rlike("float|int|string|bool")


def is_object_uri_owl(uri: Column) -> Column:
    return ~F.lower(_last(uri)).rlike("float|int|string")


def ref_datatype(ref: Column) -> Column:
    low = F.lower(_last(ref))
    return F.concat(F.lit(XSD), F.when(low.contains("float"), "float").when(low.contains("int"), "integer").when(low.contains("bool"), "boolean").otherwise("string"))


def string_datatype(fmt: Column) -> Column:
    name = F.when(fmt == "date-time", "dateTime").when(fmt == "full-time", "time").when(fmt == "date-month", "gMonth").when(fmt == "date-mday", "gMonthDay").otherwise("string")
    return F.concat(F.lit(XSD), name)


def number_datatype(kind: Column, fmt: Column) -> Column:
    return F.concat(F.lit(XSD), F.when(kind == "integer", "integer").when(fmt == "float", "float").otherwise("double"))


def owl_datatype(kind: Column) -> Column:
    name = F.when(kind == "integer", "integer").when(kind == "number", "double").when(kind == "boolean", "boolean").otherwise("string")
    return F.concat(F.lit(XSD), name)
