"""Schema trees to rows: every visited node becomes a row, every rule a projection of rows.

A recursive query over VARIANT goes down a level at a time, or, where the number of levels
is known, a chain of explodes that leaves every schema in its partition; what a node needs from above
it gets on the way: the shape its constraints go to (its line: the carrier, and where that
goes if its union leaves it alone), whether it is the first to speak on its carrier, its
owner. What comes from below, which branches of unions stay, is a window over one
schema's rows. Nothing here leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_STRING, _BOOL = T.StringType(), T.BooleanType()
_TERM = T.ArrayType(T.StructType([T.StructField("lex", _STRING), T.StructField("dt", _STRING)]))
NODE = T.StructType([
    *(T.StructField(n, _STRING) for n in ("doc", "schema")), T.StructField("ordinal", T.IntegerType()),
    *(T.StructField(n, _STRING) for n in ("node_id", "parent_id", "role", "name", "kind", "type", "ref", "format", "description", "pattern", "min_length", "max_length")),
    *(T.StructField(n, _STRING) for n in ("minimum", "minimum_dt", "maximum", "maximum_dt", "min_items", "max_items", "item_type", "item_ref", "carrier", "shape", "parent_shape", "default_on", "list_on", "list_predicate", "own_kind", "owl_owner")),
    *(T.StructField(n, _BOOL) for n in ("required", "has_items", "target", "path", "list_path", "max_one", "vocabulary", "describe", "kept", "read_only", "write_only", "nullable", "deprecated", "discriminator")),
    T.StructField("enum", _TERM), T.StructField("members", T.ArrayType(_STRING)), T.StructField("combinators", T.ArrayType(_STRING)), T.StructField("one_of", T.ArrayType(_STRING)), T.StructField("error", _STRING),
])
#: Levels that a schema may have.
LEVELS = 2000


def _at(v: str, key: str) -> str:
    return f"variant_get({v}, '$[\"{key}\"]')"


def _has(v: str, key: str) -> str:
    return f"{_at(v, key)} IS NOT NULL"


def _text(v: str, key: str) -> str:
    return f"try_variant_get({v}, '$[\"{key}\"]', 'string')"


def _list(v: str) -> str:
    return f"coalesce(try_cast({v} AS ARRAY<VARIANT>), CAST(array() AS ARRAY<VARIANT>))"


def _properties(v: str) -> str:
    return f"map_entries(try_cast({_at(v, 'properties')} AS MAP<STRING, VARIANT>))"


def _kind(v: str) -> str:
    """The first rule that applies: a reference hides everything, a type hides combinators."""
    return f"""CASE WHEN {_has(v, '$ref')} THEN 'ref' WHEN {_text(v, 'type')} IN ('object', 'array', 'string', 'integer', 'number') THEN {_text(v, 'type')}
      WHEN {_has(v, 'anyOf')} THEN 'anyOf' WHEN {_has(v, 'oneOf')} THEN 'oneOf' WHEN {_has(v, 'allOf')} THEN 'allOf' WHEN {_text(v, 'type')} = 'boolean' THEN 'boolean' ELSE 'untyped' END"""


def _shaped(v: str) -> str:
    """Whether a branch of a union is an object with properties, which has a shape of its own and no vocabulary."""
    return f"({_kind(v)} = 'object' AND coalesce(size({_properties(v)}), 0) > 0)"


def _plain(b: str) -> str:
    """Whether a branch is a primitive, or a reference to what its name says is one."""
    return f"CASE WHEN {_has(b, '$ref')} THEN lower(element_at(split({_text(b, '$ref')}, '/'), -1)) RLIKE 'float|int|string|bool' ELSE coalesce({_text(b, 'type')} IN ('string', 'integer', 'number', 'boolean'), false) END"


def _branches(t: str) -> str:
    """The branches of a union, none for any other node."""
    return f"CASE {t}.kind WHEN 'anyOf' THEN {_list(_at(t + '.v', 'anyOf'))} WHEN 'oneOf' THEN {_list(_at(t + '.v', 'oneOf'))} WHEN 'allOf' THEN {_list(_at(t + '.v', 'allOf'))} ELSE CAST(array() AS ARRAY<VARIANT>) END"


def _mixed(t: str) -> str:
    """Whether a union has primitives and classes side by side."""
    return f"(exists({t}.plain, x -> x) AND NOT forall({t}.plain, x -> x))"


_NONE = "CAST(array() AS ARRAY<STRING>)"


def _child(**fields: str) -> str:
    every = {"name": "CAST(NULL AS STRING)", "pline": _NONE, "shapes_only": "false", "required": "false", "lead": "true", "chain": _NONE, "owl_owner": "CAST(NULL AS STRING)", "least": "CAST(NULL AS STRING)", "most": "CAST(NULL AS STRING)"} | fields
    order = ("id", "role", "name", "v", "line", "pline", "shapes_only", "required", "lead", "chain", "owl_owner", "least", "most")
    return "named_struct(" + ", ".join(f"'{k}', {every[k]}" for k in order) + ")"


_CHILDREN = f"""CASE
  WHEN t.kind IN ('object', 'shape') THEN transform({_properties('t.v')}, e -> {_child(
    id="concat(t.node_id, '/properties/', e.key)", role="'property'", name="e.key", v="e.value", line="array(concat(t.node_id, '/properties/', e.key))",
    pline="CASE WHEN t.kind = 'shape' THEN t.line ELSE array(concat(t.node_id, '/shape')) END", shapes_only="t.kind = 'shape'",
    required=f"coalesce(array_contains(try_cast({_at('t.v', 'required')} AS ARRAY<STRING>), e.key), false)",
    owl_owner="CASE WHEN t.kind = 'object' AND (t.role = 'schema' OR t.owl_owner IS NOT NULL) THEN t.name END")})
  WHEN t.kind = 'array' AND {_has('t.v', 'items')} THEN array({_child(id="concat(t.node_id, '/items')", role="'items'", v=_at('t.v', 'items'), line="array(concat(t.node_id, '/items'))", pline="t.line", least=_text('t.v', 'minItems'), most=_text('t.v', 'maxItems'))})
  WHEN t.mixed THEN filter(transform(t.branches, (b, i) -> CASE WHEN NOT t.plain[i] AND {_at('b', '$ref')} IS NULL THEN {_child(
    id="concat(t.node_id, '/other/', i)", role="'other'", v="b", line="array(concat(t.node_id, '/other/', i))")} END), x -> x IS NOT NULL)
  WHEN t.kind = 'allOf' THEN transform(t.branches, (b, i) -> {_child(id="concat(t.node_id, '/allOf/', i)", role="'allOf'", v="b", line="t.line", lead="t.lead AND i = 0")})
  WHEN t.kind IN ('anyOf', 'oneOf') THEN transform(t.branches, (b, i) -> {_child(
    id="concat(t.node_id, '/', t.kind, '/', i)", role="t.kind", v="b", line="concat(array(concat(t.node_id, '/', t.kind, '/', i)), t.line)",
    chain=f"concat(array(concat(t.node_id, '/', t.kind, '/', i)), CASE WHEN t.role IN ('anyOf', 'oneOf') THEN t.chain ELSE {_NONE} END)")})
  END"""
#: The same where rows of the chain name their nodes.
_CHAINED = _CHILDREN.replace("t.node_id", "t.id")

#: What a row of the chain carries: what a child gets, and what is worked out for a row once.
_CARRIED = ("id", "parent_id", "role", "name", "v", "line", "pline", "shapes_only", "required", "lead", "chain", "owl_owner", "least", "most", "kind", "branches", "plain", "mixed", "depth")
_EMPTY = {"kind": "CAST(NULL AS STRING)", "branches": "CAST(NULL AS ARRAY<VARIANT>)", "plain": "CAST(NULL AS ARRAY<BOOLEAN>)", "mixed": "CAST(NULL AS BOOLEAN)"}


def _top(mode: str) -> str:
    """The kind of a schema; for the ontology, a type is all that counts."""
    return _kind("v") if mode == "shacl" else f"CASE WHEN {_text('v', 'type')} = 'object' THEN 'object' ELSE {_kind('v')} END"


def _roots(mode: str) -> str:
    """The schemas themselves, as rows of level 0."""
    top = _top(mode)
    return f"""SELECT s.*, {_mixed('s')} AS mixed, 0 AS depth FROM (
    SELECT r.*, transform(r.branches, b -> {_plain('b')}) AS plain FROM (
      SELECT q.*, {_branches('q')} AS branches FROM (
        SELECT doc, schema, CAST(ordinal AS INT) AS ordinal, concat(doc, '#/', schema) AS id, CAST(NULL AS STRING) AS parent_id, 'schema' AS role, schema AS name, v,
          CASE WHEN {top} IN ('array', 'anyOf', 'oneOf', 'allOf') THEN array(concat(doc, '#/', schema)) ELSE {_NONE} END AS line, {_NONE} AS pline, false AS shapes_only, false AS required, true AS lead,
          {_NONE} AS chain, schema AS owl_owner, {_text('v', 'minItems')} AS least, {_text('v', 'maxItems')} AS most, {top} AS kind FROM {{parsed}}) q) r) s"""


def _below(level: int) -> str:
    """The rows so far and the children of those of a level, from rows in {tree}."""
    row = "named_struct(" + ", ".join(f"'{c}', t.{c}" for c in _CARRIED) + ")"
    child = {"id": "c.id", "parent_id": "t.id", "depth": str(level + 1), "least": f"CASE WHEN c.role = 'items' THEN c.least ELSE {_text('c.v', 'minItems')} END", "most": f"CASE WHEN c.role = 'items' THEN c.most ELSE {_text('c.v', 'maxItems')} END"} | _EMPTY
    made = "named_struct(" + ", ".join(f"'{c}', {child.get(c, 'c.' + c)}" for c in _CARRIED) + ")"
    kept = [c for c in _CARRIED if c not in ("kind", "branches", "plain", "mixed")]
    return f"""SELECT s.* EXCEPT (known), coalesce(s.known, {_mixed('s')}) AS mixed FROM (
    SELECT r.* EXCEPT (known_plain), coalesce(r.known_plain, transform(r.branches, b -> {_plain('b')})) AS plain FROM (
      SELECT q.* EXCEPT (known_branches), coalesce(q.known_branches, {_branches('q')}) AS branches FROM (
        SELECT p.doc, p.schema, p.ordinal, {', '.join(f'p.x.{c} AS {c}' for c in kept)}, p.x.branches AS known_branches, p.x.plain AS known_plain, p.x.mixed AS known,
          coalesce(p.x.kind, CASE WHEN p.x.role IN ('anyOf', 'oneOf') AND {_shaped('p.x.v')} THEN 'shape' ELSE {_kind('p.x.v')} END) AS kind
        FROM (SELECT t.doc, t.schema, t.ordinal, explode(concat(array({row}), CASE WHEN t.depth = {level} THEN coalesce(transform({_CHAINED}, c -> {made}), array()) ELSE array() END)) AS x FROM {{tree}} t) p) q) r) s"""


def _tree(mode: str) -> str:
    """The recursion.

    line: the shape that constraints go to, and those they go to instead while a single
    branch takes its parent's place. chain: the branches that stay if this one does. lead:
    nothing has spoken on the carrier before.
    """
    top = _top(mode)
    return f"""
WITH RECURSIVE tree (doc, schema, ordinal, node_id, parent_id, role, name, v, line, pline, shapes_only, required, lead, chain, owl_owner, least, most, kind, branches, plain, mixed) MAX RECURSION LEVEL {LEVELS} AS (
  SELECT s.*, {_mixed('s')} FROM (
    SELECT r.*, transform(r.branches, b -> {_plain('b')}) AS plain FROM (
      SELECT q.*, {_branches('q')} AS branches FROM (
        SELECT doc, schema, CAST(ordinal AS INT) AS ordinal, concat(doc, '#/', schema) AS node_id, CAST(NULL AS STRING) AS parent_id, 'schema' AS role, schema AS name, v,
          CASE WHEN {top} IN ('array', 'anyOf', 'oneOf', 'allOf') THEN array(concat(doc, '#/', schema)) ELSE {_NONE} END AS line, {_NONE} AS pline, false AS shapes_only, false AS required, true AS lead,
          {_NONE} AS chain, schema AS owl_owner, {_text('v', 'minItems')} AS least, {_text('v', 'maxItems')} AS most, {top} AS kind FROM {{parsed}}) q) r) s
  UNION ALL
  SELECT s.*, {_mixed('s')} FROM (
    SELECT r.*, transform(r.branches, b -> {_plain('b')}) AS plain FROM (
      SELECT q.*, {_branches('q')} AS branches FROM (
        SELECT p.doc, p.schema, p.ordinal, x.id AS node_id, p.node_id AS parent_id, x.role, x.name, x.v, x.line, x.pline, x.shapes_only, x.required, x.lead, x.chain, x.owl_owner,
          CASE WHEN x.role = 'items' THEN x.least ELSE {_text('x.v', 'minItems')} END AS least, CASE WHEN x.role = 'items' THEN x.most ELSE {_text('x.v', 'maxItems')} END AS most,
          CASE WHEN x.role IN ('anyOf', 'oneOf') AND {_shaped('x.v')} THEN 'shape' ELSE {_kind('x.v')} END AS kind
        FROM (SELECT t.doc, t.schema, t.ordinal, t.node_id, explode({_CHILDREN}) AS x FROM tree t) p) q) r) s)
SELECT *, CAST(NULL AS INT) AS deeper FROM tree"""


def _term(v: str) -> str:
    """A scalar as its lexical form and the name of its datatype; null is the text NULL."""
    kind, text = f"schema_of_variant({v})", f"try_cast({v} AS STRING)"
    return f"""named_struct('lex', CASE WHEN {kind} = 'VOID' THEN 'NULL' ELSE {text} END, 'dt', CASE WHEN {kind} = 'BOOLEAN' THEN 'boolean' WHEN {kind} = 'BIGINT' THEN 'integer' WHEN {kind} = 'VOID' THEN 'null'
      WHEN {kind} = 'DOUBLE' OR {kind} LIKE 'DECIMAL%' THEN CASE WHEN {text} RLIKE '^[+-]?[0-9]+$' THEN 'integer' ELSE 'double' END ELSE 'string' END)"""


def _flag(key: str) -> str:
    return f"coalesce(try_variant_get(v, '$.{key}', 'boolean'), false)"


def _bound(key: str) -> str:
    return f"CASE WHEN {_text('v', key)} IS NOT NULL THEN {_term(_at('v', key))} END"


_LAST = "lower(element_at(split({}, '/'), -1))"
#: The datatype of a primitive branch.
_WORD = f"""CASE WHEN {_has('b', '$ref')} THEN CASE WHEN {_LAST.format(_text('b', '$ref'))} LIKE '%float%' THEN 'float' WHEN {_LAST.format(_text('b', '$ref'))} LIKE '%int%' THEN 'integer'
    WHEN {_LAST.format(_text('b', '$ref'))} LIKE '%bool%' THEN 'boolean' ELSE 'string' END
  WHEN {_text('b', 'type')} = 'string' THEN CASE {_text('b', 'format')} WHEN 'date-time' THEN 'dateTime' WHEN 'full-time' THEN 'time' WHEN 'date-month' THEN 'gMonth' WHEN 'date-mday' THEN 'gMonthDay' ELSE 'string' END
  WHEN {_text('b', 'type')} = 'number' THEN 'double' ELSE {_text('b', 'type')} END"""

#: What rows need of the spec itself; for mixed unions their datatypes, references and other branches.
_FIELDS = f"""
SELECT doc, schema, ordinal, node_id, parent_id, CASE WHEN v IS NOT NULL THEN role END AS role, name, CASE WHEN v IS NULL THEN 'error' ELSE kind END AS kind, line, pline, shapes_only, required, lead, chain, owl_owner,
  deeper, least AS min_items, most AS max_items, mixed, size(branches) AS n, CASE WHEN kind IN ('anyOf', 'oneOf') AND NOT mixed THEN transform(branches, b -> {_shaped('b')}) END AS shaped,
  {_text('v', 'type')} AS type, {_text('v', '$ref')} AS ref, {_text('v', 'format')} AS format, {_text('v', 'description')} AS description, {_text('v', 'pattern')} AS pattern,
  {_text('v', 'minLength')} AS min_length, {_text('v', 'maxLength')} AS max_length, {_bound('minimum')} AS minimum, {_bound('maximum')} AS maximum, {_has('v', 'items')} AS has_items,
  try_variant_get(v, '$.items.type', 'string') AS item_type, try_variant_get(v, '$.items["$ref"]', 'string') AS item_ref,
  {_flag('readOnly')} AS read_only, {_flag('writeOnly')} AS write_only, {_flag('nullable')} AS nullable, {_flag('deprecated')} AS deprecated, {_has('v', 'discriminator')} AS discriminator,
  transform(try_cast({_at('v', 'enum')} AS ARRAY<VARIANT>), x -> {_term('x')}) AS enum,
  filter(array(CASE WHEN {_has('v', 'allOf')} THEN 'allOf' END, CASE WHEN {_has('v', 'anyOf')} THEN 'anyOf' END, CASE WHEN {_has('v', 'oneOf')} THEN 'oneOf' END), x -> x IS NOT NULL) AS combinators,
  filter(transform(try_cast({_at('v', 'oneOf')} AS ARRAY<VARIANT>), b -> {_text('b', '$ref')}), x -> x IS NOT NULL) AS one_of,
  CASE WHEN mixed THEN array_distinct(filter(transform(branches, (b, i) -> CASE WHEN plain[i] THEN {_WORD} END), x -> x IS NOT NULL)) END AS words,
  CASE WHEN mixed THEN array_distinct(filter(transform(branches, (b, i) -> CASE WHEN NOT plain[i] THEN {_text('b', '$ref')} END), x -> x IS NOT NULL)) END AS refs,
  CASE WHEN mixed THEN filter(transform(branches, (b, i) -> CASE WHEN NOT plain[i] AND {_at('b', '$ref')} IS NULL THEN concat(node_id, '/other/', i) END), x -> x IS NOT NULL) END AS others,
  CASE WHEN v IS NULL THEN 'ValueError: the schema is no JSON' WHEN kind = 'object' AND try_cast({_at('v', 'properties')} AS MAP<STRING, VARIANT>) IS NULL AND coalesce({_text('v', 'properties')}, '') NOT IN ('', '[]', '0', 'false')
    THEN concat('TypeError: properties of ', node_id, ' are no mapping') END AS error
FROM {{tree}}"""

_SOLID = "(kind IN ('ref', 'object', 'shape', 'array', 'string', 'integer', 'number') OR (kind IN ('anyOf', 'oneOf', 'allOf') AND mixed) OR (kind = 'allOf' AND n > 0))"
_UNION = "left({0}, length({0}) - length(substring_index({0}, '/', -1)))"
#: Whether a branch is the only one of its union that stays.
_ALONE = f"(array_contains(stay, x) AND size(filter(stay, y -> {_UNION.format('y')} = {_UNION.format('x')})) = 1)"

_PLACED = f"""
SELECT *, get(filter(line, x -> NOT {_ALONE}), 0) AS carrier, get(filter(pline, x -> NOT {_ALONE}), 0) AS parent_shape, exists(array(node_id), x -> role IN ('anyOf', 'oneOf') AND {_ALONE}) AS alone,
  CASE WHEN shaped IS NOT NULL THEN filter(transform(shaped, (b, i) -> concat(node_id, '/', kind, '/', i)), x -> array_contains(stay, x)) END AS staying
FROM (SELECT *, array_distinct(flatten(collect_list(CASE WHEN role IN ('anyOf', 'oneOf') AND {_SOLID} THEN chain END) OVER (PARTITION BY doc, schema))) AS stay FROM {{fields}})"""


def _made(id_: str, role: str, kind: str, own: bool = False, **more: str) -> str:
    """A row that no spec stands for; it has a shape of its own or speaks on its node's carrier."""
    none = "CAST(NULL AS STRING)"
    every = {"id": id_, "role": f"'{role}'", "kind": f"'{kind}'", "own": str(own).lower(), "type": none, "ref": none, "predicate": none, "members": "CAST(NULL AS ARRAY<STRING>)"} | more
    return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in every.items()) + ")"


_ROW = "STRUCT<id: STRING, role: STRING, kind: STRING, own: BOOLEAN, type: STRING, ref: STRING, predicate: STRING, members: ARRAY<STRING>>"
_CLASS = "concat(node_id, '/class/', i)"
_MADE = f"""filter(concat(
  array(CAST(NULL AS {_ROW})),
  CASE WHEN kind = 'object' AND role <> 'schema' THEN array({_made("concat(node_id, '/shape')", 'inline', 'nodeshape', True)}) ELSE array() END,
  CASE WHEN mixed AND size(words) = 1 THEN array({_made("concat(node_id, '/datatype')", 'wrap', 'datatype', type='words[0]')})
       WHEN mixed THEN concat(transform(words, w -> {_made("concat(node_id, '/datatype/', w)", 'wrap', 'datatype', True, type='w')}),
         array({_made("concat(node_id, '/list/datatypes')", 'list', 'list', predicate="'or_'", members="transform(words, w -> concat(node_id, '/datatype/', w))")})) ELSE array() END,
  CASE WHEN mixed THEN transform(refs, (r, i) -> {_made(_CLASS, 'wrap', 'ref', True, ref='r')}) ELSE array() END,
  CASE WHEN mixed AND size(refs) = 1 AND size(others) = 0 THEN array({_made("concat(node_id, '/class')", 'wrap', 'ref', ref='refs[0]')})
       WHEN mixed THEN array({_made("concat(node_id, '/list/classes')", 'list', 'list', predicate="'or_'", members=f"concat(transform(refs, (r, i) -> {_CLASS}), others)")}) ELSE array() END,
  CASE WHEN size(staying) > 1 THEN array({_made("concat(node_id, '/list/branches')", 'list', 'list', predicate="CASE kind WHEN 'anyOf' THEN 'or_' ELSE 'xone' END", members='staying')}) ELSE array() END),
  x -> x IS NOT NULL)"""

#: The node's own row, m null, and those made of it. That a level is missing is asked behind the window, where the filter stays a short one.
_ROWS = f"""
SELECT doc, schema, ordinal, coalesce(m.id, node_id) AS node_id, CASE WHEN m IS NULL THEN parent_id ELSE node_id END AS parent_id, coalesce(m.role, role) AS role, CASE WHEN m IS NULL THEN name END AS name,
  coalesce(m.kind, kind) AS kind, CASE WHEN m IS NULL THEN type ELSE m.type END AS type, CASE WHEN m IS NULL THEN ref ELSE m.ref END AS ref,
  {', '.join(f'CASE WHEN m IS NULL THEN {c} END AS {c}' for c in ('format', 'description', 'pattern', 'min_length', 'max_length'))},
  {', '.join(f'CASE WHEN m IS NULL THEN {c}.lex END AS {c}, CASE WHEN m IS NULL THEN {c}.dt END AS {c}_dt' for c in ('minimum', 'maximum'))},
  {', '.join(f'CASE WHEN m IS NULL THEN {c} END AS {c}' for c in ('min_items', 'max_items', 'item_type', 'item_ref'))},
  CASE WHEN m IS NULL THEN carrier WHEN m.kind IN ('list', 'nodeshape') THEN NULL WHEN m.own THEN m.id ELSE carrier END AS carrier,
  CASE WHEN m.own THEN m.id WHEN m IS NOT NULL THEN NULL WHEN role IN ('property', 'items') THEN node_id WHEN role IN ('anyOf', 'oneOf') AND NOT alone THEN node_id
    WHEN role = 'schema' THEN CASE WHEN kind = 'object' THEN concat(node_id, '/shape') WHEN kind IN ('array', 'anyOf', 'oneOf', 'allOf') THEN node_id END END AS shape,
  CASE WHEN m IS NULL THEN parent_shape END AS parent_shape,
  CASE WHEN m IS NULL AND lead AND (kind IN ('object', 'boolean', 'untyped') OR (kind = 'allOf' AND n = 0) OR (shaped IS NOT NULL AND size(staying) = 0)
    OR (shaped IS NOT NULL AND size(staying) = 1 AND shaped[CAST(substring_index(staying[0], '/', -1) AS INT)])) THEN carrier END AS default_on,
  CASE WHEN m.kind = 'list' THEN carrier END AS list_on, m.predicate AS list_predicate,
  CASE WHEN m.own THEN 'NodeShape' WHEN m IS NOT NULL THEN NULL WHEN role IN ('property', 'items') THEN 'PropertyShape' WHEN role IN ('anyOf', 'oneOf') AND NOT alone THEN 'NodeShape'
    WHEN role = 'schema' AND kind IN ('object', 'array', 'anyOf', 'oneOf', 'allOf') THEN 'NodeShape' END AS own_kind,
  CASE WHEN m IS NULL THEN owl_owner END AS owl_owner, m IS NULL AND required AS required, m IS NULL AND has_items AS has_items,
  coalesce(m.kind = 'nodeshape', role = 'schema' AND kind IN ('object', 'array', 'anyOf', 'oneOf', 'allOf'), false) AS target, m IS NULL AND role = 'property' AS path, m IS NULL AND role = 'items' AS list_path,
  m IS NULL AND role = 'property' AND NOT shapes_only AND NOT (coalesce(type = 'array', false) OR has_items) AS max_one, m IS NULL AND role = 'property' AND NOT shapes_only AS vocabulary,
  m IS NULL AND role IN ('anyOf', 'oneOf', 'allOf') AS describe, m IS NOT NULL OR role NOT IN ('anyOf', 'oneOf') OR array_contains(stay, node_id) AS kept,
  {', '.join(f'm IS NULL AND {c} AS {c}' for c in ('read_only', 'write_only', 'nullable', 'deprecated', 'discriminator'))},
  CASE WHEN m IS NULL THEN enum END AS enum, m.members, CASE WHEN m IS NULL THEN combinators ELSE {_NONE} END AS combinators, CASE WHEN m IS NULL THEN one_of END AS one_of, CASE WHEN m IS NULL THEN error END AS error
FROM (SELECT *, explode(concat(array(CAST(NULL AS {_ROW})), {_MADE})) AS m FROM {{placed}}
  WHERE CASE WHEN deeper IS NOT NULL THEN CAST(raise_error(concat(node_id, ' has more than ', deeper, ' levels')) AS BOOLEAN) ELSE true END)"""


def _descended(spark: SparkSession, parsed: DataFrame, mode: str, levels: int) -> DataFrame:
    """The tree of schemas of so many levels at most, every schema's rows in its own partition; a deeper one fails the query."""
    tree = spark.sql(_roots(mode), parsed=parsed)
    for level in range(levels - 1):
        tree = spark.sql(_below(level), tree=tree)
    deeper = f"CASE WHEN t.depth = {levels - 1} AND size({_CHAINED}) > 0 THEN {levels} END"
    return spark.sql(f"SELECT t.* EXCEPT (id, depth), t.id AS node_id, {deeper} AS deeper FROM {{tree}} t", tree=tree)


def flatten(specs: DataFrame, mode: str = "shacl", levels: int | None = None) -> DataFrame:
    """specs(doc, schema, ordinal, spec: JSON) to schema nodes, as shapes (shacl) or the ontology (owl) see them.

    A schema that is no JSON, or an object whose properties are no mapping, is a row with
    its error; a schema has at most LEVELS levels. Properties of one object are in no order.
    With levels, which has to be as many as any schema has (a deeper one fails the query),
    schemas are dealt out once and nothing else is shuffled; without, a recursion goes on
    until there are no more. It may make any number of rows: spark.sql.cteRecursionRowLimit,
    which would end it at a million, is set to -1 in the session.
    """
    spark = specs.sparkSession
    # As many partitions as shuffles have: Spark would make fewer by the size of the texts, of which each becomes many times as much, and the recursion ends in as many as it began with.
    dealt = specs.select("doc", "schema", "ordinal", "spec").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc", "schema")
    parsed = dealt.select("doc", "schema", "ordinal", F.try_parse_json("spec").alias("v"))
    if levels is None:
        spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
        tree = spark.sql(_tree(mode), parsed=parsed)
    else:
        tree = _descended(spark, parsed, mode, levels)
    placed = spark.sql(_PLACED, fields=spark.sql(_FIELDS, tree=tree))
    return spark.sql(_ROWS, placed=placed).to(NODE)
