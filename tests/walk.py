"""The brute-force version of `flatten`: a walk over one schema tree in order, with all that has been said so far in its hands."""

from __future__ import annotations

from typing import Any

from weftgraph.operators.flatten import NODE

COMBINATORS = ("anyOf", "oneOf", "allOf")
PRIMITIVES = ("string", "integer", "number", "boolean")


def kind_of(spec: Any) -> str:
    """The first rule that applies: a reference hides everything, a type hides combinators."""
    if not isinstance(spec, dict):
        return "untyped"
    if "$ref" in spec:
        return "ref"
    if spec.get("type") in ("object", "array", "string", "integer", "number"):
        return spec["type"]
    return next((c for c in COMBINATORS if c in spec), "boolean" if spec.get("type") == "boolean" else "untyped")


def term(value: Any) -> tuple[str, str]:
    if isinstance(value, bool):
        return str(value).lower(), "boolean"
    if isinstance(value, int):
        return str(value), "integer"
    if isinstance(value, float):
        return repr(value), "double"
    return ("NULL", "null") if value is None else (str(value), "string")


def named_primitive(ref: str) -> bool:
    last = ref.rsplit("/", 1)[-1].lower()
    return any(w in last for w in ("float", "int", "string", "bool"))


def _ref_word(ref: str) -> str:
    last = ref.rsplit("/", 1)[-1].lower()
    return next((d for w, d in (("float", "float"), ("int", "integer"), ("bool", "boolean")) if w in last), "string")


class Walk:
    """Rows of one top-level schema."""

    def __init__(self, doc: str, schema: str, ordinal: int) -> None:
        self.doc, self.schema, self.ordinal = doc, schema, ordinal
        self.rows: list[dict[str, Any]] = []
        self.valued: set[str] = set()
        self.added = 0

    def row(self, node_id: str, parent: str | None, role: str, name: str | None, spec: Any, **more: Any) -> dict[str, Any]:
        s = spec if isinstance(spec, dict) else {}
        text = lambda k: None if s.get(k) is None else term(s[k])[0]
        items = s.get("items") if isinstance(s.get("items"), dict) else {}
        out = dict.fromkeys(NODE.names) | {
            "doc": self.doc, "schema": self.schema, "ordinal": self.ordinal, "node_id": node_id, "parent_id": parent, "role": role, "name": name,
            "kind": kind_of(spec), "type": text("type"), "ref": text("$ref"), "format": text("format"), "description": text("description"), "pattern": text("pattern"),
            "min_length": text("minLength"), "max_length": text("maxLength"), "min_items": text("minItems"), "max_items": text("maxItems"),
            "item_type": None if items.get("type") is None else str(items["type"]), "item_ref": items.get("$ref"), "has_items": "items" in s,
            "required": False, "target": False, "path": False, "list_path": False, "max_one": False, "vocabulary": False, "describe": False, "kept": True,
            "read_only": bool(s.get("readOnly")), "write_only": bool(s.get("writeOnly")), "nullable": bool(s.get("nullable")), "deprecated": bool(s.get("deprecated")), "discriminator": "discriminator" in s,
            "enum": [term(v) for v in s["enum"]] if isinstance(s.get("enum"), list) else None, "combinators": [c for c in ("allOf", "anyOf", "oneOf") if c in s],
            "one_of": [str(b["$ref"]) for b in s["oneOf"] if isinstance(b, dict) and "$ref" in b] if isinstance(s.get("oneOf"), list) else None,
        }
        for bound in ("minimum", "maximum"):
            if s.get(bound) is not None:
                out[bound], out[f"{bound}_dt"] = term(s[bound])
        self.rows.append(out | more)
        return self.rows[-1]

    def value(self, carrier: str | None) -> None:
        self.added += 1
        if carrier:
            self.valued.add(carrier)

    def dispatch(self, row: dict[str, Any], spec: Any, carrier: str | None, top: bool) -> None:
        """Emit a node onto its carrier and visit what is below it."""
        kind, node = row["kind"], row["node_id"]
        row["carrier"] = carrier
        if kind == "ref":
            if carrier:
                self.value(carrier)
            return
        if kind == "object":
            self.object(row, spec)
        elif kind == "array":
            if top:
                row["shape"], row["own_kind"], row["target"] = node, "NodeShape", True
                carrier = row["carrier"] = node
            self.value(carrier)
            if "items" in spec and carrier:
                child = f"{node}/items"
                item = self.row(child, node, "items", None, spec["items"], shape=child, own_kind="PropertyShape", parent_shape=carrier, list_path=True)
                # The list's own bounds, not those of the items; a list of lists has both.
                item["min_items"], item["max_items"] = (None if spec.get(k) is None else term(spec[k])[0] for k in ("minItems", "maxItems"))
                self.added += 3
                self.dispatch(item, spec["items"], child, False)
        elif kind in ("string", "integer", "number"):
            if carrier:
                self.value(carrier)
        elif kind in COMBINATORS:
            if top:
                row["shape"], row["own_kind"], row["target"] = node, "NodeShape", True
                carrier = row["carrier"] = node
            self.union(row, spec[kind] if isinstance(spec[kind], list) else [], carrier)
        if carrier and carrier not in self.valued:
            row["default_on"] = carrier
            self.value(carrier)

    def object(self, row: dict[str, Any], spec: dict) -> None:
        shape = f"{row['node_id']}/shape"
        if row["role"] == "schema":
            row["shape"], row["own_kind"], row["target"] = shape, "NodeShape", True
        else:  # the owner gets one more shape; nothing links the carrier to it
            self.row(shape, row["node_id"], "inline", None, None, kind="nodeshape", shape=shape, own_kind="NodeShape", target=True)
        self.added += 2
        self.properties(row["node_id"], spec, shape, shapes_only=False)

    def properties(self, node: str, spec: dict, shape: str, shapes_only: bool) -> None:
        needed = spec.get("required") if isinstance(spec.get("required"), list) else []
        for name, below in (spec.get("properties") or {}).items():
            if not isinstance(name, str):
                raise TypeError(f"property name {name!r} is no string")
            child = f"{node}/properties/{name}"
            many = isinstance(below, dict) and (below.get("type") == "array" or "items" in below)
            prop = self.row(child, node, "property", name, below, shape=child, own_kind="PropertyShape", parent_shape=shape, path=True, required=name in needed, max_one=not shapes_only and not many, vocabulary=not shapes_only)
            self.added += 3
            self.dispatch(prop, below, child, False)

    def union(self, row: dict[str, Any], branches: list, carrier: str) -> None:
        node, operator = row["node_id"], row["kind"]
        plain = [isinstance(b, dict) and (named_primitive(str(b["$ref"])) if "$ref" in b else b.get("type") in PRIMITIVES) for b in branches]
        if any(plain) and not all(plain):
            self.mixed(node, branches, plain, carrier)
        elif operator == "allOf":
            for i, b in enumerate(branches):
                self.dispatch(self.row(f"{node}/{operator}/{i}", node, operator, None, b, describe=True), b, carrier, False)
        else:
            kept = []
            for i, b in enumerate(branches):
                at = f"{node}/{operator}/{i}"
                before, first = self.added, len(self.rows)
                branch = self.row(at, node, operator, None, b, shape=at, own_kind="NodeShape", describe=True)
                if branch["kind"] == "object" and b.get("properties"):
                    branch["kind"], branch["carrier"] = "shape", at
                    self.properties(at, b, at, shapes_only=True)
                    stays = True
                else:
                    self.dispatch(branch, b, at, False)
                    stays = (at in self.valued and branch["default_on"] != at) or self.added - before >= 2
                if stays:
                    kept.append((at, first))
                else:
                    self.added = before  # what it said goes with it
                    for r in self.rows[first:]:
                        if r["carrier"] == at or r["shape"] == at:
                            r["kept"] = False
            if len(kept) == 1:
                at, first = kept[0]
                for r in self.rows[first:]:
                    for k in ("carrier", "parent_shape", "default_on", "list_on"):
                        if r[k] == at:
                            r[k] = carrier
                    if r["shape"] == at:
                        r["shape"], r["own_kind"] = None, None
                if at in self.valued:
                    self.valued.add(carrier)
            elif kept:
                self.listed(node, carrier, "or_" if operator == "anyOf" else "xone", [k for k, _ in kept], "branches")

    def listed(self, node: str, carrier: str, predicate: str, members: list[str], name: str) -> None:
        self.row(f"{node}/list/{name}", node, "list", None, None, kind="list", list_on=carrier, list_predicate=predicate, members=members)
        self.added += 2
        self.value(carrier)

    def mixed(self, node: str, branches: list, plain: list[bool], carrier: str) -> None:
        """Primitives and classes side by side: two lists on one carrier, whatever the operator."""
        def word(b: dict) -> str:
            if "$ref" in b:
                return _ref_word(str(b["$ref"]))
            if b["type"] == "string":
                return {"date-time": "dateTime", "full-time": "time", "date-month": "gMonth", "date-mday": "gMonthDay"}.get(b.get("format"), "string")
            return {"number": "double"}.get(b["type"], b["type"])

        words = list(dict.fromkeys(word(b) for b, p in zip(branches, plain, strict=True) if p))
        wrap = lambda at, on, **more: self.row(at, node, "wrap", None, None, shape=at if on == at else None, own_kind="NodeShape" if on == at else None, carrier=on, **more)
        if len(words) == 1:
            wrap(f"{node}/datatype", carrier, kind="datatype", type=words[0])
            self.value(carrier)
        else:
            ids = [f"{node}/datatype/{w}" for w in words]
            for at, w in zip(ids, words, strict=True):
                wrap(at, at, kind="datatype", type=w)
            self.listed(node, carrier, "or_", ids, "datatypes")
        refs = list(dict.fromkeys(str(b["$ref"]) for b, p in zip(branches, plain, strict=True) if not p and isinstance(b, dict) and "$ref" in b))
        ids = [f"{node}/class/{i}" for i in range(len(refs))]
        for at, ref in zip(ids, refs, strict=True):
            wrap(at, at, kind="ref", ref=ref)
        others = []
        for i, (b, p) in enumerate(zip(branches, plain, strict=True)):
            if not p and not (isinstance(b, dict) and "$ref" in b):
                at = f"{node}/other/{i}"
                others.append(at)
                self.dispatch(self.row(at, node, "other", None, b), b, at, False)
        if len(refs) == 1 and not others:
            wrap(f"{node}/class", carrier, kind="ref", ref=refs[0])
            self.value(carrier)
        else:
            self.listed(node, carrier, "or_", ids + others, "classes")


def flatten_schema(doc: str, schema: str, ordinal: int, spec: Any) -> list[dict[str, Any]]:
    walk = Walk(doc, schema, ordinal)
    walk.dispatch(walk.row(f"{doc}#/{schema}", None, "schema", schema, spec), spec, None, True)
    own: dict[str, tuple[str, str]] = {}  # nearest enclosing object: (its class name, its node)
    for r in walk.rows:
        if r["role"] == "schema":
            r["owl_owner"] = schema
        elif r["role"] == "property" and r["parent_id"] in own:
            r["owl_owner"] = own[r["parent_id"]][0]
        if r["kind"] == "object" and (r["role"] == "schema" or r["owl_owner"]):
            own[r["node_id"]] = (r["name"], r["node_id"])
    return walk.rows
