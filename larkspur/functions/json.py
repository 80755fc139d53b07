"""JSON kept as text."""

from __future__ import annotations

import re

from ..errors import ParseError


def path(p: str) -> str:
    """A path literal; ``.N`` after an array is the same as ``[N]``."""
    text = p.strip()
    if not (text.startswith("'") and text.endswith("'")):
        raise ParseError("a JSON path must be a literal")
    inner = text[1:-1]
    if not inner.startswith("$"):
        inner = f"$[{inner}]" if inner.isdigit() else f"$.{inner}"
    inner = re.sub(r"\.\"([^\"]*)\"", r"['\1']", re.sub(r"\.(\d+)(?=[.\[]|$)", r"[\1]", inner))
    return '"' + inner + '"' if "'" in inner else "'" + inner + "'"


def extract(j: str, p: str) -> str:
    """Text of the value; true and false are 1 and 0; missing, null and invalid are NULL."""
    got = f"get_json_object({j}, {path(p)})"
    kind = f"schema_of_variant(try_variant_get(try_parse_json({j}), {path(p)}, 'variant'))"
    return f"CASE WHEN {kind} = 'BOOLEAN' THEN CASE WHEN {got} = 'true' THEN '1' ELSE '0' END ELSE {got} END"


def arrow(j: str, p: str) -> str:
    return f"to_json(try_variant_get(try_parse_json({j}), {path(p)}, 'variant'))"


def valid(x: str) -> str:
    return f"CASE WHEN ({x}) IS NULL THEN NULL WHEN typeof({x}) <> 'string' THEN 0 ELSE cast(try_parse_json(cast({x} AS string)) IS NOT NULL AS int) END"


def value(x: str) -> str:
    """A value as a variant; text that is JSON is taken as it."""
    return f"CASE WHEN typeof({x}) = 'string' THEN coalesce(try_parse_json(cast({x} AS string)), cast(cast({x} AS string) AS variant)) ELSE cast({x} AS variant) END"


def array(*xs: str) -> str:
    return f"to_json(array({', '.join(value(x) for x in xs)}), map('ignoreNullFields', 'false'))" if xs else "'[]'"


def object_(*xs: str) -> str:
    if len(xs) % 2:
        raise ParseError("json_object() needs pairs of names and values")
    if not xs:
        return "'{}'"
    # Later pairs of a name win, and names are sorted.
    last = dict(zip(xs[::2], xs[1::2], strict=True))
    return "to_json(named_struct(" + ", ".join(f"{k}, {value(v)}" for k, v in sorted(last.items())) + "), map('ignoreNullFields', 'false'))"


def kind(j: str, p: str = "'$'") -> str:
    v = f"schema_of_variant(try_variant_get(try_parse_json({j}), {path(p)}, 'variant'))"
    return f"CASE WHEN {v} IS NULL THEN NULL WHEN {v} = 'VOID' THEN 'null' WHEN {v} = 'BOOLEAN' THEN CASE WHEN get_json_object({j}, {path(p)}) = 'true' THEN 'true' ELSE 'false' END WHEN {v} = 'BIGINT' THEN 'integer' WHEN {v} LIKE 'DECIMAL%' OR {v} = 'DOUBLE' THEN 'real' WHEN {v} = 'STRING' THEN 'text' WHEN {v} LIKE 'ARRAY%' THEN 'array' ELSE 'object' END"


def length(j: str, p: str = "'$'") -> str:
    return f"json_array_length(get_json_object({j}, {path(p)}))" if p.strip() != "'$'" else f"json_array_length({j})"


TEMPLATES = {
    "json": lambda x: f"to_json(parse_json({x}))",
    "json_valid": valid,
    "json_extract": extract,
    "json_arrow": arrow,
    "json_array": array,
    "json_object": object_,
    "json_type": kind,
    "json_array_length": length,
    "json_quote": lambda x: f"to_json({value(x)})",
    "json_group_object": lambda k, v: f"to_json(map_from_entries(collect_list(struct(cast({k} AS string), {value(v)}))))",
    "json_group_array": lambda x: f"to_json(collect_list({x}))",
}
