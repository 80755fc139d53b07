"""Text and blobs."""

from __future__ import annotations

import re

from ..errors import ParseError


def length(x: str) -> str:
    """Characters of text, bytes of a blob, characters of a number's text."""
    return f"length({x})"


def substr(s: str, i: str, n: str | None = None) -> str:
    """1-based; negative i counts from the end, clipped to the start; i = 0 is 1; negative n takes what stands before i."""
    text, size = f"cast({s} AS string)", f"char_length(cast({s} AS string))"
    start = f"CASE WHEN ({i}) > 0 THEN ({i}) WHEN ({i}) = 0 THEN 1 ELSE greatest({size} + ({i}) + 1, 1) END"
    if n is None:
        return f"substring({text}, {start})"
    before = f"substring({text}, greatest({start} + ({n}), 1), least({start} - 1, -({n})))"
    return f"CASE WHEN ({n}) < 0 THEN {before} ELSE substring({text}, {start}, {n}) END"


def instr(h: str, n: str) -> str:
    return f"cast(instr(cast({h} AS string), cast({n} AS string)) AS bigint)"


def replace(s: str, a: str, b: str) -> str:
    return f"replace(cast({s} AS string), {a}, {b})"


def _trim(side: str):
    def make(s: str, chars: str = "' '") -> str:
        return f"trim({side} {chars} FROM {s})"

    return make


def zeroblob(n: str) -> str:
    return f"unhex(repeat('00', cast(greatest({n}, 0) AS int)))"


def quote(x: str) -> str:
    """A value as a literal of the dialect."""
    text = f"concat('''', replace(cast({x} AS string), '''', ''''''), '''')"
    return f"CASE WHEN ({x}) IS NULL THEN 'NULL' WHEN typeof({x}) = 'string' THEN {text} WHEN typeof({x}) = 'binary' THEN concat('X''', hex({x}), '''') ELSE cast({x} AS string) END"


def glob(pattern: str, s: str) -> str:
    """Shell pattern as a regular expression, for any pattern: * ? and [...] with ^ for not."""
    escaped = f"regexp_replace({pattern}, '([.+(){{}}|$\\\\\\\\])', '\\\\\\\\$1')"
    return f"({s}) RLIKE concat('(?s)^', replace(replace({escaped}, '*', '.*'), '?', '.'), '$')"


def like(pattern: str, s: str, escape: str | None = None) -> str:
    return f"({s}) ILIKE {pattern}" + (f" ESCAPE {escape}" if escape else "")


def concat(*xs: str) -> str:
    return "concat(" + ", ".join(f"coalesce(cast({x} AS string), '')" for x in xs) + ")"


def _character(x: str) -> str:
    """The character of a code point, by its UTF-8 bytes."""
    n = f"cast({x} AS bigint)"

    def tail(shift: int) -> str:
        return f"hex(128 + shiftright({n}, {shift}) % 64)"

    two, three, four = (f"decode(unhex(concat(hex({lead} + shiftright({n}, {shift})), {', '.join(tail(k) for k in range(shift - 6, -1, -6))})), 'UTF-8')" for lead, shift in ((192, 6), (224, 12), (240, 18)))
    return f"CASE WHEN {n} < 128 THEN char({n}) WHEN {n} < 2048 THEN {two} WHEN {n} < 65536 THEN {three} ELSE {four} END"


def char(*xs: str) -> str:
    return "concat(" + ", ".join(_character(x) for x in xs) + ")" if xs else "''"


def printf(form: str, *xs: str) -> str:
    """The dialect's codes as those of Spark; the format must be a literal where it has other ones."""
    text, given, out, args = form.strip(), iter(xs), [], []
    if not (text.startswith("'") and text.endswith("'")):
        return f"format_string({', '.join((form, *xs))})"
    for part in re.findall(r"%[-+ 0,#!]*\d*(?:\.\d+)?(?:ll|l)?[a-zA-Z%]|[^%]+|%", text[1:-1]):
        code = part[-1] if part.startswith("%") and len(part) > 1 else ""
        if not code:
            out.append(part.replace("%", "%%"))
            continue
        if code in "%n":
            out.append("%%")
            continue
        x, flags = next(given, "NULL"), part[:-1].replace("l", "").replace("!", "")
        if code in "diu":
            out.append(flags + "d")
            args.append(f"cast({x} AS bigint)")
        elif code in "feEgGxXo":
            out.append(flags + {"E": "e", "G": "g"}.get(code, code))
            args.append(f"cast({x} AS {'bigint' if code in 'xXo' else 'double'})")
        elif code == "c":
            out.append(flags + "s")
            args.append(f"substring(cast({x} AS string), 1, 1)")
        elif code in "qQw":
            mark = '"' if code == "w" else "\\'"
            inside = f"replace(cast({x} AS string), '{mark}', '{mark * 2}')"
            out.append(flags + "s")
            args.append(f"CASE WHEN ({x}) IS NULL THEN 'NULL' ELSE concat('\\'', {inside}, '\\'') END" if code == "Q" else inside)
        elif code == "s":
            out.append(flags + "s")
            args.append(f"coalesce(cast({x} AS string), '')")
        else:
            raise ParseError(f"unknown printf code {part}")
    return f"format_string({', '.join(['\'' + ''.join(out) + '\'', *args])})"


TEMPLATES = {
    "length": length,
    "substr": substr,
    "substring": substr,
    "instr": instr,
    "replace": replace,
    "trim": _trim("BOTH"),
    "ltrim": _trim("LEADING"),
    "rtrim": _trim("TRAILING"),
    "zeroblob": zeroblob,
    "quote": quote,
    "glob": glob,
    "like": like,
    "concat": concat,
    "char": char,
    "hex": lambda x: f"hex(cast(cast({x} AS string) AS binary))" if not x.strip().upper().startswith("X'") else f"hex({x})",
    "unicode": lambda x: f"ascii({x})",
    "printf": printf,
    "format": printf,
    "octet_length": lambda x: f"octet_length({x})",
}
