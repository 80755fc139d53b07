"""Dates: a time value is 'now', ISO text, Unix seconds (integer) or a Julian day (real)."""

from __future__ import annotations

import re

from ..errors import ParseError

_CODES = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%f": "ss.SSS", "%j": "DDD", "%F": "yyyy-MM-dd", "%T": "HH:mm:ss"}
_UNITS = {"day": "day", "hour": "hour", "minute": "minute", "second": "second", "month": "month", "year": "year"}


def timestamp(x: str) -> str:
    """SQL for a time value as a timestamp; what is no time value gives NULL."""
    if x.strip().lower() == "'now'":
        return "current_timestamp()"
    text = f"cast({x} AS string)"
    parsed = "coalesce(" + ", ".join(f"try_to_timestamp({text}, '{p}')" for p in ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss.SSS")) + ")"
    whole, real = f"timestamp_seconds(try_cast({text} AS bigint))", f"timestamp_millis(cast(round((try_cast({text} AS double) - 2440587.5D) * 86400000) AS bigint))"
    return f"CASE WHEN typeof({x}) IN ('timestamp', 'timestamp_ntz', 'date') THEN try_cast({text} AS timestamp) WHEN typeof({x}) IN ('tinyint', 'smallint', 'int', 'bigint') THEN {whole} WHEN typeof({x}) = 'double' OR typeof({x}) LIKE 'decimal%' THEN {real} ELSE {parsed} END"


def modified(x: str, modifiers: tuple[str, ...]) -> str:
    """A time value with modifiers applied in turn; they must be literals."""
    out = timestamp(x)
    for m in modifiers:
        text = m.strip()
        if not (text.startswith("'") and text.endswith("'")):
            raise ParseError(f"a date modifier must be a literal: {m}")
        word = text[1:-1].strip().lower()
        if found := re.fullmatch(r"([+-]?\d+(?:\.\d+)?) (day|hour|minute|second|month|year)s?", word):
            n = float(found[1])
            if n != int(n) and found[2] in ("month", "year"):
                raise ParseError(f"a fraction of a {found[2]} has no length: {m}")
            out = f"timestampadd({_UNITS[found[2]].upper()}, {int(n)}, {out})" if n == int(n) else f"({out} + make_dt_interval(0, 0, 0, {n * {'day': 86400, 'hour': 3600, 'minute': 60, 'second': 1}.get(found[2], 0)}))"
        elif found := re.fullmatch(r"start of (day|month|year)", word):
            out = f"date_trunc('{found[1]}', {out})"
        elif found := re.fullmatch(r"weekday ([0-6])", word):
            out = f"timestampadd(DAY, cast((({found[1]} - (dayofweek({out}) - 1)) + 7) % 7 AS int), {out})"
        elif word in ("utc", "localtime", "auto", "unixepoch", "subsec"):
            continue
        else:
            raise ParseError(f"unknown date modifier: {m}")
    return out


def _shown(pattern: str):
    def make(x: str = "'now'", *modifiers: str) -> str:
        return f"date_format({modified(x, modifiers)}, '{pattern}')"

    return make


def julianday(x: str = "'now'", *modifiers: str) -> str:
    return f"(unix_millis({modified(x, modifiers)}) / 86400000D + 2440587.5D)"


def unixepoch(x: str = "'now'", *modifiers: str) -> str:
    return f"unix_seconds({modified(x, modifiers)})"


def strftime(form: str, x: str = "'now'", *modifiers: str) -> str:
    """The format is a literal and is translated here; an unknown code is an error."""
    text = form.strip()
    if not (text.startswith("'") and text.endswith("'")):
        raise ParseError("strftime needs a literal format")
    t, out = modified(x, modifiers), []
    for part in re.findall(r"%.|[^%]+|%", text[1:-1].replace("''", "'"), re.S):
        if part == "%%":
            out.append("'%'")
        elif part == "%s":
            out.append(f"cast(unix_seconds({t}) AS string)")
        elif part == "%J":
            out.append(f"cast({julianday(x, *modifiers)} AS string)")
        elif part == "%w":
            out.append(f"cast(dayofweek({t}) - 1 AS string)")
        elif part == "%u":
            out.append(f"cast(weekday({t}) + 1 AS string)")
        elif part == "%W":
            out.append(f"lpad(cast((dayofyear({t}) + 6 - weekday({t})) DIV 7 AS string), 2, '0')")
        elif part in _CODES:
            out.append(f"date_format({t}, '{_CODES[part]}')")
        elif part.startswith("%"):
            raise ParseError(f"unknown strftime code {part}")
        else:
            out.append("'" + part.replace("\\", "\\\\").replace("'", "\\'") + "'")
    return f"concat({', '.join(out)})" if out else "''"


TEMPLATES = {"date": _shown("yyyy-MM-dd"), "time": _shown("HH:mm:ss"), "datetime": _shown("yyyy-MM-dd HH:mm:ss"), "julianday": julianday, "unixepoch": unixepoch, "strftime": strftime}
