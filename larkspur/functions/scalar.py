"""Numbers, nulls and kinds."""

from __future__ import annotations

_INTS = "('tinyint','smallint','int','bigint','boolean')"
_REALS = "('float','double')"


def absolute(x: str) -> str:
    # The least integer has no positive counterpart; it gives the greatest.
    return f"CASE WHEN typeof({x}) = 'bigint' AND ({x}) = -9223372036854775807 - 1 THEN 9223372036854775807 ELSE abs({x}) END"


def typeof(x: str) -> str:
    return f"CASE WHEN ({x}) IS NULL THEN 'null' WHEN typeof({x}) IN {_INTS} THEN 'integer' WHEN typeof({x}) IN {_REALS} OR typeof({x}) LIKE 'decimal%' THEN 'real' WHEN typeof({x}) = 'binary' THEN 'blob' ELSE 'text' END"


def rounded(x: str, n: str = "0") -> str:
    return f"round(cast({x} AS double), {n})"


def sign(x: str) -> str:
    return f"cast(signum(cast({x} AS double)) AS bigint)"


def largest(*xs: str) -> str:
    return f"max({xs[0]})" if len(xs) == 1 else f"greatest({', '.join(xs)})"


def smallest(*xs: str) -> str:
    if len(xs) == 1:
        return f"min({xs[0]})"
    return f"CASE WHEN {' OR '.join(f'({x}) IS NULL' for x in xs)} THEN NULL ELSE least({', '.join(xs)}) END"


def ifnull(a: str, b: str) -> str:
    return f"coalesce({a}, {b})"


def coalesced(*xs: str) -> str:
    return f"coalesce({', '.join(xs)})" if xs else "NULL"


def truth(x: str) -> str:
    """A value as a condition."""
    return f"(CASE WHEN typeof({x}) = 'string' THEN length(cast({x} AS string)) > 0 ELSE try_cast({x} AS double) <> 0 END)"


def iif(test: str, yes: str, no: str = "NULL") -> str:
    return f"CASE WHEN {truth(test)} THEN {yes} ELSE {no} END"


def randomblob(n: str) -> str:
    # 32 bytes from each digest of a random identifier.
    return f"substring(unhex(array_join(transform(sequence(0, cast(greatest({n}, 1) AS int) div 32), (x, i) -> sha2(concat(uuid(), cast(i AS string)), 256)), '')), 1, cast(greatest({n}, 1) AS int))"


def same(x: str) -> str:
    return f"({x})"


def likelihood(x: str, _share: str) -> str:
    return f"({x})"


def random() -> str:
    return "cast(floor((rand() - 0.5D) * 18446744073709549568D) AS bigint)"


def log(a: str, b: str | None = None) -> str:
    return f"log10({a})" if b is None else f"log({a}, {b})"


TEMPLATES = {
    "abs": absolute,
    "typeof": typeof,
    "round": rounded,
    "sign": sign,
    "max": largest,
    "min": smallest,
    "ifnull": ifnull,
    "coalesce": coalesced,
    "iif": iif,
    "likely": same,
    "unlikely": same,
    "likelihood": likelihood,
    "random": random,
    "randomblob": randomblob,
    "log": log,
    "ceiling": lambda x: f"ceil({x})",
    "trunc": lambda x: f"CASE WHEN ({x}) < 0 THEN ceil({x}) ELSE floor({x}) END",
    "mod": lambda a, b: f"(cast({a} AS double) % cast({b} AS double))",
    "pow": lambda a, b: f"power({a}, {b})",
}
