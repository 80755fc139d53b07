"""The queries of the operators, by name."""

from __future__ import annotations

import corpus_pipeline

from . import ann, decontaminate, html, langid, mixing, ppm, quality, simhash, suffixdedup, tokens

MODULES = (mixing, simhash, suffixdedup, ppm, tokens, langid, html, decontaminate, quality, ann)


def queries() -> dict:
    out = {"pipeline": corpus_pipeline.run}
    for module in MODULES:
        out |= module.QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for module in MODULES:
        out |= getattr(module, "ORACLE_SQL", {})
    return out
