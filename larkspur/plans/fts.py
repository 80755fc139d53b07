"""Full-text search as tables: postings, document sizes, BM25 ranks."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import EngineError, ParseError, SchemaError

K1, B = 1.2, 0.75

_LOWER = str.maketrans(ascii_uppercase, ascii_lowercase)

#: Tokenizers by name: a text column to an array of tokens.
TOKENIZERS: dict[str, Callable[[Column], Column]] = {}


def tokenizer(name: str) -> Callable:
    def add(make: Callable[[Column], Column]) -> Callable:
        TOKENIZERS[name] = make
        return make

    return add


@tokenizer("ascii")
def ascii_tokens(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits; all else separates."""
    return F.transform(F.regexp_extract_all(text, F.lit("[A-Za-z0-9]+"), F.lit(0)), F.lower)


@tokenizer("unicode")
def unicode_tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits of any script."""
    return F.transform(F.regexp_extract_all(text, F.lit("[\\p{L}\\p{N}]+"), F.lit(0)), F.lower)


def token_table(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, token, start, end): ASCII tokens with their byte offsets."""
    gaps = F.regexp_extract_all(F.concat(F.col(text), F.lit("")), F.lit("([^A-Za-z0-9]*)([A-Za-z0-9]+)"), F.lit(1))
    rows = docs.select(F.col(key), F.posexplode(F.arrays_zip(ascii_tokens(F.col(text)).alias("token"), gaps.alias("gap"))).alias("pos", "t"))
    from pyspark.sql.window import Window

    upto = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.octet_length("t.gap") + F.octet_length("t.token")).over(upto)
    return rows.select(key, "pos", F.col("t.token").alias("token"), (end - F.octet_length("t.token")).alias("start"), end.alias("end"))


@dataclass
class Index:
    """postings(term, doc, tf) and docsize(doc, dl); sums over all documents."""

    postings: DataFrame
    docsize: DataFrame

    @staticmethod
    def build(docs: DataFrame, key: str, text: str, tokens: str = "ascii") -> Index:
        if tokens not in TOKENIZERS:
            raise EngineError(f"no such tokenizer: {tokens}")
        cut = docs.select(F.col(key).alias("doc"), TOKENIZERS[tokens](F.coalesce(F.col(text), F.lit(""))).alias("tokens"))
        postings = cut.select("doc", F.explode("tokens").alias("term")).groupBy("term", "doc").agg(F.count("*").alias("tf"))
        return Index(postings, cut.select("doc", F.size("tokens").cast("long").alias("dl")))

    def match(self, terms: list[str], every: bool = False) -> DataFrame:
        """(doc, score): BM25 over the query's terms; with ``every`` only documents that hold them all.

        The terms go to the postings as a filter, so only their postings are shuffled.
        """
        wanted = sorted({t.lower() for t in terms})
        stats = self.docsize.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
        hits = self.postings.where(F.col("term").isin(wanted))
        df = hits.groupBy("term").agg(F.count("*").alias("df"))  # one row for each term of the query
        rows = hits.join(F.broadcast(df), "term").join(self.docsize, "doc").join(F.broadcast(stats))
        out = rows.groupBy("doc").agg(F.sum(bm25(F.col("tf"), F.col("dl"), F.col("avgdl"), F.col("n"), F.col("df"))).alias("score"), F.count("*").alias("held"))
        return (out.where(F.col("held") == len(wanted)) if every else out).select("doc", "score")


_QUERY = re.compile(r'\s*(?:"((?:[^"]|"")*)"|([()+:*])|([^\s()"+:*]+))')


def matching(columns: list[str], query: str) -> str:
    """SQL for ``columns MATCH query``: terms, phrases, prefixes, ``column:``, AND, OR, NOT, parentheses.

    A term may be in any of the columns.  Adjacent terms are joined by AND; NOT binds before AND,
    and AND before OR.  A phrase without a token matches nothing.
    """
    words: list[tuple[str, str]] = []  # (kind, text): "phrase", "word" or the sign itself
    at, query = 0, query.rstrip()
    while at < len(query):
        m = _QUERY.match(query, at)
        if m is None:
            raise ParseError(f"a quote is not closed: {query}")
        words.append(("phrase", m[1].replace('""', '"')) if m[1] is not None else (m[2], m[2]) if m[2] else ("word", m[3]))
        at = m.end()

    def peek(k: int = 0) -> tuple[str, str]:
        return words[k] if k < len(words) else ("", "")

    def either(among: list[str]) -> str:
        out = both(among)
        while peek() == ("word", "OR"):
            words.pop(0)
            out = f"({out} OR {both(among)})"
        return out

    def both(among: list[str]) -> str:
        out = without(among)
        while peek()[0] in ("word", "phrase", "(") and peek() != ("word", "OR"):
            if peek() == ("word", "AND"):
                words.pop(0)
            out = f"({out} AND {without(among)})"
        return out

    def without(among: list[str]) -> str:
        out = primary(among)
        while peek() == ("word", "NOT"):
            words.pop(0)
            out = f"({out} AND NOT {primary(among)})"
        return out

    def primary(among: list[str]) -> str:
        kind, text = words.pop(0) if words else ("", "")
        if kind == "(":
            out = either(among)
            if not words or words.pop(0)[0] != ")":
                raise ParseError(f"a parenthesis is not closed: {query}")
            return out
        if kind not in ("word", "phrase") or kind == "word" and text in ("AND", "OR", "NOT", "NEAR"):
            raise ParseError(f"a term was expected in the query: {query}")
        if peek()[0] == ":":
            words.pop(0)
            only = [c for c in among if c.strip("`").lower() == text.lower()]
            if not only:
                raise SchemaError(f"no such column: {text}")
            return primary(only)
        while peek()[0] == "+" and peek(1)[0] in ("word", "phrase"):
            text += " " + words[1][1]
            del words[:2]
        found = re.findall("[a-z0-9]+", text.translate(_LOWER))
        prefix = peek()[0] == "*" and bool(words.pop(0))
        if not found:
            return "false"
        sought = " " + " ".join(found) + ("" if prefix else " ")
        return "(" + " OR ".join(f"coalesce(instr(concat(' ', regexp_replace(translate(cast({c} AS string), '{ascii_uppercase}', '{ascii_lowercase}'), '[^a-z0-9]+', ' '), ' '), '{sought}') > 0, false)" for c in among) + ")"

    out = either(columns) if words else "false"
    if words:
        raise ParseError(f"text goes on after the query: {query}")
    return out


def bm25(tf: Column, dl: Column, avgdl: Column, n: Column, df: Column) -> Column:
    idf = F.ln((n - df + 0.5) / (df + 0.5) + 1)
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))
