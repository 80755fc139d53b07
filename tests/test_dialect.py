import pytest

from larkspur.dialect import glob_pattern, single, statements, tokens, translate
from larkspur.errors import ParseError
from larkspur.types import affinity, spark_type, storage_kind, truth
from pyspark.sql import types as T


@pytest.mark.parametrize(
    ("sql", "want"),
    [
        ('SELECT "a b", [c d]', "SELECT `a b` , `c d`"),
        ("SELECT 0x1F", "SELECT 31"),
        ("SELECT a FROM t LIMIT 5, 10", "SELECT a FROM t LIMIT 10 OFFSET 5"),
        ("SELECT a FROM t LIMIT 10 OFFSET 5", "SELECT a FROM t LIMIT 10 OFFSET 5"),
        ("SELECT a LIKE 'x%'", "SELECT a ILIKE 'x%'"),
        ("SELECT a IS b, a IS NOT b, a IS NULL, a IS NOT NULL", "SELECT a <=> b , a IS DISTINCT FROM b , a IS NULL , a IS NOT NULL"),
        ("SELECT a ISNULL, a NOTNULL, a NOT NULL", "SELECT a IS NULL , a IS NOT NULL , a IS NOT NULL"),
        ("SELECT 20 / 4, 20.0 / 4", "SELECT 20 DIV 4 , 20.0D / 4"),
        ("SELECT 'it''s', 'a\\b'", "SELECT 'it\\'s' , 'a\\\\b'"),
        ("SELECT a FROM t WHERE b = ?1 AND c = :x AND d = @y", "SELECT a FROM t WHERE b = :_1 AND c = :x AND d = :y"),
        ("SELECT max(a), max(a, b)", "SELECT max(a) , greatest(a, b)"),
        ("SELECT a -- note\n/* more */ FROM t", "SELECT a FROM t"),
        ("SELECT a != b", "SELECT a <> b"),
    ],
)
def test_translate(sql, want):
    assert translate(sql) == want


def test_integer_division_needs_integers():
    whole = lambda c: c in ("a", "b")
    assert translate("SELECT a / b, a / x, (a + 1) / 2, length(x) / 2", whole) == "SELECT a DIV b , a / x , (a + 1) DIV 2 , length(x) DIV 2"


def test_strings_are_left_alone():
    assert translate("SELECT 'LIMIT 1, 2 LIKE [x] 0x10'") == "SELECT 'LIMIT 1, 2 LIKE [x] 0x10'"


@pytest.mark.parametrize("sql", ["SELECT 1; SELECT 2", "", ";", "SELECT (1", "SELECT #"])
def test_not_one_statement(sql):
    with pytest.raises(ParseError):
        translate(single(sql))


def test_script():
    assert [len(s) for s in statements("SELECT 1; ; SELECT ';' ;")] == [2, 2]
    assert [t.kind for t in tokens("x'0F' 'a' \"b\" 1.5e3 ?2 c ->> d")] == ["blob", "string", "name", "number", "param", "word", "op", "word"]


def test_glob():
    import re

    assert re.search(glob_pattern("a*[0-9]?.c"), "axx7q.c")
    assert not re.search(glob_pattern("a*[0-9]?.c"), "axx7qxc")


@pytest.mark.parametrize(("declared", "want"), [("INT", "INTEGER"), ("BIGINT", "INTEGER"), ("CHARINT", "INTEGER"), ("VARCHAR(9)", "TEXT"), ("CLOB", "TEXT"), ("TEXT", "TEXT"), ("BLOB", "BLOB"), ("", "BLOB"), (None, "BLOB"), ("REAL", "REAL"), ("FLOAT", "REAL"), ("DOUBLE", "REAL"), ("DECIMAL", "NUMERIC"), ("BOOLEAN", "NUMERIC")])
def test_affinity(declared, want):
    assert affinity(declared) == want


def test_types():
    assert spark_type("DECIMAL", (10, 2)) == T.DecimalType(10, 2)
    assert storage_kind(T.IntegerType()) == "integer" and storage_kind(T.BinaryType()) == "blob"
    assert truth("x", T.LongType()) == "coalesce((x) <> 0, false)"
