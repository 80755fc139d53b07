"""A command line: statements to the semicolon, rows as text joined by |.

``python -m larkspur.shell [folder]`` with the tables of a folder of Parquet files.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame

from .engine import Engine
from .errors import EngineError

HELP = ".help  this text\n.tables  names of tables and views\n.schema [table]  columns\n.quit, .exit  leave"


def lines(result: DataFrame | int) -> Iterator[str]:
    """Rows one by one; null is empty."""
    if isinstance(result, DataFrame):
        for row in result.toLocalIterator():
            yield "|".join("" if v is None else str(v) for v in row)


def run(engine: Engine, source: Iterable[str], say=print) -> None:
    held = ""
    for line in source:
        word = line.strip()
        if not held and word.startswith("."):
            command, *rest = word.split()
            if command in (".quit", ".exit"):
                return
            if command == ".help":
                say(HELP)
            elif command == ".tables":
                say("\n".join(sorted([*engine.catalog.tables, *engine.catalog.views])))
            elif command == ".schema":
                for name, t in sorted(engine.catalog.tables.items()):
                    if not rest or rest[0].lower() == name:
                        columns = ", ".join(f"{f.name} {t.declared.get(f.name.lower()) or f.dataType.simpleString()}" for f in t.df.schema.fields)
                        say(f"CREATE TABLE {name} ({columns});")
            else:
                say(f"unknown command: {command}")
            continue
        held += line if line.endswith("\n") else line + "\n"
        if not word.endswith(";"):
            continue
        try:
            for result in engine.script(held):
                for text in lines(result):
                    say(text)
        except EngineError as e:
            say(f"Error: {e}")
        except Exception as e:  # noqa: BLE001  Spark's analysis and run-time errors
            say(f"Error: {str(e).splitlines()[0]}")
        held = ""


def main(args: list[str]) -> None:
    from pathlib import Path

    from .session import session

    engine = Engine(session())
    if args:
        engine.open_folder(args[0], sorted(p.stem for p in Path(args[0]).glob("*.parquet")))
    run(engine, sys.stdin)


if __name__ == "__main__":
    main(sys.argv[1:])
