"""Where queries register themselves, with the SQL that a plain engine gives the same rows by."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .fixtures import KEYED
from .fixtures import SQL as FIXTURE_SQL

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its name. sql may use the derived tables of fixtures.SQL, whose text is put before it."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = whole_sql(sql)
        return f

    return put


def whole_sql(body: str) -> str:
    needed: list[str] = []

    open_: set[str] = set()

    def visit(text: str) -> None:
        for name, definition in FIXTURE_SQL.items():
            if name not in needed and name not in open_ and re.search(rf"\b{name}\b", text):
                open_.add(name)
                visit(definition)
                if name not in needed:
                    needed.append(name)

    visit(body)
    body = body.strip()
    parts = [f"{KEYED.get(name, name)} AS ({FIXTURE_SQL[name].strip()})" for name in needed]
    if found := re.match(r"WITH (RECURSIVE )?", body):
        parts.append(body[found.end() :])
        return f"WITH RECURSIVE {', '.join(parts)}"
    return f"WITH RECURSIVE {', '.join(parts)} {body}" if parts else body
