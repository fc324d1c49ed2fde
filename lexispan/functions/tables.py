"""Table functions for SQL: the facts of one source, to be joined laterally to a table of sources."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from lexispan.operators.extract import TABLES, file_facts
from lexispan.session import ship

#: SQL names of the functions; each takes (file_path, language, content) and gives the rows of its fact table.
NAMES = {"symbols": "source_symbols", "imports": "source_imports", "scopes": "source_scopes", "scope_symbols": "source_scope_symbols", "identifiers": "source_identifiers", "syntax_nodes": "source_nodes"}


def table_function(fact: str):
    """The rows of one fact table; a null language or content has none."""

    class Facts:
        def eval(self, file_path: str, language: str, content: str):
            if language is not None and content is not None:
                for row in file_facts(file_path, language, content.encode())[fact]:
                    yield tuple(row.get(c) for c in columns)

    columns = [c.split()[0] for c in _fields(TABLES[fact])]
    return udtf(Facts, returnType=TABLES[fact])


def _fields(schema: str) -> list[str]:
    """Top-level fields of a schema's text."""
    out, depth, own = [], 0, ""
    for c in schema:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(own.strip())
            own = ""
        else:
            own += c
    return [*out, own.strip()]


def register(spark: SparkSession) -> list[str]:
    """Register all table functions with a session; their names."""
    ship(spark)
    for fact, name in NAMES.items():
        spark.udtf.register(name, table_function(fact))
    return list(NAMES.values())
