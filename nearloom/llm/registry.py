"""What the entry file adds to the library's queries."""

from __future__ import annotations

import corpus_pipeline
from nearloom.llm import oracle
from nearloom.llm import queries as operators


def queries() -> dict:
    """Registered queries of the ten operators and of the pipeline."""
    return {**operators.REGISTRY, "pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of those that SQL can express."""
    return {**oracle.build(), **({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})}
