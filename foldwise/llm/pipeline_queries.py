"""All queries of this package, and the pipeline at the top of the repository."""

from __future__ import annotations

import corpus_pipeline
from foldwise.llm.queries import ORACLES, QUERIES

QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL

__all__ = ["ORACLES", "QUERIES"]
