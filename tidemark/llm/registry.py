"""The queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

import importlib

import corpus_pipeline

#: query -> module; a module that SQL can check has it in ORACLE
MODULES = {
    "op1_line_dedup": "lines",
    "op2_mixing": "mixing",
    "op3_quality": "quality",
    "op4_lm_score": "lattice_lm",
    "op5_jaccard": "jaccard",
    "op6_url_filter": "urls",
    "op7_repeats": "repeats",
    "op8_neighbours": "neighbours",
    "op9_sentencepiece": "sentencepieces",
    "op10_tiff": "tiff",
}


def _module(name: str):
    return importlib.import_module(f"tidemark.llm.{name}")


def queries() -> dict:
    return {name: getattr(_module(m), name) for name, m in MODULES.items()} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(_module(m), "ORACLE", None) for name, m in MODULES.items()} | {"pipeline": corpus_pipeline.ORACLE_SQL}
    return {name: sql for name, sql in found.items() if sql}
