"""All queries of the subpackage."""

from brinewave.llm import (  # noqa: F401
    bpe,
    crosstoken,
    decontaminate,
    extract,
    language,
    matroska,
    neardup,
    ngramjoin,
    quality,
    replytree,
    urltree,
    vectorcode,
    warc,
)
from brinewave.llm.common import LLM_QUERIES, LLM_SQL

__all__ = ["LLM_QUERIES", "LLM_SQL"]
