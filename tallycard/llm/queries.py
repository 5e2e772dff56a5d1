"""All queries of the corpus operators, for the entry module."""

from __future__ import annotations

from tallycard.llm import (  # noqa: F401
    bpe, chunks, compression, cross_tokens, decontaminate, lines, neardup, quality, repeats, resample, secret_scan, toxicity, warc,
)
from tallycard.llm.common import ORACLES, QUERIES  # noqa: F401
