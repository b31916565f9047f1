"""The registered queries of this subpackage."""

from __future__ import annotations

from cohortscope.llm import (alignment, chat, fingerprints, hard_negatives, jaccard, language,
                             mixing, pieces, pii, quality_model, quality_rules, repeats, warc)

MODULES = [fingerprints, repeats, pii, pieces, quality_model, warc, language, jaccard,
           mixing, quality_rules, hard_negatives, chat, alignment]
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLE = {k: q for m in MODULES for k, q in m.ORACLE.items()}
