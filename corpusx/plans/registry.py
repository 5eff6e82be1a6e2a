"""All registered queries of the library with their SQL equivalents."""

from __future__ import annotations

from corpusx.plans import authorship, campaign, evidence, judging, lineage, ordinal, overlap_queries, provenance_queries, records, recovery, retrieval, reviews, sections, selection, shaping, voices

MODULES = (overlap_queries, shaping, retrieval, judging, provenance_queries, reviews, evidence, campaign, sections, selection, records, lineage, recovery, ordinal, authorship, voices)


def flagship(spark, sf_dir):
    return overlap_queries.overlap_verdict(spark, sf_dir)


def queries() -> dict:
    return {k: q for m in MODULES for k, (q, _) in m.Q.items()}


def oracle_sql() -> dict:
    return {k: s for m in MODULES for k, (_, s) in m.Q.items() if s}
