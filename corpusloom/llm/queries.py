"""The pN_ queries of this subpackage, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import linkage, mixing, nearcopy, overlap, packing, sentences, topn, truncation
from corpusloom.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    """Each query over its whole tables."""
    return {
        "p2_found": lambda s, d: topn.p2_found(table(s, d, "pool_chunks")),
        "p3_found": lambda s, d: overlap.p3_found(table(s, d, "question_items")),
        "p3_overlap_report": lambda s, d: overlap.overlap_report(table(s, d, "question_items")),
        "p4_found": lambda s, d: nearcopy.p4_found(table(s, d, "pool_chunks")),
        "p5_found": lambda s, d: linkage.p5_found(table(s, d, "paper_records"), table(s, d, "web_results")),
        "p5_matches": lambda s, d: linkage.link(table(s, d, "paper_records"), table(s, d, "web_results")),
        "p6_found": lambda s, d: truncation.p6_found(table(s, d, "pool_chunks")),
        "p6_cut_share": lambda s, d: truncation.cut_share(table(s, d, "pool_chunks")),
        "p7_assignment": lambda s, d: packing.hierarchical(table(s, d, "documents"), table(s, d, "pack_sizes")),
        "p7_by_capacity": lambda s, d: packing.by_capacity(table(s, d, "documents"), table(s, d, "pack_sizes")),
        "p7_fill": lambda s, d: packing.fill_report(packing.hierarchical(table(s, d, "documents"), table(s, d, "pack_sizes"))),
        "p8_mixture": lambda s, d: mixing.mixture(table(s, d, "documents"), table(s, d, "mix_targets")),
        "p8_shares": lambda s, d: mixing.mix_report(mixing.mixture(table(s, d, "documents"), table(s, d, "mix_targets")), table(s, d, "mix_targets")),
        "p8_largest_shares": lambda s, d: mixing.mix_report(mixing.mixture(table(s, d, "documents"), table(s, d, "mix_targets"), budget="largest"), table(s, d, "mix_targets")),
        "p9_found": lambda s, d: sentences.p9_found(table(s, d, "documents")),
        "p6_branches": lambda s, d: truncation.branches(table(s, d, "pool_chunks")),
        "p4_near_same_groups": lambda s, d: nearcopy.near_same_groups(table(s, d, "pool_chunks")),
    }


def oracle_sql() -> dict[str, str]:
    """SQL over the whole tables; the other queries are tested against brute force in tests/llm."""
    return {
        "p2_found": """
            SELECT query, place, row_id FROM (
              SELECT source.query AS query, row_id,
                     CAST(row_number() OVER (PARTITION BY source.query
                       ORDER BY source.relevance_score DESC, source.rank ASC NULLS LAST, row_id ASC) AS INTEGER) AS place
              FROM pool_chunks
              WHERE source.query IS NOT NULL AND source.relevance_score IS NOT NULL AND NOT isnan(source.relevance_score))
            WHERE place <= 5""",
    }
