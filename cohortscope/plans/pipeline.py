"""The nine-phase feature pipeline as staged DataFrame transformations.

``run`` writes stages where a table feeds several consumers (statistics, ranking,
probing); between them everything is one lazy plan.  The lazy steps (``core_rows``,
``evidence_rows``, ``finish``) serve whoever wants a few columns: nothing wide is written
and Spark reads and computes only what these columns need.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortscope.operators import blocks, forensic, peer, preprocess, scores
from cohortscope.session import stage


@dataclass
class FittedPanel:
    """Stages of one run: ``core`` (phases 1-2), learned tables, ``scored`` (all phases)."""

    core: DataFrame
    statistics: dict
    evidence: DataFrame
    scored: DataFrame
    medians: DataFrame | None = field(default=None)


def core_rows(panel: DataFrame, medians: DataFrame | None = None) -> DataFrame:
    """Phases 1 and 2, lazy: a projection over the panel."""
    return blocks.core_features(preprocess.preprocess(panel, medians))


def numbered(core: DataFrame) -> DataFrame:
    """Staged with a stable row id."""
    return stage(core.withColumn("row_id", F.monotonically_increasing_id()), "core")


def build_core(panel: DataFrame, medians: DataFrame | None = None) -> DataFrame:
    """Phases 1 and 2, staged with a stable row id."""
    return numbered(core_rows(panel, medians))


def flagged(core: DataFrame) -> DataFrame:
    """Row part of phase 5, and 7: features and flags that need no other rows, lazy."""
    return scores.impossibility_flags(forensic.forensic_features(core))


def evidence_rows(core: DataFrame, statistics: dict, ranked: list[str] | None = None) -> DataFrame:
    """Phases 4, row part of 5, and 7, lazy; ``ranked`` names the columns to rank (all)."""
    return flagged(peer.peer_scores(core, statistics["peers"], statistics["rates"],
                                    statistics["mean"], ranked=ranked))


def build_evidence(core: DataFrame, statistics: dict) -> DataFrame:
    """Everything the final scores probe, staged."""
    return stage(evidence_rows(core, statistics), "evidence")


def finish(evidence: DataFrame, statistics: dict) -> DataFrame:
    """Forensic scores, network features and composite scores over the staged evidence."""
    probe = stage(forensic.two_valued(evidence), "two-valued")
    df = evidence.join(probe, "tax_year")
    df = forensic.forensic_scores(df)
    df = scores.network_features(df, statistics.get("employers"))
    df = scores.composite_scores(df)
    return df.drop(*[c for c in df.columns if c.startswith("two_")])


def run(panel: DataFrame) -> FittedPanel:
    """All phases.  ``scored`` stays lazy over the staged evidence."""
    medians = preprocess.fit_imputation(panel)
    core = build_core(panel, medians)
    statistics = peer.fit_statistics(core)
    evidence = build_evidence(core, statistics)
    return FittedPanel(core, statistics, evidence, finish(evidence, statistics), medians)
