"""Scoring year files as they arrive: the batch operators on a streaming frame.

Only row features and joins to small learned tables take part, so the query keeps no
state; ranks inside a peer group need the whole group and stay a batch step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from cohortscope import vocab as V
from cohortscope.operators import blocks, forensic, peer, preprocess, scores


def score_arrivals(panel: DataFrame, medians: DataFrame, statistics: dict) -> DataFrame:
    """Clean, core, peer z-score, forensic-row, network and flag features of new rows."""
    core = blocks.core_features(preprocess.preprocess(panel, medians))
    df = core.join(statistics["peers"], V.PEER_KEYS, "left")
    spare = [c for c in df.columns if c.endswith(("_mean", "_std", "_median", "_p95"))
             and c not in core.columns]
    df = peer.encode_rates(peer.z_scores(df).drop(*spare), statistics["rates"],
                           statistics["mean"])
    df = scores.network_features(forensic.forensic_features(df), statistics.get("employers"))
    return scores.impossibility_flags(df)
