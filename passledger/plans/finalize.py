"""Finalize a review: choose verdicts, refuse or build findings, check conservation, settle chains."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from passledger.operators import verdicts as ve


@dataclass
class Final:
    findings: DataFrame
    violations: DataFrame
    conservation: DataFrame
    chains: DataFrame | None = None


def finalize(candidates: DataFrame, documents: DataFrame, hops: DataFrame | None = None, scope: list[str] | None = None) -> Final:
    """``documents`` may hold several verdicts per candidate (per_file, n_keys, ord). Rows of ``violations`` mean refusal."""
    verdicts = ve.pick_verdict(documents)
    found = ve.apply_verdicts(candidates, verdicts)
    chains = None
    if hops is not None:
        chains = ve.validate_chains(hops, found.selectExpr("candidate_id AS finding_key", "status"))
    return Final(found, ve.verdict_violations(candidates, verdicts), ve.conservation(found, candidates, scope), chains)
