"""Corpus profile: census, roll-ups, units, detector hits, cost."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from passledger import constants as C
from passledger.operators import corpus as co
from passledger.operators import detect as de


@dataclass
class Profile:
    files: DataFrame
    classes: DataFrame
    repos: DataFrame
    totals: DataFrame
    units: DataFrame
    unit_files: DataFrame
    hits: DataFrame
    cost: DataFrame


def profile_corpus(corpus: DataFrame, scope: list[str] | None = None, floor: int = C.UNIT_CAP_FLOOR, detectors=None) -> Profile:
    """One scan for the census and one for the sweep; everything after works on counts and hits."""
    files = co.census(corpus, scope)
    repos = co.repo_rollup(files, scope)
    totals = co.corpus_totals(repos, scope, floor)
    packed = co.pack_units(repos, scope, floor)
    kept = de.exclude_dirs(corpus)
    hits = de.sweep_lines(kept, detectors).unionByName(de.sweep_files(kept))
    return Profile(
        files, co.class_rollup(files, scope), repos, totals, co.unit_sizes(packed, scope), co.unit_listing(files, packed, scope),
        hits, co.cost_estimate(totals),
    )
