"""Suites over text and key documents: required tokens, priors, answer keys, declared totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passledger import constants as C
from passledger import functions as fn
from passledger.expect.core import blank, row_violations

PRIORS_TAG = "priors/v1"
KEY_TAG = "answer-key/v1"


def token_suite(docs: DataFrame, tokens: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, token, problem): 'missing' or 'promissory' for required ``TOKEN: value`` lines."""
    checks = []
    for token in tokens:
        value = fn.token_value(F.col(text), token)
        problem = F.when(value.isNull(), "missing").when(fn.is_promissory(value), "promissory")
        checks.append(F.when(problem.isNotNull(), F.struct(F.lit(token).alias("token"), problem.alias("problem"))))
    return docs.select(key, F.explode(F.array_compact(F.array(*checks))).alias("v")).select(key, "v.*")


def priors_suite(targets: DataFrame, documents: DataFrame | None = None, key: str = "doc_id", tag: str = PRIORS_TAG) -> DataFrame:
    """(doc_id, rule, message) for priors: document tag, non-empty, required texts, unique ids, family, relative path."""
    rules = [(f"missing-{f}", f"target missing {f}", blank(f)) for f in ("id", "path", "title")]
    rules += [
        ("family", "family off-enum", ~F.coalesce(F.col("family").isin(*C.LENSES), F.lit(False))),
        ("path", "path must be relative", ~fn.is_safe_relative("path")),
    ]
    duplicates = targets.filter(~blank("id")).groupBy(key, "id").agg(F.count("*").alias("n")).filter("n > 1").select(
        key, F.lit("duplicate").alias("rule"), F.lit("duplicate id").alias("message")
    )
    out = row_violations(targets, [key], rules).unionByName(duplicates)
    if documents is None:
        return out
    filled = targets.groupBy(key).agg(F.count("*").alias("n_targets"))
    heads = documents.join(filled, key, "left")
    head_rules = [
        ("tag", "unsupported tag", ~F.coalesce(F.col("schema") == tag, F.lit(False))),
        ("empty", "no targets", F.coalesce("n_targets", F.lit(0)) == 0),
    ]
    return out.unionByName(row_violations(heads, [key], head_rules))


def key_suite(
    slots: DataFrame, files: DataFrame, changed: DataFrame, added: DataFrame, key: str = "key_id",
    families: list[str] | None = None, per_family: int = 2, forbidden: str | None = None,
    excluded_segments: list[str] | None = None, min_reason: int = 12,
) -> DataFrame:
    """(key_id, rule, message) for answer keys.

    ``slots``: key_id, slot, family, path, line, reachability; ``files``: path, lines (number of lines);
    ``changed``: key_id, path; ``added``: key_id, path, text (lines the plants added).
    """
    families = families or C.LENSES
    size = per_family * len(families)
    segments = [s.lower() for s in (excluded_segments or [])]
    facts = slots.groupBy(key).agg(
        F.count("*").alias("n"), F.count_distinct("slot").alias("d"), F.min("slot").alias("lo"), F.max("slot").alias("hi"),
        F.count_distinct("path", "line").alias("loci"),
    )
    whole = [
        ("size", "wrong number of slots", F.col("n") != size),
        ("slots", "slots must be 1..n", (F.col("d") != size) | (F.col("lo") != 1) | (F.col("hi") != size)),
        ("loci", "duplicate locus", F.col("loci") != F.col("n")),
    ]
    per = slots.groupBy(key, "family").agg(F.count("*").alias("n"), F.count_distinct("path").alias("files"))
    spread = [
        ("spread", "family spread", (F.col("n") != per_family) | ~F.coalesce(F.col("family").isin(*families), F.lit(False))),
        ("placement", "same-family slots share a file", F.col("files") != F.col("n")),
    ]
    known = slots.join(files.select("path", "lines"), "path", "left").join(
        changed.select(key, "path").distinct().withColumn("_changed", F.lit(True)), [key, "path"], "left"
    )
    rows = [
        ("path", "path must be relative", blank("path") | ~fn.is_safe_relative("path")),
        ("forbidden-path", "excluded path segment", fn.has_segment("path", segments, casefold=True) if segments else F.lit(False)),
        ("unchanged", "path was not modified", F.col("_changed").isNull()),
        ("line", "line must be positive", F.col("line").isNull() | (F.col("line") < 1)),
        ("outside", "line outside file", F.col("line") > F.coalesce("lines", F.lit(0))),
        ("reason", "rationale too short", F.length(F.trim(F.coalesce("reachability", F.lit("")))) < min_reason),
    ]
    keyed = slots.select(key, "path").distinct()
    stray = changed.select(key, "path").distinct().join(keyed, [key, "path"], "left_anti").select(
        key, F.lit("cover").alias("rule"), F.lit("changed file without a slot").alias("message")
    )
    out = (
        row_violations(facts, [key], whole).unionByName(row_violations(per, [key], spread))
        .unionByName(row_violations(known, [key], rows)).unionByName(stray)
    )
    if forbidden is not None:
        out = out.unionByName(row_violations(added, [key], [("marker", "marker word on an added line", F.col("text").rlike(forbidden))]))
    return out


def declared_totals(findings: DataFrame, verdict_rows: DataFrame, declared: DataFrame, key: str = "run_id") -> DataFrame:
    """(run_id, rule, message): declared totals against totals derived from the evidence rows; reach columns of critical rows.

    ``findings``: run_id, tier, reach_domain, reach_stage, reach_method, reach_authorizer; ``declared``: run_id, rows_total,
    tier_c, tier_h, tier_m, tier_l, courted.
    """
    tier = F.upper(F.trim("tier"))
    derived = findings.groupBy(key).agg(
        F.count("*").alias("n"), *[F.count_if(tier.startswith(p)).alias(f"d_{c}") for c, p in (("c", "CRI"), ("h", "HIG"), ("m", "MED"), ("l", "LOW"))]
    )
    courted = verdict_rows.groupBy(key).agg(F.count("*").alias("d_courted"))
    table = declared.join(derived, key, "left").join(courted, key, "left").fillna(0, ["n", "d_c", "d_h", "d_m", "d_l", "d_courted"])
    rules = [("rows", "rows total differs", F.col("rows_total") != F.col("n")), ("courted", "courted differs", F.col("courted") != F.col("d_courted"))]
    rules += [(f"tier_{c}", f"tier {c} differs", F.col(f"tier_{c}") != F.col(f"d_{c}")) for c in "chml"]
    reach = ["reach_domain", "reach_stage", "reach_method", "reach_authorizer"]
    gaps = row_violations(findings.filter(tier.startswith("CRIT")), [key], [("reach", f"critical row misses {c}", blank(c)) for c in reach])
    return row_violations(table, [key], rules).unionByName(gaps)
