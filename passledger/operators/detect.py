"""Detector sweep: regex detectors over lines and files in one pass over the corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passledger import constants as C
from passledger import functions as fn

Detector = tuple[str, str, str, bool]
HIT = "array<struct<detector:string,class:string,evidence:string>>"


def exclude_dirs(corpus: DataFrame, dirs: list[str] | None = None, ledger: DataFrame | None = None) -> DataFrame:
    """Drop paths under (or equal to) an excluded directory, and exact paths of a quarantine ledger."""
    dirs = C.SWEEP_EXCLUDED_DIRS if dirs is None else dirs
    out = corpus
    if dirs:
        out = out.filter(~fn.any_of([(F.col("path") == d) | F.col("path").startswith(d.rstrip("/") + "/") for d in dirs]))
    if ledger is not None:
        out = out.join(ledger.select(F.col("quarantine").alias("path")), "path", "left_anti")
    return out


def is_comment(line: Column, prefixes: list[str]) -> Column:
    marks = "|".join("".join("\\" + ch if ch in "*+?.()[]{}|^$/#-" else ch for ch in p) for p in prefixes)
    return line.rlike(rf"(?U)^\s*(?:{marks})")


def is_test_path(path: Column) -> Column:
    return path.rlike(C.TEST_PATH_PATTERN)


def _is_builtin(detector: Detector) -> bool:
    return any(detector[0] == d[0] and detector[2].removeprefix("(?U)") == d[2] for d in C.LINE_DETECTORS)


def _may_match(content: Column, detector: Detector) -> Column:
    """Whole-text condition every line match of a built-in detector implies: one of its literals."""
    return fn.any_of([content.contains(w) for w in C.DETECTOR_LITERALS[detector[0]]])


def _evidence(line: Column, pattern: str, hashed: bool) -> Column:
    match = F.regexp_extract(line, pattern, 0)
    if hashed:
        return F.concat(F.lit("REDACTED:sha256:"), F.substring(F.sha2(match, 256), 1, 12))
    return F.substring(match, 1, 80)


def sweep_lines(
    corpus: DataFrame,
    detectors: list[Detector] | None = None,
    file_pattern: str | None = C.SWEEP_FILE_PATTERN,
    exempt: list[str] | None = None,
) -> DataFrame:
    """(path, line, detector, class, evidence): first match of each detector on each line.

    With built-in detectors only, files without any of their literals are dropped before a line is split; a caller's own
    pattern may mean something else on a whole text than on a line, so it is tried on lines alone. One projection tests all
    detectors per line, without a line x detector product, and evidence is cut out for hits only.
    """
    detectors = C.LINE_DETECTORS if detectors is None else detectors
    exempt = C.SUPPRESSION_EXEMPT if exempt is None else exempt
    rows = corpus
    if file_pattern is not None:
        name = fn.file_name("path")
        rows = rows.filter(name.rlike(file_pattern) | (name == C.SWEEP_FILE_NAME))
    if all(_is_builtin(d) for d in detectors):
        rows = rows.filter(fn.any_of([_may_match(F.col("content"), d) for d in detectors]))
    lines = rows.select(
        *[c for c in rows.columns if c != "content"], is_test_path(F.col("path")).alias("_test"),
        F.posexplode(fn.split_lines("content")).alias("_pos", "_text"),
    ).filter(~is_comment(F.col("_text"), C.COMMENT_PREFIXES))
    tests, evidence = [], None
    for i, detector in enumerate(detectors):
        pattern = fn.unicode_pattern(detector[2])
        hit = F.col("_text").rlike(pattern)
        if detector[0] not in exempt:
            hit = ~F.col("_test") & hit
        tests.append(F.when(hit, F.lit(i)))
        found = _evidence(F.col("_text"), pattern, detector[3])
        evidence = F.when(F.col("_i") == i, found) if evidence is None else evidence.when(F.col("_i") == i, found)
    keep = [c for c in corpus.columns if c != "content"]
    hits = lines.select(
        *keep, (F.col("_pos") + 1).cast("bigint").alias("line"), "_text", F.explode(F.array_compact(F.array(*tests))).alias("_i")
    )
    label = lambda at: F.element_at(F.array(*[F.lit(d[at]) for d in detectors]), F.col("_i") + 1)
    return hits.select(*keep, "line", label(0).alias("detector"), label(1).alias("class"), evidence.alias("evidence"))


def sweep_files(corpus: DataFrame) -> DataFrame:
    """File-level supply-chain detectors: wrapper without a checksum pin, floating versions."""
    rows = corpus.filter(~is_test_path(F.col("path")))
    name = fn.file_name("path")
    keep = [c for c in corpus.columns if c != "content"]
    unpinned = rows.filter(
        (name == C.WRAPPER_FILE) & F.col("content").contains(C.WRAPPER_URL_KEY)
        & ~F.col("content").rlike(fn.unicode_pattern(C.WRAPPER_PIN_PATTERN))
    )
    indexed = F.transform(fn.split_lines("content"), lambda t, i: F.when(t.contains(C.WRAPPER_URL_KEY), i + 1))
    wrapper = unpinned.select(
        *keep, F.array_min(F.array_compact(indexed)).cast("bigint").alias("line"), F.lit("wrapper-sha256").alias("detector"),
        F.lit("supply-chain-pinning").alias("class"), F.lit("distributionUrl without distributionSha256Sum").alias("evidence"),
    )
    pattern = fn.unicode_pattern(C.FLOATING_PATTERN)
    floating = (
        rows.filter(name.rlike(C.FLOATING_FILE_PATTERN)).filter(F.col("content").rlike(pattern))
        .select(*keep, F.posexplode(fn.split_lines("content")).alias("_pos", "_text"))
        .filter(~is_comment(F.col("_text"), C.FLOATING_COMMENT_PREFIXES) & F.col("_text").rlike(pattern))
        .select(
            *keep, (F.col("_pos") + 1).cast("bigint").alias("line"), F.lit("floating-version").alias("detector"),
            F.lit("supply-chain-pinning").alias("class"), F.substring(F.regexp_extract("_text", pattern, 0), 1, 80).alias("evidence"),
        )
    )
    return wrapper.unionByName(floating)


def lint_lines(corpus: DataFrame, policy: list[tuple[str, str]], exceptions: DataFrame | None = None) -> DataFrame:
    """(path, line, label) where a forbidden pattern occurs, minus (path, label) exceptions."""
    tests = [F.when(F.col("_text").rlike(fn.unicode_pattern(p)), F.lit(label)) for label, p in policy]
    lines = corpus.select("path", F.posexplode(fn.split_lines("content")).alias("_pos", "_text"))
    hits = lines.select("path", (F.col("_pos") + 1).cast("bigint").alias("line"), F.explode(F.array_compact(F.array(*tests))).alias("label"))
    return hits.join(exceptions.select("path", "label"), ["path", "label"], "left_anti") if exceptions is not None else hits


def pattern_recall(samples: DataFrame, patterns: DataFrame, floor: float = C.PATTERN_RECALL_FLOOR) -> DataFrame:
    """Per family of ``samples`` (family, text): share matched by any of its ``patterns`` (family, pattern), against the floor."""
    known = patterns.groupBy("family").agg(F.collect_set("pattern").alias("_patterns"))
    hit = F.coalesce(F.exists("_patterns", lambda p: F.rlike(F.col("text"), p)), F.lit(False))
    return samples.join(known, "family", "left").groupBy("family").agg(
        F.count("text").alias("samples"), F.coalesce(F.sum(F.when(hit, 1).otherwise(0)), F.lit(0)).cast("bigint").alias("hits")
    ).withColumn("recall", F.when(F.col("samples") == 0, 1.0).otherwise(F.col("hits") / F.col("samples"))).withColumn(
        "below_floor", F.col("recall") < floor
    )


def seeds_per_unit(hits: DataFrame, unit_files: DataFrame, marker: str = "no detector candidates") -> DataFrame:
    """(unit_id, seed): 'path:line detector' rows under their unit; a unit without any keeps one marker row."""
    files = unit_files.select("unit_id", "path").distinct()
    seeds = hits.select("path", F.concat("path", F.lit(":"), F.col("line").cast("string"), F.lit(" "), "detector").alias("seed"))
    placed = files.join(seeds, "path").select("unit_id", "seed")
    empty = files.select("unit_id").distinct().join(placed.select("unit_id").distinct(), "unit_id", "left_anti")
    return placed.unionByName(empty.withColumn("seed", F.lit(marker)))


def signal_near(loci: DataFrame, hits: DataFrame, window: int = C.MATCH_WINDOW) -> DataFrame:
    """Loci (path, line, ...) with ``signal``: is there a hit on the path within ``window`` lines.

    Hits shrink to distinct (path, line bucket) extremes before the join, so a hot file contributes two lines per bucket.
    """
    from passledger.operators.recall import near_flag

    return near_flag(loci, hits, window, "signal")
