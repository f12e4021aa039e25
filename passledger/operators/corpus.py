"""Corpus census, units, size and cost estimates, fingerprints, line access."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from passledger import constants as C
from passledger import functions as fn
from passledger.operators.ranking import ordinal


def scan_corpus(spark: SparkSession, directory: str) -> DataFrame:
    """Files under ``directory`` as (path, repo, content); '.git' is pruned, paths are relative."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(directory)
    root = directory.rstrip("/") + "/"
    relative = F.element_at(F.split(F.col("path"), F.lit("\\Q" + root + "\\E"), 2), -1)
    return adapt_corpus(files.select(relative.alias("path"), F.decode("content", "UTF-8").alias("content")))


def adapt_corpus(df: DataFrame) -> DataFrame:
    """Any table with ``path`` as a corpus: repo column added, '.git' pruned."""
    return df.filter(~fn.has_segment("path", [".git"])).withColumn("repo", fn.repo_of("path"))


def exclude_paths(df: DataFrame, names: list[str] | None = None, globs: list[str] | None = None) -> DataFrame:
    """Drop paths with a segment equal to a name (case-folded) or matching a glob."""
    names = C.COPY_EXCLUDED_NAMES if names is None else names
    globs = C.COPY_EXCLUDED_GLOBS if globs is None else globs
    patterns = ["^" + glob_pattern(g) + "$" for g in globs]
    matched = F.exists(F.split("path", "/"), lambda s: fn.any_of([s.rlike(p) for p in patterns])) if patterns else F.lit(False)
    return df.filter(~fn.has_segment("path", [n.lower() for n in names], casefold=True) & ~matched)


def glob_pattern(glob: str) -> str:
    """Shell wildcard as a regex; '*' also crosses '/'."""
    out = []
    for ch in glob:
        out.append(".*" if ch == "*" else "." if ch == "?" else ch if ch.isalnum() or ch in "_/" else "\\" + ch)
    return "(?s)" + "".join(out)


def classify_file(path: str = "path", content: str = "content", rules: Column | None = None) -> Column:
    """code / shebang / lock / zone / staging / pruned / other. ``rules`` is the census rule version of the row."""
    p, name = F.col(path), fn.file_name(path)
    nested = F.instr(p, "/") > 0
    top = F.element_at(F.split(p, "/"), 1)
    shebang = F.substring(F.col(content), 1, 2) == "#!"
    if rules is not None:
        shebang = shebang & (rules != "ext/v1")
    return (
        F.when(fn.has_segment(path, [".git"]), "pruned")
        .when(nested & top.isin(*C.RECORD_ZONES), "zone")
        .when(nested & (top == C.STAGING_ZONE), "staging")
        .when(~nested & p.startswith(C.STAGING_PREFIX), "staging")
        .when(name.isin(*C.LOCKFILES), "lock")
        .when(fn.extension(path).isin(*C.CODE_EXTENSIONS) | name.isin(*C.CODE_NAMES), "code")
        .when(F.coalesce(shebang, F.lit(False)), "shebang")
        .otherwise("other")
    )


def census(corpus: DataFrame, scope: list[str] | None = None, rules: Column | None = None) -> DataFrame:
    """Per file: class, repo, lines (newline characters). Contents do not travel further than this projection."""
    keep = [c for c in (scope or [])]
    return corpus.select(
        *keep, "path", fn.repo_of("path").alias("repo"), classify_file("path", "content", rules).alias("class"),
        fn.newline_count("content").alias("lines"),
    )


def repo_rollup(files: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Per repo: loc, files, biggest code file (first by path on ties), mass-suspect flag, loc used for packing."""
    scope = scope or []
    code = F.col("class") == "code"
    biggest = F.struct(F.when(code, F.col("lines")).alias("n"))
    rolled = (
        files.filter(F.col("class").isin("code", "shebang"))
        .groupBy(*scope, "repo")
        .agg(
            F.sum("lines").alias("loc"),
            F.count("*").alias("files"),
            F.coalesce(F.sum(F.when(code, F.col("lines"))), F.lit(0).cast("bigint")).alias("code_loc"),
            F.coalesce(F.max(biggest["n"]), F.lit(0).cast("bigint")).alias("biggest_lines"),
            F.min_by(F.when(code, F.col("path")), F.when(code, F.struct((-F.col("lines")).alias("n"), F.col("path").alias("p")))).alias("biggest_path"),
        )
    )
    suspect = (
        (F.col("biggest_lines") >= F.lit(C.MASS_LINES))
        & (F.col("code_loc") > 0)
        & (F.col("biggest_lines") / F.col("code_loc") >= C.MASS_FRACTION)
    )
    return with_suspects(rolled, suspect)


def with_suspects(rolled: DataFrame, suspect: Column) -> DataFrame:
    return rolled.withColumn("mass_suspect", suspect).withColumn(
        "packed_loc",
        F.greatest(F.lit(0).cast("bigint"), F.col("loc") - F.when(F.col("mass_suspect"), F.col("biggest_lines")).otherwise(0)),
    )


def mass_suspects(files: DataFrame, scope: list[str] | None = None, lines: int = C.MASS_LINES, fraction: float = C.MASS_FRACTION) -> DataFrame:
    rolled = repo_rollup(files, scope).drop("mass_suspect", "packed_loc")
    keep = (F.col("biggest_lines") >= lines) & (F.col("code_loc") > 0) & (F.col("biggest_lines") / F.col("code_loc") >= fraction)
    return rolled.filter(keep)


def class_rollup(files: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Lines and files per class (lock, zone and staging stay outside the denominator)."""
    return files.filter("class <> 'pruned'").groupBy(*(scope or []), "class").agg(
        F.sum("lines").alias("lines"), F.count("*").alias("files")
    )


def corpus_totals(repos: DataFrame, scope: list[str] | None = None, floor: int = C.UNIT_CAP_FLOOR) -> DataFrame:
    """raw_loc, scannable_loc and the unit cap max(floor, ceil(scannable / 40))."""
    total = repos.groupBy(*(scope or [])).agg(
        F.coalesce(F.sum("loc"), F.lit(0).cast("bigint")).alias("raw_loc"),
        F.coalesce(F.sum("packed_loc"), F.lit(0).cast("bigint")).alias("scannable_loc"),
        F.count("*").alias("repos"),
    )
    return total.withColumn(
        "cap", F.greatest(F.lit(floor).cast("bigint"), F.ceil(F.col("scannable_loc") / C.UNIT_CAP_SPLIT))
    )


def cost_estimate(totals: DataFrame, usd: float = C.USD_PER_MILLION_TOKENS) -> DataFrame:
    low, high = C.TOKENS_PER_LINE
    out = totals.withColumn("tokens_low", F.col("scannable_loc") * low).withColumn("tokens_high", F.col("scannable_loc") * high)
    return out.withColumn("usd_low", F.bround(F.col("tokens_low") / F.lit(1e6) * usd, 2)).withColumn(
        "usd_high", F.bround(F.col("tokens_high") / F.lit(1e6) * usd, 2)
    )


def _fill(sizes: list[tuple[int, int]], cap: int) -> list[tuple[int, int, int, int]]:
    """First-fit-decreasing over (size, count) runs, size descending -> (size, from, to, bin) with ranks inside the run.

    Equal sizes are interchangeable, so a run fills each open bin as far as it goes before a new one opens.
    """
    loads: list[int] = []
    out = []
    for size, count in sizes:
        done = 0
        for b, load in enumerate(loads):
            if done == count:
                break
            room = count if size == 0 and load <= cap else (max(cap - load, 0) // size if size else 0)
            take = min(count - done, room)
            if take:
                out.append((size, done, done + take, b))
                loads[b] += size * take
                done += take
        while done < count:
            room = count if size == 0 else max(1, cap // size)
            take = min(count - done, room)
            loads.append(size * take)
            out.append((size, done, done + take, len(loads) - 1))
            done += take
    return out


def pack_units(repos: DataFrame, scope: list[str] | None = None, floor: int = C.UNIT_CAP_FLOOR) -> DataFrame:
    """First-fit-decreasing units: repo -> unit_id (repos by packed_loc descending, then name).

    Per corpus only the histogram of repo sizes is packed: distinct sizes number at most sqrt(2 x LOC), and at most two
    caps' worth of bins per 1/40 of the corpus stay open. Ranks are needed only for sizes that spread over several units.
    """
    scope = scope or []
    keyed = repos if scope else repos.withColumn("_all", F.lit(1))
    keys = scope or ["_all"]
    totals = corpus_totals(keyed, keys, floor).select(*keys, "cap")
    histogram = keyed.groupBy(*keys, "packed_loc").agg(F.count("*").alias("n")).join(totals, keys)
    schema = ", ".join(f"{c} {dict(keyed.dtypes)[c]}" for c in keys) + ", packed_loc bigint, first bigint, last bigint, bin bigint"

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("packed_loc", ascending=False)
        runs = _fill(list(zip(pdf["packed_loc"].tolist(), pdf["n"].tolist())), int(pdf["cap"].iloc[0]))
        out = pd.DataFrame(runs, columns=["packed_loc", "first", "last", "bin"])
        for name, value in zip(keys, key):
            out[name] = value
        return out[[*keys, "packed_loc", "first", "last", "bin"]]

    segments = histogram.groupBy(*keys).applyInPandas(run, schema)
    per_size = segments.groupBy(*keys, "packed_loc").agg(F.count("*").alias("parts"))
    segments = segments.join(per_size, keys + ["packed_loc"])
    whole = keyed.join(segments.filter("parts = 1"), keys + ["packed_loc"]).select(*keyed.columns, "bin")
    spread = keyed.join(per_size.filter("parts > 1").select(*keys, "packed_loc"), keys + ["packed_loc"])
    ranked = ordinal(spread, keys + ["packed_loc"], ["repo"], "_rank")
    split = ranked.join(segments.filter("parts > 1"), keys + ["packed_loc"]).filter(
        (F.col("_rank") > F.col("first")) & (F.col("_rank") <= F.col("last"))
    ).select(*keyed.columns, "bin")
    packed = whole.unionByName(split).withColumn("unit_id", F.format_string("UNIT-%03d", F.col("bin") + 1)).drop("bin")
    return packed if scope else packed.drop("_all")


def unit_sizes(packed: DataFrame, scope: list[str] | None = None) -> DataFrame:
    return packed.groupBy(*(scope or []), "unit_id").agg(
        F.sum("packed_loc").alias("loc"), F.count("*").alias("repos"), F.sum("files").alias("files")
    )


def unit_listing(files: DataFrame, packed: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """(unit_id, path): every eligible file of the unit's repos, mass suspects included."""
    scope = scope or []
    eligible = files.filter(F.col("class").isin("code", "shebang")).select(*scope, "repo", "path")
    return eligible.join(packed.select(*scope, "repo", "unit_id"), scope + ["repo"]).select(*scope, "unit_id", "path")


def text_lines_total(corpus: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Lines of files with a scannable suffix, the unterminated last line included."""
    eligible = ~fn.has_segment("path", C.SATURATION_EXCLUDED) & fn.extension("path").isin(*C.SATURATION_SUFFIXES)
    return corpus.filter(eligible).groupBy(*(scope or [])).agg(
        F.coalesce(F.sum(fn.text_line_count("content")), F.lit(0).cast("bigint")).alias("scannable_lines")
    )


def fingerprint(corpus: DataFrame, scope: list[str] | None = None, exclude: list[str] | None = None,
                parts: list[str] | None = None) -> DataFrame:
    """Order-free fingerprint: a digest per row, four limb sums and the count per corpus, one digest over those.

    Sums combine map-side, so a corpus of any size needs one small row per task.
    """
    exclude = C.FINGERPRINT_EXCLUDED if exclude is None else exclude
    parts = parts or ["path", "content"]
    digest = F.sha2(F.concat_ws("\u0000", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0001")) for c in parts]), 256)
    rows = corpus.filter(~fn.has_segment("path", exclude)).select(*(scope or []), digest.alias("d"))
    limbs = [
        F.sum(F.conv(F.substring("d", 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).alias(f"s{i}") for i in range(4)
    ]
    summed = rows.groupBy(*(scope or [])).agg(F.count("*").alias("files"), *limbs)
    text = F.concat_ws("|", F.col("files").cast("string"), *[F.col(f"s{i}").cast("decimal(38,0)").cast("string") for i in range(4)])
    return summed.select(*(scope or []), "files", F.sha2(text, 256).alias("fingerprint"))


def change_fingerprint(listing: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Fingerprint over (path, size) only."""
    return fingerprint(listing, scope, exclude=["\u0000"], parts=["path", "size"])


def class_feasibility(paths: DataFrame) -> DataFrame:
    """Per family: eligible files; fewer than 2 infeasible, 2 or 3 tight."""
    pairs = [(f, c) for f, classes in C.FAMILY_CLASSES.items() for c in classes]
    wanted = F.array(*[F.struct(F.lit(f).alias("family"), F.lit(c).alias("cls")) for f, c in pairs])
    hit = paths.select("path", fn.plant_classes("path").alias("classes")).select(
        "path", F.explode(F.array_distinct(F.transform(
            F.filter(wanted, lambda w: F.array_contains(F.col("classes"), w["cls"])), lambda w: w["family"]))).alias("family")
    )
    families = paths.sparkSession.createDataFrame([(f,) for f in C.FAMILY_CLASSES], "family string")
    counts = hit.groupBy("family").agg(F.count_distinct("path").alias("eligible"))
    return families.join(F.broadcast(counts), "family", "left").fillna({"eligible": 0}).withColumn(
        "state", F.when(F.col("eligible") < 2, "infeasible").when(F.col("eligible") <= 3, "tight").otherwise("ok")
    )


def search(corpus: DataFrame, pattern: str, glob: str = "*", hit_limit: int | None = C.SEARCH_HIT_LIMIT, width: int = 200) -> DataFrame:
    """Lines matching ``pattern`` in paths matching ``glob``, in path and line order; hit limit and shown width are the feature.

    The pattern is tried on lines only: on a whole text it may mean something else.
    """
    lines = (
        corpus.filter(F.col("path").rlike("^" + glob_pattern(glob) + "$"))
        .select("path", F.posexplode(fn.split_lines("content")).alias("pos", "text"))
        .filter(F.col("text").rlike(pattern))
        .select("path", (F.col("pos") + 1).cast("bigint").alias("line"), F.substring(F.trim("text"), 1, width).alias("text"))
    )
    return lines if hit_limit is None else lines.orderBy("path", "line").limit(hit_limit)


def line_window(corpus: DataFrame, offset: int = 1, limit: int = C.READ_LINES_LIMIT) -> DataFrame:
    """Numbered lines [offset, offset + limit) of each file and whether more follow."""
    offset = max(1, offset)
    lines = fn.split_lines("content")
    body = F.array_join(
        F.transform(F.slice(lines, F.lit(offset), F.lit(limit)), lambda t, i: F.concat((i + offset).cast("string"), F.lit("\t"), t)), "\n"
    )
    total = F.size(lines).cast("bigint")
    return corpus.select("path", body.alias("body"), total.alias("total_lines"), (total > offset - 1 + limit).alias("truncated"))


def first_per_group(df: DataFrame, group: list[str], order: list[str], k: int) -> DataFrame:
    """At most k rows per group by order (a report limit); the rank limit is applied before the shuffle."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_r")
