"""Free text -> the JSON objects in it, by brace depth, and the verdict extraction built on it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passledger.functions.scalars import _let, any_of, split_lines
from passledger.session import by_key, cut

#: Characters of a basis that are kept.
BASIS_CHARS = 400


def json_objects(texts: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """(key, ord, object): top-level {...} spans of each text in order; braces inside strings count like any other.

    ``key`` is unique. A text leaves a row per brace: its place and +1 or -1. The depth is the running sum S less its lowest
    value so far (a closing brace outside of any object does not count), so it takes two window functions and no loop; an
    object begins where the depth leaves 0 and ends where it is back.
    """
    lengths = F.transform(F.split(text, "[{}]", -1), F.length)
    braces = F.regexp_extract_all(text, F.lit("([{}])"), F.lit(1))
    rows = texts.select(*key, F.posexplode(F.arrays_zip(lengths.alias("n"), braces.alias("brace"))).alias("_i", "_b")).filter("_b.brace IS NOT NULL")
    so_far = Window.partitionBy(*key).orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    step = F.when(F.col("_b.brace") == "{", 1).otherwise(-1)
    walked = rows.select(*key, "_i", step.alias("_step"), (F.sum("_b.n").over(so_far) + F.col("_i") + 1).alias("_at"), F.sum(step).over(so_far).alias("_s"))
    deep = walked.withColumn("_depth", F.col("_s") - F.least(F.lit(0), F.min("_s").over(so_far)))
    opens = (F.col("_step") == 1) & (F.col("_depth") == 1)
    # a closing brace at depth 0 ends an object unless the lowest sum fell just there
    inside = F.coalesce(F.lag("_depth").over(Window.partitionBy(*key).orderBy("_i")), F.lit(0)) > 0
    closes = (F.col("_step") == -1) & (F.col("_depth") == 0) & inside
    ends = deep.withColumns({"_opens": opens, "_closes": closes}).filter("_opens OR _closes").withColumn("_n", F.count_if("_opens").over(so_far))
    spans = ends.groupBy(*key, "_n").agg(F.min("_at").alias("_from"), F.max(F.when(F.col("_closes"), F.col("_at"))).alias("_to")).filter("_to IS NOT NULL")
    listed = spans.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("_n", "_from", "_to"))).alias("_spans"))
    cut_out = F.transform("_spans", lambda s, i: F.struct(i.alias("ord"), F.col(text).substr(s["_from"].cast("int"), (s["_to"] - s["_from"] + 1).cast("int")).alias("object")))
    return texts.select(*key, text).join(by_key(listed), key).select(*key, F.inline(cut_out))


def extract_verdicts(
    responses: DataFrame, key: str = "candidate_id", text: str = "text", field: str = "clean_verdict",
    allowed: tuple[str, ...] = ("PRESENT", "ABSENT"), basis_chars: int = BASIS_CHARS,
) -> DataFrame:
    """(key, verdict, basis): first object of the response that names this key and an allowed verdict.

    Lines come first, then the whole text, then a brace scan; basis is cut to ``basis_chars``. No match leaves null.
    Responses are read once and stored. Only those that lines and whole texts leave open, and whose text holds what every
    match holds, are scanned for braces.
    """

    def verdict_of(doc):
        def read(v):
            verdict = F.try_variant_get(v, f"$.{field}", "string")
            ok = (F.try_variant_get(v, f"$.{key}", "string") == F.col(key).cast("string")) & verdict.isin(*allowed)
            basis = F.substring(F.coalesce(F.try_variant_get(v, "$.basis", "string"), F.lit("")), 1, basis_chars)
            return F.when(ok, F.struct(verdict.alias("verdict"), basis.alias("basis")))

        return _let(F.try_parse_json(doc), read)  # parsed once

    lines = F.filter(F.transform(split_lines(text), lambda s: F.trim(s)), lambda s: s.startswith("{"))
    by_line = F.try_element_at(F.array_compact(F.transform(lines, verdict_of)), F.lit(1))
    trimmed = F.regexp_replace(text, r"^\s+|\s+$", "")
    told = F.coalesce(by_line, verdict_of(trimmed))
    quick = cut(responses.select(key, text, told.alias("_v")).withColumn(text, F.when(F.col("_v").isNull(), F.col(text))))
    done = quick.filter("_v IS NOT NULL").select(key, "_v.verdict", "_v.basis")
    open_rows = quick.filter("_v IS NULL")
    keys = open_rows.select(key).distinct()
    # both names, and the verdict if it is a word, are in the text of a match as they are unless escaped
    held = F.col(text).contains(key) & F.col(text).contains(field)
    if all(word.isalpha() for word in allowed):
        held &= any_of([F.col(text).contains(word) for word in allowed])
    may = F.col(text).contains("{") & F.col(text).contains("}") & (held | F.col(text).contains("\\"))
    asked = open_rows.filter(F.col(key).isNotNull() & may).groupBy(key, F.xxhash64(text).alias("_h")).agg(F.first(text).alias(text))
    spans = json_objects(asked, [key, "_h"], text)
    scanned = (
        spans.withColumn("_v", verdict_of(F.col("object"))).filter("_v IS NOT NULL").groupBy(key).agg(F.min_by("_v", F.struct("ord", "_h")).alias("_v"))
        .join(keys.withColumnRenamed(key, "_key"), F.col(key).eqNullSafe(F.col("_key")), "right").withColumn(key, F.col("_key"))
        .select(key, F.col("_v.verdict").alias("verdict"), F.coalesce(F.col("_v.basis"), F.lit("no parseable verdict")).alias("basis"))
    )
    return done.unionByName(scanned)
