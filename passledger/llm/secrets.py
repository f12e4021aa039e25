"""Secret scans with a random forest against false positives, in built-in column functions and DataFrame ML only.

Candidates are runs of 16 or more key-like characters, and values of 6 or more characters other than white space that are
assigned to a secret's name. Each is described by its length, its character transitions (changes
of character class, and how usual its letter pairs are in the corpus), the share of it that dictionary words cover (words
that occur often in the corpus), its path (the `source` column) and its neighbouring words. A forest trained from labelled
findings scores every candidate; those below the threshold are false positives.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passledger.constants import LEAK_PLACEHOLDER
from passledger.llm.common import cut, unused
from passledger.operators.snapshots import may_occur

CANDIDATE = r"[A-Za-z0-9+/_-]{16,}={0,2}"
#: A secret's name and the sign that assigns (the form of constants.LEAK_ASSIGNMENT).
ASSIGNMENT = r"(?i)(?:passw(?:or[dt]|d)?|passphrase|pwd|secret(?:[_-]?key)?|token|credentials?|(?:api|access|private)[_-]?key)\\?[\"'`]?\s*[=:]"
#: Values assigned there, in the words before, a line feed and the word that the value starts in. One ends at its quote; a bare
#: one at white space, a separator before another name, a quote that closes or a tag (of the 50 first separators in a value).
QUOTED = ASSIGNMENT + r"{1,2}\s*\\?([\"'`])(?![^\n]*\n)(\S{6,}?)\\?\1"
BARE = (
    ASSIGNMENT + r"{1,2}\s*(?:\\?[\"'`](?=[^\s\"'`]*$))?+(?![^\n]*\n)([^\s\"'`\\=:,;][^\s\"'`,;&<]*+"
    r"(?:(?:[,;&](?!\s|$|[\"'`]?[\w.-]*[\"'`]?[=:])|[\"'`](?=\w)|<(?!/|!|(?:br|p|li|td)\b))[^\s\"'`,;&<]*+){0,50}+)"
)
#: Names that stand before secrets, markers of placeholders, and prefixes of well-known keys.
NAMES = r"(?i)(token|secret|passw|pwd|api[_-]?key|access[_-]?key|private[_-]?key|auth|credential|bearer)"
PLACEHOLDER = r"(?i)(example|sample|dummy|placeholder|changeme|your[_-]|x{6,}|0{8,}|123456789|abcdefgh)"
PREFIX = r"^(AKIA[0-9A-Z]{12}|gh[pousr]_|sk_live_|sk-|xox[abpr]-|eyJ)"
TEST_PATH = r"(?i)(test|example|sample|mock|fixture|doc)"
REDACTED = "[SECRET]"
FEATURES = [
    "f_length", "f_digits", "f_upper", "f_lower", "f_distinct", "f_changes", "f_pairs", "f_dictionary", "f_test_path", "f_path_length", "f_path_depth",
    "f_named", "f_assigned", "f_quoted", "f_address", "f_placeholder", "f_prefix", "f_next_length",
]


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, path, word_pos, run_pos, value, word, lead, context, after: one row per candidate. Null texts and paths are empty."""
    words = F.col("__words")
    before = lambda i: F.concat_ws(" ", F.when(i > 1, F.get(words, i - 2)), F.when(i > 0, F.get(words, i - 1)))
    places = F.filter(
        F.sequence(F.lit(0), F.size(words) - 1),
        lambda i: (F.length(F.get(words, i)) >= 16) & F.get(words, i).rlike(CANDIDATE)
        | F.col("__named") & (F.length(F.get(words, i)) >= 6) & F.concat(before(i), F.lit("\n"), F.get(words, i)).rlike(ASSIGNMENT),
    )
    found = F.transform(places, lambda i: F.struct(
        i.alias("pos"), F.get(words, i).alias("word"), before(i).alias("before"), F.coalesce(F.get(words, i + 1), F.lit("")).alias("after"),
    ))
    all_of = lambda column, pattern, group: F.regexp_extract_all(column, F.lit(pattern), F.lit(group))
    near = F.concat("before", F.lit("\n"), "word")
    bare = F.transform(all_of(near, BARE, 1), lambda v: F.regexp_replace(v, r"[,;.)\]}\\]+$", ""))
    return (
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"),
            (F.coalesce(F.col("source").cast("string"), F.lit("")) if "source" in docs.columns else F.lit("")).alias("path"), "text")
        .withColumn("__named", F.col("text").rlike(ASSIGNMENT))
        .where(F.col("__named") | F.col("text").rlike(CANDIDATE))
        .select("doc_id", "text_hash", "path", "__named", F.split("text", r"[ \t\n\x0B\f\r]+").alias("__words"))
        .select("doc_id", "text_hash", "path", F.explode(found).alias("w"))
        .select("doc_id", "text_hash", "path", F.col("w.pos").alias("word_pos"), F.col("w.word").alias("word"), F.col("w.before").alias("before"), F.col("w.after").alias("after"))
        .withColumn("runs", all_of(F.col("word"), f"({CANDIDATE})", 1))
        .withColumn("assigned", F.when(near.rlike(ASSIGNMENT), F.concat(all_of(near, QUOTED, 2), bare)).otherwise(F.array().cast("array<string>")))
        .withColumn("assigned", F.filter("assigned", lambda v: (F.length(v) >= 6) & ~F.array_contains("runs", v)))
        .select("doc_id", "text_hash", "path", "word_pos", "word", "before", "after", F.posexplode(F.concat("runs", "assigned")).alias("run_pos", "value"))
        .withColumn("lead", F.expr("substring_index(word, value, 1)"))
        .withColumn("context", F.concat_ws(" ", "before", "lead"))
        .drop("before")
    )


def dictionary(docs: DataFrame, least: int = 20) -> DataFrame:
    """word, n: lower-case letter words of 3 to 15 letters that occur `least` times or more in all texts."""
    return (
        docs.where("text is not null").select(F.explode(F.split(F.lower("text"), r"[^a-zà-öø-ÿ]+")).alias("word"))
        .where(F.length("word").between(3, 15)).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    )


def letter_pairs(words: DataFrame) -> DataFrame:
    """pair, p: natural logarithm of how often a letter a-z is followed by another in the words; 676 rows at most."""
    pairs = (
        words.select("n", F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring(F.col("word"), i, F.lit(2)))).alias("pair"))
        .where(F.col("pair").rlike("^[a-z]{2}$")).groupBy("pair").agg(F.sum("n").alias("n"))
    )
    firsts = pairs.groupBy(F.substring("pair", 1, 1).alias("first")).agg(F.sum("n").alias("all"))
    return pairs.join(firsts, F.substring("pair", 1, 1) == F.col("first")).select("pair", F.ln(F.col("n") / F.col("all")).alias("p"))


def _share(pattern: str) -> Column:
    return F.regexp_count("value", F.lit(pattern)) / F.length("value")


def described(found: DataFrame, words: DataFrame) -> DataFrame:
    """Stored candidates with their features. What depends on the value alone is computed once per distinct value."""
    values = found.select("value").distinct()
    changes = r"(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])|(?<=[^a-zA-Z0-9])(?=[a-zA-Z0-9])"
    parts = values.select("value", F.explode(F.expr("regexp_extract_all(lower(value), '([a-z]{3,15})', 1)")).alias("word"))
    covered = parts.join(words.select("word"), "word").groupBy("value").agg(F.sum(F.length("word")).alias("covered"))
    pairs = values.select("value", F.explode(F.transform(F.sequence(F.lit(1), F.length("value") - 1), lambda i: F.lower(F.substring(F.col("value"), i, F.lit(2))))).alias("pair"))
    # at most 676 rows
    usual = pairs.join(F.broadcast(letter_pairs(words)), "pair", "left").groupBy("value").agg(F.avg(F.coalesce("p", F.lit(-8.0))).alias("f_pairs"))
    return (
        found.join(usual, "value", "left").join(covered, "value", "left")
        .withColumns({
            "f_length": F.length("value"), "f_digits": _share("[0-9]"), "f_upper": _share("[A-Z]"), "f_lower": _share("[a-z]"),
            "f_distinct": F.size(F.array_distinct(F.split("value", ""))) / F.length("value"), "f_changes": _share(changes),
            "f_pairs": F.coalesce("f_pairs", F.lit(-8.0)), "f_dictionary": F.coalesce(F.col("covered") / F.length("value"), F.lit(0.0)),
            "f_test_path": F.col("path").rlike(TEST_PATH), "f_path_length": F.length("path"), "f_path_depth": F.regexp_count("path", F.lit("[/.]")),
            "f_named": F.col("context").rlike(NAMES), "f_assigned": F.col("context").rlike(r"[=:]\s*\\?[\"'`]?$"), "f_quoted": F.col("lead").rlike("[\"'`]$"),
            "f_address": F.col("word").rlike("@|://"), "f_placeholder": F.col("value").rlike(PLACEHOLDER) | (F.length("value") < 16) & F.col("value").rlike(LEAK_PLACEHOLDER), "f_prefix": F.col("value").rlike(PREFIX),
            "f_next_length": F.length("after"),
        })
        .withColumns({c: F.col(c).cast("double") for c in FEATURES}).drop("covered")
    )


def rule_label() -> Column:
    """From the features: 1 for a well-known prefix or a value assigned to a secret's name; 0 for placeholders, unquoted calls
    and references, parts of addresses, and values of one kind of character that nothing is assigned to; null for what no
    rule can judge."""
    bare = F.col("value").rlike("^([0-9]+|[A-Za-z]+|[a-z_-]+|[A-Z_-]+)$")
    named = (F.col("f_named") == 1) & (F.col("f_assigned") == 1)
    return (
        F.when((F.col("f_placeholder") == 1) | (F.col("f_quoted") == 0) & F.col("value").rlike(r"^[A-Za-z_$]?[\w.$]*[(\[{]"), 0)
        .when((F.col("f_prefix") == 1) | named & F.col("value").rlike("[0-9]"), 1)
        .when((F.col("f_address") == 1) & ~(named & F.col("value").rlike("[!@#$%^&*]")) | bare & ~named, 0).cast("double")
    )


def weak_labels(findings: DataFrame) -> DataFrame:
    """`label` for findings that a rule can judge, null for the rest."""
    return findings.withColumn("label", rule_label())


def train(labelled: DataFrame, most: int = 20_000, trees: int = 20, depth: int = 6) -> RandomForestClassificationModel | float:
    """A forest from rows with FEATURES and `label` (0 or 1; null: not used). Where all the labels are of one class, or there
    are none, there is nothing to learn: the share of positives (0 without labels) instead.

    At most `most` labelled rows are used, half of them of each class: those with the smallest hash of doc_id and place, a
    bounded sample that does not depend on partitioning. However rare, a class that occurs is in it. Rows weigh as many as
    they stand for, by the full counts of the classes. Everything that is scored is scored on all rows.
    """
    key = F.xxhash64("doc_id", "word_pos", "run_pos")
    seen = {r["label"]: r["n"] for r in labelled.where("label is not null").groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(seen) < 2:
        return float(next(iter(seen), 0.0))
    half = most // 2
    parts = [
        labelled.where(F.col("label") == label).orderBy(key, "value").limit(half).select("label", F.lit(max(1.0, n / half)).alias("weight"), *FEATURES)
        for label, n in sorted(seen.items())
    ]
    sample = cut(parts[0].unionByName(parts[1]))
    forest = RandomForestClassifier(labelCol="label", featuresCol="features", weightCol="weight", numTrees=trees, maxDepth=depth, seed=11)
    return forest.fit(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(sample))


def scored(findings: DataFrame, model: RandomForestClassificationModel | float, threshold: float = 0.5) -> DataFrame:
    """Add score (0 to 1) and is_secret. Without a forest the score is the rule's label, 0 where no rule can judge."""
    if isinstance(model, float):
        out = findings.withColumn("score", F.coalesce(rule_label(), F.lit(0.0)))
    else:
        out = (
            model.transform(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(findings))
            .withColumn("score", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")
        )
    return out.withColumn("is_secret", F.col("score") >= threshold)


def findings(docs: DataFrame, model: RandomForestClassificationModel | float | None = None) -> DataFrame:
    """All candidates with features, score and is_secret. Without a model one is trained from weak labels of these documents.

    Rows that repeat a document give its findings again; an empty table, or texts without candidates, give none.
    """
    found = described(cut(candidates(docs)), cut(dictionary(docs)))
    found = cut(weak_labels(found))
    return scored(found, train(found) if model is None else model)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, word_pos, run_pos, value_sha256, length, score, is_secret: the values themselves are not shown."""
    return findings(docs).select("doc_id", "word_pos", "run_pos", F.sha2("value", 256).alias("value_sha256"), F.length("value").cast("long").alias("length"), "score", "is_secret")


def _whole(value: Column) -> Column:
    """A pattern that finds the value where it does not go on as a longer run of key-like characters."""
    run = "[A-Za-z0-9+/_-]"
    quoted = F.concat(F.lit("\\Q"), F.replace(value, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    return F.concat(F.when(value.rlike(f"^{run}"), f"(?<!{run})").otherwise(""), quoted, F.when(value.rlike(f"{run}$"), f"(?!{run})").otherwise(""))


def redacted(docs: DataFrame) -> DataFrame:
    """All rows and columns of `docs`, with secrets in `text` replaced by a mark; n_chars follows where texts changed.

    Values are taken out longest first, wherever they stand in the text as a whole: not inside a longer run of key-like
    characters. Each row loses its own secrets only, also where rows share a doc_id or have none. Only documents that may
    have a secret meet the values; all others stay where they are.
    """
    key, may, doc, text_hash, values = unused(docs, "key", "may", "doc", "text_hash", "values")
    longest = lambda a, b: F.when(F.length(a) > F.length(b), -1).when(F.length(a) < F.length(b), 1).when(a < b, -1).when(a > b, 1).otherwise(0)
    found = cut(
        findings(docs).where(F.col("is_secret") & ~F.contains(F.lit(REDACTED), "value")).groupBy("doc_id", "text_hash").agg(F.collect_set("value").alias("found"))
        .select(F.xxhash64("doc_id", "text_hash").alias(key), F.col("doc_id").alias(doc), F.col("text_hash").alias(text_hash), F.array_sort("found", longest).alias(values))
    )
    own = F.col("doc_id").cast("long")
    marked = may_occur(docs.withColumn(key, F.xxhash64(own, F.xxhash64("text"))), found.select(key), key, may)
    joined = marked.where(F.col(may)).drop(key, may).join(found.drop(key), own.eqNullSafe(F.col(doc)) & (F.xxhash64("text") == F.col(text_hash)), "left")
    hit = F.col(values).isNotNull()
    text = F.aggregate(values, F.col("text"), lambda t, v: F.regexp_replace(t, _whole(v), F.lit(REDACTED)))
    out = joined.withColumn("text", F.when(hit, text).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        out = out.withColumn("n_chars", F.when(hit, F.char_length("text").cast(kind)).otherwise(F.col("n_chars")))
    return marked.where(~F.col(may)).select(*docs.columns).unionByName(out.select(*docs.columns))
