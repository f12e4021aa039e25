"""Column -> Column functions. All JVM-side; no Python runs per row.

Patterns carry ``(?U)`` so that ``\\w``, ``\\d``, ``\\s`` and ``\\b`` are Unicode-aware.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from passledger import constants as C

ColumnOrName = "Column | str"


def _c(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def unicode_pattern(pattern: str) -> str:
    return "(?U)" + pattern


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def all_of(conditions) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def lookup(key: Column, values: dict, default=None) -> Column:
    """Fixed small map as CASE, so the value stays foldable and never null-keys."""
    out = None
    for k, v in values.items():
        cond = key == F.lit(k)
        out = F.when(cond, F.lit(v)) if out is None else out.when(cond, F.lit(v))
    return out.otherwise(F.lit(default))


# -- identity and severity --------------------------------------------------------------------------
def stable_id(path, line, category, prefix: str = "OBS-") -> Column:
    """Content-addressed id: prefix + first 16 hex digits of sha256(path NUL line NUL lower(category))."""
    material = F.concat_ws("\u0000", _c(path), _c(line).cast("string"), F.lower(_c(category)))
    return F.concat(F.lit(prefix), F.substring(F.sha2(material, 256), 1, 16))


def severity_rank(severity) -> Column:
    return lookup(F.upper(_c(severity)), C.SEVERITY_RANKS, 0)


def is_serious(severity) -> Column:
    return severity_rank(severity) >= C.SERIOUS_RANK


def tier_key(severity) -> Column:
    return lookup(F.upper(_c(severity)), C.SEVERITY_TIER_KEYS)


def sarif_level(severity) -> Column:
    return lookup(_c(severity), C.SARIF_LEVELS)


def security_severity(severity) -> Column:
    return lookup(_c(severity), C.SARIF_SECURITY_SEVERITY)


def severity_name(rank) -> Column:
    return lookup(_c(rank), {v: k for k, v in C.SEVERITY_RANKS.items()}, "")


def quiet_threshold(loc) -> Column:
    """Density-scaled bar: max(2, loc / 25000 rounded half to even)."""
    scaled = F.bround(_c(loc).cast("double") / F.lit(float(C.QUIET_DENSITY_LOC))).cast("bigint")
    return F.greatest(F.lit(C.QUIET_FLOOR).cast("bigint"), scaled)


# -- redaction --------------------------------------------------------------------------------------
def _let(value: Column, body) -> Column:
    """Bind ``value`` once and use it several times in ``body``.

    An aggregate over nothing that starts and ends with ``value``. An element of a one-element array derives its type anew for
    each row, from both type and nullability of what it holds, so the cost of a row doubles with each binding inside another.
    """
    return F.aggregate(F.array(), value, lambda bound, _: bound, body)


def _may_match(text: Column, category: str) -> Column:
    """Cheap necessary condition: one of the literals every match of the pattern contains."""
    exact, folded = C.REDACTION_LITERALS[category]
    tests = [text.contains(word) for word in exact]
    if folded:  # folded once, however many words are looked for
        tests.append(_let(F.lower(F.upper(text)), lambda plain: any_of([plain.contains(word) for word in folded])))
    return any_of(tests)


def _mask(text: Column, counting: bool) -> Column:
    def step(i: int, current: Column, counts: list[Column]) -> Column:
        if i == len(C.REDACTIONS):
            return F.struct(current.alias("text"), F.struct(*counts).alias("counts")) if counting else current
        category, pattern, replacement = C.REDACTIONS[i]
        may = _may_match(current, category)
        pattern = unicode_pattern(pattern)
        if not counting:
            return _let(F.when(may, F.regexp_replace(current, pattern, replacement)).otherwise(current), lambda t: step(i + 1, t, counts))
        n = F.when(may, F.regexp_count(current, F.lit(pattern))).otherwise(0).cast("bigint")

        def counted(found: Column) -> Column:  # a text without a match is gone through once, for the count
            after = F.when(found > 0, F.regexp_replace(current, pattern, replacement)).otherwise(current)
            return _let(after, lambda t: step(i + 1, t, counts + [found.alias(category)]))

        return _let(n, counted)

    return _let(_c(text), lambda t: step(0, t, []))


def redact_text(text) -> Column:
    """Ordered masking chain. Not idempotent: apply it once, at the sink."""
    return _mask(text, False)


def redact_with_counts(text) -> Column:
    """struct<text, counts struct<category: bigint ...>>: the masking chain and the replacements each step made."""
    return _mask(text, True)


def redaction_counts(text) -> Column:
    return redact_with_counts(text)["counts"]


def redact_json(value, schema: str) -> Column:
    """Redact the serialised form of a struct and parse it back with the same schema."""
    return F.from_json(redact_text(F.to_json(_c(value))), schema)


def leak_check(text) -> Column:
    """Kind of credential leak in ``text`` or null: 'credential', 'jwt', 'aws-key', 'private-key'."""
    text = _c(text)
    values = F.regexp_extract_all(text, F.lit(C.LEAK_ASSIGNMENT), F.lit(1))

    def is_value(v: Column) -> Column:
        reference = F.substring(v, 1, 1).isin("$", "+")
        value_like = v.rlike(r"(?U)[^\p{IsAlphabetic}_-]") | ((v != F.lower(v)) & (v != F.upper(v)))
        return ~reference & value_like & ~v.rlike(C.LEAK_PLACEHOLDER)

    kinds = ["jwt", "aws-key", "private-key"]
    out = F.when(F.exists(values, is_value), F.lit("credential"))
    for kind, pattern in zip(kinds, C.LEAK_TOKENS):
        out = out.when(text.rlike(pattern), F.lit(kind))
    return out


# -- classification -----------------------------------------------------------------------------------
def category_cwe(category, title) -> Column:
    """CWE of the first keyword group found in "category title" (substring match, list order decides)."""
    text = F.lower(F.concat_ws(" ", _c(category), _c(title)))
    options = [F.when(any_of([text.contains(word) for word in words]), F.lit(cwe)) for words, cwe in C.CATEGORY_CWE]
    return F.coalesce(*options, F.lit(C.DEFAULT_CWE))


def valid_cwe(cwe) -> Column:
    return F.coalesce(F.trim(_c(cwe)).rlike("^CWE-[1-9][0-9]*$"), F.lit(False))


def canonical_cwe(cwe, category, title) -> Column:
    return F.when(valid_cwe(cwe), F.trim(_c(cwe))).otherwise(category_cwe(category, title))


def repair_title(title) -> Column:
    """Right-trim; a trailing ellipsis (or dots after one) becomes a single full stop."""
    trimmed = F.regexp_replace(_c(title), r"\s+$", "")
    cut = trimmed.endswith("...") | trimmed.endswith("…")
    return F.when(cut, F.concat(F.regexp_replace(trimmed, "[.…]+$", ""), F.lit("."))).otherwise(trimmed)


def fix_or_fallback(fix, category, path, line) -> Column:
    fix = F.trim(F.coalesce(_c(fix), F.lit("")))
    generic = F.format_string(C.NO_FIX, _c(category), _c(path), _c(line).cast("string"))
    keep = (F.length(fix) >= 20) | fix.startswith("No code change required;")
    return F.when(keep, fix).otherwise(generic)


def family_compatible(family, lens, category, title) -> Column:
    """Lens equals the family, or a keyword of the family occurs in category + title."""
    text = F.lower(F.concat_ws(" ", F.coalesce(_c(category), F.lit("")), F.coalesce(_c(title), F.lit(""))))
    options = [
        (_c(family) == F.lit(name)) & any_of([text.contains(word) for word in words])
        for name, words in C.FAMILY_KEYWORDS.items()
    ]
    return F.coalesce(_c(lens) == _c(family), F.lit(False)) | F.coalesce(any_of(options), F.lit(False))


def compatible_families(lens, category, title) -> Column:
    """All families an observation can score for (its lens plus keyword families), as array<string>."""
    text = F.lower(F.concat_ws(" ", F.coalesce(_c(category), F.lit("")), F.coalesce(_c(title), F.lit(""))))
    hits = [
        F.when(any_of([text.contains(word) for word in words]), F.lit(name))
        for name, words in C.FAMILY_KEYWORDS.items()
    ]
    return F.array_distinct(F.array_compact(F.array(_c(lens), *hits)))


# -- paths --------------------------------------------------------------------------------------------
def file_name(path) -> Column:
    return F.element_at(F.split(_c(path), "/"), -1)


def dir_name(path) -> Column:
    """Parent directory; '.' for a bare name."""
    return F.when(F.instr(_c(path), "/") > 0, F.regexp_replace(_c(path), "/[^/]*$", "")).otherwise(F.lit("."))


def extension(path) -> Column:
    """Lower-cased suffix from the last dot of the file name; '' without one; leading dots do not count."""
    name = F.regexp_replace(file_name(path), r"^\.+", "")
    return F.lower(F.when(F.instr(name, ".") > 0, F.regexp_extract(name, r"(\.[^.]*)$", 1)).otherwise(F.lit("")))


def repo_of(path) -> Column:
    return F.when(F.instr(_c(path), "/") > 0, F.element_at(F.split(_c(path), "/"), 1)).otherwise(F.lit("(root)"))


def has_segment(path, names: list[str], casefold: bool = False) -> Column:
    p = F.lower(_c(path)) if casefold else _c(path)
    return F.arrays_overlap(F.split(p, "/"), F.array(*[F.lit(n) for n in names]))


def is_safe_relative(path) -> Column:
    """Relative and without '..' segments."""
    p = _c(path)
    return ~p.startswith("/") & ~F.array_contains(F.split(p, "/"), "..")


def is_normalised_relative(path) -> Column:
    """Safe, non-empty, and without empty, '.' or '..' segments."""
    parts = F.split(_c(path), "/")
    return (_c(path) != "") & ~F.exists(parts, lambda s: s.isin("", ".", ".."))


def is_safe_id(value) -> Column:
    return _c(value).rlike(r"^[A-Za-z0-9._-]{1,80}$")


def plant_classes(path) -> Column:
    """Set of {config, iac} by suffix and name, else {source}."""
    name = F.lower(file_name(path))
    ext = extension(path)
    config = ext.isin(*C.CONFIG_SUFFIXES)
    iac = ext.isin(*C.INFRA_SUFFIXES) | any_of([name.startswith(p) for p in C.INFRA_NAME_PREFIXES])
    return F.array_compact(
        F.array(
            F.when(config, F.lit("config")),
            F.when(iac, F.lit("iac")),
            F.when(~config & ~iac, F.lit("source")),
        )
    )


def split_locus(locus) -> Column:
    """'path:line' -> struct<path, line>; a missing or non-numeric line, or one beyond a bigint, becomes 1."""
    text = _c(locus)
    path = F.when(F.instr(text, ":") > 0, F.regexp_replace(text, ":[^:]*$", "")).otherwise(F.lit(""))
    tail = F.element_at(F.split(text, ":"), -1)
    return F.struct(
        path.alias("path"),
        F.coalesce(F.when(tail.rlike("^[0-9]+$"), tail.try_cast("bigint")), F.lit(1).cast("bigint")).alias("line"),
    )


def split_repo(path, estate) -> Column:
    """struct<repo, rel>: first segment and the rest; a top-level path belongs to the estate."""
    has = F.instr(_c(path), "/") > 0
    return F.struct(
        F.when(has, F.element_at(F.split(_c(path), "/"), 1)).otherwise(_c(estate)).alias("repo"),
        F.when(has, F.regexp_replace(_c(path), "^[^/]*/", "")).otherwise(_c(path)).alias("rel"),
    )


def identity(tag_text, fallback) -> Column:
    """struct<app_id, app_name> from an 'ID|Name' first line with safe-charset rules and a fallback name."""
    first = F.element_at(F.split(F.coalesce(_c(tag_text), F.lit("")), C.LINE_BREAKS), 1)
    left = F.trim(F.element_at(F.split(first, r"\|", 2), 1))
    right = F.trim(F.coalesce(F.try_element_at(F.split(first, r"\|", 2), F.lit(2)), F.lit("")))
    usable = left.rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]{0,63}$") & (right != "")
    raw_id = F.when(usable, left).otherwise(_c(fallback))
    raw_name = F.when(usable, right).otherwise(_c(fallback))
    app_id = F.regexp_replace(F.left(F.regexp_replace(raw_id, r"[^A-Za-z0-9._-]", "-"), F.lit(64)), r"^\.+|\.+$", "")
    app_id = F.when(app_id == "", F.lit("APP")).otherwise(app_id)
    name = F.trim(F.left(F.regexp_replace(raw_name, r"[^A-Za-z0-9 ._-]", "-"), F.lit(64)))
    return F.struct(app_id.alias("app_id"), F.when(name == "", app_id).otherwise(name).alias("app_name"))


# -- text ---------------------------------------------------------------------------------------------
def split_lines(content) -> Column:
    """Lines as Python's splitlines gives them: many line ends, no empty last element."""
    # a split at one character takes a third of the time of one at a pattern, and few texts have other line ends
    parts = _let(_c(content), lambda text: F.when(text.rlike(C.ODD_BREAKS), F.split(text, C.LINE_BREAKS, -1)).otherwise(F.split(text, "\n", -1)))
    return _let(parts, lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, F.lit(1), F.size(p) - 1)).otherwise(p))


def newline_count(content) -> Column:
    """Newline characters only (an unterminated last line is not a line)."""
    return (F.length(_c(content)) - F.length(F.replace(_c(content), F.lit("\n"), F.lit("")))).cast("bigint")


def text_line_count(content) -> Column:
    """Lines as a text-mode file iterator counts them: universal newlines, unterminated last line included."""
    text = F.regexp_replace(_c(content), "\r\n?", "\n")
    open_tail = (F.length(text) > 0) & ~text.endswith("\n")
    return newline_count(text) + F.when(open_tail, 1).otherwise(0).cast("bigint")


def parse_kv(text) -> Column:
    """'name=value; name=value' -> map with trimmed lower-case names; later duplicates win, empty values are dropped."""
    parts = F.split(F.coalesce(_c(text), F.lit("")), ";")
    pairs = F.transform(parts, lambda p: F.split(F.trim(p), "=", 2))
    pairs = F.filter(pairs, lambda p: (F.size(p) == 2) & (F.trim(F.element_at(p, 2)) != ""))
    pairs = F.transform(pairs, lambda p: F.struct(F.lower(F.trim(F.element_at(p, 1))), F.trim(F.element_at(p, 2))))
    indexed = F.transform(pairs, lambda p, i: F.struct(i.alias("i"), p.alias("p")))
    last = F.filter(
        indexed,
        lambda x: ~F.exists(indexed, lambda y: (y["i"] > x["i"]) & (y["p"]["col1"] == x["p"]["col1"])),
    )
    return F.map_from_entries(F.transform(last, lambda x: x["p"]))


def neutralise_formula(value) -> Column:
    v = F.coalesce(_c(value), F.lit(""))
    return F.when(v.rlike(r"^[=+\-@\t]"), F.concat(F.lit("'"), v)).otherwise(v)


def run_id(head_sha, started_at, session_id) -> Column:
    """'r-' + 12 hex digits of sha256("sha minute session"), minute in UTC."""
    minute = F.date_format(F.date_trunc("minute", _c(started_at)), "yyyy-MM-dd'T'HH:mm'Z'")
    material = F.concat_ws(" ", _c(head_sha), minute, _c(session_id))
    return F.concat(F.lit("r-"), F.substring(F.sha2(material, 256), 1, 12))


def audit_seed(run) -> Column:
    return F.substring(F.sha2(_c(run), 256), 1, 8)


def parse_lane_label(label) -> Column:
    """'[recap-]pass3-L1-auth-UNIT-002' -> struct<pass, lens, unit_id>; null when the label has another form."""
    pattern = r"^(?:recap-)?pass(\d+)-(L\d-[a-z]+)-(UNIT-\d+)$"
    label = _c(label)
    return F.when(
        label.rlike(pattern),
        F.struct(
            F.regexp_extract(label, pattern, 1).try_cast("bigint").alias("pass"),
            F.regexp_extract(label, pattern, 2).alias("lens"),
            F.regexp_extract(label, pattern, 3).alias("unit_id"),
        ),
    )


def strip_escapes(text) -> Column:
    """Remove terminal control sequences (ESC [ ... letter)."""
    return F.regexp_replace(_c(text), "\u001b\\[[0-9;]*[A-Za-z]", "")


def token_value(document, token: str) -> Column:
    """Rest of the line after the first 'TOKEN:' that starts a name; null when the token is absent."""
    escaped = "".join("\\" + ch if not ch.isalnum() else ch for ch in token)
    pattern = r"(?m)(^|[^A-Z0-9-])" + escaped + r":([^\n]*)"
    return F.when(_c(document).rlike(pattern), F.regexp_extract(_c(document), pattern, 2))


def is_promissory(value) -> Column:
    return F.coalesce(_c(value).rlike(unicode_pattern(C.PROMISSORY)), F.lit(False))


def format_duration(seconds) -> Column:
    """Seconds -> '1h05m'; at least one minute."""
    minutes = F.greatest(F.lit(1).cast("bigint"), F.floor(_c(seconds) / 60).cast("bigint"))
    return F.format_string("%dh%02dm", F.floor(minutes / 60).cast("bigint"), minutes % 60)


def ratio_text(part, whole) -> Column:
    return F.concat(_c(part).cast("string"), F.lit("/"), _c(whole).cast("string"))


def content_token(text, label: str) -> Column:
    return F.substring(F.sha2(F.concat(_c(text), F.lit("|" + label)), 256), 1, 16)


def verdict_body(text) -> Column:
    """Drop anything before the first '# ' heading, trim, end with one newline."""
    t = F.regexp_replace(_c(text), r"^\s+|\s+$", "")
    at = F.instr(t, "# ")
    return F.concat(F.when(at > 1, F.substring(t, at, F.length(t))).otherwise(t), F.lit("\n"))


def json_type_is_integer(variant_json, field: str) -> Column:
    """True when ``field`` of the JSON text is an integer number (booleans and decimals are not)."""
    value = F.try_variant_get(F.try_parse_json(_c(variant_json)), f"$.{field}", "variant")
    return F.coalesce(F.schema_of_variant(value) == "BIGINT", F.lit(False))
