"""Summary-card suite: 'KEY: value' texts -> typed columns -> staged rules.

A card is refused at the first stage it fails, so only violations of that stage are reported.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passledger import constants as C
from passledger import functions as fn
from passledger.expect.core import row_violations

FIELDS, TIER_FIELDS = C.CARD_FIELDS, C.CARD_TIER_FIELDS


def _has(text: Column, pattern: str) -> Column:
    return text.rlike("(?m)" + pattern)


def _group(text: Column, pattern: str, i: int = 1) -> Column:
    got = F.regexp_extract(text, "(?m)" + pattern, i)
    return F.when(got != "", got)


def _int(text: Column, pattern: str, i: int = 1) -> Column:
    return _group(text, pattern, i).try_cast("bigint")


def _all(text: Column, pattern: str, i: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit("(?m)" + pattern), F.lit(i))


def parse_cards(cards: DataFrame, text: str = "text") -> DataFrame:
    """Typed columns of each card."""
    t = F.col(text)
    ratio = lambda name, i: _int(t, rf"^{name}:\s*(\d+)\s*/\s*(\d+)", i)
    strict = F.regexp_extract(t, r"(?m)^STRICT-CHAPMAN:(.*)$", 1)
    laps = r"^LAP-HISTORY:\s*\d+\s+bound\s+([0-9.]+)\s+novelCH\s+(\d+)"
    ledger = r"^PULSE-LEDGER:\s*max-gap\s+(\d+)m\s+deaths\s+(\d+)\s+redispatched\s+(\d+)(?:\s+adopted\s+(\d+))?(?:\s+unreconciled\s+(\d+))?"
    priors = r"^PRIORS:\s*(none staged|(\d+)\s+loaded\s+(\d+)\s+refound-or-adjudicated)"
    entry = r"^SEAL-ENTRY:\s*ran\s+\d{2}:\d{2}Z\b(.*)$"
    columns = {
        "missing": F.array_compact(F.array(*[F.when(~_has(t, f"^{f}:"), F.lit(f)) for f in FIELDS])),
        "rows_total": _int(t, r"^ROWS-TOTAL:\s*(\d+)"), "verified": _int(t, r"^VERIFIED-TOTAL:\s*(\d+)"), "refuted": _int(t, r"^REFUTED-TOTAL:\s*(\d+)"),
        "tiers": F.array(*[_int(t, rf"^{f}:\s*(\d+)") for f in TIER_FIELDS]),
        "tier_sum": sum((_int(t, rf"^{f}:\s*(\d+)") for f in TIER_FIELDS), F.lit(0)),
        "pc1": _int(t, r"^PC-1:\s*(\d+)"),
        "census_form": _group(t, r"^CENSUS-FORM:\s*(SCRIPT|SCRATCHPAD-COPY|FLAT-PIPELINE)\b"),
        "seal_class": _group(t, r"^SEAL-CLASS:\s*(CERTIFIED|BLOCKED-UNCERTIFIED|ASSESSMENT)\b"),
        "slots": _int(t, r"^CANARY:\s*(\d+)/8\b"), "visited": ratio("VISITATION", 1), "census": ratio("VISITATION", 2),
        "cures": F.size(_all(t, r"^((?:CANARY-CURE|MINT-ERROR):\s*\S+)")),
        "precedence": _group(t, r"^TERMINAL-PRECEDENCE:\s*ran\s+\d{2}:\d{2}Z\s+pre-assembly\s+verdict\s+(CERTIFY|BLOCK|ASSESS|CONTINUE)\b"),
        "loose_precedence": _group(t, r"^TERMINAL-PRECEDENCE:.*verdict\s+(\w+)"),
        "has_entry": _has(t, entry), "entry": F.regexp_extract(t, "(?m)" + entry, 1),
        "strict_units": F.regexp_extract_all(strict, F.lit(r"U(\d+)\s+([0-9.]+)"), F.lit(1)),
        "strict_values": F.transform(F.regexp_extract_all(strict, F.lit(r"U(\d+)\s+([0-9.]+)"), F.lit(2)), lambda v: v.try_cast("double")),
        "cured_units": _all(t, r"^CURE-LAP:\s*U(\d+)\b"),
        "mix_p": _int(t, r"^CANARY-MIX:\s*(\d+)P\+(\d+)H\b", 1), "mix_h": _int(t, r"^CANARY-MIX:\s*(\d+)P\+(\d+)H\b", 2),
        "axes": _int(t, r"^AXIS-CENSUS:\s*(\d+)\s+declared\b.*exhausted"), "axis_closed": ratio("AXIS-CLOSURE", 1), "axis_total": ratio("AXIS-CLOSURE", 2),
        "idle": _int(t, r"^SATURATION:\s*avg\s+([0-9.]+)/(\d+)\s+idle-while-ready\s+(\d+)m", 3),
        "priors_ok": _has(t, priors), "priors_loaded": _int(t, priors, 2), "priors_done": _int(t, priors, 3),
        "ledger_ok": _has(t, ledger), "deaths": _int(t, ledger, 2), "redispatched": _int(t, ledger, 3), "adopted": _int(t, ledger, 4), "unreconciled": _int(t, ledger, 5),
        "wide": ratio("WIDTH-DISCIPLINE", 1), "wide_of": ratio("WIDTH-DISCIPLINE", 2), "reached": ratio("REACH-DISCIPLINE", 1), "reached_of": ratio("REACH-DISCIPLINE", 2),
        "reach_receipts": F.size(_all(t, r"^(REACH-RECEIPT:\s*\S+)")),
        "lap_bounds": F.transform(_all(t, laps, 1), lambda v: v.try_cast("double")), "lap_novel": F.transform(_all(t, laps, 2), lambda v: v.try_cast("bigint")),
        "basis": _group(t, r"^CLOSURE-BASIS:\s*(STANDARD-095|EXHAUSTIVE-SATURATED)\b"),
        "block": _group(t, r"^BLOCK-RECEIPT:\s*(SESSION-CEILING|DISPATCH-DENIED|LAP-YIELD-COLLAPSE)\b"),
    }
    return cards.withColumns(columns)


def card_suite(cards: DataFrame, key: str = "card_id", text: str = "text", derived: DataFrame | None = None) -> DataFrame:
    """(card_id, stage, rule, message). ``derived`` holds violations (card_id, rule, message) of the evidence cross-check,
    applied to certified cards that pass everything else."""
    t = F.col(text)
    null = lambda c: F.col(c).isNull()
    differ = lambda a, b: F.col(a) != F.col(b)
    certified = F.col("seal_class") == "CERTIFIED"
    blocked = F.col("seal_class") == "BLOCKED-UNCERTIFIED"
    assessed = F.col("seal_class") == "ASSESSMENT"
    last = lambda c, back: F.try_element_at(F.col(c), F.lit(-back))
    dead = (F.size("lap_novel") >= 2) & (last("lap_novel", 1) <= 2) & (last("lap_novel", 2) <= 2)
    short_slots = (F.col("slots") < 8) & (F.col("cures") < 8 - F.col("slots"))
    conserve = r"conservation\s+(\d+)==(\d+)"
    kept, sum_of = F.regexp_extract("entry", conserve, 1), F.regexp_extract("entry", conserve, 2)

    def entry_rules(when: Column, certifying: bool):
        rules = [
            ("entry", "SEAL-ENTRY form", when & ~F.col("has_entry")),
            ("entry-census", "SEAL-ENTRY census", when & F.col("has_entry") & ~F.col("entry").contains("census")),
            ("entry-conservation", "SEAL-ENTRY conservation missing", when & F.col("has_entry") & (kept == "")),
            ("entry-conservation", "SEAL-ENTRY does not conserve", when & F.col("has_entry") & (kept != sum_of)),
        ]
        if certifying:
            rules.append(("entry-slots", "all eight slots must be opened", when & F.col("has_entry") & ~F.col("entry").rlike(r"canaries\s+8\s+OPENED")))
        return rules

    collapse = blocked & (F.col("block") == "LAP-YIELD-COLLAPSE")
    three = F.size("lap_bounds") >= 3
    d1, d2 = last("lap_bounds", 2) - last("lap_bounds", 3), last("lap_bounds", 1) - last("lap_bounds", 2)
    low_units = F.filter(
        F.arrays_zip(F.col("strict_units").alias("u"), F.col("strict_values").alias("v")),
        lambda x: (x["v"] < 0.5) & ~F.arrays_overlap(F.col("cured_units"), F.array(x["u"], F.concat(F.lit("0"), x["u"]))),
    )
    saturated_basis = F.coalesce(F.col("basis") == "EXHAUSTIVE-SATURATED", F.lit(False))
    axes_whole = F.coalesce((F.col("axis_closed") == F.col("axis_total")) & (F.col("axes") == F.col("axis_total")) & dead, F.lit(False))
    units_whole = F.coalesce((F.size("strict_values") > 0) & (F.array_min("strict_values") >= 0.95), F.lit(False))
    proven = _has(t, r"^ES-RECEIPTS:\s*6/6\b") & _has(t, r"^RECAPTURE:\s*\S+") & F.coalesce(dead, F.lit(False))
    stages: list[list[tuple[str, str, Column]]] = [
        [("fields", "missing fields", F.size("missing") > 0)],
        [("numbers", "non-numeric tier or total", null("rows_total") | F.exists("tiers", lambda x: x.isNull()))],
        [("verified", "verified or refuted total", null("verified") | null("refuted") | (F.col("verified") > F.col("rows_total")))],
        [("tiers", "tiers do not sum to the total", F.col("tier_sum") != F.col("rows_total"))],
        [("census-form", "census form", null("census_form"))],
        [("class", "seal class", null("seal_class"))],
        [
            ("block", "no block receipt class", blocked & null("block")),
            *entry_rules(blocked & F.col("block").isNotNull(), False),
            ("block-visitation", "open visitation ledger", collapse & differ("visited", "census")),
            ("block-slots", "slot misses are work, not block grounds", collapse & short_slots),
            ("block-laps", "needs three laps", collapse & ~three),
            ("block-gain", "laps still gain", collapse & three & ~((d1 < 0.02) & (d2 < 0.02))),
            ("block-novel", "laps still find", collapse & three & ((last("lap_novel", 1) > 2) | (last("lap_novel", 2) > 2))),
            ("block-bound", "bound is closed", collapse & three & (last("lap_bounds", 1) >= 0.95)),
            ("block-ceiling", "capacity is not an ending", blocked & (F.col("block") == "SESSION-CEILING")),
            ("block-quote", "denial quote missing", blocked & (F.col("block") == "DISPATCH-DENIED") & ~_has(t, r"^DENIAL-QUOTE:\s*\S+")),
            *entry_rules(assessed, False),
            ("assess-precedence", "precedence says continue", assessed & (F.col("loose_precedence") == "CONTINUE")),
            ("assess-receipt", "assessment without receipt", assessed & ~(_has(t, r"^OPERATOR-TARGET:\s*ASSESSMENT") | _has(t, r"^UNCONTROLLABLE:\s*\S+"))),
        ],
        [("slots", "slots must read n/8", certified & null("slots"))],
        [("denials", "denials line", certified & ~t.contains("result impact: ZERO"))],
        [
            ("visitation", "visitation form", certified & null("visited")),
            ("visitation", "files not opened", certified & differ("visited", "census")),
            ("slot-miss", "slot misses without receipts", certified & short_slots),
            ("precedence", "precedence form", certified & null("precedence")),
            ("precedence", "precedence says continue", certified & (F.col("precedence") == "CONTINUE")),
            *entry_rules(certified, True),
        ],
        [
            ("strict", "no per-unit values", certified & (F.size("strict_units") == 0)),
            ("strict", "unit under 0.50 without a cure lap", certified & (F.size(low_units) > 0)),
            ("mix", "mix form", certified & null("mix_p")),
            ("mix", "mix must total eight", certified & (F.col("mix_p") + F.col("mix_h") != 8)),
            ("mix", "mix needs four historical", certified & (F.col("mix_p") + F.col("mix_h") == 8) & (F.col("mix_h") < 4) & ~_has(t, r"^PRIORS:\s*none staged")),
            ("falsifiers", "falsifier form", certified & ~_has(t, r"^FALSIFIERS:\s*(run\s+\d+/\d+|hermetic-off\s*\()")),
            ("audit", "audit form", certified & ~_has(t, r"^M-AUDIT:\s*(\d+)/\1\s+re-derived\s+seed=[0-9a-f]{8}")),
            ("depth", "depth ratio", certified & ~_has(t, r"^DEPTH-RATIO:\s*[0-9.]+")),
            ("axes", "axis census", certified & null("axes")),
            ("axes", "axis closure form", certified & null("axis_closed")),
            ("axes", "axis not closed", certified & differ("axis_closed", "axis_total") & ~saturated_basis),
            ("axes", "axis census and closure disagree", certified & differ("axes", "axis_total")),
            ("engine", "engine", certified & ~_has(t, r"^ENGINE:\s*ONE-QUEUE\b")),
            ("saturation", "saturation form", certified & null("idle")),
            ("saturation", "idle while ready", certified & (F.col("idle") > 5)),
            ("frontier", "frontier", certified & ~_has(t, r"^FRONTIER-CLOSE:\s*\S+")),
            ("priors", "priors form", certified & ~F.col("priors_ok")),
            ("priors", "priors lost", certified & differ("priors_loaded", "priors_done")),
            ("ledger", "ledger form", certified & ~F.col("ledger_ok")),
            ("ledger", "deaths without closure", certified & (F.col("unreconciled") != 0)),
            ("ledger", "deaths and closures differ", certified & null("unreconciled") & (F.col("deaths") != F.col("redispatched") + F.coalesce("adopted", F.lit(0)))),
            ("width", "width form", certified & null("wide")),
            ("width", "narrow phase", certified & differ("wide", "wide_of")),
            ("reach", "reach form", certified & null("reached")),
            ("reach", "reach rows incomplete", certified & differ("reached", "reached_of")),
            ("receipts", "four reach receipts per top claim", certified & (F.col("pc1") > 0) & (F.col("reach_receipts") < F.col("pc1") * 4)),
        ],
        [
            ("basis", "closure basis", certified & null("basis")),
            ("closure", "saturated basis not proven", certified & ~axes_whole & ~units_whole & saturated_basis & ~proven),
            ("closure", "closure standard", certified & F.col("basis").isNotNull() & ~axes_whole & ~units_whole & ~saturated_basis),
        ],
    ]
    parsed = parse_cards(cards, text)
    rules = [(f"{i:02d}|{rule}", message, cond) for i, stage in enumerate(stages, 1) for rule, message, cond in stage]
    found = row_violations(parsed, [key], rules)
    out = found.select(
        key, F.substring("rule", 1, 2).cast("int").alias("stage"), F.substring("rule", 4, 40).alias("rule"), "message"
    )
    if derived is not None:
        scope = parsed.filter(certified).select(key)
        out = out.unionByName(derived.join(scope, key, "left_semi").select(key, F.lit(len(stages) + 1).alias("stage"), "rule", "message"))
    first = Window.partitionBy(key)
    return out.withColumn("_first", F.min("stage").over(first)).filter("stage = _first").drop("_first")


def card_tokens(cards: DataFrame, violations: DataFrame, key: str = "card_id", text: str = "text") -> DataFrame:
    """Token per accepted card, by class."""
    passed = parse_cards(cards, text).join(violations.select(key).distinct(), key, "left_anti")
    token = (
        F.when(F.col("seal_class") == "CERTIFIED", fn.content_token(text, "CERTIFIED-PASS"))
        .when(F.col("seal_class") == "ASSESSMENT", fn.content_token(text, "ASSESSMENT-VALID"))
        .otherwise(fn.content_token(text, "BLOCKED-VALID"))
    )
    return passed.select(key, "seal_class", token.alias("token"))
