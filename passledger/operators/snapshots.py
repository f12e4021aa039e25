"""Two snapshots of a corpus: changed files, added lines, manifest checks, locus drift, structural health.

Contents move only for files that need them: keys are settled on hashes first, and a bitmap over hashed keys, of fixed size,
keeps the other files' contents out of the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passledger import functions as fn
from passledger.session import cut

#: Bits of the key bitmap: 2 MB in all, in rows of 4 KB.
KEY_BITS = 1 << 24
#: Lines of a file that one window takes.
LINE_CHUNK = 100_000


def with_keys(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose key occurs in ``keys`` (same name): by the bitmap first, then by an exact semi-join of what is left."""
    marked = may_occur(df, keys, key, "_may")
    return marked.filter("_may").drop("_may").join(keys.select(key).distinct(), key, "left_semi")


def may_occur(df: DataFrame, keys: DataFrame, key: str, name: str) -> DataFrame:
    """Add boolean ``name``: false only where the key does not occur in ``keys``, true where it does and for a few others.

    The hashed keys set bits of a bitmap of fixed size that every task gets; nothing of ``df`` is shuffled. With very many
    keys the bitmap fills up and merely rules out less. Null is a key like any other.
    """

    def place(column: str) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(KEY_BITS))

    bits = keys.select(place(key).alias("p")).groupBy(F.bitmap_bucket_number("p").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("_bits"))
    at = F.bitmap_bit_position(place(key))
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    there = (F.floor(byte / F.pow(F.lit(2), at % 8)) % 2) == 1
    joined = df.withColumn("_bucket", F.bitmap_bucket_number(place(key))).join(F.broadcast(bits), "_bucket", "left")
    return joined.withColumn(name, F.coalesce(there, F.lit(False))).drop("_bucket", "_bits")


def changed_files(before: DataFrame, after: DataFrame, key: str = "path") -> DataFrame:
    """(key, change): added, removed or modified; hashes travel, contents do not."""
    b = before.select(key, F.sha2("content", 256).alias("h_before"))
    a = after.select(key, F.sha2("content", 256).alias("h_after"))
    change = (
        F.when(F.col("h_before").isNull(), "added").when(F.col("h_after").isNull(), "removed")
        .when(F.col("h_before") != F.col("h_after"), "modified")
    )
    return b.join(a, key, "full_outer").withColumn("change", change).filter("change IS NOT NULL").select(key, "change")


def _modified(before: DataFrame, after: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(key, content) of both sides, for modified files only."""
    keys = cut(changed_files(before, after, key).filter("change = 'modified'").select(key))
    return with_keys(before.select(key, "content"), keys, key), with_keys(after.select(key, "content"), keys, key)


# -- added lines ------------------------------------------------------------------------------------
def _lines(files: DataFrame, key: str) -> DataFrame:
    """key, pos (from 0), h: two hashes of each line."""
    lines = files.select(key, F.posexplode(fn.split_lines("content")).alias("pos", "text"))
    return lines.select(key, F.col("pos").cast("bigint").alias("pos"), F.struct(F.xxhash64("text").alias("x"), F.xxhash64(F.lit(1), "text").alias("y")).alias("h"))


def _chunk(column: str = "pos") -> Column:
    return F.floor(F.col(column) / LINE_CHUNK)


def _running(rows: DataFrame, group: list[str], pos: str, amount: Column, name: str) -> DataFrame:
    """Add the sum of ``amount`` over the rows of the group up to this one; groups of any length, a chunk of lines at a time."""
    chunked = rows.withColumns({"_chunk": _chunk(pos), "_amount": amount})
    totals = chunked.groupBy(*group, "_chunk").agg(F.sum("_amount").alias("_sum"))
    earlier = Window.partitionBy(*group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.withColumn("_start", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).drop("_sum")
    here = Window.partitionBy(*group, "_chunk").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    return (
        chunked.withColumn("_here", F.sum("_amount").over(here)).join(starts, [*group, "_chunk"])
        .withColumn(name, F.col("_start") + F.col("_here")).drop("_chunk", "_amount", "_here", "_start")
    )


def _heaviest(first: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Which members of a sequence make up its increasing subsequence of most weight (by prefix maxima in a binary indexed tree)."""
    n = len(first)
    place = np.argsort(np.argsort(first)) + 1
    best, holder, back = [0] * (n + 1), [-1] * (n + 1), [-1] * n
    for k, (p, w) in enumerate(zip(place.tolist(), weight.tolist())):
        most, at, q = 0, -1, p - 1
        while q > 0:
            if best[q] > most:
                most, at = best[q], holder[q]
            q -= q & -q
        back[k], most, q = at, most + w, p
        while q <= n:
            if best[q] < most:
                best[q], holder[q] = most, k
            q += q & -q
    kept, k, most, q = np.zeros(n, dtype=bool), -1, 0, n
    while q > 0:
        if best[q] > most:
            most, k = best[q], holder[q]
        q -= q & -q
    while k >= 0:
        kept[k] = True
        k = back[k]
    return kept


def _in_order(pairs: DataFrame, group: list[str]) -> DataFrame:
    """Of one-to-one matches (group, pos, old) as many as keep both orders: (group, pos, old).

    Neighbours that moved together are one run; runs lie apart on both sides, so an order-keeping choice takes whole runs,
    and a task sees the runs of a group, one row for each, not its lines.
    """
    shifted = pairs.select(*group, "pos", "old", (F.col("old") - F.col("pos")).alias("_shift"), _chunk().alias("_chunk"))
    island = F.col("pos") - F.row_number().over(Window.partitionBy(*group, "_shift", "_chunk").orderBy("pos"))
    runs = shifted.withColumn("_island", island).groupBy(*group, "_shift", "_chunk", "_island").agg(F.min("pos").alias("pos"), F.min("old").alias("old"), F.count("*").alias("n"))
    named = runs.select(F.xxhash64(*group).alias("_g"), *group, "pos", "old", "n")

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None

        def done() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held).combine_chunks()
            kept = _heaviest(table.column("old").to_numpy(), table.column("n").to_numpy())
            yield from table.filter(pa.array(kept)).to_batches()

        for batch in batches:
            if batch.num_rows == 0:
                continue
            cols = [batch.column(c).to_pylist() for c in group]
            keys = list(zip(*cols))
            starts = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1]), len(keys)]
            for a, b in zip(starts, starts[1:]):
                if held and keys[a] != last:
                    yield from done()
                    held = []
                last = keys[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield from done()

    ordered = named.repartition("_g").sortWithinPartitions("_g", *group, "pos")
    kept = ordered.mapInArrow(choose, named.schema)
    step = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1))
    return kept.select(*group, "pos", "old", step.alias("_k")).select(*group, (F.col("pos") + F.col("_k")).alias("pos"), (F.col("old") + F.col("_k")).alias("old"))


def added_lines(before: DataFrame, after: DataFrame, key: str = "path") -> DataFrame:
    """(key, line, text) for every line a modified file gained, numbered in the new file from 1.

    Lines that occur once on either side, in a common order as long as can be, are anchors. Between two anchors equal lines
    are matched by their number of occurrence there, again as many as keep the order; what has no match was added. A moved line
    counts as added where it stands now. Lines are rows keyed by hash, so a large file is many tasks.
    """
    old_files, new_files = _modified(before, after, key)
    old, new = cut(_lines(old_files, key)), cut(_lines(new_files, key))

    def once(lines: DataFrame, name: str) -> DataFrame:
        return lines.groupBy(key, "h").agg(F.min("pos").alias(name), F.count("*").alias("n")).filter("n = 1").drop("n")

    anchors = cut(_in_order(once(new, "pos").join(once(old, "old"), [key, "h"]).select(key, "pos", "old"), [key]))

    def rest(lines: DataFrame, at: str) -> DataFrame:
        """Lines that are no anchor, with the number of anchors before them and their occurrence there."""
        marked = lines.join(anchors.select(key, F.col(at).alias("pos"), F.lit(1).alias("anchor")), [key, "pos"], "left")
        placed = _running(marked, [key], "pos", F.coalesce("anchor", F.lit(0)), "part").filter("anchor IS NULL").drop("anchor")
        return _running(placed, [key, "part", "h"], "pos", F.lit(1), "nth")

    same = rest(new, "pos").join(rest(old, "old").withColumnRenamed("pos", "old"), [key, "part", "h", "nth"]).select(key, "part", "pos", "old")
    matched = anchors.select(key, "pos").unionByName(_in_order(same, [key, "part"]).select(key, "pos"))
    gained = new.select(key, "pos").join(matched, [key, "pos"], "left_anti").groupBy(key).agg(F.sort_array(F.collect_list("pos")).alias("_at"))
    lines = new_files.join(gained, key).select(key, "_at", fn.split_lines("content").alias("_lines"))
    picked = F.transform("_at", lambda p: F.struct((p + 1).alias("line"), F.element_at("_lines", (p + 1).cast("int")).alias("text")))
    return lines.select(key, F.inline(picked))


# -- structural health ------------------------------------------------------------------------------
def delimiter_balance(text: Column) -> Column:
    """Unmatched brackets: closers without their opener plus openers left over.

    A fold over the brackets of the text; the string of open ones is the stack.
    """
    brackets = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^()\[\]{}]", ""), "")
    start = F.struct(F.lit("").alias("open"), F.lit(0).cast("bigint").alias("bad"))

    def step(held: Column, ch: Column) -> Column:
        opener = F.translate(ch, ")]}", "([{")
        opens = ch.isin("(", "[", "{")
        fits = (opener != ch) & held["open"].endswith(opener)
        return F.when(ch == "", held).otherwise(F.struct(
            F.when(opens, F.concat(held["open"], ch)).when(fits, F.substring(held["open"], F.lit(1), F.length(held["open"]) - 1)).otherwise(held["open"]).alias("open"),
            F.when(opens | fits, held["bad"]).otherwise(held["bad"] + 1).alias("bad")))

    return F.aggregate(brackets, start, step, lambda held: held["bad"] + F.length(held["open"]))


def snapshot_health(before: DataFrame, after: DataFrame, key: str = "path") -> DataFrame:
    """Modified files whose bracket balance got worse, or that stopped being JSON. Scores meet, contents do not."""

    def scored(files: DataFrame, name: str) -> DataFrame:
        return files.select(key, delimiter_balance(F.col("content")).alias(f"balance_{name}"), F.try_parse_json("content").isNotNull().alias(f"json_{name}"))

    old, new = _modified(before, after, key)
    pairs = scored(old, "before").join(scored(new, "after"), key)
    broken = (F.col("json_before") & ~F.col("json_after")).alias("json_broken")
    return pairs.select(key, "balance_before", "balance_after", broken).filter((F.col("balance_after") > F.col("balance_before")) | F.col("json_broken"))


def verify_manifest(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """(path, problem) for a manifest (path, sha256, size): missing, hash mismatch, size drift."""
    actual = files.select("path", F.sha2("content", 256).alias("actual"), F.octet_length("content").alias("actual_size"))
    problem = (
        F.when(F.col("actual").isNull(), "missing").when(F.col("actual") != F.col("sha256"), "hash mismatch")
        .when(F.col("size").isNotNull() & (F.col("size") != F.col("actual_size")), "size drift")
    )
    return manifest.join(actual, "path", "left").withColumn("problem", problem).filter("problem IS NOT NULL").select("path", "problem")


def manifest_count_ok(manifest: DataFrame, declared: int) -> DataFrame:
    return manifest.agg(F.count("*").alias("listed")).select("listed", (F.col("listed") == declared).alias("count_ok"))


def locus_drift(slots: DataFrame, corpus: DataFrame) -> DataFrame:
    """Slots with ``drift``: the line at (path, line) no longer hashes to ``mutation_sha256`` (or is gone).

    Only files with a wanted line are split, and of those only the hashes of wanted lines meet the slots.
    """
    wanted = slots.filter("mutation_sha256 IS NOT NULL AND NOT historical")
    asked = wanted.select("path", F.col("line").cast("int").alias("_line")).distinct().groupBy("path").agg(F.collect_list("_line").alias("_asked"))
    files = with_keys(corpus.select("path", "content"), wanted.select("path"), "path").join(asked, "path")
    hashed = files.select("path", F.explode("_asked").alias("_line"), F.sha2(F.try_element_at(fn.split_lines("content"), F.col("_line")), 256).alias("_actual"))
    there = hashed.select(F.col("path").alias("_path"), "_line", "_actual")
    met = wanted.join(there, (F.col("path") == F.col("_path")) & (F.col("line").cast("int") == F.col("_line")), "left")
    return met.withColumn("drift", ~F.coalesce(F.col("_actual") == F.col("mutation_sha256"), F.lit(False))).drop("_path", "_line", "_actual")
