"""Removal of repeated passages by difference-cover anchors.

A window is `window` consecutive words of one document. Any two positions have, for a difference cover modulo a period, a
common shift below the period that takes both to cover positions. So two equal windows share an anchor: a shorter run of
words (`window` - period + 1) that starts at the same place of both windows and at a cover position of both documents. Only
anchors are hashed for all documents: with windows of 35 words, five of 21 positions, of 15 words each.

An anchor also carries a hash of its context, the words up to period - 1 before and behind it, as far as the document goes.
Rows (anchor, context, document, place) are range-partitioned and streamed in order, so a passage that very many documents
hold is dealt over many tasks:

* Anchors with equal context elsewhere: every window that contains them is a repeat. Nothing more is looked up.
* Anchors found elsewhere in other contexts only: they are extended. The windows that contain them are hashed in full (128
  bits) and compared with each other, and with the windows of one anchor for each repeated context of the same anchor.

The second kind stands at the ends of repeats only, so the rows of the comparison are few. No pair of documents is made.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passledger.llm.common import cut, text_slices, unused

#: Perfect difference covers by their period.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16)}
SHARED, REPEATED, WITNESS = 1, 2, 3
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
_LOW = (1 << 32) - 1


def cover(window: int) -> tuple[int, int, tuple[int, ...]]:
    """Words of an anchor, reach (words that a window may go on to either side), and the cover: period 21 for 35 words."""
    if window < 2:
        raise ValueError("a window has two words at least")
    period = max(p for p in COVERS if 5 * p <= 3 * window or p == 1)
    return window - period + 1, period - 1, COVERS[period]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(32))


@lru_cache(maxsize=1)
def _bytes() -> tuple[np.ndarray, np.ndarray]:
    space = np.zeros(256, dtype=bool)
    space[[0x20, *range(0x09, 0x0E)]] = True
    return np.random.Generator(np.random.Philox(key=13)).integers(0, 1 << 64, 256, dtype=np.uint64), space


@lru_cache(maxsize=4)
def _powers(lane: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    odd = int(_ODD[lane])
    up, down = np.full(size, odd, dtype=np.uint64), np.full(size, pow(odd, -1, 1 << 64), dtype=np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def word_hashes(texts: list[str | None], block: int = 1 << 17) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, one after another, and where each text's words begin (and the last ones end)."""
    value, space = _bytes()
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" " + b" ".join(raw) + b" ", dtype=np.uint8)
    gap = space[data]
    starts, ends = np.flatnonzero(gap[:-1] & ~gap[1:]) + 1, np.flatnonzero(~gap[:-1] & gap[1:]) + 1
    out = np.zeros(len(starts), dtype=np.uint64)
    for a in range(0, len(starts), block):
        s, e = starts[a : a + block], ends[a : a + block]
        first, n = s[0], int(e[-1] - s[0])
        up, down = _powers(0, 1 << max(20, n.bit_length()))
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(value[data[first : first + n]] * up[:n], dtype=np.uint64, out=sums[1:])
        out[a : a + block] = _mixed((sums[e - first] - sums[s - first]) * down[s - first] + (e - s).astype(np.uint64) * _ODD[1])
    return out, np.searchsorted(starts, 1 + np.cumsum([0, *(len(r) + 1 for r in raw)]))


class _Rolled:
    """Hashes of any run of words, from running sums."""

    def __init__(self, words: np.ndarray, lane: int) -> None:
        up, self.down = _powers(lane, 1 << max(18, (len(words) + 1).bit_length()))
        if lane:
            words = _mixed(words ^ _ODD[1])
        self.sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(words * up[: len(words)], dtype=np.uint64)])

    def runs(self, start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        return _mixed((self.sums[start + size] - self.sums[start]) * self.down[start] + np.asarray(size).astype(np.uint64) * _ODD[0])


def _keyed(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """Rows are told apart by doc_id (null: the lowest) and, in the upper half of a long, 32 bits of their text's hash."""
    return docs.withColumns({doc: F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))), text: F.shiftleft(F.xxhash64("text"), 32)})


def anchor_rows(docs: DataFrame, window: int = 35) -> DataFrame:
    """h, context, doc, place (text hash and word number) of every anchor of documents with `window` words or more."""
    span, reach, places = cover(window)
    at_cover = np.isin(np.arange(reach + 1), places)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            words, firsts = word_hashes(batch.column("text").to_pylist())
            counts = np.diff(firsts)
            row = np.repeat(np.arange(len(counts)), counts)
            pos = np.arange(len(words)) - firsts[row]
            n = counts[row]
            g = np.flatnonzero((n >= window) & at_cover[pos % (reach + 1)] & (pos + span <= n))
            if len(g) == 0:
                continue
            row, pos, n = row[g], pos[g], n[g]
            left, right = np.minimum(pos, reach), np.minimum(reach, n - pos - span)
            h = _Rolled(words, 0).runs(g, span)
            context = _mixed(_Rolled(words, 1).runs(g - left, left + span + right) + left.astype(np.uint64) * _ODD[0])
            yield pa.RecordBatch.from_arrays(
                [pa.array(h.view(np.int64)), pa.array(context.view(np.int64)), pa.array(batch.column("__doc").to_numpy()[row]), pa.array(batch.column("__text").to_numpy()[row] | pos)],
                ["h", "context", "doc", "place"])

    narrow = _keyed(docs.select("doc_id", "text"), "__doc", "__text").where("text is not null")
    return narrow.select("__doc", "__text", "text").mapInArrow(run, "h long, context long, doc long, place long")


def _judge(stretch: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Decided anchors (doc, place, kind) of sorted rows, and what other stretches may add to: of the keys at the edges the
    first row of each context, with the number of its rows. Rows after the first have an equal one before them, whatever follows.
    """
    h, context = stretch["h"].to_numpy(), stretch["context"].to_numpy()
    new_h = np.append(True, h[1:] != h[:-1])
    new_c = new_h | np.append(True, context[1:] != context[:-1])
    key, part = np.cumsum(new_h) - 1, np.cumsum(new_c) - 1
    many, same = np.bincount(key)[key], np.bincount(part)[part]
    loose = (np.bincount(key, weights=same == 1) > 0)[key]
    edge = (key == 0) | (key == key[-1])
    kind = np.select([many == 1, same == 1, new_c & loose], [0, SHARED, WITNESS], REPEATED)
    kind[edge & ~new_c] = REPEATED
    kept, late = (kind > 0) & ~(edge & new_c), edge & new_c
    return stretch.loc[kept, ["doc", "place"]].assign(kind=kind[kept].astype(np.int32)), stretch[late].assign(same=same[late])


def anchor_marks(rows: DataFrame, stretch_rows: int = 400_000) -> DataFrame:
    """doc, place, kind of every anchor that stands elsewhere too.

    kind 1: in other contexts only; 2: with the same context; 3: like 2, and it answers for its context where the anchor
    also has rows of kind 1.
    """
    schema = "h long, context long, doc long, place long, kind int, same long"
    order = ["h", "context", "doc", "place"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0

        def flush() -> Iterator[pa.RecordBatch]:
            decided, edge = _judge(pa.Table.from_batches(held).to_pandas())
            for frame in (decided.assign(h=0, context=0, same=0), edge.assign(kind=np.int32(0))):
                if len(frame):
                    yield pa.RecordBatch.from_pandas(frame[[*order, "kind", "same"]], preserve_index=False)

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
            if n >= stretch_rows:
                yield from flush()
                held, n = [], 0
        if n:
            yield from flush()

    found = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, schema))
    late = found.where("kind = 0").drop("kind")
    by_context = cut(late.groupBy("h", "context").agg(F.sum("same").alias("same"), F.min(F.struct("doc", "place")).alias("first")))
    by_key = by_context.groupBy("h").agg(F.sum("same").alias("many"), F.max(F.col("same") == 1).alias("loose")).where("many > 1")
    verdicts = cut(by_context.join(by_key, "h"))
    answers = (F.col("first.doc") == F.col("doc")) & (F.col("first.place") == F.col("place")) & F.col("loose")
    kind = F.when(F.col("same") == 1, SHARED).when(answers, WITNESS).otherwise(REPEATED)
    settled = late.drop("same").join(verdicts, ["h", "context"]).select("doc", "place", kind.cast("int").alias("kind"))
    return found.where("kind > 0").select("doc", "place", "kind").unionByName(settled)


def _starts(n: int, window: int, anchors: np.ndarray, reach: int) -> np.ndarray:
    """Which of the windows of n words contain an anchor at one of the positions."""
    edge = np.zeros(n + 2, dtype=np.int64)
    first, last = np.maximum(anchors - reach, 0), np.minimum(anchors, n - window)
    ok = first <= last
    np.add.at(edge, first[ok], 1)
    np.add.at(edge, last[ok] + 1, -1)
    return np.cumsum(edge)[: max(0, n - window + 1)] > 0


def _per_document(marks: DataFrame, code: Column) -> DataFrame:
    """mdoc, mtext, codes: per document the coded positions."""
    return marks.groupBy(F.col("doc").alias("mdoc"), F.shiftleft(F.shiftright("place", 32), 32).alias("mtext")).agg(F.collect_list(code).alias("codes"))


def _word_number() -> Column:
    return F.col("place").bitwiseAND(F.lit(_LOW))


def repeated_windows(docs: DataFrame, marks: DataFrame, window: int = 35) -> DataFrame:
    """doc, place of the windows that contain no anchor of a repeated context and yet stand elsewhere too."""
    _, reach, _ = cover(window)
    asked = _per_document(marks, _word_number() * 4 + F.col("kind")).where(F.exists("codes", lambda c: c % 2 == 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            words, firsts = word_hashes(batch.column("text").to_pylist())
            lanes = [_Rolled(words, k) for k in (0, 1)]
            for k, codes in enumerate(batch.column("codes")):
                codes = np.asarray(codes.values)
                n, kind = int(firsts[k + 1] - firsts[k]), codes % 4
                asked = np.flatnonzero(_starts(n, window, codes[kind % 2 == 1] // 4, reach))
                known = _starts(n, window, codes[kind >= REPEATED] // 4, reach)[asked]
                hashes = [pa.array(x.runs(firsts[k] + asked, window).view(np.int64)) for x in lanes]
                same = [pa.array(np.full(len(asked), batch.column("__doc")[k].as_py())), pa.array(batch.column("__text")[k].as_py() | asked)]
                yield pa.RecordBatch.from_arrays([*hashes, *same, pa.array(known)], ["w1", "w2", "doc", "place", "known"])

    keyed = _keyed(docs.select("doc_id", "text"), "__doc", "__text")
    met = keyed.join(asked, (F.col("__doc") == F.col("mdoc")) & (F.col("__text") == F.col("mtext"))).select("__doc", "__text", "text", "codes")
    windows = cut(met.mapInArrow(run, "w1 long, w2 long, doc long, place long, known boolean"))
    often = (
        windows.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n"), F.min("known").alias("all_known"))
        .where("n > 1 and not all_known").select("w1", "w2")
    )
    return windows.where("not known").join(often, ["w1", "w2"]).select("doc", "place")


def _removed(n: int, window: int, codes: np.ndarray, reach: int) -> np.ndarray:
    """Which of n words go; codes are even for the first word of a repeated window, odd for an anchor of a repeated context."""
    start = _starts(n, window, codes[codes % 2 == 1] // 2, reach)
    start[codes[codes % 2 == 0] // 2] = True
    edge = np.zeros(n + 1, dtype=np.int64)
    edge[:-window][start] += 1
    edge[window:][start] -= 1
    return np.cumsum(edge)[:n] > 0


def with_repeats(docs: DataFrame, window: int = 35, name: str = "repeats") -> DataFrame:
    """All rows and columns of `docs`, and `name`: struct<n_words long, n_removed long, kept string>.

    Words are runs of other than 09-0D and 20, unchanged. A word goes if it lies in a window whose words also stand, in the
    same order, at any other place: in another row, or elsewhere in its own. `kept` is what stays, joined by single spaces.
    A null text has no words; an empty one neither; texts shorter than a window stay whole. Rows that repeat each other are
    copies of each other. Rows without doc_id are told apart by their text. `name` must not be a column of `docs`.
    """
    if name in docs.columns:
        raise ValueError(f"the column {name} is there already")
    _, reach, _ = cover(window)
    marks = cut(anchor_marks(anchor_rows(docs, window)))
    ends = repeated_windows(docs, marks, window)
    both = marks.where(f"kind >= {REPEATED}").select("doc", "place", F.lit(1).alias("anchor")).unionByName(ends.select("doc", "place", F.lit(0).alias("anchor")))
    doc, text, lost, mdoc, mtext = unused(docs, "doc", "text_key", "lost", "mdoc", "mtext")
    found = _per_document(both, _word_number() * 2 + F.col("anchor")).select(F.col("mdoc").alias(mdoc), F.col("mtext").alias(mtext), F.col("codes").alias(lost))

    @F.pandas_udf("n_words long, n_removed long, kept string")
    def cut_words(texts: pd.Series, codes: pd.Series) -> pd.DataFrame:
        out = []
        for t, c in zip(texts, codes, strict=True):
            words = (t or "").encode("utf-8", "surrogatepass").split()
            n, gone = len(words), 0
            if c is not None and len(c):
                away = _removed(n, window, np.asarray(c), reach)
                words, gone = list(itertools.compress(words, ~away)), int(away.sum())
            out.append((n, gone, b" ".join(words).decode("utf-8", "surrogatepass")))
        return pd.DataFrame(out, columns=["n_words", "n_removed", "kept"])

    keyed = _keyed(docs, doc, text)
    joined = keyed.join(found, (F.col(doc) == F.col(mdoc)) & (F.col(text) == F.col(mtext)), "left")
    return joined.select(*docs.columns, cut_words(F.col("text"), F.col(lost)).alias(name))


def without_repeats(docs: DataFrame, window: int = 35) -> DataFrame:
    """`docs` with repeated passages taken out; texts that lose words have single spaces, other texts and null stay as they are."""
    (name,) = unused(docs, "repeats")
    cut_docs = with_repeats(docs, window, name)
    text = F.when(F.col(f"{name}.n_removed") > 0, F.col(f"{name}.kept")).otherwise(F.col("text"))
    return cut_docs.withColumn("text", text).select(*docs.columns)


def passage_report(docs: DataFrame, window: int = 35) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row of `docs`."""
    rows = with_repeats(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), window)
    return rows.select("doc_id", "repeats.n_words", "repeats.n_removed", F.sha2(F.col("repeats.kept").cast("binary"), 256).alias("kept_sha256"))
