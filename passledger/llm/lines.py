"""Exact line dedup that returns keep bitmaps.

Every long line becomes a row (128-bit hash of its key, document, position). The rows are range-partitioned by hash and
sorted by document (largest first) and position, so a line that stands in very many documents is dealt over many
partitions. Each task streams its rows in stretches and decides the keys that lie inside a stretch; the keys at the edges
of a stretch may go on in the next, so their rows are set aside with the three largest documents seen, and are decided
when all stretches have said theirs. Only (document, position) of dropped lines goes on, as one compressed bitmap per
document; the texts move once, to meet their bitmaps.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passledger.llm.common import cut, text_slices, unused

SPACE = " \t\n\x0b\x0c\r"


def _keyed(docs: DataFrame) -> DataFrame:
    """Documents are told apart by doc_id (null: the lowest); rows of one doc_id by their text's hash as well."""
    return docs.withColumns({"__doc": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))), "__text": F.xxhash64("text")})


def line_rows(docs: DataFrame, least_chars: int = 20) -> DataFrame:
    """h1, h2, doc, text_hash, pos: lines whose key (ends stripped, A-Z lower-cased) has `least_chars` code points or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            digests, counts, places = [], [], []
            for text in batch.column("text").to_pylist():
                n = 0
                for pos, line in enumerate(text.split("\n") if text else ()):
                    key = line.strip(SPACE)
                    if len(key) >= least_chars:
                        digests.append(xxhash.xxh3_128_digest(key.encode().lower()))
                        places.append(pos)
                        n += 1
                counts.append(n)
            h = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
            each = [np.repeat(batch.column(c).to_numpy(), counts) for c in ("__doc", "__text")]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h[:, 0], h[:, 1], *each, np.array(places, dtype=np.int32))], ["h1", "h2", "doc", "text_hash", "pos"])

    return _keyed(docs).where("text is not null").select("__doc", "__text", "text").mapInArrow(run, "h1 long, h2 long, doc long, text_hash long, pos int")


def _judge(stretch: pd.DataFrame, least_docs: int) -> Iterator[pd.DataFrame]:
    """kind 0: dropped lines; 1: lines at an edge, undecided; 2: for each edge key the largest documents, `least_docs` of them."""
    h1, h2, doc = (stretch[c].to_numpy() for c in ("h1", "h2", "doc"))
    new_key = np.append(True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]))
    new_doc = new_key | np.append(True, doc[1:] != doc[:-1])
    key = np.cumsum(new_key) - 1
    rank = np.cumsum(new_doc)
    rank -= rank[new_key][key]
    docs = np.zeros(key[-1] + 1, dtype=np.int64)
    np.maximum.at(docs, key, rank + 1)
    edge = (key == 0) | (key == key[-1])
    yield stretch[~edge & (docs[key] >= least_docs) & (rank > 0)].assign(kind=0)
    yield stretch[edge].assign(kind=1)
    yield stretch[edge & new_doc & (rank < least_docs)].assign(kind=2)


def dropped_lines(rows: DataFrame, least_docs: int = 3, stretch_rows: int = 400_000) -> DataFrame:
    """doc, text_hash, pos of every line whose key stands in `least_docs` documents or more, but for the largest of them."""
    schema = "h1 long, h2 long, doc long, text_hash long, pos int, kind int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            frame = pa.Table.from_batches(held).to_pandas()
            for out in _judge(frame, least_docs):
                if len(out):
                    yield from pa.Table.from_pandas(out, preserve_index=False).cast(arrow).to_batches()

        arrow = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc", pa.int64()), ("text_hash", pa.int64()), ("pos", pa.int32()), ("kind", pa.int32())])
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
            if n >= stretch_rows:
                yield from flush()
                held, n = [], 0
        if n:
            yield from flush()

    order = [F.col("h1"), F.col("h2"), F.col("doc").desc(), F.col("pos"), F.col("text_hash")]
    marks = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, schema))
    firsts = marks.where("kind = 2").select("h1", "h2", "doc").distinct()
    verdicts = firsts.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("docs"), F.max("doc").alias("kept")).where(F.col("docs") >= least_docs)
    late = marks.where("kind = 1").join(verdicts, ["h1", "h2"]).where("doc <> kept")
    return marks.where("kind = 0").unionByName(late.select(*marks.columns)).select("doc", "text_hash", "pos")


def keep_bitmaps(docs: DataFrame, least_chars: int = 20, least_docs: int = 3) -> DataFrame:
    """doc, text_hash, n_dropped, keep: for each document that loses lines, which lines stay, a bit each, zlib-compressed.

    Lines after the bitmap's end stay. Rows that repeat a document in full lose the same lines. A null text has no lines.
    """
    lost = (
        dropped_lines(line_rows(docs, least_chars), least_docs)
        .groupBy("doc", "text_hash").agg(F.sort_array(F.collect_set("pos")).alias("lost"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maps, sizes = [], []
            for places in batch.column("lost"):
                places = np.asarray(places.values)
                keep = np.ones((places[-1] // 8 + 1) * 8, dtype=np.uint8)
                keep[places] = 0
                maps.append(zlib.compress(np.packbits(keep, bitorder="little").tobytes(), 1))
                sizes.append(len(places))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), batch.column("text_hash"), pa.array(sizes, pa.int64()), pa.array(maps, pa.binary())], ["doc", "text_hash", "n_dropped", "keep"])

    return lost.mapInArrow(run, "doc long, text_hash long, n_dropped long, keep binary")


def kept_text(text: str, keep: bytes | None) -> str:
    """The text without the lines whose bit is off."""
    if keep is None:
        return text
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), dtype=np.uint8), bitorder="little")
    lines = text.split("\n")
    return "\n".join([line for line, bit in zip(lines, bits.tolist(), strict=False) if bit] + lines[len(bits) :])


def _with_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    maps = bitmaps.select(F.col("doc").alias("__mdoc"), F.col("text_hash").alias("__mtext"), F.col("n_dropped").alias("__dropped"), F.col("keep").alias("__keep"))
    return _keyed(docs).join(maps, (F.col("__doc") == F.col("__mdoc")) & (F.col("__text") == F.col("__mtext")), "left")


def line_report(docs: DataFrame, least_chars: int = 20, least_docs: int = 3) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 for every row of `docs`. A null or empty text is one empty line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            sizes, sums = [], []
            for text, keep in zip(batch.column("text").to_pylist(), batch.column("__keep").to_pylist(), strict=True):
                sizes.append(text.count("\n") + 1)
                sums.append(hashlib.sha256(kept_text(text, keep).encode()).hexdigest())
            dropped = pc.fill_null(batch.column("__dropped"), 0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), dropped, pa.array(sums, pa.string())],
                                             ["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    narrow = docs.select(F.col("doc_id").cast("long"), "text")
    joined = _with_bitmaps(narrow, keep_bitmaps(narrow, least_chars, least_docs))
    return (
        joined.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "__dropped", "__keep")
        .mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")
    )


def without_repeated_lines(docs: DataFrame, least_chars: int = 20, least_docs: int = 3) -> DataFrame:
    """All columns of `docs` with the repeated lines taken out of `text`; n_chars follows where lines went. Null texts stay null."""

    @F.pandas_udf("string")
    def cut_lines(text: pd.Series, keep: pd.Series) -> pd.Series:
        return pd.Series([kept_text(t, k) for t, k in zip(text, keep, strict=True)], dtype=object)

    narrow = docs.select("doc_id", "text")
    doc, text_hash, mdoc, mtext, keep = unused(docs, "doc", "text", "mdoc", "mtext", "keep")
    maps = keep_bitmaps(narrow, least_chars, least_docs).select(F.col("doc").alias(mdoc), F.col("text_hash").alias(mtext), F.col("keep").alias(keep))
    keyed = docs.withColumns({doc: F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))), text_hash: F.xxhash64("text")})
    out = keyed.join(maps, (F.col(doc) == F.col(mdoc)) & (F.col(text_hash) == F.col(mtext)), "left")
    same = F.col(keep).isNull()
    out = out.withColumn("text", F.when(same, F.col("text")).otherwise(cut_lines("text", keep)))
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        out = out.withColumn("n_chars", F.when(same, F.col("n_chars")).otherwise(F.char_length("text").cast(kind)))
    return out.select(*docs.columns)
