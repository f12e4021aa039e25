"""Vector best-fit packing of tokenised documents into sequences.

Every sequence has three capacities: tokens, documents and attention cost (the sum of squared lengths). Pieces go in by
falling length; a piece takes the open sequence, among those where it fits under every capacity, whose residual vector is
smallest in weighted norm afterwards. Pieces of one length are alike, and so are sequences with the same contents, so the
choice is made on the histogram of lengths: at most 1024 rows reach the driver, whatever the input. The pieces then find
their places by their rank among those of their length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passledger.llm.common import cut, rank_in_groups, text_slices
from passledger.llm.tokens import default_tokenizer, encoder


@dataclass(frozen=True)
class Capacity:
    """Of a sequence. The defaults for documents and cost are the most that `tokens` tokens can need, so they bind only if lowered."""

    tokens: int = 1024
    documents: int = 1024
    cost: int = 1024 * 1024
    weights: tuple[float, float, float] = (1.0, 0.05, 0.05)


def pieces(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2, tokens: int = 1024, with_ids: bool = False, forget: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: documents as ids and `end_id`; those over `tokens` are cut, a short piece first.

    With `forget` a worker gives its chunk tables back at the end of a task, for jobs whose other stages need the memory.
    """
    tokenizer = tokenizer or default_tokenizer()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], dtype="<u4")
        try:
            for batch in text_slices(batches, limit=8 << 20):
                out: list[tuple] = []
                kept: list[np.ndarray] = []
                for doc, ids in zip(batch.column("doc_id").to_pylist(), encoder(tokenizer).encode_all(batch.column("text")), strict=True):
                    ids = np.append(ids, end)
                    cuts = [0, *range(len(ids) % tokens or tokens, len(ids) + 1, tokens)]
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        out.append((doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes())))
                        if with_ids:
                            kept.append(ids[a:b].astype(np.int64))
                columns = [pa.array(c, pa.int32() if n == "piece" else pa.int64()) for n, c in zip(names, zip(*out, strict=True), strict=True)]
                if with_ids:
                    columns.append(pa.array(kept, pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, names + ["ids"] * with_ids)
        finally:
            if forget:
                encoder(tokenizer).forget()

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(encode, schema)


def plan(histogram: dict[int, int], capacity: Capacity = Capacity()) -> np.ndarray:
    """Where pieces go: rows (length, first rank, first sequence, pieces a sequence, first offset), sorted by length and rank.

    Open sequences are kept as groups of equal ones. Placing a length splits a group in those that took a piece and those
    that did not, so the number of groups follows the number of lengths, not of pieces.
    """
    top = np.array([capacity.tokens, capacity.documents, capacity.cost], dtype=float)
    weights = np.array(capacity.weights) / top
    count = np.zeros(0, dtype=np.int64)
    left = np.zeros((0, 3))
    held: list[list[tuple[int, int]]] = []

    def opened(n: int, rest: np.ndarray, contents: list[tuple[int, int]]) -> None:
        nonlocal count, left
        if n:
            count, left = np.append(count, n), np.vstack([left, rest])
            held.append(contents)

    for size in sorted(histogram, reverse=True):
        n, need = histogram[size], np.array([size, 1, size * size], dtype=float)
        if n and (need > top).any():
            raise ValueError(f"a piece of {size} tokens fits into no sequence")
        while n:
            rest = left - need
            fits = np.flatnonzero((rest >= 0).all(axis=1) & (count > 0))
            if len(fits) == 0:
                most = int((top / need).min())
                opened(n // most, top - most * need, [(size, most)])
                if n % most:
                    opened(1, top - (n % most) * need, [(size, n % most)])
                break
            best = int(fits[np.argmin(((rest[fits] * weights) ** 2).sum(axis=1))])
            took = min(n, int(count[best]))
            contents = held[best]
            contents = [*contents[:-1], (size, contents[-1][1] + 1)] if contents[-1][0] == size else [*contents, (size, 1)]
            after = rest[best]
            if took == count[best]:
                left[best], held[best] = after, contents
            else:
                count[best] -= took
                opened(took, after, contents)
            n -= took
    rows, ranks, sequence = [], dict.fromkeys(histogram, 0), 0
    for n, contents in zip(count.tolist(), held, strict=True):
        offset = 0
        for size, each in contents:
            rows.append((size, ranks[size], sequence, each, offset))
            ranks[size] += n * each
            offset += size * each
        sequence += n
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def pack(cut_pieces: DataFrame, capacity: Capacity = Capacity()) -> DataFrame:
    """Add sequence_id and offset to stored pieces (doc_id, piece, length and whatever else they hold)."""
    histogram = {int(r["length"]): int(r["n"]) for r in cut_pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = plan(histogram, capacity)
    keys = rows[:, 0] << 44 | rows[:, 1] if len(rows) else np.zeros(0, dtype=np.int64)
    ranked = rank_in_groups(cut_pieces, ["length"], ["doc_id", "piece"], ["doc_id", "piece"], "__rank")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, rank = (batch.column(c).to_numpy() for c in ("length", "__rank"))
            row = rows[np.searchsorted(keys, size << 44 | rank, side="right") - 1]
            nth = rank - row[:, 1]
            rest = batch.drop_columns(["__rank"])
            yield pa.RecordBatch.from_arrays(
                [*rest.columns, pa.array(row[:, 2] + nth // row[:, 3]), pa.array(row[:, 4] + nth % row[:, 3] * size)],
                [*rest.schema.names, "sequence_id", "offset"],
            )

    schema = ", ".join(f"`{n}` {t}" for n, t in cut_pieces.dtypes) + ", sequence_id long, offset long"
    return ranked.select(*cut_pieces.columns, "__rank").mapInArrow(place, schema)


def packed(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2, capacity: Capacity = Capacity(), forget: bool = False) -> DataFrame:
    """Pieces of all documents with their places. Null texts count as empty (the end id alone); an empty table gives no rows;
    repeated rows are packed as often as they occur."""
    return pack(cut(pieces(docs, tokenizer, end_id, capacity.tokens, forget=forget)), capacity)
