"""Homomorphic multiset fingerprints of documents.

A document is the multiset of its paragraphs (the parts between line feeds). Each paragraph is hashed to a wide vector and
a document's fingerprint is the sum of its paragraphs' vectors, each lane modulo a power of two: the order of paragraphs
does not matter, and paragraphs are inserted and deleted by adding and subtracting their vectors.

The vector has two parts. Four lanes modulo 2^64 are filled from a cryptographic hash of the whole paragraph and decide
equality. 256 lanes modulo 2^32 are filled from the paragraph's windows of 16 bytes: each window's hash picks a lane and a
sign. The dot product of two such sums estimates that of the window counts, so their cosine tells how alike two documents
are, to about 1/16.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passledger.llm.common import text_slices

LANES = 256
WINDOW = 16
#: Odd multipliers of the window hash.
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def _window_lanes(data: bytes, owners: np.ndarray, n: int) -> np.ndarray:
    """Signed lane sums of all windows within paragraphs, by owner of the byte where a window starts."""
    size = len(data) - WINDOW + 1
    if size <= 0:
        return np.zeros((n, LANES), dtype=np.int64)
    word = lambda k: np.ndarray((size,), dtype="<u8", buffer=data, offset=k, strides=(1,))
    h = word(0) * _M1 ^ word(8) * _M2
    h ^= h >> np.uint64(29)
    h *= _M3
    feeds = np.cumsum(np.frombuffer(data, dtype=np.uint8) == 10, dtype=np.int32)
    whole = np.append(0, feeds[: size - 1]) == feeds[WINDOW - 1 :]
    bins = (h[whole] >> np.uint64(55)).astype(np.int64) + owners[:size][whole] * (2 * LANES)
    counts = np.bincount(bins, minlength=n * 2 * LANES).reshape(n, LANES, 2)
    return counts[:, :, 0] - counts[:, :, 1]


def vectors(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(n x 4 uint64, n x LANES uint32): the fingerprints of texts. The empty text is one empty paragraph."""
    exact = np.zeros((len(texts), 4), dtype=np.uint64)
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    small = np.zeros((len(texts), LANES), dtype=np.int64)
    for k, data in enumerate(raw):
        digests = b"".join([hashlib.blake2b(p, digest_size=32).digest() for p in data.split(b"\n")])
        exact[k] = np.frombuffer(digests, dtype="<u8").reshape(-1, 4).sum(axis=0, dtype=np.uint64)
        for p in data.split(b"\n") if len(data) < WINDOW or b"\n" in data else ():
            if len(p) < WINDOW:  # a short paragraph is one window
                lane = hashlib.blake2b(p, digest_size=2).digest()
                small[k, lane[0]] += 1 - 2 * (lane[1] & 1)
    joined = b"\n".join(raw)
    owners = np.repeat(np.arange(len(raw)), [len(r) + 1 for r in raw])
    return exact, ((small + _window_lanes(joined, owners, len(raw))) & 0xFFFFFFFF).astype(np.uint32)


def edited_text(text: str, following: str) -> str:
    """The last third of the code points (rounded down) replaced by the first as many, or all, of the following text."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n] if n else text


def exchange(before: tuple[np.ndarray, np.ndarray], gone: tuple, come: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints after paragraphs were deleted and others inserted: arithmetic modulo 2^64 and 2^32, lane by lane."""
    return before[0] - gone[0] + come[0], before[1] - gone[1] + come[1]


def printed(exact: np.ndarray, lanes: np.ndarray) -> list[str]:
    """Base64 text of fingerprints: the exact lanes, then the window lanes, little-endian."""
    rows = np.concatenate([exact.astype("<u8").view(np.uint8).reshape(len(exact), -1), lanes.astype("<u4").view(np.uint8).reshape(len(lanes), -1)], axis=1)
    return [base64.b64encode(r.tobytes()).decode() for r in rows]


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """1 where all lanes are equal, else the cosine of the window lanes read as signed numbers, between 0 and below 1."""
    x, y = a[1].view(np.int32).astype(float), b[1].view(np.int32).astype(float)
    size = np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))
    cosine = ((x * y).sum(axis=1) / np.where(size > 0, size, 1)).clip(0, 1 - 1e-9)
    same = (a[0] == b[0]).all(axis=1) & (a[1] == b[1]).all(axis=1)
    return np.where(same, 1.0, cosine)


def _in_order(docs: DataFrame, stretches: int) -> DataFrame:
    """`__ord`, `__ahead`, text, sorted by falling doc_id within stretches; each stretch ends in a copy of the row after it.

    The bounds of the stretches are ids that occur, so the first row of a stretch is known without looking: it is copied
    into the stretch before. The row with the largest id is copied behind the last row of all.
    """
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("__ord"), F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce("text", F.lit("")).alias("text"))
    shares = [k / stretches for k in range(1, stretches)]
    found = rows.agg(F.percentile_approx("__ord", shares, F.lit(20 * stretches)).alias("b"), F.max("__ord").alias("top")).first()
    bounds = np.unique(np.array(found["b"] or [], dtype=np.int64))
    top = found["top"]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            order = batch.column("__ord").to_numpy()
            stretch = np.searchsorted(bounds, order, side="left")
            names = ["__stretch", "__ahead", *batch.schema.names]
            yield pa.RecordBatch.from_arrays([pa.array(stretch), pa.array(np.zeros(len(order), dtype=bool)), *batch.columns], names)
            for into, rows_ in ((stretch + 1, (stretch < len(bounds)) & (bounds[np.minimum(stretch, len(bounds) - 1)] == order) if len(bounds) else np.zeros(len(order), bool)), (stretch * 0, order == top)):
                if rows_.any():
                    part = batch.filter(pa.array(rows_))
                    yield pa.RecordBatch.from_arrays([pa.array(into[rows_]), pa.array(np.ones(part.num_rows, dtype=bool)), *part.columns], names)

    dealt = rows.mapInArrow(deal, "__stretch long, __ahead boolean, __ord long, doc_id long, text string")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(n, "__stretch").sortWithinPartitions("__stretch", "__ahead", F.col("__ord").desc(), "text")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row.

    The next document is the one after it by falling doc_id (rows of one doc_id go by text, rows without one come last), and
    the first after the last. Null texts count as empty. An edited text's fingerprint is derived from the document's own:
    the paragraphs from the cut on are deleted and those that replace them inserted.
    """
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the last row so far: its successor is still to come
        for batch in text_slices(batches, limit=2 << 20):
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("__stretch", "__ahead", "doc_id", "text")), strict=True))
            if held:
                rows.insert(0, held)
            own = [r[3] for r in rows]
            prints = vectors(own)
            pairs = [k for k in range(len(rows) - 1) if not rows[k][1] and rows[k + 1][0] == rows[k][0]]
            held = rows[-1]
            if not pairs:
                continue
            edited = [edited_text(own[k], own[k + 1]) for k in pairs]
            cuts = [own[k].rfind("\n", 0, len(own[k]) - len(own[k]) // 3) + 1 for k in pairs]
            gone = vectors([own[k][c:] for k, c in zip(pairs, cuts, strict=True)])
            come = vectors([e[c:] for e, c in zip(edited, cuts, strict=True)])
            here, there = (prints[0][pairs], prints[1][pairs]), (prints[0][[k + 1 for k in pairs]], prints[1][[k + 1 for k in pairs]])
            after = exchange(here, gone, come)
            yield pa.RecordBatch.from_arrays(
                [pa.array([rows[k][2] for k in pairs], pa.int64()), pa.array([len(own[k]) for k in pairs], pa.int64()),
                 pa.array([hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edited]), pa.array(printed(*here)), pa.array(printed(*after)),
                 pa.array(likeness(here, after)), pa.array(likeness(here, there))],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    stretches = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return _in_order(docs, stretches).select("__stretch", "__ahead", "doc_id", "text").mapInArrow(run, schema)
