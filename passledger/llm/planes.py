"""Token-id files as compressed bit planes.

A file holds the ids of many documents in blocks of a fixed number of ids. A block is turned by 90 degrees: plane k holds
bit k of all its ids, packed eight to a byte, and is compressed by itself with zstandard. High planes of frequent (small)
ids are mostly zero and shrink to almost nothing. The file ends in an index: where each block starts, how many ids it
holds and how long each of its planes is, and the id and length of each document.

Layout, little-endian: magic `PLBP0002`; the planes of all blocks; the index (a zstandard frame of int64 values: blocks,
documents, documents without id, then per block offset, ids, planes and each plane's length, then all document ids, then
all lengths); the index's offset and length (two int64); the magic again. Documents without id come first; 0 stands in
their place.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passledger.llm.common import cut, text_slices
from passledger.llm.tokens import default_tokenizer, encoder
from passledger.session import ensure_checkpoint_dir

MAGIC = b"PLBP0002"
BLOCK = 1 << 16


def to_planes(ids: np.ndarray, level: int = 3) -> list[bytes]:
    """Compressed bit planes of a block, lowest bit first; as many as its largest id has bits, one at least."""
    width = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    columns = np.ascontiguousarray(np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4).T)
    press = zstandard.ZstdCompressor(level=level)
    return [press.compress(np.packbits(columns[k // 8] & (1 << k % 8), bitorder="little").tobytes()) for k in range(width)]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    columns = np.zeros((4, n), dtype=np.uint8)
    opener = zstandard.ZstdDecompressor()
    for k, plane in enumerate(planes):
        columns[k // 8] |= np.unpackbits(np.frombuffer(opener.decompress(plane), dtype=np.uint8), bitorder="little")[:n] << (k % 8)
    return np.ascontiguousarray(columns.T).reshape(-1).view("<u4")


def file_bytes(doc_ids: list[int | None], documents: list[np.ndarray], block: int = BLOCK) -> bytes:
    """The file of some documents, in the order given; those without id must come first."""
    nameless = sum(d is None for d in doc_ids)
    if any(d is None for d in doc_ids[nameless:]):
        raise ValueError("documents without id come first")
    ids = np.concatenate(documents) if documents else np.zeros(0, dtype="<u4")
    body, index, at = [MAGIC], [], len(MAGIC)
    for k in range(0, len(ids), block):
        part = ids[k : k + block]
        planes = to_planes(part)
        index += [at, len(part), len(planes), *map(len, planes)]
        body += planes
        at += sum(map(len, planes))
    blocks = -(-len(ids) // block)
    values = np.array([blocks, len(doc_ids), nameless, *index, *[0] * nameless, *doc_ids[nameless:], *map(len, documents)], dtype="<i8")
    tail = zstandard.ZstdCompressor().compress(values.tobytes())
    return b"".join([*body, tail, np.array([at, len(tail)], dtype="<i8").tobytes(), MAGIC])


def read_file(content: bytes) -> Iterator[tuple[int | None, np.ndarray]]:
    """(document id or None, ids) in file order. Blocks are opened as the documents reach them."""
    if content[: len(MAGIC)] != MAGIC or content[-len(MAGIC) :] != MAGIC:
        raise ValueError("not a bit-plane file")
    at, size = np.frombuffer(content[-len(MAGIC) - 16 : -len(MAGIC)], dtype="<i8").tolist()
    values = np.frombuffer(zstandard.ZstdDecompressor().decompress(content[at : at + size]), dtype="<i8").tolist()
    blocks, docs, nameless, p = *values[:3], 3
    index = []
    for _ in range(blocks):
        offset, n, width = values[p : p + 3]
        index.append((offset, n, values[p + 3 : p + 3 + width]))
        p += 3 + width
    doc_ids, lengths = [None] * nameless + values[p + nameless : p + docs], values[p + docs : p + 2 * docs]
    held, k = np.zeros(0, dtype="<u4"), 0
    for doc, n in zip(doc_ids, lengths, strict=True):
        parts, have = [held], len(held)
        while have < n:
            offset, m, sizes = index[k]
            ends = offset + np.cumsum(sizes)
            parts.append(from_planes([content[e - s : e] for e, s in zip(ends.tolist(), sizes, strict=True)], m))
            have, k = have + m, k + 1
        held = np.concatenate(parts) if len(parts) > 1 else held
        yield doc, held[:n]
        held = held[n:]


def _store(folder: str, name: str, content: bytes) -> None:
    """Write under a name of its own, by pyarrow's file systems (local, HDFS, object stores)."""
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(folder)
    system.create_dir(root, recursive=True)
    with system.open_output_stream(f"{root}/{name}") as out:
        out.write(content)


def write_token_files(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = 2, file_ids: int = 1 << 22) -> DataFrame:
    """Encode `text` (null: empty), append `end_id`, and write bit-plane files in ascending doc_id order.

    Documents are range-partitioned and sorted by doc_id; each task writes its range, a new file after about `file_ids`
    ids, so a task holds one file. Returns the stored manifest: part, seq, file, docs, ids. A task that runs again writes
    files under other names, and only those that the manifest names are read. Documents without doc_id come before all
    others and are spread by a hash of their text; rows of one doc_id follow each other by text. Repeated rows are written
    as often as they occur.
    """
    tokenizer = tokenizer or default_tokenizer()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        doc_ids: list[int | None] = []
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal seq, size
            name = f"ids-{part:06d}-{seq:05d}-{uuid.uuid4().hex[:12]}.plbp"
            _store(folder, name, file_bytes(doc_ids, held))
            row = pa.RecordBatch.from_pydict({"part": [part], "seq": [seq], "file": [name], "docs": [len(doc_ids)], "ids": [size]},
                                             schema=pa.schema([("part", pa.int64()), ("seq", pa.int64()), ("file", pa.string()), ("docs", pa.int64()), ("ids", pa.int64())]))
            doc_ids.clear()
            held.clear()
            seq, size = seq + 1, 0
            return row

        end = np.array([end_id], dtype="<u4")
        for batch in text_slices(batches, limit=4 << 20):
            for doc, ids in zip(batch.column("doc_id").to_pylist(), encoder(tokenizer).encode_all(batch.column("text")), strict=True):
                doc_ids.append(doc)
                held.append(np.append(ids, end))
                size += len(ids) + 1
                if size >= file_ids:
                    yield flush()
        if doc_ids:
            yield flush()

    dealt = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
        .repartitionByRange("doc_id", F.when(F.col("doc_id").isNull(), F.xxhash64("text"))).sortWithinPartitions("doc_id", "text")
    )
    return cut(dealt.mapInArrow(write, "part long, seq long, file string, docs long, ids long"))


def read_token_files(manifest: DataFrame, folder: str, with_ids: bool = False) -> DataFrame:
    """doc_id (null where it was null), start (ids of all documents before it), n_tokens, ids_crc32, and the ids themselves if asked for."""
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    starts = manifest.select("file", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, content in zip(batch.column("base").to_pylist(), batch.column("content"), strict=True):
                docs, starts_, sizes, sums, all_ids = [], [], [], [], []
                at = base
                for doc, ids in read_file(content.as_py()):
                    docs.append(doc)
                    starts_.append(at)
                    sizes.append(len(ids))
                    sums.append(zlib.crc32(ids.astype("<u4").tobytes()))
                    at += len(ids)
                    if with_ids:
                        all_ids.append(ids.astype(np.int64))
                columns = [pa.array(x, pa.int64()) for x in (docs, starts_, sizes, sums)]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array(all_ids, pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    spark = manifest.sparkSession
    files = (
        spark.read.schema("path string, modificationTime timestamp, length long, content binary").format("binaryFile").load(folder)
        .select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    )
    return files.join(starts, "file").select("base", "content").mapInArrow(read, schema)


def token_files(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2) -> DataFrame:
    """Write `docs` to new files in the shared folder and read them back. An empty table gives no rows."""
    folder = f"{ensure_checkpoint_dir(docs.sparkSession).rstrip('/')}/token-files-{uuid.uuid4().hex}"
    if "://" not in folder:
        folder = f"file://{folder}" if not folder.startswith("file:") else folder
    manifest = write_token_files(docs, folder, tokenizer, end_id)
    if manifest.isEmpty():
        return docs.sparkSession.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return read_token_files(manifest, folder)
