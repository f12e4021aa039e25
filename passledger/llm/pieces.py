"""SentencePiece encoding and decoding with a table of distinct marked words.

White space is written as a mark in front of what follows it. Where no piece holds a mark after another character, a piece
never reaches from one marked word into the next, so a text is segmented word by word: each distinct marked word of a
batch is segmented once by the library, and its ids are laid out at every position of the word.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passledger.llm.common import text_slices
from passledger.llm.tokens import Memory

MARK = "▁"
#: Runs of spaces, or a space or mark at an end: the words are then cut by a pattern instead of at every space.
_RUNS = r"  |^ | $|▁"
_MARKED = re.compile(r" +[^ ]*")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class WordSegmenter:
    """For models with identity normalisation, a dummy prefix and no piece across a mark; others are refused."""

    def __init__(self, path: str, limit: int = 200_000):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        crossing = [p for p in map(self.library.id_to_piece, range(self.library.get_piece_size())) if MARK in p.lstrip(MARK)]
        odd = "  a ﬁ\t  b "
        if crossing or self.library.decode(self.library.encode(odd)) != odd:
            raise ValueError("pieces of this model cross white space, or it rewrites texts")
        self.mark = np.array([self.library.piece_to_id(MARK)], dtype="<u4").tobytes()
        self.words = Memory(limit)

    def _word_ids(self, words: list[str]) -> list[bytes]:
        """Ids of marked words, each given without its first mark."""

        def segment(new: list[str]) -> Iterator[bytes]:
            for w, ids in zip(new, self.library.encode(new, num_threads=1), strict=True):
                yield array("I", ids).tobytes() if w else self.mark

        return self.words.all(words, segment)

    def encode_all(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text without begin and end; no text may be null."""
        texts = texts.cast(pa.large_string())
        loose = pc.or_(pc.match_substring_regex(texts, _RUNS), pc.equal(texts, "")).to_numpy(zero_copy_only=False)
        out: list[np.ndarray | None] = [None] * len(texts)
        for k in np.flatnonzero(loose).tolist():
            text = texts[k].as_py().replace(MARK, " ")
            words = [w[1:] for w in _MARKED.findall(" " + text)] if text else []
            out[k] = np.frombuffer(b"".join(self._word_ids(words)), dtype="<u4")
        tight = np.flatnonzero(~loose)
        if len(tight) == 0:
            return out
        lists = pc.split_pattern(texts.take(pa.array(tight)), " ")
        first = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        coded = lists.flatten().dictionary_encode()
        index = coded.indices.to_numpy(zero_copy_only=False)
        distinct = self._word_ids(coded.dictionary.to_pylist())
        table = np.frombuffer(b"".join(distinct), dtype="<u4")
        sizes = np.fromiter((len(x) // 4 for x in distinct), dtype=np.int64, count=len(distinct))
        at = (np.cumsum(sizes) - sizes)[index]
        n = sizes[index]
        ends = np.cumsum(n)
        ids = table[np.arange(ends[-1]) + np.repeat(at - (ends - n), n)]
        bounds = np.append(ends - n, ends[-1])[first]
        for j, k in enumerate(tight.tolist()):
            out[k] = ids[bounds[j] : bounds[j + 1]]
        return out


@lru_cache(maxsize=2)
def segmenter(path: str) -> WordSegmenter:
    return WordSegmenter(path)


def encode_decode(docs: DataFrame, model: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: ids with begin and end, decoded again by the library; ids and decoded
    text too if asked for.

    A null text counts as empty: begin and end only. Repeated rows give repeated rows; an empty table gives none.
    """
    model = model or default_model()
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = segmenter(model)
        begin, end = np.array([[words.library.bos_id()], [words.library.eos_id()]], dtype="<u4")
        for batch in text_slices(batches, limit=8 << 20):
            sizes, sums, decoded_sums, kept, texts = [], [], [], [], []
            for ids in words.encode_all(batch.column("text")):
                ids = np.concatenate([begin, ids, end])
                decoded = words.library.decode(ids.tolist())
                sizes.append(len(ids))
                sums.append(hashlib.sha256(ids.tobytes()).hexdigest())
                decoded_sums.append(hashlib.sha256(decoded.encode()).hexdigest())
                if with_ids:
                    kept.append(ids.astype(np.int32))
                    texts.append(decoded)
            columns = [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(sums, pa.string()), pa.array(decoded_sums, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns += [pa.array(kept, pa.list_(pa.int32())), pa.array(texts, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, schema)
