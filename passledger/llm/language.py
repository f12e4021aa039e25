"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. An n-gram's vector binds its letters: each is permuted (rotated) by its
place and all are multiplied. A document's vector bundles (adds) the vectors of all its n-grams, a language's prototype
those of all its training documents, and a document is given to the prototype with the largest cosine. Bundling is linear,
so an n-gram is bound once per batch and weighted by its counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passledger.llm.common import text_slices

UNDETERMINED = "und"
N_GRAM = 3
DIMENSIONS = 1024


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Code point -> its lower-case letter, or 0 for what is no letter. Lower-casing to several code points keeps the first."""
    table = np.zeros(0x110000, dtype=np.int32)
    for c in range(0x110000):
        if not 0xD800 <= c < 0xE000:
            ch = chr(c)
            if ch.isalpha():
                table[c] = ord(ch.lower()[0])
    return table


@lru_cache(maxsize=4096)
def _letter_vector(code: int, dimensions: int) -> np.ndarray:
    return np.random.Generator(np.random.Philox(key=code)).integers(0, 2, dimensions, dtype=np.int8) * 2 - 1


def _grams(texts: list[str | None], groups: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(alphabet, distinct n-grams as rows of places in it, and for each n-gram met: its number and its group).

    A run of other characters than letters counts as one gap (code 0) between words, and a text starts and ends with one.
    """
    codes = np.frombuffer("\n".join(t or "" for t in texts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    codes = np.concatenate([[0], _letters()[codes], [0]]).astype(np.int32)
    sizes = np.array([len(t) if t else 0 for t in texts], dtype=np.int64) + 1
    owner = np.repeat(groups, sizes)
    owner = np.concatenate([owner[:1], owner])[: len(codes)] if len(owner) else np.zeros(len(codes), dtype=np.int64)
    keep = np.append(True, (codes[1:] != 0) | (codes[:-1] != 0))
    codes, owner = codes[keep], owner[keep]
    alphabet, index = np.unique(codes, return_inverse=True)
    if len(codes) < N_GRAM:
        return alphabet, np.zeros((0, N_GRAM), dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    grams = np.zeros(len(codes) - N_GRAM + 1, dtype=np.int64)
    for k in range(N_GRAM):
        grams = grams * len(alphabet) + index[k : k + len(grams)]
    middle = codes[1:-1] != 0  # a gap in the middle joins words, or texts, that have nothing to do with each other
    grams, owner = grams[middle], owner[1:-1][middle]
    distinct, column = np.unique(grams, return_inverse=True)
    places = np.stack([distinct // len(alphabet) ** (N_GRAM - 1 - k) % len(alphabet) for k in range(N_GRAM)], axis=1)
    return alphabet, places, column, owner


def bundles(texts: list[str | None], groups: np.ndarray | None = None, dimensions: int = DIMENSIONS, cells: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
    """The bundled vector of each group of texts, a text by default, and how many n-grams it has.

    Counts are a matrix of so many groups at a time that it has about `cells` cells, however many short texts come together.
    """
    groups = np.arange(len(texts)) if groups is None else groups
    n_groups = int(groups.max()) + 1 if len(groups) else 0
    alphabet, places, column, owner = _grams(texts, groups)
    vectors, found = np.zeros((n_groups, dimensions), dtype=np.float32), np.bincount(owner, minlength=n_groups)
    if len(places) == 0:
        return vectors, found
    order = np.argsort(owner, kind="stable")
    column, owner = column[order], owner[order]
    each, n = bound(alphabet, places, dimensions), len(places)
    step = max(1, cells // n)
    for first in range(0, n_groups, step):
        size = min(step, n_groups - first)
        a, b = np.searchsorted(owner, [first, first + size])
        counts = np.bincount((owner[a:b] - first) * n + column[a:b], minlength=size * n).reshape(size, n).astype(np.float32)
        vectors[first : first + size] = counts @ each
    return vectors, found


def bound(alphabet: np.ndarray, places: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Vectors of n-grams: letters rotated by their place and multiplied."""
    letters = np.stack([_letter_vector(int(c), dimensions) for c in alphabet])
    out = np.ones((len(places), dimensions), dtype=np.int8)
    for k in range(places.shape[1]):
        out *= np.roll(letters, k, axis=1)[places[:, k]]
    return out.astype(np.float32)


def learn(labelled: DataFrame, dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """Prototypes from all rows of (text, lang) with a language and letters: one vector of `dimensions` numbers a language.

    Tasks add up their n-grams by language and send vectors only; what reaches the driver is one vector a language.
    """

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in text_slices(batches, limit=4 << 20):
            names, groups = np.unique(batch.column("lang").to_pylist(), return_inverse=True)
            vectors, _ = bundles(batch.column("text").to_pylist(), groups, dimensions)
            for name, vector in zip(names.tolist(), vectors.astype(np.float64), strict=True):
                sums[name] = sums[name] + vector if name in sums else vector
        if sums:
            yield pa.RecordBatch.from_pydict({"lang": list(sums), "vector": [v.tolist() for v in sums.values()]})

    parts = labelled.where("lang is not null and text is not null").select("lang", "text").mapInArrow(bundle, "lang string, vector array<double>")
    total = (
        parts.select("lang", F.posexplode("vector")).groupBy("lang", "pos").agg(F.sum("col").alias("x"))
        .groupBy("lang").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("vector"))
    )
    out = {}
    for row in total.collect():
        vector = np.array(row["vector"])
        if (size := np.linalg.norm(vector)) > 0:
            out[row["lang"]] = vector / size
    return out


def language(text: Column, prototypes: dict[str, np.ndarray]) -> Column:
    """struct<lang, score>: the nearest prototype and its cosine (0 at least). `und` and 0 for null, for texts without letters,
    and where nothing was learnt. Of equal cosines the language that sorts first wins."""
    names = sorted(prototypes)
    matrix = np.stack([prototypes[n] for n in names]).T.astype(np.float32) if names else np.zeros((DIMENSIONS, 0), dtype=np.float32)

    @F.pandas_udf("lang string, score double")
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for series in texts:
            langs, scores = np.full(len(series), UNDETERMINED, dtype=object), np.zeros(len(series))
            sizes = np.cumsum(series.str.len().fillna(0).to_numpy())
            for part in np.split(np.arange(len(series)), np.flatnonzero(np.diff(sizes // (1 << 20))) + 1):
                if len(part) == 0 or not names:
                    continue
                vectors, grams = bundles(series.iloc[part].tolist(), None, len(matrix))
                length = np.linalg.norm(vectors, axis=1)
                cosine = (vectors @ matrix) / np.where(length > 0, length, 1)[:, None]
                best = cosine.argmax(axis=1)
                found = grams > 0
                langs[part] = np.where(found, np.array(names, dtype=object)[best], UNDETERMINED)
                scores[part] = np.where(found, cosine[np.arange(len(part)), best].clip(0, 1), 0)
            yield pd.DataFrame({"lang": langs, "score": scores.astype(float)})

    return predict(text)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text leaves 2 when divided by 4. Null ids are kept out too."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def learn_from_documents(docs: DataFrame) -> dict[str, np.ndarray]:
    return learn(docs.where(~held_out(F.col("doc_id"))))


def identified(docs: DataFrame, prototypes: dict[str, np.ndarray] | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; prototypes are learnt from the rows that are not held out."""
    prototypes = learn_from_documents(docs) if prototypes is None else prototypes
    found = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), language(F.col("text"), prototypes).alias("__found"))
    return found.select("doc_id", "held_out", F.col("__found.lang").alias("lang_pred"), F.col("__found.score").alias("score"))
