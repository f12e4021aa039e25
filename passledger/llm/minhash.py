"""Near-duplicate documents: b-bit minhash signatures joined by multi-index Hamming search, and exact confirmation.

A document's set of word shingles gets a signature of 80 minhashes of 16 bits. Two sets of similarity s differ in about
80 (1 - s) places. The signature is split into 16 chunks of 5; two signatures that differ in at most 31 places differ, by the
pigeonhole principle, in at most one place of some chunk. So each chunk is looked up five times, once for every place that
may be wrong, by its other four places: all pairs within distance 31 meet. At similarity 0.75 that is 0.998 of all pairs, and more above.

Equal sets are taken together first. Where a key is shared by a few, all close pairs are candidates; where many share it,
representatives are chosen so that each member is close to one, and a member is paired with one of them only. After
these pairs are confirmed on the full sets, keys whose members are still not all connected are gone through again, block
by block, for the pairs between different components, keys that share members taken together: first each member's likeliest partners in each other component, then,
where these did not connect them, all others. Only members that may have a link to another component are looked at: two sets
of similarity 0.75 share one of their rarest shingles, so that texts with no more than a frequent passage in common stay out.
This look also has a sketch of 256 bins, which keeps pairs out that are far from similar: a pair of similarity 0.75 is kept
out with a chance of 1 in 30,000. No other pair within the distance is left out unless it is connected already.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passledger.llm.common import components, cut, text_slices
from passledger.operators.snapshots import may_occur

PLACES, CHUNKS, DISTANCE = 80, 16, 31
#: Bins of the finer sketch, and by how many standard deviations it may fall short of similarity 0.75.
BINS, DEVIATIONS = 256, 4.0
#: Signatures this near are taken as one neighbourhood when representatives are chosen.
NEAR = 16
FEW = 12
_B = np.uint64(0x9E3779B97F4A7C15)
_B_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _constants() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.Philox(key=5))
    byte = rng.integers(0, 1 << 64, 256, dtype=np.uint64)
    space = np.zeros(256, dtype=bool)
    space[[0x20, *range(0x09, 0x0E)]] = True
    return byte, space, rng.integers(0, 1 << 64, PLACES, dtype=np.uint64) | np.uint64(1), rng.integers(0, 1 << 64, max(64, PLACES), dtype=np.uint64) | np.uint64(1)


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(size, _B), np.full(size, _B_INVERSE)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def shingle_sets(texts: list[str], words: int = 5) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the word shingles of each text; of a shorter text, of its whole word sequence.

    Words are runs of bytes other than 09-0D and 20, A-Z lower-cased. Each gets a polynomial hash from running sums.
    """
    byte, space, _, odd = _constants()
    raw = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    data = np.frombuffer(b" " + b" ".join(raw) + b" ", dtype=np.uint8)
    up, down = _powers(1 << max(20, int(len(data) + 1).bit_length()))
    sums = np.cumsum(byte[data] * up[: len(data)], dtype=np.uint64)
    gap = space[data]
    starts = np.flatnonzero(gap[:-1] & ~gap[1:]) + 1
    ends = np.flatnonzero(~gap[:-1] & gap[1:]) + 1
    hashes = _mixed((sums[ends - 1] - sums[starts - 1]) * down[starts] + (ends - starts).astype(np.uint64) * odd[60])
    firsts = np.searchsorted(starts, 1 + np.cumsum([0, *(len(r) + 1 for r in raw)]))
    rolled = np.zeros(len(hashes), dtype=np.uint64)
    for k in range(min(words, len(hashes))):
        rolled[: len(hashes) - k] += hashes[k:] * odd[k]
    rolled = _mixed(rolled)
    out = []
    for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(rolled[a : b - words + 1]))
        elif b > a:
            out.append(_mixed((hashes[a:b] * odd[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(sets x PLACES) 16-bit minhashes; of an empty set, zeros."""
    out = np.zeros((len(sets), PLACES), dtype=np.uint16)
    full = np.flatnonzero([len(s) > 0 for s in sets])
    if len(full) == 0:
        return out
    sizes = [len(sets[k]) for k in full.tolist()]
    joined, starts = np.concatenate([sets[k] for k in full.tolist()]), np.cumsum([0, *sizes[:-1]])
    for p, m in enumerate(_constants()[2]):
        least = np.minimum.reduceat((joined ^ (m >> np.uint64(7))) * m, starts)
        out[full, p] = (_mixed(least) >> np.uint64(48)).astype(np.uint16)
    return out


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """(sets x BINS) bytes: of the smallest hash in each equal part of the hash range, 1 to 255; 0 where the set has none.

    Of the parts that either of two sets has something in, a share equal to their similarity agrees on average.
    """
    edges = np.arange(BINS, dtype=np.uint64) << np.uint64(64 - 8)
    out = np.zeros((len(sets), BINS), dtype=np.uint8)
    for k, s in enumerate(sets):
        if len(s):
            at = np.searchsorted(s, edges)
            low = s[np.minimum(at, len(s) - 1)]
            there = (at < len(s)) & (low >> np.uint64(56) == np.arange(BINS, dtype=np.uint64))
            out[k] = np.where(there, 1 + low % np.uint64(255), 0)
    return out


def _likely(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows of sketches: may they belong to sets of similarity 0.75, and the estimate of it."""
    either = ((a != 0) | (b != 0)).sum(axis=1)
    same = ((a == b) & (a != 0)).sum(axis=1)
    return same >= 0.75 * either - DEVIATIONS * np.sqrt(0.1875 * either), same / np.maximum(either, 1)


def chunk_keys(signature: np.ndarray) -> np.ndarray:
    """(signatures x PLACES) keys: each chunk without each one of its places; four places of 16 bits fill a key exactly."""
    size = PLACES // CHUNKS
    parts = signature.reshape(len(signature), CHUNKS, size).astype(np.uint64)
    keys = np.zeros((len(signature), CHUNKS, size), dtype=np.uint64)
    for gone in range(size):
        rest = [k for k in range(size) if k != gone]
        for k in rest:
            keys[:, :, gone] = keys[:, :, gone] << np.uint64(16) | parts[:, :, k]
    salt = _constants()[3][: CHUNKS * size].reshape(CHUNKS, size)
    return _mixed(keys ^ salt).reshape(len(signature), -1).view(np.int64)


def _nibbles(signature: np.ndarray) -> np.ndarray:
    """Four bits of each place, for a cheap lower bound of the distance: 40 bytes."""
    low = (signature & 15).astype(np.uint8)
    return low[:, 0::2] | low[:, 1::2] << 4


def _far(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(a x b) places in which nibble signatures differ."""
    x = a[:, None, :] ^ b[None, :, :]
    return ((x & 15) != 0).sum(axis=2) + ((x >> 4) != 0).sum(axis=2)


def _fits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Set sizes that allow a similarity of 0.75: the smaller is 3/4 of the larger or more."""
    return 4 * np.minimum(a[:, None], b[None, :]) >= 3 * np.maximum(a[:, None], b[None, :])


class _Run:
    """Members of one key as they stream by. Small runs give all close pairs; large ones pairs with representatives."""

    def __init__(self) -> None:
        self.n = 0
        self.few: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.centres: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    def add(self, rep: np.ndarray, size: np.ndarray, sig: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        self.n += len(rep)
        if self.centres is None and self.n <= FEW:
            self.few.append((rep, size, sig))
            return
        if self.few:
            rep, size, sig = (np.concatenate([*(f[k] for f in self.few), x]) for k, x in enumerate((rep, size, sig)))
            self.few = []
        for k in range(0, len(rep), 1024):
            yield from self._block(rep[k : k + 1024], size[k : k + 1024], sig[k : k + 1024])

    def _block(self, rep: np.ndarray, size: np.ndarray, sig: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """One pair for each member at most: with the first representative that it is near to, else with the nearest within
        the distance, and then it stands for others itself. What this leaves apart is for the second look."""
        n = len(rep)
        if self.centres is None:
            self.centres = rep[:0], size[:0], sig[:0]
        partner, reach, near = np.full(n, -1, dtype=np.int64), np.full(n, DISTANCE + 1), np.zeros(n, dtype=bool)
        if len(self.centres[0]):
            far = np.where(_fits(self.centres[1], size), _far(self.centres[2], sig), DISTANCE + 1)
            near = (far <= NEAR).any(axis=0)
            best = np.where(near, (far <= NEAR).argmax(axis=0), far.argmin(axis=0))
            reach = far[best, np.arange(n)]
            partner = np.where(reach <= DISTANCE, self.centres[0][best], -1)
        fresh: list[int] = []
        while not near.all():
            c = int(np.argmin(near))
            far = np.where(_fits(size[c : c + 1], size)[0], _far(sig[c : c + 1], sig)[0], DISTANCE + 1)
            far[c] = DISTANCE + 1
            better = ~near & (far < reach)
            better[fresh] = False
            partner[better], reach[better] = rep[c], far[better]
            near |= far <= NEAR
            near[c] = True
            fresh.append(c)
        there = partner >= 0
        yield partner[there], rep[there]
        keep = fresh[: max(0, 64 - len(self.centres[0]))]  # further ones are known in their own block only; what that leaves is found in the second look
        self.centres = tuple(np.concatenate([x, y[keep]]) for x, y in zip(self.centres, (rep, size, sig), strict=True))

    def end(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if self.few and self.n > 1:
            rep, size, sig = (np.concatenate([f[k] for f in self.few]) for k in range(3))
            i, j = np.nonzero(np.triu((_far(sig, sig) <= DISTANCE) & _fits(size, size), 1))
            yield rep[i], rep[j]


def _sig_rows(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(len(column), -1)


def _runs(batch: pa.RecordBatch, names: list[str]) -> Iterator[tuple[tuple, int, int]]:
    cols = [batch.column(c).to_numpy() for c in names]
    new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
    bounds = [0, *new.tolist(), batch.num_rows]
    for a, b in zip(bounds, bounds[1:], strict=False):
        yield tuple(int(c[a]) for c in cols), a, b


def described(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_shingles, h1, h2 (equal for equal sets), sig (minhashes, then the sketch), for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            sets = shingle_sets(batch.column("text").to_pylist())
            sig = signatures(sets)
            h1 = np.array([_mixed(s).sum(dtype=np.uint64) for s in sets], dtype=np.uint64).view(np.int64)
            h2 = np.array([_mixed(s ^ _B).sum(dtype=np.uint64) for s in sets], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array([len(s) for s in sets], pa.int64()), pa.array(h1), pa.array(h2), pa.array([r.tobytes() + k.tobytes() for r, k in zip(sig, sketches(sets), strict=True)], pa.binary())],
                ["doc_id", "text_hash", "n_shingles", "h1", "h2", "sig"])

    return (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
        .mapInArrow(run, "doc_id long, text_hash long, n_shingles long, h1 long, h2 long, sig binary")
    )


def _first_look(classes: DataFrame) -> DataFrame:
    """kind 0: candidate pairs (a, b); kind 1: members (a) of keys (b) that many share.

    Most keys are alone, so keys travel by themselves first; only those that occur again are given sizes and signatures.
    """

    def places(batch: pa.RecordBatch) -> np.ndarray:
        return np.ascontiguousarray(_sig_rows(batch.column("sig"))[:, : 2 * PLACES]).view("<u2")

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                found = chunk_keys(places(batch))
                take = pa.array(np.repeat(np.arange(len(found)), found.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(found.ravel()), batch.column("rep").take(take)], ["key", "rep"])

    def brief(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                small = pa.array([x.tobytes() for x in _nibbles(places(batch))], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("n_shingles").cast(pa.int32()), small], ["rep", "n", "sig"])

    full = classes.where("n_shingles > 0").select("rep", "n_shingles", "sig")
    along = Window.partitionBy("key").orderBy("rep")
    shared = cut(
        full.select("rep", "sig").mapInArrow(keys, "key long, rep long")
        .select("key", "rep", (F.lag("rep").over(along).isNotNull() | F.lead("rep").over(along).isNotNull()).alias("again"))
        .where("again").drop("again")
    )
    briefly = may_occur(full, shared, "rep", "asked").where("asked").drop("asked").mapInArrow(brief, "rep long, n int, sig binary")
    keyed = shared.join(briefly, "rep").select("key", "rep", "n", "sig")

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, last, first = _Run(), None, None

        def out(kind: int, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, dtype=np.int32)), pa.array(a), pa.array(b)], ["kind", "a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            reps, sizes, sigs = batch.column("rep").to_numpy(), batch.column("n").to_numpy(), _sig_rows(batch.column("sig"))
            made: list[tuple[np.ndarray, np.ndarray]] = []
            late: list[tuple[np.ndarray, np.ndarray]] = []
            for (key,), a, b in _runs(batch, ["key"]):
                if key != last:
                    made += run.end()
                    run, last, first = _Run(), key, None
                if b - a == 1 and run.n == 0 and b < batch.num_rows:
                    continue  # alone
                small_before = run.few
                made += run.add(reps[a:b], sizes[a:b], sigs[a:b])
                if run.centres is not None:
                    if first is None:
                        first = True
                        late += [(f[0], np.full(len(f[0]), key)) for f in small_before]
                    late.append((reps[a:b], np.full(b - a, key)))
            for kind, rows in ((0, made), (1, late)):
                if rows:
                    a, b = (np.concatenate([r[k] for r in rows]) for k in (0, 1))
                    yield out(kind, np.minimum(a, b) if kind == 0 else a, np.maximum(a, b) if kind == 0 else b)
        rest = list(run.end())
        for a, b in rest:
            yield out(0, np.minimum(a, b), np.maximum(a, b))

    return keyed.repartition("key").sortWithinPartitions("key", "rep").mapInArrow(pair, "kind int, a long, b long")


def _within_reach(crowd: DataFrame, ends: DataFrame, docs: DataFrame) -> DataFrame:
    """rep of those of the crowd (rep, text_hash) that may have a link to one of another component; of the others, none has.

    A link leaves at most a quarter of a set's shingles unshared, so whatever the order of all shingles, the first shared one
    is among the first floor(n / 4) + 1 of both sets. Shingles held in one component only come first, as they join nothing,
    then those of few holders. Who shares none of these first shingles with another component is out of its reach.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            sets = shingle_sets(batch.column("text").to_pylist())
            sizes = np.array([len(s) for s in sets], dtype=np.int64)
            take = pa.array(np.repeat(np.arange(len(sets)), sizes))
            shingles = np.concatenate([np.zeros(0, dtype=np.uint64), *sets]).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("rep").take(take), batch.column("component_id").take(take), pa.array(np.repeat(sizes, sizes).astype(np.int32)), pa.array(shingles)],
                ["rep", "component_id", "n", "shingle"])

    def met(rows: DataFrame) -> DataFrame:
        """The shingles held in several components, and how many hold them."""
        by_shingle = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("holders"), F.min("component_id").alias("low"), F.max("component_id").alias("high"))
        return cut(by_shingle.where("low <> high").select("shingle", "holders"))

    placed = crowd.join(ends.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component_id", F.coalesce("component_id", "rep"))
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), F.xxhash64("text").alias("text_hash"), "text")
    texts = may_occur(texts, crowd, "rep", "asked").where("asked").drop("asked")
    held = cut(
        texts.join(placed, ["rep", "text_hash"]).dropDuplicates(["rep", "text_hash"])
        .select("rep", "component_id", "text").mapInArrow(run, "rep long, component_id long, n int, shingle long")
    )
    one = Window.partitionBy("rep")
    first = cut(
        held.join(met(held), "shingle")
        .withColumn("alone", F.col("n") - F.count(F.lit(1)).over(one))
        .withColumn("place", F.row_number().over(one.orderBy("holders", "shingle")))
        .where("alone + place <= floor(n / 4) + 1").select("rep", "component_id", "shingle")
    )
    return first.join(met(first), "shingle", "left_semi").select("rep").distinct()


def _neighbourhoods(members: DataFrame, block_rows: int) -> DataFrame:
    """Members (a) of keys (b), with keys that hang together by shared members made one, so that a member that shares many
    keys with the same others is there once. Where that would send more rows around than the keys one by one, these stay."""
    home = cut(components(members.select("a", "b")))
    names = F.xxhash64("component_id").alias("b")  # not itself, which is one of the keys as a rule
    together = cut(members.select(F.col("a").alias("id")).distinct().join(home, "id").select(F.col("id").alias("a"), names))
    rows = F.sum(F.col("n") * F.ceil(F.col("n") / block_rows))
    sizes = members.groupBy(F.col("b").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    apart = cut(sizes.join(home, "id").select(F.col("id").alias("key"), names, "n"))
    fewer = cut(
        together.groupBy("b").agg(F.count(F.lit(1)).alias("n")).groupBy("b").agg(rows.alias("once"))
        .join(apart.groupBy("b").agg(rows.alias("each")), "b").where("each < once").select("b")
    )
    single = apart.join(fewer, "b", "left_semi").select(F.col("key").alias("b"))
    return cut(together.join(fewer, "b", "left_anti").unionByName(members.join(single, "b", "left_semi").select("a", "b")))


def _second_look(members: DataFrame, classes: DataFrame, ends: DataFrame, block_rows: int, best: int | None) -> DataFrame:
    """Candidates between different components, of the keys that many share and that are not all one component.

    A row (key, low, high, rep, partners) for each member of a pair of blocks, so that no row is made per pair. With `best`,
    the partners are as many for each member and other component, the likeliest; without, all. A pair counts in the first key
    that it shares.
    """
    placed = members.select(F.col("b").alias("key"), F.col("a").alias("rep")).join(ends.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component_id", F.coalesce("component_id", "rep"))
    placed = cut(placed)
    open_keys = (
        placed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("component_id").alias("low"), F.max("component_id").alias("high"))
        .where("low <> high").select("key", F.ceil(F.col("n") / block_rows).alias("blocks"))
    )
    dealt = (
        placed.join(open_keys, "key").join(classes.select("rep", F.col("n_shingles").cast("int").alias("n"), "sig"), "rep")
        .withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .select("key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "rep", "component_id", "n", "sig")
    )
    group = ["key", "low", "high"]

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None

        def done() -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held)
            block, low, high = (rows.column(c).to_numpy() for c in ("block", "low", "high"))
            rep, home, n = (rows.column(c).to_numpy() for c in ("rep", "component_id", "n"))
            whole = _sig_rows(rows.column("sig").combine_chunks())
            full = np.ascontiguousarray(whole[:, : 2 * PLACES]).view("<u2")
            sig, sketch, keys = _nibbles(full), whole[:, 2 * PLACES :], chunk_keys(full)
            this = int(np.append(np.flatnonzero((keys == rows.column("key")[0].as_py()).any(axis=0)), 0)[0])  # 0 for a neighbourhood
            left, right = np.flatnonzero(block == low[0]), np.flatnonzero(block == high[0])
            all_i, all_j = [], []
            for k in range(0, len(left), 64):
                part = left[k : k + 64]
                far = _far(sig[part], sig[right])
                i, j = np.nonzero((far <= DISTANCE) & (home[part][:, None] != home[right][None, :]) & _fits(n[part], n[right]))
                i, j = part[i], right[j]
                fresh = ~(keys[i, :this] == keys[j, :this]).any(axis=1)
                i, j = i[fresh], j[fresh]
                if low[0] == high[0]:
                    i, j = i[i < j], j[i < j]
                may, estimate = _likely(sketch[i], sketch[j])
                i, j, estimate = i[may], j[may], estimate[may]
                if best is not None and len(i):
                    order = np.lexsort((rep[j], -estimate, home[j], i))
                    i, j = i[order], j[order]
                    start = np.append(True, (i[1:] != i[:-1]) | (home[j[1:]] != home[j[:-1]]))
                    nth = np.arange(len(i)) - np.flatnonzero(start)[np.cumsum(start) - 1]
                    i, j = i[nth < best], j[nth < best]
                all_i.append(i)
                all_j.append(j)
            i, j = np.concatenate(all_i), np.concatenate(all_j)
            if len(i):
                order = np.argsort(i, kind="stable")
                there = np.unique(np.concatenate([i, j]))
                ends_ = np.searchsorted(i[order], there, side="right")
                partners = pa.ListArray.from_arrays(pa.array(np.append(0, ends_).astype(np.int32)), pa.array(rep[j[order]]))
                same = [pa.array(np.full(len(there), int(rows.column(c)[0].as_py()), dtype=np.int64)) for c in group]
                yield pa.RecordBatch.from_arrays([*same, pa.array(rep[there]), partners], [*group, "rep", "partners"])

        for batch in batches:
            if not batch.num_rows:
                continue
            for at, a, b in _runs(batch, group):
                if at != last and held:
                    yield from done()
                    held = []
                last = at
                held.append(batch.slice(a, b - a))
        if held:
            yield from done()

    placed_blocks = dealt.repartition(*group).sortWithinPartitions(*group, "rep")
    return placed_blocks.mapInArrow(pair, "key long, low long, high long, rep long, partners array<long>")


def _linked_blocks(blocks: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """Links (a, b) among the listed partners of each pair of blocks, confirmed on the full sets, as many as connect what is
    linked there. The texts of a pair of blocks meet in one task; a partner that is connected already is not compared."""
    group = ["key", "low", "high"]
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), F.xxhash64("text").alias("text_hash"), "text")
    texts = may_occur(texts, blocks, "rep", "asked").where("asked").drop("asked")
    asked = blocks.join(classes.select("rep", "text_hash"), "rep")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[int, np.ndarray] = {}
        partners: dict[int, list[int]] = {}
        last = None

        def done() -> Iterator[pa.RecordBatch]:
            home = {r: r for r in sets}

            def find(x: int) -> int:
                while home[x] != x:
                    home[x] = x = home[home[x]]
                return x

            found = []
            for a, others in partners.items():
                for b in others:
                    x, y = find(a), find(b)
                    if x != y:
                        common = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                        if 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                            home[x] = y
                            found.append((a, b))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["a", "b"])

        for batch in text_slices(batches):
            for at, a, b in _runs(batch, group):
                if at != last:
                    yield from done()
                    sets, partners, last = {}, {}, at
                part = batch.slice(a, b - a)
                reps = part.column("rep").to_pylist()
                sets.update(zip(reps, shingle_sets(part.column("text").to_pylist()), strict=True))
                partners.update((r, p) for r, p in zip(reps, part.column("partners").to_pylist(), strict=True) if p)
        yield from done()

    return (
        texts.join(asked, ["rep", "text_hash"]).select(*group, "rep", "partners", "text")
        .repartition(*group).sortWithinPartitions(*group, "rep").mapInArrow(link, "a long, b long").distinct()
    )


def confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, per_task: int = 500) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= 75 * union.

    The text of each b travels to its a; an a with very many partners is dealt to several tasks, each with a's own text.
    """
    parts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / per_task).alias("parts"))
    partners = pairs.join(parts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"), "b")
    heads = parts.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.col("a").alias("b"))
    asked = partners.unionByName(heads).join(classes.select(F.col("rep").alias("b"), "text_hash"), "b")
    asked = cut(asked)
    texts = docs.select(F.col("doc_id").cast("long").alias("b"), F.xxhash64("text").alias("text_hash"), "text")
    texts = may_occur(texts, asked, "b", "asked").where("asked").drop("asked")  # most texts stay where they are

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, head_set, last = None, None, None
        for batch in text_slices(batches):
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            sets = shingle_sets(batch.column("text").to_pylist())
            found = []
            for x, y, s in zip(a, b, sets, strict=True):
                if x == y:
                    head, head_set = x, s
                elif (x, y) != last:
                    assert x == head
                    common = len(np.intersect1d(head_set, s, assume_unique=True))
                    if 100 * common >= 75 * (len(s) + len(head_set) - common):
                        found.append((x, y))
                    last = (x, y)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["a", "b"])

    return (
        texts.join(asked, ["b", "text_hash"]).select("a", "part", "b", "text")
        .repartition("a", "part").sortWithinPartitions("a", "part", F.col("b") != F.col("a"), "b").mapInArrow(check, "a long, b long")
    )


def near_duplicates(docs: DataFrame, block_rows: int = 512) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row.

    Rows without text or words, or without doc_id, link with nothing. Rows that repeat a doc_id count as one document: they
    share its component, and if their texts differ, the one with the smaller hash stands for them.
    """
    rows = cut(described(docs))
    classes = cut(
        rows.where("n_shingles > 0 and doc_id is not null")
        .groupBy("n_shingles", "h1", "h2").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"), F.first("sig").alias("sig"))
        .groupBy(F.col("first.doc_id").alias("rep")).agg(F.min(F.struct("first.text_hash", "n_shingles", "h1", "h2", "sig")).alias("x"))
        .select("rep", "x.*")
    )
    found = cut(_first_look(classes))
    pairs = cut(found.where("kind = 0").select("a", "b").distinct())
    links = cut(confirmed(pairs, classes, docs))
    ends = cut(components(links))
    members = found.where("kind = 1")
    if not members.isEmpty():
        crowd = members.select(F.col("a").alias("rep")).distinct()
        some = may_occur(classes.select("rep", "text_hash"), crowd, "rep", "asked").where("asked").drop("asked")
        crowd = cut(some.join(crowd, "rep", "left_semi"))
        reach = cut(_within_reach(crowd, ends, docs))
        members = _neighbourhoods(cut(members.select("a", "b").join(reach.withColumnRenamed("rep", "a"), "a", "left_semi")), block_rows)
        crowd = cut(may_occur(classes, reach, "rep", "asked").where("asked").drop("asked"))  # signatures of the others stay where they are
        likely = cut(_second_look(members, crowd, ends, block_rows, 2))
        if not likely.isEmpty():
            links = cut(links.unionByName(_linked_blocks(likely, classes, docs)))
            ends = cut(components(links))
        rest = cut(_second_look(members, crowd, ends, block_rows, None))
        if not rest.isEmpty():
            ends = cut(components(links.unionByName(_linked_blocks(rest, classes, docs))))
    by_class = (
        classes.join(ends.withColumnRenamed("id", "rep"), "rep", "left")
        .select(*(F.col(c).alias(f"__{c}") for c in ("n_shingles", "h1", "h2")), F.coalesce("component_id", "rep").alias("__c"))
    )
    joined = rows.join(by_class, [F.col(c) == F.col(f"__{c}") for c in ("n_shingles", "h1", "h2")], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("__c", "doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
