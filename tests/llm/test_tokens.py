import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest

from passledger.llm import packing, pieces, planes
from passledger.llm.tokens import ChunkEncoder, default_tokenizer

from .conftest import ODD_TEXTS

TEXTS = [t or "" for t in ODD_TEXTS]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_tokenizer())


@pytest.mark.parametrize("limit", [3, 200_000])
def test_chunks_give_the_librarys_ids(library, limit):
    encoder = ChunkEncoder(default_tokenizer(), limit=limit)
    for _ in range(2):  # with and without remembered chunks
        got = encoder.encode_all(pa.array(TEXTS))
        assert [x.tolist() for x in got] == [library.encode(t, add_special_tokens=False).ids for t in TEXTS]


def test_planes_round_trip():
    rng = np.random.default_rng(1)
    for ids in (np.zeros(0), np.zeros(9), np.array([2**32 - 1, 0, 7]), rng.integers(0, 50_257, 70_001), rng.integers(0, 3, 8)):
        ids = ids.astype("<u4")
        assert (planes.from_planes(planes.to_planes(ids), len(ids)) == ids).all()


def test_file_round_trip_across_blocks():
    rng = np.random.default_rng(2)
    docs = [rng.integers(0, 50_257, n).astype("<u4") for n in (0, 1, 999, 1000, 1001, 3500, 5)]
    content = planes.file_bytes(list(range(7)), docs, block=1000)
    back = list(planes.read_file(content))
    assert [d for d, _ in back] == list(range(7))
    assert all((a == b).all() and len(a) == len(b) for (_, a), b in zip(back, docs, strict=True))
    with pytest.raises(ValueError, match="bit-plane"):
        list(planes.read_file(b"PLBP0001 and nothing that ends it"))


def test_documents_without_id_come_first_in_a_file():
    docs = [np.arange(n, dtype="<u4") for n in (3, 0, 5)]
    back = list(planes.read_file(planes.file_bytes([None, None, -4], docs)))
    assert [d for d, _ in back] == [None, None, -4]
    assert all((a == b).all() for (_, a), b in zip(back, docs, strict=True))
    with pytest.raises(ValueError, match="first"):
        planes.file_bytes([1, None], docs[:2])


def expected_ids(library, docs):
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: r[0])
    return [(d, np.array([*library.encode(t, add_special_tokens=False).ids, 2], dtype="<u4")) for d, t in rows]


def test_token_files(library, strange):
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in planes.token_files(strange).collect())
    want, at = [], 0
    for doc, ids in expected_ids(library, strange):
        want.append((at, doc, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want
    assert planes.token_files(strange.limit(0)).count() == 0


def test_token_files_of_rows_without_doc_id(library, spark, frame):
    """They come first, whole and as often as they occur; a third of all rows may be such."""
    texts = [f"nameless {k % 40} text" for k in range(60)] + [None, None]
    rows = [(None, t) for t in texts] + [(k, f"text of {k}") for k in range(-3, 120)] + [(7, "another text of 7"), (7, None)]
    got = sorted(planes.token_files(frame(rows).repartition(5)).collect(), key=lambda r: (r.start, r.n_tokens))
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    ids = [r.doc_id for r in got]
    assert ids[: len(texts)] == [None] * len(texts) and ids[len(texts):] == sorted(d for d, _ in rows if d is not None)
    coded = [(d, np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4")) for d, t in rows]
    want = sorted((d is not None, d or 0, len(x), zlib.crc32(x.tobytes())) for d, x in coded)
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in got) == want
    assert sorted(r.ids_crc32 for r in planes.token_files(frame([(None, "a"), (None, None)])).collect()) == sorted(
        zlib.crc32(np.array([*library.encode(t, add_special_tokens=False).ids, 2], dtype="<u4").tobytes()) for t in ("a", ""))


def test_packing_places_every_token_once(library, strange):
    rows = packing.packed(strange).collect()
    ids = expected_ids(library, strange)
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(
        (doc, k, a, b - a, zlib.crc32(x[a:b].tobytes()))
        for doc, x in ids for cuts in [[0, *range(len(x) % 1024 or 1024, len(x) + 1, 1024)]] for k, (a, b) in enumerate(zip(cuts, cuts[1:]))
    )
    held = {}
    for r in rows:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.packed(strange.limit(0)).count() == 0


def test_plan_keeps_every_capacity():
    rng = np.random.default_rng(3)
    sizes, counts = np.unique(rng.integers(1, 100, 3000), return_counts=True)
    cap = packing.Capacity(tokens=100, documents=4, cost=6000)
    with pytest.raises(ValueError, match="fits into no sequence"):
        packing.plan({99: 1}, packing.Capacity(tokens=100, cost=9000))
    keep = {int(s): int(n) for s, n in zip(sizes, counts) if s * s <= 6000}
    rows = packing.plan(keep, cap)
    bins = {}
    for size, n in keep.items():
        mine = rows[rows[:, 0] == size]
        for rank in range(n):
            _, low, seq, each, _ = mine[np.searchsorted(mine[:, 1], rank, side="right") - 1]
            bins.setdefault(seq + (rank - low) // each, []).append(size)
    assert sum(map(len, bins.values())) == sum(keep.values())
    assert all(sum(b) <= 100 and len(b) <= 4 and sum(x * x for x in b) <= 6000 for b in bins.values())


def test_plan_is_close_to_the_bound():
    rng = np.random.default_rng(4)
    sizes, counts = np.unique(np.minimum(rng.exponential(300, 20_000).astype(int) + 1, 1024), return_counts=True)
    histogram = dict(zip(sizes.tolist(), counts.tolist()))
    rows = packing.plan(histogram)
    used = rows[:, 2].max() + 1  # the last group of equal sequences may hold more; its rows say how many pieces each takes
    last = rows[rows[:, 2] == used - 1]
    used += max(-(-(histogram[int(s)] - int(low)) // int(each)) for s, low, _, each, _ in last) - 1
    assert used <= 1.01 * sum(s * n for s, n in histogram.items()) / 1024 + 1


@pytest.mark.parametrize("limit", [3, 200_000])
def test_marked_words_give_the_librarys_ids(limit):
    words = pieces.WordSegmenter(pieces.default_model(), limit=limit)
    got = words.encode_all(pa.array(TEXTS))
    assert [x.tolist() for x in got] == [words.library.encode(t) for t in TEXTS]


def test_encode_decode(strange):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    want = []
    for r in strange.collect():
        ids = library.encode(r.text or "", add_bos=True, add_eos=True)
        want.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    got = pieces.encode_decode(strange, with_ids=True)
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got.collect()) == sorted(want)
    assert all(r.ids[0] == 1 and r.ids[-1] == 2 for r in got.collect())
    assert pieces.encode_decode(strange.limit(0)).count() == 0
