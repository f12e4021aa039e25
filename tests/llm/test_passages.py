import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from passledger.llm import passages

from .conftest import make_text

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_hand(texts, window):
    """(n_words, n_removed, kept text) per text: every window is counted."""
    split = [WORD.findall(t or "") for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for words in split:
        gone = set()
        for i in range(len(words) - window + 1):
            if seen[tuple(words[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((len(words), len(gone), " ".join(w for k, w in enumerate(words) if k not in gone)))
    return out


def corpus(seed):
    """Documents that share passages of many lengths, with edits, repeats inside a text, copies and overlapping shares."""
    rng = random.Random(seed)
    passage = [make_text(rng, "en", n).split() for n in (34, 35, 36, 40, 55, 56, 90, 200)]
    texts = []
    for k in range(150):
        words = []
        for _ in range(rng.randrange(1, 5)):
            if rng.random() < 0.5:
                part = list(rng.choice(passage))
                if rng.random() < 0.4:
                    part[rng.randrange(len(part))] = f"edit{k}"
                a = rng.randrange(0, 6)
                words += part[a : len(part) - rng.randrange(0, 6)]
            else:
                words += make_text(rng, rng.choice(["en", "de"]), rng.randrange(1, 80)).split()
        texts.append(rng.choice([" ", "\n", " \t "]).join(words))
    texts += ["same word " * 60, "a " * 36, "a " * 35, "a " * 34, "x y " * 300, texts[3], texts[3], texts[4] + " tail"]
    return texts


@pytest.mark.parametrize("window,seed", [(35, 1), (35, 2), (35, 3), (8, 4), (13, 5), (2, 6)])
def test_passages_by_hand(frame, window, seed):
    texts = corpus(seed) if window == 35 else [t[:300] for t in corpus(seed)]
    got = {r.doc_id: r for r in passages.passage_report(frame(texts), window).collect()}
    want = by_hand(texts, window)
    assert sum(w[1] > 0 for w in want) > 20
    for k, (n, gone, kept) in enumerate(want):
        assert (got[k].n_words, got[k].n_removed) == (n, gone), k
        assert got[k].kept_sha256 == hashlib.sha256(kept.encode()).hexdigest()


def test_stretches_do_not_change_the_result(frame):
    """Keys at the edges of stretches are settled apart; with stretches of a few rows all of them are."""
    docs = frame(corpus(7))
    rows = passages.anchor_rows(docs)
    whole = Counter((r.doc, r.place, r.kind) for r in passages.anchor_marks(rows).collect())
    for size in (1, 50, 1000):
        assert Counter((r.doc, r.place, r.kind) for r in passages.anchor_marks(rows, size).collect()) == whole


def test_odd_rows(strange, frame):
    """Null, empty and long texts, repeated rows, clashing names, an empty table."""
    docs = strange.withColumns({c: F.lit(7) for c in ("__doc", "__text_key", "__lost", "__mdoc", "repeats", "__repeats")})
    want = Counter((hashlib.sha256(w[2].encode()).hexdigest(), w[0], w[1]) for w in by_hand([r.text for r in docs.collect()], 35))
    got = passages.passage_report(docs).collect()
    assert Counter((r.kept_sha256, r.n_words, r.n_removed) for r in got) == want
    out = passages.without_repeats(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert out.where("__doc = 7 and __lost = 7 and repeats = 7").count() == docs.count()
    assert passages.passage_report(docs.limit(0)).count() == 0
    long = " ".join(f"w{k}" for k in range(40))
    rows = [(None, long), (None, "other " * 10), (None, None), (5, long), (5, "tail " + long), (6, "short")]
    got = Counter((r.doc_id, r.n_words, r.n_removed) for r in passages.passage_report(frame(rows)).collect())
    assert got == Counter([(None, 40, 40), (None, 10, 0), (None, 0, 0), (5, 40, 40), (5, 41, 40), (6, 1, 0)])
    kept = {r.text for r in passages.without_repeats(frame(rows)).collect()}
    assert kept == {"", "other " * 10, None, "tail", "short"}


def test_rows_grow_with_the_group_and_not_its_square(frame):
    rng = random.Random(3)
    base = make_text(rng, "en", 200)

    def made(n):
        docs = frame([f"start{k} " + base + f" end{k}" for k in range(n)])
        marks = passages.anchor_marks(passages.anchor_rows(docs))
        return marks.count()

    assert made(200) < 2.2 * made(100)


def test_copies_at_the_edge_of_a_stretch_send_one_row():
    """Of a key that other stretches may hold, each context sends its first row and a count, however many rows it has."""
    import pandas as pd

    stretch = pd.DataFrame({"h": 1, "context": [5] * 1000 + [6], "doc": range(1001), "place": 0})
    decided, late = passages._judge(stretch)
    assert late[["context", "doc", "same"]].values.tolist() == [[5, 0, 1000], [6, 1000, 1]]
    assert len(decided) == 999 and (decided.kind == passages.REPEATED).all()
