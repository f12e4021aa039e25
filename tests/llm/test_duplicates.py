import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, IntegerType, LongType, StructField, StructType

from passledger.llm import embeddings, lines, minhash
from passledger.llm.common import components, cut, rank_in_groups

from .conftest import make_text


def smallest_reachable(ids, links):
    home = {i: i for i in ids}

    def find(x):
        while home[x] != x:
            x = home[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        home[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_components(spark):
    rng = random.Random(1)
    chain = [(k, k + 1) for k in range(40)]
    star = [(100, k) for k in range(101, 160)]
    loose = [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)]
    links = [*chain, *star, *loose, (500, 501), (501, 500), (600, 600)]
    ids = {x for a, b in links for x in (a, b) if a != b}
    want = smallest_reachable(ids, [x for x in links if x[0] != x[1]])
    for per_task in (20, 70, 500_000):
        got = components(spark.createDataFrame(links, "a long, b long"), edges_per_task=per_task).collect()
        assert {r.id: r.component_id for r in got} == want and len(got) == len(want)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_ranks_in_a_hot_group(spark):
    rows = cut(spark.range(500).select("id", F.when(F.col("id") % 3 == 0, F.col("id") % 7).alias("g")))
    got = rank_in_groups(rows, ["g"], ["id"], ["id"], "r", block_rows=20).collect()
    ranks = {}
    for r in got:
        ranks.setdefault(r.g, []).append(r.r)
    assert len(got) == 500 and all(sorted(v) == list(range(len(v))) for v in ranks.values())


# --- lines

STRIP = " \t\n\x0b\x0c\r"


def lines_by_hand(rows):
    """(doc_id, n_lines, n_dropped, kept text) of (doc_id, text) rows."""
    def key(line):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(STRIP))

    holders = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 20:
                holders.setdefault(key(line), set()).add(-(2**63) if doc is None else doc)
    out = []
    for doc, text in rows:
        parts = (text or "").split("\n")
        keep = [x for x in parts if not (len(holders.get(key(x), ())) >= 3 and max(holders[key(x)]) != (-(2**63) if doc is None else doc))]
        out.append((doc, len(parts), len(parts) - len(keep), "\n".join(keep)))
    return out


def line_rows(rng):
    common = ["this line stands in very many documents", "  This line is in some documents\t", "short", "exactly twenty chars", "nineteen characters", "Ünder zwänzig Zeichen ä"]
    rows = []
    for doc in range(120):
        parts = [common[0].upper() if doc % 2 else common[0]] + [rng.choice(common) for _ in range(rng.randrange(6))] + [f"a line of document {doc // 2} alone, more or less"]
        rng.shuffle(parts)
        rows.append((doc, "\n".join(parts)))
    return [*rows, (7, rows[7][1]), (300, None), (301, ""), (302, "\n\n"), (None, common[0]), (303, common[0] + "\r"), (304, common[0] + "\n" + common[0])]


@pytest.mark.parametrize("stretch", [3, 50, 400_000])
def test_lines(frame, monkeypatch, stretch):
    real = lines.dropped_lines
    monkeypatch.setattr(lines, "dropped_lines", lambda rows, least_docs: real(rows, least_docs, stretch))
    rows = line_rows(random.Random(2))
    docs = frame(rows)
    want = [(d, n, k, hashlib.sha256(t.encode()).hexdigest()) for d, n, k, t in lines_by_hand(rows)]
    got = [(r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in lines.line_report(docs).collect()]
    order = lambda r: (r[0] is None, r)
    assert sorted(got, key=order) == sorted(want, key=order)


def test_lines_on_odd_documents(strange):
    want = sorted((d, n, k) for d, n, k, _ in lines_by_hand([(r.doc_id, r.text) for r in strange.collect()]))
    assert sorted((r.doc_id, r.n_lines, r.n_dropped) for r in lines.line_report(strange).collect()) == want
    out = lines.without_repeated_lines(strange)
    assert out.columns == strange.columns and out.count() == strange.count()
    assert lines.line_report(strange.limit(0)).count() == 0


# --- word shingles


def shingles_by_hand(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def shingle_links(rows):
    sets = {}
    for doc, text in rows:
        sets[doc] = shingles_by_hand(text)
    ids = sorted(sets)
    return sets, [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :]
                  if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]


def near_rows(rng):
    rows, doc = [], 0
    for size, edits in ((2, 1), (5, 3), (40, 2), (30, 6)):
        base = make_text(rng, "en", 150).split(" ")
        for _ in range(size):
            text = list(base)
            for _ in range(rng.randrange(edits + 1)):
                text[rng.randrange(len(text))] = f"edit{rng.randrange(10**6)}"
            rows.append((doc, " ".join(text)))
            doc += 1
    rows += [(doc + k, make_text(rng, "de", 60)) for k in range(30)]
    passage = make_text(rng, "fr", 40)
    rows += [(doc + 50 + k, passage + " " + make_text(rng, "fr", 60)) for k in range(40)]
    rows += [(500, None), (501, ""), (502, " \t\n "), (503, "one two"), (504, "ONE  two"), (505, "two one"), (506, "a b c d e"), (507, "A b\nc d e"),
             (508, rows[0][1]), (508, rows[0][1]), (509, rows[0][1].upper()), (510, "é É"), (511, "É É")]
    return rows


@pytest.mark.parametrize("few,block", [(12, 1024), (2, 8)])
def test_near_documents(frame, monkeypatch, few, block):
    monkeypatch.setattr(minhash, "FEW", few)
    rows = near_rows(random.Random(3))
    sets, links = shingle_links(rows)
    home = smallest_reachable(sets, links)
    got = minhash.near_duplicates(frame(rows), block_rows=block).collect()
    assert len(got) == len(rows)
    assert all(r.n_shingles == len(sets[r.doc_id]) for r in got)
    wrong = {r.doc_id for r in got if r.component_id != home[r.doc_id]}
    assert not wrong
    assert all(r.kept == (r.component_id == r.doc_id) for r in got)


def test_isolated_pairs_just_above_the_threshold(frame):
    """3,000 pairs of 70 shingles each, of which 60, 61 or 62 are common: similarity 0.75 to 0.80."""
    rng = np.random.default_rng(9)
    rows = []
    for k in range(3000):
        words = [f"w{x}" for x in rng.integers(0, 1 << 40, 74)]
        same = 64 if k % 2 else 65 + k % 4 // 2
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[:same] + [f"x{x}" for x in rng.integers(0, 1 << 40, 74 - same)]))]
    got = minhash.near_duplicates(frame(rows)).where("doc_id % 2 = 1").collect()
    assert len(got) == 3000
    assert sum(r.component_id != r.doc_id - 1 for r in got) <= 9  # 0.003 of all


def test_all_near_signatures_share_a_key():
    """The pigeonhole promise: up to 31 places changed at will, and some key is still shared."""
    rng = np.random.default_rng(5)
    sig = rng.integers(0, 1 << 16, (300, minhash.PLACES), dtype=np.uint16)
    other = sig.copy()
    for row in other:
        row[rng.choice(minhash.PLACES, minhash.DISTANCE, replace=False)] ^= np.uint16(rng.integers(1, 1 << 16))
    a, b = minhash.chunk_keys(sig), minhash.chunk_keys(other)
    assert all(set(x) & set(y) for x, y in zip(a.tolist(), b.tolist(), strict=True))


def test_second_look_finds_what_representatives_leave(frame, monkeypatch):
    """With no neighbourhood to speak of and one centre at most, pairs left over by the first look are still found."""
    monkeypatch.setattr(minhash, "FEW", 2)
    monkeypatch.setattr(minhash, "NEAR", minhash.PLACES)
    rows = near_rows(random.Random(6))
    sets, links = shingle_links(rows)
    home = smallest_reachable(sets, links)
    assert all(r.component_id == home[r.doc_id] for r in minhash.near_duplicates(frame(rows), block_rows=4).collect())


def test_near_documents_on_odd_documents(strange):
    got = minhash.near_duplicates(strange).collect()
    sets, links = shingle_links([(r.doc_id, r.text) for r in strange.where("doc_id <> 0").collect()])
    home = smallest_reachable(sets, links)
    assert len(got) == strange.count() and all(r.component_id == home[r.doc_id] for r in got if r.doc_id)
    assert minhash.near_duplicates(strange.limit(0)).count() == 0


# --- embeddings

VECTORS = StructType([StructField("vec_id", LongType()), StructField("embedding", ArrayType(FloatType())), StructField("label", IntegerType())])


def vector_rows(rng):
    rows, at = [], 0
    for label, size, noise in ((0, 3, 0.01), (0, 60, 0.012), (1, 30, 0.02), (2, 200, 1.0)):
        base = rng.standard_normal(64)
        for _ in range(size):
            rows.append((at, [float(x) for x in (base + noise * rng.standard_normal(64) * np.abs(base).mean()).astype(np.float32)], label))
            at += 1
    rows += [(at + k, rows[5][1], 0) for k in range(20)]
    rows += [(900, rows[5][1], None), (901, None, 0), (902, [0.0] * 64, 0), (903, [None, *rows[5][1][1:]], 0), (904, [math.nan] * 64, 0), (905, [math.inf] * 64, 0),
             (906, [], 0), (907, rows[5][1][:32], 0), (908, [x * 2 for x in rows[5][1]], 0), (909, [1.0, 0.0], 0), (910, [1.0, 0.0], 0)]
    return rows


@pytest.mark.parametrize("block", [7, 1024])
def test_embeddings(spark, block):
    rows = vector_rows(np.random.default_rng(7))
    ok = [r for r in rows if r[2] is not None and r[1] and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])]
    links = []
    for k, a in enumerate(ok):
        for b in ok[k + 1 :]:
            if a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1]), np.array(b[1])
                if x @ y / math.sqrt((x @ x) * (y @ y)) >= 0.98:
                    links.append((a[0], b[0]))
    home = smallest_reachable([r[0] for r in rows], links)
    degree = {r[0]: 0 for r in rows}
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    docs = spark.createDataFrame(rows, VECTORS).withColumns({"rep": F.lit(1), "n": F.lit(2), "copies": F.lit(3)})
    got = embeddings.near_duplicates(docs, block_rows=block).collect()
    assert len(got) == len(rows)
    assert all(r.n_links <= degree[r.vec_id] for r in got)  # none below the threshold
    assert sum(r.n_links for r in got) >= 0.99 * sum(degree.values())
    assert sum(r.component_id != home[r.vec_id] for r in got) <= 2
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert embeddings.near_duplicates(docs.limit(0)).count() == 0


def test_candidate_rows_are_linear_in_a_group(spark):
    """A group of near copies, a quarter of it far from the others: twice the copies give about twice the candidate rows."""
    rng = random.Random(1)
    vocabulary = [f"w{k}" for k in range(4000)]
    base = [rng.choice(vocabulary) for _ in range(200)]

    def candidates(n):
        rows = []
        for k in range(n):
            share = rng.uniform(0.03, 0.16) if k % 4 == 0 else rng.uniform(0, 0.03)
            rows.append((k, " ".join(rng.choice(vocabulary) if rng.random() < share else w for w in base)))
        found = minhash.described(spark.createDataFrame(rows, "doc_id long, text string"))
        return minhash._first_look(found.select(F.col("doc_id").alias("rep"), "n_shingles", "sig")).count()

    small, large = candidates(250), candidates(500)
    assert large < 2.5 * small and large < 500 * 160


def test_second_look_makes_a_row_per_member_not_per_pair(spark):
    """Near texts that are all apart: the likeliest partners of a member are listed in its row, however many components there are."""
    rng = random.Random(2)
    vocabulary = [f"w{k}" for k in range(4000)]
    base = [rng.choice(vocabulary) for _ in range(300)]
    rows = [(k, " ".join(rng.choice(vocabulary) if rng.random() < 0.02 else w for w in base)) for k in range(60)]
    classes = minhash.described(spark.createDataFrame(rows, "doc_id long, text string")).withColumnRenamed("doc_id", "rep").cache()
    keys = {r.rep: minhash.chunk_keys(np.frombuffer(bytes(r.sig)[: 2 * minhash.PLACES], "<u2")[None])[0].tolist() for r in classes.select("rep", "sig").collect()}
    key = Counter(k for found in keys.values() for k in set(found)).most_common(1)[0][0]
    sharing = [rep for rep, found in keys.items() if key in found]
    members = spark.createDataFrame([(rep, key) for rep in sharing], "a long, b long")
    found = minhash._second_look(members, classes, spark.createDataFrame([], "id long, component_id long"), 512, 2).collect()
    assert len(sharing) > 8 and sorted({r.rep for r in found}) == sorted(r.rep for r in found)
    assert len(found) <= len(sharing) < sum(len(r.partners or ()) for r in found)


def near_group(rng, n, far=0.3):
    """A group of near copies, some far from the others, and twice as many texts that share no more than a passage with them."""
    vocabulary = [f"w{k}" for k in range(4000)]
    base = [rng.choice(vocabulary) for _ in range(150)]
    rows = []
    for k in range(n):
        share = rng.uniform(0.02, 0.08) if rng.random() < far else rng.uniform(0, 0.02)
        rows.append((k, " ".join(rng.choice(vocabulary) if rng.random() < share else w for w in base)))
    return [*rows, *((n + k, " ".join([*base[:80], *(f"own{rng.randrange(10**9)}" for _ in range(40))])) for k in range(2 * n))]


def test_second_look_meets_a_member_once_not_once_a_key(frame, monkeypatch):
    """Near copies share dozens of keys, and texts with a common passage some: each that may have a link is looked at once."""
    seen = []
    real = minhash._second_look

    def look(members, *rest):
        seen.append([(r.a, r.b) for r in members.collect()])
        return real(members, *rest)

    monkeypatch.setattr(minhash, "_second_look", look)
    rows = near_group(random.Random(4), 80)
    sets, links = shingle_links(rows)
    home = smallest_reachable(sets, links)
    got = minhash.near_duplicates(frame(rows)).collect()
    assert all(r.component_id == home[r.doc_id] for r in got)
    assert len(seen) == 2 and all(len(m) == len({a for a, _ in m}) and all(a < 80 for a, _ in m) for m in seen)


@pytest.mark.parametrize("kept_links", [0, 0.3, 0.9])
def test_all_ends_of_open_links_are_within_reach(frame, kept_links):
    """Whatever components are known already, both ends of every link between two of them are kept; repeated rows do not count."""
    rng = random.Random(5)
    rows = [*near_group(rng, 30), *((1000 + d, t) for d, t in near_rows(rng) if t and t.strip())]
    rows += rows[:7]
    sets, links = shingle_links(rows)
    known = smallest_reachable(sets, [x for x in links if rng.random() < kept_links])
    docs = frame(rows)
    crowd = docs.select(F.col("doc_id").alias("rep"), F.xxhash64("text").alias("text_hash")).distinct()
    ends = frame([]).sparkSession.createDataFrame([(i, c) for i, c in known.items()], "id long, component_id long")
    got = [r.rep for r in minhash._within_reach(crowd, ends, docs).collect()]
    assert len(got) == len(set(got))
    assert {x for a, b in links if known[a] != known[b] for x in (a, b)} <= set(got)
    assert not set(range(30, 90)) & set(got)  # a passage in common is no reach


def test_neighbourhoods(spark):
    """Keys that share members become one; a chain of keys that would make more rows together stays as it is."""
    same = [(a, 100 + b) for a in range(10) for b in range(6)]
    chain = [(1000 + 3 * b + k, 200 + b) for b in range(40) for k in range(4)]
    members = spark.createDataFrame(same + chain, "a long, b long")
    got = [(r.a, r.b) for r in minhash._neighbourhoods(members, 4).collect()]
    near, far = [x for x in got if x[0] < 1000], [x for x in got if x[0] >= 1000]
    assert sorted(a for a, _ in near) == list(range(10)) and len({b for _, b in near}) == 1
    assert sorted(far) == sorted(chain)
    assert len(minhash._neighbourhoods(members, 512).collect()) == 10 + len({a for a, _ in chain})
    assert minhash._neighbourhoods(members.limit(0), 4).count() == 0
