import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from passledger.llm import prefixes

TURNS = StructType([StructField("conv_id", LongType()), StructField("turn", LongType()), StructField("role", StringType()), StructField("text", StringType())])


def by_hand(rows):
    """Rows of the trie, from (conv_id, turn, role, text)."""
    own = {}
    for c, t, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    own = {c: [(r, x) for *_, r, _, x in sorted(turns)] for c, turns in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        whole[c] = tuple(own.get(c - c % 5, [])[:h] + turns[h:])
    members = {}
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    own_saving = {p: (len(m) - 1) * len(p[-1][1].encode()) if p else 0 for p, m in members.items()}
    children = {p: 0 for p in members}
    for p in members:
        if p:
            children[p[:-1]] += 1
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for p in members:
        for d in range(len(p) + 1):
            saved[p[:d]] += own_saving[p]
            leaves[p[:d]] += children[p] == 0
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p],
         hashlib.sha256(",".join(str(c) for c in sorted(m) if len(whole[c]) == len(p)).encode()).hexdigest())
        for p, m in members.items())


NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def made(frame):
    return sorted((tuple(r[c] for c in NAMES) for r in frame.collect()), key=str)


def talks(rng, n):
    texts = ["hi", "höllo there", "", "go on", "x" * 40]
    rows = []
    for c in range(n):
        for t in range(rng.choice([1, 2, 3, 8, 12, 20])):
            rows.append((c * rng.choice([1, 1, 2]), t, rng.choice(["user", "assistant"]), rng.choice(texts[: 1 + t % 5 + rng.randrange(2)])))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_trie_by_hand(spark, seed):
    rng = random.Random(seed)
    rows = talks(rng, 120)
    rows += [(500 + k, t, "user", f"same {t}") for k in range(40) for t in range(12)]  # copies
    rows += [(1000 + k, t, "user", f"stair {t}") for k in range(30) for t in range(k)]  # each the beginning of the next
    turns, ids = prefixes.rebuilt_turns(spark.createDataFrame(rows, TURNS))
    want = sorted(by_hand(rows), key=str)
    for shard in (1, 40, 300_000):
        assert made(prefixes.prefix_trie(turns, ids, shard)) == want


def test_long_conversation(spark):
    """One conversation is longer than the chunks of running values; others go along with it for a while."""
    rows = [(0, t, "user", f"t{t % 7}") for t in range(9000)] + [(c, t, "user", f"t{t % 7}") for c in (10, 15) for t in range(4200 + c)]
    assert made(prefixes.conversation_trie(spark.createDataFrame(rows, TURNS))) == sorted(by_hand_long(rows), key=str)


def by_hand_long(rows):
    """As by_hand, told by running hashes: prefixes as tuples would take too much memory."""
    own = {}
    for c, _, role, text in rows:
        own.setdefault(c, []).append((role, text))
    nodes, ends = {}, {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        turns = own.get(c - c % 5, [])[:h] + turns[h:]
        at, walk = b"", [(0, b"", b"", 0)]
        for d, (role, text) in enumerate(turns, 1):
            up, at = at, hashlib.md5(at + role.encode() + b"\0" + text.encode()).digest()
            walk.append((d, at, up, len(text.encode())))
        for d, key, up, size in walk:
            nodes.setdefault((d, key), [up, size, []])[2].append(c)
        ends.setdefault((len(turns), at), []).append(c)
    children, leaves, saved = {}, {}, {}
    for (d, key), (up, size, m) in sorted(nodes.items(), key=lambda x: -x[0][0]):
        leaves[d, key] = leaves.get((d, key), 0) or 1
        saved[d, key] = saved.get((d, key), 0) + (len(m) - 1) * size
        if d:
            for box, x in ((children, 1), (leaves, leaves[d, key]), (saved, saved[d, key])):
                box[d - 1, up] = box.get((d - 1, up), 0) + x
    return [(min(m), d, min(nodes[d - 1, up][2]) if d else None, len(m), children.get((d, key), 0), leaves[d, key], saved[d, key],
             hashlib.sha256(",".join(map(str, sorted(ends.get((d, key), [])))).encode()).hexdigest()) for (d, key), (up, size, m) in nodes.items()]


def test_odd_conversations(spark):
    """Null turns, roles, texts and ids; ties, repeated rows, turnless results, negative ids, extra columns, an empty table."""
    rows = [(None, 0, "user", "lost"), (0, None, None, None), (0, 0, "user", "a"), (0, 0, "user", "a"), (0, 0, "assistant", "b"), (1, None, "user", "only"),
            (2, 5, None, "x"), (2, 3, "user", None), (7, 0, "user", "p"), (8, 0, "user", "q"), (13, 1, "user", "deep"), (-4, 0, "user", "minus"), (4, 0, "user", "a,b\n")]
    docs = spark.createDataFrame(rows, TURNS).withColumns({c: F.lit(3) for c in ("depth", "k", "chunk", "label", "x1", "_part", "bytes")})
    got = made(prefixes.conversation_trie(docs))
    mod = [(c, t, r, x) for c, t, r, x in rows if c is None or c >= 0]  # the remainder of a negative id has its sign: base 0
    assert len(got) >= len(by_hand(mod)) and any(r[3] == 8 and r[1] == 0 for r in got)
    assert made(prefixes.conversation_trie(spark.createDataFrame(mod, TURNS))) == sorted(by_hand(mod), key=str)
    assert prefixes.conversation_trie(docs.limit(0)).count() == 0


def test_find_close():
    rng = random.Random(5)
    for n, block in ((1, 4), (5, 4), (300, 8), (3000, 64)):
        bits, left, depth = [1], n - 1, 1
        while left or depth:
            if left and (depth < 1 or rng.random() < 0.55):
                bits.append(1)
                left -= 1
                depth += 1
            else:
                bits.append(0)
                depth -= 1
        stack, want = [], {}
        for k, b in enumerate(bits):
            if b:
                stack.append(k)
            else:
                want[stack.pop()] = k
        trie = prefixes.Parentheses(np.array(bits, dtype=np.uint8), block)
        at = np.flatnonzero(trie.bits)
        assert trie.find_close(at).tolist() == [want[k] for k in at.tolist()]
