import random
import zlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from passledger.llm import packing, secrets
from passledger.llm.queries import ORACLES, QUERIES
from passledger.llm.tokens import default_tokenizer

from .conftest import DOCUMENTS, make_text
from .test_duplicates import lines_by_hand, shingle_links, smallest_reachable

LANGS = ["en", "de", "fr"]


def corpus(rng):
    rows = [(k, make_text(rng, LANGS[k % 3], rng.randrange(30, 90)), LANGS[k % 3], f"src{k % 4}") for k in range(150)]
    notice = "a notice that every document of one source repeats"
    rows = [(d, t + "\n" + notice if d % 4 == 0 else t, lang, s) for d, t, lang, s in rows]
    rows += [(200 + k, rows[10 * k][1].replace("\n", " ", 1) + " more", rows[10 * k][2], "src0") for k in range(10)]
    for k in (20, 30):
        token = "".join(rng.choice("0123456789abcdef") for _ in range(40))
        rows.append((300 + k, make_text(rng, "en", 50) + f' token = "{token}" end', "en", "src1"))
    rows += [(400, None, "en", "src1"), (401, "", None, None), (402, "1234 5678 !!", "en", "src1"), (403, make_text(rng, "de", 40), None, None), (None, make_text(rng, "fr", 40), "fr", "src2")]
    return [(d, t, lang, s, None if t is None else len(t)) for d, t, lang, s in rows]


def test_stages_against_a_plain_version(spark, tmp_path):
    from tokenizers import Tokenizer

    rows = corpus(random.Random(5))
    folder = str(tmp_path / "in")
    spark.createDataFrame(rows, DOCUMENTS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    kept = [(d, t) for d, t, *_ in rows if t and any(c.isalpha() for c in t)]
    kept = [(d, t) for d, _, _, t in lines_by_hand(kept)]
    sets, links = shingle_links([r for r in kept if r[0] is not None])
    home = smallest_reachable(sets, links)
    kept = [(d, t) for d, t in kept if d is None or home[d] == d]
    assert 0 < sum(len(x) == 0 for x in sets.values()) or len(links) >= 10
    import re
    kept = [(d, re.sub(r"[0-9a-f]{40}", secrets.REDACTED, t)) for d, t in kept]
    library = Tokenizer.from_file(default_tokenizer())
    want = []
    for doc, text in kept:
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 2], dtype="<u4")
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
        want += [(doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    got = corpus_pipeline.run(spark, folder).collect()
    key = lambda r: (r[0] is None, r)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=key) == sorted(want, key=key)
    sequences = {}
    for r in got:
        sequences[r.sequence_id] = sequences.get(r.sequence_id, 0) + r.length
    assert max(sequences.values()) <= 1024


def test_stages_keep_columns_and_take_anything(spark, strange):
    strange = strange.withColumns({c: F.lit(7) for c in ("__doc", "__id", "__found", "__values", "__row", "__gone", "__text", "__keep", "__may")})
    for docs in (strange, strange.limit(0), strange.where("text is null")):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, "")
            assert out.columns == docs.columns, name
            assert out.count() <= docs.count() and out.where("__doc <> 7 or __id <> 7 or __row <> 7").count() == 0
        assert packing.packed(docs).select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_clean_documents_stay(spark, frame):
    rng = random.Random(6)
    docs = frame([make_text(rng, "en", 60) for _ in range(60)]).withColumn("lang", F.lit("en"))
    before = {r.doc_id: r.text for r in docs.collect()}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert {r.doc_id: r.text for r in stage(spark, docs, "").collect()} == before


def test_a_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)


def test_without_labels_only_texts_without_letters_go(spark, frame):
    rng = random.Random(8)
    texts = [make_text(rng, "en", 60) for _ in range(5)]
    docs = frame([*texts, None, "", "123 !!", "é"]).withColumn("lang", F.lit(None).cast("string"))
    kept = corpus_pipeline.language_id(spark, docs, "").collect()
    assert sorted(r.text for r in kept) == sorted([*texts, "é"])
