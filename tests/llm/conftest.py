import random

import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

DOCUMENTS = StructType([
    StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()),
    StructField("source", StringType()), StructField("n_chars", LongType()),
])

WORDS = {
    "en": "the of and river stone walked house with under morning light quickly green thing other than".split(),
    "de": "der und straße gehen über schön häuser nicht mit unter licht morgen schnell grün ding andere".split(),
    "fr": "le de et rivière pierre marché maison avec sous matin lumière vite vert chose autre que".split(),
}

ODD_TEXTS = [
    None, "", " ", "  ", "\n", "\n\n", "a", "a  b", " a", "a ", "a \n b", "foo\n bar ", "foo\n \nbar", "x <|endoftext|> y", "a  <|endoftext|>", "it's we'll  don't",
    "x  y　z", "\x1c a \x1d\x00", "日本 語 🙂 🙂", "▁a ▁▁ b▁", "12 34  5,6.7", "Ünïcödé ǅ ß ŉ", "w" * 5000, "ab " * 4000, "line\r\nline\r\n", "<s> </s> <unk>", "<0x41>",
]


def make_text(rng: random.Random, lang: str, n: int) -> str:
    out = []
    for k in range(n):
        out.append(rng.choice(WORDS[lang]) + rng.choice(["", "", "", rng.choice("aeiou") + rng.choice("nrst")]))
        out.append("\n" if k % 12 == 11 else " ")
    return "".join(out).strip()


@pytest.fixture
def frame(spark):
    """Documents from texts, or from (doc_id, text) pairs."""
    def build(texts):
        pairs = [t if isinstance(t, tuple) else (k, t) for k, t in enumerate(texts)]
        return spark.createDataFrame([(d, t, "en", f"src{k % 3}", None if t is None else len(t)) for k, (d, t) in enumerate(pairs)], DOCUMENTS)
    return build


@pytest.fixture
def strange(frame):
    """Odd texts, repeated rows and a column whose name an operator might use itself."""
    from pyspark.sql import functions as F

    docs = frame([*ODD_TEXTS, (0, None), (6, "a"), (900, "tie"), (900, "tie")])
    return docs.withColumns({"rank": F.lit(1), "shard": F.lit("x"), "key": F.lit(2), "component_id": F.lit(3), "piece": F.lit(4), "score": F.lit("y"), "value": F.lit(5), "n": F.lit(6)})
