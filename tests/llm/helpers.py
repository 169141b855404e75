"""Small awkward tables shared by the tests of the training-data operators."""
import random

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType()),
                     # names that an operator might use inside
                     T.StructField("word", T.StringType()), T.StructField("key", T.LongType()),
                     T.StructField("ids", T.StringType()), T.StructField("rank", T.IntegerType())])


def documents(spark, texts, ids=None, langs=None):
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, (langs[n] if langs else "en"), f"src{n % 2}", None if t is None else len(t),
             "w", 1, "x", 2) for n, (i, t) in enumerate(zip(ids, texts))]
    return spark.createDataFrame(rows, DOCS)


def awkward_texts(seed=3, n=40):
    """Null, empty, blank, one very long word, a very long text, copies, odd characters."""
    rnd = random.Random(seed)
    words = ["the", "And", "of", "tion", "Straße", "ÉTÉ", "naïve", "a", "I'll", "x1y2", "!!!", "漢字", "😀👍"]
    plain = [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 60))) for _ in range(n)]
    return [None, "", " \t\n", "x" * 3000, "ab " * 4000, "a\x0bb\x0cc d\u0085e\x1cf",
            "<|endoftext|> hi <|startoftext|>", "ΑΣ ΣΑΣ İstanbul ǅ ﬁ"] + plain + plain[:3] + plain[:1]
