"""Small inputs with everything that is odd: nulls, empty and long texts, ties, repeats, clashing columns."""

import random

from pyspark.sql import functions as F

ODD = [
    (1, ""), (2, None), (3, "one"), (4, "Hello  world, it's \t\n fine 🎉 é漢字 <|endoftext|> ▁x\x00"), (5, "   "),
    (6, "same text twice over here"), (7, "same text twice over here"), (7, "same text twice over here"),
    (8, "xyz" * 900), (None, "no id"), (None, None), (-5, "a\r\n\r\nb\r\n\r\n"), (2**62, "far away"),
]


def documents(spark, rows):
    """Columns of ``documents`` and some whose names operators use themselves."""
    schema = "doc_id long, text string"
    df = spark.createDataFrame(list(rows), schema)
    return df.select(
        "*", F.lit("en").alias("lang"), F.lit(None).cast("string").alias("source"), F.length("text").cast("long").alias("n_chars"),
        *[F.lit("clash").alias(n) for n in ("part", "start", "piece", "n_tokens", "ids", "score", "row", "key", "tag", "words")],
    )


def prose(seed, n, words=60, copies=True):
    """Rows of invented prose with exact copies, near copies and shared passages, ids in no order."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(3000)]
    passage = [rng.choice(vocabulary) for _ in range(55)]
    texts = []
    for _ in range(n):
        kind = rng.random() if copies and texts else 1
        if kind < 0.15:
            text = rng.choice(texts)
        elif kind < 0.35:
            own = rng.choice(texts).split(" ")
            for _ in range(rng.randint(1, 4)):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            text = " ".join(own)
        else:
            own = [rng.choice(vocabulary) for _ in range(rng.randint(1, 2 * words))]
            if copies and kind < 0.55:
                at = rng.randint(0, len(own))
                own[at:at] = passage[rng.randint(0, 5) : rng.randint(45, 55)]
            text = " ".join(own)
        texts.append(text)
    ids = rng.sample(range(10 * n), n)
    return list(zip(ids, texts))
