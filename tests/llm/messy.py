"""Small tables with the awkward cases: nulls, empty and long texts, ties, repeated rows, clashing extra columns."""

import random

from pyspark.sql import functions as F

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def texts():
    long = "\n".join(prose(100 + i, 60) for i in range(300))
    base = prose(1, 40)
    near = base.split()
    near[7] = "changed"
    return [
        (1, base),
        (2, base),
        (3, " ".join(near)),
        (4, None),
        (5, ""),
        (6, "   \t\n \n"),
        (7, "one"),
        (8, "two words"),
        (9, "ünï çødé ﬀ 😀 mixed CASE Text"),
        (10, long),
        (11, prose(2, 35) + "\n" + base + "\n" + prose(3, 30)),
        (None, "a row without an id " + prose(4, 12)),
        (12, "same row twice " + prose(5, 20)),
        (12, "same row twice " + prose(5, 20)),
        (13, "control \x00 \x0b \x0c marks"),
    ]


def documents(spark, rows=None):
    """With the usual columns and some whose names the operators use inside."""
    df = spark.createDataFrame(rows if rows is not None else texts(), "doc_id bigint, text string")
    return df.select(
        "doc_id", "text", F.lit("en").alias("lang"), F.lit("src0").alias("source"),
        F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("n_chars"),
        F.lit(1).alias("label"), F.lit("x").alias("items"), F.lit(2.5).alias("score"), F.lit(7).alias("line_no"), F.lit(8).alias("fp"),
    )


def empty_documents(spark):
    return documents(spark, [])
