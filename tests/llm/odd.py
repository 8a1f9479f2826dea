"""Frames with everything that the operators must survive."""

from pyspark.sql import functions as F

WORDS = "the quick brown fox jumps over a lazy dog while nine wise owls watch from old oaks near the quiet river bank".split()


def prose(n, seed=0):
    x, out = seed * 7919 + 1, []
    for _ in range(n):
        x = (x * 1103515245 + 12345) % 2**31
        out.append(WORDS[x % len(WORDS)] + str(x // 64 % 97))
    return " ".join(out)


LONG = prose(20000, 3)
ROWS = [
    (1, prose(80, 1), "src0"), (2, prose(80, 1), "src0"), (2, prose(80, 1), "src0"), (3, None, None), (4, "", "src1"), (5, " \t\n ", "src1"), (6, LONG, "src0"),
    (7, "one", "src2"), (8, "ONE", "src2"), (9, "one two", None), (None, prose(80, 1), "src0"), (None, None, "src9"), (11, prose(80, 1) + " tail", "src0"),
    (12, "x" * 5000, "src2"), (13, "é ß \U0001f600 中文 \x1c  CafÉ", "src2"), (14, prose(200, 5), "src3"), (15, prose(200, 5).replace("fox", "cat", 1), "src3"),
]
CLASHING = ("row", "key", "size", "score", "label", "matches", "digest", "text_key", "node", "n", "range", "copies", "source_size", "x", "keep_id", "html", "w", "r_id")


def documents(spark, rows=ROWS):
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("lang", F.lit("en")).withColumn("n_chars", F.length("text").cast("bigint"))
    for c in CLASHING:
        df = df.withColumn(c, F.lit(f"own {c}"))
    return df


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id bigint, quality int, toxic int")
