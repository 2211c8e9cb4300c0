"""Small fixtures with nulls, empty and long texts, ties, repeated rows and clashing column names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use themselves, as further columns of the documents.
CLASHING = "fp string, node long, size string, before string, shard string, key long, label string, n long, root long, copies string, spans string, media string"


def sentence(draw: random.Random, words: int, stock: list[str]) -> str:
    return " ".join(draw.choice(stock) for _ in range(words)).capitalize() + "."


def corpus(n: int = 60, seed: int = 1) -> list[tuple]:
    draw = random.Random(seed)
    stocks = {"en": ["the", "thing", "other", "which", "nation", "of", "that", "house"], "de": ["der", "nicht", "keit", "schule", "über", "und", "einfach", "groß"]}
    rows = []
    for i in range(n):
        lang = ("en", "de")[i % 2]
        text = "\n".join(sentence(draw, draw.randint(3, 30), stocks[lang]) for _ in range(draw.randint(1, 5)))
        rows.append((i, text, lang, f"s{i % 4}", len(text)))
    rows += [(n, None, "en", "s0", None), (n + 1, "", None, None, 0), (n + 2, "  \n\t", "de", "s1", 4), (n + 3, "x" * 20000, None, "s2", 20000), (None, "The thing without an id.", "en", None, None)]
    rows += [rows[3], rows[3], (n + 4, rows[3][1], "de", "s0", rows[3][4]), (n + 5, rows[4][1] + " more", "en", "s9", None), (n + 6, "12345 +++ 678", "en", "s3", 13)]
    return rows


def documents(spark, rows=None):
    return spark.createDataFrame(corpus() if rows is None else rows, SCHEMA)


def widened(spark, rows=None):
    import pyspark.sql.functions as F

    df = documents(spark, rows)
    for column in CLASHING.split(", "):
        name, kind = column.split()
        df = df.withColumn(name, F.lit(7).cast(kind))
    return df


def empty(spark):
    return documents(spark, [])


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)
