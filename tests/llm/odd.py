"""Odd rows that every operator has to take."""

from pyspark.sql import functions as F

from datatrawl.checks.compare import duck

LONG = " ".join(f"w{i % 977}" for i in range(60_000))


def documents(spark, rows):
    """(doc_id, text) rows with columns whose names the operators also use inside."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("id", "row", "w", "at", "word", "node", "n", "key", "label", "items", "__row"):
        df = df.withColumn(name, F.lit(1))
    return df


ROWS = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "Two WORDS"), (6, "éÉ straße 東京 word"),
    (7, LONG), (8, "same text here twice over"), (8, "same text here twice over"),
    (9, "same text here twice over"), (None, "no key at all here"), (10, "... !!! ***"),
]


def pandas(df):
    return df.toPandas()


def oracle(sql, sf="/root/testdata/sf0.001"):
    return sorted(map(tuple, duck(sf).sql(sql).fetchall()), key=str)
