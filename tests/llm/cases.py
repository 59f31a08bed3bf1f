"""Inputs that every operator must take: nulls, empty and very long texts,
repeated rows, extra columns whose names clash with internal ones."""

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def odd_rows():
    long = " ".join(f"word{i % 977}x" for i in range(20_000))
    texts = ["plain text here.", None, "", " ", "\n\n", long, "plain text here.", "é中😀 <|endoftext|> </s>\t x", "A" * 30_000, "it's  1,000 km   next", "▁marks▁ and  spaces "]
    rows = [(i, t, "en", "src0", len(t or "")) for i, t in enumerate(texts)]
    return [*rows, rows[0], rows[0], (None, "no id", None, None, None), (None, None, None, None, None)]


def odd_documents(spark, clashing=True):
    df = spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)
    if clashing:
        for name in ("key", "bucket", "guest", "shard", "length", "start", "to", "token", "sig", "id"):
            df = df.selectExpr("*", f"'clash' AS {name}")
    return df


def empty_documents(spark):
    return spark.createDataFrame([], SCHEMA)
