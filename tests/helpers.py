"""Small frames and tables for tests."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, n int, size string, token int, node string, label string, row string"


def frame(spark, rows, parts=3):
    return spark.createDataFrame(rows, DOCS).repartition(parts)


def saved(spark, rows, folder, name="documents", schema=DOCS):
    """Write rows as the table ``name`` of a folder and return the folder."""
    spark.createDataFrame(rows, schema).repartition(3).write.mode("overwrite").parquet(f"file://{folder}/{name}.parquet")
    return f"file://{folder}"
