"""Rows that every operator must bear: nulls, empty and very long texts, ties, repeats, clashing names."""

LONG = "lorem ipsum dolor sit amet " * 40_000
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, score string, kept string, _row string, _text string, _cand string, found string, key string"
CLASHES = ["x"] * 8


def hard_documents(spark, more=()):
    rows = [
        (None, None), (None, "null id, with some words"), (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "tie tie tie"), (6, "tie tie tie"),
        (7, LONG), (8, LONG + "end"), (9, "repeated row"), (9, "repeated row"), (10, "same id, one text here"), (10, "same id, another text"), (11, "\x00▁ \U0001f600 é ‮"),
        *more,
    ]
    return spark.createDataFrame([(i, t, "en", None, None, *CLASHES) for i, t in rows], SCHEMA)


def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)


def texts_of(path, limit=None):
    import duckdb

    return duckdb.sql(f"SELECT doc_id, text FROM '{path}/documents.parquet' ORDER BY doc_id{f' LIMIT {limit}' if limit else ''}").fetchall()
