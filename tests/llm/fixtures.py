"""Small tables with nulls, blanks, long texts, ties and repeated rows."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows, extra=False):
    df = spark.createDataFrame([(i, t, g, s, len(t or "")) for i, t, g, s in rows], DOCS)
    if extra:
        df = df.selectExpr("*", "'x' AS Fingerprint", "1 AS fp", "2 AS size", "'y' AS source_size", "3 AS score", "4 AS host", "5 AS TEXT", "6 AS text_hash", "7 AS n_entities", "'z' AS Doc_Id")
    return df


def edge_rows():
    return [
        (None, "an orphan without any id", "en", "a"),
        (1, None, "en", "a"),
        (2, "", None, None),
        (3, " \n\t ", "fr", "b"),
        (4, "one", "en", "b"),
        (5, "the same text twice in two rows", "en", None),
        (5, "the same text twice in two rows", "en", None),
        (6, "the same text twice in two rows", None, "c"),
        (7, "Überlänge " * 30_000, "de", "c"),
        (8, "naïve 🙂 <|endoftext|> 東京 it's I'll    x", "xx", "🙂"),
        (9, "12345 67.8 !!! ###", "en", ""),
    ]
