"""Documents with nulls, empty and long texts, ties, repeated rows and clashing column names."""

from __future__ import annotations

COLUMNS = ("doc_id long, text string, lang string, source string, n_chars long, "
           "key string, id string, part long, _text string, _key string, _id string, _digest string, row_key string")

LONG = " ".join(f"w{i % 977} erea{i % 13}" for i in range(12_000))


def rows():
    def row(doc, text, lang="en", source="s1"):
        return (doc, text, lang, source, None if text is None else len(text),
                "k", "i", 7, "t", "y", "d", "g", "r")

    return [
        row(1, "The quick brown fox jumps over the lazy dog"), row(2, "the QUICK brown fox jumps over the lazy dog"),
        row(3, None), row(4, ""), row(5, " \t\n"), row(6, "one"), row(7, "One"), row(8, "42 ++ --"),
        row(9, LONG), row(10, LONG + " tail"), row(None, "no id at all"), row(None, "no id at all"),
        row(11, "same row"), row(11, "same row"), row(11, "other text"), row(12, "Élan vital à la carte", None, None),
        row(13, "mail bob.b@example.org or +1 (415) 555-2671 now", "de", None), row(14, "x y  z　 w", None, "s2"),
    ]


def documents(spark, parts: int = 3):
    return spark.createDataFrame(rows(), COLUMNS).repartition(parts)


def empty(spark):
    return spark.createDataFrame([], COLUMNS)


def labels(spark, some=((1, 1, 0), (2, 1, 0), (6, 0, 0), (7, 0, 1), (9, None, None), (11, None, 0), (None, 1, 1))):
    return spark.createDataFrame(list(some), "doc_id long, quality int, toxic int")


def brief(rows):
    """Rows in an order that nulls do not upset."""
    return sorted(map(tuple, rows), key=repr)
