"""Documents with everything that a table can hold badly."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

WORDS = "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima mike november oscar papa quebec romeo sierra tango".split()


def sentence(seed: int, n: int = 12) -> str:
    return " ".join(WORDS[(seed * 7 + i * (seed % 5 + 1)) % len(WORDS)] + str((seed + i) % 9) for i in range(n))


LONG = " ".join(f"w{i}" for i in range(120_000))

#: doc_id, text, lang, source, n_chars: nulls, empty texts, repeated rows, one id with two texts, a very long text.
ROWS = [
    (1, sentence(1), "en", "a"), (1, sentence(1), "en", "a"), (2, sentence(1), "en", "a"), (3, None, "en", "b"), (4, "", None, None), (5, " \n\t ", "de", ""), (None, sentence(6), "en", "a"), (None, None, None, None),
    (6, LONG, "en", "b"), (7, "?!", "en", "b"), (7, sentence(9, 30), "en", "b"), (8, "é ü ñ 漢字 \u0000 x", "fr", "c"),
]
#: Names that the operators use inside.
CLASHES = "key row gone node score KEY_ROW_KEY_OF_TEXT text_to_score row_key_of_text key_of_tree region_of_tree mixed_doc page_to_extract nonces_of_text".split()


def bad_docs(spark: SparkSession, rows: list[tuple] | None = None) -> DataFrame:
    rows = ROWS if rows is None else rows
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHES)
    return spark.createDataFrame([(i, t, lang, s, len(t) if t is not None else None, *(["c"] * len(CLASHES))) for i, t, lang, s in rows], schema)


def labels(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def items(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, "item_id long, text string")
