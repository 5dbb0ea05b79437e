import pytest

#: rows that every operator must take: nulls, empty and blank texts, repeated rows, a very long text
HARD = [
    (1, "a b c d e f g", "en", "src0"),
    (2, "a b c d e f g", "en", "src1"),
    (2, "a b c d e f g", "en", "src1"),
    (3, None, None, None),
    (None, "a b c d e f g", "de", "src0"),
    (None, None, "de", None),
    (4, "", "fr", "src2"),
    (5, " \n\t ", "fr", "src2"),
    (6, "", None, "src2"),
    (7, "long word " * 60_000, "es", "src3"),
    (8, "a b c d e f x", "en", "src0"),
    (9, "Ünïcödé 中文 🙂 line\nline two", "de", "src9"),
]
CLASHING = "doc_id long, text string, lang string, source string, n_chars long, tokens string, shard string, owner_id string, h string, n string, a string, b string, v string"


@pytest.fixture(scope="session")
def hard(spark):
    """HARD with columns whose names the operators use themselves."""
    rows = [(*r, None if r[1] is None else len(r[1]), *["x"] * 9) for r in HARD]
    return spark.createDataFrame(rows, CLASHING + ", times string").repartition(3)
