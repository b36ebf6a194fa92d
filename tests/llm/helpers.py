"""Small inputs shared by the tests of the training-data operators."""

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

WORDS = "the quick brown fox jumps over a lazy dog while seven wizards brew strange potions under old stone bridges".split()


def prose(n: int, seed: int = 0) -> str:
    """``n`` words without a short period."""
    x, out = seed * 7919 + 1, []
    for _ in range(n):
        x = (x * 6364136223846793005 + 1442695040888963407) % 2**64
        out.append(WORDS[(x >> 33) % len(WORDS)] + str((x >> 40) % 50))
    return " ".join(out)


#: Nulls, empty texts, ties, repeated rows and scripts of several widths.
ODD_ROWS = [
    (1, "plain words, don't stop", "en", "a", 1), (1, "plain words, don't stop", "en", "a", 1),
    (2, "", "en", "a", 0), (3, None, None, None, None), (None, "no id here", "en", "b", None),
    (4, "  spaces \n\n\t and   runs  ", "en", "a", 5), (5, "日本語のテキスト、句読点。ñandú’s", "ja", "c", 9),
    (6, "x" * 5000, "en", "a", 5000), (7, "'re 're're '' 'll  end ", "en", "b", 1),
]


def odd_docs(spark, extra=("_row", "shard", "text_crc32", "ids", "_at")):
    """The odd rows, with extra columns whose names operators might use themselves."""
    from pyspark.sql import functions as F

    return spark.createDataFrame(ODD_ROWS, DOC_SCHEMA).withColumns({c: F.lit("clash") for c in extra})
