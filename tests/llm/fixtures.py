"""Documents with the awkward cases that every operator has to bear: nulls, empty and long texts, ties, repeated rows, columns of clashing names."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, start long, size long, _id long, length long, keep_id long"


def documents(spark, texts, sources=None):
    rows = [(k, t, None, sources[k] if sources else f"s{k % 3}" if k % 5 else None, None, -1, -2, -3, -4, -5) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


AWKWARD = [
    None,
    "",
    " ",
    "\n\n",
    "One",
    "one",
    "ONE",
    "É é",
    "é é",
    "a\tb\rc\x0bd\x0ce f",
    "x" * 5000,
    "long words " * 3000,
    "the quick brown fox " * 40,
    "THE QUICK brown fox " * 40,
    "don't stop, it's; we'll ẛ̣ <|endoftext|> <s>",
    "line one\nline two\nline one\n\nline two",
    "  two  spaces▁here ",
]
