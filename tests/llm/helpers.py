import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, fp string, row string, marks int"
#: Extra columns whose names clash with those the operators use.
EXTRA = {"lang": "en", "source": "s", "n_chars": 0, "score": 1.5, "fp": "x", "row": "r", "marks": 7}


def docs_of(spark, texts):
    """A table of (doc_id, text) pairs with clashing further columns."""
    rows = [(i, t, *EXTRA.values()) for i, t in texts]
    return spark.createDataFrame(rows, DOCS)


def words(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(n))


def edge_texts():
    """Nulls in text and id, empty and blank texts, ties, repeated rows, a very long text, marks of many scripts."""
    long = words(1, 30_000)
    return [
        (1, None), (2, ""), (3, "   \n\n "), (4, "!!! ???"), (5, words(5, 120)), (6, words(5, 120)), (6, words(5, 120)), (7, long), (8, long + " tail"),
        (None, words(9, 80)), (None, words(9, 80)), (None, None), (10, "漢字かな交じり文 " * 40), (11, "'s don't <|endoftext|> x́ Σς"), (12, "word"), (13, "two words"),
    ]
