"""Small documents with the awkward cases: nulls, empty and long texts, ties, repeated rows, clashing extra columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, doc string, h int, key long, score string, keep_bitmap int, part int"


def documents(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, "en", "s", len(t or ""), 7, "x", 1, 2, "?", 3, 4) for i, t in zip(ids, texts)]
    return spark.createDataFrame(rows, SCHEMA)


def prose(n, seed, vocab=60):
    rng = random.Random(seed)
    words = ["".join(random.Random(k).choices("abcdefgh", k=2 + k % 7)) for k in range(vocab)]
    return " ".join(rng.choice(words) for _ in range(n))


def awkward():
    """Texts and ids: a null text, an empty one, one of white space, a very long one, copies, and shared passages."""
    shared = prose(70, 1)
    long = prose(6000, 2)
    texts = [
        None, "", " \n\t ", "one", "Two words", long, long, prose(120, 3), prose(120, 3), prose(120, 3) + " end",
        prose(30, 4) + " " + shared + " " + prose(30, 5), prose(10, 6) + " " + shared + "\n" + prose(25, 7), shared, shared.upper(),
        "A line that is long enough\nanother\nA line that is long enough\nb", "a LINE that is long enough  \nc", "  A line that is long enough\n", "été é ß 中文   x",
    ]
    return texts


def write(spark, path, **tables):
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}.parquet")
    return str(path)
