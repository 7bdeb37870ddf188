"""Small tables with the awkward cases that every operator on documents must take."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, uid long, pos long, name string, size long"


def awkward(spark, seed=1):
    """Nulls in any column, empty, blank and very long texts, repeated rows, non-ASCII, and columns with clashing names."""
    rng = random.Random(seed)
    words = "the of and fox über éau jumps mit license apache general public Ünder dog 12 x-ray ΣΑΣ 中文".split()
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 120))) for _ in range(30)]
    long = " ".join(rng.choice(words) for _ in range(9000))
    texts = [*base, base[0], base[0], base[1], base[2] + " more", None, "", "  \n\t ", "x", long, long + " end", "a\x0bb\x00c", "\U0001f600 smile", None, base[3], "MIT License mit license"]
    rows = [(i, t, rng.choice(["en", None]), rng.choice(["s1", "s2", "é", None]), len(t or ""), 5, 6, "n", None) for i, t in enumerate(texts)]
    rows += [rows[4], (None, base[5], None, None, None, 1, 1, None, 1)]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
