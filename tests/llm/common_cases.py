"""Documents with nulls, empty and long texts, ties, repeats and columns whose names operators use themselves."""

import random

from pyspark.sql import functions as F

WORDS = "the quick brown fox jumps over a lazy dog while seven small birds sing loud songs near old stone walls under grey skies".split()
CLASHING = ("hash", "n", "rep", "a", "b", "key", "bands", "salt", "h", "start", "end", "wanted", "spans", "length", "component", "doc", "id", "row", "tail", "__score", "__spans", "__kept", "__text", "__id", "__sha", "__same", "__dropped")


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(30)) for _ in range(n))


def twins(bits: int = 11) -> tuple[str, str]:
    """Two words that sums of powers of a base can not tell apart: one letter by the parity of each place's bits, and the
    same with the letters swapped."""
    one = "".join("ab"[k.bit_count() % 2] for k in range(1 << bits))
    return one, one.translate(str.maketrans("ab", "ba"))


def long_rows() -> list[tuple]:
    """Texts of over a million bytes: prose, a near copy of it, one without white space, and short ones beside them."""
    text = prose(21, 150_000)
    unbroken = "".join(random.Random(22).choice("abcdefgh") for _ in range(40_000)) * 30
    return [(1, text), (2, text[:-300] + prose(23, 30)), (3, unbroken), (4, "short text of a few words"), (5, text[5000:6000])]


def cases() -> list[tuple]:
    base = prose(1, 120)
    words = base.split()
    rows = [
        (1, base), (2, base), (3, " ".join(words[:60] + ["other"] + words[61:])), (4, " ".join(words[:100])), (5, None), (6, ""), (7, "   \n\t "), (8, "one two"), (9, "ONE two"), (10, "one two three four five"),
        (11, prose(2, 4000)), (12, "ab" * 400), (13, base.upper()), (14, "é" * 300 + " ß " + "日本語" * 60), (15, prose(3, 80) + " " + base[:300]), (16, "!!! ??? 123"), (17, prose(2, 4000) + " tail"),
        (18, "<|endoftext|> a<|endoftext|>"), (19, base), (None, base), (None, None), (20, base[200:500] + prose(5, 30)),
    ]
    return [*rows, rows[0], rows[4]]


def frame(spark, rows=None):
    df = spark.createDataFrame(cases() if rows is None else rows, "doc_id long, text string")
    return df.select("doc_id", "text", *(F.lit("x").alias(c) for c in CLASHING))


def empty(spark):
    return frame(spark, [])


def with_ids(rows=None):
    return [(i, t or "") for i, t in (cases() if rows is None else rows)]
