"""A small table with the rows that operators trip over."""

import random

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, bucket int, score double, fp string"
_rng = random.Random(5)
_WORDS = ["alpha", "beta", "gamma", "delta", "été", "straße", "the", "of", "Ω", "x1", "don't", "中文"]


def prose(n: int, seed: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(_WORDS) + rng.choice(["", "", "", ",", ".\n"]) + str(rng.randrange(99)) * (rng.random() < 0.5) for _ in range(n))


def texts() -> list[tuple]:
    shared, long = prose(30, 1), prose(6000, 2)
    rows = [
        (0, prose(60, 3) + " " + shared),
        (1, shared + "\n\n" + prose(40, 4)),
        (2, prose(60, 3) + " " + shared),  # as 0
        (2, prose(60, 3) + " " + shared),  # a repeated row
        (2, prose(25, 9)),  # the same doc_id, another text
        (3, None),
        (4, ""),
        (5, " \t\n \x0b "),
        (6, "one"),
        (7, "one two three"),
        (8, long),
        (9, long + " tail"),
        (10, "same same same same same same same same same same same same same same same same same"),
        (None, shared),
        (None, None),
        (11, "mail a.b@example.com or +1 (555) 123-4567, card 4111 1111 1111 1111 at 10.0.0.255 and 10.0.0.256"),
        (12, "x" * 5000),
        (13, "tab\tx\r\nfeed\x0cy\x1cz  two  spaces "),
        (14, "<|endoftext|> </s> ▁mark"),
    ]
    return [(d, t, "en", ["a", "b", None, "Z"][k % 4], None if t is None else len(t), k, 0.5, "fp") for k, (d, t) in enumerate(rows)]


def table(spark, rows=None):
    return spark.createDataFrame(texts() if rows is None else rows, COLUMNS)
