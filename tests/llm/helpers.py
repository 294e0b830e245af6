"""Tables of edge cases that the operators' tests share."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, fp string, did string, tag string, row_pos string, q string, h string, label string"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n))


def documents(spark, rows):
    """Rows of (doc_id, text), with the columns of documents and further ones whose names clash."""
    full = [(i, t, "en", "src0", None if t is None else len(t), *["x" if j else 0.5 for j in range(8)]) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA)


def edge_rows():
    long = prose(1, 30_000)
    return [(1, prose(2, 80)), (1, prose(2, 80)), (2, None), (3, ""), (4, " \t\n\x0b"), (None, prose(3, 60)), (None, None), (5, long), (6, "one"), (7, "Ünïcode ß 漢字   end"), (8, prose(2, 80))]
