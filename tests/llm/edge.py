"""Rows that every corpus operator must take: nulls, empty and very long texts, ties, repeated rows, clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, kept string, block string, label string, words string"


def edge_rows():
    rnd = random.Random(11)
    vocabulary = ["".join(rnd.choices("aehilnorstw", k=rnd.randint(2, 8))) for _ in range(400)]
    sentence = lambda n: " ".join(rnd.choices(vocabulary, k=n)).capitalize() + "."
    base = [sentence(rnd.randint(4, 30)) + "\n" + sentence(rnd.randint(4, 30)) for _ in range(12)]
    texts = [None, "", " \n\t ", *base, base[0], base[1].replace(" ", "  \n"), base[2].upper(), base[3] + " " + base[4],
             "\n".join([base[5]] * 3), "é日🙂 ̈ " + base[6], "x" * 5000, " ".join(sentence(20) for _ in range(900)), base[7] + "<|endoftext|>" + base[8],
             "\n".join(base[:6]), "\n".join(["head", *base[:6]])]
    rows = [(10 + i, t) for i, t in enumerate(texts)]
    rows += [(None, base[0]), (None, None), (12, base[9]), (13, base[9]), (13, base[9]), (5, base[10])]
    return rows


def edge_docs(spark):
    return spark.createDataFrame([(i, t, None, "src0" if k % 2 else None, None, "a", None, "b", "c", "d") for k, (i, t) in enumerate(edge_rows())], SCHEMA)


def by_row(rows):
    return sorted(map(tuple, rows), key=repr)
