import random

import pytest

PROSE = ("the ou thand erly ing of reon ble tion shthe wherer and that enth inor then hean stond athe with from "
         "eron ning deste ally oron thent isher").split()


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(PROSE) + rng.choice(["", "", "s", "ed", "ing", "ly", str(rng.randint(0, 9))]) for _ in range(n))


def edge_rows():
    """(doc_id, text): nulls, empties, ties, repeated rows, long texts, near copies."""
    base = prose(1, 160)
    near = base.split()
    near[80] = "changed"
    passage = prose(2, 70)
    return [
        (1, base), (2, base), (2, base), (3, " ".join(near)), (4, None), (5, ""), (6, " \t\n\x0b\x0c\r "),
        (7, "Only Three words"), (8, "only three WORDS"), (9, prose(3, 90) + "\n" + passage + "\n" + prose(4, 30)),
        (10, prose(5, 60) + "\n" + passage), (11, "x" * 30_000), (12, prose(6, 9000)), (13, "ab " * 700),
        (14, "ümlaut écrit 日本語 " * 20 + prose(7, 60)), (15, "ümlaut écrit 日本語 " * 20 + prose(8, 60)),
        (16, "mail a.b@mail.example.com, ip 10.0.0.1 300.1.1.1 card 4111 1111 1111 1111 call +1 (654) 555-4136 " + prose(9, 60)),
        (17, "<|endoftext|> odd \u2028 \u00a0 text\u0130 \u03a3 <|startoftext|>"), (None, prose(10, 80)), (None, base),
        (18, "one\ntwo\none\none\n" + prose(11, 60)), (19, "# $ % & * | < > " * 40), (20, "a\x1cb\x85c d e f g"),
    ]


@pytest.fixture(scope="session")
def rows():
    return edge_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The edge rows, with other columns whose names the operators use inside."""
    return spark.createDataFrame(
        [(d, t, "en", "s", 1, "x", 2, "y", 3, 4) for d, t in rows],
        "doc_id long, text string, lang string, source string, n_chars long, row_key string, key long, "
        "tokens string, row long, n long").repartition(3)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.where("false")
