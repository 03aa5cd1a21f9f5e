import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, shard int, key binary, sketch string, next string, range int, ids string"


def corpus(n=60, seed=5):
    """Random documents with near and exact copies."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    out = []
    for k in range(n):
        if k % 6 == 1:
            text = out[-1]
        elif k % 6 == 2:
            parts = out[-1].split()
            for _ in range(max(1, len(parts) // 40)):
                parts[rng.randrange(len(parts))] = rng.choice(words)
            text = " ".join(parts)
        else:
            text = ". ".join(" ".join(rng.choice(words) for _ in range(rng.randint(3, 12))).capitalize() for _ in range(rng.randint(1, 14))) + "."
        out.append(text)
    return out


@pytest.fixture(scope="session")
def edge_rows():
    """Ids and texts with nulls, blanks, odd characters, long texts, ties and repeated rows."""
    texts = corpus()
    rows = list(enumerate(texts))
    rows += [(100, None), (101, ""), (102, "   \n"), (103, "a b c"), (104, "a  b\tc"), (105, "Ünïcödé ẞ İ ﬁ 日本語 текст \U0001f600 \x00x"), (106, "one two three four five " * 3000), (107, "x" * 20000)]
    rows += [(108, "<|endoftext|> hi <|startoftext|>"), (109, "it's  I'LL\r\n\ttabs  "), (110, None)]
    rows += [(7, texts[7]), (7, texts[7]), (None, "no id here at all"), (None, texts[3])]
    return rows


@pytest.fixture(scope="session")
def edges(spark, edge_rows):
    """These rows with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 0.5, True, 1, b"k", "s", "n", 2, "i") for i, t in edge_rows], COLUMNS).repartition(5)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], COLUMNS)
