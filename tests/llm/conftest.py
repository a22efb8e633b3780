import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed: int = 5, count: int = 120) -> list[tuple]:
    """Documents with copies, near copies, repeated passages, nulls and empty texts."""
    rng = random.Random(seed)
    en = ["the", "of", "and", "to", "in", "is", "house", "river", "think", "with"]
    de = ["der", "und", "die", "das", "ist", "nicht", "haus", "fluß", "über", "mit"]
    rows = []
    for i in range(count):
        words, lang = (en, "en") if i % 3 else (de, "de")
        text = "\n".join(" ".join(rng.choice(words) + rng.choice(["", "s", "n"]) for _ in range(rng.randint(3, 12))) + "." for _ in range(rng.randint(1, 12)))
        rows.append((i, text, lang, f"src{i % 4 if i % 2 else 0}", len(text)))
    passage = "\n".join(" ".join(rng.choice(en) for _ in range(9)) for _ in range(14))
    for i in range(3, 40, 6):
        rows[i] = (i, rows[i][1] + "\n" + passage + "\n" + rows[i + 1][1], *rows[i][2:])
    for i in range(50, 60):
        rows[i] = (i, rows[49][1], *rows[i][2:])
    for i in range(60, 66):
        rows[i] = (i, passage + "\n" + passage.upper() + f" tail{i}", *rows[i][2:])
    rows += [(count, None, "en", "src1", None), (count + 1, "", None, None, 0), (None, "some text here", "en", None, 14), (None, None, None, None, None)]
    rows += [(count + 2, " \n\t 123 .", "de", "src0", 9), rows[10], rows[10], (count + 3, "word " * 20_000, "en", "src2", 100_000)]
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def clashing(docs):
    """More columns, with the names that the operators use for themselves."""
    from pyspark.sql import functions as F

    names = ["_copy", "_place", "shard", "slot", "spans", "items", "n_words", "_raw", "_row", "fp", "root", "component_id", "_text_key", "digest", "_score", "_lang_pred", "_0", "_1", "k0", "size", "_clean", "_drop", "_count", "stratum", "_u", "_salt", "_order", "rate"]
    return docs.select("*", *(F.lit(f"x{i}").alias(n) for i, n in enumerate(names)))


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
