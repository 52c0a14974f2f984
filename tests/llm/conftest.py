import pytest

#: One input for all operators: null, empty, repeated, long and odd texts; repeated rows; a null id; columns whose names clash with results.
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score double, class_id long, sig string, share long, bin_id string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    import random

    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7)))
    sentence = lambda: " ".join(word() for _ in range(rng.randrange(6, 15))).capitalize() + "."
    base = " ".join(sentence() for _ in range(30))
    shared = " ".join(sentence() for _ in range(7))
    words = base.split()
    near = " ".join(words[:40] + ["changed"] + words[41:])
    texts = {1: base, 2: base, 3: near, 4: None, 5: "", 6: "", 7: "a", 8: "a", 9: "ü\U0001f600  \n\t x" * 30, 10: "x" * 40_000, 11: "\n".join([sentence() + " " + shared, sentence()]), 12: sentence() + " " + shared + " " + sentence(), 13: " \n ", 14: "The. The. The. " * 50, 15: "0123456789" * 30}
    texts |= {k: " ".join(sentence() for _ in range(rng.randrange(1, 60))) for k in range(16, 80)}
    texts[80] = texts[20] + " " + " ".join(sentence() for _ in range(300))
    rows = [(k, t, "en", None if k % 7 == 0 else f"s{k % 3}", len(t or ""), 0.5, 1, "x", 2, "b") for k, t in texts.items()]
    rows += [rows[0], rows[15], (None, base, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, COLUMNS).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], COLUMNS)
