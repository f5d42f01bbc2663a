import pytest


@pytest.fixture(scope="session")
def texts():
    """Invented documents: copies, near copies, shared passages, odd and empty ones."""
    import random

    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("aeioustrnlmdé") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    make = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage = make(70)
    out = []
    for i in range(60):
        words = make(rng.randint(20, 300))
        if i % 5 == 0:
            at = rng.randint(0, len(words))
            words = words[:at] + passage + words[at:]
        out.append(" ".join(words))
    for i in range(0, 20, 2):
        words = out[i].split()
        for _ in range(rng.randint(1, 6)):
            words[rng.randrange(len(words))] = "edit"
        out.append("\n".join([" ".join(words[:10]), " ".join(words[10:])]))
    out += [out[3], out[3], out[4] + " tail", "", None, " ", "one", "one two", "One TWO", "a b c", "a b c", "Queja " * 200, "x" * 700, "x" * 450]
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i, t, "en", "s", "extra", 1) for i, t in enumerate(texts)] + [(None, texts[3], "en", "s", "x", 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, h string, k int").repartition(3).cache()


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("false")
