import random

import pytest

SF = "/root/testdata/sf0.001"


def words(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def corpus(spark):
    """Documents with copies, near copies, a shared passage, odd texts, a repeated row and clashing extra columns."""
    rng = random.Random(7)
    texts = [words(rng, rng.randint(1, 120)) for _ in range(60)]
    texts += texts[:5]
    for t in texts[5:25]:
        parts = t.split()
        for k in rng.sample(range(len(parts)), min(len(parts), rng.randint(1, 3))):
            parts[k] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(parts))
    passage = words(rng, 40)
    texts += [f"{words(rng, 30)} {passage} {words(rng, 30)}" for _ in range(12)]
    base = words(rng, 80).split()
    for k in range(25):
        near = list(base)
        near[(3 * k) % 80] = f"y{k}"
        texts.append(" ".join(near))
    texts += [None, "", "   ", "one", "ONE", "one two", "a\tb\n c\x0bd", "é ü ñ", "1 2 3", "🙂 🙂", words(rng, 9000), "z" * 50_000]
    rows = [(i, t, "id", "n", 0) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3]]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "doc_id long, text string, component_id string, _part string, n int").repartition(5)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")
