import random

import pytest

WORDS = [a + b for a in "ba de fi go lu mar nes pol ris tan".split() for b in "ka le mi no ru sta ven xor".split()]


def prose(seed: int, n: int) -> str:
    """Seeded text of ``n`` words with sentences and lines."""
    r = random.Random(seed)
    words = [r.choice(WORDS) + r.choice(["", "", "s", "n"]) for _ in range(n)]
    out, left = [], 0
    for w in words:
        if left == 0:
            left = r.randrange(5, 12)
            w = w.capitalize()
        left -= 1
        out.append(w + ("." if left == 0 else ""))
    return " ".join(out)


@pytest.fixture(scope="session")
def documents(spark):
    """Builds a documents table with clashing extra columns."""

    def build(rows):
        full = [(i, t, lang, source, len(t or ""), "x", 1) for i, t, lang, source in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, text_hash string, kept int")

    return build
