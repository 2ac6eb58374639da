import numpy as np
import pytest

EXTRA = "n_tokens int, score double, component_id string, text_ string, size int, target double, row int, rid long, held_out string"


@pytest.fixture(scope="session")
def make_docs(spark):
    """documents with columns whose names clash with the operators' own."""

    def make(rows):
        full = [(i, t, "en", s, None, 1, 0.5, "x", "y", 3, 2.0, 9, 4, "z") for i, t, s in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, " + EXTRA).repartition(3)

    return make


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text, source): nulls, empty and long texts, copies, near copies, shared passages, odd white space."""
    rng = np.random.default_rng(4)
    vocabulary = ["".join(rng.choice(list("abcdeéßñ"), rng.integers(2, 8))) for _ in range(400)]
    words = lambda n: [str(w) for w in rng.choice(vocabulary, n)]
    passage = words(60)
    rows = [(1, None, "a"), (2, "", "a"), (3, " \t\n ", None), (4, "one", "b"), (5, "One two three", "b"), (6, "one TWO three", "c")]
    for i in range(10, 40):
        rows.append((i, " ".join(words(int(rng.integers(5, 200)))) + ".", "abc"[i % 3]))
    base = words(300)
    for i in range(40, 60):
        near = list(base)
        for _ in range(i - 40):
            near[int(rng.integers(0, 300))] = "edit"
        rows.append((i, " ".join(near), "a"))
    rows += [(i, rows[10][1], "a") for i in (60, 61, 62)]
    rows += [(i, " ".join(words(20) + passage + words(20)), "b") for i in (63, 64, 65)]
    rows += [(66, " ".join(["echo"] * 120), "c"), (67, "\n".join(" ".join(words(9)) + "." for _ in range(40)), "c"), (68, " ".join(words(9000)), "a")]
    rows += [(69, "a  b   c d ▁ e　f <|endoftext|> g\t\th \n\n i ", None), (None, "no id here at all", "a"), (None, None, None)]
    return rows
