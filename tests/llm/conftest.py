from __future__ import annotations

import random

import pytest


@pytest.fixture(scope="session")
def prose():
    """Reproducible sentences of invented words."""
    draw = random.Random(5)
    syllables = [a + b for a in "bdfgklmnprst" for b in "aeiou"]

    def sentence(words: int) -> str:
        return " ".join("".join(draw.choices(syllables, k=draw.randint(1, 4))) for _ in range(words)).capitalize() + "."

    def text(sentences: int) -> str:
        return " ".join(sentence(draw.randint(6, 14)) for _ in range(sentences))

    return text


@pytest.fixture(scope="session")
def odd_rows():
    """Cases every operator must survive: NULLs, empty and blank texts, repeated rows, a long word, clashing ids."""
    return [
        (1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "one"), (5, "one"), (None, "no id here"), (None, None),
        (6, "x" * 70_000), (7, "a b " * 20_000), (8, "ein kleiner Satz. " * 12), (8, "the same id, another text"),
    ]
