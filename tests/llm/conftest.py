import random

import pytest


@pytest.fixture
def prose():
    """A function that makes n words of prose from a seed."""

    def make(seed, n, vocabulary=400):
        rng = random.Random(seed)
        syllables = ["ta", "ne", "ro", "mi", "su", "ka", "lo", "ve"]
        words = ["".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(vocabulary)]
        return " ".join(rng.choices(words, k=n))

    return make
