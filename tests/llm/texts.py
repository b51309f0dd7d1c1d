"""Deterministic texts for these tests."""

import random

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(k, n=80):
    """``n`` words that depend on ``k``; different ``k`` share no long passages."""
    rng = random.Random(k)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(97)) for _ in range(n))
