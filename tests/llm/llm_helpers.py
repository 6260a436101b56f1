"""Small helpers shared by the tests of this folder."""

WORDS = "the of and to a in is on that by sun moon star tree leaf root branch river stone cloud rain".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))
