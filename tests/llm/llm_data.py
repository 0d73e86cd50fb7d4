"""Texts for the tests."""

WORDS = "the and of a to in is was it for on with as his they be at one have this from or had by hot but some what there we can out other were all your when up use word how said an each she which do their time if will way about many then them would write like so these her long make thing see him two has look more day could go come did my sound no most number who over know water than call first people may down side been now find".split()


def prose(seed: int, n: int) -> str:
    import random

    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + (r.choice(["", ",", "."]) if i % 7 == 6 else "") for i in range(n))
