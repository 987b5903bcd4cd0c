import random

import pytest

from spanfold.llm import weak_quality as q

BIT = 1 << q.LABELLERS.index("copies_of_words")


@pytest.mark.parametrize("n", [999, 1000, 1001, 1999, 2000, 2001, 20_000])
def test_length_does_not_switch_the_vote(n):
    rng = random.Random(n)
    few = " ".join(f"w{rng.randrange(200)}" for _ in range(n))  # some hundred distinct words, shuffled
    many = " ".join(f"w{i % 900}" for i in range(n))  # copies only across windows
    assert q.votes(few) & BIT and not q.votes(many) & BIT


def test_value():
    words = [b"%d" % (i % 7) for i in range(2500)]
    assert q.copies_of_words(words) == pytest.approx(1 - 21 / 2500) and q.copies_of_words([b"a"]) == 0
