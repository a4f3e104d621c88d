"""Pieces of texts whose blanks stand alone are found by a plainer pattern, and are the same."""

import random

from notewell.llm import token_alignment as ta


class Cutter:
    by_piece = True


def test_plain_pieces_are_those_of_the_full_pattern(monkeypatch):
    rng = random.Random(5)
    texts = ["", "a", "a b\nc", " a", "a ", "a  b", "a\tb c", "a b c", "\n\na", "a\n", "a \t b", "ü ß x y"]
    texts += ["".join(rng.choices("ab \n\t  é", [6, 6, 4, 1, 1, 1, 1, 2], k=rng.randrange(1, 30))) for _ in range(5000)]
    texts += [" ".join(rng.choices(["a", "bc", "dé"], k=9)) for _ in range(50)]
    for t in texts:
        assert ta.Aligner.cut(Cutter, t) == ta._PIECES.findall(" " + t)
    monkeypatch.setattr(ta, "_PIECES", None)  # a plain text does without it
    assert ta.Aligner.cut(Cutter, "a b\nc") == [" a", " b", "\nc"]
