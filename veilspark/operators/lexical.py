"""A token classifier that needs no model: capitalised words, tagged by their length.

It answers the way a subword model does: long words come in ``##`` pieces, some words
come in lower case, and most tokens come without offsets.  It serves as an example of a
tagger, and gives queries entities that plain SQL can reproduce.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Sequence

from pyspark import cloudpickle

# Ship this module's functions inside the task: executors need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

TAGS = ("B-PER", "I-GIVENNAME", "B-ORG", "I-CITY", "B-MISC")
PIECE = 5


def tag_words(chunks: Sequence[str]) -> list[list[dict]]:
    answers = []
    for chunk in chunks:
        tokens = []
        for match in re.finditer("[A-Z][a-z]+", chunk):
            word, n = match.group(), len(match.group())
            known = n % 3 == 0
            shown = word.lower() if n % 7 == 0 else word
            token = {"entity": TAGS[n % 5], "score": (50 + n * 7 % 50) / 100}
            head = min(n, PIECE)
            tokens.append({
                **token,
                "word": shown[:PIECE],
                "start": match.start() if known else None,
                "end": match.start() + head if known else None,
            })
            if n > PIECE:
                tokens.append({
                    **token,
                    "word": "##" + shown[PIECE:],
                    "start": match.start() + PIECE if known else None,
                    "end": match.end() if known else None,
                })
        answers.append(tokens)
    return answers


def load_lexical():
    return tag_words


def load_failing():
    """The same tagger, failing on every chunk with a ``q``; shows how errors are reported."""

    def tag(chunks: Sequence[str]) -> list[list[dict]]:
        if any("q" in chunk for chunk in chunks):
            raise ValueError("a q")
        return tag_words(chunks)

    return tag
