"""Cutting text into units that a tokenizer treats one by one, so that each distinct unit is encoded once a worker.

``byte_units`` is for byte-level BPE vocabularies whose pre-tokenizer attaches one space to the word after it;
``piece_units`` for SentencePiece models without pieces that hold a space after another character.
"""

from __future__ import annotations

import re
from collections.abc import Callable

#: The pre-tokenizer pattern of the byte-level vocabularies.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The unit of one trailing space: one piece. No other unit has a space after another character.
LAST_SPACE = "x "
_double = re.compile(r"\s\s")


def splits_at_each_space(text: str) -> bool:
    """Whether a unit starts at each space of the text and nowhere else."""
    return not (text[-1:].isspace() or _double.search(text))


def byte_units(text: str, find: Callable[[str], list[str]]) -> list[str]:
    """Units whose encodings, one after another, are the text's. find gives the pre-tokens of the pattern.

    Where no two white space characters meet, a space always starts the pre-token of what follows it, so text
    splits at spaces. A text with such runs, or one that ends in a space, goes through the pattern.
    """
    if not splits_at_each_space(text):
        return find(text)
    head, *rest = text.split(" ")
    return [head, *[" " + w for w in rest]] if head else [" " + w for w in rest]


def piece_units(text: str) -> list[str]:
    """Units whose piece counts add up to the text's: words with the spaces before them but one.

    The library puts a space before what it encodes, which stands for the one left out.
    A trailing run of spaces is a unit of its own; a single trailing space is LAST_SPACE.
    """
    parts = text.split(" ")
    if "" not in parts:
        return parts
    units, spaces = [], 0
    for p in parts[:-1]:
        if p:
            units.append(" " * spaces + p)
            spaces = 0
        else:
            spaces += 1
    if parts[-1]:
        units.append(" " * spaces + parts[-1])
    elif spaces or not units:
        units.append(" " * spaces)
    else:
        units.append(LAST_SPACE)
    return units


class UnitCache(dict):
    """unit -> what encode gives for it. Cleared when full: an entry only saves work."""

    def __init__(self, encode: Callable[[list[str]], list], limit: int = 400_000):
        super().__init__()
        self.encode, self.limit = encode, limit

    def learn(self, texts_units: list[list[str]]) -> None:
        new = set().union(*texts_units).difference(self)
        if len(self) + len(new) > self.limit:
            self.clear()
            new = set().union(*texts_units)
        if new:
            units = sorted(new)
            self.update(zip(units, self.encode(units)))

    def find(self, texts_units: list[list[str]]) -> list[list]:
        """What encode gives for each unit of each text; units not yet known are learned on the way."""
        get = self.get
        found = [list(map(get, units)) for units in texts_units]
        missing = [(f, u) for f, u in zip(found, texts_units) if None in f]
        new = list(dict.fromkeys(u for f, units in missing for u, x in zip(units, f) if x is None))
        if new:
            learned = dict(zip(new, self.encode(new)))
            for f, units in missing:
                for i in [i for i, x in enumerate(f) if x is None]:
                    f[i] = learned[units[i]]
            if len(self) + len(new) > self.limit:
                self.clear()
            if len(new) <= self.limit:
                self.update(learned)
        return found
