"""Character classes of the public tokenizers' splitting patterns for Python's ``re``.

Which code points are letters, numbers or white space depends on the Unicode version;
they are asked of the tokenizers library itself, so that patterns split as it does.
"""

from __future__ import annotations

import re
from functools import cache
from itertools import chain, groupby

#: Patterns over fewer code points match faster: Latin, the basic plane, everything.
TIERS = (0x250, 0x10000, 0x110000)
_BEYOND = [re.compile(f"[^\\x00-\\U{t - 1:08x}]") for t in TIERS[:-1]]


@cache
def members(kind: str, below: int) -> list[int]:
    """Code points of a class such as ``\\p{L}``, as the library's patterns see it."""
    from tokenizers import Regex, pre_tokenizers

    every = [chr(c) for c in range(below) if not 0xD800 <= c < 0xE000]
    kept = pre_tokenizers.Split(Regex(kind), "removed").pre_tokenize_str("".join(every))
    return sorted(map(ord, set(every).difference("".join(x for x, _ in kept))))


def inside(kind: str, below: int) -> str:
    """The class as the inside of a ``re`` class, up to a code point."""
    out = []
    for _, run in groupby(enumerate(members(kind, below)), lambda x: x[1] - x[0]):
        run = [p for _, p in run]
        out.append(f"\\U{run[0]:08x}-\\U{run[-1]:08x}")
    return "".join(out)


@cache
def pattern(template: str, tier: int) -> re.Pattern:
    """``template`` with ``%L``, ``%N`` and ``%S`` (letters, numbers, white space) for a tier."""
    for mark, kind in (("%L", r"\p{L}"), ("%N", r"\p{N}"), ("%S", r"\s")):
        template = template.replace(mark, inside(kind, TIERS[tier]))
    return re.compile(template)


def tier(text: str) -> int:
    """Index of the first tier that holds every character."""
    if text.isascii() or not _BEYOND[0].search(text):
        return 0
    return 1 if not _BEYOND[1].search(text) else 2


def byte_chars() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte: printable
    Latin-1 characters stand for themselves, the others follow from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class Recent:
    """A bounded cache in two ages: when the new one is full it becomes the old one, and
    what is asked for again moves back, so common words stay."""

    def __init__(self, limit: int):
        self.limit, self.new, self.old = limit, {}, {}

    def tidy(self) -> None:
        if len(self.new) > self.limit:
            self.old, self.new = self.new, {}

    def ensure(self, keys, learn) -> None:
        """Afterwards ``new`` holds all keys; ``learn(keys)`` gives a dict of unknown ones."""
        unknown = []
        for k in keys:
            v = self.old.get(k)
            if v is None:
                unknown.append(k)
            else:
                self.new[k] = v
        if unknown:
            self.new.update(learn(unknown))


def looked_up(texts: list[list[str]], known: Recent, learn) -> list[list[bytes]]:
    """The values of all parts of all texts; ``learn`` gives those not known."""
    known.tidy()
    got = [list(map(known.new.get, parts)) for parts in texts]
    holes = [i for i, values in enumerate(got) if None in values]
    known.ensure({p for i in holes for p, v in zip(texts[i], got[i]) if v is None}, learn)
    for i in holes:
        got[i] = list(map(known.new.__getitem__, texts[i]))
    return got


def joined(parts: list[str], words: list[list[str]], known: Recent, learn) -> dict[str, bytes]:
    """For each part the values of its words, put together."""
    known.tidy()
    known.ensure(set(chain.from_iterable(words)).difference(known.new), learn)
    get = known.new.__getitem__
    return {p: get(w[0]) if len(w) == 1 else b"".join(map(get, w)) for p, w in zip(parts, words)}
