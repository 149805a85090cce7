"""Cutting text for byte-level BPE at spaces where the split pattern must end a word.

At a space that follows a non-space character, or that precedes one, the pattern always begins a new word, so that a text
may be cut at such spaces and each piece encoded alone. A text with another space (one after white space and before white
space or the end), or with a special token in it, is one piece. The pieces repeat a lot; each is encoded once.
"""

from __future__ import annotations

import re
from itertools import compress, repeat
from operator import is_

_UNSAFE = re.compile(r"\s (?:\s|\Z)")
#: Pieces, and words, that a worker remembers.
REMEMBERED = 800_000

#: Code points for which all versions of the Unicode tables agree on the split pattern.
_SETTLED = re.compile(r"[\x00-\u052F]*\Z")


def _byte_chars() -> dict[int, int]:
    """The character that byte-level vocabularies write for each byte: itself if it is visible, else the next from 256 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(seen)]
    return {b: b for b in seen} | {b: 256 + i for i, b in enumerate(hidden)}


BYTE_CHARS = _byte_chars()


def word_splitter(library):
    """Words of a piece as the library cuts them; its own, slower cutting where the tables might differ."""
    import public_tokenizers
    import regex

    find, own = regex.compile(public_tokenizers.PATTERN).findall, library.pre_tokenizer.pre_tokenize_str

    def split(piece: str) -> list[str]:
        return find(piece) if _SETTLED.match(piece) else [piece[a:b] for _, (a, b) in own(piece)]

    return split


def cut(text: str, specials: tuple[str, ...]) -> list[str] | None:
    """The pieces of a text, all but the first without the space that they begin with; None: the text is one piece."""
    if _UNSAFE.search(text) or any(s in text for s in specials):
        return None
    return text.split(" ")


class Memory:
    """Values of keys, solved once and remembered: any key while there is much room, then those met again, up to `most`."""

    MET = 1 << 22

    def __init__(self, solve, most: int = REMEMBERED):
        self.solve, self.most, self.known = solve, most, {}
        self.met, self.marks = bytearray(self.MET), 0

    def values(self, keys: set) -> dict:
        known = self.known
        here = {k: known[k] for k in keys if k in known}
        if len(here) < len(keys):
            new = [k for k in keys if k not in here]
            found = dict(zip(new, self.solve(new), strict=True))
            here.update(found)
            if len(known) < self.most * 3 // 4:
                known.update(found)
            elif len(known) < self.most:
                met, last = self.met, self.MET - 1
                for k, v in found.items():
                    if met[at := hash(k) & last]:
                        known[k] = v
                    else:
                        met[at] = 1
                        self.marks += 1
                if self.marks > self.MET // 2:
                    self.met, self.marks = bytearray(self.MET), 0
        return here


class Pieces:
    """Values of whole texts, joined from the values of their words.

    solve(words) gives a value for each word of the split pattern, whole(texts) for each text; join(values) makes one of
    several. Where `split` is None, words can't be told apart and all texts are taken whole.
    """

    def __init__(self, solve, whole, join, split, specials: tuple[str, ...], most: int = REMEMBERED, most_words: int | None = None):
        self.join, self.split, self.specials = join, split, specials
        self.words = Memory(solve, most_words or most)
        self.whole = whole
        self.first = Memory(self._solve, most // 8)
        self.rest = Memory(lambda keys: self._solve([f" {k}" for k in keys]), most)

    def _solve(self, pieces: list[str]) -> list:
        words = [self.split(x) for x in pieces]
        found = self.words.values({w for x in words for w in x})
        return [self.join([found[w] for w in x]) for x in words]

    def parts(self, texts: list[str]) -> list[list]:
        """For each text the values of its parts, in order."""
        cuts = [cut(t, self.specials) if self.split else None for t in texts]
        other = [i for i, p in enumerate(cuts) if p is None]
        whole = dict(zip(other, self.whole([texts[i] for i in other]), strict=True)) if other else {}
        first = self.first.values({p[0] for p in cuts if p is not None})
        get, missing, out = self.rest.known.get, set(), []
        for p in cuts:
            values = list(map(get, p)) if p is not None else None
            if values:
                values[0] = first[p[0]]
                missing.update(compress(p, map(is_, values, repeat(None))))
            out.append(values)
        found = self.rest.values(missing) if missing else {}
        for i, (p, values) in enumerate(zip(cuts, out, strict=True)):
            if values is None:
                out[i] = [whole[i]]
            elif missing:
                out[i] = [found[k] if v is None else v for k, v in zip(p, values, strict=True)]
        return out
