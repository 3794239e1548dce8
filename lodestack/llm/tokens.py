"""Token ids from a public vocabulary file, through a cache of words in front of the tokenizer.

A text is cut at single spaces between other characters, where no token of these vocabularies can span; each
word's ids come from the tokenizer once and are kept, up to `most` words per Python worker (common words come
early and stay). A text with any other kind of space at a cut is encoded whole. The ids are the tokenizer's own
either way, which the tests hold against whole-text encoding.
"""

from __future__ import annotations

import os
import re
from array import array

END = 2
#: Words that a worker keeps, about 200 bytes each.
MOST_WORDS = 250_000
_END = array("I", [END]).tobytes()


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Words that are one piece before merging: ASCII and Latin letters alone (but for the dotted capital I, whose lower case is two characters).
_PLAIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+")
#: The letters of `_PLAIN`.
_LETTERS = frozenset(c for c in map(chr, range(0x250)) if _PLAIN.fullmatch(c))
#: ASCII punctuation that a word may end in. An apostrophe may start a piece of its own kind, and | and > end special tokens.
_MARKS = "!\"#$%&()*+,-./:;<=?@[\\]^_`{}~"


def _byte_characters() -> dict[int, str]:
    """The byte-level vocabularies' character for each byte: itself where it prints, else the next one from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in prints} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in prints)}


class Encoder:
    """`drops_space`: the vocabulary ignores white space altogether (word_bpe_49k), so any cut is safe."""

    def __init__(self, path: str, drops_space: bool, most: int = MOST_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        self.normal = self.tokenizer.normalizer.normalize_str if self.tokenizer.normalizer else str
        self.drops_space, self.most, self.bytes = drops_space, most, _byte_characters()
        self.first: dict[str, bytes] = {}
        self.rest: dict[str, bytes] = self.first if drops_space else {}

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()

    def _word(self, word: str, spaced: bool) -> bytes:
        """Ids of a stretch without spaces at its ends, after a space if `spaced`. Letters go straight to the merges;
        a run of punctuation after a letter, and a line break between others, are pieces of their own."""
        known = self.rest if spaced else self.first
        ids = known.get(word)
        if ids is not None:
            return ids
        if word.isascii() and word.isalpha():
            ids = self._merged(word.lower() if self.drops_space else word, spaced)
        elif word[-1] in _MARKS and (stem := word.rstrip(_MARKS)) and _PLAIN.fullmatch(stem, len(stem) - 1):
            ids = self._word(stem, spaced) + self._mark(word[len(stem) :])
            if word[len(stem) :] in (",", "."):
                return ids
        elif _PLAIN.fullmatch(word):
            ids = self._merged(self.normal(word).encode().decode("latin-1").translate(self.bytes), spaced)
        elif not self.drops_space and "\n" in word and all(p and not p[0].isspace() and not p[-1].isspace() for p in word.split("\n")):
            head, *lines = word.split("\n")
            return self._word(head, spaced) + b"".join([self._mark("\n") + self._word(line, False) for line in lines])
        else:
            ids = self._whole(" " + word if spaced and not self.drops_space else word)
        if len(known) < self.most:
            known[word] = ids
        return ids

    def _merged(self, piece: str, spaced: bool) -> bytes:
        return array("I", [t.id for t in self.merge("\u0120" + piece if spaced and not self.drops_space else piece)]).tobytes()

    def _mark(self, mark: str) -> bytes:
        ids = self.first.get(mark)
        if ids is None:
            ids = self._whole(mark)
            if len(self.first) < self.most:
                self.first[mark] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """The ids of the whole text and the end id, as little-endian unsigned 32-bit integers."""
        if self.drops_space:
            first, rest = None, text.replace("\n", " ").split(" ")
        else:
            first, *rest = text.split(" ")
        get, comma, stop = self.rest.get, self._mark(","), self._mark(".")
        ids, i = [*map(get, rest), None], -1
        while (i := ids.index(None, i + 1)) < len(rest):
            w = rest[i]
            last = w[-1:]
            if (last == "," or last == ".") and w[-2:-1] in _LETTERS and (stem := get(w[:-1])):
                ids[i] = stem + (comma if last == "," else stop)
            elif w and not w[0].isspace() and not last.isspace():
                ids[i] = self._word(w, True)
            elif self.drops_space:
                ids[i] = self._whole(w)
            else:
                return self._whole(text) + _END
        ids[-1] = _END
        if first is not None:
            if not first or first[0].isspace() or first[-1].isspace():
                return self._whole(text) + _END
            ids.insert(0, self._word(first, False))
        return b"".join(ids)


_ENCODERS: dict[tuple, Encoder] = {}


def encoded(texts, path: str, drops_space: bool, most: int = MOST_WORDS):
    """(index, ids) of an Arrow column of texts, null as empty. The worker keeps its encoder between tasks."""
    if (path, drops_space, most) not in _ENCODERS:
        _ENCODERS[path, drops_space, most] = Encoder(path, drops_space, most)
    e = _ENCODERS[path, drops_space, most]
    for i, t in enumerate(texts):
        yield i, e.encode(t.as_py() or "")
