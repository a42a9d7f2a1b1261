"""Ids of a word-level BPE vocabulary, by the tokenizers library, one call for each distinct word.

The normaliser of such a vocabulary (NFC, white space, lower case) and its splitting pattern never reach across
ASCII white space, so the ids of a text are those of its white-space-separated chunks in order. Each worker keeps
the ids of the chunks it has met, up to a bound, and asks the library for the others only.
"""

import functools
import os
import re
from array import array

from tokenizers import Tokenizer

#: A chunk of lower-case Latin-1 letters, and a full stop or comma after it: two words of the splitting pattern.
PLAIN = re.compile("([a-z\xdf-\xf6\xf8-\xff]+)([.,]?)")


def byte_alphabet() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


class WordEncoder:
    def __init__(self, path: str, held: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True  # such strings in a text are ordinary text
        self.model = self.whole.model
        self.alphabet = byte_alphabet()
        self.held = held
        self.known: dict[bytes, bytes] = {}

    def _plain(self, word: str) -> list[int]:
        if not word.isascii():
            word = "".join(map(self.alphabet.__getitem__, word.encode()))
        return [t.id for t in self.model.tokenize(word)]

    def _learn(self, chunks) -> None:
        odd = []
        for chunk in chunks:
            if m := PLAIN.fullmatch(chunk.decode()):
                ids = self._plain(m[1])
                if m[2]:
                    ids += self._plain(m[2])
                self.known[chunk] = array("I", ids).tobytes()
            else:
                odd.append(chunk)
        for at in range(0, len(odd), 10_000):
            part = odd[at : at + 10_000]
            for chunk, got in zip(part, self.whole.encode_batch_fast([c.decode() for c in part], add_special_tokens=False), strict=True):
                self.known[chunk] = array("I", got.ids).tobytes()

    def encode(self, texts: list) -> list[bytes]:
        """The ids of each text (null: none) as unsigned 32-bit integers in the machine's order, which is little-endian."""
        split = []
        for text in texts:
            if not text:
                split.append(())
                continue
            try:
                text.encode("latin-1")  # without combining marks, lower case may come first
                split.append(text.lower().encode().split())
            except UnicodeEncodeError:
                split.append(text.encode().split())
        need = set().union(*split)
        if missing := need.difference(self.known):
            if len(self.known) + len(missing) > self.held:
                self.known = {w: self.known[w] for w in need.difference(missing)}
            self._learn(missing)
        get = self.known.__getitem__
        return [b"".join(map(get, words)) for words in split]


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)
