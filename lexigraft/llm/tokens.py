"""Token ids of whole texts from a public tokenizer file, encoded word by word.

The tokenizers of this kind lower-case, drop white space and cut letters from
punctuation before they merge, so a text's ids are its words' ids one after
another, and a word's are those of its punctuation and letters. Each Python
worker keeps the ids of the words it has seen; the store is emptied when it is
full, which changes no result. A tokenizer that treats a sample of texts in
another way gets whole texts instead.
"""

from __future__ import annotations

import os

import numpy as np

#: Words whose ids a worker keeps (about 180 bytes each), and their bytes.
STORE, STORE_BYTES = 700_000, 32 << 20
#: What shows whether a tokenizer lower-cases and cuts at white space and punctuation.
PROBES = ("The the  THE\n\tfoo-bar, (x) [y] Ünïcode ÉTÉ 日本", " a.b,c!! don't 12345 x_y \u3000ß \U0001f600 end.", "\r\vone\ftwo  ,three; İ ŉ")
#: Words that are encoded in one string.
JOINED = 200
PUNCTUATION = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_encoders: dict[str, WordEncoder] = {}


def parted(word: bytes) -> tuple[bytes, bytes, bytes] | None:
    """A word's leading punctuation, letters and trailing punctuation, or None if it isn't so built."""
    low = word.lower()
    core = low.strip(PUNCTUATION)
    if len(core) == len(low) or not core or b"<|" in low:
        return None
    if not core.isalpha():  # ASCII letters
        text = core.decode()
        if not (text[0].isalpha() and text[-1].isalpha()):
            return None
    head = low.index(core)  # what stands before it is punctuation, with which it doesn't begin
    return low[:head], core, low[head + len(core) :]


class WordEncoder:
    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}
        self.held = 0
        self.by_word = all(self.whole([p.encode()]) == self.encode_all([p.encode()]) == self.whole([p.encode().lower()]) for p in PROBES)
        self.known.clear()

    by_word = True

    def whole(self, texts: list[bytes]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch([t.decode() for t in texts], add_special_tokens=False)]

    def alone(self, words: list[bytes]) -> None:
        found = self.tokenizer.encode_batch([w.decode() for w in words], add_special_tokens=False)
        self.known.update((w, np.array(e.ids, "<u4").tobytes()) for w, e in zip(words, found, strict=True))

    def joined(self, words: list[bytes]) -> None:
        """Words of letters only: many in a string, told apart by the library's word numbers."""
        groups = [words[i : i + JOINED] for i in range(0, len(words), JOINED)]
        found = self.tokenizer.encode_batch([b" ".join(g).decode() for g in groups], add_special_tokens=False)
        for group, e in zip(groups, found, strict=True):
            numbers = np.array(e.word_ids, np.int64)
            cuts = np.flatnonzero(np.diff(numbers)) + 1
            if len(cuts) + 1 != len(group):
                self.alone(group)
                continue
            packed, cuts = np.array(e.ids, "<u4").tobytes(), [0, *(4 * cuts).tolist(), 4 * len(numbers)]
            self.known.update((w, packed[a:b]) for w, a, b in zip(group, cuts, cuts[1:], strict=False))

    def learn(self, new: set[bytes]) -> None:
        built = {w: p for w in new if not w.isalpha() and (p := parted(w))}
        needed = new.difference(built).union(*built.values())
        needed.discard(b"")
        needed = needed.difference(self.known)  # difference_update would go through all known words, not the needed ones
        plain = [w for w in needed if w.isalpha()]  # ASCII letters
        self.joined(plain)
        rest = needed.difference(plain)
        letters = [w for w in rest if w.decode().isalpha()]
        self.joined(letters)
        self.alone(list(rest.difference(letters)))
        known = self.known
        get = known.get
        known.update({w: get(a, b"") + known[b] + get(c, b"") for w, (a, b, c) in built.items()})

    def encode_all(self, texts: list[bytes]) -> list[bytes]:
        """Each UTF-8 text's ids, packed as little-endian unsigned 32-bit numbers."""
        if not self.by_word:
            return self.whole(texts)
        split = [t.split() for t in texts]
        known = self.known
        new = set().union(*split).difference(known)
        size = sum(map(len, new))
        if len(known) + len(new) > STORE or self.held + size > STORE_BYTES:
            known.clear()
            self.held = 0
            if len(split) > 1 and (len(new) > STORE // 4 or size > STORE_BYTES // 4):
                half = len(texts) // 2
                return self.encode_all(texts[:half]) + self.encode_all(texts[half:])
            new = set().union(*split)
            size = sum(map(len, new))
        if new:
            self.held += size
            self.learn(new)
        return [b"".join(map(known.__getitem__, parts)) for parts in split]


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]
