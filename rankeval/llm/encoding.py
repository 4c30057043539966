"""Token ids of whole texts by a given tokenizer file, quickly: every word is encoded once per worker."""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Sequence
from itertools import chain

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark gives each task its core

CACHED_WORDS = 1_200_000  # about 240 MB
CACHED_BYTES = 48  # longer words are encoded anew each time
SEPARATOR = "\x02"  # encoded between words; words that hold it are encoded alone
TAIL = b".,;:!?"
_LATIN = re.compile("[a-z\u00e0-\u00f6\u00f8-\u024f]+").fullmatch

_ENCODERS: dict[str, WordEncoder] = {}


class WordEncoder:
    """Encodes with a tokenizer that never joins characters across white space.

    For such a tokenizer (the pre-tokenizer splits at and drops white space, and takes runs of letters, single digits
    and runs of other characters) the ids of a text are the ids of its words one after the other, and those of a word
    are those of its letters and of the points after them.  Words are looked up in a bounded cache; only new ones reach
    the tokenizer, many in one call.  ``tests/llm`` holds the result against the tokenizer on whole texts.
    """

    def __init__(self, path: str, words: int = CACHED_WORDS):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.code = "H" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "I"
        (self.between,) = self.tokenizer.encode(SEPARATOR, add_special_tokens=False).ids
        self.cache: dict[bytes, bytes] = {}
        self.room = words
        steps = str(self.tokenizer.normalizer)
        self.lowers = "Lowercase" in steps
        self.light = None
        if self.lowers and "Split(" in str(self.tokenizer.pre_tokenizer) and "ByteLevel(" in str(self.tokenizer.pre_tokenizer):
            # lower-case Latin letters are one piece as they are: neither normalizer nor patterns change them
            self.light = Tokenizer.from_file(path)
            self.light.normalizer = None
            self.light.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])

    def _run(self, tokenizer, words: list[bytes], texts: list[str]) -> None:
        """Encode words without a separator, written as ``texts``, in joined runs."""
        glue = f" {SEPARATOR} "
        found = tokenizer.encode_batch_fast([glue.join(texts[i : i + 256]) for i in range(0, len(texts), 256)], add_special_tokens=False)
        for i, e in zip(range(0, len(words), 256), found):
            ids = np.array(e.ids, self.code)
            data, size, at = ids.tobytes(), ids.itemsize, 0
            for w, end in zip(words[i : i + 256], [*np.flatnonzero(ids == self.between).tolist(), len(ids)], strict=True):
                self.cache[w] = data[at * size : end * size]
                at = end + 1

    def _learn(self, words: list[bytes]) -> None:
        plain, light, texts = [], [], []
        for w in words:
            text = w.decode()
            if self.light is not None and _LATIN(low := text.lower()):
                light.append(w)
                texts.append(low)
            elif SEPARATOR in text:
                self.cache[w] = array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
            else:
                plain.append(w)
        self._run(self.light, light, texts)
        self._run(self.tokenizer, plain, [w.decode() for w in plain])

    def encode(self, texts: Sequence[str | None], end_id: int) -> list[bytes]:
        """Per text its ids and ``end_id``, as little-endian integers of two bytes (four for a large vocabulary)."""
        known, full, end = self.cache, len(self.cache) > self.room, array(self.code, [end_id]).tobytes()
        data = [(t or "").encode() for t in texts]
        if self.lowers:  # fewer words; "<|" may begin a special token, which is found before lower-casing
            data = [d if b"<|" in d else d.lower() for d in data]
        split = [d.split() for d in data]  # at ASCII white space, a part of what the tokenizer drops
        out = [list(map(known.get, words)) for words in split]
        open_ = [i for i, ids in enumerate(out) if None in ids]
        words = {w for i in open_ for w, ids in zip(split[i], out[i]) if ids is None}
        new, parts = [], []
        for w in words:
            base = w.rstrip(TAIL)
            # still a letter after the tokenizer's lower-casing
            if base and len(base) < len(w) and base.decode().lower()[-1].isalpha():
                parts.append((w, base, w[len(base) :]))
            else:
                new.append(w)
        new = list({*new, *(p for _, base, tail in parts for p in (base, tail) if p not in known)})
        self._learn(new)
        for w, base, tail in parts:
            known[w] = known[base] + known[tail]
        for i in open_:
            out[i] = [known[w] if ids is None else ids for w, ids in zip(split[i], out[i])]
        out = [b"".join(ids) + end for ids in out]
        for w in {*new, *words}:  # a full cache keeps what it has
            if full or len(w) > CACHED_BYTES:
                known.pop(w, None)
        return out


def encoder(path: str, words: int = CACHED_WORDS) -> WordEncoder:
    """The worker's encoder for a tokenizer file, which keeps about so many words."""
    if path not in _ENCODERS or _ENCODERS[path].room != words:
        _ENCODERS[path] = WordEncoder(path, words)
    return _ENCODERS[path]


def runs(texts: Sequence[str | None], characters: int = 1 << 19):
    """``(start, stop)`` of consecutive texts with about so many characters, a longer one alone."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if size and size + n > characters:
            yield start, i
            start = i
            size = 0
        size += n
    if start < len(texts):
        yield start, len(texts)
