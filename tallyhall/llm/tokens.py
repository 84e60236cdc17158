"""Exact, cached encoding with public tokenizer files.

A tokenizer whose pre-tokenizer drops white space encodes every word alone, so
a text's ids are the concatenation of its words' ids. Invented or rare words
are encoded by the tokenizers library in batches; repeated ones come from a
bounded cache.
"""

from __future__ import annotations

import json
import os
from array import array

from tallyhall.llm.symbols import byte_symbols

#: Entries of a worker's cache before it starts afresh.
CACHE_WORDS = 800_000
#: Longer words are encoded each time.
CACHED_LENGTH = 48
#: str.split() also cuts at these, the tokenizer doesn't; special tokens start with "<|".
_ODD = ("\x1c", "\x1d", "\x1e", "\x1f", "<|")


#: Marks after a word's letters; no contraction starts with one.
_MARKS = ".,|!?;:#*$%&"


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _composed(s: str) -> bool:
    """Whether every character is below the letters that normalization or context may change."""
    return s.isascii() or max(s) < "ɐ"


class WordEncoder:
    """``encode(texts)`` gives each text's ids as little-endian uint32 bytes.

    Equal to ``encode_batch(texts, add_special_tokens=False)`` without
    truncation and padding. Files whose words aren't independent are encoded
    text by text.
    """

    _made: dict[str, WordEncoder] = {}

    @classmethod
    def get(cls, path: str) -> WordEncoder:
        """One per Python worker, so its cache outlives a task."""
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        parts = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        pattern = parts[0].get("pattern", {}).get("Regex", "")
        self.by_word = parts[0].get("behavior") == "Removed" and parts[0].get("invert") is True and pattern.endswith(r"[^\s\p{L}\p{N}]+")
        lowers = (spec.get("normalizer") or {}).get("normalizers") or []
        self.lowers = any(x.get("type") == "Lowercase" for x in lowers)
        self.cache: dict[str, bytes] = {}
        shown = byte_symbols()
        self.shown = {b: c for b, c in enumerate(shown) if c != chr(b)}

    def _whole(self, texts: list[str]) -> list[bytes]:
        out = []
        for e in self.tokenizer.encode_batch(texts, add_special_tokens=False):
            out.append(array("I", e.ids).tobytes())
        return out

    def _stem(self, word: str) -> tuple[str, str]:
        """A word as a stem and marks that are encoded alone: ids(word) = ids(stem) + ids(marks)."""
        stem, marks = word, ""
        if not word.isalpha():
            cut = word.rstrip(_MARKS)
            # A letter may lower to a letter and a mark of its own, which would join these.
            if len(cut) < len(word) and _composed(cut) and cut.lower().isalpha():
                stem, marks = cut, word[len(cut) :]
        if self.lowers and _composed(stem):
            stem = stem.lower()
        return stem, marks

    def _stems(self, stems: list[str]) -> list[bytes]:
        """Ids of stems. A lower-case, composed run of letters is one pre-token: only the model has work to do."""
        out, rest, tokenize = [b""] * len(stems), [], self.tokenizer.model.tokenize
        for i, s in enumerate(stems):
            if not (self.lowers and s.isalpha()):
                rest.append(i)
            elif s.isascii():
                out[i] = array("I", [t.id for t in tokenize(s)]).tobytes()
            elif _composed(s):  # letters below that bound are composed: normalization leaves them
                out[i] = array("I", [t.id for t in tokenize(s.encode().decode("latin-1").translate(self.shown))]).tobytes()
            else:
                rest.append(i)
        for i, b in zip(rest, self._whole([stems[i] for i in rest]), strict=True):
            out[i] = b
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_word:
            return self._whole(texts)
        odd = [i for i, t in enumerate(texts) if any(x in t for x in _ODD)]
        split = [t.split() for t in texts]
        for i in odd:
            split[i] = []
        self._learn(set().union(*split))
        get = self.cache.__getitem__
        out = [b"".join(map(get, words)) for words in split]
        if odd:
            for i, b in zip(odd, self._whole([texts[i] for i in odd]), strict=True):
                out[i] = b
        for w in self.long:
            self.cache.pop(w, None)
        return out

    def _learn(self, wanted: set[str]) -> None:
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        cache = self.cache
        new = wanted.difference(cache)
        self.long = [w for w in new if len(w) > CACHED_LENGTH]
        stems = {w: self._stem(w) for w in new}
        parts = {p for s in stems.values() for p in s if p and p not in cache}
        parts = list(parts)
        for lo in range(0, len(parts), 20_000):
            some = parts[lo : lo + 20_000]
            cache.update(zip(some, self._stems(some), strict=True))
        self.long += [p for p in parts if len(p) > CACHED_LENGTH]
        cache[""] = b""
        for w, (stem, mark) in stems.items():
            cache[w] = cache[stem] + cache[mark]
