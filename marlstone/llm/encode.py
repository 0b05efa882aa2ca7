"""Token ids of whole texts by the tokenizers library, with a cache of words.

Encoding a text at once and encoding it in pieces that the pre-tokenizer can
never join give the same ids. Invented or natural prose repeats its words, so
the library sees each piece once and a dictionary does the rest.
"""

from __future__ import annotations

import json
import os
import re
import sys
from array import array

import numpy as np

from marlstone.llm.common import Memo

_LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"

#: What neither library rule can split or join: words of Latin letters, runs of
#: full stops and commas, and single line ends. All else goes to the library
#: with its surroundings, up to a single space between two other characters.
_PARTS = {
    "space-led": rf" ?[{_LATIN}]+(?=[ .,\n]|\Z)|[.,]+(?=[ \n]|\Z)|\n(?=\S)| ?(?:(?!(?<=\S) (?=\S))[\s\S])+",
    "space-free": rf"[{_LATIN}]+(?=[ .,\n]|\Z)|[.,]+(?=[ \n]|\Z)|[^ \n]+",
}
_SIMPLE = re.compile(rf" ?[{_LATIN}]+|[.,]+|\n")


def _byte_chars() -> dict[int, str]:
    """Byte-level alphabet: printable bytes stand for themselves, the others
    follow from code point 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class TextEncoder:
    """``encode(text)`` gives the little-endian ids of the whole text as bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tok.get_vocab_size() <= 1 << 16 else "<u4")
        spec = json.loads(self.tok.to_str())
        norm, pre = spec.get("normalizer"), spec.get("pre_tokenizer") or {}
        steps = pre.get("pretokenizers", [pre])
        plain = not any(" " in t["content"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"])
        plain = plain and spec["model"]["type"] == "BPE" and not spec["model"].get("dropout")
        self.added = [t["content"] for t in spec["added_tokens"]]
        self._bytes = _byte_chars()
        self.rule = "whole"
        if plain and norm is None and len(steps) == 1 and steps[0].get("type") == "ByteLevel" and steps[0]["use_regex"] and not steps[0]["add_prefix_space"]:
            self.rule = "space-led"
        elif plain and self._drops_space(norm, steps):
            self.rule = "space-free"
        self._find = re.compile(_PARTS[self.rule]).findall if self.rule in _PARTS else None
        self._cache = Memo(self._part)
        self._code = "H" if self.dtype.itemsize == 2 else "I"

    @staticmethod
    def _drops_space(norm, steps) -> bool:
        """Pre-tokens never hold white space, and no normalizer step joins over it."""
        names = [s["type"] for s in (norm or {}).get("normalizers", [norm] if norm else [])]
        return (
            set(names) <= {"NFC", "Replace", "Lowercase"}
            and [s.get("type") for s in steps] == ["Split", "ByteLevel"]
            and steps[0]["behavior"] == "Removed"
            and steps[0]["invert"]
            and steps[0]["pattern"].get("Regex", "").endswith(r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
            and not steps[1]["use_regex"]
            and not steps[1]["add_prefix_space"]
        )

    def whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _part(self, part: str) -> bytes:
        if part.isascii() and part.removeprefix(" ").isalpha():
            shown = part.replace(" ", self._bytes[32]) if self.rule == "space-led" else part.lower()
        elif not _SIMPLE.fullmatch(part):
            return self.whole(part)
        else:
            if self.rule == "space-free":
                part = part.lower()
            shown = part.encode().decode("latin-1").translate(self._bytes)
        ids = array(self._code, [t.id for t in self.tok.model.tokenize(shown)])
        return (ids if sys.byteorder == "little" else ids.byteswap() or ids).tobytes()

    def encode(self, text: str) -> bytes:
        if self._find is None:
            return self.whole(text)
        return b"".join(map(self._cache.__getitem__, self._find(text)))


_ENCODERS: dict[str, TextEncoder] = {}


def encoder(path: str) -> TextEncoder:
    """One encoder a worker process and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = TextEncoder(path)
    return _ENCODERS[path]
