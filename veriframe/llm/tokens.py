"""Token ids of whole texts with the tokenizers library, word by word.

The word vocabularies drop white space before merging, so a text's ids are its
whitespace-separated chunks' ids in a row. Each worker remembers the chunks it has met (a
bounded memory) and passes only the words of new ones to the library's model.
"""

from __future__ import annotations

import json
import os
import re
import struct
from functools import lru_cache

import regex

#: Chunks remembered by a worker, in two generations; the older goes when the younger is full.
REMEMBERED = 1_600_000
#: str.split() parts at these, the vocabulary's pattern does not.
ODD_BLANKS = re.compile(r"[\x1c-\x1f]")
#: Below this character no normal form changes anything.
PLAIN = "\u0250"
NOT_PLAIN = re.compile("[\u0250-\U0010ffff]")


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[int, int]:
    """The letter that byte-level vocabularies write for each byte: printable Latin-1 as it is, others from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in own]
    return {b: b for b in own} | {b: 256 + i for i, b in enumerate(others)}


class Splitter:
    """Words of a chunk of text, in the vocabulary's letters; special tokens as ids."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            self.table = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.normalizer, self.splitter, self.model = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer, self.tokenizer.model
        self.special = {t["content"]: t["id"] for t in self.table["added_tokens"]}
        self.special_pattern = re.compile("(" + "|".join(sorted(map(re.escape, self.special), key=len, reverse=True)) + ")") if self.special else None
        self.pattern = regex.compile(self.table["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.letters = byte_letters()

    def words(self, chunk: str) -> list[str | int]:
        if self.special_pattern and "<|" in chunk:
            out: list[str | int] = []
            for part in self.special_pattern.split(chunk):
                if part in self.special:
                    out.append(self.special[part])
                elif part:
                    out += self.plain(part)
            return out
        return self.plain(chunk)

    def plain(self, chunk: str) -> list[str | tuple[str]]:
        """Lower-cased words; those the library has to normalize come in a tuple, in its letters."""
        if chunk.isascii() or max(chunk) < PLAIN:
            low = chunk.lower()
            if low.isalpha():
                return [low]
            if low[:-1].isalpha():  # one sign or digit at the end
                return [low[:-1], low[-1]]
            return self.pattern.findall(low)
        return [(w,) for w, _ in self.splitter.pre_tokenize_str(self.normalizer.normalize_str(chunk))]

    def spelled(self, word: str | tuple[str]) -> str:
        """The word in the vocabulary's letters."""
        if isinstance(word, tuple):
            return word[0]
        return word if word.isascii() and word.isalpha() else word.encode().decode("latin-1").translate(self.letters)


def chunks_of(text: str) -> list[str]:
    """Runs between white space as the vocabulary's pattern sees it."""
    return [c for c in re.split(r"[^\S\x1c-\x1f]+", text) if c] if ODD_BLANKS.search(text) else text.split()


class WordIds:
    """Ids of texts as little-endian unsigned 32-bit integers in bytes.

    Texts whose letters have plain lower forms are lowered as a whole, so a word is learnt once whatever its
    case. The memory has two generations of half the size each: what is used again moves to the younger one."""

    def __init__(self, path: str):
        self.splitter = Splitter(path)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.of_word: dict[str | int, bytes] = {}  # parts that aren't chunks of letters

    def _ids(self, word: str | tuple[str] | int) -> bytes:
        ids = [word] if isinstance(word, int) else [t.id for t in self.splitter.model.tokenize(self.splitter.spelled(word))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _word(self, word: str | tuple[str] | int) -> bytes:
        """A part of a chunk; words of letters are chunks of their own."""
        memory = self.known if isinstance(word, str) and word.isalpha() else self.of_word
        data = memory.get(word)
        if data is None:
            data = memory[word] = self._ids(word)
        return data

    def _learn(self, chunk: str) -> bytes:
        data = self.older.get(chunk)
        if data is None:
            parts = self.splitter.words(chunk)
            data = self._word(parts[0]) if len(parts) == 1 else b"".join([self._word(w) for w in parts])
        self.known[chunk] = data
        return data

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if len(self.known) > REMEMBERED // 2:
            self.older, self.known = self.known, {}
        if len(self.of_word) > REMEMBERED:
            self.of_word.clear()
        chunks = chunks_of(self.lowered(text))
        get = self.known.get
        found = list(map(get, chunks))
        if None in found:
            for i, data in enumerate(found):
                if data is None:  # unless it was learnt earlier in this text
                    found[i] = get(chunks[i]) or self._learn(chunks[i])
        return b"".join(found)

    def lowered(self, text: str) -> str:
        """The text in lower case where that is all that its normal form does; special tokens keep theirs."""
        if ("<|" in text and self.splitter.special) or not (text.isascii() or NOT_PLAIN.search(text) is None):
            return text
        return text.lower()


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)
