"""Ids of whole texts, equal to those of the tokenizers library.

Two kinds of vocabulary files are read, both in that library's own format:

* byte level: the file's vocabulary as merge ranks for tiktoken, whose merges
  are several times faster. The split pattern is the same, merges go by the
  same ranks (checked when the file loads), and the special strings of the
  file are found first, as the library does by default.
* word ends: white space is dropped and nothing joins words across it, so a
  text's ids are its words' ids. Words come from a cache in the worker; a word
  not there is cut into its parts, and each part that is not cached either is
  merged by the same ranks. Words with characters outside ASCII and the Latin
  letters, or that may hold a special string, go to the library whole.

Any other file goes to the library text by text.
"""

from __future__ import annotations

import array
import functools
import json
import os
import re

WORD_ENTRIES = 150_000
PART_ENTRIES = 200_000
#: Longer words are encoded each time.
KEPT_CHARS = 48

#: The split of the byte-level pre-tokenizer. A fixed value of the format.
BYTE_LEVEL_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The split of the word-end files, on lower-cased ASCII and Latin letters.
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+")
_PLAIN = re.compile(r"(?:(?!<\|)[!-~À-ÖØ-öø-ÿ])+")
_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
#: Signs that may end a word of letters and are one part; "<" may begin a special string.
_SIGNS = "!\"#$%&'()*+,-./:;=>?@[\\]^_`{|}~"
#: str.split() also cuts at these; the library takes them as characters.
_SEPARATORS = re.compile("[\x1c-\x1f]")
_WIDE = re.compile("[^\x00-\xff]")
#: Stands for the mark of a word's end; no UTF-8 text has this byte.
WORD_END = b"\xff"
_workers: dict = {}


def byte_alphabet() -> dict[str, int]:
    """Characters of byte-level files -> bytes: printable ones stand for themselves, the rest follow from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


def _core(kind: dict, pattern: str, special: dict[str, int]):
    """The file's vocabulary as merge ranks: bytes -> id, the mark of a word's end as WORD_END."""
    import tiktoken

    letters = byte_alphabet()
    end = kind["model"].get("end_of_word_suffix") or ""

    def raw(token: str) -> bytes:
        ended = bool(end) and token.endswith(end)
        return bytes(letters[c] for c in (token[: -len(end)] if ended else token)) + WORD_END * ended

    ranks = {raw(token): i for token, i in kind["model"]["vocab"].items() if token not in special}
    pairs = [m if isinstance(m, list) else m.split(" ") for m in kind["model"]["merges"]]
    made = [ranks[raw(a) + raw(b)] for a, b in pairs]
    if made != sorted(made) or end and max(ranks[bytes([b]) + WORD_END] for b in range(256)) > made[0]:
        raise ValueError("the merges of this file are not in the order of its ids")
    return tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)._core_bpe


class ByteLevelIds:
    def __init__(self, kind: dict):
        special = {x["content"]: x["id"] for x in kind["added_tokens"]}
        self.core = _core(kind, BYTE_LEVEL_SPLIT, special)
        self.special = set(special)

    def ids(self, texts: list[str | None]) -> list[bytes]:
        encode = self.core.encode_to_tiktoken_buffer
        return [bytes(encode(x, self.special)) if x else b"" for x in texts]


class LibraryIds:
    def __init__(self, path: str):
        self.path = path

    @functools.cached_property
    def tokenizer(self):
        """Loaded for the first text that needs it; it takes tens of MB."""
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def one(self, text: str) -> bytes:
        return array.array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def ids(self, texts: list[str | None]) -> list[bytes]:
        return [self.one(x) if x else b"" for x in texts]


class _Words(dict):
    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, word: str) -> bytes:
        got = self.make(word)
        if len(word) <= KEPT_CHARS:
            self[word] = got
        return got


class WordEndIds(LibraryIds):
    def __init__(self, path: str, kind: dict):
        super().__init__(path)
        self.core = _core(kind, r"\S+", {x["content"]: x["id"] for x in kind["added_tokens"]})
        self.words, self.parts = _Words(self._word), _Words(self._part)

    def _part(self, part: str) -> bytes:
        return array.array("I", self.core.encode_single_piece(part.encode() + WORD_END)).tobytes()

    def _word(self, word: str) -> bytes:
        letters = word.rstrip(_SIGNS)
        if letters.isalpha() and (letters.isascii() or _LETTERS.fullmatch(letters)):
            ids = self.parts[letters.lower()]
            return ids if len(letters) == len(word) else ids + self.parts[word[len(letters) :]]
        if not _PLAIN.fullmatch(word):
            return self.one(word)
        parts = _PARTS.findall(word.lower())
        return self.parts[parts[0]] if len(parts) == 1 else b"".join(map(self.parts.__getitem__, parts))

    def ids(self, texts: list[str | None]) -> list[bytes]:
        out = []
        for text in texts:
            if not text:
                out.append(b"")
            elif _SEPARATORS.search(text):
                out.append(self.one(text))
            else:
                if "<|" not in text and (text.isascii() or not _WIDE.search(text)):
                    text = text.lower()  # each of these letters has one lower-case form, the library's; fewer words are cut
                out.append(b"".join(map(self.words.__getitem__, text.split())))
                for kept, most in ((self.words, WORD_ENTRIES), (self.parts, PART_ENTRIES)):
                    if len(kept) > most:
                        kept.clear()
        return out


def worker(path: str):
    """The encoder of this process for a file of the tokenizers library."""
    if path not in _workers:
        with open(path, encoding="utf-8") as f:
            kind = json.load(f)
        pre, model = kind.get("pre_tokenizer") or {}, kind["model"]
        if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not kind.get("normalizer") and not model.get("end_of_word_suffix"):
            _workers[path] = ByteLevelIds(kind)
        elif model.get("end_of_word_suffix") and pre.get("type") == "Sequence" and "Lowercase" in json.dumps(kind.get("normalizer")):
            _workers[path] = WordEndIds(path, kind)
        else:
            _workers[path] = LibraryIds(path)
    return _workers[path]
