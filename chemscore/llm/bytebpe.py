"""Byte-level BPE files: cutting texts into pre-tokens, and a worker's cache.

A text is first cut at the file's added tokens, as the tokenizers library
does.  Each segment is then cut at spaces.  The pre-token pattern lets a
single space join the pre-token after it, and no pre-token holds a space
between two characters that are not white space; so ``' ' + run`` of every
space-delimited run tokenizes alone exactly as within the segment, unless a
space has white space on both sides (``_ODD``).  Segments of that kind are cut
by the pattern itself, and segments with characters that are newer than the
oldest Unicode table at hand are cut by the library, whose Unicode version may
differ from ours.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array
from collections.abc import Callable
from functools import lru_cache

import regex

#: Fixed value: the pre-token pattern of byte-level BPE files with use_regex.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_ODD = re.compile(r"\s \s")
#: White space but the space and the line feed.
_RARE_SPACE = tuple(chr(c) for c in range(0x3001) if c not in (0x0A, 0x20) and re.match(r"\s", chr(c)))
_MARKS = frozenset(",.;:!?")
#: Runs longer than this are encoded but not kept in a worker's cache.
KEEP_CHARS = 64


@lru_cache(maxsize=4)
def library(path: str):
    """The tokenizers library's tokenizer, without truncation or padding."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


@lru_cache(maxsize=1)
def _newer() -> re.Pattern:
    """Matches any character without a category in Unicode 3.2."""
    category, ranges = unicodedata.ucd_3_2_0.category, []
    for c in range(0x80, 0x110000):
        if category(chr(c)) == "Cn":
            if ranges and ranges[-1][1] == c - 1:
                ranges[-1][1] = c
            else:
                ranges.append([c, c])
    return re.compile("[" + "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in ranges) + "]")


class PreTokens:
    """Cuts texts for one byte-level BPE file (no normalizer, no prefix space)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            self.file = json.load(f)
        pre = self.file["pre_tokenizer"]
        if (self.file["model"]["type"], self.file["normalizer"], pre["type"], pre["add_prefix_space"], pre["use_regex"]) \
                != ("BPE", None, "ByteLevel", False, True):
            raise ValueError(f"{path}: not a plain byte-level BPE file")
        self.added = {t["content"]: t["id"] for t in self.file["added_tokens"]}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in self.file["added_tokens"]):
            raise ValueError(f"{path}: added tokens that strip or need word ends")
        self._cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") \
            if self.added else None
        self._pattern = regex.compile(PATTERN)
        self._library = library(path)

    def segments(self, text: str) -> list[str]:
        """Added tokens at odd places, the text between them at even ones."""
        return self._cut.split(text) if self._cut else [text]

    def exact(self, segment: str) -> list[str]:
        """All pre-tokens of a segment."""
        if not _plain_latin(segment) and _newer().search(segment):
            return [segment[a:b] for _, (a, b) in self._library.pre_tokenizer.pre_tokenize_str(segment)]
        return self._pattern.findall(segment)

    def pieces(self, run: str, lead: str) -> list[str]:
        """All pre-tokens of ``lead + run``; a run that a space leads has no
        character that needs the library (see ``runs``), so plain words, and
        words with one mark after them, need no pattern."""
        if lead:
            if run.isalpha():
                return [lead + run]
            if run[-1:] in _MARKS and run[:-1].isalpha():
                return [lead + run[:-1], run[-1]]
        return self.exact(lead + run)

    def runs(self, segment: str) -> tuple[list[str], list[str]]:
        """(runs as they stand, runs that a space goes before): together the segment."""
        odd = "  " in segment or "\n " in segment or any(c in segment for c in _RARE_SPACE)
        if odd and _ODD.search(segment) or not _plain_latin(segment) and _newer().search(segment):
            return self.exact(segment), []
        first, *rest = segment.split(" ")
        return [first] if first else [], rest


class CachedCoder:
    """Codes whole texts run by run through a bounded worker cache.

    ``code(runs, lead)`` gives the code of each run after ``lead`` (a space, or
    nothing): bytes of ids, or a count; ``added(id)`` the code of an added token; ``join`` sums up a list of codes.
    ``frequent`` holds codes of frequent space-led runs, which are never
    evicted.  Other codes live in two generations: when the young one holds
    ``limit`` codes it becomes the old one, and an old code that is met again
    moves to the young one; so at most about twice ``limit`` are held.
    """

    def __init__(self, pre: PreTokens, code: Callable, added: Callable, join: Callable,
                 limit: int = 900_000, frequent: dict | None = None):
        self.pre, self.code, self.added, self.join, self.limit = pre, code, added, join, limit
        self.frequent = frequent or {}
        self.plain, self.spaced = {}, dict(self.frequent)
        self.old_plain, self.old_spaced = {}, {}
        self.misses = 0

    def forget(self) -> None:
        """Drop all codes but the frequent ones."""
        self.plain, self.spaced = {}, dict(self.frequent)
        self.old_plain, self.old_spaced = {}, {}

    def _fill(self, cache: dict, old: dict, keys: set, lead: str) -> list[str]:
        missing = keys.difference(cache)
        if old and (again := missing.intersection(old)):
            cache.update((k, old[k]) for k in again)
            missing -= again
        missing = list(missing)
        if missing:
            self.misses += len(missing)
            cache.update(zip(missing, self.code(missing, lead), strict=True))
        return [k for k in missing if len(k) > KEEP_CHARS]

    def texts(self, texts: list[str]) -> list:
        """The joined code of every text."""
        if len(self.plain) + len(self.spaced) > self.limit + len(self.frequent):
            self.old_plain, self.old_spaced = self.plain, self.spaced
            self.plain, self.spaced = {}, dict(self.frequent)
        plans, plain, spaced = [], set(), set()
        for text in texts:
            parts = []
            for i, segment in enumerate(self.pre.segments(text)):
                if i % 2:
                    parts.append((self.pre.added[segment], None))
                elif segment:
                    parts.append(self.pre.runs(segment))
                    plain.update(parts[-1][0])
                    spaced.update(parts[-1][1])
            plans.append(parts)
        long_plain = self._fill(self.plain, self.old_plain, plain, "")
        long_spaced = self._fill(self.spaced, self.old_spaced, spaced, " ")
        at_start, after_space, join, out = self.plain.__getitem__, self.spaced.__getitem__, self.join, []
        for parts in plans:
            codes = []
            for a, b in parts:
                if b is None:
                    codes.append(self.added(a))
                else:
                    codes.append(join(map(at_start, a)))
                    codes.append(join(map(after_space, b)))
            out.append(join(codes))
        for k in long_plain:
            del self.plain[k]
        for k in long_spaced:
            del self.spaced[k]
        return out


class LibraryCodes(dict):
    """Codes of pre-tokens by the tokenizers library's model, kept in a bounded
    cache; ``code`` gives those of whole runs."""

    def __init__(self, path: str, make: Callable, join: Callable, limit: int = 300_000):
        super().__init__()
        self.pre, self.model, self.make, self.join, self.limit = PreTokens(path), library(path).model, make, join, limit
        alphabet = byte_alphabet()
        self.to_file, self.space = str.maketrans(dict(enumerate(alphabet))), alphabet[32]

    def coded(self, piece: str):
        """The code of a pre-token, not kept."""
        word = piece[1:] if piece[0] == " " else piece
        if word.isascii() and word.isalpha():
            spelled = self.space + word if len(word) < len(piece) else word
        else:
            spelled = piece.encode().decode("latin-1").translate(self.to_file)
        return self.make([t.id for t in self.model.tokenize(spelled)])

    def __missing__(self, piece: str):
        code = self.coded(piece)
        if len(piece) <= KEEP_CHARS:
            self[piece] = code
        return code

    def code(self, runs: list[str], lead: str) -> list:
        if len(self) > self.limit:
            self.clear()
        get, cut, join = self.__getitem__, self.pre.pieces, self.join
        return [get(lead + r) if lead and r.isalpha() else join(map(get, cut(r, lead))) for r in runs]


class RunCodes(dict):
    """Codes (bytes of ids) of runs, each made when it is first met.

    ``lead`` is what goes before each run (a space, or nothing).  A run of a word
    and one mark is put together from the word's code.  When ``limit`` codes are
    held they become the old generation, and an old code that is met again moves
    to the young one.
    """

    def __init__(self, pre: PreTokens, pieces: LibraryCodes, lead: str, limit: int):
        super().__init__()
        self.pre, self.pieces, self.lead, self.limit, self.old = pre, pieces, lead, limit, {}

    def __missing__(self, run: str) -> bytes:
        code = self.old.get(run)
        if code is None:
            if self.lead:
                if run.isalpha():
                    code = self.pieces.coded(" " + run)
                elif run[-1:] in _MARKS and run[:-1].isalpha():
                    code = self[run[:-1]] + self.pieces[run[-1]]
            if code is None:
                code = b"".join(map(self.pieces.__getitem__, self.pre.exact(self.lead + run)))
        if len(run) <= KEEP_CHARS:
            self[run] = code
        return code

    def age(self) -> None:
        if len(self) > self.limit:
            self.old = dict(self)
            self.clear()


class RunCoder:
    """Ids of whole texts as bytes, run by run through one bounded cache."""

    def __init__(self, path: str, limit: int = 500_000):
        pieces = LibraryCodes(path, lambda ids: array("I", ids).tobytes(), b"".join)
        self.pre = pieces.pre
        self.plain, self.spaced = RunCodes(self.pre, pieces, "", limit // 10), RunCodes(self.pre, pieces, " ", limit)

    def text(self, text: str) -> bytes:
        at_start, after_space, parts = self.plain.__getitem__, self.spaced.__getitem__, []
        for i, segment in enumerate(self.pre.segments(text)):
            if i % 2:
                parts.append(self.pre.added[segment].to_bytes(4, "little"))
            elif segment:
                plain, spaced = self.pre.runs(segment)
                parts += map(at_start, plain)
                parts += map(after_space, spaced)
        self.plain.age()
        self.spaced.age()
        return b"".join(parts)


def _plain_latin(text: str) -> bool:
    """All characters are Latin-1: old ones, whose classes no version disputes."""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def byte_alphabet() -> list[str]:
    """The character that stands for each byte in byte-level BPE files:
    printable Latin-1 stands for itself, the others follow from U+0100."""
    out, extra = [], 0
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out.append(chr(b))
        else:
            out.append(chr(256 + extra))
            extra += 1
    return out
