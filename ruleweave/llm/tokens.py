"""Token ids of whole texts by the public tokenizers, with bounded memos of chunks and pieces.

The tokenizers split a text into pieces that never cross certain places. A text is cut there into chunks (about
a word each); a worker remembers the ids of chunks, and of the pieces that new chunks are made of, so
the library's byte-pair model is asked once for each distinct piece. Texts with characters outside a plain
Latin set, or with a special token where these have their own ids, go to the library whole.
"""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache

import regex

#: Distinct chunks that a worker remembers before it starts afresh, about 200 bytes each; half as many pieces.
MEMO = 600_000

#: Texts of these characters only are cut into chunks: line feed, printable ASCII, Latin-1 and Latin
#: Extended-A letters and signs without the soft hyphen, general punctuation, the euro sign.
_PLAIN = re.compile("[\n\x20-\x7e\xa1-\xac\xae-ſ‐-‧€]*")
_BEFORE_WORD = re.compile(r"(?= \S)")

#: The patterns by which the two tokenizers split texts into pieces.
SPACED = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
UNSPACED = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")


#: Marks that often end a word; each is a piece of its own behind letters.
MARKS = tuple(".,;:!?")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself where it prints, else the next
    free one from U+0100 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Memo(dict):
    """Values made once by ``make``; starts afresh when full."""

    def __init__(self, make, most: int = MEMO) -> None:
        self.make, self.most = make, most

    def __missing__(self, key: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        made = self[key] = self.make(key)
        return made


class TextEncoder:
    """bytes of little-endian unsigned 32-bit ids of a text. literal: special tokens in a text are
    encoded as the characters they are written with, else (the library's default) as their own ids."""

    def __init__(self, path: str, literal: bool = True) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = literal
        added = [] if literal else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: finds a special token; pieces and chunks would split it
        self.special = re.compile("|".join(map(re.escape, added))).search if added else None
        #: byte-level pieces keep a space at the start of the next piece; else white space only separates
        self.spaced = self.tokenizer.normalizer is None
        letters, model = _byte_letters(), self.tokenizer.model

        space = letters[32]

        def piece(text: str) -> bytes:
            shown = text.replace(" ", space) if text.isascii() and "\n" not in text else text.encode().decode("latin-1").translate(letters)
            return array("I", [t.id for t in model.tokenize(shown)]).tobytes()

        self.pieces = _Memo(piece, MEMO // 2)
        of_piece = self.pieces.__getitem__
        split = SPACED.findall if self.spaced else UNSPACED.findall

        def chunk(memo: _Memo, text: str, before: str) -> bytes:
            """A chunk of letters is one piece, with a mark behind it two; others are split."""
            if text.isalpha():
                return piece(before + text)
            if text[-1:] in MARKS and text[:-1].isalpha():
                return memo[text[:-1]] + of_piece(text[-1])
            return b"".join(map(of_piece, split(text if text[:1] == "\n" else before + text)))

        if self.spaced:
            self.whole = _Memo(lambda text: b"".join(map(of_piece, split(text))))
            self.after = _Memo(lambda text: chunk(self.after, text, " "))
        else:
            self.whole = _Memo(lambda text: chunk(self.whole, text.lower(), ""))

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if _PLAIN.fullmatch(text) is None or self.special is not None and self.special(text) is not None:
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        if not self.spaced:
            return b"".join(map(self.whole.__getitem__, text.split()))
        if "  " in text or "\n\n" in text or " \n" in text or "\n " in text:
            return b"".join(map(self.whole.__getitem__, _BEFORE_WORD.split(text)))
        first, *rest = text.replace("\n", " \n").split(" ")
        return self.whole[first] * bool(first) + b"".join(map(self.after.__getitem__, rest))


@lru_cache(4)
def encoder(path: str) -> TextEncoder:
    """One encoder per worker process and vocabulary file, with the library's default for special tokens."""
    return TextEncoder(path, literal=False)
