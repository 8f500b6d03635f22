"""Token ids of whole texts by a tokenizer file, with a memory of words.

The two tokenizers used here split a text into pretokens before they merge
bytes, and no pretoken joins a word to the white space after it.  A plain text
is therefore cut at its spaces, each distinct piece is split by the
tokenizer's own pattern and encoded once by the tokenizer's model, and the ids
are remembered; punctuation after a word of letters is no part of its pretoken,
so the word alone is encoded.  Texts outside the plain case (letters beyond Latin, other
white space, runs of spaces, strings of special tokens) are encoded as a
whole.  Either way the ids are those of ``encode`` on the whole text.
"""

from __future__ import annotations

import codecs
import gc
import os
import re
import string
from array import array
from collections.abc import Iterable

import numpy as np
import regex

from termscan.llm import texts

# Most remembered pieces and pretokens of a process.  After half as many new ones
# those not met since the last such time are forgotten.
REMEMBERED = 800_000

# Beyond Latin letters, normal forms and letter classes would matter.
_BEYOND_LATIN = re.compile("[^\x00-\u024f]")
_UNUSUAL = ("\x00", "\x1c", "\x1d", "\x1e", "\x1f", "\x85", "\xa0", "\u0130", "<|")
_UNEVEN = ("  ", " \n", "\n ", "\n\n", "\t", "\v", "\f", "\r")


def _plain(text: str, words: bool) -> bool:
    """Whether a text may be cut at its spaces and line ends."""
    if any([odd in text for odd in _UNUSUAL]):
        return False
    if not words and (any([odd in text for odd in _UNEVEN]) or text[0] in " \n" or text[-1] in " \n"):
        return False
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
        return True
    except UnicodeEncodeError:
        return not _BEYOND_LATIN.search(text)


# The split patterns of the two tokenizer files.
BYTE_PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
WORD_PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")

_encoders: dict[tuple[str, bool], Encoder] = {}


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> str:
    """Byte-level models write each byte as a visible letter."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {b: chr(b) for b in visible}
    for b in range(256):
        table.setdefault(b, chr(256 + len(table) - len(visible)))
    return "".join([table[b] for b in range(256)])


def narrowed(ids: bytes, width: int) -> bytes:
    """Ids of four bytes each in ``width`` bytes each."""
    return ids if width == 4 else np.frombuffer(ids, "<u4").astype(f"<u{width}").tobytes()


def widened(ids: bytes, width: int) -> bytes:
    """The inverse of ``narrowed``."""
    return ids if width == 4 else np.frombuffer(ids, f"<u{width}").astype("<u4").tobytes()


class Encoder:
    """``encode(texts)`` gives the ids of each as little-endian unsigned 32-bit bytes.

    ``words``: the tokenizer lowers case and drops white space; otherwise a
    space belongs to the word after it.
    """

    def __init__(self, path: str, words: bool) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.words = words
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4  # bytes that hold any id
        self.letters = _byte_letters()
        self.pieces: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}  # pieces met before the last time half was forgotten
        self.pretokens: dict[str, bytes] = {}
        texts.memories += [self.pieces, self.older, self.pretokens]

    def _pretoken(self, text: str) -> bytes:
        written = codecs.charmap_decode(text.encode(), "strict", self.letters)[0]
        return array("I", [token.id for token in self.model.tokenize(written)]).tobytes()

    def _known_pretoken(self, text: str) -> bytes:
        ids = self.pretokens.get(text)
        if ids is None:
            ids = self.pretokens[text] = self._pretoken(text)
        return ids

    def _piece(self, piece: str) -> bytes:
        """Ids of a piece; one that starts with a null character begins its text."""
        if piece.isalpha():  # one pretoken, and as a piece remembered already
            return self._pretoken(piece if self.words else " " + piece)
        word = piece.rstrip(string.punctuation)
        if word.isalpha():  # what follows it is one pretoken
            return self._known(word) + self._known_pretoken(piece[len(word) :])
        if self.words:
            found = WORD_PATTERN.findall(piece)
        else:
            if piece[0] == "\x00":
                piece = piece[1:]
            elif piece[0] != "\n":
                piece = " " + piece
            found = BYTE_PATTERN.findall(piece)
        return b"".join([self._known_pretoken(pretoken) for pretoken in found])

    def _known(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            ids = self.older.get(piece)
            if ids is None:
                ids = self._piece(piece)
            self.pieces[piece] = ids
        return ids

    def _cut(self, text: str) -> list[str]:
        if self.words:
            return text.lower().split()
        pieces = text.replace("\n", " \n").split(" ")
        pieces[0] = "\x00" + pieces[0]
        return pieces

    def _remember(self, pieces: list[str], found: list[bytes | None]) -> None:
        """Fill in the ids that were not found."""
        if len(self.pieces) + len(self.pretokens) > REMEMBERED // 2:
            self.older.clear()
            self.pretokens.clear()
            self.pieces, self.older = self.older, self.pieces
        collecting = gc.isenabled()
        gc.disable()  # nothing here is cyclic; the collector would take half of the time
        for at, ids in enumerate(found):
            if ids is None:
                found[at] = self._known(pieces[at])
        if collecting:
            gc.enable()

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        out = []
        for text in texts:
            if not text:
                out.append(b"")
            elif not _plain(text, self.words):
                found = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0]
                out.append(np.array(found.ids, "<u4").tobytes())
            else:
                pieces = self._cut(text)
                ids = [*map(self.pieces.get, pieces)]
                if None in ids:
                    self._remember(pieces, ids)
                out.append(b"".join(ids))
        return out


def encoder(path: str, words: bool) -> Encoder:
    """The encoder of this process, made once."""
    key = (path, words)
    if key not in _encoders:
        _encoders[key] = Encoder(path, words)
    return _encoders[key]
