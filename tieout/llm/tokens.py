"""Encoding pieces of text with a public tokenizer, each piece once."""

from __future__ import annotations

import json
import os
import re
import struct
from pathlib import Path

import public_tokenizers

#: Letters up to here have one form and belong to one class in every version of Unicode.
_LAST_LETTER = "ɏ"
#: A line's end, a word of plain letters and ASCII marks: three pieces to a vocabulary that keeps spaces.
_WORD_AND_MARKS = re.compile("(\n?)( ?[A-Za-zªµºÀ-ÖØ-öø-ɏ]+)([!-/:-@\\[-`{-~]*)")


def byte_characters() -> list[str]:
    """The visible character by which byte-level vocabularies write each byte: itself where it has one in
    Latin-1, else the next code point from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b if b in visible else next(hidden)) for b in range(256)]


class PieceIds(dict):
    """Token ids of pieces as little-endian unsigned 32-bit bytes, worked out when first asked for.

    Pieces are texts or their UTF-8 bytes. Of the pieces asked for last, ``limit`` to twice as many are held;
    long ones are not. Pieces that the tokenizer's rules leave whole, words of plain letters, go to its merges
    directly; all others through the whole tokenizer. Words with marks behind them or a line's end before are put
    together from their parts.
    """

    def __init__(self, path: str, limit: int = 100_000, longest: int = 64):
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.model, self.characters = self.tokenizer.model, dict(enumerate(byte_characters()))
        self.limit, self.longest, self.before = limit, longest, {}
        rules = json.loads(Path(path).read_text())
        changes, parts = rules["normalizer"], rules["pre_tokenizer"]
        steps = parts.get("pretokenizers", [parts])
        self.lowers = bool(changes) and [x["type"] for x in changes.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
        self.spaced = changes is None and steps[0].get("use_regex", False) and not steps[0]["add_prefix_space"]
        self.direct = steps[-1]["type"] == "ByteLevel" and (
            (self.spaced and len(steps) == 1)
            or (self.lowers and len(steps) == 2 and "|[\\p{L}]+|" in str(steps[0].get("pattern", {}).get("Regex"))))

    def _whole(self, text: str) -> bool:
        """Whether the piece is one word to the tokenizer, in the form in which it merges it."""
        word = text[1:] if self.spaced and text[:1] == " " else text
        return self.direct and word.isalpha() and max(word) <= _LAST_LETTER and not (self.lowers and word != word.lower())

    def __missing__(self, piece: str | bytes) -> bytes:
        ids = self.before.get(piece)
        if ids is None:
            text = piece.decode() if isinstance(piece, bytes) else piece
            parts = _WORD_AND_MARKS.fullmatch(text) if self.spaced and self.direct else None
            if parts and parts[2] != text:
                return self._keep(piece, b"".join([self[part] for part in parts.groups() if part]))
            if not text:
                numbers = []
            elif parts or self._whole(text):
                line = text if text.isascii() and text[0] != " " else text.encode().decode("latin-1").translate(self.characters)
                numbers = [token.id for token in self.model.tokenize(line)]
            elif self.lowers and text[-1] in ",.;:!?" and self._whole(text[:-1]):
                return self._keep(piece, self[piece[:-1]] + self[piece[-1:]])  # a mark parts from letters
            else:
                numbers = self.tokenizer.encode(text, add_special_tokens=False).ids
            ids = struct.pack(f"<{len(numbers)}I", *numbers)
        return self._keep(piece, ids)

    def _keep(self, piece: str | bytes, ids: bytes) -> bytes:
        if len(piece) <= self.longest:
            if len(self) >= self.limit:
                self.before = dict(self)
                self.clear()
            self[piece] = ids
        return ids


_HELD: dict[str, PieceIds] = {}


def piece_ids(path: str, limit: int = 100_000) -> PieceIds:
    """The pieces of one tokenizer file, kept by a Python worker from task to task; one file's at a time."""
    if path not in _HELD or _HELD[path].limit != limit:
        _HELD.clear()
        _HELD[path] = PieceIds(path, limit)
    return _HELD[path]


def tokenizer_path(name: str) -> str:
    """Where a vocabulary lies: a path as it is, or the name of a public tokenizer file."""
    return name if Path(name).is_absolute() else public_tokenizers.path(name)
