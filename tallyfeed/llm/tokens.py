"""Exact token ids through a cache of the pieces that the tokenizer's rule splits texts into.

A text of printable ASCII, Latin letters and white space is split by the
tokenizer's own rule, and only pieces that ``Encoder`` hasn't met go to the
tokenizer's model; their ids are kept (as little-endian unsigned 32-bit bytes), at
most ``limit`` of them, which takes some 60 MB in a worker. Of any other text, or
one that may hold a special token, the white-space separated chunks are taken one by
one (no token spans white space): those of such characters go the same way, others
through the whole tokenizer, and a third of ``limit`` of chunks is kept. Tests hold the
result against the tokenizer on hostile strings. The encoder is kept for the life of a
worker process, since a piece that is new to it costs some twenty times a known one.
"""

from __future__ import annotations

import re

#: str.split() also splits at these, which the tokenizer takes for symbols.
_ODD = re.compile("[\x1c-\x1f]")
#: Characters whose normal form, lower case and class are beyond doubt; what else a text holds than them and white space.
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
_OTHER = re.compile("[^\t-\r -~À-ÖØ-öø-ÿ]")
#: The tokenizer's splitting rule for them; letters first, as no other piece begins with one.
_PIECES = re.compile("[a-zß-öø-ÿ]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^\t-\r a-zß-öø-ÿ0-9]+")


def _byte_characters() -> dict[int, str]:
    """Byte-level alphabet: printable bytes stand for themselves, the rest for code points from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


_BYTES = _byte_characters()
_LETTERS = {c: "".join(_BYTES[b] for b in chr(c).encode()) for c in range(0xC0, 0x100)}


#: Encoders of this process, by file: later tasks of a worker find their caches filled.
_ENCODERS: dict[str, Encoder] = {}


class _Pieces(dict):
    def __init__(self, model, pack, limit: int):
        self.model, self.pack, self.limit = model, pack, limit

    def __missing__(self, piece: str) -> bytes:
        ids = [t.id for t in self.model.tokenize(piece if piece.isascii() else piece.translate(_LETTERS))]
        value = self.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= 64:
            if len(self) >= self.limit:
                self.clear()
            self[piece] = value
        return value


class Encoder(dict):
    def __init__(self, path: str, limit: int = 300_000):
        import struct

        from tokenizers import Tokenizer

        self.tokenizer, self.limit, self.pack = Tokenizer.from_file(path), limit // 3, struct.pack
        self.pieces = _Pieces(self.tokenizer.model, self.pack, limit)

    @staticmethod
    def of(path: str) -> Encoder:
        """The process's encoder for a file."""
        if path not in _ENCODERS:
            _ENCODERS[path] = Encoder(path)
        return _ENCODERS[path]

    def ids(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return self.pack(f"<{len(ids)}I", *ids)

    def __missing__(self, chunk: str) -> bytes:
        if len(chunk) > 64:
            return self.ids(chunk)
        if len(self) >= self.limit:
            self.clear()
        if _PLAIN.fullmatch(chunk) and "<|" not in chunk:
            value = b"".join(map(self.pieces.__getitem__, _PIECES.findall(chunk.lower())))
        else:
            value = self.ids(chunk)
        self[chunk] = value
        return value

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit bytes; none for a null or blank text."""
        if not text:
            return b""
        if not _OTHER.search(text) and "<|" not in text:
            return b"".join(map(self.pieces.__getitem__, _PIECES.findall(text.lower())))
        if _ODD.search(text):
            return self.ids(text)
        return b"".join(map(self.__getitem__, text.split()))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
