"""Byte-pair encoding with a bounded cache of text pieces.

The byte-level pre-tokenizer attaches one space to the word after it and never
lets a piece run over a space or line end that is followed by a visible
character. Text may therefore be cut before such a character without changing
one id; the cut pieces repeat often and are encoded once. Ids always come from
the ``tokenizers`` library.
"""

from __future__ import annotations

import os
import re
from array import array

# A worker process encodes alone: one thread per task.
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
os.environ.setdefault("RAYON_NUM_THREADS", "1")

CUT = re.compile(r"(?=[ \n]\S)")
SEGMENT = 1 << 20
#: Pieces a generation of the cache holds, about 0.2 kB each. Fewer save memory and cost encoding time.
CACHE_ENTRIES = 500_000
MAX_KEY = 64
#: ASCII marks, the letter that spells a space, and the last letter of the Latin blocks whose letters are settled.
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
SPACE = "\u0120"
LAST_LATIN = "\u024f"


def default_path() -> str:
    """The public byte-level vocabulary, wherever it is installed."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _segments(text: str):
    """Cut very long texts at safe places, so that memory follows the segment."""
    start = 0
    while len(text) - start > SEGMENT:
        m = CUT.search(text, start + SEGMENT)
        if not m or m.start() >= len(text):
            break
        yield text[start:m.start()]
        start = m.start()
    yield text[start:] if start else text


def pieces(text: str) -> list[str]:
    """Cache keys of the pieces of a text, in order.

    A key is the piece itself, with two exceptions that save copying: the space
    before a word is left out, and a piece that has none before it (the first
    of a text) is marked by a leading zero character.
    """
    words = text.count(" ") + text.count("\n") + 1
    if len(text.split()) == words and "\0" not in text:
        keys = text.replace("\n", " \n").split(" ")
        # Single separators only: every key is visible or a line end before something visible.
        if "" not in keys and "\n" not in keys and text[0] != "\n":
            keys[0] = "\0" + keys[0]
            return keys
    return [x[1:] if x[0] == " " and x[1:2] not in ("", "\0", "\n") else x if x[0] == "\n" else "\0" + x for x in CUT.split(text) if x]


def _content(key: str) -> str:
    return key[1:] if key[0] == "\0" else key if key[0] == "\n" else " " + key


def _byte_letters() -> dict[int, int]:
    """Letters by which a byte-level vocabulary spells the bytes: visible ones stand for themselves, others follow from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(256, 512))
    return {b: b if b in shown else next(hidden) for b in range(256)}


class _Pieces(dict):
    """Encoded pieces; an unknown one is made when it is asked for, and kept unless it is long."""

    def __init__(self, make) -> None:
        self.make = make

    def __missing__(self, key: str) -> bytes:
        ids = self.make(key)
        if len(key) <= MAX_KEY:
            self[key] = ids
        return ids


class PieceEncoder:
    """ids of whole texts as little-endian unsigned 32-bit bytes.

    A word of Latin letters is one unit of the pre-tokenizer, and marks after it
    are another, so both go to the model directly; any other piece passes
    through the whole tokenizer. The cache keeps two generations of at most
    ``max_entries`` short keys each, so memory doesn't follow the number of
    distinct words.
    """

    def __init__(self, path: str, max_entries: int = CACHE_ENTRIES) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        self.max_entries = max_entries
        self.letters = _byte_letters()
        # Words go around the pre-tokenizer only where it is the known one and no added token can lie in them.
        pre, added = self.tokenizer.pre_tokenizer, list(self.tokenizer.get_added_tokens_decoder().values())
        cores = [t.content.rstrip(MARKS) for t in added]
        # Added tokens are taken out before the pre-tokenizer sees the text, so blanks before one end their text.
        self.added_texts = sorted((t.content for t in added), key=len, reverse=True)
        self.added = re.compile("(" + "|".join(map(re.escape, self.added_texts)) + ")")
        self.direct = (isinstance(pre, pre_tokenizers.ByteLevel) and pre.use_regex and not pre.add_prefix_space
                       and self.tokenizer.normalizer is None and not any(x == "" or x.isalpha() for x in cores))
        self.known = _Pieces(self._piece)
        self.older: dict[str, bytes] = {}
        self.line_end = self._whole("\n")

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _piece(self, key: str) -> bytes:
        ids = self.older.get(key)
        if ids is not None:
            return ids
        spaced = key[0] not in "\0\n"
        body = key if spaced else key[1:]
        stem = body.rstrip(MARKS)
        if not self.direct or not stem.isalpha() or not (stem.isascii() or max(stem) <= LAST_LATIN):
            return self._whole(_content(key))
        if len(stem) < len(body):
            ids = self.known[stem if spaced else "\0" + stem] + self.known["\0" + body[len(stem):]]
        else:
            spelt = stem if stem.isascii() else stem.encode().decode("latin-1").translate(self.letters)
            ids = array("I", [t.id for t in self.tokenize(SPACE + spelt if spaced else spelt)]).tobytes()
        return self.line_end + ids if key[0] == "\n" else ids

    def encode(self, text: str) -> bytes:
        out = []
        parts = self.added.split(text) if any(x in text for x in self.added_texts) else (text,)
        for k, part in enumerate(parts):
            if k % 2:
                out.append(self._whole(part))
                continue
            for segment in _segments(part) if len(part) > SEGMENT else (part,) if part else ():
                out.append(b"".join(map(self.known.__getitem__, pieces(segment))))
                if len(self.known) > self.max_entries:
                    self.older, self.known = dict(self.known), _Pieces(self._piece)
        return out[0] if len(out) == 1 else b"".join(out)

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """ids of every text."""
        return [self.encode(text) for text in texts]


_encoders: dict[tuple[str, int], PieceEncoder] = {}


def encoder(path: str, cache_entries: int = CACHE_ENTRIES) -> PieceEncoder:
    """One encoder per worker process, vocabulary and cache size."""
    key = (path, cache_entries)
    if key not in _encoders:
        _encoders[key] = PieceEncoder(path, cache_entries)
    return _encoders[key]
