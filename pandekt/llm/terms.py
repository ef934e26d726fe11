"""Terms of whole texts as byte strings, split without an object per character."""

from __future__ import annotations

from collections.abc import Iterator

#: A longer text is split in pieces of about this many bytes, so that the list of its words stays small.
PIECE = 1 << 20


def fold_table(digits: bool) -> bytes:
    """Translation that lower-cases A-Z and turns every other ASCII byte outside a term into a blank.

    Bytes of multi-byte characters stay: every character beyond ASCII belongs to a term.
    """
    keep = set(range(97, 123)) | set(range(128, 256)) | (set(range(48, 58)) if digits else set())
    return bytes(b + 32 if 65 <= b <= 90 else b if b in keep else 32 for b in range(256))


LETTERS = fold_table(digits=False)
LETTERS_AND_DIGITS = fold_table(digits=True)


def term_lists(text: bytes, table: bytes) -> Iterator[list[bytes]]:
    """The terms of one text in order, in lists of bounded size."""
    folded = text.translate(table)
    if len(folded) <= PIECE:
        yield folded.split()
        return
    at = 0
    while at < len(folded):
        end = folded.find(b" ", at + PIECE)
        end = len(folded) if end < 0 else end
        yield folded[at:end].split()
        at = end
