"""How byte-level vocabularies write the bytes of their entries as characters."""

from __future__ import annotations


def byte_of_character() -> dict[str, int]:
    """Printable Latin-1 characters stand for themselves, characters from U+0100 on for the other bytes in order."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    found = {chr(b): b for b in shown}
    return found | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(shown)))}


#: For str.translate of bytes that were decoded as Latin-1.
CHARACTER_OF_BYTE = {b: char for char, b in byte_of_character().items()}
