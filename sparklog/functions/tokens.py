"""Word matching on message text: terms, phrases, prefixes, NEAR, and their combinations.

Words are runs of letters, digits and private-use characters, compared without case and
without Latin accents. A word, a phrase or a prefix is one regular expression over the whole
message; its first letter comes first, so a scan rejects most positions on one character.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"\p{L}\p{N}\p{Co}"
SEPARATORS = f"[^{WORD}]+"
MARKS = "\u0300-\u036f"

# Lower-case Latin letters made of one base letter and one mark, found by rule, and the
# combining marks themselves, which translate() deletes because they have no counterpart.
_ACCENTED = [
    char
    for char in map(chr, range(0x80, 0x2000))
    if char == char.lower()
    and unicodedata.name(char, "").startswith("LATIN")
    and len(unicodedata.normalize("NFD", char)) == 2
]
_MARKS = [chr(code) for code in range(0x300, 0x370)]
_FROM = "".join(_ACCENTED + _MARKS)
_TO = "".join(unicodedata.normalize("NFD", char)[0] for char in _ACCENTED)
_FOLDING = str.maketrans(_FROM[: len(_TO)], _TO, "".join(_MARKS))


def _spellings() -> dict[str, str]:
    """Folded character -> every character that folds to it."""
    found: dict[str, list[str]] = {}
    for char in map(chr, range(0x80, 0x3000)):
        folded = char.lower().translate(_FOLDING)
        if len(folded) == 1 and folded != char:
            found.setdefault(folded, []).append(char)
    return {folded: "".join(chars) for folded, chars in found.items()}


_SPELLINGS = _spellings()


def _words(text: str) -> list[str]:
    """The same folding for a search argument."""
    folded = text.lower().translate(_FOLDING)
    kept = [c if unicodedata.category(c)[0] in "LN" or unicodedata.category(c) == "Co" else " " for c in folded]
    found = "".join(kept).split()
    if not found:
        raise ValueError(f"{text!r} holds no word to search for")
    return found


def _folded(message: Column, separate: Callable[[Column, str], Column]) -> Column:
    """``separate`` on folded text. Plain ASCII takes the short way, with the same outcome."""
    lowered = F.lower(message)
    ascii_only = F.octet_length(message) == F.length(message)
    return F.when(ascii_only, separate(lowered, "[^a-z0-9]+")).otherwise(
        separate(F.translate(lowered, _FROM, _TO), SEPARATORS)
    )


def tokens(message: Column) -> Column:
    """Message as an array of folded words, in order."""
    return F.array_remove(_folded(message, F.split), "")


class Match:
    """A test on a message. Combine with ``&``, ``|`` and ``~``; turn into a Column with ``on``.

    ``form`` says the same to an index: ("words", words, whole), ("near", phrases, distance),
    ("and", a, b), ("or", a, b) or ("not", a).
    """

    def __init__(self, test: Callable[[Column], Column], form: tuple):
        self.on, self.form = test, form

    def __repr__(self) -> str:
        return f"Match{self.form!r}"

    def __and__(self, other: Match) -> Match:
        return Match(lambda message: self.on(message) & other.on(message), ("and", self, other))

    def __or__(self, other: Match) -> Match:
        return Match(lambda message: self.on(message) | other.on(message), ("or", self, other))

    def __invert__(self) -> Match:
        return Match(lambda message: ~self.on(message), ("not", self))


def _letter(char: str) -> str:
    """Character class of every spelling; the rare ones stand behind one not-ASCII test."""
    upper = char.upper() if len(char.upper()) == 1 else ""
    common = "".join(dict.fromkeys(char + upper))
    rare = "".join(c for c in _SPELLINGS.get(char, "") if c not in common)
    return f"[{common}[[^\\x00-\\x7F]&&[{rare}]]]" if rare else f"[{common}]"


def _pattern(words: list[str], whole: bool) -> str:
    """The words in order with only separators between, starting and (if whole) ending a word."""
    spelled = [f"[{MARKS}]*+".join(_letter(c) for c in word) for word in words]
    # Not inside a longer word: marks may come before it, and before them the start or a separator.
    start = f"(?:^|[^{WORD}{MARKS}])[{MARKS}]*+"
    body = start + f"[{MARKS}]*+[^{WORD}]++".join(spelled)
    end = f"[{MARKS}]*+(?![{WORD}])" if whole else ""
    return body + end


def phrase(text: str) -> Match:
    """The words of ``text`` next to each other, in order. One word is a plain term."""
    words = _words(text)
    pattern = _pattern(words, whole=True)
    return Match(lambda message: message.rlike(pattern), ("words", words, True))


term = phrase


def prefix(text: str) -> Match:
    """As a phrase, but the last word may go on."""
    words = _words(text)
    pattern = _pattern(words, whole=False)
    return Match(lambda message: message.rlike(pattern), ("words", words, False))


def _opens_at(array: Column, opening: list[str], others: list[list[str]], distance: int):
    """Spot -> does ``opening`` stand there with every other phrase starting close enough after it."""

    def test(spot: Column) -> Column:
        hit = F.lit(True)
        for i, word in enumerate(opening):
            hit = hit & (F.get(array, spot - 1 + i) == word)
        for other in others:
            span = len(opening) + distance + len(other)
            window = F.array_join(F.slice(array, spot, F.lit(span)), " ")
            hit = hit & F.concat(F.lit(" "), window, F.lit(" ")).contains(f" {' '.join(other)} ")
        return F.coalesce(hit, F.lit(False))

    return test


def near(*phrases: str, distance: int = 10) -> Match:
    """All phrases, at most ``distance`` words from the end of the first to the start of the last."""
    parts = [_words(p) for p in phrases]

    def anywhere(array: Column) -> Column:
        found = F.lit(False)
        for i, opening in enumerate(parts):
            others = parts[:i] + parts[i + 1 :]
            spots = F.sequence(F.lit(1), F.size(array))
            found = found | F.exists(spots, _opens_at(array, opening, others, distance))
        return found

    def test(message: Column) -> Column:
        every = F.lit(True)
        for words in parts:
            every = every & message.rlike(_pattern(words, whole=True))
        # The positional test runs only where every phrase occurs, so the array is not empty.
        return F.when(every, F.exists(F.array(tokens(message)), anywhere)).otherwise(F.lit(False))

    return Match(test, ("near", parts, distance))


def check_word(text: str) -> str:
    """The single folded word of ``text``; an index lookup takes one word at a time."""
    words = _words(text)
    if len(words) != 1:
        raise ValueError(f"{text!r} is {len(words)} words; give them one by one")
    return words[0]
