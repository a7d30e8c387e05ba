"""Text normalisation shared by the text operators."""

from __future__ import annotations

import re
import unicodedata

_WORD = re.compile(r"[^\W_]+")
#: Characters that NFKD leaves and words do not have: marks and invisible format characters.
_DROP = dict.fromkeys(
    i for i in range(0x110000) if unicodedata.category(chr(i)) in ("Mn", "Mc", "Me", "Cf")
)


def words(text: str) -> list[str]:
    """Maximal runs of letters and digits, in lower case after NFKD, without marks and format characters."""
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text).translate(_DROP)
    return _WORD.findall(text.lower())


def word_spans(text: str) -> list[tuple[int, int]]:
    """First and end position in the text itself of each of its ``words``, with the marks that follow its letters.

    Where one character holds several words (as a fraction sign), each has the place of the whole character.
    """
    if text.isascii():
        return [m.span() for m in _WORD.finditer(text.lower())]
    # marks are all that NFKD reorders, and they are dropped, so characters can be taken one by one
    parts = [unicodedata.normalize("NFKD", c).translate(_DROP) for c in text]
    origin = [i for i, part in enumerate(parts) for _ in part]
    out = []
    for m in _WORD.finditer("".join(parts).lower()):
        end = origin[m.end() - 1] + 1
        while end < len(text) and not parts[end]:
            end += 1
        out.append((origin[m.start()], end))
    return out
