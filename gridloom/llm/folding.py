"""Python counterparts of the look-alike mapping, and folding for comparison."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from gridloom.llm.lookalike import (
    CYRILLIC_AS_GREEK,
    CYRILLIC_AS_LATIN,
    GREEK_AS_CYRILLIC,
    GREEK_AS_LATIN,
    HYPHENS,
    LATIN_AS_CYRILLIC,
    LATIN_AS_GREEK,
    LATIN_AS_LATIN,
    notation_variants,
)

#: Serbian Cyrillic in Latin letters.
SERBIAN_LATIN = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "ђ": "đ", "е": "e", "ж": "ž", "з": "z", "и": "i", "ј": "j",
    "к": "k", "л": "l", "љ": "lj", "м": "m", "н": "n", "њ": "nj", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t",
    "ћ": "ć", "у": "u", "ф": "f", "х": "h", "ц": "c", "ч": "č", "џ": "dž", "ш": "š",
}

_SPACES = re.compile(r"[   -   　]")
_LETTERS = re.compile(r"[^\W\d_]+")
_SERBIAN = str.maketrans(SERBIAN_LATIN | {k.upper(): v.capitalize() for k, v in SERBIAN_LATIN.items()})


def _script(c: str) -> str:
    code = ord(c)
    if code < 0x250 or 0x1E00 <= code < 0x1F00:
        return "Latin" if c.isalpha() else ""
    if 0x370 <= code < 0x400 or 0x1F00 <= code < 0x2000:
        return "Greek"
    if 0x400 <= code < 0x530:
        return "Cyrillic"
    return ""


def _scripts(run: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for c in run:
        if s := _script(c):
            out[s] = out.get(s, 0) + 1
    return out


_TO = {
    "Latin": str.maketrans(CYRILLIC_AS_LATIN | GREEK_AS_LATIN),
    "Cyrillic": str.maketrans(LATIN_AS_CYRILLIC | GREEK_AS_CYRILLIC),
    "Greek": str.maketrans(LATIN_AS_GREEK | CYRILLIC_AS_GREEK),
}


def one_script(run: str, latin_only: bool = False) -> str:
    own = _scripts(run)
    if len(own) < 2 and not (latin_only and own and "Latin" not in own):
        return run
    fits = {s: to for s in _TO if not set(_scripts(to := run.translate(_TO[s]))) - {s}}
    if latin_only and "Latin" in fits:
        return fits["Latin"]
    if len(own) < 2:
        return run
    if "Latin" in fits and "Cyrillic" in fits:
        return fits["Cyrillic" if own.get("Cyrillic", 0) > own.get("Latin", 0) + own.get("Greek", 0) else "Latin"]
    return fits.get("Latin") or fits.get("Cyrillic") or fits.get("Greek") or run


@lru_cache(maxsize=1)
def _notation() -> dict[int, str]:
    single, several = notation_variants()
    return str.maketrans(single | several)


def consistent(text: str, latin_only: bool = False) -> str:
    """The text in consistent form, as the SQL mapping makes it."""
    if text.isascii():
        return text
    out = "".join(c for c in text if unicodedata.category(c) != "Cf" and c not in "͏ᅟᅠ឴឵ㅤﾠ" and not "︀" <= c <= "️")
    out = _SPACES.sub(" ", out)
    for h in HYPHENS:
        out = out.replace(h, "-")
    out = out.translate(_notation()).translate(str.maketrans(LATIN_AS_LATIN))
    out = unicodedata.normalize("NFC", out)
    return _LETTERS.sub(lambda m: one_script(m.group(), latin_only), out)


def latinised(text: str) -> str:
    """Consistent, in Latin letters and lower case, accents kept."""
    return consistent(text).translate(_SERBIAN).lower()


def plain_latin(text: str) -> str:
    """Consistent, in lower-case Latin letters without accents."""
    decomposed = unicodedata.normalize("NFD", latinised(text).replace("đ", "dj"))
    return "".join(c for c in decomposed if unicodedata.category(c) != "Mn")
