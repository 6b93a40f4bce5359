"""Plain form of a text and its look-alike skeleton.

``plain_form`` brings a text to one consistent form: canonical composition, no zero-width characters,
ordinary spaces, ordinary letters and digits for full-width ones, ligatures as their letters, and inside a
word the letter that the word's own alphabet uses in place of a look-alike from another one.

``skeleton`` is coarser: it decomposes, replaces every character by the prototype of its look-alike class
and decomposes again, so two texts that look the same have one skeleton. It serves grouping, not output.

Defined results: null stays null; an empty text stays empty; very long texts are processed whole.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np

# Characters of other alphabets and the Latin letter of the same look.
_CYRILLIC = {
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X",
    "У": "Y", "І": "I", "Ј": "J", "Ѕ": "S", "Ԛ": "Q", "Ԝ": "W", "Ү": "Y", "Ѵ": "V", "Ԍ": "G",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ј": "j", "ѕ": "s", "һ": "h",
    "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ӏ": "l",
}
_GREEK = {
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Υ": "Y", "Χ": "X", "α": "a", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "ϲ": "c", "ϳ": "j",
}
_ARMENIAN = {"օ": "o", "ո": "n", "ս": "u", "հ": "h", "Օ": "O", "Տ": "S", "Լ": "L"}
# Latin letters of other languages that look like a letter of the languages handled here.
_LATIN = {"ð": "đ", "Ð": "Đ", "Ɖ": "Đ", "ɖ": "đ", "ı": "i", "ɑ": "a", "ɡ": "g"}
# Kana of the look of a Han character, replaced in texts that have no other kana.
_KANA = {"ロ": "口", "カ": "力", "エ": "工", "タ": "夕", "ト": "卜", "ハ": "八", "ニ": "二", "ー": "一"}

_ZERO_WIDTH = "­͏؜ᅟᅠ᠋-᠏​-‏‪-‮⁠-⁤⁦-⁯︀-️﻿"
_SPACES = "   -   　"
_LIGATURES = "ĲĳǄ-ǌǱ-ǳﬀ-ﬆﬓ-ﬗ"


def _marks() -> str:
    """The combining signs of the basic plane as the inside of a character class."""
    runs: list[list[int]] = []
    for code in range(0x300, 0x10000):
        if unicodedata.category(chr(code))[0] == "M":
            if runs and runs[-1][1] == code - 1:
                runs[-1][1] = code
            else:
                runs.append([code, code])
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in runs)


MARKS = _marks()
#: An unbroken run of letters, combining signs, digits and underscores.
WORD = re.compile(f"[\\w{MARKS}]+")


def _expand(spec: str) -> str:
    return "".join(chr(c) for c in range(0x10000) if re.match(f"[{spec}]", chr(c)))


_FORM = {ord(c): None for c in _expand(_ZERO_WIDTH)}
_FORM |= {ord(c): " " for c in _expand(_SPACES)}
_SPLIT = {c: unicodedata.normalize("NFKC", c) for c in _expand(_LIGATURES)}
_FORM |= {c: chr(c - 0xFEE0) for a, b in ((0xFF10, 0xFF1A), (0xFF21, 0xFF3B), (0xFF41, 0xFF5B)) for c in range(a, b)}
_FORM |= {c: unicodedata.normalize("NFKC", chr(c)) for c in range(0x2F00, 0x2FD6)}
_TOP = 0x32000  # code points from here on are never changed
#: Letters that may stand for a letter of another alphabet, as the inside of a character class.
_ALIENS = f"Ͱ-֏{''.join(_LATIN)}"


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """By code point: replacement (0: none), whether it is in words, whether it is alien, whether to look closer."""
    change = np.arange(_TOP + 1, dtype=np.uint32)
    for code, to in _FORM.items():
        change[code] = 0 if to is None else ord(to)
    chars = [chr(c) for c in range(_TOP + 1)]
    word = np.fromiter((c.isalnum() or c == "_" for c in chars), bool, _TOP + 1)
    is_mark, is_alien = re.compile(f"[{MARKS}]"), re.compile(f"[{_ALIENS}]")
    word[[i for i, c in enumerate(chars[:0x10000]) if is_mark.match(c)]] = True
    word[_TOP] = False
    alien = np.fromiter((is_alien.match(c) is not None for c in chars), bool, _TOP + 1)
    odd = (change != np.arange(_TOP + 1)) | alien
    for i in range(0x80, 0x10000):
        if not 0xD800 <= i < 0xE000:
            odd[i] |= unicodedata.combining(chars[i]) > 0 or not unicodedata.is_normalized("NFC", chars[i])
    odd[[ord(c) for c in _SPLIT]] = True
    odd[0x1161:0x1200] = True  # parts of Hangul syllables
    odd[[ord(c) for c in _KANA]] = True
    return change, word, alien, odd


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


_TO_LATIN = {ord(k): v for table in (_CYRILLIC, _GREEK, _ARMENIAN, _LATIN) for k, v in table.items()}
_TO_CYRILLIC = {ord(v): k for k, v in reversed(list(_CYRILLIC.items()))}
_TO_GREEK = {ord(v): k for k, v in reversed(list(_GREEK.items()))}
_TO_LATIN_KEYS = frozenset(map(chr, _TO_LATIN))
_KANA_RUN = re.compile("[" + "".join(_KANA) + "]")
_ANY_KANA = re.compile("[ぁ-んァ-ヺ]")
_HAN = re.compile("[一-鿿]")


def _script(char: str) -> str:
    code = ord(char)
    if code < 0x250 or 0x1E00 <= code < 0x1F00:
        return "latin" if char.isalpha() else ""
    if 0x370 <= code < 0x400 or 0x1F00 <= code < 0x2000:
        return "greek"
    if 0x400 <= code < 0x530:
        return "cyrillic"
    if 0x530 <= code < 0x590:
        return "armenian"
    return ""


@lru_cache(maxsize=100_000)
def _word(word: str, around: str) -> str:
    """The word in the letters of its own alphabet; ``around`` is the alphabet of most of the text."""
    apart = unicodedata.normalize("NFD", word)
    sure = {"latin": 0, "greek": 0, "cyrillic": 0, "armenian": 0}
    alike = dict(sure)
    for char in apart:
        if script := _script(char):
            (alike if char in _TO_LATIN_KEYS and script != "latin" else sure)[script] += 1
    # Latin letters always may be of either alphabet; letters without a Latin look-alike decide.
    if sure["cyrillic"]:
        return unicodedata.normalize("NFC", apart.translate(_TO_CYRILLIC)) if sure["latin"] else word
    if sure["greek"]:
        if not sure["latin"]:
            return word
        if sure["greek"] + alike["greek"] > sure["latin"]:
            return unicodedata.normalize("NFC", apart.translate(_TO_GREEK))
    if alike["greek"] and not sure["latin"]:
        # a lone Greek letter is right as it is; a run of look-alikes in a Latin text is a Latin word
        letters = [c for c in apart if _script(c)]
        if len(letters) == 1 or around == "greek":
            return word
    if alike["cyrillic"] and not sure["latin"] and around == "cyrillic":
        return word
    if alike["armenian"] and not sure["latin"]:
        return word
    return unicodedata.normalize("NFC", apart.translate(_TO_LATIN))


def plain_form(text: str | None) -> str | None:
    """The plain form of a text; null stays null."""
    if not text or text.isascii():
        return text
    change, word, alien, odd = tables()
    codes = _codes(text)
    low = np.minimum(codes, _TOP)
    if not odd[low].any():
        return text
    if (changed := change[low] != low).any():
        codes = np.where(changed, change[low], codes)
        text = codes[codes > 0].tobytes().decode("utf-32-le", "surrogatepass")
    for char, letters in _SPLIT.items():
        if char in text:
            text = text.replace(char, letters)
    text = unicodedata.normalize("NFC", text)
    low = np.minimum(_codes(text), _TOP)
    places = np.flatnonzero(alien[low])
    if len(places):
        inside, around, done, parts = word[low], "", 0, []
        for at in places.tolist():
            if at < done:
                continue
            begin, end = at, at + 1
            while begin > done and inside[begin - 1]:
                begin -= 1
            while end < len(low) and inside[end]:
                end += 1
            around = around or _alphabet(low)
            parts += (text[done:begin], _word(text[begin:end], around))
            done = end
        text = "".join(parts) + text[done:]
    return _han(text)


def _alphabet(codes: np.ndarray) -> str:
    """The alphabet of most letters of a text."""
    counts = {
        "latin": int((((codes >= 0x41) & (codes < 0x250)) | ((codes >= 0x1E00) & (codes < 0x1F00))).sum()),
        "greek": int(((codes >= 0x370) & (codes < 0x400)).sum()),
        "cyrillic": int(((codes >= 0x400) & (codes < 0x530)).sum()),
    }
    return max(counts, key=counts.__getitem__)


def _han(text: str) -> str:
    if any(c in text for c in _KANA) and _HAN.search(text) and not _ANY_KANA.search(_KANA_RUN.sub("", text)):
        return text.translate({ord(k): v for k, v in _KANA.items()})
    return text


def differs(text: str | None) -> bool:
    """Whether a text differs from its plain form, letter case aside; false for null."""
    if not text or text.isascii():
        return False
    plain = plain_form(text)
    return plain != text and plain.lower() != text.lower()


_PROTOTYPES = _TO_LATIN | {ord(k): v for k, v in _KANA.items()} | {ord("đ"): "đ", ord("Đ"): "Đ"}
_SKELETON = _FORM | {ord(k): v for k, v in _SPLIT.items()}


@lru_cache(maxsize=1)
def _prototypes() -> dict[int, str]:
    """The look-alike table, and by rule the letters and digits whose compatibility form is one plain letter or digit (styled letters)."""
    out: dict[int, str] = dict(_PROTOTYPES)
    for code in (*range(0x2100, 0x2150), *range(0x1D400, 0x1D800), *range(0xFF00, 0xFFF0)):
        char = chr(code)
        to = unicodedata.normalize("NFKC", char)
        if len(to) == 1 and to != char and char.isalnum() and to.isalnum():
            out[code] = to
    return out


def prototype(text: str) -> str:
    """Decompose, replace every character by its prototype, decompose again; letter case stays."""
    apart = unicodedata.normalize("NFD", text.translate(_SKELETON))
    return unicodedata.normalize("NFD", apart.translate(_prototypes()))


def unlike_prototype(text: str) -> bool:
    """Whether the prototypes change a text beyond its decomposition, or it is not composed as it should be."""
    apart = unicodedata.normalize("NFD", text)
    return prototype(text) != apart or unicodedata.normalize("NFC", text) != text


def skeleton(text: str | None) -> str | None:
    """The look-alike skeleton: the prototypes without letter case."""
    if text is None:
        return None
    if text.isascii():
        return text.casefold()
    return unicodedata.normalize("NFD", prototype(text).casefold())
