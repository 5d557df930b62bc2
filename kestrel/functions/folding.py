"""Compatibility folding of text to ASCII look-alikes, built from Unicode's own data.

The table is made by rule when the module is loaded: compatibility decomposition (full-width,
mathematical, enclosed and ligature forms) without its marks, base letters taken from character names
(stroke, hook, dotless and the like), and romanisation of Cyrillic and Greek by letter name.  Marks and
invisible format characters fold to nothing.  Letters of other scripts are left as they are.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

# FIXED VALUES: romanisation by Unicode letter name.
CYRILLIC = {"A": "a", "BE": "b", "VE": "v", "GHE": "g", "DE": "d", "IE": "e", "IO": "e", "ZHE": "zh", "ZE": "z", "I": "i", "SHORT I": "i",
            "KA": "k", "EL": "l", "EM": "m", "EN": "n", "O": "o", "PE": "p", "ER": "r", "ES": "s", "TE": "t", "U": "u", "EF": "f", "HA": "kh",
            "TSE": "ts", "CHE": "ch", "SHA": "sh", "SHCHA": "shch", "HARD SIGN": "", "YERU": "y", "SOFT SIGN": "", "E": "e", "YU": "iu", "YA": "ia",
            "BYELORUSSIAN-UKRAINIAN I": "i", "YI": "i", "UKRAINIAN IE": "ie", "JE": "j", "LJE": "lj", "NJE": "nj", "DZE": "dz", "DZHE": "dzh",
            "SHORT U": "u", "DJE": "dj", "GJE": "g", "KJE": "k", "TSHE": "ts", "SHHA": "h", "PALOCHKA": "i", "QA": "q", "WE": "w"}
GREEK = {"ALPHA": "a", "BETA": "b", "GAMMA": "g", "DELTA": "d", "EPSILON": "e", "ZETA": "z", "ETA": "e", "THETA": "th", "IOTA": "i", "KAPPA": "k",
         "LAMDA": "l", "MU": "m", "NU": "n", "XI": "x", "OMICRON": "o", "PI": "p", "RHO": "r", "FINAL SIGMA": "s", "SIGMA": "s", "TAU": "t",
         "UPSILON": "u", "PHI": "ph", "CHI": "kh", "PSI": "ps", "OMEGA": "o"}
LATIN = {"SHARP S": "ss", "ETH": "d", "THORN": "th", "DOTLESS I": "i", "DOTLESS J": "j", "LONG S": "s", "KRA": "k", "ENG": "ng", "ALPHA": "a",
         "OPEN E": "e", "OPEN O": "o", "IOTA": "i", "UPSILON": "u", "SCRIPT G": "g", "ESH": "sh", "EZH": "zh"}
SCRIPTS = {"CYRILLIC": CYRILLIC, "GREEK": GREEK, "LATIN": LATIN}

BLOCKS = [(0xA0, 0x250), (0x250, 0x2B0), (0x2B0, 0x370), (0x370, 0x400), (0x400, 0x530), (0x1AB0, 0x1B00), (0x1D00, 0x1DC0), (0x1DC0, 0x1F00),
          (0x2000, 0x20A0), (0x20D0, 0x2190), (0x2460, 0x2500), (0xFB00, 0xFB07), (0xFE00, 0xFE10), (0xFE20, 0xFE30), (0xFEFF, 0xFF00),
          (0xFF01, 0xFFA0), (0x1D400, 0x1D800), (0x1F100, 0x1F190)]


def fold_character(ch: str) -> str | None:
    """ASCII letters, digits or signs that ``ch`` stands for; "" if it is invisible; None if unknown."""
    if ch.isascii():
        return ch
    if unicodedata.category(ch) in ("Mn", "Me", "Cf"):
        return ""
    plain = "".join(c for c in unicodedata.normalize("NFKD", ch) if unicodedata.category(c) not in ("Mn", "Me"))
    if plain != ch:
        parts = [fold_character(c) for c in plain]
        return None if None in parts else "".join(parts).strip()
    name = unicodedata.name(ch, "")
    if unicodedata.category(ch) == "Pd":
        return "--" if name == "EM DASH" else "-"
    if unicodedata.category(ch) in ("Pi", "Pf") or "QUOTATION MARK" in name:
        return '"' if "DOUBLE" in name else "'"
    found = re.fullmatch(r"(LATIN|CYRILLIC|GREEK) (CAPITAL|SMALL|LETTER) ?(?:LETTER |LIGATURE )?(?:SMALL CAPITAL )?(.+?)(?: WITH .*)?", name)
    if not found:
        return None
    script, case, letter = found.groups()
    base = SCRIPTS[script].get(letter)
    if base is None and script == "LATIN" and re.fullmatch(r"[A-Z]{1,2}", letter):
        base = letter.lower()
    if base is None:
        return None
    return base.upper() if case == "CAPITAL" and len(base) == 1 else base.capitalize() if case == "CAPITAL" else base


@lru_cache
def fold_table() -> dict[str, str]:
    """Every non-ASCII character of ``BLOCKS`` that folds, but white space."""
    found = {}
    for lo, hi in BLOCKS:
        for cp in range(lo, hi):
            ch = chr(cp)
            if not ch.isspace() and (folded := fold_character(ch)) is not None and not (len(folded) > 1 and not folded.isalpha() and folded != "--"):
                found[ch] = folded
    return found


def one_to_one() -> tuple[str, str]:
    """Characters for ``translate``: those folding to one character, then those that go."""
    table = fold_table()
    single = [c for c, f in table.items() if len(f) == 1]
    return "".join(single) + "".join(c for c, f in table.items() if not f), "".join(table[c] for c in single)


def one_to_many() -> dict[str, str]:
    """Expansion → the characters that fold to it."""
    out: dict[str, str] = {}
    for c, f in fold_table().items():
        if len(f) > 1:
            out[f] = out.get(f, "") + c
    return out
