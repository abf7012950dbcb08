"""The spoken text inside subtitle files, with every character left where it is.

`spoken` gives a text of the same length in which everything that isn't speech (headers, cue numbers, times, markup,
speaker names, sound descriptions, adverts) is blanked with NUL, cue borders are marked CUE and a dash that opens a
speaker's turn is marked TURN, so positions in it are positions in the file.
"""

from __future__ import annotations

import re
from collections.abc import Collection

NUL, CUE, TURN = "\x00", "\x1e", "\x1d"
_TIME = re.compile(r"(?:(?<=[\n\r])|^)[﻿ \t]*(?:\d+[ \t]*(?:\r\n|\n|\r)[ \t]*)?\d+:\d\d(?::\d\d)?[.,]\d+[ \t]*[-=]+>[ \t]*\d+:\d\d(?::\d\d)?[.,]\d+[^\r\n]*")
_MARKUP = re.compile(r"</?[A-Za-z][^<>\r\n]*>|\{\\[^{}\r\n]*\}")
_SOUND = re.compile(r"\[[^\[\]\r\n]*\]|\{[^{}\r\n]*\}|＜[^＜＞\r\n]*＞|（[^（）\r\n]*）|\*[^*\r\n]+\*|\([^()\r\n]*[.!?…]\)|\((?=[A-Z])[A-Z' ]+\)")
_SONG = re.compile(r"[♪♫][^♪♫\r\n]*[♪♫]|[♪♫]")
_LEADING = re.compile(r"(?m)^([\x00\x1e \t]*(?:[-–—][ \t]*)?(?:[A-Z][A-Z0-9 #.'-]*:[ \t]*)?)(\([^()\r\n]*\))")
_SPEAKER = re.compile(r"(?m)^([\x00\x1e \t]*(?:[-–—][\x00 \t]*)?)((?:[^\W\d_a-z][A-Z0-9 #.'’-]*[A-Z0-9]):)(?=[ \t\x00])")
_DASH = re.compile(r"(?m)^[\x00\x1e \t]*(?:([-–])|(—)(?=[\x00 \t]*[^\W\d_a-zа-яё]))")
_ADDRESS = re.compile(r"https?://|www\.|[\w.-]+@[\w-]+\.\w+")
#: A name that ends in figures, or words joined by a point: an advert only together with a word that adverts use.
_HANDLE = re.compile(r"\b[a-z]{2,}\d+\b|\b[a-z0-9-]+\.[a-z]{3,}\b")
_WORDS = re.compile("[a-z]{4,}")
#: What every address or handle holds; found faster.
_MAYBE = re.compile(r"[a-z](?:\d|\.[a-z])|://|www\.|@|\d\.[a-z]|-\.[a-z]")
_SINGLE = {c: bytes([c]).decode("cp1252", "replace") for c in range(256)}
_BACK = {ch: c for c, ch in _SINGLE.items() if ch != "�"} | {chr(c): c for c in range(160)}
_REST = "".join(re.escape(ch) for ch, b in _BACK.items() if 0x80 <= b < 0xC0)
_SEQUENCE = re.compile(f"[Â-ß][{_REST}]|[à-ï][{_REST}]{{2}}|[ð-ô][{_REST}]{{3}}")
_PAIR = re.compile(f"[Â-ô][{_REST}]")  # what every such sequence begins with; found faster
_HIGH = re.compile("[\u0080-ÿŒœŠšŸŽžƒˆ˜–-›€™]")
_HIGH_LETTER = re.compile("[À-ÖØ-öø-ÿ]")
_LETTER = re.compile(r"[^\W\d_]")


def reread(text: str) -> tuple[str, list[int]] | None:
    """A text that was decoded with a wrong encoding, read rightly, and the end of each of its characters in `text`; None if it wasn't.

    Known cases: UTF-8 read as a Western one-byte encoding, and Cyrillic or Greek one-byte text read as that; what
    doesn't fit (put in later) stays as it is.
    """
    if text.isascii():
        return None
    found = list(_SEQUENCE.finditer(text)) if _PAIR.search(text) else []
    high = len(_HIGH.findall(text)) if found else 0
    whole = sum(m.end() - m.start() for m in found)
    sure = whole >= 0.8 * high if len(found) >= 3 else whole == high and all(m[0][0] in "ÂÃâ" and "\xa0" not in m[0][1:] for m in found)
    if found and sure:
        out, ends, at = [], [], 0
        for m in found:
            out.append(text[at : m.start()])
            ends += range(at + 1, m.start() + 1)
            at = m.end()
            raw = bytes(_BACK[ch] for ch in m[0])
            try:
                out.append(raw.decode("utf-8"))
                ends.append(at)
            except UnicodeDecodeError:
                out.append(m[0])
                ends += range(m.start() + 1, at + 1)
        out.append(text[at:])
        ends += range(at + 1, len(text) + 1)
        again = reread("".join(out))  # some were misread twice
        return (again[0], [ends[e - 1] for e in again[1]]) if again else ("".join(out), ends)
    high = len(_HIGH_LETTER.findall(text))
    if high > 0.1 * len(text) and high > 0.5 * len(_LETTER.findall(text)):
        raw = bytes(_BACK.get(ch, 0x20) for ch in text)
        try:
            right = raw.decode("cp1253")
        except UnicodeDecodeError:  # it has no letter where Cyrillic has two common ones
            right = raw.decode("cp1251", "replace")
        return "".join(r if ch in _BACK else ch for r, ch in zip(right, text)), list(range(1, len(text) + 1))
    return None


def _blank(m: re.Match) -> str:
    return NUL * len(m[0])


def advertises(cue: str, words: Collection[str]) -> bool:
    """Whether a cue is an advert: it holds an address, or a handle and one of `words`, which training finds."""
    return bool(_ADDRESS.search(cue)) or (bool(_HANDLE.search(cue)) and any(w in words for w in _WORDS.findall(cue.lower())))


def suspects(s: str) -> list[tuple[bool, set[str]]]:
    """For each cue with a word: whether it holds an address or a handle, and its longer words."""
    return [(bool(_ADDRESS.search(c) or _HANDLE.search(c)), w) for c in s.split(CUE) if (w := set(_WORDS.findall(c.lower())))]


def cued(text: str) -> str:
    """The text with cue borders marked, and times, numbers, headers and markup blanked."""
    s, n = _TIME.subn(lambda m: CUE + NUL * (len(m[0]) - 1), text)
    if n:
        head = s.index(CUE)
        s = NUL * head + s[head:]
    else:
        s = re.sub(r"^\ufeff?WEBVTT[^\r\n]*", _blank, s)
    if "<" in s or "{" in s:
        s = _MARKUP.sub(_blank, s)
    return s


def spoken(text: str, advert_words: Collection[str] = ()) -> tuple[str, list[int]]:
    """The speech in place, and the end of each advert cue."""
    s = cued(text)
    ads: list[int] = []
    if _MAYBE.search(s):
        cues = s.split(CUE)
        at = 0
        for k, cue in enumerate(cues):
            if _MAYBE.search(cue) and advertises(cue, advert_words):
                ads.append(at + len(cue.rstrip("\x00 \t\r\n\u3000")))
                cues[k] = re.sub(r"[^\r\n]", NUL, cue)
            at += len(cue) + 1
        s = CUE.join(cues)
    if any(k in s for k in "[{(*＜（"):
        s = _SOUND.sub(_blank, s)
    if "♪" in s or "♫" in s:
        s = _SONG.sub(_blank, s)
    if "(" in s:
        s = _LEADING.sub(lambda m: m[1] + NUL * len(m[2]), s)
    if ":" in s:
        s = _SPEAKER.sub(lambda m: m[1] + NUL * len(m[2]), s)
    if "-" in s or "–" in s or "—" in s:
        s = _DASH.sub(lambda m: m[0][:-1] + TURN, s)
    return s, ads
