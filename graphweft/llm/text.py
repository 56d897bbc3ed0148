"""Folding of text to what a reader would call the same words."""

from __future__ import annotations

import html
import re
import unicodedata

# Letters of other scripts that look like Latin ones.
LOOKALIKES = str.maketrans("аеорсухіѕјԁһкмтвн", "aeopcyxisjdhkmtbh")
CJK = "぀-ヿ㐀-鿿豈-﫿"
WORD = re.compile(rf"[^\W_{CJK}]+|[{CJK}]")
LATIN = re.compile(r"[a-z]")
MARKUP = re.compile(r"</?[a-zA-Z][a-zA-Z0-9]*(?:\s[^<>]*)?/?>")
APOSTROPHE = re.compile(r"(?<=\w)['’ʼ`´](?=\w)")


def fold(text: str | None) -> str:
    """Lower case without accents, invisible marks and apostrophes inside words."""
    if not text:
        return ""
    if text.isascii():
        return APOSTROPHE.sub("", text.lower())
    out = unicodedata.normalize("NFKD", text.casefold())
    out = "".join(ch for ch in out if ch.isascii() or unicodedata.category(ch) not in ("Mn", "Cf", "Me"))
    return APOSTROPHE.sub("", out.casefold())


def words(text: str | None) -> list[str]:
    """The folded words; a character of a script without spaces is a word of its own.  Look-alike letters are Latin ones in a
    word that has Latin letters."""
    found = WORD.findall(fold(text))
    return [w if w.isascii() or not LATIN.search(w) else w.translate(LOOKALIKES) for w in found]


def bare_words(text: str | None) -> list[str]:
    """``words`` without markup: tags dropped, character references resolved."""
    if not text:
        return []
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = MARKUP.sub("", text)
    return words(text)
