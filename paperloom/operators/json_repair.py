"""Broken JSON read as it was meant: a recovering reader for answers of models.

It forgives text and fences around the value, single and curly quotes, bare keys and words, missing and doubled commas,
comments, Python's literals, quotes within strings, wrong or missing closing brackets, and an end that was cut off. What
it can't tell, like a key without a value in the middle, it refuses.
"""

from __future__ import annotations

import json
import re

_QUOTES = {'"': '"', "'": "'", "“": "”", "‘": "’"}
_WORDS = {"true": True, "false": False, "null": None, "none": None, "undefined": None}
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}
_SKIP = re.compile(r"(?:\s+|//[^\n]*|/\*.*?(?:\*/|\Z)|#[^\n]*)+", re.S)
_NUMBER = re.compile(r"[-+]?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?")
_KEY = re.compile(r"[A-Za-z_$][\w$ .-]*?(?=\s*:)")
_BARE = re.compile(r"[^\s,:{}\[\]\"'][^,{}\[\]\n\"]*")
#: A comment behind a bare word.
_NOTE = re.compile(r"\s(?=//|/\*|#)")
#: After the quote that ends a string stands a separator, the end, or another key or item.
_AFTER = re.compile(r"\s*(?:[,:}\]]|//|/\*|\Z|\n\s*[\"'{\[\w]|[\"'][^\"'\n]{1,80}[\"']\s*:)")
_DEEPEST = 100


class _Reader:
    def __init__(self, text: str, at: int):
        self.text, self.at = text, at

    def skip(self) -> str:
        """The next character that says something, '' at the end."""
        blank = _SKIP.match(self.text, self.at)
        self.at = blank.end() if blank else self.at
        return self.text[self.at : self.at + 1]

    def value(self, depth: int = 0) -> object:
        c = self.skip()
        if depth > _DEEPEST:
            raise ValueError("too deep")
        if c in ("{", "["):
            self.at += 1
            return self.object_(depth) if c == "{" else self.array(depth)
        if c in _QUOTES and c:
            return self.string(_QUOTES[c])
        bare = _BARE.match(self.text, self.at)
        if not bare:
            raise ValueError("no value")
        word = _NOTE.split(bare[0])[0]
        self.at += len(word)
        word = word.strip()
        if word.lower() in _WORDS:
            return _WORDS[word.lower()]
        if _NUMBER.fullmatch(word):
            return json.loads(word.lstrip("+"))
        return word

    def string(self, end: str, is_key: bool = False) -> str:
        out, i = [], self.at + 1
        while i < len(self.text):
            c = self.text[i]
            if c == "\\" and i + 1 < len(self.text):
                code = re.compile(r"u([0-9a-fA-F]{4})").match(self.text, i + 1)
                out.append(chr(int(code[1], 16)) if code else _ESCAPES.get(self.text[i + 1], self.text[i + 1]))
                i += 6 if code else 2
                continue
            if c == end and (is_key or _AFTER.match(self.text, i + 1)):
                self.at = i + 1
                break
            out.append(c)
            i += 1
        else:
            self.at = len(self.text)
        # halves of surrogate pairs, written one by one, belong together
        return "".join(out).encode("utf-16", "surrogatepass").decode("utf-16", "replace")

    def object_(self, depth: int) -> dict:
        out = {}
        while (c := self.skip()) not in ("", "]"):
            if c == "}":
                self.at += 1
                break
            if c in ",;":
                self.at += 1
                continue
            if c in _QUOTES:
                key = self.string(_QUOTES[c], is_key=True)
            else:
                bare = _KEY.match(self.text, self.at)
                if not bare:
                    raise ValueError("no key")
                key, self.at = bare[0], bare.end()
            if (c := self.skip()) != ":":
                if c:
                    raise ValueError("a key without a value")
                break
            self.at += 1
            if (c := self.skip()) in ("", ",", "}"):
                if c:
                    out[key] = None
                continue
            out[key] = self.value(depth + 1)
        return out

    def array(self, depth: int) -> list:
        out = []
        while (c := self.skip()) not in ("", "}"):
            if c == "]":
                self.at += 1
                break
            if c in ",;":
                self.at += 1
                continue
            out.append(self.value(depth + 1))
        return out


def tolerant_json(text: str) -> str | None:
    """The first object or array of a broken text as JSON; null where there is none, or where it can't be told."""
    begin = min((i for i in (text.find("{"), text.find("[")) if i >= 0), default=-1)
    if begin < 0:
        return None
    try:
        return json.dumps(_Reader(text, begin).value(), ensure_ascii=False)
    except (ValueError, RecursionError):
        return None
