"""What is wrong with a Markdown text, line by line."""

from __future__ import annotations

import re
from collections.abc import Iterator

# Words on which no sentence ends.
DANGLING = frozenset("and or but nor yet so for the a an to of in on at by from with as into onto upon per via than then that which who whose when while where because if unless until although though however therefore thus must should shall will would can could may might is are was were be been being has have had do does did".split())
_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})(.*)")
_HEADING = re.compile(r" {0,3}(#{1,6})(\s|$)")
_UNSPACED = re.compile(r" {0,3}#{1,6}[^#\s\d]")
_LIST = re.compile(r"\s*(?:[-*+]|\d+[.)])\s")
#: What may stand behind the mark that ends a sentence.
_CLOSERS = ")\"'*_` \t\r\n\x0b\x0c"
_LINK = re.compile(r"\[[^\]]*\]\(([^)]*)\)")


def fenced(lines: list[str]) -> tuple[list[bool], int | None]:
    """Whether each line is in a fenced block, its fences included, and the line of a fence that is never closed."""
    inside, fence, begun = [], "", None
    for i, line in enumerate(lines):
        m = _FENCE.match(line)
        inside.append(bool(fence) or m is not None)
        if not fence and m:
            fence, begun = m[1], i
        elif fence and m and m[1][0] == fence[0] and len(m[1]) >= len(fence) and not m[2].strip():
            fence, begun = "", None
    return inside, begun


def slug(heading: str) -> str:
    """The anchor of a heading."""
    return re.sub(r"\s+", "-", re.sub(r"[^\w\s-]", "", heading.strip().lower()))


class Last:
    """The last line of a text, taken apart once."""

    def __init__(self, line: str) -> None:
        bare = line.strip()
        self.words = bare.split()
        self.heading = bool(_HEADING.match(line))
        self.structure = bare[:1] == "|" or bool(_LIST.match(line))
        self.colon = bare[-1:] == ":"
        self.closed = bare.rstrip(_CLOSERS)[-1:] in (".", "!", "?")
        letters = [w.lstrip("'-") for w in re.split(r"[^A-Za-z'-]+", bare)]
        self.last = next((w.lower() for w in reversed(letters) if w), "")
        stem, _, ending = bare.rpartition(".")
        self.path = bool(stem) and 1 <= len(ending) <= 5 and ending.isascii() and ending.isalnum() and ("/" in bare or "\\" in bare)
        self.prose = not self.structure and bare[:1].isascii() and bare[:1].isalpha()


#: What a last line may be, in this order: the first that holds tells whether the text was cut off, and how.
ENDINGS = [
    (lambda x: x.heading, "TRUNC_EMPTY_FINAL_HEADING"),
    (lambda x: x.last in DANGLING and not x.closed, "TRUNC_DANGLING_WORD"),
    (lambda x: x.structure, None),
    (lambda x: x.colon, "TRUNC_TRAILING_COLON"),
    (lambda x: x.closed or x.path, None),
    (lambda x: x.prose and len(x.words) >= 3, "TRUNC_PROSE_NO_TERMINAL"),
]


def ending(line: str) -> str | None:
    """The one thing that tells that a text was cut off at its last line, if any."""
    last = Last(line)
    return next((code for test, code in ENDINGS if test(last)), None)


def findings(text: str | None) -> Iterator[tuple[int, str]]:
    """(line from 1, code) of all that is wrong with a text; line 0 is the text as a whole. Nothing is wrong with an empty one."""
    lines = (text or "").split("\n")
    inside, unclosed = fenced(lines)
    free = [i for i in range(len(lines)) if not inside[i]]
    filled = [i for i in range(len(lines)) if lines[i].strip()]
    if not filled:
        return
    titles = {i: m for i in free if (m := _HEADING.match(lines[i]))}
    anchors = {slug(lines[i][m.end() :]) for i, m in titles.items()}
    if not any(len(m[1]) == 1 for m in titles.values()):
        yield 0, "TITLE_MISSING"
    if unclosed is not None:
        yield unclosed + 1, "FENCE_UNCLOSED"
    for i in free:
        line, bare = lines[i], lines[i].strip()
        if _UNSPACED.match(line):
            yield i + 1, "HEADING_NO_SPACE"
        if i and lines[i - 1].strip().startswith("|") and "|" in bare and "-" in bare and not bare.strip("|:- \t") and not all(re.match(r"\s*:?-+:?\s*$", c) for c in bare.removeprefix("|").removesuffix("|").split("|")):
            yield i + 1, "TABLE_SEPARATOR_INVALID"
        if (re.search(r"\][ \t]*\([^)]*$", line) and not re.match(r"\s*\[[^\]]*\]:\s", line)) or re.search(r"\][ \t]+\(\S", line):
            yield i + 1, "LINK_MALFORMED"
        for target in _LINK.findall(line):
            if not target.strip():
                yield i + 1, "LINK_EMPTY"
            elif target.startswith("#") and target[1:].lower() not in anchors:
                yield i + 1, "LINK_ANCHOR_MISSING"
    last = filled[-1]
    if not inside[last] and (code := ending(lines[last])):
        yield last + 1, code
