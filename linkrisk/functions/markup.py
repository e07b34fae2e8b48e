"""A page's tags, found in one pass: each search begins where the one before has ended, and none is made twice in vain."""

from __future__ import annotations

import html
import re
from typing import NamedTuple

NAME = re.compile(r"[A-Za-z][^\t\n\r\f />\x00]*+")
#: Up to the end of a tag or the next value.
STEP = re.compile(r"[^>=]*+(>|=++\s*+)")
ATTRIBUTE = re.compile(r"([^\s/>][^\s/=>]*+)(?:\s*+=++\s*+('[^']*+'|\"[^\"]*+\"|[^>\s]*+))?+")


class Tag(NamedTuple):
    """A start or end tag at page[begin:end]; ``name`` is in lower case, and "" for a comment or declaration."""

    begin: int
    end: int
    ending: bool
    name: str
    attributes: str


class Markup:
    """The tags of a page.

    Values after "=" may be quoted, and a quoted one may hold ">". A quote without its partner is a letter like others. A
    comment without end goes on to the page's end; a tag without end is text, as is all after it.
    """

    def __init__(self, page: str):
        self.page = page
        self.over = page.rfind(">") + 1
        self.last = {q: page.rfind(q) for q in "'\""}

    def find(self, at: int) -> Tag | None:
        """The first tag, comment or declaration at or after ``at``."""
        page = self.page
        while (begin := page.find("<", at)) >= 0:
            if page.startswith("<!--", begin):
                end = page.find("-->", begin + 4)
                return Tag(begin, len(page) if end < 0 else end + 3, False, "", "")
            if begin >= self.over:
                return None
            ending = page.startswith("/", begin + 1)
            name = NAME.match(page, begin + 1 + ending)
            if name:
                end = page.find(">", name.end()) + 1 if ending else self.end_of(name.end())
                if not end:
                    self.over = begin
                    return None
                return Tag(begin, end, ending, name[0].lower(), page[name.end() : end - 1])
            if ending or page.startswith(("!", "?"), begin + 1):
                return Tag(begin, page.find(">", begin) + 1, False, "", "")
            at = begin + 1
        return None

    def end_of(self, at: int) -> int:
        """Where the start tag ends whose attributes begin at ``at``; 0 if it does not."""
        page = self.page
        while m := STEP.match(page, at):
            at = m.end()
            if m[1] == ">":
                return at
            quote = page[at : at + 1]
            if self.last.get(quote, -1) > at:
                at = page.find(quote, at + 1) + 1
        return 0


def closes_itself(text: str) -> bool:
    """Whether a start tag with these attributes ends with "/>"; a "/" at the end of an unquoted value belongs to the value."""
    if not text.endswith("/"):
        return False
    last = None
    for last in ATTRIBUTE.finditer(text):
        pass
    return last is None or last.end() < len(text) or not last[2] or last[2][0] in "'\""


def attributes_of(text: str) -> dict[str, str]:
    """A start tag's attributes, names in lower case, references decoded; of repeated ones the first counts."""
    out: dict[str, str] = {}
    for name, value in ATTRIBUTE.findall(text):
        if value[:1] in ("'", '"') and len(value) > 1 and value[-1] == value[0]:
            value = value[1:-1]
        out.setdefault(name.lower(), html.unescape(value) if "&" in value else value)
    return out
