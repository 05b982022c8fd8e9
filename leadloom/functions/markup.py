"""A tokenizer for HTML that reads any input in one pass: no page costs more than its length."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

_OPEN = re.compile(r"<(?=[a-zA-Z!?]|/[a-zA-Z])")
_NAME = re.compile(r"[a-zA-Z][^\s/>\x00]*+")
_SKIP = re.compile(r"[\s/]*+")
_ATTRIBUTE = re.compile(r"([^\s/>][^\s/=>]*+)(\s*+=++\s*+)?+")
_BARE = re.compile(r"[^>\s]*+")

Attributes = list[tuple[str, str | None]]


def decoded(text: str) -> str:
    """The text with its character references resolved; a reference to a number without bound stays as it is."""
    if "&" not in text:
        return text
    try:
        return unescape(text)
    except ValueError:
        return text


class _Tags:
    """Start tags of one page. Quotes that never close, and tags that swallow the rest, are met once and remembered."""

    def __init__(self, page: str) -> None:
        self.page = page
        self.last_quote = {q: page.rfind(q) for q in "\"'"}
        self.last_end = page.rfind(">")
        self.trusted = True  # quotes may hold a ">"

    def _attributes(self, at: int, limit: int) -> tuple[Attributes, int, bool] | None:
        page, found = self.page, []
        while True:
            skipped = _SKIP.match(page, at, limit)
            at = skipped.end()
            if at >= limit:
                return None
            if page[at] == ">":
                return found, at + 1, skipped[0].endswith("/")
            name = _ATTRIBUTE.match(page, at, limit)
            at = name.end()
            if name[2] is None:
                found.append((name[1].lower(), None))
                continue
            quote = page[at : at + 1]
            end = -1
            if quote in ('"', "'") and at < min(self.last_quote[quote], limit):
                end = page.find(quote, at + 1, limit)
            if end >= 0:
                value, at = page[at + 1 : end], end + 1
            else:
                bare = _BARE.match(page, at, limit)
                value, at = bare[0], bare.end()
            found.append((name[1].lower(), decoded(value)))

    def read(self, at: int) -> tuple[Attributes, int, bool] | None:
        """(attributes, place behind the tag, whether it closes itself) from behind the tag's name; None if it has no end."""
        if at > self.last_end:
            return None
        end = self.page.find(">", at)
        if "=" not in self.page[at:end]:  # no value, so no quote that could hold the end
            return self._attributes(at, end + 1)
        if self.trusted:
            found = self._attributes(at, len(self.page))
            if found:
                return found
            self.trusted = False
        return self._attributes(at, end + 1) or ([], end + 1, False)


def tokens(page: str, raw: frozenset[str] = frozenset(("script", "style"))) -> Iterator[tuple]:
    """("text", text), ("start", name, attributes, closes itself), ("end", name), ("raw", content), ("broken", source).

    Text and values come with references resolved. ``raw`` names elements whose content is not markup. "broken" is what
    begins like a comment, declaration or tag but never ends, up to the next ">"; comments and declarations are left out.
    """
    tags, at, text_from, n = _Tags(page), 0, 0, len(page)
    comments = True
    while True:
        m = _OPEN.search(page, at)
        if not m:
            break
        start = m.start()
        if start > text_from:
            yield "text", decoded(page[text_from:start])
        sign = page[start + 1]
        if start > tags.last_end:  # nothing ends any more
            yield "broken", decoded(page[start:])
            return
        if sign in "!?":
            end = page.find(">", start)
            if page.startswith("<!--", start):
                close = page.find("-->", start + 2) if comments else -1
                if close < 0:
                    comments = False
                    yield "broken", decoded(page[start : end + 1])
                else:
                    end = close + 2
            at = text_from = end + 1
            continue
        name = _NAME.match(page, start + 1 + (sign == "/"))
        tag = name[0].lower()
        if sign == "/":
            at = text_from = page.find(">", start) + 1
            yield "end", tag
            continue
        found = tags.read(name.end())
        if found is None:
            yield "broken", decoded(page[start:])
            return
        attributes, at, closed = found
        yield "start", tag, attributes, closed
        if tag in raw and not closed:
            close = re.compile(f"</{re.escape(tag)}(?=[\\s/>])", re.I).search(page, at)
            end = close.start() if close else n
            yield "raw", page[at:end]
            at = end
        text_from = at
    if text_from < n:
        yield "text", decoded(page[text_from:])
