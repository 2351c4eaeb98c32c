"""Sections of annual reports whose headings don't follow the form.

Each section has rules that are tried in order; the first that gives enough words wins. A rule either takes the longest
span between a start and an end, or the first heading that is no entry of a table of contents. The index that maps the
form's items to a report's own titles, at the end of many reports, bounds the search and gives the title to look for.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from .filings import MIN_WORDS, PATTERNS, clean_lines, longest_span

# Fixed values.
INDEX = r"CROSS.REFERENCE\s+INDEX"
OWN_TITLE = r"ITEM\s*1[\s.:\-–—]*\s*([A-Za-z][^\n\d]{3,60}?)\s*(?:\n|\d)"
TITLE_END = r"\n(?:RISK FACTORS|Risk Factors|Management.{0,5}s?\s+Discussion)"
SEPARATED = r"item\s*[1I][\s.:\-–—]+\s*business"
COMBINED = r"(?:^|\n)[ \t]*items?\s*1\s*(?:and\s*2)?[\s.:\-–—]+\s*business"
COMBINED_END = r"(?:^|\n)[ \t]*item\s*1\s*[Aa][\s.:\-–—]|(?:^|\n)[ \t]*item\s*3[\s.:\-–—]"
WORDED = r"item\s*[1I][\s.\n:–—]+(?:\w+\s+){0,4}business"
BRANDED = r"ABOUT\s+[A-Z][A-Z\s&]{5,50}\."
BRANDED_END = r"RISK\s+FACTORS\.|\nRISK\s+FACTORS\s*\n|(?:^|\n)[ \t]*item\s*[1I]\s*[Aa][\s.:\-–—]"
RISK_SEPARATED = r"item\s*[1I]\s*a[\s.:\-–—]+\s*risk\s*factors"
RISK_HEADING = r"(?:^|\n)(RISK FACTORS)\s*\n"
RISK_HEADING_END = r"\n(?:UNRESOLVED STAFF COMMENTS|PROPERTIES|Quantitative\s+and\s+Qualitative)"
RISK_INLINE = r"RISK\s+FACTORS\.\s+"
RISK_INLINE_END = r"(?:^|\n)[ \t]*PROPERTIES\b|(?:^|\n)[ \t]*UNRESOLVED\s+STAFF\s+COMMENTS\b|(?:^|\n)[ \t]*item\s*(?:2|II)[\s.:\-–—]"
DISCUSSION = r"(?:^|\n)Management.{0,5}s?\s+Discussion\s+and\s+Analysis[^\n]*\n"
DISCUSSION_END = r"\n(?:Quantitative\s+and\s+Qualitative|FINANCIAL STATEMENTS|Financial Statements)"
HEAD_CHARS, LONG_OPEN_END_CHARS = 500, 60_000


def _find(pattern: str, case: bool = False) -> re.Pattern:
    return re.compile(pattern, 0 if case else re.IGNORECASE)


@dataclass(frozen=True)
class Heading:
    """Sections that begin at a heading. Those up to the index keep the heading and stop at the index; open ones begin
    after it and stop after LONG_OPEN_END_CHARS. Headings behind the index count only where before_index is off."""

    start: str
    end: str
    up_to_index: bool = True
    only_first: bool = True
    peek: int = 30
    case: bool = False
    no_comma: bool = False
    whole_word: bool = False
    before_index: bool = True

    def spans(self, text: str, index: int) -> Iterator[str]:
        limit = index if self.before_index else len(text)
        for m in _find(self.start, self.case).finditer(text, 0, limit):
            if self.whole_word and text[m.end() : m.end() + 1].isalpha():
                continue
            if self.peek and text[m.end() : m.end() + self.peek].strip()[:1].isdigit():
                continue
            if self.no_comma and text[m.end() :].split("\n", 1)[0].strip().endswith(","):
                continue
            begin = m.start() if self.up_to_index else m.end()
            stop = _find(self.end).search(text, begin + HEAD_CHARS if self.up_to_index else begin)
            if self.up_to_index:
                last = stop.start() if stop and stop.start() < index else index
            else:
                last = stop.start() if stop else begin + LONG_OPEN_END_CHARS
            yield text[begin:last].strip()
            if self.only_first:
                return


@dataclass(frozen=True)
class Longest:
    start: str
    end: str

    def spans(self, text: str, index: int) -> Iterator[str]:
        yield longest_span(text, _find(self.start), _find(self.end))


class OwnTitle:
    """The title that the index gives item 1, if it is of two words or more."""

    def spans(self, text: str, index: int) -> Iterator[str]:
        m = _find(OWN_TITLE).search(text, index)
        title = m[1].strip() if m else ""
        if len(title.split()) > 1:
            yield from Heading(re.escape(title), TITLE_END, whole_word=True).spans(text, index)


RULES = {
    "item_1": (
        OwnTitle(),
        Longest(SEPARATED, PATTERNS["10-K", "item_1"][1]),
        Heading(COMBINED, COMBINED_END, up_to_index=False, only_first=False, peek=0, no_comma=True, before_index=False),
        Longest(WORDED, PATTERNS["10-K", "item_1"][1]),
        Heading(BRANDED, BRANDED_END, up_to_index=False, only_first=False, peek=10, case=True, before_index=False),
    ),
    "item_1a": (
        Longest(RISK_SEPARATED, PATTERNS["10-K", "item_1a"][1]),
        Heading(RISK_HEADING, RISK_HEADING_END),
        Heading(RISK_INLINE, RISK_INLINE_END, up_to_index=False, only_first=False, peek=10),
    ),
    "item_7": (Heading(DISCUSSION, DISCUSSION_END),),
}


def fallback(text: str, name: str) -> str | None:
    """A section by the rules for other headings."""
    found = list(_find(INDEX).finditer(text))
    index = found[-1].start() if found else len(text)
    for rule in RULES[name]:
        for span in rule.spans(text, index):
            if len(span.split()) >= MIN_WORDS:
                return clean_lines(span)
    return None
