"""The query language: plain terms and quoted phrases, all of which must occur."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from lodestream.functions.text import TOKEN_PATTERN

RANKING_MODES = ("bm25", "tfidf")

_token = re.compile(TOKEN_PATTERN)
#: Fixed: a quoted run, or a run without white space.
_part = re.compile(r'"([^"]+)"|(\S+)')


def query_tokens(raw: str) -> list[str]:
    """Tokens of user input; hyphenated ones are not expanded."""
    return _token.findall(raw.lower())


def normal_term(raw: str) -> str:
    """The first token, or the trimmed lower-case input where there is none."""
    return next(iter(query_tokens(raw)), raw.strip().lower())


@dataclass(frozen=True)
class Query:
    terms: tuple[str, ...]
    phrases: tuple[tuple[str, ...], ...]
    scoring_terms: tuple[str, ...]
    display: str

    @property
    def required(self) -> tuple[str, ...]:
        """Every term that a match must contain, in scoring order."""
        return self.scoring_terms

    @property
    def empty(self) -> bool:
        return not self.terms and not self.phrases


def parse_query(words: Sequence[str] | str) -> Query:
    raw = words if isinstance(words, str) else " ".join(words)
    terms: dict[str, None] = {}
    phrases: dict[tuple[str, ...], None] = {}
    shown: dict[str, None] = {}
    for phrase, word in _part.findall(raw.strip()):
        found = query_tokens(phrase or word)
        if not found:
            continue
        if phrase:
            phrases.setdefault(tuple(found))
            shown.setdefault('"' + " ".join(found) + '"')
        else:
            terms.update(dict.fromkeys(found))
            shown.update(dict.fromkeys(found))
    scoring = dict.fromkeys(terms)
    for p in phrases:
        scoring.update(dict.fromkeys(p))
    return Query(tuple(terms), tuple(phrases), tuple(scoring), " ".join(shown))
