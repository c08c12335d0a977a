"""Search language (Q01-Q09): a query is compiled on the driver to one Column, which stays in generated code."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import has_phrase, normalize, plain, variants


@dataclass(frozen=True)
class Term:
    variants: tuple[str, ...]
    tag: str | None
    phrase: bool


def tokens(query: str) -> tuple[list[list[tuple[str, bool]]], list[str]]:
    """Q01, Q02: clauses of (text, quoted), any of which may hold, and excluded texts."""
    clauses: list[list[tuple[str, bool]]] = [[]]
    exclude = []
    for m in re.finditer(r'(-?)"([^"]*)"|(\S+)', query):
        quoted = m[2] is not None
        word = m[2].strip() if quoted else m[3]
        minus = m[1] == "-" if quoted else len(word) > 1 and word.startswith("-")
        word = word[1:] if minus and not quoted else word
        if not word:
            continue
        if not quoted and not minus and word in ("OR", "|"):
            if clauses[-1]:
                clauses.append([])
        elif minus:
            exclude.append(word.lower())
        else:
            clauses[-1].append((word.lower(), quoted))
    return [c for c in clauses if c], exclude


def canonical(phrase: str, keywords: list[str], aliases: dict[str, list[str]]) -> str | None:
    """The keyword that a phrase is, or is a synonym of."""
    p = plain(phrase)
    for k in keywords:
        if p in map(plain, variants(k, aliases)):
            return k
    return next((c for c, others in aliases.items() if p in map(plain, (c, *others))), None)


@dataclass(frozen=True)
class Matcher:
    clauses: tuple[tuple[Term, ...], ...]
    exclude: tuple[str, ...]

    @property
    def empty(self) -> bool:
        """Q08."""
        return not self.clauses and not self.exclude

    def _hit(self, hay: Column, tags: Column | None, term: Term) -> Column:
        """Q06: by tag, whole phrase, or, for a single bare word, as part of a word."""
        tests = [F.coalesce(F.array_contains(tags, term.tag), F.lit(False))] if term.tag and tags is not None else []
        for v in term.variants:
            p = plain(v)
            tests.append(has_phrase(hay, p) if term.phrase or " " in v else hay.contains(p))
        return reduce(lambda a, b: a | b, tests)

    def test(self, hay: Column, tags: Column | None = None) -> Column:
        """Q07."""
        out = F.lit(True)
        if self.clauses:
            out = reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [self._hit(hay, tags, t) for t in c]) for c in self.clauses])
        for e in self.exclude:
            out = out & ~has_phrase(hay, e)
        return out

    def title_hits(self, title: Column) -> Column:
        """Q09: terms, of all clauses, with a variant in the normalised title."""
        out = F.lit(0)
        for term in (t for c in self.clauses for t in c):
            hit = reduce(lambda a, b: a | b, [has_phrase(title, plain(v)) | title.contains(plain(v)) for v in term.variants])
            out = out + F.when(hit, 1).otherwise(0)
        return out


def compile_query(query: str, keywords: list[str] = (), aliases: dict[str, list[str]] | None = None) -> Matcher:
    """Q04, Q05: a clause that is a keyword as a whole is one phrase with all its variants."""
    aliases = aliases or {}
    clauses, exclude = tokens(query)
    out = []
    for terms in clauses:
        joined = " ".join(t for t, _ in terms)
        canon = canonical(joined, keywords, aliases) if keywords or aliases else None
        if canon or (len(terms) > 1 and len(variants(joined, aliases)) > 1):
            out.append((Term(tuple(variants(canon or joined, aliases)), canon, True),))
            continue
        made = []
        for t, quoted in terms:
            vs = tuple(variants(t, aliases))
            made.append(Term(vs, canonical(t, keywords, aliases) if keywords or aliases else None, quoted or len(vs) > 1))
        out.append(tuple(made))
    return Matcher(tuple(out), tuple(filter(None, map(plain, exclude))))


def haystack(*columns: Column) -> Column:
    """Q03: normalised text of all searched columns; arrays are joined by spaces."""
    return normalize(F.concat_ws(" ", *columns))
