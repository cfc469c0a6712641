"""Rule tables: rows that say something when their conditions hold for some facts."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field


def split_words(text: str) -> set[str]:
    """Lower-case runs of letters and digits of three characters or more."""
    return {t for t in re.split(r"[^a-z0-9]+", text.lower()) if len(t) >= 3}


@dataclass(frozen=True)
class Facts:
    """What rules are held against: words, categories, column names (in lower case) and names of concepts."""

    words: frozenset[str] = frozenset()
    kinds: frozenset[str] = frozenset()
    columns: tuple[str, ...] = ()
    concepts: frozenset[str] = frozenset()

    @classmethod
    def of(cls, words: Iterable[str] = (), kinds: Iterable[str] = (), columns: Iterable[str] = (), concepts: Iterable[str] = ()) -> Facts:
        return cls(frozenset(words), frozenset(kinds), tuple(c.lower() for c in columns), frozenset(concepts))


@dataclass(frozen=True)
class Rule:
    """A row of a table. Every condition that is given must hold; a rule without conditions always holds.

    starts: a column's name starts with it. inside: one of these parts is in some column's name. words, also: one of these words each.
    two: two of these words. kinds: one of these categories. either: one of these as a category or a word. concepts: one of
    these concepts. all_concepts: all of them. any_of: rules of which one holds.
    """

    says: object
    starts: str = ""
    inside: tuple[str, ...] = ()
    words: tuple[str, ...] = ()
    also: tuple[str, ...] = ()
    two: tuple[str, ...] = ()
    kinds: tuple[str, ...] = ()
    either: tuple[str, ...] = ()
    concepts: tuple[str, ...] = ()
    all_concepts: tuple[str, ...] = ()
    any_of: tuple[Rule, ...] = field(default=())

    def holds(self, f: Facts) -> bool:
        some = lambda wanted, have: not wanted or not have.isdisjoint(wanted)
        return (
            (not self.starts or any(c.startswith(self.starts) for c in f.columns))
            and (not self.inside or any(part in name for part in self.inside for name in f.columns))
            and all(some(wanted, f.words) for wanted in (self.words, self.also))
            and (not self.two or len(f.words.intersection(self.two)) >= 2)
            and some(self.kinds, f.kinds)
            and some(self.either, f.kinds | f.words)
            and some(self.concepts, f.concepts)
            and f.concepts.issuperset(self.all_concepts)
            and (not self.any_of or any(r.holds(f) for r in self.any_of))
        )


def fitting(rules: Iterable[Rule], facts: Facts) -> Iterator[object]:
    """What the rules that hold say, in their order."""
    return (r.says for r in rules if r.holds(facts))


def first(rules: Iterable[Rule], facts: Facts) -> object | None:
    return next(fitting(rules, facts), None)
