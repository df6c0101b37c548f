"""Parsing-expression grammars: ordered choice, no backtracking into a choice once made, results remembered by rule and place."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass


@dataclass(slots=True)
class Tree:
    rule: str
    start: int
    end: int
    parts: list["Tree"]

    def text(self, source: str) -> str:
        return source[self.start : self.end]

    def first(self, rule: str) -> "Tree | None":
        for p in self.parts:
            if p.rule == rule:
                return p
            if not p.rule and (found := p.first(rule)):
                return found
        return None


Parser = Callable[["Grammar", str, int, dict], "Tree | None"]


def token(pattern: str, name: str = "", flags: int = 0) -> Parser:
    match = re.compile(pattern, flags).match

    def parse(g: Grammar, s: str, at: int, memo: dict) -> Tree | None:
        m = match(s, at)
        return Tree(name, at, m.end(), []) if m else None

    return parse


def sequence(*items: Parser) -> Parser:
    def parse(g: Grammar, s: str, at: int, memo: dict) -> Tree | None:
        parts, here = [], at
        for item in items:
            t = item(g, s, here, memo)
            if t is None:
                return None
            here = t.end
            parts.append(t)
        return Tree("", at, here, parts)

    return parse


def choice(*items: Parser) -> Parser:
    def parse(g: Grammar, s: str, at: int, memo: dict) -> Tree | None:
        for item in items:
            t = item(g, s, at, memo)
            if t is not None:
                return t
        return None

    return parse


def many(item: Parser) -> Parser:
    def parse(g: Grammar, s: str, at: int, memo: dict) -> Tree | None:
        parts, here = [], at
        while here < len(s) and (t := item(g, s, here, memo)) is not None and t.end > here:
            parts.append(t)
            here = t.end
        return Tree("", at, here, parts)

    return parse


def maybe(item: Parser) -> Parser:
    def parse(g: Grammar, s: str, at: int, memo: dict) -> Tree | None:
        return item(g, s, at, memo) or Tree("", at, at, [])

    return parse


def unless(item: Parser) -> Parser:
    """Matches nothing, where ``item`` does not match."""

    def parse(g: Grammar, s: str, at: int, memo: dict) -> Tree | None:
        return None if item(g, s, at, memo) else Tree("", at, at, [])

    return parse


def ref(name: str) -> Parser:
    def parse(g: Grammar, s: str, at: int, memo: dict) -> Tree | None:
        key = (name, at)
        if key not in memo:
            t = g.rules[name](g, s, at, memo)
            memo[key] = t and Tree(name, t.start, t.end, [t] if t.rule else t.parts)
        return memo[key]

    return parse


class Grammar:
    def __init__(self, **rules: Parser) -> None:
        self.rules = rules

    def parse(self, rule: str, source: str) -> Tree | None:
        """The tree of ``rule`` over the whole of ``source``, or None."""
        t = ref(rule)(self, source, 0, {})
        return t if t is not None and t.end == len(source) else None
