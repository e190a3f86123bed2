"""Lexer and parser of the query language.

    find [type] {where EXPR | linked [to] REF [via LINK, ...] [within N] | order by FIELD [asc|desc] | limit N|all}
    path REF to REF [within N] [limit N]
    show REF

Keywords are case-insensitive, strings have no escapes, ``not`` binds tighter than ``and``,
``and`` tighter than ``or``. Clauses of ``find`` come in any order and a later one replaces an
earlier one of its kind. Trailing words, fractional or negative counts are errors.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

RESERVED = frozenset("find path show where linked to via within order by asc desc limit and or not count in".split())
OPERATORS = ("<=", ">=", "!=", "=", "<", ">", "~")
_LEX = re.compile(
    r"(?P<text>\"[^\"]*\"|'[^']*')|(?P<num>-?\d+(?:\.\d+)?)|(?P<op>[<>!]=|[=<>~])|(?P<name>[A-Za-z_][\w.\-]*)|(?P<mark>[(),])|(?P<gap>\s+)"
)


class QueryError(ValueError):
    """A query that does not parse or names something unknown."""


@dataclass(frozen=True)
class Token:
    kind: str  # text, num, op, name, key, mark
    value: str


@dataclass(frozen=True)
class Comparison:
    field: str
    op: str
    value: str | float


@dataclass(frozen=True)
class Junction:
    op: str  # and, or
    terms: tuple


@dataclass(frozen=True)
class Negation:
    term: object


@dataclass(frozen=True)
class FindQuery:
    entity_type: str | None = None
    where: object | None = None
    linked: str | None = None
    via: tuple[str, ...] | None = None
    within: int = 1
    order: str | None = None
    descending: bool = True
    limit: int | None = 25


@dataclass(frozen=True)
class PathQuery:
    start: str
    end: str
    within: int = 4
    limit: int = 5


@dataclass(frozen=True)
class ShowQuery:
    ref: str


def tokenize(text: str) -> list[Token]:
    out, at = [], 0
    while at < len(text):
        m = _LEX.match(text, at)
        if not m:
            raise QueryError(f"cannot read {text[at : at + 20]!r}")
        at, kind, value = m.end(), m.lastgroup, m.group()
        if kind == "text":
            value = value[1:-1]
        elif kind == "name" and value.lower() in RESERVED:
            kind, value = "key", value.lower()
        if kind != "gap":
            out.append(Token(kind, value))
    return out


class _Parser:
    def __init__(self, text: str) -> None:
        self.tokens, self.at = tokenize(text), 0

    def look(self) -> Token | None:
        return self.tokens[self.at] if self.at < len(self.tokens) else None

    def take(self, kind: str, *values: str) -> str | None:
        """The next token's value if it is of the kind (and one of the values), consumed."""
        t = self.look()
        if t and t.kind == kind and (not values or t.value in values):
            self.at += 1
            return t.value
        return None

    def need(self, kind: str, *values: str) -> str:
        got = self.take(kind, *values)
        if got is None:
            t = self.look()
            raise QueryError(f"expected {' or '.join(values) or kind}, found {t.value if t else 'the end'!r}")
        return got

    def whole(self) -> int:
        value = self.need("num")
        if not value.isdigit():
            raise QueryError(f"expected a whole number, found {value}")
        return int(value)

    def ref(self) -> str:
        for kind in ("text", "name"):
            got = self.take(kind)
            if got is not None:
                return got
        raise QueryError("expected an id or a quoted name")

    def query(self) -> FindQuery | PathQuery | ShowQuery:
        verb = self.need("key", "find", "path", "show")
        out = {"find": self.find, "path": self.path, "show": lambda: ShowQuery(self.ref())}[verb]()
        if self.look():
            raise QueryError(f"unexpected {self.look().value!r}")
        return out

    def find(self) -> FindQuery:
        parts: dict = {"entity_type": self.take("name")}
        while self.look():
            clause = self.need("key", "where", "linked", "order", "limit")
            if clause == "where":
                parts["where"] = self.either()
            elif clause == "limit":
                parts["limit"] = None if self.take("name", "all") else self.whole()
            elif clause == "order":
                self.need("key", "by")
                parts["order"] = self.field()
                parts["descending"] = self.take("key", "asc", "desc") != "asc"
            else:
                self.take("key", "to")
                parts |= {"linked": self.ref(), "via": None, "within": 1}
                if self.take("key", "via"):
                    names = [self.need("name")]
                    while self.take("mark", ","):
                        names.append(self.need("name"))
                    parts["via"] = tuple(names)
                if self.take("key", "within"):
                    parts["within"] = self.whole()
        return FindQuery(**parts)

    def path(self) -> PathQuery:
        start = self.ref()
        self.need("key", "to")
        parts = {"start": start, "end": self.ref()}
        while self.look():
            clause = self.need("key", "within", "limit")
            parts[clause] = self.whole()
        return PathQuery(**parts)

    def field(self) -> str:
        return self.take("name") or self.need("key", "count", "in")

    def either(self) -> object:
        return self.joined("or", lambda: self.joined("and", self.term))

    def joined(self, word: str, inner) -> object:
        terms = [inner()]
        while self.take("key", word):
            terms.append(inner())
        return terms[0] if len(terms) == 1 else Junction(word, tuple(terms))

    def term(self) -> object:
        if self.take("key", "not"):
            return Negation(self.term())
        if self.take("mark", "("):
            inner = self.either()
            self.need("mark", ")")
            return inner
        field, op = self.field(), self.need("op")
        number = self.take("num")
        if number is not None:
            return Comparison(field, op, float(number))
        for kind in ("text", "name", "key"):
            value = self.take(kind)
            if value is not None:
                return Comparison(field, op, value)
        raise QueryError(f"expected a value after {field} {op}")


def parse(text: str) -> FindQuery | PathQuery | ShowQuery:
    return _Parser(text).query()
