"""Predicate text of plans: parser, depth-first sequence, and evaluation as a Column."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = re.compile(r"\s+|(?P<cast>::\w+(?: varying| without time zone)?(?:\(\d+\))?(?:\[\])?)|(?P<string>'(?:[^']|'')*')|(?P<number>-?\d+(?:\.\d+)?\b)|(?P<word>[A-Za-z_][\w.]*)|(?P<op>!~~|~~|<>|!=|<=|>=|=|<|>)|(?P<paren>[()])")
TAGS = {"~~": "like", "!~~": "not_like", "<>": "!="}
FLIP = {"<": ">", ">": "<", "<=": ">=", ">=": "<="}


@dataclass(frozen=True)
class Word:
    """A column, perhaps with its relation's alias."""

    name: str


@dataclass(frozen=True)
class Compare:
    column: str
    op: str
    value: object


@dataclass(frozen=True)
class Bool:
    op: str
    children: tuple = field(default_factory=tuple)


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text):
        m = TOKEN.match(text, at)
        if m is None:
            raise ValueError(f"predicate not understood at {at}: {text}")
        if m.lastgroup not in (None, "cast"):
            out.append((m.lastgroup, m.group()))
        at = m.end()
    return out


class _Parser:
    def __init__(self, text: str):
        self.rest, self.at = tokens(text), 0

    def peek(self, *words: str) -> bool:
        return self.at < len(self.rest) and self.rest[self.at][1].upper() in words

    def take(self) -> tuple[str, str]:
        if self.at >= len(self.rest):
            raise ValueError("predicate ends early")
        self.at += 1
        return self.rest[self.at - 1]

    def chain(self, word: str, below):
        parts = [below()]
        while self.peek(word):
            self.take()
            parts.append(below())
        return parts[0] if len(parts) == 1 else Bool(word.lower(), tuple(parts))

    def either(self):
        return self.chain("OR", lambda: self.chain("AND", self.one))

    def one(self):
        if self.peek("NOT"):
            self.take()
            return Bool("not", (self.one(),))
        left = self.operand()
        if isinstance(left, (Bool, Compare)):
            return left
        if self.peek("IS"):
            self.take()
            negated = self.peek("NOT")
            if negated:
                self.take()
            self.take()
            return Compare(left.name, "!=" if negated else "=", None)
        if self.at >= len(self.rest) or self.rest[self.at][0] != "op":
            return left
        op = TAGS.get(self.rest[self.at][1], self.take()[1])
        if self.peek("ANY"):
            self.take()
            values = self.operand()
            return Compare(left.name, "any", tuple(v.strip('" ') for v in str(values).strip("{}").split(",")))
        right = self.operand()
        if not isinstance(left, Word):
            left, right, op = right, left, FLIP.get(op, op)
        return Compare(left.name, op, right)

    def operand(self):
        kind, text = self.take()
        if text == "(":
            inner = self.either()
            if self.take()[1] != ")":
                raise ValueError("parenthesis left open")
            return inner
        if kind == "string":
            return text[1:-1].replace("''", "'")
        if kind == "number":
            return float(text) if "." in text else int(text)
        if kind == "word":
            return None if text.upper() == "NULL" else Word(text)
        raise ValueError(f"{text} is not an operand")


def parse(text: str | None):
    """Tree of a predicate's text; None without text."""
    if not text or not text.strip():
        return None
    p = _Parser(text)
    tree = p.either()
    if p.at != len(p.rest):
        raise ValueError(f"predicate not understood after {p.rest[p.at][1]}: {text}")
    return tree


def qualified(tree, aliases: dict[str, str], relation: str | None = None):
    """The tree with aliases replaced by relations; a column without one gets `relation`."""

    def name(n: str) -> str:
        alias, _, column = n.rpartition(".")
        owner = aliases.get(alias, alias) or relation
        return f"{owner}.{column}" if owner else column

    if isinstance(tree, Bool):
        return Bool(tree.op, tuple(qualified(c, aliases, relation) for c in tree.children))
    if tree is None:
        return None
    value = Word(name(tree.value.name)) if isinstance(tree.value, Word) else tree.value
    return Compare(name(tree.column), tree.op, value)


def sequence(tree) -> list[dict | None]:
    """Depth-first list of a tree's items, None where a subtree ends."""
    if tree is None:
        return []
    if isinstance(tree, Bool):
        out: list = [{"op_type": "Bool", "operator": tree.op.upper()}]
        for c in tree.children:
            out += sequence(c)
        return [*out, None]
    value = tree.value.name if isinstance(tree.value, Word) else tree.value
    return [{"op_type": "Compare", "operator": tree.op, "left_value": tree.column, "right_value": value}, None]


def rebuild(items: list[dict | None]):
    """The tree of a depth-first list."""
    root, stack = None, []
    for item in items:
        if item is None:
            node = stack.pop()
            made = Bool(node[0]["operator"].lower(), tuple(node[1])) if node[0]["op_type"] == "Bool" else Compare(node[0]["left_value"], node[0]["operator"], node[0]["right_value"])
            if stack:
                stack[-1][1].append(made)
            else:
                root = made
        else:
            stack.append((item, []))
    return root


def like(column: Column, pattern: str) -> Column:
    """Only % is a wildcard; it does not cross lines."""
    return F.rlike(column, F.lit("^" + "[^\\n]*".join(re.escape(p) for p in pattern.split("%")) + "\\z"))


_OPS = {"=": Column.__eq__, "!=": Column.__ne__, "<": Column.__lt__, ">": Column.__gt__, "<=": Column.__le__, ">=": Column.__ge__}


def selected(tree, types: dict[str, str], strict: bool = False) -> Column:
    """Whether a row satisfies the tree. types: "number" or "string" by column.

    A missing number fails = and passes the other comparisons, a missing string counts as empty;
    strict follows SQL instead (unknown is not selected).
    """
    if tree is None:
        return F.lit(True)
    if isinstance(tree, Bool):
        parts = [selected(c, types, strict) for c in tree.children]
        if tree.op == "not":
            return ~parts[0]
        out = parts[0]
        for p in parts[1:]:
            out = out & p if tree.op == "and" else out | p
        return out
    c = F.col(tree.column)
    if isinstance(tree.value, Word):
        return F.coalesce(_OPS[tree.op](c, F.col(tree.value.name)), F.lit(False))
    if types[tree.column] == "number":
        if tree.value is None:
            return c.isNull() if tree.op == "=" else c.isNotNull()
        if tree.op == "any":
            return F.coalesce(c.isin([float(v) for v in tree.value]), F.lit(False))
        number = tree.value if isinstance(tree.value, (int, float)) else float(tree.value)
        return F.coalesce(_OPS[tree.op](c, F.lit(number)), F.lit(False if strict else tree.op != "="))
    s = c if strict else F.coalesce(c, F.lit(""))
    if tree.value is None:
        empty = F.coalesce(c, F.lit("")) == "" if not strict else c.isNull()
        return empty if tree.op == "=" else ~empty
    if tree.op in ("like", "not_like"):
        found = like(s, str(tree.value)) if tree.op == "like" else ~like(s, str(tree.value))
    elif tree.op == "any":
        found = s.isin([str(v) for v in tree.value])
    else:
        found = _OPS[tree.op](s, F.lit(str(tree.value)))
    return F.coalesce(found, F.lit(False))
