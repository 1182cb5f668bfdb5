"""Factor expressions: ``(rank (ts_mean close 5))``, statements split by ``;`` or new lines, ``(let name expr)``."""

from __future__ import annotations

import re
from dataclasses import dataclass


@dataclass(frozen=True)
class Node:
    value: str
    children: tuple[Node, ...] = ()

    def __str__(self) -> str:
        return f"({' '.join([self.value, *map(str, self.children)])})" if self.children else self.value


def _read(tokens: list[str], at: int) -> tuple[Node, int]:
    if at >= len(tokens):
        raise ValueError("expression ends too early")
    if tokens[at] == ")":
        raise ValueError("unexpected )")
    if tokens[at] != "(":
        return Node(tokens[at]), at + 1
    if at + 1 >= len(tokens) or tokens[at + 1] in "()":
        raise ValueError("a call needs a name")
    name, parts, at = tokens[at + 1], [], at + 2
    while at < len(tokens) and tokens[at] != ")":
        part, at = _read(tokens, at)
        parts.append(part)
    if at >= len(tokens):
        raise ValueError("missing )")
    return Node(name, tuple(parts)), at + 1


def parse(text: str) -> Node:
    """The last statement, with the names of earlier ``let`` statements put in."""
    statements = [s for s in re.split(r"[;\n]", text) if s.strip()]
    if not statements:
        raise ValueError("empty expression")
    names: dict[str, Node] = {}

    def bind(node: Node) -> Node:
        if not node.children:
            return names.get(node.value, node)
        return Node(node.value, tuple(map(bind, node.children)))

    for k, s in enumerate(statements):
        tokens = re.findall(r"[()]|[^\s()]+", s)
        node, at = _read(tokens, 0)
        if at != len(tokens):
            raise ValueError(f"more than one expression: {s.strip()}")
        if node.value == "let" and node.children:
            if len(node.children) != 2 or node.children[0].children or k == len(statements) - 1:
                raise ValueError("let takes a name and an expression, before the last statement")
            names[node.children[0].value] = bind(node.children[1])
        else:
            last = bind(node)
    return last
