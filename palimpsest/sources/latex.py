r"""LaTeX sources as text: a tokenizer, a tree of groups, and what a reader would see of it.

A group is a list, a command a ``Command``, anything else a string. A command shows its last group
(``\frac{a}{b}`` shows ``b``); ``\begin``, ``\end`` and options in brackets show nothing; escaped signs show
themselves; comments go to the end of their line. Groups nest to any depth.
"""

from __future__ import annotations

import re
from typing import NamedTuple

_TOKENS = re.compile(r"\\(?P<word>[A-Za-z@]+)\*?(?:\[[^\[\]{}]*\])?[ \t]*|\\(?P<sign>.)|%[^\n]*|(?P<open>\{)|(?P<close>\})|(?P<text>[^\\%{}]+)", re.S)
_SHOWN = {s: s for s in "%&_#${}"} | {"\\": "\n", " ": " ", "\n": "\n"}


class Command(NamedTuple):
    name: str


def tree(source: str) -> list:
    """The source as nested lists; a closing brace too many is left out, a missing one is made up at the end."""
    top: list = []
    path = [top]
    for m in _TOKENS.finditer(source):
        kind = m.lastgroup
        if kind == "word":
            path[-1].append(Command(m["word"]))
        elif kind == "sign":
            path[-1].append(_SHOWN.get(m["sign"], ""))
        elif kind == "text":
            path[-1].append(m["text"])
        elif kind == "open":
            path[-1].append([])
            path.append(path[-1][-1])
        elif kind == "close" and len(path) > 1:
            path.pop()
    return top


def shown(nodes: list) -> str:
    """What is seen of a tree."""
    parts: list[str] = []
    todo = [iter(_seen(nodes))]
    while todo:
        node = next(todo[-1], None)
        if node is None:
            todo.pop()
        elif isinstance(node, str):
            parts.append(node)
        else:
            todo.append(iter(_seen(node)))
    return re.sub(r"[ ]{2,}", " ", re.sub(r"\n{3,}", "\n\n", "".join(parts)))


def _seen(nodes: list) -> list:
    """The strings and groups of a list that are seen: of each command, the last group behind it."""
    out: list = []
    command, last = None, None
    for node in [*nodes, ""]:
        if command is not None and isinstance(node, list):
            last = node
            continue
        if command is not None and last is not None and command.name not in ("begin", "end"):
            out.append(last)
        command, last = (node, None) if isinstance(node, Command) else (None, None)
        if command is None:
            out.append(node)
    return out


def argument(nodes: list, name: str) -> str:
    """The first group of the first such command that has one, as seen; '' without."""
    todo = [nodes]
    while todo:
        level = todo.pop()
        for node, after in zip(level, [*level[1:], None], strict=False):
            if node == Command(name) and isinstance(after, list):
                return shown(after).strip()
        todo += [x for x in reversed(level) if isinstance(x, list)]
    return ""


def environment(nodes: list, name: str) -> list | None:
    """What stands between the first ``\\begin`` and the next ``\\end`` of that name; None without either."""
    edge = lambda k, word: nodes[k] == Command(word) and k + 1 < len(nodes) and isinstance(nodes[k + 1], list) and shown(nodes[k + 1]).strip() == name
    begin = next((k for k in range(len(nodes)) if edge(k, "begin")), None)
    end = next((k for k in range(begin + 2, len(nodes)) if edge(k, "end")), None) if begin is not None else None
    return nodes[begin + 2 : end] if end is not None else None
