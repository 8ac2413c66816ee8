"""Closed templates of one text by a plain walk with a stack, to compare with."""

from __future__ import annotations

import re

_RUN = re.compile(r"\{+|\}+")


def closed(text: str) -> list[tuple[int, int, int]]:
    """(level, start, end) of each closed template in the order in which they close; level 1 holds none.

    Runs of opening braces wait on a stack, closing runs take pairs off its top. A single brace
    left between two runs belongs to no template, and no template reaches over it.
    """
    found, waiting = [], []  # a waiting run: its end, the braces left, the deepest level inside
    for run in _RUN.finditer(text):
        at, n = run.start(), run.end() - run.start()
        if text[at] == "{":
            waiting.append([run.end(), n, 0])
            continue
        while n >= 2 and waiting and waiting[-1][1] >= 2:
            top = waiting[-1]
            level, at, n = top[2] + 1, at + 2, n - 2
            found.append((level, top[0] - 2, at))
            top[:] = top[0] - 2, top[1] - 2, level
            if not top[1]:
                waiting.pop()
                if waiting:
                    waiting[-1][2] = max(waiting[-1][2], level)
        if n:
            waiting.clear()
    return found


def without(text: str) -> str:
    """The text without its closed templates."""
    kept, at = [], 0
    for start, end in _outermost(closed(text)):
        kept.append(text[at:start])
        at = end
    return "".join([*kept, text[at:]])


def _outermost(found: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    out = []
    for _, start, end in found:
        while out and out[-1][0] >= start:
            out.pop()
        out.append((start, end))
    return out


def parts(text: str) -> list[tuple[str, str]]:
    """(name, body) of each closed template in the order in which they close."""
    done, open_ = [], []  # open_: start, end and short name of templates not yet inside another one
    for _, start, end in closed(text):
        inner = []
        while open_ and open_[-1][0] >= start:
            inner.append(open_.pop())
        name, body, at = [], None, start + 2
        for s, e, short in [*reversed(inner), (end - 2, end, None)]:
            piece, at = text[at:s], e
            if body is None:
                head, bar, piece = piece.partition("|")
                name.append(head)
                if bar:
                    body = [piece]
            else:
                body.append(piece)
            if short is not None:
                (name if body is None else body).append("{{" + short + "}}")
        open_.append((start, end, name[0]))
        done.append(("".join(name), "".join(body or [])))
    return done
