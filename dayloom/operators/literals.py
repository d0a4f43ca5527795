"""What a text must contain for an expression to match it, read off the expression.

needed() gives strings of which each match contains one at least, or None where
it can't tell: where a part of the expression isn't understood, all of it isn't.
ASCII letters are folded, so that an expression that ignores case is covered.
"""

from __future__ import annotations

import re

#: Length of the grams by which texts are looked up; shorter strings say nothing.
GRAM = 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FOLD = str.maketrans(UPPER, LOWER)
QUANTIFIER = re.compile(r"(?:([?*+])|\{(\d+)(?:,\d*)?\})[?+]?")
FLAGS = re.compile(r"[ims]*(?:-[ims]+)?([:)])")
ANCHORS, KINDS = "bBAzZG", "dDwWsShHvVRtnrfae"


class Unknown(Exception):
    pass


def needed(expression: str | None) -> list[str] | None:
    """Strings of GRAM characters or more, one of which is in every text that expression matches; None if there are none."""
    if not expression:
        return None
    try:
        found, end = _either(expression, 0)
        return found if end == len(expression) else None
    except (Unknown, IndexError, RecursionError):
        return None


def _either(p: str, i: int) -> tuple[list[str] | None, int]:
    """What alternatives need, up to a closing parenthesis or the end: one string of each."""
    branches = []
    while True:
        found, i = _sequence(p, i)
        branches.append(found)
        if i == len(p) or p[i] != "|":
            break
        i += 1
    return (None if None in branches else sorted({x for b in branches for x in b})), i


def _sequence(p: str, i: int) -> tuple[list[str] | None, int]:
    """What a sequence needs: the run of plain characters, or the group, that tells most."""
    options: list[list[str]] = []
    run = ""

    def flush() -> None:
        nonlocal run
        if len(run) >= GRAM:
            options.append([run.translate(FOLD)])
        run = ""

    while i < len(p) and p[i] not in "|)":
        c, plain, inner = p[i], None, None
        if c == "(":
            inner, i = _group(p, i + 1)
        elif c == "[":
            i = _class_end(p, i)
        elif c in "^$" or c == "\\" and p[i + 1] in ANCHORS:
            i += 1 if c != "\\" else 2
            if i < len(p) and p[i] in "{?*+":
                raise Unknown
            continue  # no width: what follows is next to what was before
        elif c == "\\":
            if p[i + 1].isascii() and p[i + 1].isalnum() and p[i + 1] not in KINDS:
                raise Unknown
            plain, i = (None if p[i + 1] in KINDS else p[i + 1]), i + 2
        elif c in "{}*+?]":
            raise Unknown
        else:
            plain, i = (None if c == "." else c), i + 1
        times = QUANTIFIER.match(p, i)
        if times:
            i = times.end()
        elif i < len(p) and p[i] == "{":
            raise Unknown
        never = times is not None and (times[1] in ("?", "*") or times[2] is not None and int(times[2]) == 0)
        if plain is not None and not never:
            run += plain
        if plain is None or times:
            flush()
        if inner and not never:
            options.append(inner)
    flush()
    return max(options, key=lambda x: (min(map(len, x)), -len(x)), default=None), i


def _group(p: str, i: int) -> tuple[list[str] | None, int]:
    """What a group needs, from behind its opening parenthesis; nothing for one that only looks ahead or back, or sets flags."""
    looks = False
    if p[i] == "?":
        i += 1
        if p[i] in ":>":
            i += 1
        elif p[i] in "=!":
            looks, i = True, i + 1
        elif p[i] == "<" and p[i + 1] in "=!":
            looks, i = True, i + 2
        elif p[i] == "<":
            i = p.index(">", i) + 1 if ">" in p[i:] else len(p)
        else:
            flags = FLAGS.match(p, i)
            if not flags:
                raise Unknown
            i = flags.end()
            if flags[1] == ")":
                return None, i
    found, i = _either(p, i)
    if p[i] != ")":
        raise Unknown
    return (None if looks else found), i + 1


def _class_end(p: str, i: int) -> int:
    """Behind a character class that may hold others."""
    depth = 0
    while True:
        if p[i] == "\\":
            if p[i + 1] == "Q":
                raise Unknown
            i += 1
        elif p[i] == "[":
            depth += 1
        elif p[i] == "]":
            depth -= 1
        i += 1
        if not depth:
            return i
