"""Python regular expressions as Java ones, with the same matches.

Verbose text is stripped here, as Java's own verbose mode also strips inside classes. Flags become one prefix: ``d`` keeps ``.`` and ``$``
to line feeds, ``U`` gives Unicode classes and case folding. What Java can't express raises ``Untranslatable``; such a pattern runs in Python workers.
"""

from __future__ import annotations

import re
from dataclasses import dataclass


class Untranslatable(ValueError):
    pass


FLAGS = {"I": re.I, "M": re.M, "S": re.S, "U": re.U, "X": re.X}


def python_flags(names: list[str] | tuple[str, ...]) -> tuple[int, list[str]]:
    """The flags of their letters, UNICODE always, and the letters that are unknown."""
    value = re.U
    for name in names:
        value |= FLAGS.get(name, 0)
    return value, [n for n in names if n not in FLAGS]


@dataclass(frozen=True)
class Pattern:
    """A pattern as given and, if it can be had, for Java."""

    python: str
    flags: int
    java: str | None
    groups: dict[str, int]

    @property
    def never(self) -> bool:
        return self.python == "(?!)"


def _class_end(text: str, at: int) -> int:
    """The place of the bracket that closes the class opened at ``at``."""
    i = at + 1
    if text[i : i + 1] == "^":
        i += 1
    if text[i : i + 1] == "]":
        i += 1
    while text[i] != "]":
        i += 2 if text[i] == "\\" else 1
    return i


def _java_class(body: str) -> str:
    """A class body with what only Java treats specially escaped."""
    out, i = [], 0
    while i < len(body):
        if body[i] == "\\":
            out.append(body[i : i + 2])
            i += 2
            continue
        head = i == (1 if body.startswith("^") else 0)
        out.append("\\" + body[i] if body[i] in "[&" or (body[i] == "]" and head) else body[i])
        i += 1
    return "".join(out)


def translate(pattern: str, flags: int) -> str:
    """The Java form of a valid Python pattern."""
    lead = re.match(r"\(\?([aiLmsux]+)\)", pattern)
    if lead:
        if set(lead[1]) & {"a", "L"}:
            raise Untranslatable(f"flags {lead[1]}")
        for letter in lead[1]:
            flags |= FLAGS[letter.upper()]
        pattern = pattern[lead.end() :]
    out, i, verbose = [], 0, bool(flags & re.X)
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            code = pattern[i + 1]
            if code in "NU":
                raise Untranslatable(f"\\{code}")
            out.append("\\z" if code == "Z" else pattern[i : i + 2])
            i += 2
        elif c == "[":
            end = _class_end(pattern, i)
            out.append("[" + _java_class(pattern[i + 1 : end]) + "]")
            i = end + 1
        elif verbose and c.isspace():
            i += 1
        elif verbose and c == "#":
            end = pattern.find("\n", i)
            i = len(pattern) if end < 0 else end + 1
        elif pattern.startswith("(?P", i):
            named = re.compile(r"\(\?P(?:<([A-Za-z][A-Za-z0-9]*)>|=([A-Za-z][A-Za-z0-9]*)\))").match(pattern, i)
            if not named:
                raise Untranslatable(pattern[i : i + 12])
            out.append(f"(?<{named[1]}>" if named[1] else f"\\k<{named[2]}>")
            i = named.end()
        elif pattern.startswith(("(?(", "(?a", "(?L", "(?u", "(?x", "(?-"), i):
            raise Untranslatable(pattern[i : i + 12])
        else:
            out.append(c)
            i += 1
    letters = "dU" + "".join(low for low, flag in (("i", re.I), ("m", re.M), ("s", re.S)) if flags & flag)
    return f"(?{letters})" + "".join(out)


def compile_pattern(name: str, pattern: str, flag_names: list[str] | tuple[str, ...] = ()) -> Pattern:
    """Validate a pattern and translate it; errors name it."""
    flags, _ = python_flags(flag_names)
    try:
        compiled = re.compile(pattern, flags)
    except re.error as e:
        raise ValueError(f"pattern {name!r} does not compile: {e}") from e
    if compiled.match("") and pattern:
        raise ValueError(f"pattern {name!r} matches the empty text")
    try:
        java = translate(pattern, flags)
    except Untranslatable:
        java = None
    return Pattern(pattern, flags, java, dict(compiled.groupindex))
