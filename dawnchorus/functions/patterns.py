"""File-name patterns and ``{token}`` templates, compiled on the driver."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the canonical recording file name.
CANONICAL_FILENAME = (
    r"^(?P<timestamp>\d{8}T\d{6}(?:[+-]\d{4,6}|Z))_"
    r"(?P<site_name>.+)_"
    r"(?P<audio_recording_id>\d+)\."
    r"(?P<extension>.+)$"
)
PATTERN_PRESETS = {"canonical_filename": CANONICAL_FILENAME}

TOKEN = re.compile(r"\{([A-Za-z_][A-Za-z0-9_]*)\}")

# Python syntax the JVM engine lacks or reads differently (word borders follow another idea of a word).
_ONLY_PYTHON = re.compile(r"\(\?P=|\(\?P>|\(\?\(|\(\?[a-zA-Z]*[xaLu]|\\[ZNbB0-9]|\{,|\[[^\]]*(\[|&&)")
_NAMED_OPEN = re.compile(r"(?<!\\)((?:\\\\)*)\(\?P<\w+>")


@dataclass(frozen=True)
class NamePattern:
    """A regular expression with named groups, searched in a text column."""

    text: str
    groups: tuple[tuple[str, int], ...]
    jvm_text: str | None

    @classmethod
    def compile(cls, pattern: str) -> "NamePattern":
        pattern = PATTERN_PRESETS.get(pattern, pattern)
        if not isinstance(pattern, str):
            raise TypeError(f"expected a pattern as text, got {type(pattern).__name__}")
        try:
            compiled = re.compile(pattern)
        except re.error as e:
            raise ValueError(f"invalid file-name pattern: {e}") from e
        named = tuple(sorted(compiled.groupindex.items(), key=lambda g: g[1]))
        return cls(pattern, named, _for_jvm(pattern))

    @property
    def names(self) -> list[str]:
        return [name for name, _ in self.groups]

    def extract(self, c: Column) -> dict[str, Column]:
        """Group name to value; null where the pattern or the group didn't match."""
        if self.jvm_text is not None:
            return {
                name: F.nullif(F.regexp_extract(c, self.jvm_text, i), F.lit(""))
                for name, i in self.groups
            }
        found = _python_search(self.text, [i for _, i in self.groups])(c)
        return {name: F.get(found, k) for k, (name, _) in enumerate(self.groups)}


def _for_jvm(pattern: str) -> str | None:
    """The same pattern for the JVM engine, or None where it can't be exact.

    Group names go (the JVM rejects underscores in them), classes become
    Unicode-aware and ``$`` sees only ``\\n``, as in Python. The JVM reports an
    unmatched group as an empty text, so a group able to match nothing stays
    with Python.
    """
    if _ONLY_PYTHON.search(pattern):
        return None
    for opening in _NAMED_OPEN.finditer(pattern):
        body = _group_body(pattern, opening.end())
        try:
            if body is None or re.fullmatch(body, ""):
                return None
        except re.error:
            return None
    translated = _python_classes(_NAMED_OPEN.sub(r"\1(", pattern))
    return None if translated is None else "(?Ud)" + translated


# What Python's \w and \s match, as members of a JVM character class.
_MEMBERS = {"w": r"\p{L}\p{N}_", "s": r"\s\x1c-\x1f"}


def _python_classes(pattern: str) -> str | None:
    """``\\w``, ``\\s`` and their negations spelled out: the JVM counts marks as word characters.

    None for a negation inside a class, where the engines nest differently.
    """
    out, inside, i = [], False, 0
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two[0] == "\\" and len(two) == 2:
            members = _MEMBERS.get(two[1].lower())
            if members is None:
                out.append(two)
            elif two[1].islower():
                out.append(members if inside else f"[{members}]")
            elif inside:
                return None
            else:
                out.append(f"[^{members}]")
            i += 2
            continue
        if two[0] == "[" and not inside:
            inside = True
            first = i + (2 if two == "[^" else 1)
            if pattern[first : first + 1] == "]":  # a bracket in first place is a member
                out.append(pattern[i:first] + "\\]")
                i = first + 1
                continue
        elif two[0] == "]":
            inside = False
        out.append(two[0])
        i += 1
    return "".join(out)


def _group_body(pattern: str, start: int) -> str | None:
    depth, i = 1, start
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\":
            i += 2
            continue
        if ch == "[":
            close = pattern.find("]", i + 2)
            if close < 0:
                return None
            i = close
        elif ch == "(":
            depth += 1
        elif ch == ")":
            depth -= 1
            if depth == 0:
                return pattern[start:i]
        i += 1
    return None


def _python_search(pattern: str, positions: list[int]):
    @F.pandas_udf("array<string>")
    def search(s):
        import re as _re

        import pandas as pd

        find = _re.compile(pattern).search

        def groups(text):
            m = None if text is None else find(text)
            return [None if m is None else m.group(i) for i in positions]

        return pd.Series([groups(x) for x in s], index=s.index)

    return search


def fill_template(template: str, values: dict[str, Column], token: re.Pattern = TOKEN) -> Column:
    """Concatenate the literal pieces and token values of a template.

    A value is never scanned for tokens again; a null value makes the result null.
    """
    missing = sorted(set(token.findall(template)) - set(values))
    if missing:
        raise ValueError(f"no value for template tokens {missing}")
    if not template.strip():
        raise ValueError("a template can't be empty")
    pieces, at = [], 0
    for m in token.finditer(template):
        if m.start() > at:
            pieces.append(F.lit(template[at : m.start()]))
        pieces.append(values[m.group(1)])
        at = m.end()
    if at < len(template) or not pieces:
        pieces.append(F.lit(template[at:]))
    return F.concat(*pieces) if len(pieces) > 1 else pieces[0]
