"""Shell-style patterns as regular expressions for ``rlike``."""

from __future__ import annotations

import re


def glob_to_regex(pattern: str) -> str:
    """Whole-string Java regex for a glob with ``*``, ``?``, ``[set]`` and ``[!set]``."""

    def piece(m: re.Match) -> str:
        token = m.group()
        if token == "*":
            return ".*"
        if token == "?":
            return "."
        if len(token) > 2 and token[0] == "[":
            negate, members = (True, token[2:-1]) if token[1] == "!" else (False, token[1:-1])
            members = re.sub(r"([\\\[\]^&])", r"\\\1", members)
            return f"[{'^' if negate else ''}{members}]"
        return re.sub(r"([^\w\s])", r"\\\1", token)

    body = re.sub(r"\*|\?|\[!?\]?[^\]]*\]|.", piece, pattern, flags=re.S)
    return rf"(?s)\A{body}\z"


class UnsupportedPattern(ValueError):
    """A pattern that is valid but that the engine of ``rlike`` cannot express."""


#: What is written in another way: escapes, sets, named groups and references, groups with a condition, and braces.
_PIECES = re.compile(
    r"\\U[0-9A-Fa-f]{8}|\\0[0-7]{0,2}|\\.|(?P<set>\[\^?\]?(?:\\.|[^\]\\])*\])|\(\?P[<=](?P<name>\w+)[>)]|(?P<condition>\(\?\()|(?P<braces>\{(?:\d+(?:,\d*)?|,\d*)\}|\{)", re.S)


def _escape(token: str) -> str:
    if token == r"\Z":
        return r"\z"
    if token.startswith(r"\U"):
        return rf"\x{{{int(token[2:], 16):x}}}"
    if token.startswith(r"\0"):
        return rf"\x{{{int(token[1:], 8):x}}}"
    return token


def _set(token: str) -> str:
    """A set: a bracket at its start, other brackets and ampersands stand for themselves."""
    head = "[^" if token.startswith("[^") else "["
    body = token[len(head) : -1]
    if body.startswith("]"):
        body = "\\" + body
    return head + re.sub(r"\\U[0-9A-Fa-f]{8}|\\0[0-7]{0,2}|\\.|[\[&]", lambda m: "\\" + m.group() if m.group() in "[&" else _escape(m.group()), body, flags=re.S) + "]"


def java_regex(pattern: str) -> str | None:
    """A Python pattern as the engine of ``rlike`` reads it, or null if it is none.

    Classes such as ``\\w`` cover all of Unicode, only a line feed ends a line, and sets, counts from nothing, lone braces, named groups
    and the end of the text have other spellings. What has no counterpart, such as a group with a condition, is an error.
    """
    from pyspark.sql import SparkSession

    try:
        re.compile(pattern)
    except (re.error, OverflowError, RecursionError):
        return None
    names: dict[str, str] = {}

    def piece(m: re.Match) -> str:
        token = m.group()
        if m.group("set"):
            return _set(token)
        if m.group("condition"):
            raise UnsupportedPattern(f"a group with a condition cannot be used: {pattern}")
        if m.group("braces"):
            return r"\{" if token == "{" else token.replace("{,", "{0,")
        if m.group("name"):
            name = names.setdefault(m.group("name"), f"g{len(names)}")
            return f"(?<{name}>" if token.startswith("(?P<") else rf"\k<{name}>"
        return _escape(token)

    body = _PIECES.sub(piece, pattern)
    spark = SparkSession.getActiveSession()
    if spark is not None:
        try:
            spark.sparkContext._jvm.java.util.regex.Pattern.compile(body)
        except Exception as e:
            raise UnsupportedPattern(f"the pattern cannot be used: {pattern}") from e
    return "(?dU)" + body
