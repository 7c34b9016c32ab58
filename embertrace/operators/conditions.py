"""Rule conditions rewritten as Spark SQL boolean expressions.

Catalyst parses the result, so nesting and precedence are Spark's own. Only the
words of the rule language are replaced: selection names and quantifiers become
column names.
"""

from __future__ import annotations

import re
from collections.abc import Callable

_QUANTIFIER = re.compile(r"\b(1|all)\s+of\s+(\w+)\*?", re.IGNORECASE)
_TOKEN = re.compile(r"[()]|[^\s()]+")


def _group(how: str, names: list[str], columns: dict[str, str]) -> str:
    if not names:
        return "false"  # a quantifier over nothing, as an unknown name, is never true
    glue = " AND " if how == "all" else " OR "
    return "(" + glue.join(f"`{columns[name]}`" for name in names) + ")"


def documented_sql(condition: str, columns: dict[str, str], report: Callable[[str], None]) -> str:
    """Usual precedence: ``not`` binds tightest, then ``and``, then ``or``."""
    groups: list[str] = []

    def quantified(match: re.Match) -> str:
        how, prefix = match.group(1).lower(), match.group(2).lower()
        names = [n for n in columns if prefix == "them" or n.lower().startswith(prefix)]
        if not names:
            report(f"no selection is called {match.group(2)}*")
        groups.append(_group(how, names, columns))
        return f" \x00{len(groups) - 1} "

    words = []
    for token in _TOKEN.findall(_QUANTIFIER.sub(quantified, condition)):
        if token in "()" or token.lower() in ("and", "or", "not"):
            words.append(token.upper())
        elif token.startswith("\x00"):
            words.append(groups[int(token[1:])])
        elif token in columns:
            words.append(f"`{columns[token]}`")
        else:
            report(f"unknown selection {token!r}")
            words.append("false")
    # The outer parentheses keep a stray word from being read as an alias.
    return "(" + " ".join(words) + ")"
