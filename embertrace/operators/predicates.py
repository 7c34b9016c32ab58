"""Field tests of a detection rule as Spark columns.

All comparisons are on lower-cased text. A field that is absent makes its test
false, never NULL, so that ``not`` over it is safe.
"""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, functions as F

from embertrace.config import EngineConfig

_KEYWORDS = "keyword lists are not supported"
_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_IPV4 = rf"^{_OCTET}(\.{_OCTET}){{3}}$"


class UnsupportedRule(ValueError):
    """The rule uses a construct that can never match."""


@dataclass(frozen=True)
class RuleContext:
    """What the tests of one rule are compiled with."""

    config: EngineConfig
    report: Callable[[str], None]
    # Patterns that the rule language allows but the engine's own syntax does not.
    rejected: frozenset[str] = frozenset()


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests) if tests else F.lit(False)


def all_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, tests) if tests else F.lit(True)


def _as_text(value) -> str:
    """Text of a rule value, as compared with the event's text."""
    return str(value).lower()


def _contains(text: Column, value: str) -> Column:
    return text.contains(value) if value else text.isNotNull()


def java_pattern(pattern: str) -> str:
    """A Python regular expression in Java's syntax; raises ``re.error`` if bad."""
    re.compile(pattern)
    pattern = re.sub(r"\(\?P<", "(?<", pattern)
    return re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", pattern)


def patterns_of(detection: dict, config: EngineConfig) -> set[str]:
    """Usable regular expressions of a detection block, in Java's syntax."""
    return {pattern for _, pattern in stated_patterns(detection, config)}


def stated_patterns(detection: dict, config: EngineConfig) -> list[tuple[object, str]]:
    """Values of a detection block that are usable regular expressions, each with its form in Java's syntax."""
    found: list[tuple[object, str]] = []
    for mapping in mappings_of(detection):
        for key, value in mapping.items():
            if modifiers_of(key)[:1] == ["re"]:
                for item in value if isinstance(value, list) else [value]:
                    try:
                        found.append((item, _engine_pattern(item, config)))
                    except re.error:
                        pass
    return found


def refused_pattern(value) -> str:
    return f"regular expression {value!r} is not accepted by the engine"


def _engine_pattern(value, config: EngineConfig) -> str:
    return "(?iu)" + java_pattern(str(value) if config.documented else str(value).lower())


def _regex(text: Column, values: list, context: RuleContext) -> list[Column]:
    tests = []
    for value in values:
        try:
            pattern = _engine_pattern(value, context.config)
        except re.error:
            continue
        if pattern not in context.rejected:
            tests.append(text.rlike(pattern))
    return tests


def _regex_problems(values: list, context: RuleContext) -> Iterator[str]:
    for value in values:
        try:
            if _engine_pattern(value, context.config) in context.rejected:
                yield refused_pattern(value)
        except re.error as problem:
            yield f"bad regular expression {value!r}: {problem}"


def ipv4_number(text: Column) -> Column:
    """A dotted quad as a number, NULL for anything else."""
    octets = F.split(text, r"\.")
    number = reduce(lambda acc, i: acc * 256 + octets[i].cast("bigint"), range(1, 4), octets[0].cast("bigint"))
    return F.when(text.rlike(_IPV4), number)


def _ipv6_test(network: str) -> Callable:
    parsed = ipaddress.ip_network(network, strict=False)

    def inside(value) -> bool:
        try:
            return value is not None and ipaddress.ip_address(value) in parsed
        except ValueError:
            return False

    @F.pandas_udf("boolean")
    def in_network(addresses: pd.Series) -> pd.Series:
        return addresses.map(inside).astype(bool)

    return in_network


def _network_problems(values: list) -> Iterator[str]:
    for value in values:
        try:
            ipaddress.ip_network(_as_text(value), strict=False)
        except ValueError as problem:
            yield f"bad network {value!r}: {problem}"


def _cidr(text: Column, values: list) -> list[Column]:
    tests = []
    for value in values:
        try:
            network = ipaddress.ip_network(_as_text(value), strict=False)
        except ValueError:
            continue
        if network.version == 4:
            tests.append(ipv4_number(text).between(int(network[0]), int(network[-1])))
        else:
            tests.append(_ipv6_test(str(network))(text))
    return tests


def _windash(text: Column, values: list[str]) -> list[Column]:
    slashed = F.translate(text, "-", "/")
    return [_contains(slashed, value.replace("-", "/")) for value in values]


def modifiers_of(expression: str) -> list[str]:
    return [part.strip().lower() for part in expression.split("|")[1:]]


def field_of(expression: str) -> str:
    return expression.split("|")[0].strip().lower()


def field_test(text: Column, expression: str, expected, context: RuleContext) -> Column:
    """Test of one ``field|modifier: expected`` entry against the field's
    lower-cased column."""
    config = context.config
    modifiers = modifiers_of(expression)
    kind = modifiers[0] if modifiers else ""
    raw_values = expected if isinstance(expected, list) else [expected]
    values = [_as_text(value) for value in raw_values]

    if kind == "null":
        return text.isNull()
    if kind in ("", "exact"):
        if config.documented and None in raw_values:
            # A null in the rule means an absent field, not the text "none".
            stated = [_as_text(value) for value in raw_values if value is not None]
            return text.isNull() | F.coalesce(text.isin(stated) if stated else F.lit(False), F.lit(False))
        test = text.isin(values) if values else F.lit(False)
    elif kind == "contains":
        parts = [_contains(text, value) for value in values]
        wants_all = config.documented and modifiers[1:2] == ["all"]
        test = all_of(parts) if wants_all and parts else any_of(parts)
    elif kind == "startswith":
        test = any_of([text.startswith(value) for value in values])
    elif kind == "endswith":
        test = any_of([text.endswith(value) for value in values])
    elif kind == "re":
        test = any_of(_regex(text, raw_values, context))
    elif kind == "cidr":
        test = any_of(_cidr(text, raw_values))
    elif kind == "windash":
        test = any_of(_windash(text, values))
    else:
        test = F.lit(False)
    return F.coalesce(test, F.lit(False))


_KINDS = {"", "exact", "null", "contains", "startswith", "endswith", "re", "cidr", "windash"}


def field_problems(expression: str, expected, context: RuleContext) -> Iterator[str]:
    """What :func:`field_test` cannot evaluate of an entry; needs no session."""
    kind = (modifiers_of(expression) or [""])[0]
    raw_values = expected if isinstance(expected, list) else [expected]
    if kind == "re":
        yield from _regex_problems(raw_values, context)
    elif kind == "cidr":
        yield from _network_problems(raw_values)
    elif kind not in _KINDS:
        yield f"unknown modifier {kind!r} in {expression!r}"


def selection_problems(block, context: RuleContext) -> Iterator[str]:
    """What :func:`selection_test` cannot evaluate of a selection."""
    if isinstance(block, list):
        if any(not isinstance(item, dict) for item in block):
            raise UnsupportedRule(_KEYWORDS)
        for item in block:
            yield from selection_problems(item, context)
    elif isinstance(block, dict):
        for key, expected in block.items():
            yield from field_problems(key, expected, context)


def selection_test(block, field: Callable[[str], Column], context: RuleContext) -> Column:
    """A selection: a mapping is an AND over its fields, a list an OR over mappings."""
    if isinstance(block, list):
        if any(not isinstance(item, dict) for item in block):
            raise UnsupportedRule(_KEYWORDS)
        return any_of([selection_test(item, field, context) for item in block])
    if isinstance(block, dict):
        return all_of([field_test(field(field_of(key)), key, expected, context) for key, expected in block.items()])
    return F.lit(False)


def mappings_of(detection: dict) -> list[dict]:
    """Every field mapping of a detection block."""
    return [
        mapping for block in detection.values()
        for mapping in (block if isinstance(block, list) else [block]) if isinstance(mapping, dict)
    ]


def fields_of(detection: dict) -> set[str]:
    """Lower-cased names of the fields a detection block reads."""
    return {field_of(key) for mapping in mappings_of(detection) for key in mapping}
