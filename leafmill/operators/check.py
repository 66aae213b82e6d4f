"""Rule-based validation."""

from __future__ import annotations

import tomllib
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.operators.project import Matcher, control_number

LEVELS = ("error", "warning", "info")


@dataclass(frozen=True)
class Rule:
    """A rule is broken by records that its matcher matches (``invert``: does not match)."""

    name: str
    matcher: Matcher
    level: str = "error"
    message: str = ""
    scope: Matcher | None = None
    invert: bool = False


@dataclass(frozen=True)
class RuleSet:
    rules: tuple[Rule, ...]
    scope: Matcher | None = None

    @classmethod
    def parse(cls, text: str) -> RuleSet:
        """A rule set from TOML: an optional scope and tables ``rule.<name>``."""
        said = tomllib.loads(text)
        rules = []
        for name, own in sorted(said.get("rule", {}).items()):
            level = own.get("level", "error")
            if level not in LEVELS:
                raise ValueError(f"unknown level: {level}")
            if own.get("validator", "filter") != "filter":
                raise ValueError(f"unknown validator: {own['validator']}")
            matcher = own.get("matcher", own.get("filter"))
            if matcher is None:
                raise ValueError(f"rule {name} has no matcher")
            scope = own.get("scope")
            rules.append(Rule(name, Matcher.parse(matcher), level, own.get("message", ""), Matcher.parse(scope) if scope else None, own.get("invert-match", own.get("invert-matcher", False))))
        scope = said.get("scope")
        return cls(tuple(rules), Matcher.parse(scope) if scope else None)


def check(records: DataFrame, rule_sets: Sequence[RuleSet | str]) -> DataFrame:
    """A row cn, rule, level, message for each record and rule that it breaks; all rules in one pass."""
    broken = []
    for own in (s if isinstance(s, RuleSet) else RuleSet.parse(s) for s in rule_sets):
        for rule in own.rules:
            test = ~rule.matcher.column() if rule.invert else rule.matcher.column()
            for scope in (own.scope, rule.scope):
                if scope is not None:
                    test = scope.column() & test
            row = F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.level).alias("level"), F.lit(rule.message).alias("message"))
            broken.append(F.when(test, row))
    cn = F.coalesce(control_number(), F.lit("")).alias("cn")
    if not broken:
        return records.select(cn, F.lit("").alias("rule"), F.lit("").alias("level"), F.lit("").alias("message")).where(F.lit(False))
    found = records.select(cn, F.explode(F.array_compact(F.array(*broken))).alias("b"))
    return found.select("cn", "b.rule", "b.level", "b.message")


def report_text(violations: DataFrame) -> DataFrame:
    return violations.select(F.concat_ws(": ", "cn", "rule", "level", "message").alias("line"))


def report_json(violations: DataFrame) -> DataFrame:
    """One JSON object for each violation, with the record's position, the message, the level and the rule as its type."""
    return violations.select(F.to_json(F.struct(F.struct(F.col("cn").alias("id")).alias("position"), "message", "level", F.col("rule").alias("type"))).alias("line"))
