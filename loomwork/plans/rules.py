"""Rule lists: conditions in order, and what they set.

A rule is ``(condition, {column: value})``; conditions are SQL text over the
columns of the row, values are SQL text too. A list of rules in place of a rule
holds alternatives.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Rule = tuple[str, dict[str, str]]


def first_rule(df: DataFrame, rules: Sequence[Rule], columns: Sequence[str]) -> DataFrame:
    """The first rule that holds sets its columns; without one they are null."""
    # the number of the rule is found once, so no condition is repeated per column
    which = F.expr("case " + " ".join(f"when {cond} then {i}" for i, (cond, _) in enumerate(rules)) + " end")
    out = df.withColumn("__rule", which)
    texts = {}
    for c in columns:
        cases = " ".join(f"when {i} then {new[c]}" for i, (_, new) in enumerate(rules) if c in new)
        texts[c] = F.expr(f"case __rule {cases} end") if cases else F.lit(None).cast("string")
    return out.withColumns(texts).drop("__rule")


def steps_of(rules: Sequence[Rule | list[Rule]]) -> list[list[Rule]]:
    return [step if isinstance(step, list) else [step] for step in rules]


def bind(rules: Sequence[Rule | list[Rule]], values: Mapping[str, str]) -> list[list[Rule]]:
    """The rules with some names replaced by text literals, for values that are the same in every row."""
    def put(text: str) -> str:
        # text literals are left alone
        parts = re.split(r"('(?:[^']|'')*')", text)
        return "".join(p if p.startswith("'") else re.sub(
            r"\b[A-Za-z_]\w*\b", lambda m: "'" + values[m[0]] + "'" if m[0] in values else m[0], p) for p in parts)
    return [[(put(cond), {c: put(v) for c, v in new.items()}) for cond, new in step] for step in steps_of(rules)]


def names_in(rules: Sequence[Rule | list[Rule]]) -> set[str]:
    """All names that the rules read or set (and the SQL words among them)."""
    texts = [t for step in steps_of(rules) for cond, new in step for t in (cond, *new, *new.values())]
    return {w for t in texts for w in re.findall(r"[A-Za-z_]\w*", re.sub(r"'(?:[^']|'')*'", "", t))}


def apply_rules(df: DataFrame, rules: Sequence[Rule | list[Rule]]) -> DataFrame:
    """Steps one after the other: later steps see and overwrite the results of earlier ones.

    A step is a rule or a list of alternatives, of which the first that holds
    applies. Alternatives keep the plan short: one projection per step.
    """
    for step in steps_of(rules):
        written = list(dict.fromkeys(c for _, new in step for c in new))
        tests = [cond for cond, _ in step]
        if len(written) > 2:
            # many columns: find the alternative once
            df = df.withColumn("__which", F.expr("case " + " ".join(f"when {t} then {i}" for i, t in enumerate(tests)) + " end"))
            tests = [f"__which = {i}" for i in range(len(step))]
        df = df.withColumns({c: F.expr("case " + " ".join(f"when {t} then {new.get(c, c)}" for t, (_, new) in zip(tests, step))
                                       + f" else {c} end") for c in written})
    return df.drop("__which")
