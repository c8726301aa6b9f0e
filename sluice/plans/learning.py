"""Lessons of earlier policies: facts that inference starts from, kept in a small JSON file on the driver.

A fact is a kind and a text. What a policy teaches is the set of its facts less the known ones.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator, Mapping
from pathlib import Path
from typing import Any

from sluice.functions.numbers import CODES, SYMBOLS
from sluice.plans.policy import Policy, make_policy

#: Kinds of facts: currency marks, words of protected names, words for yes and no, types by column, fills by bucket.
KINDS = ("mark", "protected_word", "yes", "no", "column_type", "fill")

#: Parts of names that say nothing about their content.
COMMON = frozenset({"the", "and", "for", "column", "field", "data", "value", "table", "row"})


def name_words(name: str) -> list[str]:
    return re.findall(r"[^\W_]+", name.lower())


def facts_of(policy: Policy) -> Iterator[tuple[str, str]]:
    """Everything that a policy says beyond the built-in knowledge."""
    for mark in policy.parsing.currency_symbols:
        if mark not in (*SYMBOLS, *CODES):
            yield "mark", mark
    for name in policy.roles.protected_columns:
        yield from (("protected_word", w) for w in name_words(name) if len(w) > 2 and w not in COMMON)
    for own in policy.parsing.boolean_columns.values():
        yield from (("yes", str(v).strip().lower()) for v in own.true_values)
        yield from (("no", str(v).strip().lower()) for v in own.false_values)
    yield from (("column_type", f"{name}={kind}") for name, kind in policy.parsing.column_types.items())
    fills = policy.missing_data.imputation
    for bucket in ("numeric", "categorical", "datetime"):
        if (strategy := getattr(fills, bucket).default) != "none":
            yield "fill", f"{bucket}={strategy}"


def default_path() -> Path:
    return Path.home() / ".sluice" / "lessons.json"


class LearningStore:
    """Facts in the order in which they were learned; the first word on a column or a bucket stays."""

    def __init__(self, path: str | Path | None = None):
        self.path = Path(path) if path else default_path()
        self.facts: dict[tuple[str, str], None] = {}
        self.lessons = 0
        try:
            held = json.loads(self.path.read_text(encoding="utf-8"))
            self.facts = {(k, v): None for k in KINDS for v in held["facts"].get(k, [])}
            self.lessons = int(held["lessons"])
        except (OSError, ValueError, KeyError, TypeError, AttributeError):  # no file, or one that is no store
            pass

    def known(self, kind: str) -> list[str]:
        return [v for k, v in self.facts if k == kind]

    def mapping(self, kind: str) -> dict[str, str]:
        """Facts of the form name=value."""
        return dict(v.rsplit("=", 1) for v in self.known(kind))

    def learn(self, policy: Policy | Mapping[str, Any], builtin: Iterable[tuple[str, str]] = ()) -> int:
        """How many facts of the policy are new; the file is written only if some are."""
        policy = policy if isinstance(policy, Policy) else make_policy(policy)
        named = {(k, v.rsplit("=", 1)[0]) for k, v in self.facts if "=" in v}
        known = {*self.facts, *builtin}
        new = [f for f in dict.fromkeys(facts_of(policy)) if f not in known and (f[0], f[1].rsplit("=", 1)[0]) not in named]
        if new:
            self.facts |= dict.fromkeys(new)
            self.lessons += 1
            self.path.parent.mkdir(parents=True, exist_ok=True)
            held = {"facts": {k: self.known(k) for k in KINDS}, "lessons": self.lessons}
            self.path.write_text(json.dumps(held, indent=2, sort_keys=True, ensure_ascii=False), encoding="utf-8")
        return len(new)

    def reset(self) -> None:
        self.facts, self.lessons = {}, 0
        self.path.unlink(missing_ok=True)

    def summary(self) -> dict[str, int]:
        return {k: len(self.known(k)) for k in KINDS} | {"lessons": self.lessons}
