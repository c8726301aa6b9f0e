"""Policies: what to clean and how, validated on the driver before any plan is built."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Mapping
from dataclasses import asdict, dataclass, field, fields, is_dataclass
from pathlib import Path
from typing import Any, get_type_hints

# The choices of the policy format.
CHOICES = {
    "percent_scale": ("auto", "0_1", "0_100"),
    "on_failure": ("null", "drop_row", "keep_raw"),
    "casefold": ("none", "lower", "upper", "title"),
    "strategy": ("keep_first", "keep_last", "keep_max", "keep_min"),
    "exact_row_duplicates": ("drop", "keep"),
    "on_violation": ("flag", "null", "drop_row"),
    "method": ("iqr", "zscore"),
    "action": ("flag", "cap", "drop_row"),
    "format": ("parquet", "csv"),
    "audit_detail": ("summary", "detailed"),
}
DEFAULTS = {"NumericImputation": ("none", "mean", "median", "constant"), "CategoricalImputation": ("none", "mode", "constant"), "DatetimeImputation": ("none", "constant")}
NUMBERS, TIMES = ("numeric", "integer", "float"), ("datetime", "date", "timestamp")
TYPES = ("boolean", *NUMBERS, *TIMES, "text", "categorical")


class PolicyError(ValueError):
    """A policy that cannot be used, with every reason."""


def tidy(name: str) -> str:
    """A column name without outer and repeated white space."""
    return " ".join(str(name).split())


def _unique(names: Iterable[str]) -> list[str]:
    return list(dict.fromkeys(tidy(n) for n in names))


@dataclass
class Dataset:
    name: str = "unknown"
    description: str = ""
    expected_granularity: str = ""
    primary_key: dict = field(default_factory=lambda: {"columns": [], "mode": "infer_or_use"})
    time_column: dict = field(default_factory=lambda: {"column": None, "mode": "infer_or_use"})

    def check(self):
        if self.primary_key.get("mode", "infer_or_use") not in ("infer_or_use", "use_only"):
            yield "dataset.primary_key.mode: infer_or_use or use_only"
        if not isinstance(self.primary_key.get("columns", []), list):
            yield "dataset.primary_key.columns: a list"
        mode = self.time_column.get("mode", "infer_or_use")
        if mode not in ("infer_or_use", "use_only", "none"):
            yield "dataset.time_column.mode: infer_or_use, use_only or none"
        if mode == "use_only" and not self.time_column.get("column"):
            yield "dataset.time_column.column: needed for use_only"


@dataclass
class Roles:
    critical_columns: list = field(default_factory=list)
    protected_columns: list = field(default_factory=list)
    standardize_columns: list = field(default_factory=list)
    fillable_columns: list = field(default_factory=list)
    droppable_columns: list = field(default_factory=list)

    def check(self):
        for f in fields(self):
            setattr(self, f.name, _unique(getattr(self, f.name)))
        for what in ("standardize", "fillable"):
            if both := sorted(set(self.protected_columns) & set(getattr(self, f"{what}_columns"))):
                yield f"roles: protected columns are not {what}: {both}"


@dataclass
class DatetimeParsing:
    dayfirst: bool = False
    yearfirst: bool = False
    allowed_formats: list = field(default_factory=list)
    on_failure: str = "null"


@dataclass
class NumericParsing:
    allow_commas: bool = True
    allow_currency_symbols: bool = True
    allow_percent_symbol: bool = True
    percent_scale: str = "auto"
    on_failure: str = "null"


@dataclass
class BooleanParsing:
    true_values: list = field(default_factory=lambda: ["true", "t", "yes", "y", "1"])
    false_values: list = field(default_factory=lambda: ["false", "f", "no", "n", "0"])
    on_failure: str = "null"


@dataclass
class Parsing:
    infer_types: bool = True
    column_types: dict = field(default_factory=dict)
    datetime: DatetimeParsing = field(default_factory=DatetimeParsing)
    numeric: NumericParsing = field(default_factory=NumericParsing)
    boolean: BooleanParsing = field(default_factory=BooleanParsing)
    currency_symbols: list = field(default_factory=list)
    boolean_columns: dict = field(default_factory=dict)

    def check(self):
        self.column_types = {tidy(k): v for k, v in self.column_types.items()}
        for name, kind in self.column_types.items():
            if kind not in TYPES:
                yield f"parsing.column_types: {name!r} is {kind!r}, not one of {sorted(TYPES)}"
        own = {}
        for name, given in self.boolean_columns.items():
            own[tidy(name)] = given if isinstance(given, BooleanParsing) else _build(BooleanParsing, given or {}, "parsing.boolean_columns", [])
        self.boolean_columns = own

    def boolean_for(self, name: str) -> BooleanParsing:
        return self.boolean_columns.get(name, self.boolean)


@dataclass
class Standardization:
    global_trim_whitespace: bool = True
    global_collapse_whitespace: bool = True
    casefold: str = "none"
    mappings: dict = field(default_factory=dict)
    strip_nonprinting: bool = True
    asciify: bool = False

    def check(self):
        self.mappings = {tidy(k): dict(v) for k, v in self.mappings.items()}
        yield from ()


@dataclass
class Deduplication:
    enabled: bool = True
    keys: list = field(default_factory=list)
    strategy: str = "keep_first"
    order_by: str | None = None
    exact_row_duplicates: str = "drop"

    def check(self):
        self.keys = _unique(self.keys)
        self.order_by = tidy(self.order_by) if self.order_by else None
        if self.strategy in ("keep_max", "keep_min") and not self.order_by:
            yield "deduplication.order_by: needed for keep_max and keep_min"
        if "" in self.keys:
            yield "deduplication.keys: an empty name"


@dataclass
class NumericImputation:
    default: str = "none"
    constants: dict = field(default_factory=dict)
    allow_if_missing_pct_leq: float = 0.2


@dataclass
class CategoricalImputation:
    default: str = "none"
    constants: dict = field(default_factory=dict)
    allow_if_missing_pct_leq: float = 0.2


@dataclass
class DatetimeImputation:
    default: str = "none"
    constants: dict = field(default_factory=dict)
    allow_if_missing_pct_leq: float = 0.05


@dataclass
class Imputation:
    numeric: NumericImputation = field(default_factory=NumericImputation)
    categorical: CategoricalImputation = field(default_factory=CategoricalImputation)
    datetime: DatetimeImputation = field(default_factory=DatetimeImputation)

    def check(self):
        for bucket in (self.numeric, self.categorical, self.datetime):
            bucket.constants = {tidy(k): v for k, v in bucket.constants.items()}
        yield from ()


@dataclass
class MissingData:
    enabled: bool = True
    drop_if_missing_critical: bool = True
    drop_thresholds: dict = field(default_factory=lambda: {"row_missing_pct_gt": None, "col_missing_pct_gt": None})
    imputation: Imputation = field(default_factory=Imputation)

    def check(self):
        for name in ("row_missing_pct_gt", "col_missing_pct_gt"):
            value = self.drop_thresholds.get(name)
            if value is not None and not 0 <= float(value) <= 1:
                yield f"missing_data.drop_thresholds.{name}: between 0 and 1"


@dataclass
class ValidityRules:
    enabled: bool = True
    ranges: dict = field(default_factory=dict)
    allowed_values: dict = field(default_factory=dict)
    regex: dict = field(default_factory=dict)
    non_negative_columns: list = field(default_factory=list)
    on_violation: str = "flag"

    def check(self):
        for name in ("ranges", "allowed_values", "regex"):
            setattr(self, name, {tidy(k): v for k, v in getattr(self, name).items()})
        self.non_negative_columns = _unique(self.non_negative_columns)
        yield from ()


@dataclass
class Outliers:
    enabled: bool = True
    method: str = "iqr"
    action: str = "flag"
    cap_quantiles: list = field(default_factory=lambda: [0.01, 0.99])
    apply_to_columns: list = field(default_factory=list)
    exclude_protected: bool = True

    def check(self):
        self.cap_quantiles = list(self.cap_quantiles)
        if len(self.cap_quantiles) != 2 or not 0 <= self.cap_quantiles[0] < self.cap_quantiles[1] <= 1:
            yield "outliers.cap_quantiles: two shares in order"
        self.apply_to_columns = _unique(self.apply_to_columns)


@dataclass
class Output:
    format: str = "parquet"
    include_audit_log: bool = True
    include_before_after_scores: bool = True
    audit_detail: str = "summary"
    save_intermediate: bool = False


@dataclass
class Reproducibility:
    random_seed: int = 42
    policy_hash: str = "auto"


@dataclass
class Policy:
    version: str = "1.0"
    dataset: Dataset = field(default_factory=Dataset)
    roles: Roles = field(default_factory=Roles)
    parsing: Parsing = field(default_factory=Parsing)
    standardization: Standardization = field(default_factory=Standardization)
    deduplication: Deduplication = field(default_factory=lambda: Deduplication())
    missing_data: MissingData = field(default_factory=MissingData)
    validity_rules: ValidityRules = field(default_factory=ValidityRules)
    outliers: Outliers = field(default_factory=Outliers)
    output: Output = field(default_factory=Output)
    reproducibility: Reproducibility = field(default_factory=Reproducibility)

    def check(self):
        protected = set(self.roles.protected_columns)
        if bad := sorted(protected & set(self.standardization.mappings)):
            yield f"standardization.mappings: protected columns {bad}"
        fill = self.missing_data.imputation
        if bad := sorted(protected & {*fill.numeric.constants, *fill.categorical.constants, *fill.datetime.constants}):
            yield f"imputation constants: protected columns {bad}"

    def to_dict(self) -> dict[str, Any]:
        return asdict(self)


def _build(kind: type, given: Mapping[str, Any], where: str, problems: list[str]):
    """A section from its mapping; unknown keys are ignored, as the format allows notes."""
    if not isinstance(given, Mapping):
        problems.append(f"{where}: a mapping")
        return kind()
    hints, values = get_type_hints(kind), {}
    for f in fields(kind):
        if f.name not in given or given[f.name] is None and not is_dataclass(hints[f.name]) and f.name != "order_by":
            continue
        value, hint = given[f.name], hints[f.name]
        if is_dataclass(hint):
            value = _build(hint, value or {}, f"{where}.{f.name}".lstrip("."), problems)
        elif hint in (list, dict) and not isinstance(value, (list, tuple) if hint is list else Mapping):
            problems.append(f"{where}.{f.name}: a {'list' if hint is list else 'mapping'}")
            continue
        elif hint is bool and not isinstance(value, bool) or hint is float and (isinstance(value, bool) or not isinstance(value, (int, float))):
            problems.append(f"{where}.{f.name}: a {'truth value' if hint is bool else 'number'}")
            continue
        allowed = DEFAULTS.get(kind.__name__) if f.name == "default" else CHOICES.get(f.name)
        if allowed and value not in allowed:
            problems.append(f"{where}.{f.name}: {value!r} is not one of {list(allowed)}")
            continue
        values[f.name] = value
    made = kind(**values)
    if hasattr(made, "check"):
        problems.extend(made.check())
    return made


def policy_hash(policy: Policy) -> str:
    plain = policy.to_dict()
    plain["reproducibility"]["policy_hash"] = ""
    text = json.dumps(plain, sort_keys=True, separators=(",", ":"), ensure_ascii=True, default=str)
    return hashlib.sha256(text.encode()).hexdigest()[:16]


def make_policy(given: Mapping[str, Any] | None = None) -> Policy:
    """A checked policy; missing sections have their defaults. PolicyError lists all problems."""
    problems: list[str] = []
    policy = _build(Policy, given or {}, "", problems)
    if problems:
        raise PolicyError("; ".join(problems))
    if policy.reproducibility.policy_hash == "auto":
        policy.reproducibility.policy_hash = policy_hash(policy)
    return policy


def load_policy(path: str | Path) -> Policy:
    import yaml

    try:
        given = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    except (OSError, yaml.YAMLError) as error:
        raise PolicyError(f"policy file: {error}") from error
    if given is not None and not isinstance(given, Mapping):
        raise PolicyError("the policy file holds no mapping")
    return make_policy(given)


def save_policy(given: Mapping[str, Any] | Policy, path: str | Path) -> None:
    import yaml

    plain = given.to_dict() if isinstance(given, Policy) else dict(given)
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(yaml.safe_dump(plain, sort_keys=False, allow_unicode=True), encoding="utf-8")


def against_columns(policy: Policy, columns: Iterable[str]) -> tuple[list[str], list[str]]:
    """(errors, warnings) of a policy for a table with these columns. Errors stop a run."""
    have, errors, warnings = set(columns), [], []
    critical = set(policy.roles.critical_columns)
    if absent := sorted(critical - have):
        errors.append(f"critical columns not in the table: {absent}")
    for bucket in ("numeric", "categorical", "datetime"):
        share = getattr(policy.missing_data.imputation, bucket).allow_if_missing_pct_leq
        if not 0 <= share <= 1:
            errors.append(f"imputation.{bucket}.allow_if_missing_pct_leq: between 0 and 1, not {share}")
    if absent := sorted(set(policy.parsing.column_types) - have - critical):
        warnings.append(f"typed columns not in the table: {absent}")
    if critical and not policy.missing_data.drop_if_missing_critical:
        warnings.append("rows without critical values stay: drop_if_missing_critical is off")
    if absent := sorted(set(policy.dataset.primary_key.get("columns", [])) - have):
        warnings.append(f"primary key columns not in the table: {absent}")
    return errors, warnings


def unknown_columns(policy: Policy, columns: Iterable[str]) -> list[str]:
    """A warning for every mention of a column that the table lacks."""
    have = {tidy(c) for c in columns}
    fill = policy.missing_data.imputation
    named = {
        **{f"roles.{f.name}": getattr(policy.roles, f.name) for f in fields(policy.roles)},
        "parsing.column_types": policy.parsing.column_types,
        "standardization.mappings": policy.standardization.mappings,
        "deduplication.keys": policy.deduplication.keys,
        "deduplication.order_by": [policy.deduplication.order_by] if policy.deduplication.order_by else [],
        **{f"missing_data.imputation.{b}.constants": getattr(fill, b).constants for b in ("numeric", "categorical", "datetime")},
        **{f"validity_rules.{n}": getattr(policy.validity_rules, n) for n in ("ranges", "allowed_values", "regex", "non_negative_columns")},
        "outliers.apply_to_columns": policy.outliers.apply_to_columns,
        "dataset.primary_key.columns": policy.dataset.primary_key.get("columns", []),
        "dataset.time_column.column": [c for c in [policy.dataset.time_column.get("column")] if c],
    }
    return [f"{where}: no column {name!r}" for where, names in named.items() for name in names if name not in have]
