"""Rules of the readiness engine on small tables."""

import datetime as dt
import json
import math
import random
import time

import pytest
from pyspark.sql import functions as F

from sluice import cli
from sluice.functions import text
from sluice.operators import dedupe, events, impute, profile, quantiles
from sluice.plans import contracts, infer, pipeline, report
from sluice.plans.learning import LearningStore
from sluice.plans.policy import PolicyError, load_policy, make_policy, unknown_columns
from sluice.plans.score import readiness
from sluice.sources import tables
from sluice.streaming.apply import correct_stream

CLOCK = "2000-01-01T00:00:00Z"
QUIET = {"standardization": {"global_trim_whitespace": False, "global_collapse_whitespace": False, "strip_nonprinting": False}}


def frame(spark, values, kind="string"):
    return spark.createDataFrame([(i + 1, v) for i, v in enumerate(values)], f"_row_id long, v {kind}")


def corrected(spark, values, kind="string", **sections):
    return pipeline.correct(frame(spark, values, kind), make_policy(QUIET | sections), CLOCK)


def column(result, name="v"):
    return [r[name] for r in result.table(keep_row_id=True).orderBy("_row_id").collect()]


NUMBERS = [
    ("1,234.50", 1234.5), ("$5", 5.0), ("USD 5", 5.0), ("5 eur", 5.0), ("Rs. 7", 7.0), ("(12.5)", -12.5), ("–3", -3.0), ("+4", 4.0), ("++4", None),
    ("1 234 567", 1234567.0), ("85.3k", 85300.0), ("2M", 2e6), ("1.5B", 1.5e9), ("1T", 1e12), ("12%", 0.12), ("% 50", 0.5), ("5 % x", None), ("1_000", 1000.0),
    ("1d", None), ("1e3", 1000.0), (".5", 0.5), ("5.", 5.0), ("N/A", None), (" inf ", None), ("+inf", None), ("1e999", None), ("(5K)", None), ("banana", None), ("1,234.00-", None),
]


def test_numbers(spark):
    result = corrected(spark, [n for n, _ in NUMBERS], parsing={"column_types": {"v": "float"}})
    for (raw, want), got in zip(NUMBERS, column(result), strict=True):
        assert got == (pytest.approx(want) if want is not None else None), raw
    failures = {r["old_value"]: r["reason"] for r in result.events().collect()}
    assert failures["banana"] == "invalid_numeric" and failures["+inf"] == failures["1e999"] == "infinite_or_nan_value"
    assert "N/A" not in failures and " inf " not in failures


def test_percent_scale_and_symbols(spark):
    kept = corrected(spark, ["12%", "kr7"], parsing={"column_types": {"v": "float"}, "numeric": {"percent_scale": "0_100"}, "currency_symbols": ["kr"]})
    assert column(kept) == [12.0, 7.0]


DATES = [
    ("2024-02-20", "2024-02-20"), ("2024-1-5", "2024-01-05"), ("2024/2/20", "2024-02-20"), ("02/13/2024", "2024-02-13"), ("13/02/2024", "2024-02-13"), ("Feb 20th 2024", "2024-02-20"),
    ("February 20, 2024", "2024-02-20"), ("20240220", "2024-02-20"), ("20-Feb-24", "2024-02-20"), ("2024-02-20 13:05:07", "2024-02-20 13:05:07"), ("2024-02-20T13:05:07+02:00", "2024-02-20 11:05:07"),
    ("02/13/2024 1:05 PM", "2024-02-13 13:05"), ("99/99/9999", None), ("2024-02-30", None), ("today", None), ("12:30", None), ("Unknown", None), ("N/A", None),
]


def test_dates(spark):
    got = column(corrected(spark, [d for d, _ in DATES], parsing={"column_types": {"v": "date"}}))
    for (raw, want), value in zip(DATES, got, strict=True):
        assert value == (dt.datetime.fromisoformat(want) if want else None), raw


def test_dates_by_format_and_day_first(spark):
    rules = {"column_types": {"v": "date"}, "datetime": {"dayfirst": True, "allowed_formats": ["%d.%m.%y"]}}
    assert column(corrected(spark, ["03/04/2024", "05.06.24", "1600-01-01"], parsing=rules)) == [dt.datetime(2024, 4, 3), dt.datetime(2024, 6, 5), None]


def test_booleans_and_failures(spark):
    values = ["Yes", " n ", "maybe", "", None, "1"]
    assert column(corrected(spark, values, parsing={"column_types": {"v": "boolean"}})) == [True, False, None, None, None, True]
    own = {"column_types": {"v": "boolean"}, "boolean_columns": {"v": {"true_values": ["maybe"], "false_values": []}}}
    assert column(corrected(spark, values, parsing=own))[2] is True
    dropped = corrected(spark, values, parsing={"column_types": {"v": "boolean"}, "boolean": {"on_failure": "drop_row"}})
    assert len(column(dropped)) == 5
    assert sorted(r["event_type"] for r in dropped.events().collect()) == ["parsing_failure", "row_dropped"]


def test_text_steps(spark):
    assert column(corrected(spark, ["  a\t b  c ", "ﬁ​x\x07", None], standardization={})) == ["a b c", "fix", None]
    titles = ["o'neil sao-paulo x1y", "straße ÉTÉ", "", None]
    got = [r["t"] for r in frame(spark, titles).orderBy("_row_id").select(text.title(F.col("v")).alias("t")).collect()]
    assert got == ["O'Neil Sao-Paulo X1Y", "Straße Été", "", None]
    assert column(corrected(spark, ["São Brasília"], standardization=QUIET["standardization"] | {"asciify": True})) == ["Sao Brasilia"]


def test_changes_are_events_and_protected_columns_stay(spark):
    result = pipeline.correct(frame(spark, [" a  b "]).withColumn("p", F.lit("  x ")), make_policy({"roles": {"protected_columns": ["p"]}, "standardization": {"casefold": "upper"}}), CLOCK)
    assert column(result) == ["A B"] and column(result, "p") == ["  x "]
    assert sorted(r["reason"] for r in result.events().collect()) == ["casefold_upper", "collapse_whitespace", "trim_whitespace"]


def test_validity_null_is_seen_by_later_rules(spark):
    rules = {"on_violation": "null", "ranges": {"v": {"min": 0, "max": 10}}, "non_negative_columns": ["v"]}
    result = corrected(spark, [-1.0, 5.0, 11.0, None, float("nan")], "double", validity_rules=rules)
    assert column(result)[:4] == [None, 5.0, None, None]
    assert {r["reason"]: r["violation_count"] for r in result.events().collect()} == {"non_negative: Value must be >= 0 (1 rows)": 1, "range_max: Value > 10 (1 rows)": 1}


def test_validity_regex_matches_the_start(spark):
    dropped = corrected(spark, ["ab1", "xab", None], validity_rules={"on_violation": "drop_row", "regex": {"v": "ab"}})
    assert column(dropped) == ["ab1", None]
    assert sorted(r["event_type"] for r in dropped.events().collect()) == ["validity_drop", "validity_drop_row"]


def test_critical_rows_and_imputation(spark):
    df = spark.createDataFrame([(1, "a", 1.0, "x"), (2, " NaN ", 2.0, "y"), (3, "b", None, "n/a"), (4, "c", 9.0, "x")], "_row_id long, k string, n double, c string")
    policy = make_policy(QUIET | {"roles": {"critical_columns": ["k"]}, "missing_data": {"imputation": {"numeric": {"default": "median", "allow_if_missing_pct_leq": 0.5}, "categorical": {"default": "mode", "allow_if_missing_pct_leq": 0.5}}}})
    result = pipeline.correct(df, policy, CLOCK)
    assert [tuple(r) for r in result.table().orderBy("k").collect()] == [("a", 1.0, "x"), ("b", 5.0, "x"), ("c", 9.0, "x")]
    assert sorted(r["event_type"] for r in result.events().collect()) == ["imputation_fill", "imputation_fill", "row_dropped"]


def test_imputation_bounds_constants_and_given_statistics(spark):
    values = [1.0, None, None, 3.0]
    skipped = corrected(spark, values, "double", missing_data={"imputation": {"numeric": {"default": "mean"}}})
    assert column(skipped) == values
    assert [r["reason"] for r in skipped.events().collect()] == ["missing_pct_0.5000_gt_0.2000"]
    loose = {"numeric": {"default": "mean", "allow_if_missing_pct_leq": 1.0}}
    policy = make_policy(QUIET | {"missing_data": {"imputation": loose}})
    assert column(pipeline.correct(frame(spark, values, "double"), policy, CLOCK, {"v": {"mean": 7.0}})) == [1.0, 7.0, 7.0, 3.0]
    fixed = {"numeric": loose["numeric"] | {"constants": {"v": -1}}}
    assert column(corrected(spark, values, "double", missing_data={"imputation": fixed})) == [1.0, -1.0, -1.0, 3.0]


@pytest.mark.parametrize("near", [20_000, 5])
def test_quantiles_are_exact(spark, monkeypatch, near):
    monkeypatch.setattr(quantiles, "NEAR", near)
    rng = random.Random(3)
    rows = [(rng.choice([None, float("nan"), -math.inf, rng.gauss(0, 1), float(rng.randrange(4))]), 7.0 if i % 3 else None, i) for i in range(4000)]
    df = spark.createDataFrame(rows, "a double, b double, c long").withColumn("d", F.lit(None).cast("double"))
    shares = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    got = quantiles.quantiles(df, {n: (F.col(n), shares) for n in "abcd"})
    want = df.select(*[F.percentile(F.nanvl(F.col(n).cast("double"), F.lit(None)), shares).alias(n) for n in "abc"]).first()
    for n in "abc":
        assert got[n] == pytest.approx(want[n]), n
    assert got["d"] == [None] * 6
    texts = spark.createDataFrame([("x", "q"), ("y", None), ("y", None), ("x", None)], "a string, b string").withColumn("c", F.lit(None).cast("string"))
    assert quantiles.modes(texts, {n: F.col(n) for n in "abc"}) == {"a": "x", "b": "q", "c": None}


def test_long_mappings_are_joined(spark):
    entries = {str(i): str(i + 1) for i in range(3000)}
    result = corrected(spark, ["5", "2999", "x", None], standardization=QUIET["standardization"] | {"mappings": {"v": entries}})
    assert column(result) == ["6", "3000", "x", None] and result.events().count() == 2


def test_json_has_no_bare_words(tmp_path):
    tables.write_json({"a": float("nan"), "b": [math.inf, {"c": dt.date(2024, 1, 1)}], 3: True}, tmp_path / "x.json")
    assert json.loads((tmp_path / "x.json").read_text(), parse_constant=pytest.fail) == {"a": None, "b": [None, {"c": "2024-01-01"}], "3": True}
    assert json.loads(events.json_line({"v": -math.inf}), parse_constant=pytest.fail) == {"v": None}


def test_csv_with_line_ends_in_fields(spark, tmp_path):
    (tmp_path / "x.csv").write_text('a,b\n1,"two\nlines"\n2,c\n', encoding="utf-8")
    assert [r["b"] for r in tables.read_csv(spark, str(tmp_path / "x.csv"), multiline=True).orderBy("_row_id").collect()] == ["two\nlines", "c"]


def test_output_options(spark, tmp_path):
    (tmp_path / "x.csv").write_text("k,v\na,1\nb,x\n", encoding="utf-8")
    (tmp_path / "p.yaml").write_text("output: {include_audit_log: false, include_before_after_scores: false, save_intermediate: true}\nparsing: {column_types: {v: float}}\n")
    args = ["correct", "--input", str(tmp_path / "x.csv"), "--policy", str(tmp_path / "p.yaml"), "--out", str(tmp_path / "out"), "--audit", str(tmp_path / "a.jsonl"), "--report", str(tmp_path / "r.json")]
    assert cli.main([*args, "--store", str(tmp_path / "s.json"), "--quiet"], spark) == 0
    assert not (tmp_path / "a.jsonl").exists() and "readiness" not in json.loads((tmp_path / "r.json").read_text())
    assert spark.read.parquet(str(tmp_path / "out.cleaned")).count() == 2


def test_duplicates_and_sparse_rows(spark):
    df = spark.createDataFrame([(1, "a", 1), (2, "a", 1), (3, "a", 5), (4, None, 2), (5, None, 3)], "_row_id long, k string, n long")
    own = make_policy({"deduplication": {"keys": ["k"], "strategy": "keep_max", "order_by": "n"}})
    assert sorted(r["_row_id"] for r in events.kept(dedupe.deduplicate(events.start(df), own)).collect()) == [3, 5]
    half = make_policy({"missing_data": {"drop_thresholds": {"row_missing_pct_gt": 0.4}}})
    assert sorted(r["_row_id"] for r in events.kept(impute.drop_sparse_rows(events.start(df), half)).collect()) == [1, 2, 3]


def test_profile_and_score(spark):
    df = spark.createDataFrame([(1, "1", "x"), (2, "bad", "x"), (3, "", None), (4, "1", "x")], "_row_id long, n string, c string")
    policy = make_policy({"dataset": {"name": "d", "primary_key": {"columns": ["n"]}}, "roles": {"critical_columns": ["n"]}, "parsing": {"column_types": {"n": "float"}}})
    found = profile.profile(df, policy, CLOCK)
    contracts.validate_profile(found)
    n = found["columns"]["n"]
    assert (n["role"], n["effective_missing_pct"], n["invalid_count"], n["unique_pct"]) == ("critical", 0.25, 1, 0.75)
    assert n["frequent_values"][0] == {"value": "1", "count": 2} and n["stats"]["std"] == 0.0
    assert found["duplicates"] == {"exact_row_dupe_count": 1, "pk_dupe_count": 1}
    assert found["readiness"]["score"] == round(40 * (2 * 0.75 + 0.75) / 3 + 30 * 0.75 + 20 * 0.75 + 10 - 10, 2)
    assert readiness(profile.profile(df.limit(0), policy, CLOCK))["score"] == 0.0


def test_policies():
    for bad in (
        {"parsing": {"column_types": {"a": "money"}}},
        {"roles": {"protected_columns": ["a"], "fillable_columns": ["a"]}},
        {"deduplication": {"strategy": "keep_max"}},
        {"outliers": {"cap_quantiles": [0.9, 0.1]}},
        {"missing_data": {"drop_thresholds": {"row_missing_pct_gt": 2}}},
        {"standardization": {"casefold": "odd"}},
        {"roles": {"protected_columns": ["a"]}, "standardization": {"mappings": {"a": {"x": "y"}}}},
    ):
        with pytest.raises(PolicyError):
            make_policy(bad)
    one, two = make_policy({"dataset": {"name": "a"}, "note": 1}), make_policy({"dataset": {"name": "b"}})
    assert len(one.reproducibility.policy_hash) == 16 and one.reproducibility.policy_hash != two.reproducibility.policy_hash
    assert make_policy({"roles": {"critical_columns": [" a  b ", "a b"]}}).roles.critical_columns == ["a b"]
    assert unknown_columns(make_policy({"roles": {"critical_columns": ["x"]}}), ["y"]) == ["roles.critical_columns: no column 'x'"]


MESSY = [
    "customer_id,signup date,annual_salary,is_active,email,city_name",
    *(f"CUST_{i:04d},2024/0{1 + i % 9}/1{i % 10},{'"$1,2' + str(10 + i) + '.50"' if i % 2 else str(900 + i)},{'Yes' if i % 3 else 'no'},u{i}@x.org,  são {i} " for i in range(30)),
    "CUST_0099,Unknown,N/A,maybe,NULL,x,too,long",
    "CUST_0100,2024/01/01",
]


def test_csv_scan(spark, tmp_path):
    path = tmp_path / "messy.csv"
    path.write_text("﻿" + "\n".join(MESSY) + "\n", encoding="utf-8")
    df = tables.read_csv(spark, str(path))
    assert df.columns == ["customer_id", "signup date", "annual_salary", "is_active", "email", "city_name", "_row_id"]
    rows = {r["customer_id"]: r for r in df.collect()}
    assert "CUST_0099" not in rows and rows["CUST_0100"]["email"] is None and rows["CUST_0000"]["_row_id"] == 1
    assert sorted(r["_row_id"] for r in rows.values()) == list(range(1, 32))
    assert tables.distinct_names(["a", "a", " b "]) == ["a", "a.1", "b"]
    assert tables.read_csv(spark, str(path), limit=3).count() == 3


def test_row_ids_are_dense_over_partitions(spark):
    ids = tables.with_row_ids(spark.range(0, 1000, 1, 7).toDF("x")).collect()
    assert [r["_row_id"] for r in sorted(ids, key=lambda r: r["x"])] == list(range(1, 1001))
    own = tables.with_row_ids(spark.createDataFrame([("2.7",), ("x",), (None,)], "_row_id string"))
    assert [r[0] for r in own.collect()] == [2, None, None]


def test_types_from_values(spark):
    df = spark.createDataFrame([("1", "1.5", "true", "x"), ("2", None, "False", "1")], "a string, b string, c string, d string")
    assert [f.dataType.simpleString() for f in tables.typed_by_values(df).schema.fields] == ["bigint", "double", "boolean", "string"]


def test_inferred_policy_corrects_its_table(spark, tmp_path):
    path, out = tmp_path / "messy.csv", tmp_path / "out"
    path.write_text("\n".join(MESSY) + "\n", encoding="utf-8")
    store = ["--store", str(tmp_path / "store.json")]
    assert cli.main(["infer", "--input", str(path), "--out", str(tmp_path / "p.yaml"), *store], spark) == 0
    policy = load_policy(tmp_path / "p.yaml")
    assert policy.parsing.column_types == {"signup date": "datetime", "annual_salary": "float", "is_active": "boolean"}
    assert "customer_id" in policy.roles.critical_columns and "email" in policy.roles.protected_columns
    assert policy.standardization.casefold == "title" and policy.validity_rules.ranges == {"annual_salary": {"min": 0}}
    common = ["correct", "--input", str(path), "--out", str(out), "--audit", str(tmp_path / "audit.jsonl"), "--clock", CLOCK, *store]
    assert cli.main([*common, "--policy", str(tmp_path / "p.yaml"), "--report", str(tmp_path / "r.json"), "--report-md", str(tmp_path / "r.md")], spark) == 0
    contracts.validate_audit_log(tmp_path / "audit.jsonl")
    contracts.validate_report(json.loads((tmp_path / "r.json").read_text()))
    assert "# Correction Report" in (tmp_path / "r.md").read_text()
    rows = {r["customer_id"]: r for r in spark.read.parquet(str(out)).collect()}
    assert rows["CUST_0001"]["annual_salary"] == 1211.5 and rows["CUST_0001"]["is_active"] is True
    assert cli.main([*common, "--auto-policy", "--audit-detail", "detailed"], spark) == 0
    contracts.validate_audit_log(tmp_path / "audit.jsonl")
    assert cli.main(["profile", "--input", str(path), "--policy", str(tmp_path / "p.yaml"), "--out", str(tmp_path / "pr.json"), "--compare"], spark) == 0
    assert json.loads((tmp_path / "pr.json").read_text())["readiness"]["transformation"]["delta"]["score"] >= 0
    assert cli.main(["correct", "--input", str(path), "--out", str(out), "--audit", str(tmp_path / "a"), "--policy", str(tmp_path / "none.yaml")], spark) == 2


def test_learning(tmp_path):
    store = LearningStore(tmp_path / "s.json")
    policy = {
        "parsing": {"currency_symbols": ["kr", "$"], "boolean_columns": {"a": {"true_values": ["Aye"], "false_values": []}}, "column_types": {"a": "boolean"}},
        "roles": {"protected_columns": ["the_secret_col"]},
        "missing_data": {"imputation": {"numeric": {"default": "mean"}}},
    }
    assert store.learn(policy) == 6 and store.learn(policy) == 0
    again = LearningStore(tmp_path / "s.json")
    assert again.known("protected_word") == ["secret", "col"] and again.known("yes") == ["aye"] and again.known("mark") == ["kr"]
    assert again.mapping("fill") == {"numeric": "mean"} and again.mapping("column_type") == {"a": "boolean"}
    assert again.learn({"missing_data": {"imputation": {"numeric": {"default": "median"}}}}) == 0
    assert infer.protected_name("my_secret", again.known("protected_word")) and not infer.protected_name("my_secret")
    assert infer.protected_name("Diagnosis_2") and infer.protected_name("firstname") and not infer.protected_name("sums")
    again.reset()
    assert LearningStore(tmp_path / "s.json").summary()["lessons"] == 0


def test_inference_uses_lessons(spark, tmp_path):
    store = LearningStore(tmp_path / "s.json")
    store.learn({"parsing": {"currency_symbols": ["kr"]}, "missing_data": {"imputation": {"numeric": {"default": "mean"}}}})
    rows = [(i, f"kr {i}", "USD 5 EUR", f"{1 + i % 12}/{1 + i % 28}/2024") for i in range(40)]
    df = spark.createDataFrame(rows, "_row_id long, fee_amount string, odd string, date_started string")
    found = infer.infer_policy(df, "t", store)
    assert found["parsing"]["column_types"] == {"fee_amount": "float", "date_started": "datetime"} and found["parsing"]["currency_symbols"] == ["kr"]
    assert found["missing_data"]["imputation"]["numeric"] == {"default": "mean"}
    assert column(pipeline.correct(df, make_policy(found), CLOCK), "fee_amount")[7] == 7.0


def test_report_names_violations(spark):
    df = frame(spark, [-1.0, 2.0], "double")
    policy = make_policy({"roles": {"protected_columns": ["v"]}, "validity_rules": {"ranges": {"v": {"min": 0}}}})
    result = pipeline.correct(df, policy, CLOCK)
    before = profile.profile(df, policy, CLOCK)
    made = report.build_report(before, profile.profile(result.table(True), policy, CLOCK), result.events(), policy, result.steps)
    assert made["compliance"]["protected_columns"]["status"] == "fail" and made["readiness"]["delta"]["score"] == 0
    assert "column=v event=validity_flag" in report.markdown(made)


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([(1, " $5 "), (2, "x"), (3, "-1")], "_row_id long, v string")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    policy = make_policy({"parsing": {"column_types": {"v": "float"}}, "validity_rules": {"on_violation": "null", "non_negative_columns": ["v"]}})
    told = []
    correct_stream(stream, policy, str(tmp_path / "out"), str(tmp_path / "audit"), str(tmp_path / "check"), clock=CLOCK, progress=lambda *b: told.append(b)).awaitTermination(120)
    assert sorted(r["v"] or 0 for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0, 0, 5.0]
    assert {r["reason"] for r in spark.read.json(str(tmp_path / "audit")).collect()} == {"invalid_numeric", "trim_whitespace", "non_negative: Value must be >= 0 (1 rows)"}
    for _ in range(50):
        if told:
            break
        time.sleep(0.1)
    assert told[-1][2] == 3
