import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tidemark import cli
from tidemark.operators import splits
from tidemark.plans import contracts, fingerprints, ledgers, manifest, provenance, reports
from tidemark.plans.alphas import Alpha, AlphaMetadata, AlphaRegistry
from tidemark.plans.dataset import horizon_of, research_dataset
from tidemark.schema import PanelError

CLOCK = lambda: dt.datetime(2024, 2, 1, tzinfo=dt.UTC)


def definition(**change):
    return contracts.FeatureDefinition(**({"name": "volume_x", "family": "f", "description": "d", "dtype": "double", "source": "bars", "pit_safe": True} | change))


def test_feature_specs():
    spec = contracts.normalize_specs(["bar_volume", {"name": "level", "price_level": True, "adjustment": "unknown"}])
    assert contracts.classify(spec) == {"safe": ["bar_volume"], "suspect": ["level"], "rejected": []}
    assert contracts.assert_acceptable(spec) == ["level"]
    assert [r["name"] for r in contracts.availability_table(spec)] == ["bar_volume", "level"]
    for broken in ([], ["a", "a"], ["my_alpha"], [{"name": "x", "nope": 1}], [{"name": "x", "availability": "lagged"}], [{"name": "x", "price_level": True}], [{"name": "x", "adjustment": "pit_safe"}], [3]):
        with pytest.raises(contracts.ContractError):
            contracts.normalize_specs(broken)
    with pytest.raises(contracts.ContractError):
        contracts.assert_acceptable(contracts.normalize_specs([{"name": "x", "price_level": True, "adjustment": "back_adjusted"}]))


@pytest.mark.parametrize(
    "change,verdict,codes",
    [
        ({}, "OK", []),
        ({"pit_safe": False}, "SUSPECT", ["not_declared_pit_safe"]),
        ({"uses_future_data": True, "pit_safe": False}, "REJECTED", ["uses_future_data", "not_declared_pit_safe"]),
        ({"is_alpha_like": True}, "REJECTED", ["alpha_like_feature"]),
        ({"name": "my_rank"}, "REJECTED", ["alpha_like_name"]),
        ({"allowed_in_phase": ("9Z",)}, "REJECTED", ["phase_not_allowed"]),
        ({"requires_adjusted_price": True, "adjustment_safety": "back_adjusted"}, "REJECTED", ["back_adjusted_price_level"]),
        ({"adjustment_safety": "unknown"}, "SUSPECT", ["ambiguous_adjustment"]),
        ({"requires_adjusted_price": True}, "SUSPECT", ["undeclared_price_level_safety"]),
        ({"requires_adjusted_price": True, "adjustment_safety": "pit_safe"}, "OK", []),
    ],
)
def test_registry_rules(change, verdict, codes):
    got = contracts.judge(definition(**change))
    assert got["verdict"] == verdict and [r["code"] for r in got["reasons"]] == codes


def test_registry_sets():
    a, b = definition(), definition(name="volume_y")
    assert contracts.definitions_id([a, b]) == contracts.definitions_id([b, a]) != contracts.definitions_id([a, definition(name="volume_y", version=2)])
    assert contracts.judge_set([a, b])["verdict"] == "OK"
    assert contracts.judge_set([a, definition(name="z", is_alpha_like=True)])["rejected"] == ["z"]
    assert contracts.export_table([b, a])[0]["name"] == "volume_x"
    strict = contracts.RegistryConfig(unknown_adjustment="REJECTED")
    assert contracts.judge(definition(adjustment_safety="unknown"), strict)["verdict"] == "REJECTED"
    for broken in (dict(version=0), dict(null_policy="fill"), dict(name=" x"), dict(availability="lagged", feature_cutoff_rule="same_bar"), dict(allowed_in_phase=())):
        with pytest.raises(contracts.ContractError):
            definition(**broken)
    with pytest.raises(contracts.ContractError):
        contracts.FeatureRegistry([a, a])


def test_declarations():
    assert contracts.declared_adjustment({"data_declaration": {"corporate_actions_status": "clean", "price_adjustment": "full"}}) == ("clean", "full")
    assert contracts.adjustment_is_ambiguous() and contracts.adjustment_is_ambiguous("partial") and not contracts.adjustment_is_ambiguous(" Full ", None)
    given = dict(data_declaration_id="d", tier=2, universe_source="s", universe_id="u", survivorship_bias_status="controlled", corporate_actions_status="clean", pit_status="guaranteed", data_feed="iex", date_range=(dt.date(2024, 1, 1), dt.date(2024, 1, 2)))
    assert "tier: 2" in contracts.DataDeclaration.load(given).to_yaml()
    for broken in (dict(tier=3), dict(pit_status="best_effort"), dict(date_range=(dt.date(2024, 1, 2), dt.date(2024, 1, 1))), dict(extra=1)):
        with pytest.raises(contracts.ContractError):
            contracts.DataDeclaration.load(given | broken)


def assembled(spark, fault=None):
    panel, declaration = provenance.dirty(spark, fault) if fault else provenance.clean(spark)
    frame, made = manifest.assemble(panel, specs=[provenance.registry()[provenance.FEATURE].to_spec()], declaration=declaration, clock=CLOCK)
    return frame, made, manifest.inspect(frame, manifest=made, registry=provenance.registry(), requested=[provenance.FEATURE], clock=CLOCK)


def test_clean_panel_is_ok(spark):
    frame, made, report = assembled(spark)
    assert (made["verdict"], report["verdict"], report["warnings"]) == ("OK", "OK", [])
    assert made["row_count"] == 10 and made["eligible_row_count"] == 6  # two tickers, each without a first cutoff and a last label
    again = manifest.build_manifest(frame.repartition(3), provenance.clean(spark)[0], specs=[provenance.FEATURE], clock=CLOCK)
    assert again["fingerprint"] == made["fingerprint"]


@pytest.mark.parametrize(
    "fault,code",
    [
        ("broken_identity", "missing_symbol_identity"),
        ("ambiguous_adjustment", "ambiguous_adjustment_declaration"),
        ("zone_mismatch", "feature_timezone_mismatch"),
    ],
)
def test_dirty_panels_name_their_fault(spark, fault, code):
    _, made, report = assembled(spark, fault)
    assert "SUSPECT" in (made["verdict"], report["verdict"]) and code in {r["code"] for r in report["warnings"]}


def test_missing_availability_is_named(spark):
    """Fail-open joins leave null values; the report, not the join, raises the flag."""
    _, made, report = assembled(spark, "missing_availability")
    assert not made["asof_join_summary"]["columns"]["adjustment_factor"]["present"]
    assert report["verdict"] == "SUSPECT" and "missing_available_at_semantics" in {r["code"] for r in report["warnings"]}


def test_delisted_and_short_panels(spark):
    _, made, _ = assembled(spark, "delisted")
    assert made["excluded_by_reason"]["not_in_universe"] == 4
    frame, made, _ = assembled(spark, "too_short")
    assert made["eligible_row_count"] == 0
    with pytest.raises(PanelError):
        splits.temporal_split(frame, max_horizon=1)


def test_inspection_rejects_bad_splits_and_misses(spark):
    frame, made, _ = assembled(spark)
    assigned, b = splits.temporal_split(frame, max_horizon=2)
    bad = assigned.withColumn("split", F.when(F.col("split").isin("purged"), "train").otherwise(F.col("split")))
    report = manifest.inspect(frame, manifest=made, registry=provenance.registry(), requested=["nope"], splits=[(bad, b)], clock=CLOCK)
    assert report["verdict"] == "REJECTED"
    assert {"invalid_split_definition", "missing_feature_metadata", "feature_missing_from_dataset", "undeclared_dataset_column"} <= {r["code"] for r in report["warnings"]}


def test_research_dataset(bars):
    df = bars({"A": [1.0, 2, 3], "B": [4.0, 5, 6]})
    made = df.select("symbol", "timestamp", F.lit(1.0).alias("sma_5d"))
    got = research_dataset(df, made, feature_columns=["sma_5d"], symbols=["B", "A"], end="2024-01-02")
    assert got.count() == 4
    for broken in (dict(symbols=["Z"]), dict(start="2025-01-01")):
        with pytest.raises(PanelError):
            research_dataset(df, made, feature_columns=["sma_5d"], **broken)
    assert horizon_of("label_forward_return_20d") == 20 and horizon_of("y") == 1 and horizon_of("y", {"y": 3}) == 3


def test_fingerprints(spark, bars):
    df = bars({"A": [1.0, 2, 3]}).select("symbol", "timestamp", "close")
    one = fingerprints.fingerprint(df)
    assert one == fingerprints.fingerprint(df.orderBy(F.desc("close")).repartition(3))
    assert one != fingerprints.fingerprint(df.withColumn("close", F.col("close") + 1e-9)) and one != fingerprints.fingerprint(df.union(df.limit(1)))
    with pytest.raises(PanelError):
        fingerprints.fingerprint(df.withColumn("close", F.lit(float("nan"))))
    assert fingerprints.feature_set_id("p", "a", "2024-01-02") == fingerprints.feature_set_id("p", " A ", "2024-01-02")
    assert fingerprints.config_hash({"b": 1, "a": 2}) == fingerprints.config_hash({"a": 2, "b": 1})


def test_ledgers(spark, tmp_path):
    book = ledgers.Ledger(tmp_path / "l.jsonl")
    book.append({"run_id": "r", "created_at": "x", "n": 1}, id_field="run_id")
    book.append({"run_id": "r", "created_at": "x", "n": 1}, id_field="run_id")
    assert len(book.entries()) == 1 and book.read(spark).count() == 1
    for bad in ({"run_id": "r", "created_at": "x", "n": 2}, {"run_id": "q", "api_key": "k"}, {"run_id": "q", "note": "hunter2"}):
        with pytest.raises(PanelError):
            book.append(bad, id_field="run_id", secrets=["hunter2"])


def test_lineage(spark, tmp_path):
    _, made, report = assembled(spark)
    book = ledgers.LineageLedger(tmp_path / "lineage.jsonl")
    entry = book.record(made, report, feature_set_id="fs-1", clock=CLOCK)
    assert book.record(made, report, feature_set_id="fs-1", clock=CLOCK) == entry and entry["entry_id"].startswith("lin-")
    assert book.find(spark, verdict="OK", dataset_id=made["dataset_id"]).count() == 1 and book.find(spark, verdict="REJECTED").count() == 0
    with pytest.raises(PanelError):
        ledgers.check_lineage(entry | {"verdict": "SUSPECT"})
    with pytest.raises(PanelError):
        ledgers.lineage_record(made, report, clock=lambda: dt.datetime(2024, 1, 1))


def test_label_report(bars):
    from tidemark.functions.labels import with_labels

    made = with_labels(bars({"A": [100.0, 110, 300, 310], "B": [1.0, 1, 1, 1]}), 1)
    label = "label_forward_return_1d"
    known = reports.label_manifest(made, [label])
    report = reports.label_report(made, [label], manifest=known, max_null_pct=30, extreme=2.0, clock=CLOCK)
    assert report["verdict"] == "OK" and report["per_horizon"][0]["n_valid"] == 6 and len(report["per_symbol"]) == 2
    assert label in reports.label_markdown(report)
    strict = reports.label_report(made, [label], manifest=known | {"row_count": 9}, max_null_pct=1, extreme=0.5, max_symbols=1, clock=CLOCK)
    assert {"high_null_fraction", "extreme_return", "manifest_data_mismatch", "per_symbol_distribution_omitted"} <= {w["code"] for w in strict["warnings"]}
    assert strict["verdict"] == "SUSPECT"


def test_experiment(spark, bars, tmp_path):
    df = bars({"A": [100.0 * 1.01**i * (1 + 0.02 * (i % 3)) for i in range(30)]})
    weights = df.select("symbol", "timestamp", F.lit(1.0).alias("weight"))
    book = ledgers.Ledger(tmp_path / "runs.jsonl")
    got = reports.run_experiment(df, weights, out_dir=str(tmp_path / "r"), as_of="2024-01-31", weight_source="test", symbols=["A"], horizon=2, ledger=book, dataset_id="ds-1")
    assert spark.read.parquet(got["equity_curve"]["path"]).count() == got["equity_curve"]["rows"] == got["headline_metrics"]["n_periods"] == 28
    assert got["config"]["horizon"] == 2 and book.entries()[0]["dataset_id"] == "ds-1" and book.entries()[0]["as_of"] == "2024-01-31"
    for broken in ({"weight_source": " "}, {"weight_source": "w", "symbols": ["B"]}):
        with pytest.raises(PanelError):
            reports.run_experiment(df, weights, out_dir=str(tmp_path / "q"), as_of="2024-01-31", **broken)
    assert got["report_health"] in ("SUSPECT", "ENGINE_SUSPECT") and got["data_declaration_status"] == "MISSING"
    assert book.entries()[0]["metrics"]["battery.random_near_zero"] in (0.0, 1.0) and len(list((tmp_path / "r").iterdir())) == 3
    with pytest.raises(PanelError):
        reports.check_report(got | {"config_hash": None})
    assert reports.battery_summary(None)["verdicts"]["random_signal"] == "UNKNOWN"
    passed = {"available": True, "engine_suspect": False, "verdicts": dict.fromkeys(reports.CORE_CHECKS, "PASS")}
    assert reports.health("COMPLETE", passed) == "OK" and reports.health("MISSING", passed) == "SUSPECT"
    assert reports.health("COMPLETE", passed | {"engine_suspect": True}) == "ENGINE_SUSPECT"


def test_alphas(bars):
    registry = AlphaRegistry()

    @registry.register
    class Twice(Alpha):
        metadata = AlphaMetadata("twice")

        def compute(self, features):
            return F.col("close") * 2

    assert registry.names() == ["twice"] and registry["twice"]().scores(bars({"A": [0.2, 3.0]})).agg(F.max("score")).first()[0] == 1.0
    with pytest.raises(ValueError):
        registry.register(Twice)
    with pytest.raises(KeyError):
        registry["x"]


def test_command_line(spark, bars, tmp_path, capsys):
    p = lambda x: str(tmp_path / x)
    df = bars({"A": [100.0 + i + (i % 3) for i in range(30)]})
    df.write.parquet(p("bars.parquet"))
    df.select("symbol", "timestamp", F.lit(1.0).alias("weight")).write.parquet(p("weights.parquet"))
    assert cli.main(["compute-features", "--bars", p("bars.parquet"), "--out", p("f.parquet"), "--as-of", "2024-01-25"]) == 0
    assert spark.read.parquet(p("f.parquet")).count() == 25
    assert cli.main(["compute-features", "--bars", p("bars.parquet"), "--out", p("g.parquet"), "--as-of", "2020-01-01"]) == 2
    assert cli.main(["run-experiment", "--bars", p("bars.parquet"), "--weights", p("weights.parquet"), "--out", p("r"), "--as-of", "2024-01-30", "--ledger", p("l.jsonl")]) == 0
    assert cli.main(["list-experiments", "--ledger", p("l.jsonl")]) == 0 and "config_hash" in capsys.readouterr().out
    panel, declaration = provenance.clean(spark)
    for name in ("labels", "features", "universe", "identity", "reference"):
        getattr(panel, name).write.parquet(p(f"{name}.parquet"))
    spec = {k: p(f"{k}.parquet") for k in ("labels", "features", "universe", "identity", "reference")} | {"label_columns": [provenance.LABEL], "features_declared": [provenance.FEATURE], "reference_columns": ["adjustment_factor"], "data_declaration": declaration["data_declaration"]}
    (tmp_path / "spec.json").write_text(json.dumps(spec))
    assert cli.main(["assemble-dataset", "--spec", p("spec.json"), "--out", p("d.parquet"), "--manifest", p("m.json")]) == 0
    (tmp_path / "registry.json").write_text(json.dumps({"features": provenance.registry().list()}))
    assert cli.main(["inspect-dataset", "--dataset", p("d.parquet"), "--manifest", p("m.json"), "--registry", p("registry.json"), "--features", provenance.FEATURE, "--out", p("i.json")]) == 0
    assert json.loads((tmp_path / "i.json").read_text())["verdict"] == "OK"
    assert cli.main(["list-feature-sets", "--registry", p("registry.json")]) == 0
    assert cli.main(["run-dry-run", "--out", p("dry")]) == 0
    assert cli.main(["report-targets", "--labels", p("labels.parquet"), "--columns", provenance.LABEL, "--out", p("t")]) == 0


def test_null_labels_without_a_reason_are_unspecified(bars):
    from tidemark.functions.labels import with_labels

    label = "label_forward_return_1d"
    made = with_labels(bars({"A": [100.0, 110, 120], "B": [1.0, 1, 1]}), 1)
    known = reports.label_manifest(made, [label])
    assert known["symbols"] == ["A", "B"] and known["valid_label_count"] == 4 and known["null_breakdown"] == {"insufficient_future_rows": 2}
    blank = made.withColumn("target_null_reason", F.when(F.col("symbol") == "A", F.col("target_null_reason")))
    got = reports.label_report(blank, [label], manifest=known | {"symbols": ["A", "C"]}, max_symbols=1, clock=CLOCK)
    assert got["null_breakdown"]["data"] == {"insufficient_future_rows": 1, "UNSPECIFIED": 1}
    mismatch = next(w["message"] for w in got["warnings"] if w["code"] == "manifest_data_mismatch")
    assert "symbols" in mismatch and "null_breakdown" in mismatch and "row_count" not in mismatch
    first = got["per_symbol"][0]
    assert first["n_rows"] == 3 and first["distribution_included"] is False and set(first["targets"][label]) == set(reports.COUNTS)
    assert "UNSPECIFIED" in reports.label_markdown(got)


def test_markdown_of_manifest_and_inspection(spark):
    _, made, report = assembled(spark)
    text = manifest.manifest_markdown(made)
    assert made["dataset_id"] in text and "eligible" in text and provenance.FEATURE in text
    named = manifest.attach_feature_set_id(report, "fs-9")
    assert "fs-9" in manifest.inspection_markdown(named) and "feature_set_id" not in report
    for broken in (made | {"schema_version": 2}, made | {"row_count": 99}, made | {"verdict": "SUSPECT"}, made | {"verdict": "?"}):
        with pytest.raises(PanelError):
            manifest.manifest_markdown(broken)


def test_lineage_export(spark, tmp_path):
    _, made, report = assembled(spark)
    book = ledgers.LineageLedger(tmp_path / "lineage.jsonl")
    one = book.record(made, report, feature_set_id="fs-1", clock=CLOCK)
    book.record(made, report, feature_set_id="fs-2", clock=CLOCK)
    assert json.loads(book.export(tmp_path / "out" / "all.json").read_text())[0] == one
    assert [e["feature_set_id"] for e in json.loads(book.export(tmp_path / "some.json", feature_set_id="fs-2").read_text())] == ["fs-2"]
    with pytest.raises(PanelError):
        book.export(tmp_path / "x.json", seed="1")
    book.path.write_text(book.path.read_text() + book.path.read_text().splitlines()[0] + "\n")
    with pytest.raises(PanelError):
        book.export(tmp_path / "x.json")


def test_corporate_actions_are_known_in_time(spark):
    from tidemark.operators import temporal

    panel, _ = provenance.clean(spark)
    got = temporal.as_of(panel.labels.select("symbol", "timestamp"), provenance.corporate_actions(spark), ["adjustment_factor"]).orderBy("timestamp").collect()
    assert [r["adjustment_factor"] for r in got] == [None] * 3 + [0.5] * 2 + [None] * 2 + [0.99] * 3
