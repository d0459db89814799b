"""Command line: ``python -m tidemark.cli COMMAND``."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from .plans import contracts, ledgers, manifest, reports
from .schema import PanelError
from .session import session
from .sources import bars as source
from .sources import rest
from .sources.sinks import write_frame


def _csv(text: str) -> list[str]:
    return [x for x in text.split(",") if x]


def _save(path: str, value) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(value, default=str, indent=2), encoding="utf-8")


def features(a, spark) -> None:
    from .functions.features import build_pit_feature_set, with_features
    from .plans.fingerprints import feature_set_id

    symbols = _csv(a.symbols) if a.symbols else []
    if len(symbols) == 1:
        made = build_pit_feature_set(spark, a.bars, symbols[0], as_of=a.as_of)
    else:
        known = source.point_in_time(source.scan(spark, a.bars), as_of=a.as_of, symbols=symbols or None)
        made = with_features(known, feature_set_id(a.bars, a.symbols or "ALL", known.agg({"timestamp": "max"}).first()[0].date()))
    last = made.agg({"timestamp": "max"}).first()[0]
    write_frame(made, a.out, overwrite=a.overwrite)
    _save(a.out.rstrip("/") + ".manifest.json", {"as_of": a.as_of, "bars": a.bars, "last_bar": str(last), "columns": made.columns})


def assemble(a, spark) -> None:
    spec = source.read_spec(a.spec)
    read = lambda key: source.read_table(spark, spec[key]) if spec.get(key) else None
    from .plans.dataset import Panel

    panel = Panel(read("labels"), spec["label_columns"], read("features"), [s["name"] if isinstance(s, dict) else s for s in spec["features_declared"]], read("universe"), read("identity"), read("reference"), spec.get("reference_columns", []), synthetic_no_universe=spec.get("synthetic_no_universe", False))
    frame, made = manifest.assemble(panel, specs=spec["features_declared"], declaration=spec.get("data_declaration"))
    write_frame(frame, a.out, overwrite=a.overwrite)
    _save(a.manifest, made)
    Path(a.manifest).with_suffix(".md").write_text(manifest.manifest_markdown(made), encoding="utf-8")


def inspect(a, spark) -> None:
    registry = contracts.FeatureRegistry(source.read_spec(a.registry, allow_list=True))
    found = manifest.inspect(source.read_table(spark, a.dataset), manifest=source.read_spec(a.manifest), registry=registry, requested=_csv(a.features))
    if a.feature_set_id:
        found = manifest.attach_feature_set_id(found, a.feature_set_id)
    _save(a.out, found)
    Path(a.out).with_suffix(".md").write_text(manifest.inspection_markdown(found), encoding="utf-8")
    print(found["verdict"])


def inspect_research(a, spark) -> None:
    from .plans.dataset import dataset_summary

    df = source.read_table(spark, a.dataset)
    print(json.dumps(dataset_summary(df, df.columns), default=str, indent=2))


def targets(a, spark) -> None:
    found = reports.label_report(source.read_table(spark, a.labels), _csv(a.columns), manifest=source.read_spec(a.manifest) if a.manifest else None)
    _save(a.out + ".json", found)
    Path(a.out + ".md").write_text(reports.label_markdown(found), encoding="utf-8")
    print(found["verdict"])


def experiment(a, spark) -> None:
    from .operators.backtest import CostModel, load_costs, load_stress

    costs = load_costs(a.costs, a.stress) if a.costs else CostModel(0.0, a.slippage_bps)
    declaration = source.read_spec(a.declaration) if a.declaration else None
    found = reports.run_experiment(
        source.scan(spark, a.bars),
        source.read_weights(spark, a.weights),
        out_dir=a.out,
        as_of=a.as_of,
        weight_source=a.weight_source,
        seed=a.seed,
        horizon=int(a.horizon),
        symbols=_csv(a.symbols) if a.symbols else None,
        periods_per_year=int(a.periods_per_year),
        cost_model=costs,
        stress=load_stress(a.costs) if a.costs else None,
        declaration=(declaration or {}).get("data_declaration", declaration),
        ledger=ledgers.Ledger(a.ledger) if a.ledger else None,
        weights_path=a.weights,
        cost_config_path=a.costs,
        dataset_id=a.dataset_id,
        feature_set_id=a.feature_set_id,
    )
    print(found["run_id"], found["report_health"])


def dry_run(a, spark) -> None:
    print(json.dumps(rest.dry_run(spark, a.out).checks))


def fetch(a, spark) -> None:
    """Over HTTP with the environment's access, or from saved pages if a folder of them is given."""
    options = {"symbols": _csv(a.symbols), "start": a.start, "end": a.end, "feed": a.feed, "ledger": ledgers.Ledger(a.ledger) if a.ledger else None}
    if a.pages:
        payloads = [json.loads(f.read_text(encoding="utf-8")) for f in sorted(Path(a.pages).glob("*.json"))]
        found = rest.controlled_fetch(spark, rest.CannedTransport(payloads), "saved:", a.out, **options)
    else:
        access = rest.BarsAccess.from_env()
        found = rest.controlled_fetch(spark, rest.HttpTransport(), access.url, a.out, secrets=access.secrets, headers=access.headers, **options)
    print(found.rows_written, found.symbols)


def export_lineage(a, spark) -> None:
    print(ledgers.LineageLedger(a.ledger).export(a.out, **dict(x.split("=", 1) for x in a.where)))


def listing(a, spark) -> None:
    for entry in ledgers.Ledger(a.ledger).entries():
        if not a.where or all(str(entry.get(k)) == v for k, v in (x.split("=", 1) for x in a.where)):
            print(json.dumps(entry))


def definitions(a, spark) -> None:
    print(json.dumps(contracts.export_table(source.read_spec(a.registry, allow_list=True)), indent=2))


COMMANDS = {
    "compute-features": (features, ["bars", "out", "as-of"], {"symbols": None}, True),
    "assemble-dataset": (assemble, ["spec", "out", "manifest"], {}, True),
    "inspect-dataset": (inspect, ["dataset", "manifest", "registry", "features", "out"], {"feature-set-id": None}, True),
    "inspect-research-dataset": (inspect_research, ["dataset"], {}, True),
    "report-targets": (targets, ["labels", "columns", "out"], {"manifest": None}, True),
    "run-experiment": (experiment, ["bars", "weights", "out", "as-of"], {"costs": None, "stress": "none", "declaration": None, "ledger": None, "weight-source": "file", "horizon": "1", "symbols": None, "periods-per-year": "252", "dataset-id": None, "feature-set-id": None}, True),
    "run-dry-run": (dry_run, ["out"], {}, True),
    "run-fetch": (fetch, ["out", "symbols", "start", "end"], {"pages": None, "feed": "iex", "ledger": None}, True),
    "export-lineage": (export_lineage, ["ledger", "out"], {}, False),
    "list-experiments": (listing, ["ledger"], {}, False),
    "list-fetch-runs": (listing, ["ledger"], {}, False),
    "list-research-datasets": (listing, ["ledger"], {}, False),
    "list-feature-sets": (definitions, ["registry"], {}, False),
}


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tidemark")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, (_, needed, optional, _) in COMMANDS.items():
        p = commands.add_parser(name)
        for x in needed:
            p.add_argument(f"--{x}", required=True)
        for x, default in optional.items():
            p.add_argument(f"--{x}", default=default)
        p.add_argument("--overwrite", action="store_true")
        p.add_argument("--seed", type=int, default=7)
        p.add_argument("--slippage-bps", type=float, default=5.0)
        p.add_argument("--where", action="append", default=[])
        p.add_argument("--master", default=None)
    a = parser.parse_args(argv)
    run, _, _, needs_spark = COMMANDS[a.command]
    try:
        run(a, session(master=a.master) if needs_spark else None)
    except (PanelError, rest.RestError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
