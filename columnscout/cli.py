"""Command line: sources, models and searches below a home folder.

    python -m columnscout.cli add-csv lake /data/lake --separator ,
    python -m columnscout.cli build-model lake model1
    python -m columnscout.cli explore-model model1 --keyword price
"""

from __future__ import annotations

import argparse
import json
import os
import shutil
from pathlib import Path

from columnscout.plans.lineage import shared_folder
from columnscout.sources import config, sinks


def _home() -> Path:
    home = Path(os.environ.get("COLUMNSCOUT_HOME", Path.home() / ".columnscout"))
    for d in ("sources", "models"):
        (home / d).mkdir(parents=True, exist_ok=True)
    return home


def _models(spark) -> str:
    """Where models are: executors write them, so on a cluster below the shared folder that the session names."""
    return str(_home() / "models") if spark.sparkContext.master.startswith("local") else f"{shared_folder(spark)}/models"


def _source(name: str) -> config.SourceConfig:
    path = _home() / "sources" / f"{name}.json"
    if not path.exists():
        raise SystemExit(f"no source {name}")
    return config.load(str(path))[0]


def _add(name: str, kind: str, settings: dict) -> None:
    config.dump([config.SourceConfig(name, kind, settings)], str(_home() / "sources" / f"{name}.json"))


def _spark():
    from columnscout.session import get_spark

    return get_spark(os.environ.get("COLUMNSCOUT_MASTER"))


def build_model(source: str, name: str) -> None:
    """Profile a source and store its columns, profile and graph."""
    from columnscout.plans import model

    spark, s = _spark(), _source(source)
    m = model.build(spark, config.tables(spark, s), s.name)
    path = f"{_models(spark)}/{name}"
    sinks.write_profile(m.profile, f"{path}/profile")
    sinks.write_network(m.columns, m.edges(), path)


def explore(name: str, keyword: str, k: int) -> list[tuple]:
    """Columns whose name has a term within the allowed edits of the keyword, and their neighbours."""
    from columnscout.operators import graph, search

    columns, edges = sinks.read_network(spark := _spark(), f"{_models(spark)}/{name}")
    hits = search.fuzzy_match(columns, keyword, k=k)
    near = graph.neighbours(hits, edges).join(columns, "nid").select("origin", "relation", "source_name", "field_name", "score")
    return [tuple(r) for r in near.orderBy("origin", "relation", "source_name", "field_name").collect()]


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="columnscout")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("list-sources")
    sub.add_parser("list-models")
    csv = sub.add_parser("add-csv")
    csv.add_argument("name")
    csv.add_argument("path")
    csv.add_argument("--separator", default=",")
    db = sub.add_parser("add-db")
    db.add_argument("name")
    db.add_argument("kind", choices=sorted(config.READERS))
    db.add_argument("settings", help="settings as JSON")
    for command in ("show-source", "clear-store"):
        sub.add_parser(command).add_argument("name")
    build = sub.add_parser("build-model")
    build.add_argument("source")
    build.add_argument("name")
    export = sub.add_parser("export-model")
    export.add_argument("name")
    export.add_argument("path")
    look = sub.add_parser("explore-model")
    look.add_argument("name")
    look.add_argument("--keyword", required=True)
    look.add_argument("--limit", type=int, default=15)
    a = p.parse_args(argv)
    if a.command in ("list-sources", "list-models"):
        print("\n".join(sorted(x.name.removesuffix(".json") for x in (_home() / a.command.split("-")[1]).iterdir())))
    elif a.command == "add-csv":
        _add(a.name, "csv", {"path": a.path, "separator": a.separator})
    elif a.command == "add-db":
        _add(a.name, a.kind, json.loads(a.settings))
    elif a.command == "show-source":
        s = _source(a.name)
        print(json.dumps({"name": s.name, "type": s.kind, "config": {k: v for k, v in s.config.items() if k != "password"}}, indent=2))
    elif a.command == "build-model":
        build_model(a.source, a.name)
    elif a.command == "export-model":
        columns, edges = sinks.read_network(_spark(), str(_home() / "models" / a.name))
        sinks.network_to_csv(columns, edges, a.path)
    elif a.command == "clear-store":
        shutil.rmtree(_home() / "models" / a.name)
    else:
        for row in explore(a.name, a.keyword, a.limit):
            print(*row, sep="\t")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
