"""Command line: run, inspect, diff, replay, cache, prompt, ablate."""

from __future__ import annotations

import argparse
import json
import sys

from sparkloom.plans import runs
from sparkloom.plans.config import PromptPack
from sparkloom.sources import tables


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="sparkloom")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("inspect").add_argument("folder")
    d = sub.add_parser("diff")
    d.add_argument("old")
    d.add_argument("new")
    r = sub.add_parser("replay")
    r.add_argument("folder")
    r.add_argument("--mode", default="full_cache", choices=["full_cache", "verify", "from_stage", "selective"])
    r.add_argument("--stage", action="append", default=[])
    u = sub.add_parser("run")
    u.add_argument("config", help="a YAML file with name, data, stages and, if wanted, seed, run_id, cache")
    u.add_argument("folder")
    q = sub.add_parser("prompt")
    q.add_argument("action", choices=["lint", "list"])
    q.add_argument("pack")
    c = sub.add_parser("cache")
    c.add_argument("action", choices=["stats", "clear"])
    c.add_argument("path")
    c.add_argument("--stage")
    a = sub.add_parser("ablate")
    a.add_argument("matrix", help="a JSON or YAML file with name, base and overrides")
    x = p.parse_args(argv)
    if x.command == "inspect":
        m = runs.Manifest.load(x.folder)
        print(json.dumps({"run": m.run_id, "status": m.status, "hash": m.hash(), "stages": [[s["name"], s["rows"], s["status"]] for s in m.stages]}))
    elif x.command == "diff":
        old, new = ({s["name"]: s["hash"] for s in runs.Manifest.load(f).stages} for f in (x.old, x.new))
        print(json.dumps({"added": sorted(new.keys() - old.keys()), "removed": sorted(old.keys() - new.keys()), "changed": sorted(k for k in old.keys() & new.keys() if old[k] != new[k])}))
    elif x.command == "replay":
        plan = runs.plan_replay(runs.Manifest.load(x.folder), x.mode, tuple(x.stage))
        print(json.dumps({"execute": plan.execute, "verify": plan.verify, "cached": plan.cached}))
    elif x.command == "prompt":
        pack = PromptPack.load(x.pack)
        found = {n: q.problems() for n, q in pack.prompts.items()}
        print(json.dumps(found if x.action == "lint" else sorted(found)))
        return int(x.action == "lint" and any(found.values()))
    elif x.command == "ablate":
        import yaml

        with open(x.matrix, encoding="utf-8") as f:
            print(json.dumps(runs.Matrix(**yaml.safe_load(f)).expand()))
    elif x.command == "cache":
        from pyspark.sql import SparkSession

        from sparkloom.operators import cache

        spark = SparkSession.builder.getOrCreate()
        if x.action == "stats":
            cache.stats(spark.read.parquet(x.path)).orderBy("stage_name").show(truncate=False)
        else:
            print(json.dumps({"cleared": cache.clear(spark, x.path, x.stage)}))
    elif x.command == "run":
        import yaml
        from pyspark.sql import SparkSession

        with open(x.config, encoding="utf-8") as f:
            config = yaml.safe_load(f)
        spark = SparkSession.builder.getOrCreate()
        m = runs.run(runs.graph_of(config), tables.read_table(spark, config["data"]), x.folder, runs.Context(run_id=config.get("run_id", config["name"])), config.get("seed", 42), cache_path=config.get("cache"))
        print(json.dumps({"run": m.run_id, "status": m.status, "hash": m.hash(), "stages": [[s["name"], s["rows"], s["status"]] for s in m.stages]}))
    return 0


if __name__ == "__main__":
    sys.exit(main())
