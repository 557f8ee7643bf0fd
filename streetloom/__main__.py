"""Commands over a city's folder of layers: python -m streetloom {layers,describe,csv,combine,process} ..."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from streetloom.plans.city_metrics import default_registry
from streetloom.plans.shared import materialise
from streetloom.sources.city import City, Lock, combine, list_layers, write_csv


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="streetloom", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name, options in {"layers": [], "describe": ["layer"], "csv": ["layer", "target"], "combine": ["layer", "target"], "process": []}.items():
        sub = commands.add_parser(name)
        sub.add_argument("path", nargs="+" if name == "combine" else None)
        for o in options:
            sub.add_argument(f"--{o}", required=True)
        if name == "process":
            sub.add_argument("--select", action="append")
            sub.add_argument("--overwrite", action="store_true")
            sub.add_argument("--crash-early", action="store_true")
        if name == "combine":
            sub.add_argument("--key", default="id")
            sub.add_argument("--all", action="store_true", help="all rows in the place of a sample of 10 000 a city")
    a = parser.parse_args(args)
    spark = SparkSession.builder.appName("streetloom").getOrCreate()
    if a.command == "layers":
        print("\n".join(list_layers(spark, a.path)))
    elif a.command == "describe":
        City.read(spark, a.path, [a.layer]).describe(a.layer).show(1000, truncate=False)
    elif a.command == "csv":
        write_csv(City.read(spark, a.path, [a.layer]).layers[a.layer], a.target)
    elif a.command == "combine":
        cities = {p.rstrip("/").rsplit("/", 1)[-1]: City.read(spark, p, [a.layer]).layers[a.layer] for p in a.path}
        City({a.layer: combine(cities, a.key, not a.all)}).write(a.target)
    else:
        with Lock(spark, a.path, "PROCESS"):
            names = list_layers(spark, a.path)
            layers = City.read(spark, a.path, names).layers
            done, spent, failed = default_registry().run(layers, a.select, a.overwrite, materialise, a.crash_early)
            changed = [n for n in names if done[n] is not layers[n]]
            City({n: materialise(done[n]) for n in changed}).write(a.path)
            print(f"{len(spent)} metrics, failed: {failed or 'none'}")


if __name__ == "__main__":
    main()
