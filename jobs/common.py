"""What the jobs share: their configuration, their command line's session and the log."""

from __future__ import annotations

import argparse
import json
import logging
from pathlib import Path

from pyspark.sql import SparkSession

log = logging.getLogger("quernstone.jobs")


def config_of(name: str, path: str | None = None, **changes) -> dict:
    """The settings of ``jobs/<name>.json``, with those of the file ``path`` and ``changes`` over them; unknown ones are an error."""
    found = json.loads(Path(__file__).with_name(f"{name}.json").read_text())
    over = (json.loads(Path(path).read_text()) if path else {}) | changes
    if unknown := set(over) - set(found):
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    return found | over


def arguments(description: str, *names: str) -> argparse.Namespace:
    parser = argparse.ArgumentParser(description=description)
    for name in names:
        parser.add_argument(f"--{name}", required=True, help="a path of any store that Spark reads")
    parser.add_argument("--config", help="a JSON file whose settings go over the job's own")
    return parser.parse_args()


def session(name: str) -> SparkSession:
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    return SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").getOrCreate()
