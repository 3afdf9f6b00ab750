"""Run parameters; the registered queries and their SQL twins take their limits from the defaults."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class RunConfig:
    seed: int = 7
    test_cap: int = 5000
    dev_cap: int = 2000
    contamination_cap: int = 500
    min_k_share: float = 0.2
    bins: int = 15
    replicates: int = 1000
    audit_per_source: int = 50
    stratified_dev: int = 2000
    thinking: int = 200
    spot_checks: int = 5
    template_target: int = 500
    drop_at: float = 0.95
    teacher_ece: float = 0.05
    agreement_points: float = 2.0
    candidate_counts: tuple[int, ...] = field(default=(2, 4, 8, 16))


def load_config(spark: SparkSession, path: str) -> RunConfig:
    """Parameters from a file that Spark can read: a JSON object, or lines of `name: value` whose values are JSON.

    Names that the file lacks keep their defaults. An unknown name, a value of another type and a file
    that is neither are refused; so is a folder of several files. Lines that begin with # are comments.
    """
    texts = [r.value for r in spark.read.text(path, wholetext=True).limit(2).collect()]
    if len(texts) != 1:
        raise ValueError("a run has one file of parameters")
    text = texts[0].strip()
    try:
        if text.startswith("{"):
            given = json.loads(text)
        else:
            lines = [line.partition(":") for line in text.splitlines() if line.strip() and not line.lstrip().startswith("#")]
            given = {name.strip(): json.loads(value) for name, _, value in lines}
    except json.JSONDecodeError as e:
        raise ValueError(f"no parameters: {e}") from None
    defaults, out = {f.name: getattr(RunConfig(), f.name) for f in fields(RunConfig)}, {}
    for name, value in given.items():
        if name not in defaults:
            raise ValueError(f"{name} is no parameter")
        default = defaults[name]
        if isinstance(default, tuple) and isinstance(value, list) and all(type(v) is int for v in value):
            value = tuple(value)
        elif isinstance(default, float) and type(value) is int:
            value = float(value)
        if type(value) is not type(default):
            raise ValueError(f"{name} is a {type(default).__name__}")
        out[name] = value
    return RunConfig(**out)
