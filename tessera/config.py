"""All settings of the entity-resolution engine."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Settings:
    windows: dict[str, int] = field(default_factory=lambda: {"name": 25, "token_sorted": 15, "address": 15})
    cap_per_pass: int = 40
    threshold: float = 0.5
    caps: dict[str, int] = field(default_factory=lambda: {"s2": 5, "s3": 6})
    global_cap: int | None = 6
    chunk_rows: int = 10_000
    tfidf_top: int = 15
    positives: int = 150_000
    negatives: int = 450_000
    validation: float = 0.2
    seed: int = 42
    trees: int = 250
    larger_id_first: bool = False  # among equal probabilities
    spill_dir: str | None = None  # of a session made here; else the cluster's own


DEFAULT = Settings()


def session(settings: Settings = DEFAULT, **conf: str):
    """A session with the settings that a session has; a running one is taken as it is."""
    from pyspark.sql import SparkSession

    builder = SparkSession.builder.config("spark.sql.execution.arrow.maxRecordsPerBatch", str(settings.chunk_rows))
    if settings.spill_dir:
        builder = builder.config("spark.local.dir", settings.spill_dir)
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    return builder.getOrCreate()
