"""Settings from the environment, logging, and a probe."""

from __future__ import annotations

import logging
import os
import sys
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PREFIX = "SPINDRIFT_"


@dataclass(frozen=True)
class Settings:
    """What a deployment may set, each as SPINDRIFT_<NAME> in the environment."""

    app_name: str = "spindrift"
    environment: str = "development"
    log_level: str = "INFO"
    store: str = "data/store"
    raw: str = "data/raw"
    synthetic: str = "data/synthetic"
    model: str | None = None
    model_key: str | None = None

    @classmethod
    def from_environment(cls, env: dict[str, str] | None = None) -> Settings:
        env = dict(os.environ) if env is None else env
        return cls(**{f.name: env[key] for f in fields(cls) if (key := PREFIX + f.name.upper()) in env})


def configure_logging(level: str = "INFO") -> logging.Logger:
    """The package's logger, writing to standard output once; an unknown level counts as INFO."""
    log = logging.getLogger("spindrift")
    log.setLevel(logging.getLevelNamesMapping().get(level.upper(), logging.INFO))
    if not log.handlers:
        handler = logging.StreamHandler(sys.stdout)
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s"))
        log.addHandler(handler)
    return log


def health(spark: SparkSession, settings: Settings | None = None) -> DataFrame:
    """One row: app, environment, status; `ok` comes from a job on the executors."""
    own = settings or Settings()
    return spark.range(1).agg(F.count("*").alias("n")).select(F.lit(own.app_name).alias("app"), F.lit(own.environment).alias("environment"), F.when(F.col("n") == 1, "ok").otherwise("down").alias("status"))
