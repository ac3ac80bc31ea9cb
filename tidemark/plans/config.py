"""Settings of a deployment, as one JSON document. Secrets belong into a secret store, not here."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields

from pyspark.sql import SparkSession


@dataclass
class Config:
    source_url: str = ""
    source_api_key: str = ""
    source_tenant: str = ""
    target_type: str = "tally"
    target_url: str = ""
    target_api_key: str = ""
    proxy: str = ""
    sync_interval_minutes: int = 10
    auto_sync_enabled: bool = True
    verify_ssl: bool = True

    def interval(self) -> int:
        """Minutes between two syncs, one at least."""
        return max(1, self.sync_interval_minutes)


def load(spark: SparkSession, path: str) -> Config | None:
    """The stored settings; None where there are none or they can't be read. Unknown fields are ignored."""
    try:
        text = spark.read.text(path, wholetext=True).first().value
        known = {f.name for f in fields(Config)}
        return Config(**{k: v for k, v in json.loads(text).items() if k in known})
    except Exception:  # noqa: BLE001  a broken file counts as no settings
        return None


def require(spark: SparkSession, path: str) -> Config:
    """The stored settings; their absence is an error of the caller's."""
    found = load(spark, path)
    if found is None:
        raise ValueError("no settings are stored")
    return found


def current(spark: SparkSession, path: str) -> Config:
    """The stored settings, or the defaults."""
    return load(spark, path) or Config()


def save(spark: SparkSession, path: str, config: Config) -> None:
    spark.createDataFrame([(json.dumps(asdict(config)),)], "value string").coalesce(1).write.mode("overwrite").text(path)
