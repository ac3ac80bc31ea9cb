"""Canonical content hashes, which tell a changed record from an unchanged one."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def typed_hash(*fields: Column) -> Column:
    """SHA-256 of fields in a fixed order; NULL and '' differ, and a separator in a text is only as safe as its neighbours."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(f.cast("string"), F.lit("\u0000")) for f in fields]), 256)


def payload_hash(raw: Column) -> Column:
    """SHA-256 of a JSON document in canonical form: keys in order at every level, numbers normalised (1.0 is 1).

    NULL where the text is no JSON.
    """
    return F.sha2(F.to_json(F.try_parse_json(raw)), 256)


@F.pandas_udf(StringType())
def migration_hash(raws: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """SHA-256 of a document as Python writes it with sorted keys; only to compare with hashes stored so."""

    def one(raw: str | None) -> str | None:
        if raw is None:
            return None
        return hashlib.sha256(json.dumps(json.loads(raw), sort_keys=True, ensure_ascii=False).encode()).hexdigest()

    for batch in raws:
        yield batch.map(one)
