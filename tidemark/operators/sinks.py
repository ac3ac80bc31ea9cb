"""Pushing records to the target system, and what comes back."""

from __future__ import annotations

import json
from abc import ABC, abstractmethod
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..schemas import ENDPOINTS
from ..sources import rest
from ..sources.http import Session


class Connector(ABC):
    """A target system, over one connection that stays open. sync returns {success, external_id, error, data} of one payload."""

    def __init__(self, base: str, key: str | None = None):
        self.base, self.key, self.session = base.rstrip("/"), key, Session(base, key, rest.TIMEOUT_S)

    def connect(self) -> bool:
        return self.health_check()

    def disconnect(self) -> None:
        self.session.close()

    def health_check(self) -> bool:
        return rest.target_alive(self.base, self.key)

    @abstractmethod
    def data(self, entity: str, payload: dict) -> dict: ...

    def sync(self, entity: str, payload: dict, once: str | None = None) -> dict:
        """Pushes one payload; entities that are not known go where customers go, and errors are returned.

        once is an idempotency key, by which the target may tell a repeated request.
        """
        entity = entity if entity in ENDPOINTS else "customer"
        try:
            answer = self.session.text("POST", ENDPOINTS[entity], json.dumps(payload), {"Idempotency-Key": once} if once else None)
            found = rest.external_id(entity, answer, str(payload.get("id")))
            return {"success": True, "external_id": found, "error": None, "data": self.data(entity, payload)}
        except Exception as e:  # noqa: BLE001  whatever failed belongs to this record, not to the task
            return {"success": False, "external_id": None, "error": str(e), "data": payload}

    def update(self, entity: str, external_id: str, payload: dict) -> dict:
        return self.sync(entity, payload)

    def delete(self, entity: str, external_id: str) -> dict:
        return {"success": True, "external_id": external_id, "error": None, "data": {}}


class RestConnector(Connector):
    def data(self, entity: str, payload: dict) -> dict:
        return payload


class AccountingConnector(Connector):
    """Posts JSON as well, and returns the import envelope beside the payload (see scalars.xml_envelope)."""

    def data(self, entity: str, payload: dict) -> dict:
        return {"xml_meta": {"action": "SYNC", "entity": entity, "voucher": "Voucher"}, "payload": payload}


def connector(kind: str | None, base: str, key: str | None = None) -> Connector:
    """The accounting connector by default, the REST connector for any other kind."""
    return (AccountingConnector if (kind or "tally").lower() == "tally" else RestConnector)(base, key)


def push(records: DataFrame, kind: str | None, base: str, key: str | None = None) -> DataFrame:
    """records (entity_type, payload, ...) with success, external_id, error and data of each push.

    Each row is posted once for each evaluation: write the result, and read it from there. Run it without
    speculation, and bound the target's load by the number of partitions.
    """

    def pushed(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        target = connector(kind, base, key)
        for batch in batches:
            answers = [target.sync(e, json.loads(p)) for e, p in zip(batch["entity_type"], batch["payload"])]
            for field in ("success", "external_id", "error"):
                batch[field] = pd.Series([a[field] for a in answers], index=batch.index, dtype=object)
            batch["data"] = [json.dumps(a["data"], ensure_ascii=False) for a in answers]
            yield batch
        target.disconnect()

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in records.schema)
    out = records.mapInPandas(pushed, f"{fields}, success boolean, external_id string, error string, data string")
    if (kind or "tally").lower() == "tally":
        envelope = S.xml_envelope(F.lit("SYNC"), F.col("entity_type"), F.lit("Voucher"))
        out = out.withColumn("xml_meta", F.when(F.col("success"), envelope))
    return out
