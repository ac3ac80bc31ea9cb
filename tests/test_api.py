"""The facade's routes that are more than a name."""

from test_cdc import now

from tidemark import api
from tidemark.plans.config import Config
from tidemark.schemas import JOBS


class Scheduler:
    """One that only remembers."""

    def __init__(self):
        self.calls = []

    def __getattr__(self, name):
        if name == "state":
            return lambda: self.calls[-1][0]
        return lambda *a: self.calls.append((name, *a))


def test_settings_move_the_scheduler(spark, tmp_path):
    path, scheduler = str(tmp_path / "config"), Scheduler()
    assert api.get_config(spark, path) == Config()
    api.save_config(spark, path, Config(sync_interval_minutes=3), scheduler)
    api.save_config(spark, path, Config(auto_sync_enabled=False), scheduler)
    api.save_config(spark, path, Config(source_url="http://x"))
    assert scheduler.calls == [("start", 3), ("stop",)] and api.get_config(spark, path).source_url == "http://x"
    assert [api.start(scheduler, Config(sync_interval_minutes=0)), api.pause(scheduler), api.resume(scheduler), api.stop(scheduler)] == ["start", "pause", "resume", "stop"]
    assert scheduler.calls[2] == ("start", 1)


def test_triggers(spark):
    """One entity or all, unless it has an active job."""
    row = (7, "customers", None, "Running", 0, 3, None, None, None, None)
    queue = spark.createDataFrame([row, (8, "payments", None, "Failed", 3, 3, "e", None, None, None)], JOBS)
    assert sorted(r.entity_type for r in api.trigger(queue, now(), first_id=9).collect()) == ["equipment", "invoices", "payments", "rental_orders"]
    one = api.trigger(queue, now(), "invoices", first_id=9).collect()
    assert [(r.id, r.entity_type, r.status, (r.created_at - r.scheduled_at).seconds) for r in one] == [(9, "invoices", "Pending", 10)]
    assert api.trigger(queue, now(), "customers").count() == 0
    after, again = api.retry_failed(queue, now())
    assert [r.entity_type for r in again.collect()] == ["payments"] and after.where("status = 'Pending'").count() == 1


def test_every_route_is_there():
    assert all(callable(getattr(api, name)) for name in api.__all__) and len(api.__all__) == 21
