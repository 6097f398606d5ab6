"""Routing of alerts to handlers: each gets each alert once, whatever fails."""

import datetime as dt

import pytest

from plumbline.schemas import ALERT
from plumbline.sources import routing
from plumbline.sources.routing import Handler, RoutingError, commits, handed_over, handlers_from_mapping, route

COLUMNS = "timestamp timestamp, w long, alert_type string, severity string, message string, what string, why string, metric_value double, details map<string,string>"


def alerts(spark, batch, n=3):
    rows = [(dt.datetime(2024, 1, 1), batch, f"t{i}", "high", "a — b", f"a{batch}{i}", "b", 0.5, {"k": "v"}) for i in range(n)]
    return spark.createDataFrame(rows, COLUMNS)


def seen(spark, path, handler, column):
    found = handed_over(spark, path, handler)
    return sorted(r[0] for r in found.select(column).collect()) if column in found.columns else []


def test_every_handler_gets_every_alert_in_its_form(spark, tmp_path):
    path = str(tmp_path / "r")
    handlers = handlers_from_mapping(
        {"alerts": {"log_file": "x", "slack_webhook_url": "y", "dashboard_state_path": "z",
                    "email": {"enabled": True, "recipients": ["a@b", "c@d"], "sender": "m@b"}}}
    )
    assert [h.name for h in handlers] == ["log", "file", "dashboard", "chat", "mail"]
    for batch in (4, 5, 6):
        route(alerts(spark, batch, batch - 4), path, batch, "w", handlers)
    assert commits(spark, path).count() == 18
    assert len(seen(spark, path, "log", "line")) == len(seen(spark, path, "chat", "message")) == 3
    assert seen(spark, path, "file", "what") == seen(spark, path, "dashboard", "what") == ["a50", "a60", "a61"]
    mailed = handed_over(spark, path, "mail").collect()
    assert all(r["recipients"] == ["a@b", "c@d"] and r["sender"] == "m@b" and r["subject"].startswith("[HIGH]") for r in mailed)
    assert handed_over(spark, path, "other").count() == 0


def test_only_what_is_set_up_is_active():
    assert [h.name for h in handlers_from_mapping({})] == ["log"]
    off = {"alerts": {"email": {"enabled": False, "recipients": ["a"]}, "slack_webhook_url": None}}
    assert [h.name for h in handlers_from_mapping(off)] == ["log"]
    assert [h.name for h in handlers_from_mapping({"alerts": {"email": {"enabled": True, "recipients": []}}})] == ["log"]


def test_a_failure_is_made_good_by_the_repeat(spark, tmp_path):
    path, tries = str(tmp_path / "r"), []

    def halfway(rows, folder):
        tries.append(folder)
        rows.limit(1).write.mode("overwrite").json(folder)
        if len(tries) < 3:
            raise OSError("lost")
        rows.write.mode("overwrite").json(folder)

    def counted(rows, folder):
        assert folder not in written
        written.append(folder)
        rows.write.mode("overwrite").json(folder)

    written = []
    handlers = [Handler("first", lambda a, w: a, halfway), Handler("second", lambda a, w: a, counted)]
    for _ in range(2):
        with pytest.raises(RoutingError, match="batch 0: first: lost"):
            # The repeat computes other rows; those of the first try count.
            route(alerts(spark, 0, 3 + len(tries)), path, 0, "w", handlers)
        assert seen(spark, path, "first", "what") == []
        assert len(seen(spark, path, "second", "what")) == 3
    route(alerts(spark, 0, 9), path, 0, "w", handlers)
    route(alerts(spark, 0, 9), path, 0, "w", handlers)
    assert seen(spark, path, "first", "what") == seen(spark, path, "second", "what") == ["a00", "a01", "a02"]
    assert len(tries) == 3 and len(written) == 1


def test_batches_without_alerts_and_names(spark, tmp_path):
    path = str(tmp_path / "r")
    route(alerts(spark, 0, 0), path, 0, "w", [routing.LOG])
    assert commits(spark, path).where("handler = 'log'").first()["alerts"] == 0
    assert handed_over(spark, path, "log").count() == 0
    with pytest.raises(ValueError):
        route(alerts(spark, 0), path, 1, "w", [routing.LOG, routing.LOG])
    assert set(ALERT.names) >= {"alert_type", "severity", "what"}
