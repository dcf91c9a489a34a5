import json

import pytest

from evtrail import cli, schemas, settings
from evtrail.session import CaseSession
from evtrail.store import TABLES

from .builders import SYSMON


def test_settings(tmp_path, monkeypatch):
    monkeypatch.setenv("HOME", str(tmp_path))
    assert settings.load().source is None
    file = tmp_path / "c.toml"
    file.write_text('state_dir = "/s"\ndefault_severity = "HIGH"\nanalyst_name = "a"\nother = "x"\n')
    own = settings.load(str(file))
    assert (own.state_dir, own.default_severity, own.analyst_name, own.warnings) == ("/s", "high", "a", ["unknown key other"])
    monkeypatch.delenv(settings.VARIABLE, raising=False)
    assert settings.state_folder(None, own) == "/s" and settings.state_folder("/o", own) == "/o"
    monkeypatch.setenv(settings.VARIABLE, "/e")
    assert settings.state_folder(None, own) == "/e"
    for body in ("default_severity = 'huge'", "state_dir = 3", "= x"):
        file.write_text(body)
        with pytest.raises(settings.SettingsError, match="c.toml"):
            settings.load(str(file))
    with pytest.raises(settings.SettingsError):
        settings.load(str(tmp_path / "none.toml"))


def test_schemas_fit_what_is_written(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.xml").write_text(SYSMON)
    s = CaseSession(spark, str(tmp_path / "store"), "c").create()
    s.ingest(str(tmp_path / "in"))
    s.detect()
    for what in ("events", "findings"):
        s.export(what, str(tmp_path / what))
        lines = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / what)).collect()]
        assert lines
        for x in lines:
            assert schemas.faults(x, schemas.named("export")) == []
            assert schemas.faults(x["record"], schemas.named(what.removesuffix("s"))) == []
    assert schemas.faults({"severity": "odd", "confidence": 101, "evidence": []}, schemas.named("finding"))[-3:] == ["severity: not one of informational, low, medium, high, critical", "confidence: out of range", "evidence: too few items"]
    assert schemas.faults({"confidence": True}, {"properties": {"confidence": {"type": "integer"}}}) == ["confidence: not integer"]
    assert cli.main(["schema"]) == 0 and json.loads(capsys.readouterr().out)["result"] == sorted(schemas.SCHEMAS)
    assert cli.main(["schema", "event"]) == 0 and cli.main(["schema", "nothing"]) == 2
    capsys.readouterr()
    assert cli.main(["--state-dir", str(tmp_path / "store"), "--case", "c", "--as", "table", "--rows", "1", "events"], spark) == 0
    assert "process_name" in (out := capsys.readouterr().out) and "(more rows are there)" in out
    assert cli.main(["--config", str(tmp_path / "none.toml"), "config"]) == 2


def test_cases_of_older_and_newer_layouts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.xml").write_text(SYSMON)
    s = CaseSession(spark, str(tmp_path / "store"), "old").create()
    s.ingest(str(tmp_path / "in"))
    found = s.detect(save=False).collect()
    s.store.replace("cases", spark.createDataFrame([("old", "old", "t", 1)], TABLES["cases"]))
    thin = spark.createDataFrame([("old", f"EV-{i:04d}", r["rule_id"], r["severity"], r["confidence"], r["event_id"], r["detail"], r["evidence"]) for i, r in enumerate(found, 1)], "case_id string, uid string, rule_id string, severity string, confidence int, event_id long, detail string, evidence array<long>")
    thin.write.partitionBy("case_id").parquet(str(tmp_path / "store" / "findings"))
    assert s.findings().filter("title IS NOT NULL").count() == 0
    assert s.migrate() == 1 and s.migrate() == 2
    assert s.findings().count() == len(found) == s.findings().filter("title IS NOT NULL AND size(why) = 1").count()
    s.store.replace("cases", spark.createDataFrame([("old", "old", "t", 99)], TABLES["cases"]))
    with pytest.raises(ValueError, match="layout 99"):
        s.migrate()
