import json

import pytest

from keelson import cli, config
from keelson.config import config_from
from keelson.sources import readers
from keelson.sources.store import Table


def one(spark, tmp_path, connection=None, name="CRM", path="x"):
    c = config_from({"root": str(tmp_path), "sources": [{"name": name, "path": path}], "connections": {name: connection} if connection else {}})
    return readers.read_source(spark, c.sources[0], c)


def test_no_connection_and_unknown_type_fall_back_to_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n1,x\n")
    for connection in (None, {"type": "carrier pigeon"}):
        assert one(spark, tmp_path, connection, path=str(tmp_path / "a.csv")).collect()[0].asDict() == {"a": "1", "b": "x"}


def test_placeholders_raise(spark, tmp_path):
    for kind in ("api", "stream"):
        with pytest.raises(NotImplementedError):
            one(spark, tmp_path, {"type": kind})


def test_api_by_python_data_source(spark, tmp_path):
    from pyspark.sql.datasource import DataSource, DataSourceReader

    class Rows(DataSourceReader):
        def read(self, partition):
            yield (1, "x")

    class Api(DataSource):
        @classmethod
        def name(cls):
            return "test_api"

        def schema(self):
            return "id int, v string"

        def reader(self, schema):
            return Rows()

    spark.dataSource.register(Api)
    assert [tuple(r) for r in one(spark, tmp_path, {"type": "api", "format": "test_api"}).collect()] == [(1, "x")]


def test_config(spark, tmp_path, monkeypatch):
    body = {"root": "/lake/", "sources": [{"name": "CRM", "path": "p", "entity": "customer", "similarity_threshold": 95}], "paths": {"raw_crm_customer": "/elsewhere"}}
    (tmp_path / "c.json").write_text(json.dumps(body))
    c = config.load(str(tmp_path / "c.json"))
    assert config.load(f"file://{tmp_path}/c.json", spark) == config.load(str(tmp_path / "c.json"), spark) == c
    assert c.path("raw", "CRM", "customer") == "/elsewhere" and c.path("gold", "Customer") == "/lake/gold/customer"
    assert c.sources[0].dedupe_keys == ("customer_id",)
    assert (c.threshold("CUSTOMER", "crm"), c.threshold("customer", "x"), c.threshold("customer", None)) == (95, 80, 80)
    assert [s.name for s in c.selected("crm")] == ["CRM"] and c.selected("none") == []
    monkeypatch.setenv("A_SECRET", "s")
    assert config.env_secret("A_SECRET") == "s"


def test_cli(spark, tmp_path, capsys):
    (tmp_path / "CRM.csv").write_text("id,email\n1,a@x\n")
    body = {"root": str(tmp_path / "lake"), "sources": [{"name": "CRM", "path": str(tmp_path / "CRM.csv"), "dedupe_keys": ["email"]}], "schemas": {"crm_customer": {"fields": [{"name": "customer_id", "type": "long", "natural_key": True}]}}}
    (tmp_path / "c.json").write_text(json.dumps(body))
    assert cli.main(["ingest", "--config", str(tmp_path / "c.json"), "--source", "crm"]) == 0
    assert cli.main(["bronze", "--config", str(tmp_path / "c.json")]) == 0
    table = str(tmp_path / "lake/raw/crm/customer")
    assert cli.main(["history", "--config", str(tmp_path / "c.json"), "--table", table]) == 0
    assert "overwrite" in capsys.readouterr().out
    assert Table(spark, table).count() == 1
