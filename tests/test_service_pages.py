"""The metadata service as a data source, against a service of this process: cursors, stores that are gone on with, scans."""

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from quarry import cli
from quarry.sources import service, service_pages

PAGES, NODES = 23, 3


class Fake(BaseHTTPRequestHandler):
    asked: list = []
    down_after = None

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["content-length"])))
        env, after = body["variables"]["environmentId"], body["variables"].get("after")
        resource = next((r for r in service.FIELDS if f"{r}(first" in body["query"]), "lineage")
        Fake.asked.append((env, resource, after))
        if Fake.down_after is not None and len(Fake.asked) > Fake.down_after:
            return self.answer(503, {})
        at = int(after or 0)
        if resource == "lineage":
            return self.answer(200, {"lineage": [{"uniqueId": "model.p.m1", "parentIds": ["model.p.m0", "source.p.s0"]}]})
        ids = range(at * NODES, at * NODES + NODES) if resource == "models" else range(1)
        node = {
            "models": lambda i: {"uniqueId": f"model.p.m{i}", "name": f"stg_{env}_m{i}", "filePath": f"models/staging/m{i}.sql", "materializedType": "table", "rawCode": "select 1"},
            "sources": lambda i: {"uniqueId": f"source.p.s{i}", "name": "s", "sourceName": "x"},
            "exposures": lambda i: {"uniqueId": "e", "name": "e", "parents": []},
        }[resource]
        more = resource == "models" and at + 1 < PAGES
        return self.answer(200, {resource: {"edges": [{"node": node(i)} for i in ids], "pageInfo": {"hasNextPage": more, "endCursor": str(at + 1)}}})

    def answer(self, status, applied):
        said = json.dumps({"data": {"environment": {"applied": applied}}}).encode()
        self.send_response(status)
        self.send_header("content-length", str(len(said)))
        self.end_headers()
        self.wfile.write(said)

    def log_message(self, *args):
        pass


@pytest.fixture
def url():
    Fake.asked, Fake.down_after = [], None
    server = ThreadingHTTPServer(("127.0.0.1", 0), Fake)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/graphql"
    server.shutdown()


def test_pages_of_several_environments(spark, url, tmp_path):
    own = service_pages.read_service(spark, url, {5: "shop", 6: "bank"}, str(tmp_path / "store"), "t")
    models = own.models.collect()
    assert {(r["project_id"], r["name"]) for r in models} == {(p, f"stg_{e}_m{i}") for e, p in ((5, "shop"), (6, "bank")) for i in range(PAGES * NODES)} and len(models) == 2 * PAGES * NODES
    assert {(r["project_id"], r["child_id"], r["parent_id"]) for r in own.edges.collect()} == {(p, "model.p.m1", x) for p in ("shop", "bank") for x in ("model.p.m0", "source.p.s0")}
    # A partition an environment and resource; each page was asked for once.
    assert len(Fake.asked) == len(set(Fake.asked)) == 2 * (PAGES + 3)


def test_a_store_is_gone_on_with(spark, url, tmp_path):
    store = str(tmp_path / "store")
    Fake.down_after = 14
    with pytest.raises(Exception, match="503"):
        service_pages.pull(spark, url, {5: "shop"}, store, "t", pages=4)
    kept = service_pages.stored(spark, store).filter("resource = 'models'").count()
    assert 4 <= kept < PAGES and kept % 4 == 0
    Fake.asked, Fake.down_after = [], None
    found = service_pages.pull(spark, url, {5: "shop"}, store, "t", pages=4)
    assert sorted(r["page"] for r in found.filter("resource = 'models'").collect()) == list(range(PAGES))
    assert [x for x in Fake.asked if x[1] == "models"] == [(5, "models", str(p)) for p in range(kept, PAGES)]
    Fake.asked = []
    assert service_pages.pull(spark, url, {5: "shop"}, store, "t").count() == PAGES + 3 and Fake.asked == []


def test_a_scan_of_the_service(spark, url, tmp_path, monkeypatch, capsys):
    monkeypatch.setattr(cli, "_session", lambda: spark)
    monkeypatch.setenv(service.TOKEN, "t")
    (tmp_path / "models" / "staging").mkdir(parents=True)
    (tmp_path / "models" / "staging" / "m2.sql").write_text("select * from prod.a.b")
    at = tmp_path / "out.json"
    told = ["scan", "--project-dir", str(tmp_path), "--service", "--service-url", url, "--environment", "5", "--project", "shop", "--rules", "materialization,style", "--output", "json", "--output-file", str(at)]
    assert cli.main(told) == 0
    rows = json.loads(at.read_text())
    assert sum(r["rule_id"] == "materialization.staging_must_be_view" for r in rows) == PAGES * NODES
    assert [r["model_name"] for r in rows if r["rule_id"] == "style.no_hardcoded_schema"] == ["stg_5_m2"]
    monkeypatch.delenv(service.TOKEN)
    assert cli.main(told) == 1 and service.TOKEN in capsys.readouterr().err
