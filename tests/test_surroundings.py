"""Stores, outputs, rights, workspaces, the server, the command line and streams."""

import io
import json
import threading
from urllib.request import urlopen

import pytest

from hyperstar import cli
from hyperstar.auth import SimpleAuthorizer
from hyperstar.errors import ArgumentError, ConfigurationError, NoSuchTableError, NotAuthorized, StoreError
from hyperstar.model import Cube, ModelProvider
from hyperstar.server import Service, make_server
from hyperstar.sources import output
from hyperstar.sources.querylog import AsyncRequestLog, CSVHandler, JSONHandler, RequestLog, TableHandler
from hyperstar.sources.remote import RemoteBrowser, RemoteProvider, RemoteStore
from hyperstar.sources.store import SparkStore, read_csv
from hyperstar.streaming.live import LiveCube
from hyperstar.workspace import Workspace

MODEL = {
    "name": "shop",
    "marts": [{"name": "sales", "label": "Sales", "dimensions": ["date", "item"], "measures": ["amount"], "aggregates": [{"name": "amount_sum", "label": "Amount", "measure": "amount", "function": "sum"}, {"name": "record_count", "function": "count"}], "fact": "facts", "joins": [["id_date", "date.id"], ["id_item", "item.id"]]}],
    "dimensions": [{"name": "date", "role": "time", "levels": ["year", "month", "day"], "info": {"x": 1}}, {"name": "item", "attributes": ["id", "name"], "label": "Item"}],
}


@pytest.fixture(scope="module")
def tables(spark):
    return {
        "facts": spark.createDataFrame([(i, 20130901 + i % 30, 1 + i % 4, 10 * i) for i in range(1, 11)], "id int, id_date int, id_item int, amount int"),
        "date": spark.createDataFrame([(20130900 + d, 2013, 9, d) for d in range(1, 31)], "id int, year int, month int, day int"),
        "item": spark.createDataFrame([(1, "apple"), (2, "pear"), (3, "plum"), (4, "kiwi")], "id int, name string"),
    }


@pytest.fixture
def workspace(spark, tables):
    w = Workspace(spark, {})
    w.register_store(store=SparkStore(spark, tables=tables))
    w.import_model(MODEL)
    return w


@pytest.fixture(scope="module")
def folder(tables, tmp_path_factory):
    path = tmp_path_factory.mktemp("store")
    for n, df in tables.items():
        df.write.parquet(str(path / f"{n}.parquet"))
    (path / "model.json").write_text(json.dumps(MODEL))
    (path / "shop.ini").write_text(f"[workspace]\nroot_directory = {path}\n[store]\npath = {path}\n[models]\nmain = model.json\n")
    return path


def test_store_from_files(spark, folder):
    store = SparkStore(spark, str(folder))
    assert {"facts", "date", "item"} <= set(store.table_names())
    assert store.table("item").count() == 4
    with pytest.raises(NoSuchTableError):
        store.table("nothing")


def test_sinks(spark, tables, tmp_path):
    store = SparkStore(spark, str(tmp_path), tables=tables, denormalized_prefix="wide_", aggregate_prefix="agg_")
    p = ModelProvider(MODEL)
    cube = p.cube("sales").link(p.dimension)
    wide = store.create_denormalized_view(cube, materialize=True, create_index=True)
    assert wide.columns == ["id", "date.year", "date.month", "date.day", "item.id", "item.name", "amount"] and wide.count() == 10
    assert store.wide_browser(cube).aggregate("item:1", ["amount_sum"]).summary == store.browser(cube).aggregate("item:1", ["amount_sum"]).summary
    keys = store.create_denormalized_view(cube, "keys", materialize=True, keys_only=True)
    assert "item.name" not in keys.columns
    with pytest.raises(StoreError):
        store.create_denormalized_view(cube, "facts")
    with pytest.raises(StoreError):
        store.create_denormalized_view(cube, materialize=True)
    store.create_denormalized_view(cube, "shown")
    assert spark.table("shown").count() == 10
    made = store.create_cube_aggregate(cube, dimensions=["item"])
    assert {r["item.id"]: r["record_count"] for r in made.collect()} == {1: 2, 2: 3, 3: 3, 4: 2}
    assert store.create_conformed_rollups(cube, ["date"])["date_month"].collect()[0].asDict() == {"year": 2013, "month": 9}
    assert store.create_table_from_statement(tables["item"], "copy").count() == 4


def test_discovery_and_validation(spark, tables):
    store = SparkStore(spark, tables={"ft_sales": tables["facts"], "dm_item": tables["item"]}, fact_prefix="ft_", dimension_prefix="dm_")
    assert store.discover_facts() == ["sales"] and store.discover_dimensions() == ["item"]
    assert store.discovered_model("sales")["marts"][0]["measures"] == ["id_date", "id_item", "amount"]
    p = ModelProvider(MODEL)
    cube = p.cube("sales").link(p.dimension)
    assert SparkStore(spark, tables=tables).validate(cube) == []
    broken = SparkStore(spark, tables=tables | {"item": tables["item"].drop("name")})
    assert [(k, w) for k, w, _ in broken.validate(cube)] == [("attribute", "item.name")]


def test_csv_in_and_out(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text("name,n,day\na,1,2020-01-02\nb,2,\n")
    df = read_csv(spark, str(path), ["name", ("n", "integer"), ("day", "date")], create_id=True)
    assert [(r.id, r.n, str(r.day)) for r in df.collect()] == [(1, 1, "2020-01-02"), (2, 2, "None")]
    assert "".join(output.csv_lines(df, ["name", "n"], lineterminator="\n")) == "name,n\na,1\nb,2\n"
    with pytest.raises(ArgumentError):
        read_csv(spark, str(path), [("n", "quaternion")])
    output.write_rows(df, str(tmp_path / "out"), "json")
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_formats(workspace):
    r = workspace.browser("sales").aggregate(drilldown=["item"], aggregates=["amount_sum"])
    assert json.loads(output.formatted("json", r))["summary"] == {"amount_sum": 550}
    assert output.formatted("csv", r).splitlines()[0] == "item.id,item.name,amount_sum"
    assert len(output.formatted("json_lines", r).splitlines()) == 4
    assert output.formatted("html_cross_table", r, rows=["item.name"], columns=[]).count("<tr>") == 5
    assert json.loads(output.formatted("cross_table", r, rows=["item.name"], columns=[]))["rows"][0] == ["apple"]
    assert json.loads(output.to_json(iter(range(5000)))) == list(range(1000))
    with pytest.raises(ArgumentError):
        output.formatted("smoke", r)


def marts(*names):
    return [Cube(n) for n in names]


@pytest.mark.parametrize(("order", "wins"), [("deny_allow", True), ("allow_deny", False)])
@pytest.mark.parametrize("denied", ["stock", "st*", "*"])
@pytest.mark.parametrize("allowed", ["stock", "*ck", "*"])
def test_order_of_rights(order, wins, denied, allowed):
    """Where a mart is both denied and allowed, what comes later in the order wins."""
    a = SimpleAuthorizer({"clerk": {"denied_marts": [denied], "allowed_marts": [allowed]}}, order=order)
    assert bool(a.authorize("clerk", marts("stock"))) == wins


def test_rights_and_roles():
    rights = {"lead": {"roles": ["buyer"]}, "temp": {"denied_marts": ["stock"]}, "visitor": {}, "auditor": {"allowed_marts": ["st*", "*lls"]}}
    a = SimpleAuthorizer(rights, {"reader": {"allowed_marts": ["stock"]}, "buyer": {"roles": ["reader"]}}, guest="visitor")
    seen = {who: [c.name for c in a.authorize(who, marts("stock", "bills", "wages"))] for who in ("lead", "temp", "auditor", "nobody")}
    assert seen == {"lead": ["stock"], "temp": ["bills", "wages"], "auditor": ["stock", "bills"], "nobody": ["stock", "bills", "wages"]}
    assert SimpleAuthorizer().authorize("lead", marts("stock")) == []
    with pytest.raises(ConfigurationError):
        SimpleAuthorizer(roles={"one": {"roles": ["two"]}, "two": {"roles": ["one"]}})


def test_details_show_no_more_than_the_cell(spark, tables):
    w = Workspace(spark, {}, SimpleAuthorizer({"clerk": {"cell_restrictions": {"sales": ["item:1;2"]}}}))
    w.register_store(store=SparkStore(spark, tables=tables))
    w.import_model(MODEL)
    b = w.browser("sales", identity="clerk")
    assert b.path_details("item", [3]) is None and b.path_details("item", [2])["item.name"] == "pear"
    assert [x and x[0]["_label"] for x in b.cell_details("item:1;4")[0]] == ["apple", None]


def test_limits_of_answers(workspace):
    s = Service(workspace, record_limit=2)
    ask = lambda path, method="GET", body=b"", **args: s.answer(method, path, args, body)
    assert len(json.loads(ask("/cube/sales/aggregate", drilldown="item")[2])["cells"]) == 2
    assert len(ask("/cube/sales/facts", format="csv")[2].splitlines()) == 11
    status, _, content = ask("/cube/sales/report", "POST", json.dumps({"queries": {"a": {"query": "aggregate", "odd": 1}}}).encode())
    assert status == 400 and b"odd" in content
    status, _, parts = s.streamed("GET", "/cube/sales/facts", {"format": "json_lines"})
    assert status == 200 and sum(1 for _ in parts) >= 10


def test_restricted_cells(spark, tables):
    rights = {"ann": {"cell_restrictions": {"sales": ["item:1;2"]}}, "bob": {"hierarchy_limits": {"*": ["date:month"]}}}
    w = Workspace(spark, {}, SimpleAuthorizer(rights))
    w.register_store(store=SparkStore(spark, tables=tables))
    w.import_model(MODEL)
    b = w.browser("sales", identity="ann")
    assert [c["item.id"] for c in b.aggregate(drilldown=["item"]).cells] == [1, 2] and b.facts().count() == 5
    assert not b.cell().public_cell().cuts and b.report(None, {"f": {"query": "facts"}})["f"].count() == 5
    assert w.cube("sales", "bob").dimension("date").hierarchy().level_names == ["year", "month"]
    assert w.cube("sales", "ann").dimension("date").hierarchy().level_names == ["year", "month", "day"]
    with pytest.raises(NotAuthorized):
        w.browser("sales", identity="eve")
    own = SimpleAuthorizer({"3": {}}, identity_dimension="item")
    assert str(own.restricted_cell("3", w.cube("sales", "ann"), None)) == "item@default:3"


def test_configuration(spark, folder, tables):
    w = Workspace(spark, str(folder / "shop.ini"))
    assert w.list_marts()[0]["name"] == "sales" and w.browser("sales").aggregate().summary["record_count"] == 10
    with pytest.raises(ConfigurationError):
        w.store("other")
    with pytest.raises(ConfigurationError):
        Workspace(spark, "/nowhere.ini")
    assert w.browser("sales", include_summary=False, include_cell_count=False).aggregate(drilldown=["item"]).total_cell_count is None


def test_service(workspace):
    ask = lambda path, method="GET", body=b"", **args: Service(workspace).answer(method, path, args, body)
    status, kind, content = ask("/cube/sales/aggregate", drilldown="date", format="csv")
    assert (status, content.decode()) == (200, "date.year,Amount,record_count\n2013,550,10\n")
    assert ask("/cube/sales/aggregate", drilldown="date", format="csv", header="names")[2].decode().startswith("date.year,amount_sum,record_count")
    assert ask("/cube/sales/aggregate", drilldown="date", format="csv", header="none")[2] == b"2013,550,10\n"
    assert json.loads(ask("/cube/sales/aggregate", cut="item:1", aggregates="record_count")[2])["summary"] == {"record_count": 2}
    assert len(json.loads(ask("/cube/sales/facts", cut="item:1", fields="amount")[2])) == 2
    assert json.loads(ask("/cube/sales/fact/3")[2])["amount"] == 30 and ask("/cube/sales/fact/99")[0] == 404
    assert [r["item.name"] for r in json.loads(ask("/cube/sales/members/item", order="item.name")[2])["data"]] == ["apple", "kiwi", "pear", "plum"]
    assert json.loads(ask("/cube/sales/cell", cut="item:1")[2])["cuts"][0]["details"][0]["_label"] == "apple"
    report = json.dumps({"queries": {"a": {"query": "aggregate", "aggregates": ["record_count"]}}}).encode()
    assert json.loads(ask("/cube/sales/report", "POST", report, cut="item:1")[2])["a"]["summary"] == {"record_count": 2}
    assert [ask(p)[0] for p in ("/", "/version", "/info", "/marts", "/cube/sales/model", "/cube/none/model", "/odd", "/cube/sales/odd")] == [200] * 5 + [404] * 3
    assert ask("/cube/sales/aggregate", cut="nonsense")[0] == 400 and ask("/cube/sales/aggregate", page="x")[0] == 400


def test_remote(workspace):
    server = make_server(workspace, port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://localhost:{server.server_port}"
    try:
        assert json.load(urlopen(f"{url}/version"))["version"]
        store = RemoteStore(url)
        b = RemoteBrowser(store, "sales")
        assert b.aggregate("item:1", drilldown=["date"])["cells"][0]["record_count"] == 2
        assert len(b.facts("item:1")) == 2 and b.fact(1)["amount"] == 10 and len(b.members(dimension="item")) == 4
        assert b.report("item:2", {"x": {"query": "aggregate"}})["x"]["summary"]["record_count"] == 3
        assert RemoteProvider(store).cube("sales").aggregate("amount_sum").function == "sum"
        with pytest.raises(ArgumentError):
            b.aggregate("nonsense")
    finally:
        server.shutdown()


def test_request_logs(spark, tmp_path):
    table = TableHandler(spark, str(tmp_path / "log"), batch=1)
    log = RequestLog(CSVHandler(str(tmp_path / "a.csv")), JSONHandler(str(tmp_path / "a.json")), table)
    with log.request("aggregate", "sales", "item:1", "ann"):
        pass
    assert json.loads((tmp_path / "a.json").read_text())["cube"] == "sales"
    assert spark.read.parquet(str(tmp_path / "log")).first()["identity"] == "ann"
    later = AsyncRequestLog(CSVHandler(str(tmp_path / "b.csv")))
    with later.request("facts", "sales"):
        pass
    later.close()
    assert "facts" in (tmp_path / "b.csv").read_text()


def run(spark, *args):
    out = io.StringIO()
    return cli.main(list(args), spark, out), out.getvalue()


def test_command_line(spark, folder, tmp_path):
    ini = str(folder / "shop.ini")
    assert run(spark, "list", ini) == (0, "sales\n")
    assert run(spark, "model", "validate", str(folder / "model.json")) == (0, "the model is sound\n")
    assert run(spark, "model", "convert", str(folder / "model.json"), "--target", str(tmp_path / "m.bundle"))[0] == 0
    assert run(spark, "test", ini, "--aggregate") == (0, "sales: ok\n")
    assert json.loads(run(spark, "aggregate", ini, "sales", "--aggregate", "record_count")[1])["summary"] == {"record_count": 10}
    assert run(spark, "aggregate", ini, "sales", "--drilldown", "item", "--aggregate", "record_count", "--format", "csv")[1].splitlines()[1] == "1,apple,2"
    assert json.loads(run(spark, "aggregate", ini, "sales", "--drilldown", "item", "--aggregate", "record_count", "--on-rows", "item.name")[1])["data"][0] == [2]
    assert len(json.loads(run(spark, "members", ini, "sales", "item")[1])) == 4
    assert run(spark, "preaggregate", ini, "sales", "--table", "pre", "--dimension", "item")[0] == 0
    assert run(spark, "aggregate", ini, "nothing")[0] == 1


def test_stream(spark, tmp_path):
    rows = [(i, f"2024-01-01 00:0{i % 6}:00", ["a", "b"][i % 2], float(i)) for i in range(12)]
    df = spark.createDataFrame(rows, "id int, ts string, kind string, value double").selectExpr("id", "cast(ts as timestamp) ts", "kind", "value")
    df.write.parquet(str(tmp_path / "in"))
    model = {"marts": [{"name": "events", "key": "id", "dimensions": ["kind"], "measures": ["value"], "aggregates": [{"name": "n", "function": "count"}, {"name": "s", "measure": "value", "function": "sum"}], "mappings": {"kind.kind": "kind"}}], "dimensions": ["kind"]}
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    w = Workspace(spark, {})
    w.register_store(store=SparkStore(spark, tables={"events": stream}))
    w.import_model(model)
    live = LiveCube(w.browser("events"), "ts")
    q = live.aggregate("2 minutes", cell="kind:a", drilldown=["kind"]).writeStream.outputMode("update").format("memory").queryName("live").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert sorted((r.n, r.s) for r in spark.table("live").collect()) == [(2, 6.0), (2, 10.0), (2, 14.0)]
    assert live.sessions("kind", "1 minute").columns == ["kind.kind", "session_start", "session_end", "events"]
