import json

import pytest

from hyperstar.errors import ExpressionError, HierarchyError, ModelError, NoSuchAttributeError, NoSuchCubeError, NoSuchDimensionError, TemplateRequired
from hyperstar.model import Attribute, Cube, Dimension, Measure, ModelProvider, read_model, write_bundle
from hyperstar.model.attributes import in_order_of_dependency
from hyperstar.model.provider import validate
from hyperstar.namespace import Namespace

DATE = {"name": "date", "role": "time", "levels": ["year", {"name": "month", "attributes": ["month", "month_name"], "order": "desc"}, "day", "unused"], "hierarchies": [{"name": "ymd", "levels": ["year", "month", "day"]}, {"name": "ym", "levels": ["year", "month"]}]}


def test_flat_dimension():
    d = Dimension.from_metadata("flag")
    assert d.is_flat and not d.has_details
    assert d.levels[0].key.ref == "flag.flag"


def test_levels_and_hierarchies():
    d = Dimension.from_metadata(DATE)
    assert [x.name for x in d.levels] == ["year", "month", "day"]  # one is in no hierarchy
    month = d.level("month")
    assert (month.key.name, month.label_attribute.name, month.order_attribute.name) == ("month", "month_name", "month")
    assert d.level("year").role == "year" and d.has_details and d.hierarchy().name == "ymd"
    h = d.hierarchy("ym")
    assert h.next_level("year").name == "month" and h.next_level("month") is None and h.previous_level("month").name == "year"
    assert h.rollup([2010, 1]) == [2010] and h.path_is_base([2010, 1])
    assert [x.name for x in h.levels_for_path([2010], drilldown=True)] == ["year", "month"]
    with pytest.raises(HierarchyError):
        h.levels_for_depth(3)
    with pytest.raises(HierarchyError):
        d.hierarchy("nope")


@pytest.mark.parametrize(
    "bad",
    [
        {"levels": ["a"]},
        {"name": "d", "levels": []},
        {"name": "d", "levels": ["a", "a"]},
        {"name": "d", "levels": ["a"], "hierarchy": ["a"], "hierarchies": [{"name": "h", "levels": ["a"]}]},
        {"name": "d", "levels": ["a"], "hierarchy": ["b"]},
        {"name": "d", "levels": ["a"], "attributes": ["b"]},
        {"name": "d", "cardinality": "enormous"},
    ],
)
def test_bad_dimensions(bad):
    with pytest.raises(ModelError):
        Dimension.from_metadata(bad)


def test_templates():
    base = Dimension.from_metadata(DATE)
    with pytest.raises(TemplateRequired):
        Dimension.from_metadata({"name": "contract", "template": "date"})
    d = Dimension.from_metadata({"name": "contract", "template": "date", "hierarchy": ["year", "month"], "label": "Contract"}, {"date": base})
    assert [a.ref for a in d.attributes] == ["contract.year", "contract.month", "contract.month_name"] and d.label == "Contract"


def test_template_circles():
    p = ModelProvider({"marts": [{"name": "c", "dimensions": ["a"]}], "dimensions": [{"name": "a", "template": "b"}, {"name": "b", "template": "a"}]})
    space = Namespace()
    space.add_provider(p)
    with pytest.raises(ModelError):
        space.cube("c")


def test_clone():
    d = Dimension.from_metadata(DATE).clone(hierarchies=["ym"], alias="shipped", nonadditive="any")
    assert d.name == "shipped" and list(d.hierarchies) == ["ym"] and [a.ref for a in d.attributes][:1] == ["shipped.year"]
    assert d.levels[0].nonadditive == "any"
    with pytest.raises(ModelError):
        Dimension.from_metadata(DATE).clone(hierarchies=[])


def test_aggregates():
    assert [a.name for a in Cube.from_metadata({"name": "c"}).aggregates] == ["fact_count"]
    c = Cube.from_metadata({"name": "c", "measures": [{"name": "amount", "aggregates": ["sum", "min", "identity"]}, "price"], "implicit_aggregates": True})
    assert [(a.name, a.function) for a in c.aggregates] == [("amount_sum", "sum"), ("amount_min", "min"), ("amount", None), ("price_sum", "sum")]
    assert c.aggregate("amount_sum").label == "Sum of amount"
    assert not Cube.from_metadata({"name": "c", "measures": ["amount"]}).aggregates
    with pytest.raises(ModelError):
        Cube.from_metadata({"name": "c", "measures": ["amount"], "aggregates": [{"name": "amount_sum", "measure": "amount", "function": "min"}], "implicit_aggregates": True})
    with pytest.raises(ModelError):
        Measure("m", nonadditive="sometimes")


def test_attributes_of_marts():
    p = ModelProvider({"marts": [{"name": "c", "dimensions": ["flag", "date"], "measures": ["amount"], "details": ["note"]}], "dimensions": ["flag", DATE]})
    c = p.cube("c").link(p.dimension)
    assert c.attribute("flag").ref == "flag.flag" and c.attribute("date.month").name == "month"
    with pytest.raises(NoSuchAttributeError):
        c.attribute("date")
    with pytest.raises(NoSuchDimensionError):
        c.dimension("nope")
    with pytest.raises(NoSuchCubeError):
        p.cube("nope")


def test_two_links_of_one_dimension():
    p = ModelProvider({"marts": [{"name": "c", "dimensions": ["date", {"name": "date", "alias": "shipped"}]}], "dimensions": [DATE]})
    assert list(p.cube("c").link(p.dimension).dimensions) == ["date", "shipped"]


def test_dependencies():
    needs = {"d": {"c"}, "c": {"a", "b"}, "b": {"a"}, "a": set()}
    order = in_order_of_dependency([Attribute(n) for n in "dcba"], lambda a: needs[a.name])
    assert [a.name for a in order] == ["a", "b", "c", "d"]
    with pytest.raises(ExpressionError, match="circular"):
        in_order_of_dependency([Attribute("a"), Attribute("b")], lambda a: {"a": {"b"}, "b": {"a"}}[a.name])
    with pytest.raises(ExpressionError, match="unknown"):
        in_order_of_dependency([Attribute("a")], lambda a: {"z"})


def test_join_and_mapping_templates():
    p = ModelProvider({"joins": [{"name": "d", "master": "f.k", "detail": "d.k"}], "mappings": {"x": "t.x"}, "marts": [{"name": "c", "joins": [{"name": "d", "method": "master"}], "mappings": {"y": "t.y"}}]})
    c = p.cube("c")
    assert c.joins == [{"name": "d", "master": "f.k", "detail": "d.k", "method": "master"}] and c.mappings == {"x": "t.x", "y": "t.y"}


def test_bundles(tmp_path):
    model = {"name": "m", "marts": [{"name": "c", "dimensions": ["date"]}], "dimensions": [DATE]}
    write_bundle(str(tmp_path / "m.bundle"), model)
    assert read_model(str(tmp_path / "m.bundle")) == {"name": "m", "marts": model["marts"], "dimensions": [DATE]}
    (tmp_path / "m.json").write_text(json.dumps(model))
    assert ModelProvider(str(tmp_path / "m.json")).list_marts()[0]["name"] == "c"


def test_validation():
    assert validate({"name": "m", "marts": [{"name": "c", "dimensions": ["d"], "measures": ["x"], "aggregates": [{"name": "s", "measure": "x", "function": "sum"}]}], "dimensions": ["d"]}) == []
    issues = validate({"marts": [{"name": "c", "aggregates": [{"name": "s", "function": "sum"}], "odd": 1}, {"name": "c"}], "dimensions": [{"name": "d", "template": "none"}]})
    assert {s for s, _, _ in issues} == {"default", "error", "warning"}


def test_namespaces_and_languages():
    top = Namespace()
    top.add_provider(ModelProvider({"dimensions": ["flag"]}))
    own = {"marts": [{"name": "c", "label": "Cube", "dimensions": ["flag"]}], "translations": {"de": {"marts": {"c": {"label": "Würfel", "dimensions": {"flag": {"label": "Fahne"}}}}}}}
    top.create_namespace("a.b").add_provider(ModelProvider(own))
    assert top.cube("a.b.c").dimension("flag").name == "flag"
    german = top.cube("a.b.c", "de")
    assert german.label == "Würfel" and german.dimension("flag").label == "Fahne" and german.namespace == "a.b"
    assert [c["name"] for c in top.list_marts(recursive=True)] == ["a.b.c"]
