import json

import pytest

from leadloom.operators import linked


def page(*blocks):
    return "<html>" + "".join(f'<script type="application/ld+json">{b if isinstance(b, str) else json.dumps(b)}</script>' for b in blocks) + "</html>"


def walk(spark, *pages, most=linked.MOST):
    return linked.walked(linked.blocks(spark.createDataFrame(list(enumerate(pages)), "id int, html string").repartition(2), "id", "html"), "id", most)


def every(value, name=None, depth=0):
    yield depth, name
    for k, v in value.items() if isinstance(value, dict) else ((None, v) for v in value) if isinstance(value, list) else ():
        yield from every(v, k, depth + 1)


def test_every_value_at_any_depth(spark):
    deep = 1
    for i in range(20):
        deep = {"a": deep, "b": [i, {"c": None}]} if i % 2 else [deep, []]
    got = sorted(((r.depth, r.name) for r in walk(spark, page(deep, [], "no json", 7)).collect()), key=str)
    assert got == sorted([*every(deep), *every([]), *every(7)], key=str)


def test_too_deep_raises(spark):
    with pytest.raises(ValueError):
        walk(spark, page([[[[1]]]]), most=3)
    assert walk(spark, page([[[[1]]]]), most=4).count() == 5


def test_products_by_hand(spark):
    first = {"@graph": [{"@type": "ItemList", "itemListElement": [{"@type": "ListItem", "item": {"@type": ["Thing", "Product"], "name": " Ring ", "url": "/ring", "offers": [{"price": 9.5}], "image": {"url": "r.png"}}}, {"@type": "Product", "name": "ring two", "url": "/RING"}]},
                        {"mainEntity": {"hasOfferCatalog": {"other": {"@type": "product", "name": "Bolt", "@id": "#b", "offers": {"price": "3"}, "image": ["b.png", "c.png"]}}}}]}
    second = [{"@type": "Product", "name": ""}, {"@type": "Product", "name": "Lone"}, {"@type": "Product", "name": "LONE"}, {"@type": "Person", "name": "x", "Email": "mailto:Info@Brand.com", "c": {"email": "noreply@brand.com"}}]
    rows = walk(spark, page(first, second), None, "", page("{broken"), "<script>{}</script>")
    got = {(r.id, r["name"], r.link, r.price, r.image) for r in linked.products(rows, "id").collect()}
    # of one link the shallower entry counts
    assert got == {(0, "ring two", "/RING", "", ""), (0, "Bolt", "#b", "3", "b.png"), (0, "Lone", "", "", "")}
    assert [tuple(r) for r in linked.emails(rows, "id").collect()] == [(0, "info@brand.com")]


def test_a_batch_of_long_documents_stays_small(spark):
    """A reader's batch ends with a row group, so no row group of outer levels holds many whole documents."""
    import pyarrow.parquet as pq

    pages = [page([{"name": f"{i} {j} {(i * 7919 + j) ** 5}", "email": f"a{j}@b{i}.com"} for j in range(400)]) for i in range(300)]
    rows = walk(spark, *pages)
    assert linked.emails(rows, "id").count() == 300 * 400
    files = [pq.ParquetFile(f.removeprefix("file://")) for f in rows.filter("depth = 0").inputFiles()]
    sizes = [(g.num_rows, g.total_byte_size) for f in files for g in (f.metadata.row_group(i) for i in range(f.num_row_groups))]
    assert max(n for n, size in sizes if size / n > 10_000) <= 100


def test_nodes_are_those_of_the_walk(spark):
    """In one pass and without a written level: the rows of the walk, in its order, with whole values."""
    first = {"email": "a@x.com", "list": [{"Email": ["b@x.com"], "z": {"email": None}}, [[{"email": {"email": 5}}]], {}], "b": {"email": "c@x.com", "@type": ["Product"], "name": "n"}}
    pages = [page(first, [first, {"@type": "product"}], "no json", 7, []), None, page({"email": "d@x.com"})]
    found = linked.blocks(spark.createDataFrame(list(enumerate(pages)), "id int, html string").repartition(2), "id", "html")
    for wanted in (linked.is_email, linked.is_product, lambda name, value: linked.F.lit(True)):
        got = linked.nodes(found, "id", wanted)
        in_order = lambda rows: [tuple(r) for r in rows.orderBy("id", "block", "depth", "path").selectExpr("id", "block", "depth", "name", "to_json(value)").collect()]
        assert in_order(got) == in_order(linked.walked(found, "id").filter(wanted(linked.F.col("name"), linked.F.col("value"))))
        assert "parquet" not in got._jdf.queryExecution().optimizedPlan().toString().lower()


def test_nodes_of_a_document_that_is_too_deep_raise(spark):
    found = linked.blocks(spark.createDataFrame([(1, page([[[[1]]]]))], "id int, html string"), "id", "html")
    every = lambda name, value: linked.F.lit(True)
    assert linked.nodes(found, "id", every, most=4).count() == 5
    with pytest.raises(Exception, match="deeper than 3"):
        linked.nodes(found, "id", every, most=3).count()
