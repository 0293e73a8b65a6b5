"""Statistics of documents and columns on small fixtures."""

from folia.operators import markup, statistics


def test_document_statistics(spark):
    docs = spark.createDataFrame([("a", "xml", "<r><x k='1'>one two</x><y><z>three</z></y></r>"), ("b", "csv", "h,i\n1,2 3\n"), ("c", "xml", None), ("d", "html", "<p>" + "w " * 600 + "</p>"), ("e", "xml", "<broken")], "doc_id string, doc_type string, content string")
    got = {r.doc_id: r for r in statistics.document_statistics(markup.explode_mixed(docs)).collect()}
    assert (got["a"].words, got["a"].characters, got["a"].depth_of_paths, got["a"].top, got["a"].by_type["xml_text"]) == (3, 12, 3, "r", 2)
    assert got["b"].words == 3 and got["b"].by_type == {"root": 1, "table": 1, "table_header_row": 1, "table_row": 1, "table_cell": 2}
    assert got["d"].words == 600 and got["d"].pages == 2 and got["c"].words == 0 and got["c"].pages == 1 and got["e"].elements == 1
    assert statistics.document_statistics(markup.explode_mixed(docs.limit(0))).count() == 0


def test_column_statistics(spark):
    text = "name,when,mixed,empty\n" + "".join(f"n{k},{k % 12 + 1}pm,{'3pm' if k < 5 else 'word'},\n" for k in range(20))
    rows = markup.explode_markup(spark.createDataFrame([("t", text), ("u", "only,head"), ("v", None)], "doc_id string, content string"), "csv")
    got = {r.header: r for r in statistics.column_statistics(statistics.cells(rows)).collect()}
    assert {h: (r.is_identity, r.is_temporal, r.inferred_type, r.cells) for h, r in got.items()} == {"name": (True, False, "string", 20), "when": (False, True, "string", 20), "mixed": (False, False, "string", 20), "empty": (False, False, "string", 20)}
