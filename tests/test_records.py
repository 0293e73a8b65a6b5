"""Paged services over recorded pages: shapes, paging and filters that leave pages unread."""

import json

from pyspark.sql import functions as F

from folia.sources import records


def record(folder, collection, start, page):
    (folder / collection).mkdir(exist_ok=True)
    (folder / collection / f"{start}.json").write_text(json.dumps(page))


def issue(k, **more):
    return {"key": f"OPS-{k}", "fields": {"summary": f"issue {k}", "updated": f"2024-01-{k:02d}", **more}}


def load(spark, folder, service, collections, **more):
    records.register(spark)
    r = spark.read.format("records").option("service", service).option("collections", collections).option("template", f"file://{folder}/{{collection}}/{{start}}.json")
    for k, v in more.items():
        r = r.option(k, v)
    return r.load()


def test_issues_page_by_page(spark, tmp_path):
    issues = [issue(1, description="why", comment={"comments": [{"body": "c1"}, {"body": "c2"}]}, subtasks=[{"fields": {"summary": "part"}}]), *(issue(k) for k in range(2, 8))]
    for at in range(0, 7, 2):
        record(tmp_path, "OPS", at, {"total": 7, "issues": issues[at : at + 2]})
    record(tmp_path, "NONE", 0, {"total": 0, "issues": []})
    df = load(spark, tmp_path, "jira", "OPS, NONE", pagesize="2", pagespertask="2")
    rows = {r.source_id: r for r in df.collect()}
    assert len(rows) == 7 and df.rdd.getNumPartitions() == 2
    assert rows["jira://OPS/OPS-1"].content == "issue 1\n\nwhy\n\nc1\n\nc2\n\npart" and rows["jira://OPS/OPS-3"].title == "issue 3"
    assert df.where("updated >= '2024-01-06'").count() == 2 and json.loads(rows["jira://OPS/OPS-2"].record)["key"] == "OPS-2"


def test_filters_leave_pages_unread(spark, tmp_path):
    record(tmp_path, "A", 0, {"totalSize": 1, "results": [{"id": "1", "title": "t", "body": {"storage": {"value": "<p>x</p>"}}, "children": {"comment": {"results": [{"body": {"storage": {"value": "said"}}}]}, "attachment": {"results": [{"title": "f.pdf"}]}}}]})
    # B and the person's space have no pages: to ask for one would fail
    df = load(spark, tmp_path, "confluence", "A,B,~kim")
    got = df.where(F.col("collection") == "A")
    assert [(r.source_id, r.content) for r in got.collect()] == [("confluence://A/1", "<p>x</p>\n\nsaid\n\nf.pdf")]
    assert "Filter (collection" not in got._jdf.queryExecution().executedPlan().toString()
    assert df.where("collection in ('A', 'Z')").count() == 1 and df.where("collection = 'Z'").count() == 0


def test_since_goes_into_the_address(spark, tmp_path):
    record(tmp_path, "inc-2024-05", 0, {"total": 1, "result": [{"sys_id": "9", "short_description": "new", "sys_updated_on": "2024-05-02"}]})
    records.register(spark)
    df = spark.read.format("records").option("service", "servicenow").option("collections", "inc").option("template", f"file://{tmp_path}/{{collection}}-{{since}}/{{start}}.json").load()
    assert [r.title for r in df.where("updated >= '2024-05'").collect()] == ["new"]
