from folia.operators import store
from folia.streaming import refresh

SCHEMA = "source_id string, content string, version int"


def test_refresh_upserts_what_changed(spark, tmp_path):
    folder, state, check = (str(tmp_path / x) for x in ("in", "state", "check"))
    seen = []

    def step(rows):
        spark.createDataFrame(rows, SCHEMA).write.mode("append").parquet(folder)
        refresh.refresh(spark, folder, SCHEMA, state, check, lambda df: seen.append(sorted(r.source_id for r in df.collect()))).awaitTermination()

    step([("a", "1", 1), ("b", "1", 1)])
    step([("a", "1", 2), ("b", "2", 2), ("c", None, 1)])
    assert seen == [["a", "b"], ["b", "c"]]
    got = {r.source_id: r.content for r in store.current(spark, state, "sources").collect()}
    assert got == {"a": "1", "b": "2", "c": None}
