"""Line numbers of files that are read in splits."""

from parallex.sources import records


def test_lines_over_splits(spark, tmp_path):
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    want, bad = {}, {}
    for name in ("a.jsonl", "b.jsonl"):
        body = []
        for k in range(1, 401):
            value = ["{\"id\": \"U%d\"}" % k, "  ", "{\"id\": ", "[1]", "\"text\"", "{\"id\": null, \"more\": [%d]}" % k][0 if k % 9 else (k // 9) % 6]
            body.append(value)
            want[name, k] = value
        for k, value in enumerate(body, 1):
            if value.strip() and not value.startswith("{\"id\": \"U") and not value.startswith("{\"id\": null"):
                bad[name, k] = "INVALID_JSON" if value == "{\"id\": " else "NOT_AN_OBJECT"
        (tmp_path / name).write_text("\n".join(body) + ("\n" if name < "b" else ""))
    (tmp_path / "c.jsonl").write_text("")
    spark.conf.set(key, "700")
    try:
        lines = records.numbered_lines(spark, f"file://{tmp_path}")
        assert lines.rdd.getNumPartitions() > 5
        assert {(r.path.rsplit("/", 1)[1], r.line): r.value for r in lines.collect()} == want
        rows, errors = records.read_json_lines(spark, f"file://{tmp_path}", "id string")
        assert {(r.path.rsplit("/", 1)[1], r.line): r.error for r in errors.collect()} == bad and {*bad.values()} == {"INVALID_JSON", "NOT_AN_OBJECT"}
        good = {k for k, v in want.items() if v.strip()} - bad.keys()
        assert {(r.path.rsplit("/", 1)[1], r.line) for r in rows.collect()} == good
        assert all(r.id == f"U{r.line}" or r.id is None for r in rows.collect())
    finally:
        spark.conf.set(key, before)
