"""Streams over several runs: progress, late and repeated rows, compaction."""

import json

from quillstone.streaming import logs

SCHEMA = "request_id bigint, ts bigint, status string"


def put(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(dict(zip(("request_id", "ts", "status"), r, strict=True))) for r in rows))


def test_latest_status_goes_on_where_it_stopped(spark, tmp_path):
    log, table, state = tmp_path / "log", f"{tmp_path}/table", f"{tmp_path}/state"

    def run():
        logs.drain(logs.stream_latest_status(logs.read_log(spark, str(log), SCHEMA), table, f"{tmp_path}/progress"))

    def current(**more):
        return {r["request_id"]: r["status"] for r in logs.latest_table(spark, table, **more).collect()}

    put(log, "a.json", [(1, 10, "new"), (2, 10, "new"), (1, 20, "done")])
    run()
    assert current() == {1: "done", 2: "new"}
    assert logs.compact(spark, table, state) == 0
    put(log, "b.json", [(1, 15, "late"), (2, 30, "done"), (2, 30, "done"), (3, 5, "new")])
    run()
    run()  # nothing new
    batches = sorted(p.name for p in (tmp_path / "table").iterdir() if p.name.startswith("batch="))
    assert batches == ["batch=0", "batch=1"]
    assert current() == current(state=state) == {1: "done", 2: "done", 3: "new"}
    assert logs.compact(spark, table, state, after=state) == 1
    assert current(state=state) == {1: "done", 2: "done", 3: "new"}
    logs.write_batch(spark.createDataFrame([(3, 6, "again")], SCHEMA), table, 1)  # a batch repeated with other rows
    assert logs.latest_table(spark, table).where("request_id = 3").first()["status"] == "again"


def test_ingest_takes_each_row_once(spark, tmp_path):
    log, table = tmp_path / "log", f"{tmp_path}/table"
    for name, rows in (("a.json", [(1, 1, "x"), (1, 1, "x")]), ("b.json", [(2, 2, "y")])):
        put(log, name, rows)
        logs.drain(logs.stream_ingest(logs.read_log(spark, str(log), SCHEMA), table, f"{tmp_path}/progress"))
    assert sorted(map(tuple, spark.read.parquet(table).collect())) == [(1, 1, "x"), (1, 1, "x"), (2, 2, "y")]


def test_late_rows_and_the_day_table(spark, tmp_path):
    """A late row within the delay corrects its day, one behind the watermark is dropped; a second run goes on."""
    log, table, state = tmp_path / "log", f"{tmp_path}/table", f"{tmp_path}/state"
    log.mkdir()

    def run(*files):
        for name, days in files:
            (log / name).write_text("\n".join(json.dumps({"event_time": f"2024-01-{d:02d}T12:00:00Z"}) for d in days))
        stream = logs.read_log(spark, str(log), "event_time timestamp", files=1)
        logs.drain(logs.stream_daily_sessions(stream, table, f"{tmp_path}/progress", delay="2 days"))
        return {r["day"][-2:]: r["n"] for r in logs.day_table(spark, table, state).collect()}

    assert run(("a.json", [1, 1, 5])) == {"01": 2, "05": 1}
    assert run(("b.json", [4, 1, 9])) == {"01": 2, "04": 1, "05": 1, "09": 1}  # the fourth is late, the first too late
    assert run() == {"01": 2, "04": 1, "05": 1, "09": 1}
    assert run(("c.json", [8, 9, 2])) == {"01": 2, "04": 1, "05": 1, "08": 1, "09": 2}


def test_quality_pages_reads_new_files_only(spark, tmp_path):
    docs, labels = tmp_path / "docs", spark.createDataFrame([(1, 0)], "doc_id bigint, quality int")
    docs.mkdir()
    seen = []
    for i, name in enumerate(("a.json", "b.json", "c.json")):
        (docs / name).write_text(json.dumps({"doc_id": i, "text": "a line of words\na line of words\n" * (i + 1)}))
        stream = logs.read_log(spark, str(docs), "doc_id bigint, text string", files=1)
        query = logs.stream_incremental_pages(stream, lambda df: logs.quality_pages(df, [], labels), f"{tmp_path}/out", f"{tmp_path}/progress")
        logs.drain(query)
        seen.append(sum(p["numInputRows"] for p in query.recentProgress))
    assert seen == [1, 1, 1]
    rows = {r.doc_id: r for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert set(rows) == {0, 1, 2} and rows[1].label == 0 and rows[0].label is None and all(r.text == "a line of words\n" and r.word_count == 4 for r in rows.values())
