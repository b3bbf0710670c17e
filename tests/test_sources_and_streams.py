"""Round trips of the readers and writers, resumed runs, stream against batch."""

import json

import pytest
from pyspark.sql import functions as F

from lodeworks.sources import tables as S
from lodeworks.streaming import ingest, outreach


def test_json_lines_skip_blank(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1, "x": "a"}\n\n{"id": 2, "y": 5}\n')
    rows = S.read_json_lines(spark, str(tmp_path / "a.jsonl"), "id int, x string").collect()
    assert sorted((r.id, r.x) for r in rows if r.id is not None) == [(1, "a"), (2, None)]
    assert len(rows) == 2


def test_json_array_and_wrapped(spark, tmp_path):
    rows = [{"id": 1}, {"id": 2}]
    shapes = {"bare": rows, "data": {"data": rows}, "records": {"n": 2, "records": rows}}
    for name, shape in shapes.items():
        path = tmp_path / f"{name}.json"
        path.write_text(json.dumps(shape))
        assert sorted(r.id for r in S.read_wrapped(spark, str(path), "id: int").collect()) == [1, 2]
    assert S.read_json_array(spark, str(tmp_path / "bare.json"), "id int").count() == 2


def test_csv_round_trip_joins_lists(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", "b"])], "id int, tags array<string>")
    S.write_csv_joined(df, str(tmp_path / "csv"))
    got = S.read_csv_strings(spark, str(tmp_path / "csv")).first()
    assert (got.id, got.tags) == ("1", "a; b")


def test_first_existing(spark, tmp_path):
    there = tmp_path / "there"
    there.mkdir()
    assert S.first_existing(spark, [str(tmp_path / "no"), str(there)]) == str(there)


def test_two_copies_and_append(spark, tmp_path):
    df = spark.range(3)
    S.write_copies(df, str(tmp_path / "p"), str(tmp_path / "j"))
    S.append_json_lines(df, str(tmp_path / "j"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 3
    assert spark.read.json(str(tmp_path / "j")).count() == 6


def test_versions_are_numbers_and_only_complete_ones_are_read(spark, tmp_path):
    root = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        S.read_latest(spark, root)
    assert S.write_version(spark.range(2), root) == 1
    assert S.write_version(S.read_latest(spark, root).unionByName(spark.range(5, 6)), root, 9) == 9
    assert S.write_version(S.read_latest(spark, root).unionByName(spark.range(7, 8)), root) == 10
    assert sorted(r.id for r in S.read_latest(spark, root).collect()) == [0, 1, 5, 7]

    # A writer that fails after its data, before its pointer, is not seen.
    spark.range(100).write.parquet(f"{root}/data/version-11-half")
    failing = spark.range(3).select(F.raise_error(F.lit("stop")).cast("long").alias("id"))
    with pytest.raises(Exception, match="stop"):
        S.write_version(failing, root)
    assert S.read_latest(spark, root).count() == 4 and S.latest_pointer(spark, root).n_rows == 4


def test_batches_after_a_stop_are_written_once(spark, tmp_path):
    source, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    for i in range(5):
        spark.range(10 * i, 10 * i + 10).coalesce(1).write.mode("append").parquet(str(source))

    def stream():
        return ingest.open_stream(spark, str(source), "id long", files_per_batch=2)

    assert ingest.write_batches(stream(), out, mark) == 3
    spark.range(50, 55).coalesce(1).write.mode("append").parquet(str(source))
    # The stop comes after a batch is written and before it is marked as done.
    commits = tmp_path / "mark" / "commits"
    last = max((p for p in commits.iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
    last.unlink()
    (commits / f".{last.name}.crc").unlink(missing_ok=True)
    assert ingest.write_batches(stream(), out, mark) == 2
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == list(range(55))
    assert ingest.write_batches(stream(), out, mark) == 0


def test_owner_rows_replaced(spark, tmp_path):
    path = str(tmp_path / "items")
    S.replace_owner_rows(spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "user_id int, item string"), path, "user_id")
    S.replace_owner_rows(spark.createDataFrame([(1, "z")], "user_id int, item string"), path, "user_id")
    got = sorted((r.user_id, r.item) for r in S.read_owner_rows(spark, path).collect())
    assert got == [(1, "z"), (2, "c")]
    none = spark.createDataFrame([], "user_id int, item string")
    S.replace_owner_rows(none, path, "user_id", spark.createDataFrame([(1,)], "user_id int"))
    assert [(r.user_id, r.item) for r in S.read_owner_rows(spark, path).collect()] == [(2, "c")]


def test_only_a_missing_table_counts_as_first_run(spark, tmp_path):
    df = spark.createDataFrame([(1,)], "id int")
    assert S.pending(df, str(tmp_path / "none"), "id").count() == 1
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "part.parquet").write_text("no parquet")
    with pytest.raises(Exception, match="(?i)parquet|schema|read"):
        S.pending(df, str(tmp_path / "bad"), "id").count()


def test_first_seen_remembers_late_and_old_keys(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    days = ["2024-06-01", "2024-01-01", "2024-12-31"]
    for i, day in enumerate(days):
        rows = [(1, day), (i + 10, day)]
        spark.createDataFrame(rows, "k int, day string").coalesce(1).write.mode("append").parquet(str(source))
        stream = ingest.first_seen(ingest.open_stream(spark, str(source), "k int, day string"), ["k"])
        ingest.append_new(stream, f"{out}/rows", f"{out}/checkpoint")
    assert sorted(r.k for r in spark.read.parquet(f"{out}/rows").collect()) == [1, 10, 11, 12]


def test_import_once_and_payload(spark, tmp_path):
    (tmp_path / "old.json").write_text(json.dumps([{"id": 1, "note": '{"step": 2}'}, {"id": 2, "note": None}]))
    path = str(tmp_path / "table")
    for _ in range(2):
        S.import_once(spark, str(tmp_path / "old.json"), "id int, note string", path, "id")
    rows = S.with_payload(spark.read.parquet(path), "note", "step int").collect()
    assert sorted((r.id, r.note.step) for r in rows) == [(1, 2), (2, None)]


def test_export_json(spark, tmp_path):
    S.export_json(spark.createDataFrame([(7, "x")], "id int, v string"), str(tmp_path / "e"), "id")
    text = spark.read.text(str(tmp_path / "e")).first().value
    assert json.loads(text) == {"id": 7, "v": "x"}


def test_resume_skips_done(spark, tmp_path):
    path = str(tmp_path / "done")
    df = spark.range(5)
    assert S.pending(df, path, "id").count() == 5
    S.mark_done(df.filter("id < 3"), path, "id")
    assert sorted(r.id for r in S.pending(df, path, "id").collect()) == [3, 4]


def test_stream_takes_only_new_files(spark, tmp_path):
    src, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    spark.range(3).write.parquet(src)
    for expected in (3, 3, 5):
        if expected == 5:
            spark.range(10, 12).write.mode("append").parquet(src)
        stream = ingest.open_stream(spark, src, spark.range(1).schema)
        ingest.append_new(stream, out, mark)
        assert spark.read.parquet(out).count() == expected


def test_stream_state_equals_batch_with_tombstone(spark, tmp_path):
    src = str(tmp_path / "ev")
    rows = [(1, 1, 1, "move"), (1, 3, 4, "move"), (1, 2, 2, "move"), (2, 1, 1, "move"), (2, 2, 1, "delete")]
    df = spark.createDataFrame(rows, "item int, seq int, step int, op string")
    df.repartition(3).write.parquet(src)
    stream = ingest.open_stream(spark, src, df.schema)
    got = outreach.fold_to_table(stream, "item", ["seq"], ["step"], "op").collect()
    assert [(r.item, r.step) for r in got] == [(1, 4)]


def test_tag_walk(spark):
    from lodeworks.functions.html import walk_sections

    html = '<div class="team-grid"><li>Ann <b>Lee</b></li><br></div><p>out</p><section id="portfolio"><p>Acme</p></section>'
    pages = spark.createDataFrame([(1, html)], "page_id long, html string")
    got = walk_sections(pages, "page_id", "html", ["team", "portfolio"], ["li", "p"]).collect()
    assert sorted((r.section, r.item) for r in got) == [("portfolio", "Acme"), ("team", "Ann Lee")]


