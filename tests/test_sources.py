import json
import zipfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from lodeline.operators import lexical
from lodeline.sources import files
from lodeline.streaming import deliveries
from lodeline.runtime import publish


def test_csv_header_and_quotes(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('﻿id,text\n1,"two\nlines, ""quoted"""\n2,x\n', encoding="utf-8")
    d = files.read_csv(spark, str(p), ["id", "text"])
    assert sorted(tuple(r) for r in d.collect()) == [("1", 'two\nlines, "quoted"'), ("2", "x")]
    assert tuple(files.csv_audit(d, "id", ["text"]).first()) == (2, 0, 0, 0)
    with pytest.raises(ValueError, match="header"):
        files.read_csv(spark, str(p), ["id", "other"])


def test_json_lines_have_closed_keys(spark, tmp_path):
    schema = StructType([StructField("a", LongType()), StructField("b", StringType())])
    (tmp_path / "x.jsonl").write_text('{"b":"u","a":1}\n')
    assert tuple(files.read_json_lines(spark, str(tmp_path / "x.jsonl"), schema).first()) == (1, "u")
    (tmp_path / "y.jsonl").write_text('{"b":"u","a":1,"c":2}\n')
    with pytest.raises(Exception, match="unexpected keys"):
        files.read_json_lines(spark, str(tmp_path / "y.jsonl"), schema).collect()
    files.write_json_lines(spark.createDataFrame([("u", 1)], "b string, a int"), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).first()[0] == '{"a":1,"b":"u"}'


def test_canonical_queries(spark, tmp_path):
    good = {"qid": "q1", "query": "x", "as_of": "2026-06-09T10:00:00+08:00", "location_codes": ["9", "10"], "duty_codes": []}
    bad = [good | {"qid": "bad/qid"}, good | {"query": " x"}, good | {"as_of": "2026-06-09T10:00:00"}, good | {"as_of": "2020-06-09T10:00:00Z"}, good | {"duty_codes": ["1", "1"]}]
    (tmp_path / "q.jsonl").write_text("\n".join(json.dumps(x) for x in [good, *bad]))
    got = [r["violation"] for r in files.read_queries(spark, str(tmp_path / "q.jsonl"), "2026-01-01", "2027-01-01").collect()]
    assert got == [None, "unsafe qid", "text not trimmed", "time without zone", "outside window", "codes not sorted"]


def test_index_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([(1, ["a"], []), (2, [], ["b"])], "doc int, body array<string>, title array<string>")
    files.write_index(lexical.build(lexical.token_fields(docs, {f: F.col(f) for f in ("body", "title")})), str(tmp_path / "i"))
    i = files.read_index(spark, str(tmp_path / "i"))
    assert sorted((r["term"], r["df"]) for r in i.terms.collect()) == [("a", 1), ("b", 1)]
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        files.write_index(i, str(tmp_path / "i"))


def test_vector_shards_resume(spark, tmp_path):
    v = spark.createDataFrame([(i, [float(i)]) for i in range(10)], "job_index long, embedding array<float>")
    files.write_vector_shards(v.filter("job_index < 7"), str(tmp_path / "v"), 4)
    files.write_vector_shards(v, str(tmp_path / "v"), 4)
    assert spark.read.parquet(str(tmp_path / "v")).count() == 10


def test_trec_file(spark, tmp_path):
    r = spark.createDataFrame([("q", 5, 1)], "qid string, doc int, rank int")
    files.write_trec(r, str(tmp_path / "run"), "t")
    assert files.read_trec(spark, str(tmp_path / "run")).first()["ok"]


def test_manifest_helpers(spark, tmp_path):
    assert files.canonical_json({"b": 1, "a": "字"}) == '{"a":"字","b":1}'
    files.write_json(str(tmp_path / "m.json"), {"a": 1})
    assert (tmp_path / "m.json").read_text() == '{"a":1}\n'
    assert files.inventory(spark, str(tmp_path)).first()["size_bytes"] == 8
    with pytest.raises(ValueError):
        files.exact_keys({"a": 1}, {"b"})
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("d/a.csv", "x")
    assert files.zip_members(str(tmp_path / "z.zip"), ["a.csv"]) == {"a.csv": "d/a.csv"}
    with pytest.raises(ValueError, match="missing"):
        files.zip_members(str(tmp_path / "z.zip"), ["b.csv"])


def test_replace_table_audits_before_it_replaces(spark, tmp_path):
    t = str(tmp_path / "t")
    files.replace_table(spark.createDataFrame([("1", 1, "x"), ("2", 2, "y")], "k string, n int, v string"), t, "k", "n", ["v"])
    with pytest.raises(ValueError, match="audit"):
        files.replace_table(spark.createDataFrame([("1", 1, "x"), ("1", 2, "y")], "k string, n int, v string"), t, "k", "n", ["v"])
    assert spark.read.parquet(t).count() == 2 and not (tmp_path / "t.staged").exists()
    files.replace_table(spark.createDataFrame([("3", 1, "z")], "k string, n int, v string"), t, "k", "n", ["v"])
    assert [tuple(r) for r in spark.read.parquet(t).collect()] == [("3", 1, "z")]


def test_publish_is_exclusive(spark, tmp_path):
    for n in ("a", "b"):
        spark.range(3).write.parquet(str(tmp_path / n))
    publish(spark, str(tmp_path / "a"), str(tmp_path / "out"))
    with pytest.raises(FileExistsError):
        publish(spark, str(tmp_path / "b"), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3 and (tmp_path / "b").exists()


def test_stream_keeps_the_newest(spark, tmp_path):
    rows = [(1, 1, "old"), (2, 1, "only")], [(1, 2, "new"), (3, 1, "x")]
    for i, part in enumerate(rows):
        spark.createDataFrame(part, "k int, t int, v string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    stream = deliveries.read_stream(spark, str(tmp_path / "in"), schema, 1)
    out = str(tmp_path / "out")
    deliveries.keep_snapshot(stream, "k", lambda: [F.col("t")], out, str(tmp_path / "cp")).awaitTermination()
    now = lambda: sorted(tuple(r) for r in deliveries.current_snapshot(spark, out, schema).collect())
    assert now() == [(1, 2, "new"), (2, 1, "only"), (3, 1, "x")]
    write = deliveries.upsert_newest("k", lambda: [F.col("t")], out)
    write(spark.createDataFrame([(9, 9, "again")], schema), 0)  # a batch whose pointer stands already
    assert now() == [(1, 2, "new"), (2, 1, "only"), (3, 1, "x")]
    write(spark.createDataFrame([(1, 1, "late"), (9, 9, "y")], schema), 7)
    assert now() == [(1, 2, "new"), (2, 1, "only"), (3, 1, "x"), (9, 9, "y")]
    assert deliveries.current_snapshot(spark, str(tmp_path / "none"), schema).count() == 0


def test_stream_of_window_counts_equals_the_batch(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/events.parquet").select("ts", "event_type").withColumn("ts", F.col("ts").cast("timestamp"))
    e.repartition(3).write.parquet(str(tmp_path / "e"))
    s = deliveries.windowed_counts(spark.readStream.schema(e.schema).parquet(str(tmp_path / "e")), "ts", ["event_type"], "1 day")
    q = s.writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination()
    want = deliveries.windowed_counts(e, "ts", ["event_type"], "1 day")
    assert sorted(map(tuple, spark.sql("select * from counts").collect())) == sorted(map(tuple, want.collect()))
