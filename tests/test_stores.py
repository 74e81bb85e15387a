"""The feature store, SQL functions over payloads, and messages as a stream, each against plain Python."""

import json
import os
import uuid

from pyspark.sql import functions as F

from tabulith.operators import functions as U
from tabulith.sources import features as G
from tabulith.streaming import messages as M


def test_feature_store_reads_what_changed(spark, tmp_path):
    folder, seen = tmp_path / "files", []
    folder.mkdir()
    name = lambda m: f"treasury_bulletin_1950_{m:02d}.txt"
    for m in range(1, 7):
        (folder / name(m)).write_text(" " if m == 6 else "word " * m)

    def compute(files):
        seen.append(sorted(r.file_name for r in files.select("file_name").collect()))
        return files.select("file_name", F.explode(F.split("text", " ")).alias("w")).where("w <> ''").groupBy("file_name").agg(F.count("w").alias("n"))

    mark = uuid.uuid4().hex
    store = G.FeatureStore(spark, f"counts_{mark}", f"{tmp_path}/table", compute)
    read = lambda s: {r.file_name: r.n for r in s.read(str(folder)).collect()}
    assert read(store) == {name(m): m for m in range(1, 6)} | {name(6): None}
    # nothing changed: nothing is computed, also for the file without features
    assert read(store) == {name(m): m for m in range(1, 6)} | {name(6): None} and len(seen) == 1
    # prints, not texts, decide: a text of the same size and time is not read
    at = os.stat(folder / name(2))
    (folder / name(2)).write_text("other text"[: at.st_size].ljust(at.st_size, "x"))
    os.utime(folder / name(2), ns=(at.st_atime_ns, at.st_mtime_ns))
    assert read(store)[name(2)] == 2 and len(seen) == 1
    # a changed, a new and a removed file
    (folder / name(3)).write_text("a b c d e f g")
    (folder / name(7)).write_text("new one")
    (folder / name(1)).unlink()
    assert read(store) == {name(2): 2, name(3): 7, name(4): 4, name(5): 5, name(6): None, name(7): 2}
    assert seen[1:] == [[name(3), name(7)]]
    # another version computes all
    assert read(G.FeatureStore(spark, f"counts_{mark}", f"{tmp_path}/table", compute, "2"))[name(3)] == 7 and len(seen[2]) == 6
    spark.sql(f"DROP TABLE counts_{mark}")


def test_json_functions(spark):
    U.register(spark)
    rows = [
        ('[{"k": 1}, {"k": "2.5"}, {"j": 7}, {"k": null}]', "k"), ("[]", "k"), ('[{"k": "x"}]', "k"), ("[{", "k"), ('[{"k": 12345678}, {"k": 1e9}]', "k"), ('[{"k": -0.25}]', "k"), ('[{"j": 1}]', "k"), (None, "k"),
    ]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, data string, field string")
    frame.createOrReplaceTempView("given")
    got = spark.sql("SELECT i, op, json_aggregate(data, field, op) AS r FROM given, (SELECT explode(array('sum', 'avg', 'min', 'max', 'count', 'mode')) AS op)").collect()

    def plain(data, field, op):
        try:
            values = [float(r[field]) for r in json.loads(data) if r.get(field) is not None]
        except (ValueError, TypeError) as e:
            return f"Tool error: {'JSONDecodeError' if data is None else type(e).__name__}"
        if not values:
            return "No numeric values found for field"
        return str({"sum": sum(values), "avg": sum(values) / len(values), "min": min(values), "max": max(values), "count": len(values)}.get(op, "Unknown operation"))

    assert {(r.i, r.op): r.r for r in got} == {(i, op): plain(*rows[i], op) for i in range(len(rows)) for op in ("sum", "avg", "min", "max", "count", "mode")}
    data = '[{"k": "Net Debt", "n": 1}, {"k": "gross"}, {"k": null}, {"n": {"a": [2]}}]'
    found = spark.sql(f"SELECT json_search('{data}', 'k', 'DEBT') AS r").first().r
    assert [json.loads(x) for x in found] == [{"k": "Net Debt", "n": 1}]
    assert spark.sql("SELECT json_search('[{', 'k', 'x') AS r").first().r is None
    table = spark.sql(f"SELECT * FROM json_rows('{data}', 'k, n, zz')")
    assert table.columns == ["k", "n", "zz"]
    assert [tuple(r) for r in table.collect()] == [("Net Debt", "1", None), ("gross", None, None), (None, None, None), (None, '{"a": [2]}', None)]
    assert spark.sql("SELECT * FROM json_rows('[1, {', 'k')").collect() == []


def test_streamed_messages(spark, tmp_path):
    parts = [(c, t, f"part {c}.{t}" if t else None) for c in range(12) for t in range(1 + c % 4)]
    schema = "conv_id long, turn long, text string"
    for i, at in enumerate([parts[::3], parts[1::3], parts[2::3]]):
        spark.createDataFrame(at, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        if i == 0:  # the first parts again: they count once
            spark.createDataFrame(at, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        M.write_messages(M.merged(stream), f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
        return {r.conv_id: (r.n_parts, r.message) for r in M.latest(spark, f"{tmp_path}/out").collect()}

    want = {c: (1 + c % 4, "\n".join(f"part {c}.{t}" if t else "" for t in range(1 + c % 4))) for c in range(12)}
    assert run() == want
    batches = len(list((tmp_path / "out").glob("batch=*")))
    assert batches > 3 and run() == want and len(list((tmp_path / "out").glob("batch=*"))) == batches
    # a late part, long after the others
    spark.createDataFrame([(3, 9, "late"), (77, 0, "alone")], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    assert run() == want | {3: (5, want[3][1] + "\nlate"), 77: (1, "alone")}


def test_a_watermark_bounds_state(spark, tmp_path):
    rows = [(1, 0, "a", "2024-01-01 10:00:00"), (1, 1, "b", "2024-01-01 10:05:00")], [(2, 0, "c", "2024-01-03 09:00:00")], [(1, 2, "too late", "2024-01-01 10:06:00"), (2, 1, "d", "2024-01-03 09:01:00")]
    for i, batch in enumerate(rows):
        spark.createDataFrame(batch, "conv_id long, turn long, text string, at string").withColumn("at", F.to_timestamp("at")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("conv_id long, turn long, text string, at timestamp").parquet(f"{tmp_path}/in")
        M.write_messages(M.merged(stream, time="at"), f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
    got = {r.conv_id: r.message for r in M.latest(spark, f"{tmp_path}/out").collect()}
    assert got == {1: "a\nb", 2: "c\nd"}
