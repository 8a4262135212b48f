"""Spans of a stream of contacts equal those of the same rows at rest."""

import time

from moltide.streaming import contacts as SC


def test_spans(spark, tmp_path):
    rows = [("a", float(t)) for t in (0, 1, 2, 10, 11, 40)] + [("b", float(t)) for t in (5, 30)]
    d = spark.createDataFrame(rows, "pair string, t_fs double")
    for part in ("t_fs < 20", "t_fs >= 20"):
        d.where(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)  # files are taken in the order of their times
    s = spark.readStream.schema("pair string, t_fs double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = SC.contact_spans(SC.with_time(s), ["pair"], "5 milliseconds", "1 millisecond").writeStream.outputMode("append").format("memory").queryName("spans").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r["pair"], r["n"]) for r in spark.table("spans").collect()}
    rest = sorted((r["pair"], r["n"]) for r in SC.contact_spans(SC.with_time(d), ["pair"], "5 milliseconds", "1 millisecond").collect())
    assert rest == [("a", 1), ("a", 2), ("a", 3), ("b", 1), ("b", 1)]
    assert got <= set(rest) and ("a", 3) in got
    n = SC.contact_counts(SC.with_time(d), "10 milliseconds", "10 milliseconds", "1 millisecond", "pair").collect()
    assert sorted(r["n"] for r in n if r["pair"] == "a") == [1, 2, 3]
