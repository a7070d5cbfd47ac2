import os
import tempfile
import time

from wirefold.streaming.new_sources import stream_new_sources


def _write(root, rel, text):
    p = os.path.join(root, rel)
    os.makedirs(os.path.dirname(p), exist_ok=True)
    with open(p, "w") as f:
        f.write(text)


def test_stream_picks_up_arrivals_only(spark):
    base = tempfile.mkdtemp(prefix="wf-stream-", dir="/tmp")
    root, sink, ckpt = (os.path.join(base, d) for d in ("root", "sink", "ckpt"))
    _write(root, "src/main/java/a/A.java", "class A {}")
    _write(root, "src/test/java/a/ATest.java", "class ATest {}")
    _write(root, "build/gen/G.java", "class G {}")
    n1 = stream_new_sources(spark, root, repo="r", snapshot="s", sink=sink, checkpoint=ckpt)
    assert n1 == 2
    time.sleep(1.1)
    _write(root, "src/main/java/a/B.java", "class B {}")
    n2 = stream_new_sources(spark, root, repo="r", snapshot="s", sink=sink, checkpoint=ckpt)
    assert n2 == 1
    rows = spark.read.parquet(sink).select("path", "source_set").collect()
    got = sorted((r.path, r.source_set) for r in rows)
    assert got == [("src/main/java/a/A.java", "production"), ("src/main/java/a/B.java", "production"),
                   ("src/test/java/a/ATest.java", "test")]


def test_epochs_run_again_leave_their_rows_once(spark):
    from wirefold.streaming.arrivals import delivered, stream_arrivals, uncommit

    base = tempfile.mkdtemp(prefix="wf-arrivals-", dir="/tmp")
    landing, sink, state = (os.path.join(base, d) for d in ("landing", "sink", "state"))
    rows = spark.createDataFrame([(i, f"f{i}") for i in range(6)], "id long, name string")
    run = lambda **more: stream_arrivals(spark, landing, rows.schema, sink=sink, checkpoint=state, **more)
    got = lambda: sorted(r.id for r in delivered(spark, sink, rows.schema).collect())
    assert uncommit(spark, state) is None
    rows.where("id < 2").coalesce(1).write.mode("append").parquet(landing)
    assert run() == 1 and got() == [0, 1]
    assert run() == 0 and got() == [0, 1]
    for i in range(2, 6):
        rows.where(f"id = {i}").coalesce(1).write.mode("append").parquet(landing)
    assert run(files_per_epoch=2) == 2 and got() == list(range(6))
    assert uncommit(spark, state) == 2
    assert run() == 1 and got() == list(range(6))
    assert {r.epoch for r in delivered(spark, sink, rows.schema).collect()} == {0, 1, 2}
