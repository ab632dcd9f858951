"""W3 as a stream-stream join: outputs before, with and after their log rows."""

from pyspark.sql import functions as F

from tierlens.fixtures import verification_pairs
from tierlens.session import scratch_path
from tierlens.sources import logs as L
from tierlens.streaming import jobs as W

from .conftest import SF_SMALL
from .test_hard_inputs import _empty_log, frame, record


def setup(spark):
    log, landing, out, ck = (scratch_path(spark, n) for n in ("log", "landing", "verdicts", "ck"))
    one = verification_pairs(spark, SF_SMALL).limit(1)

    def land(*ids):
        one.withColumn("pair_id", F.explode(F.array(*[F.lit(i).cast("long") for i in ids]))).write.mode("append").parquet(landing)
    land(*[-1])
    return log, landing, out, ck, land, one.schema


def verified(spark, out):
    return sorted(r.id for r in W.read_verdicts(spark, out).collect())


def test_either_side_waits_for_the_other(spark):
    log, landing, out, ck, land, schema = setup(spark)
    go = lambda: W.stateful_verification(spark, log, landing, schema, out, ck)
    _empty_log(spark, log + "/append=99/day=2026-01-01")
    go()
    assert verified(spark, out) == []
    L.append_request_telemetry(frame(spark, [record(1, i=1), record(2, i=2)]), log)
    land(1)
    go()
    assert verified(spark, out) == [1]
    go()                                            # nothing new: nothing again
    assert verified(spark, out) == [1]
    land(2, 3)                                      # 2 is late, 3 comes before its log row
    go()
    assert verified(spark, out) == [1, 2]
    L.append_request_telemetry(frame(spark, [record(3, i=3)]), log)
    go()
    assert verified(spark, out) == [1, 2, 3]


def test_a_lost_batch_is_repeated_whole(spark, monkeypatch):
    log, landing, out, ck, land, schema = setup(spark)
    L.append_request_telemetry(frame(spark, [record(1, i=1), record(2, i=2)]), log)
    land(1, 2)
    write, died = W._batch_writer, []

    def dying(path, *a):
        sink = write(path, *a)

        def once(df, batch_id):
            sink(df, batch_id)
            if not died:
                died.append(batch_id)
                raise RuntimeError("died after the write, before the commit")
        return once
    monkeypatch.setattr(W, "_batch_writer", dying)
    try:
        W.stateful_verification(spark, log, landing, schema, out, ck)
    except Exception as e:  # noqa: BLE001
        assert "died" in str(e)
    assert died
    W.stateful_verification(spark, log, landing, schema, out, ck)
    assert verified(spark, out) == [1, 2]


def test_bounded_state_gives_up_after_the_wait(spark):
    log, landing, out, ck, land, schema = setup(spark)
    go = lambda: W.stateful_verification(spark, log, landing, schema, out, ck, wait="1 second")
    L.append_request_telemetry(frame(spark, [record(1, i=1), record(2, i=2)]), log)
    land(1)
    go()
    for i in range(10, 14):                         # time passes with the batches that arrive
        L.append_request_telemetry(frame(spark, [record(1, i=i)]), log)
        land(i)
        go()
    assert set(verified(spark, out)) == {1, 10, 11, 12, 13}
    assert 2 in {r.id for r in spark.read.parquet(out + "_expired").collect()}
    land(2)
    go()
    assert 2 not in verified(spark, out)
