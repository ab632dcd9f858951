"""T4-T9 from daily partials: equal to the panels over the whole log, changed days only."""

from tierlens.operators import telemetry as T
from tierlens.session import scratch_path
from tierlens.sources import logs as L
from tierlens.streaming import compaction as CO
from tierlens.streaming import dashboard_view as DV

from .test_compaction import land_verdicts
from .test_hard_inputs import frame, record


def panels(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def check(spark, log, verdicts):
    logs, parts = CO.read_current(spark, log, verdicts), DV.read_partials(spark, log)
    view = DV.spend_and_escalation(parts)
    for grain in ("day", "week"):
        want = panels(T.spend_by(logs, grain))
        assert panels(view.where(f"grain = '{grain}'").select("period", "cost", "gpt4o_baseline_cost")) == want
    k = T.headline_kpis(logs)
    assert panels(view.where("grain = 'total'").select("requests", "cost", "gpt4o_baseline_cost", "net_savings", "savings_pct")) == panels(k)
    assert panels(view.where("grain = 'day'").select("period", "requests", "escalated_count", "escalation_rate_pct")) == panels(T.escalation_rate(logs))
    assert panels(DV.model_mix(parts)) == panels(T.model_mix(logs)) and panels(DV.quality_histogram(parts)) == panels(T.quality_histogram(logs))


def test_view_recomputes_changed_days_only(spark, monkeypatch):
    log, verdicts = scratch_path(spark, "log"), scratch_path(spark, "verdicts")
    assert DV.refresh(spark, log) == [] and DV.read_partials(spark, log).count() == 0
    more = [record(d, i=10 * d + k, cost=0.1 * k + d, flag=k == 1, quality_score=[None, 0.5, 3.3, 5.0, 7.0, float("nan")][k]) for d in (1, 2, 8, 9) for k in range(6)]
    for r in more:
        r["routed_model"] = ["gpt-4o", "gpt-4o-mini", "claude-3-haiku"][r["id"] % 3]
    L.append_request_telemetry(frame(spark, more), log)
    assert DV.refresh(spark, log) == []                                     # nothing compacted yet
    CO.compact(spark, log, verdicts)
    assert DV.refresh(spark, log) == ["2025-01-01", "2025-01-02", "2025-01-08", "2025-01-09"]
    check(spark, log, verdicts)
    read = []
    base_rows = DV.base_rows
    monkeypatch.setattr(DV, "base_rows", lambda s, lg, days: read.append(sorted(days)) or base_rows(s, lg, days))
    L.append_request_telemetry(frame(spark, [record(8, i=500, cost=2.5)]), log)
    CO.compact(spark, log, verdicts)
    assert DV.refresh(spark, log) == ["2025-01-08"] == read[-1] and DV.refresh(spark, log) == []
    check(spark, log, verdicts)
    land_verdicts(spark, verdicts, 0, [(20, 2.0, 1, 2)])                    # a verdict changes its day
    CO.compact(spark, log, verdicts)
    assert DV.refresh(spark, log) == ["2025-01-02"]
    check(spark, log, verdicts)


def test_view_survives_death_before_the_switch(spark, monkeypatch):
    log, verdicts = scratch_path(spark, "log"), scratch_path(spark, "verdicts")
    L.append_request_telemetry(frame(spark, [record(1, i=1)]), log)
    CO.compact(spark, log, verdicts)
    DV.refresh(spark, log)
    L.append_request_telemetry(frame(spark, [record(1, i=2)]), log)
    CO.compact(spark, log, verdicts)
    with monkeypatch.context() as m:
        m.setattr(DV.Sequence, "offer", lambda *a: (_ for _ in ()).throw(RuntimeError("died")))
        try:
            DV.refresh(spark, log)
        except RuntimeError:
            pass
    assert DV.spend_and_escalation(DV.read_partials(spark, log)).where("grain = 'total'").first().requests == 1
    assert DV.refresh(spark, log) == ["2025-01-01"]
    check(spark, log, verdicts)


def scores(spark, values):
    return spark.createDataFrame([(v,) for v in values], "quality_score double").repartition(3)


def test_data_histogram(spark):
    from decimal import Decimal
    for lo, hi, step in [("1", "5", "0.2"), ("0", "1", "0.05"), ("0", "1.01", "0.1"), ("3", "3", "1"), ("-7", "1000", "100"), ("0", "0.002", "0.0001"), ("0", "40", "2")]:
        assert T.nice_step(Decimal(lo), Decimal(hi)) == Decimal(step)
    nan = float("nan")
    got = [tuple(r) for r in T.data_histogram(scores(spark, [-0.3, 0.0, 0.1, 0.1, 0.3, 0.7, None, nan, 1.7])).orderBy("bin").collect()]
    assert [(round(a, 9), n) for _, a, _, n in got] == [(-0.3, 1), (-0.2, 0), (-0.1, 0), (0.0, 1), (0.1, 2), (0.2, 0), (0.3, 1), (0.4, 0), (0.5, 0), (0.6, 0), (0.7, 1)] + [
        (round(0.8 + k / 10, 9), 0) for k in range(8)] + [(1.6, 1)]
    assert all(b == got[k + 1][1] for k, (_, _, b, _) in enumerate(got[:-1])) and got[-1][2] == 1.7
    assert [tuple(r) for r in T.data_histogram(scores(spark, [4.5, 4.5])).collect()] == [(0, 4.0, 5.0, 2)]
    assert T.data_histogram(scores(spark, [None, nan])).count() == 0


def test_quantiles_are_within_their_error(spark):
    import random
    random.seed(1)
    values = [random.gauss(3, 1) for _ in range(20_000)]
    got = {r.share: r.score for r in T.quality_quantiles(scores(spark, [*values, None, float("nan")]), [0.0, 0.1, 0.5, 0.99, 1.0], 1000).collect()}
    for share, score in got.items():
        assert abs(sum(v <= score for v in values) - share * len(values)) <= len(values) / 1000 + 1
