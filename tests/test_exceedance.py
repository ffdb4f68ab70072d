"""Exceedance scores over growing folds against numpy."""

from datetime import datetime, timedelta

import numpy as np
import pytest

from knownwhen.operators.exceedance import exceedance_backtest


def test_folds_windows_and_pit(spark):
    rng = np.random.default_rng(2)
    first = datetime(2024, 1, 1)
    rows = []
    for k in ("a", None):
        for i in range(160):
            start = first + timedelta(days=float(rng.uniform(0, 180)))
            rows.append((k, start, start + timedelta(hours=float(rng.uniform(0, 60))), float(np.round(rng.exponential(5), 1))))
    rows += [("few", first, first, 1.0), ("few", datetime(2024, 4, 2), datetime(2024, 4, 2), 1.0)]
    df = spark.createDataFrame(rows, "k string, s timestamp_ntz, e timestamp_ntz, x double")
    taus = np.array([0.05, 0.5, 0.9, 0.99])
    got = {(r.k, r.fold, r.window): r for r in exceedance_backtest(df, ["k"], "s", "e", "x", "2024-03-01", 1, taus.tolist(), 20, embargo_days=1, recent_days=25).collect()}
    starts = [datetime(2024, m, 1) for m in range(3, 8)]
    want = set()
    for k in ("a", None):
        own = [r for r in rows if r[0] == k]
        for f, (a, b) in enumerate(zip(starts, starts[1:])):
            test = np.array([x for _, s, _, x in own if a <= s < b])
            past = [(e, x) for _, _, e, x in own if e < a - timedelta(days=1)]
            recent = [x for e, x in past if e >= a - timedelta(days=25)]
            if not len(test) or len(past) < 20:
                continue
            for window, y in (("expanding", [x for _, x in past]), ("recent", recent if len(recent) >= 20 else [x for _, x in past])):
                want.add((k, f, window))
                r, y = got[k, f, window], np.array(y)
                q = np.quantile(y, taus)
                loss = lambda q, t: np.mean([np.maximum(t * (x - q), (t - 1) * (x - q)).mean() for x in test])
                exp = -np.log(1 - taus) * y.mean()
                assert (r.n_test, r.n_fit) == (len(test), len(y))
                assert r.score_empirical == pytest.approx(loss(q, taus)) and r.score_exponential == pytest.approx(loss(exp, taus))
                assert r.tail_empirical == pytest.approx(loss(q[2:], taus[2:])) and r.tail_exponential == pytest.approx(loss(exp[2:], taus[2:]))
                assert r.mean_pit_empirical == pytest.approx(np.mean([(y <= x).mean() for x in test])) and r.hit_empirical == pytest.approx((test <= q[-1]).mean())
    assert set(got) == want and len(want) >= 12
