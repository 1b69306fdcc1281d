"""Decision checks where the baseline's own differences are not exactly zero."""

from crosstide.operators.selection import decision_checks

SPEC = "model string, fold string, delta_ic_mean double, delta_annual_excess double, delta_mean_turnover double, delta_final_score double, final_score double"


def test_noise_of_sums_is_no_improvement(spark):
    noise = 2.0 ** -53
    rows = [("a", f, noise, noise, -noise, noise, 0.25 - noise) for f in ("F1", "F2", "F3")]
    rows += [("b", f, 0.001, 0.01, -0.01, 0.02, 0.3) for f in ("F1", "F2", "F3")]
    a, b = decision_checks(spark.createDataFrame(rows, SPEC)).orderBy("model").collect()
    metrics = ("ic_mean", "annual_excess", "mean_turnover", "final_score")
    assert [a[f"improved_{m}"] for m in metrics] == [0] * 4 and [b[f"improved_{m}"] for m in metrics] == [3] * 4
    assert a["score_above_threshold"] and not a["ic_or_excess_gain"] and not a["accepted"] and b["accepted"]
