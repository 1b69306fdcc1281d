"""The study of all columns in one exchange against the ways for dates of any size."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from crosstide.functions import rank_kernel
from crosstide.operators import residual as D
from crosstide.plans import comparison as C
from crosstide.plans.registry import date_sizes
from crosstide.schema import DATE, LABEL


def test_study_equals_the_large_way(spark, folder, monkeypatch):
    df = C.studied(spark, folder).filter(F.col(DATE) < 19990401).cache()
    sizes, key = date_sizes(spark, folder), ["fold", DATE, "region", "feature"]
    assert set(df.columns).isdisjoint({"csr_ret_1", "relret_1"})  # only trailing features are moved
    found = D.study(df, [LABEL, "pred_rank"], ["fold"], sizes, 1).toPandas().sort_values(key).reset_index(drop=True)
    monkeypatch.setattr(rank_kernel, "CELL_LIMIT", 0)
    large = D.study(df, [LABEL, "pred_rank"], ["fold"], sizes, 1).toPandas()[list(found.columns)].sort_values(key).reset_index(drop=True)
    assert len(found) > 1000 and set(found.region) == {"full", "top20", "middle60"}
    pd.testing.assert_frame_equal(found, large, check_dtype=False, rtol=1e-9)


def test_equal_spreads_give_the_exact_decimal():
    values = np.array([[1.0], [2.0], [3.0], [4.0], [5.0]])
    against = np.array([[2.0], [1.0], [3.0], [5.0], [4.0]])
    assert rank_kernel.correlations(values, against)[1][0, 0] == 0.8
    roots = [s for s in range(2, 400) if np.sqrt(float(s)) * np.sqrt(float(s)) != s]
    assert roots and all(rank_kernel.norm(float(s), float(s)) == s for s in roots)
