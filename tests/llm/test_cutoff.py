"""The outlier cutoff follows the distances, not a fixed number."""

import numpy as np
from pyspark.sql import functions as F

from agora.llm import quality_rules


def test_cutoff_follows_the_spread_of_the_distances(spark):
    """Log-normal distances, a tenth of them far off: the cutoff scales with them and stays below the far ones."""
    rng = np.random.default_rng(5)
    for centre, spread in ((2.0, 1.0), (8.0, 0.5), (20.0, 1.0)):
        x = np.log(centre) + spread * rng.standard_normal(4000)
        x[:400] = np.log(centre) + 8 * spread
        frame = spark.createDataFrame([(float(v),) for v in x], "x double")
        got = quality_rules._cutoff(frame, quality_rules.Settings())
        mad = np.median(np.abs(x - np.median(x)))
        want = max(quality_rules.CHI2_975, np.exp(np.median(x) + 3.5 * mad / 0.6745))
        assert abs(np.log(got) - np.log(want)) < 0.05
        assert np.log(got) < np.log(centre) + 8 * spread
    assert quality_rules._cutoff(frame.where(F.lit(False)), quality_rules.Settings()) == quality_rules.CHI2_975
