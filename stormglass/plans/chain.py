"""The stages of the monthly pipeline over the supplied tables, one call per stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .. import fixed
from ..operators.index import forward_targets, stress_index
from ..operators.intervals import label_listed_periods
from ..operators.reshape import series_to_wide
from ..operators.timeseries import create_features, to_monthly
from ..sources import macro_obs

KEYS = ["entity"]
Tables = dict[str, DataFrame]

FEATURES = ("FED_CHANGE", "TREASURY_CHANGE", "VIX_CHANGE", "UNRATE_CHANGE", "INFLATION_RATE",
            "GDP_GROWTH", "FED_3M_AVG", "FED_6M_AVG", "CPI_3M_AVG", "GDP_3M_AVG", "UNRATE_3M_AVG",
            "VIX_3M_AVG", "FED_LAG1", "GDP_LAG1", "CPI_LAG1", "UNRATE_LAG1", "TREASURY_LAG1",
            "VIX_LAG1", "VIX_VOLATILITY", "FED_VOLATILITY", "FED_MOMENTUM", "GDP_MOMENTUM",
            "UNRATE_MOMENTUM", "VIX_MOMENTUM")
INDEX = (*fixed.Z_INPUTS, "RAW_ECON_STRESS", "ECON_STRESS")
TRENDS = ("STRESS_CHANGE_1M", "STRESS_CHANGE_3M", "STRESS_3M_AVG", "STRESS_GAP_3M",
          "STRESS_VOLATILITY_6M", "STRESS_ACCELERATION")


def wide(t: Tables, entity: str = "c_mktsegment") -> DataFrame:
    return series_to_wide(macro_obs(t, entity), KEYS)


def monthly(t: Tables, entity: str = "c_mktsegment") -> DataFrame:
    return to_monthly(wide(t, entity), KEYS)


def features(t: Tables, entity: str = "c_mktsegment") -> DataFrame:
    return create_features(monthly(t, entity), KEYS)


def stress(t: Tables, entity: str = "c_mktsegment",
           min_periods: int = fixed.MIN_PERIODS) -> DataFrame:
    return stress_index(features(t, entity), KEYS, min_periods=min_periods)


def labelled(spark: SparkSession, t: Tables, entity: str = "c_mktsegment",
             min_periods: int = fixed.MIN_PERIODS) -> DataFrame:
    return label_listed_periods(stress(t, entity, min_periods))


def targets(spark: SparkSession, t: Tables, entity: str = "c_mktsegment",
            min_periods: int = fixed.MIN_PERIODS) -> DataFrame:
    return forward_targets(labelled(spark, t, entity, min_periods), KEYS)
