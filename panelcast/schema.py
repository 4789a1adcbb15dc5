"""Column vocabulary and declared schemas."""

from pyspark.sql import types as T

SERIES = "series"
PERIOD = "period"
STAGES = ("applications", "visas_issued", "arrivals")
KEYS = (SERIES, PERIOD)

PANEL_SCHEMA = T.StructType(
    [T.StructField(PERIOD, T.DateType()), T.StructField(SERIES, T.StringType())]
    + [T.StructField(stage, T.DoubleType()) for stage in STAGES]
)

FORECAST_SCHEMA = T.StructType(
    [
        T.StructField("model", T.StringType()),
        T.StructField(PERIOD, T.DateType()),
        T.StructField("forecast", T.DoubleType()),
        T.StructField("lo80", T.DoubleType()),
        T.StructField("hi80", T.DoubleType()),
        T.StructField("lo95", T.DoubleType()),
        T.StructField("hi95", T.DoubleType()),
    ]
)

METRIC_SCHEMA = T.StructType(
    [
        T.StructField("model", T.StringType()),
        T.StructField("n_forecasts", T.LongType()),
        T.StructField("mae", T.DoubleType()),
        T.StructField("rmse", T.DoubleType()),
        T.StructField("bias", T.DoubleType()),
        T.StructField("mape", T.DoubleType()),
    ]
)

# Two-sided normal quantiles of the 80 % and 95 % bands (fixed values).
Z80 = 1.2815515655446004
Z95 = 1.959963984540054
