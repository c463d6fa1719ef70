"""Schemas of the named data sets and of result records, declared once by name."""

from __future__ import annotations

from pyspark.sql import types as T


def _fields(kind: T.DataType, names: str) -> list[T.StructField]:
    return [T.StructField(n, kind) for n in names.split()]


# Column names and orders of the published data sets.
IRIS = T.StructType(
    _fields(T.DoubleType(), "sepal.length sepal.width petal.length petal.width")
    + _fields(T.StringType(), "variety")
)

BANK_NUMERIC = (
    "age duration campaign pdays previous emp_var_rate cons_price_idx cons_conf_idx euribor3m nr_employed".split()
)
BANK_CATEGORICAL = (
    "job marital education default housing loan contact month day_of_week poutcome".split()
)
BANK = T.StructType(
    _fields(T.StringType(), "age job marital education default housing loan contact month day_of_week duration")
    + _fields(T.StringType(), "campaign pdays previous poutcome")
    + _fields(T.StringType(), "emp.var.rate cons.price.idx cons.conf.idx euribor3m nr.employed y")
)

COVERTYPE = T.StructType(
    _fields(
        T.IntegerType(),
        "Elevation Aspect Slope Horizontal_Distance_To_Hydrology Vertical_Distance_To_Hydrology "
        "Horizontal_Distance_To_Roadways Hillshade_9am Hillshade_Noon Hillshade_3pm "
        "Horizontal_Distance_To_Fire_Points",
    )
    + [T.StructField(f"Wilderness_Area{i}", T.IntegerType()) for i in range(1, 5)]
    + [T.StructField(f"Soil_Type{i}", T.IntegerType()) for i in range(1, 41)]
    + _fields(T.IntegerType(), "Cover_Type")
)

HOUSING = T.StructType(
    _fields(T.DoubleType(), "MedInc HouseAge AveRooms AveBedrms Population AveOccup Latitude Longitude target")
)

DIGITS = T.StructType(
    [T.StructField(f"pixel_{i}", T.DoubleType()) for i in range(64)] + _fields(T.IntegerType(), "target")
)

RESULT = T.StructType(
    _fields(T.StringType(), "library model")
    + _fields(T.DoubleType(), "train_time_sec inference_time_sec accuracy memory_usage_mb")
)

RESULT_WITH_RESOURCES = T.StructType(
    RESULT.fields + _fields(T.DoubleType(), "cpu_usage_percent peak_memory_mb")
)

STATS = T.StructType(_fields(T.DoubleType(), "mean std_dev min_val max_val") + _fields(T.LongType(), "count"))

BENCHMARK_RESULTS = T.StructType(
    _fields(
        T.DoubleType(),
        "total_training_time_seconds training_throughput_samples_per_sec inference_throughput_samples_per_sec "
        "inference_latency_mean_seconds inference_latency_p50_seconds inference_latency_p90_seconds "
        "inference_latency_p99_seconds cpu_utilization_mean_percent cpu_utilization_peak_percent "
        "memory_mean_mb memory_peak_mb memory_delta_mb model_accuracy",
    )
    + _fields(T.StringType(), "metric_type")
    + _fields(T.LongType(), "training_samples test_samples features classes clusters")
)

SUITE_REPORT = T.StructType(
    _fields(T.StringType(), "language algorithm")
    + _fields(T.DoubleType(), "timestamp")
    + [
        T.StructField(
            "system_info",
            T.StructType(_fields(T.LongType(), "cpu_count") + _fields(T.DoubleType(), "total_memory_mb")),
        ),
        T.StructField("benchmark_results", BENCHMARK_RESULTS),
    ]
)
