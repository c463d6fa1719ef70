from __future__ import annotations

from pyspark.sql import functions as F

from fitgrid.operators.stats import dataset_profile
from fitgrid.plans.report import analyse, report_document, report_rows, standardise
from fitgrid.sources import schemas

RUNS = [
    ("one", "SVC", 1.0, 0.1, 0.9, 3.0),
    ("one", "SVC", 2.0, 0.3, 0.8, 5.0),
    ("two", "MLPClassifier", 4.0, 0.01, 0.95, 1.234),
    ("two", "Mystery", 0.5, 0.2, 0.5, 2.0),
]


def test_names_and_categories(frame):
    got = {r["model"]: (r["algorithm"], r["category"]) for r in standardise(frame(RUNS, schemas.RESULT)).collect()}
    assert got == {
        "SVC": ("SVM", "Support Vector Machines"),
        "MLPClassifier": ("Neural Network", "Neural Networks"),
        "Mystery": ("Mystery", "Other"),
    }


def test_report_rows(frame):
    _, stats = analyse(frame(RUNS, schemas.RESULT))
    lines = {r["algorithm"]: r["line"] for r in report_rows(stats).collect()}
    assert lines["SVM"] == "| one | SVM | 1.500000±0.707107 | 0.200000±0.141421 | 0.8500±0.0707 | 4.00 |"
    assert lines["Neural Network"] == "| two | Neural Network | 4.000000±nan | 0.010000±nan | 0.9500±nan | 1.23 |"


def test_resource_columns_appear_when_present(frame):
    runs = frame([(*r, 50.0, 7.0) for r in RUNS], schemas.RESULT_WITH_RESOURCES)
    _, stats = analyse(runs)
    line = report_rows(stats).filter(F.col("algorithm") == "Mystery").first()["line"]
    assert line.endswith("| 2.00 | 50.00 | 7.00 |")


def test_document_order(frame):
    runs = frame(RUNS, schemas.RESULT)
    named, stats = analyse(runs)
    lines = [r["line"] for r in report_document(dataset_profile(runs, "model"), stats, "iris-data").collect()]
    assert lines[0] == "# ML Benchmark Report: Iris-Data"
    heads = [line for line in lines if line.startswith("## ")]
    assert heads == [
        "## Dataset Information", "## Neural Networks", "## Other", "## Support Vector Machines", "## Performance Champions",
    ]
    assert "- **Size**: small (4 samples)" in lines
    assert "- **🏃 Fastest Training**: Mystery (two) - 0.500000s" in lines
    assert "- **💾 Most Memory Efficient**: Neural Network (two) - 1.23 MB" in lines
    at = lines.index("## Other")
    assert lines[at + 1].startswith("| Library | Algorithm |") and lines[at + 2].startswith("|---") and "Mystery" in lines[at + 3]


def test_no_line_for_a_metric_without_values(frame):
    runs = frame([(*r[:5], None) for r in RUNS], schemas.RESULT)
    _, stats = analyse(runs)
    lines = [r["line"] for r in report_document(dataset_profile(runs, "model"), stats, "x", F.lit("2025-07-27 19:18:13").cast("timestamp")).collect()]
    assert None not in lines and not any("Memory Efficient" in line for line in lines)
    assert "- **Timestamp**: 2025-07-27 19:18:13" in lines


def test_more_names_are_an_option(frame):
    runs = frame([("one", "DecisionTree", 1.0, 1.0, 1.0, 1.0)], schemas.RESULT)
    assert standardise(runs).first()["algorithm"] == "DecisionTree"
    assert standardise(runs, {"DecisionTree": "Decision Tree"}).first()["category"] == "Tree-Based Models"
