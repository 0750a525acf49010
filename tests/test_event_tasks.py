"""Queries over the log: their distinct events are dealt to tasks by the number of hits."""

import pytest

from runlens import queries
from runlens.operators import features

from .test_oracles import SF, duck, rows

#: Queries of FINDINGS_r03 that share the step, by finding.
SHARE = {
    "F4": "alert_text",
    "F5": "annotated_cases",
    "F6": "anomaly_rate",
    "F7": "answer_cases",
    "F8": "best_profiles",
    "F9": "case_blocks",
    "F10": "channel_frequency",
    "F11": "channel_severity",
    "F12": "combine_logs",
    "F13": "confusion_metrics",
    "F15": "eval_rates",
    "F16": "feature_frequency",
    "F17": "file_counts",
    "F18": "file_status",
    "F19": "flat_metrics",
}


@pytest.mark.parametrize("name", SHARE.values(), ids=SHARE.keys())
def test_more_hits_are_more_tasks(spark, monkeypatch, name):
    """A stage has a task for every so many hits, where the session's four partitions gave it four; the rows are those of SQL."""
    monkeypatch.setattr(features, "EVENT_ROWS", 500, raising=False)
    spark.sparkContext.setJobGroup(f"events of {name}", name)
    try:
        df = queries.QUERIES[name](spark, SF)
        got = df.collect()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    want = duck(SF).execute(queries.ORACLES[name])
    assert rows(df.columns, got) == rows([d[0] for d in want.description], want.fetchall())
    seen = spark.sparkContext.statusTracker()
    jobs = [seen.getJobInfo(j) for j in seen.getJobIdsForGroup(f"events of {name}")]
    sizes = {s.numTasks for j in jobs if j for i in j.stageIds if (s := seen.getStageInfo(i))}
    assert 1 + spark.read.parquet(f"{SF}/lineitem.parquet").count() // 500 in sizes
