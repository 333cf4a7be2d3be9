"""Artifacts of a run. Hypotheses exist only where validation passed; a run that fails leaves none behind."""

from __future__ import annotations

import json
import math
import os
from collections.abc import Mapping
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def validate(published: DataFrame) -> DataFrame:
    """Per recording (rec) the publication gate over published (rec, seq, tick, start, end, speaker, text)."""
    key = F.sha2(F.to_json(F.struct("start", "end", "text")), 256)
    checks = published.groupBy("rec").agg(
        F.count(F.lit(1)).alias("turns"),
        (F.count(F.lit(1)) - F.count_distinct(key)).alias("repeats"),
        F.sum(F.when(F.col("end") > F.col("tick") + 1e-6, 1).otherwise(0)).alias("early"),
        F.sum(F.when(F.coalesce(F.trim("speaker"), F.lit("")) == "", 1).otherwise(0)).alias("unassigned"),
        F.max(F.col("tick") - F.col("end")).alias("worst_lag"),
    )
    return checks.withColumn("passed", (F.col("repeats") == 0) & (F.col("early") == 0) & (F.col("unassigned") == 0))


def write_run(published: DataFrame, path: str) -> DataFrame:
    """Write trace, validation and hypothesis under path, as Parquet and JSON; returns the validation.

    Spark's committer makes each table appear at once. The hypothesis holds only recordings that passed, and is overwritten even if none did."""
    spark = published.sparkSession
    published.write.mode("overwrite").parquet(f"{path}/ticks")
    trace = spark.read.schema(published.schema).parquet(f"{path}/ticks")
    validate(trace).write.mode("overwrite").json(f"{path}/validation")
    passed = validate(trace)
    good = trace.join(passed.where("passed").select("rec"), "rec", "left_semi").select("rec", "start", "end", "speaker", "text")
    good.write.mode("overwrite").json(f"{path}/hypothesis")
    return passed


def read_committed(spark, path: str) -> DataFrame:
    return spark.read.schema("rec long, start double, end double, speaker string, text string").json(f"{path}/hypothesis")


def write_json(path: str | Path, value) -> None:
    """value as JSON with sorted keys, at once: readers see the old file or the new one. What is not finite is an error."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    draft = path.with_name(path.name + ".tmp")
    draft.write_text(json.dumps(value, ensure_ascii=False, indent=2, sort_keys=True, allow_nan=False) + "\n", encoding="utf-8")
    os.replace(draft, path)


def write_jsonl(path: str | Path, rows) -> None:
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    draft = path.with_name(path.name + ".tmp")
    with draft.open("w", encoding="utf-8") as f:
        f.writelines(json.dumps(r, ensure_ascii=False, sort_keys=True) + "\n" for r in rows)
    os.replace(draft, path)


HYPOTHESIS, VALIDATION, TRACE, PUBLISHED = "hypothesis.json", "stream_validation.json", "results/ticks.jsonl", "published"


def write_recording(folder: str | Path, rows: list[dict], validation: Mapping, turns: list[Mapping], name: str = "", audio: str = "") -> bool:
    """One recording's trace and validation, and its hypothesis only if it passed; a stale one goes. Returns whether it may be published."""
    folder = Path(folder)
    write_jsonl(folder / TRACE, rows)
    passed = validation.get("status") == "passed"
    if not passed:
        drop_hypotheses(folder)
    write_json(folder / VALIDATION, {**validation, "postprocess_gate_pass": passed})
    if passed:
        write_json(folder / HYPOTHESIS, [{"audio_name": name, "audio_path": audio, "segments": list(turns)}])
    return passed and publishable(folder)


def drop_hypotheses(folder: str | Path) -> None:
    for at in (HYPOTHESIS, f"{PUBLISHED}/{HYPOTHESIS}", f"{PUBLISHED}/summary.json"):
        (Path(folder) / at).unlink(missing_ok=True)


def mark_failure(folder: str | Path, error: BaseException) -> None:
    """A run that failed after its ticks: the validation says so, in at most 512 characters, and nothing is left to be taken for a result."""
    folder, why = Path(folder), repr(error)
    why = why if len(why) <= 512 else why[:509] + "..."
    try:
        known = json.loads((folder / VALIDATION).read_text(encoding="utf-8"))
    except (OSError, json.JSONDecodeError):
        known = {}
    write_json(folder / VALIDATION, {**(known if isinstance(known, dict) else {}), "status": "failed", "speaker_assignment_gate_pass": False, "postprocess_gate_pass": False, "pipeline_stage_failed": True, "pipeline_error": why})
    drop_hypotheses(folder)


def valid_hypothesis(value) -> bool:
    """One recording with a list of turns: finite times in order, a speaker that is not blank, text."""

    def turn(t) -> bool:
        if not isinstance(t, Mapping) or not isinstance(t.get("text", ""), str) or not str(t.get("speaker", "UNK")).strip():
            return False
        try:
            start, end = float(t["start"]), float(t["end"])
        except (KeyError, TypeError, ValueError):
            return False
        return math.isfinite(start) and math.isfinite(end) and 0 <= start <= end

    return isinstance(value, list) and len(value) == 1 and isinstance(value[0], Mapping) and isinstance(value[0].get("segments"), list) and all(map(turn, value[0]["segments"]))


def _count(v) -> bool:
    return isinstance(v, int) and not isinstance(v, bool) and v >= 0


def _seconds(v) -> bool:
    return isinstance(v, (int, float)) and not isinstance(v, bool) and math.isfinite(v) and v >= 0


def _none(v) -> bool:
    """No violations: an empty list, or the number 0."""
    return (_count(v) and v == 0) or (isinstance(v, list) and not v)


def content_gate(v: Mapping) -> bool:
    """Whether what was heard is in the result; evidence that is missing or malformed counts against it."""
    observed, material = v.get("observed_speech"), v.get("observed_material_content", v.get("observed_speech"))
    counts = v.get("observed_mapped_segment_count"), v.get("committed_segment_count")
    if not all(isinstance(x, bool) for x in (observed, material, v.get("final_content_gate_pass"))) or not all(map(_count, counts)):
        return False
    return observed == (counts[0] > 0) and (observed or not material) and v["final_content_gate_pass"] and (not material or counts[1] > 0)


def publishable(folder: str | Path, speakers: bool = False) -> bool:
    """Whether a recording's files may be published; speakers: the artifact with lasting labels. Anything missing or odd says no."""
    folder = Path(folder)
    try:
        v = json.loads((folder / VALIDATION).read_text(encoding="utf-8"))
        hypothesis = json.loads((folder / (f"{PUBLISHED}/{HYPOTHESIS}" if speakers else HYPOTHESIS)).read_text(encoding="utf-8"))
    except (OSError, json.JSONDecodeError):
        return False
    if not isinstance(v, dict) or not valid_hypothesis(hypothesis) or not content_gate(v):
        return False
    latency = v.get("latency", {"max_sec": 0})
    return (
        v.get("status") == "passed"
        and v.get("postprocess_gate_pass") is True
        and (not speakers or v.get("speaker_assignment_gate_pass") is True)
        and all(_none(v.get(k)) for k in ("failed_ticks", "timestamp_violations", "schedule_mismatches"))
        and isinstance(v.get("failed_ticks"), list)
        and _count(v.get("expected_tick_count"))
        and v.get("tick_count") == v.get("expected_tick_count")
        and all(_seconds(v[k]) for k in ("algorithmic_delay_sec", "pending_age_max_sec", "delta_first_publish_age_max_sec") if k in v)
        and isinstance(latency, dict)
        and _seconds(latency.get("max_sec"))
    )


def materialize(folder: str | Path, policy: str = "identity") -> dict:
    """Copy a published recording as the artifact with lasting labels, and a summary; nothing is labelled anew."""
    folder = Path(folder)
    if not publishable(folder):
        raise ValueError(f"{folder} may not be published")
    v = json.loads((folder / VALIDATION).read_text(encoding="utf-8"))
    hypothesis = json.loads((folder / HYPOTHESIS).read_text(encoding="utf-8"))
    write_json(folder / VALIDATION, {**v, "speaker_assignment_gate_pass": True})
    write_json(folder / PUBLISHED / HYPOTHESIS, hypothesis)
    turns = hypothesis[0]["segments"]
    summary = {"speaker_policy": policy, "causal": True, "text_timestamp_identity": True, "segments": len(turns), "speakers": sorted({t["speaker"] for t in turns}), "stream_validation_path": VALIDATION}
    write_json(folder / PUBLISHED / "summary.json", summary)
    return summary


def run_summary(recordings: list[Mapping]) -> dict:
    """Of recordings (name, status, duration_sec, wall_sec): how many completed, and the real-time factor weighted by duration."""
    done = [r for r in recordings if r.get("status") == "passed" and r.get("duration_sec", 0) > 0]
    audio = sum(r["duration_sec"] for r in done)
    return {"recordings": [{**r, "rtf": r["wall_sec"] / r["duration_sec"]} if r in done else dict(r) for r in recordings], "completed": len(done), "failed": len(recordings) - len(done), "duration_weighted_rtf": sum(r["wall_sec"] for r in done) / audio if audio else None}
