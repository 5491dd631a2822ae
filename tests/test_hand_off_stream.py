"""Ingestions as state: a stream of changes ends with the rows of the batch form."""

import json
import random
from datetime import datetime, timedelta

import pytest

from quillmesh.operators.contracts import INGESTION_FILES
from quillmesh.streaming import hand_off

SCHEMA = "identity string, provider string, file string, at timestamp, gone boolean, digest string"
START = datetime(2024, 1, 1)


def _next(provider, files, same):
    """What an ingestion does next, said once more in Python."""
    has = files.__contains__
    if not files:
        return "closed", None, None
    if not has("request"):
        return None, None, "request_missing"
    if provider != "threads" and files & {"handoff", "judgement"}:
        return None, None, "handoff_of_other_provider"
    if provider != "github" and files & {"plan", "research"}:
        return None, None, "research_of_other_provider"
    if {"plan", "analysis"} <= files:
        return None, None, "plan_with_analysis"
    if not has("evidence"):
        if files & {"analysis", "plan", "research"}:
            return None, None, "before_evidence"
        if has("judgement"):
            issue = "judgement_without_handoff" if not has("handoff") else None if same else "judgement_of_other_evidence"
            return (None, None, issue) if issue else ("fetch-evidence", None, None)
        return ("waiting-for-analysis", "semantic-judgement", None) if has("handoff") else ("fetch-evidence", None, None)
    if files & {"handoff", "judgement"}:
        return None, None, "handoff_not_cleared"
    if provider == "github" and not has("research"):
        return None, None, "research_missing"
    if has("analysis"):
        return "apply-analysis", None, None
    if has("plan"):
        return "expand-research", None, None
    return "waiting-for-analysis", "research-plan-or-analysis" if provider == "github" else "analysis", None


def _brute(rows, wait, late):
    now = max(r[3] for r in rows) - late
    out = {}
    for i in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == i), key=lambda r: (r[3], r[4], r[5]))
        latest = {r[2]: r for r in mine}
        files = {f for f, r in latest.items() if not r[4]}
        same = latest["handoff"][5] == latest["judgement"][5] if {"handoff", "judgement"} <= files else False
        provider = min(r[1] for r in mine)
        out[i] = (provider, ",".join(f for f in INGESTION_FILES if f in files), *_next(provider, files, same), bool(files) and mine[-1][3] + wait <= now, mine[-1][3])
    return out


def _made(n, seed):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        i = rng.choice([0, 0, 0, *range(1, 60)])
        at = START + timedelta(minutes=k // 2, seconds=rng.randint(0, 3))
        rows.append((f"s{i}", ("threads", "github", "generic_web")[i % 3], rng.choice(INGESTION_FILES if i % 4 else INGESTION_FILES[:4]), at, rng.random() < 0.35, rng.choice("ab")))
    return rows


def _send(folder, name, rows):
    (folder / name).write_text("\n".join(json.dumps({"identity": r[0], "provider": r[1], "file": r[2], "at": r[3].isoformat(), "gone": r[4], "digest": r[5]}) for r in rows))


def _read(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(folder))


def _by_id(df):
    return {r[0]: tuple(r[1:]) for r in df.select("identity", "provider", "files", "stage", "waiting_for", "issue", "stalled", "last").collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_batch_is_brute_force(spark, seed):
    rows = _made(700, seed)
    expected = _brute(rows, timedelta(hours=2), timedelta(minutes=30))
    assert _by_id(hand_off.stages(spark.createDataFrame(rows + rows[:90], SCHEMA), "2 HOURS", "30 MINUTES")) == expected
    assert len({r[2] for r in expected.values()} | {r[4] for r in expected.values()}) >= 8


def test_stream_ends_as_the_batch_and_goes_on_after_a_restart(spark, tmp_path):
    rows, rng = _made(240, 5), random.Random(6)
    folder, out, check = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")
    folder.mkdir()
    sent = []
    for k in range(2):
        part = rows[k * 120 : (k + 1) * 120]
        # Repeated, and out of order by less than the stream waits for.
        part += rng.sample(part, 30) + (sent[-10:] if sent else [])
        rng.shuffle(part)
        _send(folder, f"{k}.json", part)
        sent += part
        hand_off.run(_read(spark, folder), out, check, "20 MINUTES", "3 HOURS").awaitTermination()
    assert _by_id(hand_off.current(spark, out)) == _brute(sent, timedelta(minutes=20), timedelta(hours=3))
    written = spark.read.schema(hand_off._OUT).parquet(out).count()
    hand_off.run(_read(spark, folder), out, check, "20 MINUTES", "3 HOURS").awaitTermination()
    assert spark.read.schema(hand_off._OUT).parquet(out).count() == written


def test_timers_late_changes_and_closed_ingestions(spark, tmp_path):
    folder, out, check = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")
    folder.mkdir()
    at = lambda minutes: START + timedelta(minutes=minutes)
    _send(folder, "0.json", [("a", "github", "request", at(0), False, ""), ("b", "github", "request", at(0), False, ""), ("b", "github", "request", at(1), True, ""), ("c", "github", "request", at(500), False, "")])
    hand_off.run(_read(spark, folder), out, check, "60 MINUTES", "10 MINUTES").awaitTermination()
    assert {i: (r[2], r[5]) for i, r in _by_id(hand_off.current(spark, out)).items()} == {"a": ("fetch-evidence", True), "b": ("closed", False), "c": ("fetch-evidence", False)}
    # What is older than the watermark is not read; what is newer wakes a stalled ingestion.
    _send(folder, "1.json", [("a", "github", "request", at(5), True, ""), ("b", "github", "request", at(0), False, ""), ("c", "github", "evidence", at(495), False, "")])
    hand_off.run(_read(spark, folder), out, check, "60 MINUTES", "10 MINUTES").awaitTermination()
    _send(folder, "2.json", [("a", "github", "evidence", at(505), False, "")])
    hand_off.run(_read(spark, folder), out, check, "60 MINUTES", "10 MINUTES").awaitTermination()
    found = {i: (r[1], r[2], r[4], r[5]) for i, r in _by_id(hand_off.current(spark, out)).items()}
    assert found == {"a": ("request,evidence", None, "research_missing", False), "b": ("", "closed", None, False), "c": ("request,evidence", None, "research_missing", False)}


def test_nothing_and_what_is_no_change(spark, tmp_path):
    rows = [(None, "github", "request", START, False, ""), ("x", "github", None, START, False, ""), ("x", "github", "other", START, False, ""), ("x", None, "request", None, False, ""), ("y", None, "request", START, None, None)]
    assert _by_id(hand_off.stages(spark.createDataFrame(rows, SCHEMA), "1 HOUR", "1 HOUR")) == {"y": (None, "request", "fetch-evidence", None, None, False, START)}
    assert hand_off.stages(spark.createDataFrame([], SCHEMA), "1 HOUR", "1 HOUR").count() == 0
