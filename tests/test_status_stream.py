"""The status stream against the same machine in plain Python, over batches out of order, late rows and a restart."""

import random

import pytest

from stratafind.streaming import status as S

LOG = "path string, ts timestamp, event_id long, kind string"
DELAY, TIMEOUT, RETRY = 10_000, 30_000, 50_000


def plain(events, watermark):
    """path -> (status, since, attempts) after all events, in order, and the timers up to the watermark or the last event."""
    out, by_path = {}, {}
    for path, ms, event, kind in events:
        by_path.setdefault(path, []).append((ms, event, kind))

    def timers(status, since, tries, now):
        if status == "processing" and now - since >= TIMEOUT:
            status, since = "error", since + TIMEOUT
        if status == "error" and now - since >= RETRY:
            return "pending", since + RETRY, tries + 1
        return status, since, tries

    for path, rows in by_path.items():
        status, since, tries = "", 0, 0
        for ms, _, kind in sorted(rows):
            status, since, tries = timers(status, since, tries, ms)
            if kind == "scan" and status in ("", "error"):
                status, since, tries = "pending", ms, tries + 1
            elif kind == "start" and status == "pending":
                status, since = "processing", ms
            elif kind in ("finish", "fail") and status == "processing":
                status, since = {"finish": "done", "fail": "error"}[kind], ms
        status, since, tries = timers(status, since, tries, max(watermark, max(rows)[0]))
        if status:
            out[path] = (status, since, tries)
    return out


def write(spark, folder, events):
    frame = spark.createDataFrame(events, "path string, ms long, event_id long, kind string")
    frame.selectExpr("path", "timestamp_millis(ms) AS ts", "event_id", "kind").coalesce(1).write.mode("append").parquet(folder)


def taken(spark, folder, state):
    log = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(folder)
    S.follow(log, state, delay_ms=DELAY, timeout_ms=TIMEOUT, retry_ms=RETRY)
    return {r["path"]: tuple(r)[1:] for r in S.current(spark.read.schema(S.OUT).parquet(f"{state}/changes")).collect()}


def made(seed):
    r = random.Random(seed)
    return [(f"f{r.randrange(12)}", 1_000_000 + k * 900 + r.randrange(900), k, r.choice(["scan", "scan", "start", "start", "finish", "fail"])) for k in range(300)]


@pytest.mark.parametrize("seed", [1, 2])
def test_three_batches_out_of_order_and_a_restart(spark, tmp_path, seed):
    events, r = made(seed), random.Random(seed)
    batches = [[], [], []]
    for k, e in enumerate(events):  # some events come a batch late, by less than the delay
        at = k // 100
        batches[at + 1 if at < 2 and k % 100 > 92 and r.random() < 0.5 else at].append(e)
    for b in batches:
        r.shuffle(b)
    folder, state = str(tmp_path / "log"), str(tmp_path / "state")
    write(spark, folder, batches[0])
    for b in (batches[1], None, batches[2]):  # each run goes on from the last one's checkpoint; the second finds one batch more
        taken(spark, folder, state)
        if b:
            write(spark, folder, b)
    got = taken(spark, folder, state)
    assert got == plain(events, max(e[1] for e in events) - DELAY)
    assert taken(spark, folder, state) == got


def test_rows_behind_the_watermark_go_and_timers_fire_without_events(spark, tmp_path):
    folder, state = str(tmp_path / "log"), str(tmp_path / "state")
    write(spark, folder, [("a", 1000, 1, "scan"), ("a", 2000, 2, "start"), (None, 2500, 3, "scan"), ("c", 3000, 4, "finish")])
    assert taken(spark, folder, state) == {"a": ("processing", 2000, 1)}
    write(spark, folder, [("b", 200_000, 5, "scan")])  # passes a's time-out and its retry
    assert taken(spark, folder, state) == {"a": ("pending", 2000 + TIMEOUT + RETRY, 2), "b": ("pending", 200_000, 1)}
    write(spark, folder, [("a", 5000, 6, "finish"), ("b", 195_000, 7, "start")])  # too late; late, and before the scan
    assert taken(spark, folder, state) == {"a": ("pending", 2000 + TIMEOUT + RETRY, 2), "b": ("pending", 200_000, 1)}


def test_done_is_not_queued_again():
    status = ("", 0, 0)
    for ms, kind, want in [(1, "start", ""), (2, "scan", "pending"), (3, "start", "processing"), (4, "scan", "processing"), (5, "finish", "done"), (9**12, "scan", "done")]:
        status = S.stepped(*status, ms, kind, TIMEOUT, RETRY)
        assert status[0] == want
