"""The log that several writers append to."""

import threading

import pytest

from quillpool.plans import history
from quillpool.sources import tables
from quillpool.sources.commitlog import CommitLog


def lines(log, **more):
    return [r.value for r in log.read(**more).orderBy("number", "place").collect()]


def test_order_is_by_number(spark, tmp_path):
    log = CommitLog(spark, f"file://{tmp_path}/log")
    assert log.last() == 0 and lines(log) == [] and log.append([]) == -1 and log.snapshot() == 0
    assert log.append(["a", "é\n\"x\"", ""]) == 1
    assert log.append(spark.range(50, numPartitions=5).selectExpr("concat('t', id) as value")) == 2
    assert log.append(["z"]) == 3
    table = [f"t{i}" for i in range(50)]
    assert lines(log) == ["a", "é\n\"x\"", "", *table, "z"]
    assert lines(log, after=1) == [*table, "z"] and lines(log, after=2) == ["z"] and lines(log, after=3) == [] and lines(log, upto=1) == lines(log)[:3]
    whole = lines(log)
    assert log.snapshot() == 3 == log.snapshot()
    assert lines(log) == whole and lines(log, after=1) == whole[3:] and lines(log, upto=2) == whole[:-1]
    assert log.append(["after"]) == 4 and lines(log) == [*whole, "after"] and lines(log, after=3) == ["after"]


def test_reads_after_a_snapshot_open_it_and_later_entries(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path / "log"))
    for k in range(4):
        log.append([f"{k}"])
    log.snapshot()
    log.append(["4"])
    for old in (tmp_path / "log" / "entries").iterdir():
        if old.name.isdigit() and int(old.name) <= 4:
            old.unlink()
    assert lines(log) == list("01234")


@pytest.mark.parametrize("writers", [6])
def test_no_append_is_lost(spark, tmp_path, writers):
    """Writers of their own handles append at once: all lines are there, whole, in each writer's order."""
    path, errors = str(tmp_path / "log"), []
    gate = threading.Barrier(writers)

    def work(w):
        try:
            log, mine = CommitLog(spark, path), []
            gate.wait()
            for k in range(8):
                mine.append(log.append([f"{w} {k} a", f"{w} {k} b"]))
                if k == 4 and w < 2:
                    log.snapshot()
            assert mine == sorted(mine)
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=work, args=(w,)) for w in range(writers)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors
    got = lines(CommitLog(spark, path))
    assert len(got) == len(set(got)) == writers * 16
    assert all(a[:-1] == b[:-1] for a, b in zip(got[::2], got[1::2]))  # entries are not mixed
    for w in range(writers):
        assert [x for x in got if x.startswith(f"{w} ")] == [f"{w} {k} {s}" for k in range(8) for s in "ab"]
    assert CommitLog(spark, path).last() == writers * 8


def test_a_number_is_taken_once(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path / "log"))
    assert log._put("entries", 1, "first\n") and not log._put("entries", 1, "second\n")
    assert (tmp_path / "log" / "entries" / f"{1:020d}").read_text() == "first\n" and not [f for f in (tmp_path / "log" / "drafts").iterdir() if not f.name.endswith(".crc")]


def test_an_unreadable_log_is_an_error(spark, tmp_path):
    """Only a log that is not there is empty; one that cannot be read raises, so that nothing is run twice."""
    log = history.HistoryManager(spark, str(tmp_path / "log"))
    assert log.completed() == set()
    log.record({"experiment_name": "x", "status": "COMPLETED"})
    assert log.completed() == {"x"}
    log.commits.append(spark.createDataFrame([('{"experiment_name": "y", "status": "COMPLETED"}',)], "value string"))
    assert log.completed() == {"x", "y"}
    for f in (tmp_path / "log" / "data").rglob("*.parquet"):
        f.unlink()
    for f in (tmp_path / "log" / "data").iterdir():
        for g in f.iterdir():
            g.unlink()
        f.rmdir()
    with pytest.raises(Exception):  # noqa: B017
        log.completed()


def test_plain_logs_are_adopted(spark, tmp_path):
    tables.append_log(spark, str(tmp_path / "plain"), [{"experiment_name": "a", "status": "COMPLETED", "history_data": [], "baseline_metrics": {"baseline_f1": float("nan")}}])
    log = history.HistoryManager(spark, str(tmp_path / "log"))
    log.adopt(str(tmp_path / "plain"))
    log.record({"experiment_name": "b", "status": "FAILED"})
    assert [(r.number, r.experiment_name) for r in log.log().orderBy("number").collect()] == [(1, "a"), (2, "b")]
    assert [r.experiment_name for r in log.log(after=1).collect()] == ["b"]
