import json
import time

import pytest

from shelfspark.__main__ import main
from shelfspark.plans.jobs import Jobs
from shelfspark.plans.model import LONGEST, ModelError, Retrying, answerer


def test_retries():
    replies, waits = [], []

    def call(prompt):
        r = replies.pop(0)
        if isinstance(r, Exception):
            raise r
        return r

    ask = Retrying(call, 3, waits.append)
    replies[:] = [ModelError("busy", 429, 7.0), ModelError("late"), " yes "]
    assert ask("x") == "yes" and waits[0] == 7.0 and 2 <= waits[1] < 3
    replies[:] = [ModelError("busy", 503, 900.0), "ok"]
    assert ask("x") == "ok" and waits[-1] == LONGEST
    for status in (401, 403, 404, 418):
        replies[:] = [ModelError("no", status), "never"]
        with pytest.raises(ModelError):
            ask("x")
        assert replies == ["never"]
    replies[:] = ["", " ", ""]
    with pytest.raises(ModelError):
        ask("x")
    assert replies == []


def test_answerer(spark):
    def call(prompt):
        if "bad" in prompt:
            raise ModelError("no key", 401)
        return f"so: {len(prompt) > 10}"

    given = spark.createDataFrame([(1, "q", "search", None, "e"), (2, "bad", "search", None, "e")], "query_id long, question string, mode string, note string, excerpts string")
    got = {r.query_id: (r.answer, r.error) for r in answerer(call)(given).collect()}
    assert got == {1: ("so: True", None), 2: (None, "no key")}


def test_jobs_run_one_at_a_time_and_a_folder_once():
    class Slow:
        seen = []

        def sync_folder(self, folder):
            self.seen.append(folder)
            time.sleep(0.2)
            if folder == "/bad":
                raise ValueError("no")
            return {"to_index": 1}

    jobs = Jobs(Slow())
    first = jobs.start("/a")
    assert jobs.start("/a") is first and jobs.status("/none") is None
    bad, last = jobs.start("/bad"), jobs.start("/c")
    jobs.close()
    assert (first.state, first.report, bad.state, bad.error, last.state) == ("done", {"to_index": 1}, "error", "no", "done")
    assert Slow.seen == ["/a", "/bad", "/c"] and first.finished_at <= last.started_at


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs/a.txt").write_text("The boiler was drained in May by the crew of the pump house.")
    at = ["--index", str(tmp_path / "index")]
    assert main([*at, "index", str(tmp_path / "docs")], spark) == 0
    assert json.loads(capsys.readouterr().out)["to_index"] == 1
    assert main([*at, "status", str(tmp_path / "docs")], spark) == 0
    assert json.loads(capsys.readouterr().out)["files_indexed"] == 1
    assert main([*at, "ask", str(tmp_path / "docs"), "when was the boiler drained"], spark) == 0
    assert "[1] a.txt" in capsys.readouterr().out
    lines = iter(["when was the boiler drained\n", "exit\n"])
    assert main([*at, "chat", str(tmp_path / "docs")], spark, lambda: next(lines)) == 0
    assert "[1] a.txt" in capsys.readouterr().out
    assert main([*at, "index", str(tmp_path / "none")], spark) == 1
