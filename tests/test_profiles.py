"""Profiles that extend each other, and the states of jobs over micro-batches."""

import json

from reportloom.plans import profiles as PF
from reportloom.streaming import jobs


def test_profiles(spark):
    rows = [
        ("base", None, '{"page": {"size": "A4", "margin": {"top": 20, "left": 10}}, "fonts": {"body": {"size": 11}}, "numbering": [{"m": "1"}, {"m": "-", "gap": 3}]}'),
        ("wide", "base", '{"page": {"margin": {"left": 30}}, "fonts": "none", "numbering_all": {"gap": 0}}'), ("wider", "wide", '{"fonts": {"title": 1}, "numbering": [{"m": "x"}]}'), ("same", "wider", None),
        ("a", "b", "{}"), ("b", "c", "{}"), ("c", "a", "{}"), ("d", "c", "{}"), ("gone", "nothing", "{}"), ("list", "base", "[1]"), ("text", None, "no json"), ("own", "own", "{}"),
    ]
    df = spark.createDataFrame(rows, "name string, extends string, body string")
    got = {r["name"]: (json.loads(r["profile"]) if r["profile"] else None, r["problem"]) for r in PF.resolved(df).collect()}
    assert got["wide"] == ({"page": {"size": "A4", "margin": {"top": 20, "left": 30}}, "fonts": "none", "numbering": [{"m": "1", "gap": 0}, {"m": "-", "gap": 0}]}, None)
    assert got["wider"][0]["fonts"] == {"title": 1} and got["wider"][0]["numbering"] == [{"m": "x", "gap": 0}] and got["same"] == got["wider"]
    assert {n: got[n] for n in "abcd"} == {n: (None, "cycle") for n in "abcd"} and got["own"] == (None, "cycle")
    assert got["gone"] == (None, "missing") and got["list"] == got["text"] == (None, "broken")
    flat = {(r["name"], r["path"]): (r["value"], r["problem"]) for r in PF.profile_rows(df).collect()}
    assert flat["wide", "page.margin.left"] == ("30", None) and flat["a", None] == (None, "cycle") and ("wide", "fonts.body.size") not in flat
    assert PF.profile_rows(df.limit(0)).count() == 0


def test_job_states_over_batches(spark, tmp_path):
    folder, sink = tmp_path / "events", tmp_path / "states"
    folder.mkdir()

    def heard(name, events):
        (folder / name).write_text("".join(json.dumps(dict(zip(("job", "at", "stage", "done", "message"), e, strict=True))) + "\n" for e in events))
        jobs.follow_jobs(spark, str(folder), str(sink), str(tmp_path / "checkpoint"), once=True).awaitTermination(120)
        rows = spark.read.parquet(str(sink)).orderBy("batch", "job").collect()
        last = {r["job"]: (r["stage"], r["done"], r["message"], r["events"], str(r["at"])[11:16]) for r in rows}
        return last

    day = "2026-01-05T"
    first = heard("1.json", [("j1", f"{day}10:00:00Z", "read", 0.1, "in"), ("j1", f"{day}10:05:00Z", "fit", 0.5, None), ("j2", f"{day}10:01:00Z", "read", 0.2, "x"), (None, f"{day}10:01:00Z", "read", 0.2, "x"), ("j3", None, "read", 0.2, "x")])
    assert first == {"j1": ("fit", 0.5, "in", 2, "10:05"), "j2": ("read", 0.2, "x", 1, "10:01")}
    second = heard("2.json", [("j1", f"{day}10:04:30Z", "late", 0.9, "old"), ("j1", f"{day}10:10:00Z", "done", 0.4, "ok"), ("j4", f"{day}11:30:00Z", "read", None, None)])
    assert second["j1"] == ("done", 0.5, "ok", 4, "10:10") and second["j4"] == ("read", 0.0, "", 1, "11:30") and second["j2"][0] in ("read", "lost")
    third = heard("3.json", [("j4", f"{day}11:31:00Z", "fit", 0.3, "y")])
    assert third["j2"] == ("lost", 0.2, "x", 1, "10:01") and third["j1"][0] == "done" and third["j4"] == ("fit", 0.3, "y", 2, "11:31")


def test_chains_are_not_broadcast(spark):
    df = spark.createDataFrame([(1, None, '{"a": 1}'), (2, 1, '{"b": 2}')], "name long, extends long, body string")
    out = PF.resolved(df)
    assert sorted(r["profile"] for r in out.collect()) == ['{"a": 1, "b": 2}', '{"a": 1}']
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
