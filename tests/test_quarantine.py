"""Files with broken lines give rows and rejects that add up; a full load replaces the rows or leaves them."""

from __future__ import annotations

import json

import pytest

from claimloom.sources import quarantine as q


def put(folder, name, *lines, header="cpt_code,description,rvu_value"):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join([header, *lines]) + "\n")
    return str(folder)


def held(feeds, feed=q.RVU):
    return sorted(tuple(r) for r in feeds.rows(feed).collect()), sorted((r.reason, r.n) for r in feeds.rejects(feed).collect())


def test_broken_prices(spark, tmp_path):
    files = put(tmp_path / "in", "a.csv", "A,x,1.5", "B,y,", "C,z,word", "D", "E,e,1,2", ",none,3", "F,f,-1", "G,g,2", "G,g,2", "H,h,1", "H,h,2", "K,NaN,NaN", '"L","a, b",4')
    put(tmp_path / "in", "b.csv", "G,g,2", "M,,5")
    feeds = q.Feeds(spark, str(tmp_path / "t"))
    counts = feeds.load(files, q.RVU).first()
    rows, rejects = held(feeds)
    assert rows == [("A", "x", 1.5), ("G", "g", 2.0), ("L", "a, b", 4.0), ("M", None, 5.0)]
    assert rejects == [("contradicting_rows", 1), ("contradicting_rows", 1), ("malformed", 1), ("malformed", 1), ("malformed", 1), ("no_cpt_code", 1), ("no_rvu_value", 1), ("no_rvu_value", 1), ("repeated_row", 2), ("rvu_value_below_zero", 1)]
    assert tuple(counts) == (15, 4, 11, True)
    bad = {r.record: r.file for r in feeds.rejects(q.RVU).where("reason = 'malformed'").collect()}
    assert bad == {"C,z,word": "a.csv", "D": "a.csv", "E,e,1,2": "a.csv"}


def test_a_load_replaces_or_leaves(spark, tmp_path):
    feeds = q.Feeds(spark, str(tmp_path / "t"))
    feeds.load(put(tmp_path / "one", "a.csv", "A,x,1", "B,x,1"), q.RVU)
    feeds.load(put(tmp_path / "two", "a.csv", "C,x,3"), q.RVU)
    assert held(feeds) == ([("C", "x", 3.0)], [])
    for name, lines in (("three", ["D,x,"]), ("four", [])):  # nothing good, no line at all
        counts = feeds.load(put(tmp_path / name, "a.csv", *lines), q.RVU).first()
        assert tuple(counts) == (len(lines), 0, len(lines), False)
        assert held(feeds) == ([("C", "x", 3.0)], [("no_rvu_value", 1)] * len(lines))
    with pytest.raises(Exception, match="CSV header does not conform"):
        feeds.load(put(tmp_path / "five", "a.csv", "1,2,3", header="a,b,c"), q.RVU)
    assert held(feeds)[0] == [("C", "x", 3.0)]


def test_a_killed_swap_is_finished(spark, tmp_path, monkeypatch):
    feeds = q.Feeds(spark, str(tmp_path / "t"))
    feeds.load(put(tmp_path / "one", "a.csv", "A,x,1"), q.RVU)

    def killed(self, source, target):
        raise KeyboardInterrupt

    with monkeypatch.context() as m, pytest.raises(KeyboardInterrupt):
        m.setattr(q.Feeds, "move", killed)
        feeds.load(put(tmp_path / "two", "a.csv", "B,x,2"), q.RVU)
    assert not feeds.exists("rvu")
    assert held(feeds) == ([("B", "x", 2.0)], [])


def test_training_lines(spark, tmp_path):
    header = "claim_id,total_charge_amount,patient_age,num_diagnoses,num_line_items,target_filter_id"
    files = put(tmp_path / "in", "a.csv", "1,10,40,1,2,F1", "2,,,,,F1", "3,-1,40,1,2,F1", "4,10,40,-1,2,F1", "5,10,40,1,2,", "6,10,old,1,2,F1", "1,10,40,1,2,F1", header=header)
    feeds = q.Feeds(spark, str(tmp_path / "t"))
    assert tuple(feeds.load(files, q.TRAINING).first()) == (7, 3, 4, True)  # no unique column: equal lines stay
    assert {r for r, _ in held(feeds, q.TRAINING)[1]} == {"charge_below_zero", "count_below_zero", "no_target", "malformed"}


def test_settings(tmp_path):
    pytest.importorskip("yaml")
    path = tmp_path / "s.yaml"
    path.write_text("# names\ndatabase:\n  host: ${HOST:-localhost}\n  ports: [1, 2]\n  user: ${USER_NAME}\nlimit: 0.8\n")
    want = {"database": {"host": "localhost", "ports": [1, 2], "user": "u"}, "limit": 0.8}
    assert q.settings(str(path), {"USER_NAME": "u"}) == want
    (tmp_path / "s.json").write_text(json.dumps({"a": "${X:-y}"}))
    assert q.settings(str(tmp_path / "s.json"), {}) == {"a": "y"}
    for text, want in (("", {}), ("# nothing\n", {})):
        path.write_text(text)
        assert q.settings(str(path), {}) == want
    path.write_text("- a\n")
    with pytest.raises(ValueError):
        q.settings(str(path), {})
