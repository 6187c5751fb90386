"""Only applications of companies that have candidates are taken apart and written."""

from vantage.operators import queue as QU


def test_applications_without_candidates_are_not_written(spark, monkeypatch):
    written = []
    monkeypatch.setattr(QU, "cut_table", lambda df, cut=QU.cut_table: (written.append(cut(df)), written[-1])[1])
    apps = [(1, "acme", "Data Developer"), (2, "acme", None), (2, "acme", "Lead"), (None, "acme", "Data"), (5, None, "Data"), (6, "", "Data")]
    apps += [(100 + i, f"other {i}", "Data Developer") for i in range(50)]
    cands = [("acme", "Lead Developer", "u1", 1), ("acme", "Data Lead", "u2", 2), ("nobody", "Data", "u3", 3), (None, "Data", "u4", 4), ("", None, "u5", 5)]
    best = QU.best_role(spark.createDataFrame(apps, "pos long, ckey string, role string"), spark.createDataFrame(cands, "ckey string, cand_role string, url string, cand_pos long"))
    assert sorted(((r.pos, r.url, r.score) for r in best.collect()), key=str) == [(1, "u1", 1), (2, "u1", 0), (2, "u1", 1), (None, "u2", 1)]
    asked = next(t for t in written if "words" in t.columns)
    assert asked.columns == ["pos", "block", "words"] and asked.count() == 4
