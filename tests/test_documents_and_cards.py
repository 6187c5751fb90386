"""Grouped documents written and read back, and card windows of equal anchors."""

from pyspark.sql import functions as F

from vantage.operators import grouped_text as GT
from vantage.plans.extra_jobs import card_windows, html_cards


def test_inbox_after_new_offers(spark, tmp_path):
    lines = ["# Pipeline", "## Pending", "- [ ] http://a | A | T | West | 2026-01-02", "- [ ] http://b | B | T", "- [ ] http://c | C | T | East Town | 2026-01-01",
             "## Processed", "- [x] http://z | Z | T", "", "the end"]
    offers = [(1, "http://c", "C", "New", "East Town", "2026-01-03"), (2, "http://d", "D", "T", "East Town", "2026-01-03"), (3, "http://d", "D", "T2", "East Town", "2026-01-03"),
              (4, "http://e", "E", "T", "", None), (5, "http://f", "F", "T", "East Town", "2026-02-01")]
    frame = spark.createDataFrame(list(enumerate(lines, 1)), "line_no long, line string")
    new = spark.createDataFrame(offers, "pos long, url string, company string, title string, location string, date string")
    title = F.array(F.concat(F.lit("total "), F.col("n").cast("string")))
    heading = F.array(F.lit(""), F.concat(F.lit("### "), "grp", F.lit(" "), F.col("n").cast("string")))

    def document(inbox, offers, name):
        rows, tail = GT.merged_inbox(inbox, offers)
        GT.write_document(GT.grouped_document(rows, heading, title, ["East"], tail), str(tmp_path / name))
        out = GT.read_document(spark, str(tmp_path / name)).orderBy("line_no").collect()
        assert [r.line_no for r in out] == list(range(1, len(out) + 1))
        return [r.line for r in out]

    assert document(frame, new, "a") == [
        "total 6", "", "### East Town 3", "- [ ] http://f | F | T | East Town | 2026-02-01", "- [ ] http://c | C | New | East Town | 2026-01-03",
        "- [ ] http://d | D | T2 | East Town | 2026-01-03", "", "### West 1", "- [ ] http://a | A | T | West | 2026-01-02", "", "### 其他 2",
        "- [ ] http://b | B | T", "- [ ] http://e | E | T |  | ", "## Processed", "- [x] http://z | Z | T", "", "the end"]
    assert document(frame.limit(0), new.limit(0), "b") == ["total 0", "", "## Processed"]


def test_equal_anchors_have_windows_of_their_own(spark):
    anchor = '<a class="jobTitle" href="/companies/c/jobs/7">Same</a>'
    html = "<p>é</p>" + anchor + '<a class="companyName">First</a>' + "x" * 60 + anchor + '<A CLASS="companyName">Second</A>'
    df = spark.createDataFrame([(1, "http://h/x", html), (2, "http://h/x", "no cards"), (3, "http://h/x", None)], "page_id long, url string, html string")
    cards = [r.c for r in df.select(F.explode(card_windows(F.col("html"), 90)).alias("c")).collect()]
    assert len(cards) == 2 and "First" in cards[0].card and "Second" not in cards[0].card and "Second" in cards[1].card
    for c, at in zip(cards, (html.index(anchor), html.rindex(anchor)), strict=True):
        assert c.card == html[max(at - 90, 0):at + 90] and c.inner == "Same"
    (only,) = html_cards(df).collect()
    assert (only.page_id, only.idx, only.title, only.company) == (1, 0, "Same", "First")
