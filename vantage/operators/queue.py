"""Work queue: latest state per item, eligibility, summary, ids, report numbers, url resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import cut_table, once
from .contains import best_texts
from .prefix import row_number_global
from .skew import lookup

STATE_COLS = ["status", "report_num", "score", "retries"]


def latest_state(log: DataFrame, key: str = "id", seq: str = "seq") -> DataFrame:
    """upsert_queue_state: insert-or-replace by id == the last state-change per id.

    ``max_by`` over the sequence is a map-side-combined aggregate; the first
    sequence number is kept as the row's position in the state file.
    """
    latest = log.groupBy(key).agg(
        F.max_by(F.struct(*STATE_COLS), F.col(seq)).alias("s"), F.min(seq).alias("first_seq"))
    return latest.select(key, "first_seq", *[F.col(f"s.{c}").alias(c) for c in STATE_COLS])


def render_state_tsv(state: DataFrame, urls: DataFrame) -> DataFrame:
    """State rows -> TSV lines (header + one line per id, ``-`` for missing values)."""
    s = state.join(urls.select("id", "url"), "id", "left")

    def cell(c):
        return F.coalesce(F.col(c).cast("string"), F.lit("-"))

    error = F.coalesce(F.when(F.col("status") == "failed", F.concat(F.lit("exit code "), F.col("retries").cast("string"))), F.lit("-"))
    line = F.concat_ws("\t", F.col("id").cast("string"), cell("url"), cell("status"), F.lit("-"), F.lit("-"),
                       cell("report_num"), cell("score"), error, cell("retries"))
    header = state.sparkSession.createDataFrame(
        [(-1, "id\turl\tstatus\tstarted_at\tcompleted_at\treport_num\tscore\terror\tretries")], "pos long, line string")
    return header.unionByName(s.select(F.col("first_seq").alias("pos"), line.alias("line")))


def src_state_tsv(lines: DataFrame) -> DataFrame:
    """Tolerant state reader: header and short rows skipped, numeric id, ``-`` -> null."""
    f = F.split(F.col("line"), "\t", -1)

    def val(i):
        v = F.get(f, i)
        return F.when((v != "-") & (v != ""), v)

    ok = (F.size(f) >= 9) & F.get(f, 0).rlike("^[0-9]+$")
    return lines.where(ok).select(
        F.get(f, 0).cast("long").alias("id"), val(1).alias("url"), val(2).alias("status"),
        val(5).alias("report_num"), val(6).try_cast("double").alias("score"), val(7).alias("error"),
        val(8).try_cast("int").alias("retries"))


def eligible(inputs: DataFrame, state: DataFrame, start_from: int = 0, max_retries: int = 2,
             retry_failed: bool = False) -> DataFrame:
    """flt_queue_eligible: numeric id ≥ start; normal mode drops completed and exhausted failures."""
    i = inputs.where(F.col("id").cast("string").rlike("^[0-9]+$") & (F.col("id") >= start_from)
                     & F.col("url").isNotNull() & (F.col("url") != ""))
    j = i.join(state.select("id", "status", "retries"), "id", "left")
    st, rt = F.col("status"), F.coalesce(F.col("retries"), F.lit(0))
    if retry_failed:
        keep = (st == "failed") & (rt < max_retries)
    else:
        keep = ~F.coalesce(st == "completed", F.lit(False)) & ~F.coalesce((st == "failed") & (rt >= max_retries),
                                                                         F.lit(False))
    return j.where(keep)


def min_score_gate(state: DataFrame, min_score: float) -> DataFrame:
    """flt_min_score: completed items scored below the floor become skipped / below-min-score."""
    below = (F.col("status") == "completed") & F.col("score").isNotNull() & (F.col("score") < min_score)
    return state.select("id", F.when(below, "skipped").otherwise(F.col("status")).alias("status"),
                        F.when(below, "below-min-score").alias("error"))


def queue_summary(state: DataFrame) -> DataFrame:
    """agg_queue_summary: totals and the completed mean truncated to one decimal (exact integer math)."""
    st = F.col("status")
    done_score = F.when((st == "completed") & F.col("score").isNotNull(), F.col("score"))
    c = state.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(st == "completed").alias("completed"),
        F.count_if(st == "failed").alias("failed"),
        F.count_if(~st.isin("completed", "failed") | st.isNull()).alias("pending"),
        F.sum(F.round(done_score * 10).cast("long")).alias("_s10"), F.count(done_score).alias("_n"))
    return c.select("total", "completed", "failed", "pending",
                    F.when(F.col("_n") > 0, F.floor(F.col("_s10") / F.col("_n")) / F.lit(10.0)).alias("avg_score"))


def notes_parts(notes: Column, url: Column) -> tuple[Column, Column, Column]:
    """join_queue_notes: ``Role @ Company | Match% | url`` -> (role, company, url)."""
    tail = F.substring_index(notes, "| ", -1)
    has_bar = F.instr(notes, "| ") > 0
    u = F.when(has_bar & T.js_trim(tail).startswith("http"), T.js_trim(tail))
    u = F.coalesce(u, F.when(url.startswith("http"), url))
    head = F.when(F.instr(notes, " | ") > 0, F.substring_index(notes, " | ", 1)).otherwise(notes)
    has_at = F.instr(head, " @ ") > 0
    role = F.when(has_at, T.js_trim(F.regexp_extract(head, r"^([\s\S]*) @ ", 1)))
    company = F.when(has_at, T.js_trim(F.regexp_extract(head, r"^[\s\S]* @ ([\s\S]*)$", 1)))
    return role, company, u


def next_ids(items: DataFrame, order: str, existing_ids: DataFrame) -> DataFrame:
    """win_queue_ids: ids from max(existing) + 1 in item order (range-partitioned prefix count)."""
    mx = existing_ids.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_max"))
    ranked = row_number_global(items, [order], "_rn")
    return ranked.withColumn("_one", F.lit(1)).join(F.broadcast(mx.withColumn("_one", F.lit(1))), "_one") \
        .withColumn("id", F.col("_max") + F.col("_rn")).drop("_one", "_max", "_rn")


def report_urls(completed: DataFrame) -> DataFrame:
    """(report_num, m_url) from completed items (report_num, qurl, first_seq), the last in file order winning.

    A number of fewer than three characters is a key as it stands and padded with zeros to three.
    """
    num = F.col("report_num")
    keys = F.when(F.length(num) < 3, F.array(num, F.lpad(num, 3, "0"))).otherwise(F.array(num))
    return (completed.select(F.explode(keys).alias("report_num"), "qurl", "first_seq").groupBy("report_num")
            .agg(F.max_by("qurl", "first_seq").alias("m_url")))


def best_role(apps: DataFrame, cands: DataFrame, app_id: str = "pos") -> DataFrame:
    """join_best_role: per app, the candidate url of its company block with the most role words.

    ``apps``: (app_id, ckey, role); ``cands``: (ckey, cand_role, url, cand_pos).
    One candidate -> it; several -> most app-role words (> 2 bytes) contained
    in the candidate role, ties and all-zero -> the earliest candidate.
    Candidates are first collapsed to distinct roles per block and applications
    to distinct word lists, which are looked up in an index of the roles' grams.
    """
    # Nulls are dropped from the written tables: a filter before would work out every key a second time.
    roles = cut_table(cands.groupBy(F.col("ckey").alias("block"), F.lower("cand_role").alias("text")).agg(
        F.min_by("url", "cand_pos").alias("value"), F.min("cand_pos").alias("place"))).where("block is not null and text is not null")
    # Applications of blocks without candidates have no answer: they leave before their roles are taken apart and looked up.
    known = roles.select("block").distinct()
    asked = cut_table(apps.select(app_id, "role", once(F.col("ckey")).alias("block")).join(known, "block", "left_semi")
                      .select(app_id, "block", F.split(F.lower(T.js_trim("role")), r"[ \t\n\r\f\v]+").alias("words"))
                      .withColumn("words", F.coalesce(F.filter("words", lambda w: F.octet_length(w) > 2), F.array().cast("array<string>"))))
    best = best_texts(asked.select("block", "words").distinct(), roles)
    first = roles.groupBy("block").agg(F.min_by("value", "place").alias("first_url"))
    answers = asked.select("block", "words").distinct().join(first, "block").join(best.drop("place"), ["block", "words"], "left")
    return lookup(asked, answers, ["block", "words"]).select(app_id, F.coalesce("value", "first_url").alias("url"), F.coalesce("score", F.lit(0)).alias("score"))
