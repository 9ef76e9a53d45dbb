"""Boards embedded in pages, undated feed entries, and checks of coherence."""

import json

from pyspark.sql import functions as F
from topicflow.operators import replies
from topicflow.sources import landed


def page(*texts):
    return "<html>" + "".join(f"<script>self.__next_f.push([1,{json.dumps(t)}])</script>" for t in texts) + "</html>"


def test_boards_are_read_by_decoding_and_faults_have_reasons(spark):
    entry = lambda rank, name: {"rank": rank, "modelDisplayName": name, "modelOrganization": "o", "rating": 1.25, "votes": 3}
    data = json.dumps({"leaderboard": {"entries": [entry(1, 'lone ] bracket "quoted"'), entry(2, "[[["), entry(None, "unranked")]}}, separators=(",", ":"))
    pages = [
        (1, page("x", data)), (2, page(data[:40], data[40:])), (3, page("no board here")), (4, None), (5, page('{"leaderboard":{"entries":[{"rank":1')), (6, '<script>push([1,"never closed</script>'), (7, page('{"leaderboard":{"entries":{}}}')),
    ]
    df = spark.createDataFrame(pages, "page_id long, html string")
    got = sorted((r["page_id"], r["rank"], r["model"], r["score"]) for r in landed.boards(df).collect())
    assert got == [(k, *x) for k in (1, 2) for x in ((1, 'lone ] bracket "quoted"', 1.3), (2, "[[[", 1.3))]
    assert {r["page_id"]: r["fault"] for r in landed.board_faults(df).collect()} == {3: "no_board", 4: "no_board", 5: "broken_entries", 6: "broken_script", 7: "broken_entries"}


def test_an_entry_without_a_date_is_as_new_as_the_fetch(spark):
    rows = [(0, "a", "u/a", "text", None, None, None, None), (1, "b", "u/b", "text", None, None, "2025-01-01", None), (2, "c", "u/c", "text", None, None, None, "2026-02-02")]
    df = spark.createDataFrame(rows, "position int, title string, link string, content string, summary string, description string, published string, updated string")
    got = {r["external_id"]: str(r["published_at"])[:10] for r in landed.rss(df, "s", "2026-01-01", fetched="2026-03-03").collect()}
    assert got == {"u/a": "2026-03-03", "u/c": "2026-02-02"}
    assert landed.rss(df, "s", "2026-01-01").filter("external_id = 'u/a' and published_at > timestamp'2026-03-03'").count() == 1


def test_a_failed_check_of_coherence_caps_the_confidence(spark):
    checks = {
        1: {"headline_matches_body": True, "single_subject": True, "unrelated_sources": []}, 2: {"headline_matches_body": False}, 3: {"single_subject": False}, 4: {"unrelated_sources": ["S2"]}, 5: None, 6: {"headline_matches_body": None}, 7: "no object", 8: {"unrelated_sources": [{"id": 1}]},
    }
    body = lambda c: json.dumps({"fact_claims": [{"claim": "c", "verdict": "supported"}], "style_violations": [], "sensitivity_flags": [], "coherence_check": c})
    df = spark.createDataFrame([*((k, body(c)) for k, c in checks.items()), (9, json.dumps({"fact_claims": []}))], "id int, reply string")
    read = replies.read(df, "review")
    got = {r["id"]: (r["ok"], round(r["c"], 6)) for r in read.select("id", replies.coherent(F.col("value")).alias("ok"), replies.confidence(F.col("value")).alias("c")).collect()}
    assert got == {k: (k not in (2, 3, 4, 8), 0.4 if k in (2, 3, 4, 8) else 1.0) for k in range(1, 10)}
