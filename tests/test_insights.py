"""Insights name what they are about."""

import datetime as dt

from tideline.operators import insights

MON = dt.datetime(2024, 1, 1, 9)


def test_subjects_and_levels(spark):
    day = lambda d, h=0: MON + dt.timedelta(days=d, hours=h)
    rows = [(1, "home", 5, "forgotten", day(0)), (1, "home", 5, "forgotten", day(7)), (1, "shop", 6, "forgotten", day(1, 4)), (1, "work", 7, "completed", day(2)), (1, "work", 7, "completed", day(3, 1)), (1, "work", 7, "completed", day(4, 2)), (1, "work", 7, "completed", day(1, 3)), (2, "a", None, "completed", day(0))]
    t = spark.createDataFrame(rows, "user_id long, category string, location_id long, status string, created_at timestamp")
    got = {r.user_id: r for r in insights.forgetting_timing(t).collect()}
    assert got[1].subjects == {"weekdays": ["Monday"], "hours": ["9", "13"]} and got[1].risk == "MEDIUM"
    assert got[2].subjects == {"weekdays": [], "hours": []} and got[2].risk == "LOW"
    got = {r.user_id: r for r in insights.context_forgetting(t).collect()}
    assert got[1].subjects == {"categories": ["home", "shop"], "locations": ["5", "6"]} and got[1].risk == "HIGH"
    story = {r.user_id: r for r in insights.story(insights.all_insights(insights.forgetting_timing(t), insights.context_forgetting(t))).collect()}
    assert story[1].findings == "forgetting_timing: medium: 9, 13, Monday; context_forgetting: high: home, shop, 5, 6" and story[1].risks == "context_forgetting: home, shop, 5, 6"
    assert story[2].findings == "forgetting_timing: low; context_forgetting: low" and story[2].risks == ""


def test_late_categories_and_the_worst_one(spark):
    at = lambda late: (MON, MON + dt.timedelta(hours=1 if late else -1))
    rows = [(1, "home", 1, "completed", *at(True)), (1, "home", 1, "completed", *at(True)), *[(1, "work", 3, "completed", *at(False))] * 4]
    t = spark.createDataFrame(rows, "user_id long, category string, priority int, status string, deadline_at timestamp, completed_at timestamp")
    (r,) = insights.recurring_delay(t).collect()
    assert r.subjects == {"categories": ["home"], "priorities": ["1"]} and r.risk == "MEDIUM"
