"""Interruptions without a task, by brute force."""

import datetime as dt
import random

from tideline.operators import sessions

T0 = dt.datetime(2024, 1, 1)


def test_untied_interruptions_attach_to_their_users_sessions(spark):
    r = random.Random(9)
    at = lambda s: T0 + dt.timedelta(seconds=s)
    ses = []
    for k in range(60):
        a = r.randrange(200_000)
        ses.append((k, k % 3, k % 7, at(a), at(a + r.choice([0, 60, 3000, 90_000]))))
    ints = []
    for k in range(80):
        a = r.randrange(200_000)
        ints.append((r.choice([0, 1, 2, 9]), r.choice([None, None, 1, 2, 5]), at(a), r.choice([None, at(a + 500), at(a + 40_000)]), r.choice([None, 100, 400])))
    ints.append(ints[0])
    s = spark.createDataFrame(ses, "session_id long, user_id long, task_id long, session_start timestamp, session_end timestamp")
    i = spark.createDataFrame(ints, "user_id long, task_id long, start_time timestamp, end_time timestamp, duration_seconds long")
    for untied in ("none", "same_user"):
        want = {}
        for sid, user, task, a, b in ses:
            met = [x for x in ints if (x[1] == task or (untied == "same_user" and x[1] is None and x[0] == user)) and x[2] < b and (x[3] or x[2]) > a]
            lost = sum(int((min(x[3] or x[2], b) - max(x[2], a)).total_seconds() // 1) for x in met)
            want[sid] = (len(met), sum((x[4] or 0) >= 300 for x in met), lost, max(0, int((b - a).total_seconds()) - lost))
        got = sessions.measured_sessions(s, i, untied, 10_000).collect()
        assert {x.session_id: (x.interruption_count, x.context_switch_count, x.interruption_time_seconds, x.focused_time_seconds) for x in got} == want and len(got) == len(ses)
