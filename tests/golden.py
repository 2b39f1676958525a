"""Six hand-made requests with known reports."""

from ticktally.operators.source import SCHEMA, Source

MS = 1_000_000


def _timer(hits, ms, tags, u=0, s=0):
    return (hits, ms * MS, u * MS, s * MS, tags)


G, S, M, ONLY = [("group", "db"), ("op", "get")], [("group", "db"), ("op", "set")], [("group", "mc")], [("op", "get")]
ROWS = [
    (1, "h1", "a.php", "s1", "http", 200, 100, 1000, 10, [("app", "x")], [_timer(1, 4, G, 1), _timer(2, 6, S)]),
    (2, "h1", "a.php", "s1", "http", 200, 200, 1000, 20, [("app", "x"), ("app", "y")], [_timer(1, 5, G), _timer(1, 7, G)]),
    (3, "h2", "b.php", "", "https", 500, 300, 2000, 1500, [("app", "y")], [_timer(1, 3, M)]),
    (4, "h2", "b.php", "s2", "https", 0, 0, 0, 0, [], []),
    (5, "h1", "b.php", "s1", "http", 200, 50, 500, 30, [("app", "x")], [_timer(4, 8, [("group", "db"), ("group", "mc"), ("op", "get")]), _timer(1, 2, ONLY)]),
    (6, "h3", "a.php", "s1", "http", 404, 10, 100, 999, [("app", "")], [_timer(3, 10, S, 2, 1)]),
]


def nested(spark) -> Source:
    from datetime import datetime, timezone

    at = datetime(2030, 1, 1, 0, 0, 30, tzinfo=timezone.utc)
    return Source(spark.createDataFrame([(i, at, h, sv, sc, sm, str(st), tr, m, rt * MS, 0, 0, tags, timers) for i, h, sc, sv, sm, st, tr, m, rt, tags, timers in ROWS], SCHEMA))


def flat(spark) -> Source:
    from pyspark.sql import functions as F

    n = nested(spark).requests
    t = n.select("request_id", F.explode("timers").alias("t")).select("request_id", "t.*")
    return Source(n.drop("timers"), t)
