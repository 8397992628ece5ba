from functools import wraps

from rallyforge.operators import vision
from rallyforge.plans import queries

DATA = "/root/testdata/sf0.001"


def test_query_makes_the_whole_search(spark, monkeypatch):
    operator, asked = vision.robust_lines, []

    @wraps(operator)
    def recorded(points, keys, tolerance=2.0, rounds=operator.__defaults__[1]):
        asked.append((tolerance, rounds))
        return operator(points, keys, tolerance, rounds)

    monkeypatch.setattr(vision, "robust_lines", recorded)
    assert queries.robust_lines(spark, DATA).count()
    assert asked == [(2.0, 800)]
