"""Airways are dealt once, by their number, and hold what the view of their waypoints says."""

from aerolake.plans import views

DATA = "/root/testdata/sf0.001"


def test_airways_are_dealt_once_and_hold_the_views_waypoints(spark):
    views.prepare(spark, DATA)
    found = views.airways(spark)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    points = found.selectExpr("ord", "designation", "inline(waypoints)").select("ord", "designation", "seq", "identifier", "lat", "lon")
    wanted = views.view(spark, "waypoints").select("ord", "designation", "seq", "identifier", "lat", "lon")
    assert wanted.count() == points.count() and not wanted.exceptAll(points).count()
