"""Login pages whose script has a longer suffix than the rule's, where few pages hold `php`."""

import duckdb
import pandas as pd

from aerolake.llm import urls

from . import support


def test_every_match_is_tried(spark):
    rows = [(1, "http://q.org/wp-login.php5"), (2, "http://q.org/wp-login.phps?x"), (3, "http://q.org/wp-login.php"), (4, "http://q.org/login/wp"), (5, "http://q.org/wp/login")]
    df = urls.judge(spark.createDataFrame(rows, "page_id long, url string"))
    connection = duckdb.connect()
    connection.register("pages", pd.DataFrame(rows, columns=["page_id", "url"]))
    found = connection.execute(urls.oracle())
    assert support.rows(df, *[c[0] for c in found.description]) == sorted(found.fetchall(), key=str)
    assert {r.page_id for r in df.where("verdict = 'block'").collect()} == {1, 2, 3}
