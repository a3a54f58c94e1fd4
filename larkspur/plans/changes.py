"""Queries of change feeds and of what is kept up to date by them; each oracle says the same in its own SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import views
from ..registry import query
from ..shared import shared_dir, written
from ..sources import table
from ..streaming import changes

OP = "CASE WHEN event_id % 4 = 0 THEN 'DELETE' WHEN event_id % 4 = 1 THEN 'INSERT' ELSE 'UPDATE' END"


@query("t01_s16_row_changes", f"""
WITH c AS (SELECT user_id, event_id AS seq, {OP} AS op, CASE WHEN event_id % 4 <> 0 THEN event_type || '-' || event_id END AS image FROM events),
b AS (SELECT *, lag(image) OVER (PARTITION BY user_id ORDER BY seq) AS old FROM c)
SELECT user_id::VARCHAR AS id, CASE WHEN image IS NULL THEN 'DELETE' WHEN old IS NULL THEN 'INSERT' ELSE 'UPDATE' END AS event, seq, old, image AS new
FROM b WHERE image IS NOT NULL OR old IS NOT NULL""")
def t01(spark, d):
    """The events of each user as changes of one row, each told twice, through the stream's state, until its input is read."""
    rows = table(spark, d, "events").selectExpr("user_id AS id", f"{OP} AS op", "event_id AS seq", "CAST(event_id AS STRING) AS change_id",
        "CASE WHEN event_id % 4 <> 0 THEN concat(event_type, '-', event_id) END AS image")
    at = f"{shared_dir(spark)}/changes-{uuid.uuid4().hex}"
    rows.unionByName(rows).write.parquet(f"{at}/in")
    feed = spark.readStream.schema(rows.schema).parquet(f"{at}/in")
    with changes.keyed_state(spark):
        applied = changes.row_changes(changes.valid_changes(feed), None)
        run = applied.writeStream.format("parquet").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start(f"{at}/out")
    run.awaitTermination()
    return spark.read.schema(changes.CHANGE).parquet(f"{at}/out")


SHOWN = views.View(["l_suppkey", "l_returnflag"], sums={"quantity": "l_quantity"}, counts={"lines": "l_orderkey"}, means={"mean_quantity": "l_quantity"},
    least={"first_ship": "l_shipdate"}, greatest={"last_ship": "l_shipdate", "most": "l_quantity"})


@query("d21_refreshed_view", """
SELECT l_suppkey, l_returnflag, count(*) AS rows, round(sum(l_quantity), 2) AS quantity, round(avg(l_quantity), 6) AS mean_quantity, count(l_orderkey) AS lines, min(l_shipdate) AS first_ship,
  max(l_shipdate) AS last_ship, max(l_quantity) AS most FROM lineitem WHERE l_orderkey % 7 <> 0 GROUP BY l_suppkey, l_returnflag""")
def d21(spark, d):
    """The view was stored before orders divisible by 5 came and those divisible by 7 went; the oracle reads the whole table."""
    rows, n = table(spark, d, "lineitem"), F.col("l_orderkey")
    stored = written(views.full_refresh(SHOWN, rows.where(n % 5 != 0)))
    now = rows.where(n % 7 != 0)
    fresh = views.incremental_refresh(SHOWN, stored, now, now.where(n % 5 == 0), rows.where((n % 5 != 0) & (n % 7 == 0)))
    return views.shown(SHOWN, fresh).withColumns({"quantity": F.round("quantity", 2), "mean_quantity": F.round("mean_quantity", 6)})
