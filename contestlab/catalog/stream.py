"""The streaming form of the line points, run to completion over the tick table."""

from pyspark.sql import functions as F

from ..session import scratch
from ..streaming.lines import stream_line_points
from .registry import query


@query("stream_line_points", """SELECT user_id, event_type, min_by(value, ts) AS opening, max_by(value, ts) AS closing, count(*) AS ticks FROM events GROUP BY 1, 2""")
def _(spark, sf):
    path = f"{sf}/events.parquet"
    schema = spark.read.parquet(path).schema
    src = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    src = src.withColumn("ts", F.col("ts").cast("timestamp"))
    out = stream_line_points(src, ["user_id", "event_type"], "ts", "value")
    at = scratch(spark, "lines")
    result = f"{at}/result"

    def keep(batch, _):
        batch.write.mode("overwrite").parquet(result)

    run = out.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(result)
