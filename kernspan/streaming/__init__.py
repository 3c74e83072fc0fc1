"""Scoring streams.

Fitted models are constants and scoring keeps no state, so the operators of
``kernspan.operators.score``, ``classify`` and ``ridge`` take a streaming
DataFrame as it is::

    stream = spark.readStream.schema(schema).parquet(path)
    scored = leverage_min(stream, models)
    scored.writeStream.format("parquet").option("checkpointLocation", c).start(out)

Fitting and selection read their table several times and need a batch one.
"""
