"""Revenue outlook analytics as PySpark DataFrame transforms.

Layers: ``sources`` (raw entities), ``streaming`` (incremental ingest), ``operators`` (clean, gold, serving,
dashboard, forecast, review and profile transforms), ``functions`` (column expressions), ``sinks`` (writers) and
``plans`` (whole refreshes, reports and the query catalog).
"""
