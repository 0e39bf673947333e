"""chemscore: completion scoring and classifier evaluation as Spark jobs.

Sub-packages
------------
functions   Column -> Column expressions (text extraction, rewards, similarity UDF)
operators   DataFrame -> DataFrame operators (joins, rewards, metrics, folds, learning)
sources     readers and writers (JSON records, CSV, model and metric sinks)
plans       fixed dictionaries, derived test views, the query registry
streaming   Structured Streaming versions of the scoring and metric jobs
"""

__all__ = ["functions", "operators", "sources", "plans", "streaming"]
