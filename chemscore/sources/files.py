"""S2 CSV scan, S3 model save/load, S4 metric sinks."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chemscore.operators.folds import cast_label


def read_csv(spark: SparkSession, path: str, schema: str, label_col: str | None = "p_np") -> DataFrame:
    """Header CSV with an explicit schema (no inference pass over the data);
    malformed rows fail the job.  The label is read as text and cast with P4."""
    df = spark.read.schema(schema).option("header", "true").option("mode", "FAILFAST").csv(path)
    if label_col and label_col in df.columns:
        df = df.withColumn("label", cast_label(F.col(label_col)))
    return df


# Schemas of the three classifier CSV layouts (column names are fixed values)
CSV_SCHEMAS = {
    "bace": "SMILES STRING, LogP DOUBLE, MW DOUBLE, HBD INT, HBA INT, PSA DOUBLE, Charge INT, AroRings INT, "
            "Aromaticity INT, EWG_count INT, AG_count INT, p_np STRING",
    "bbbp": "SMILES STRING, LogP DOUBLE, MW DOUBLE, HBD INT, HBA INT, TPSA DOUBLE, Charge INT, ARings INT, "
            "AroAtoms INT, p_np STRING",
    "clintox": "SMILES STRING, LogP DOUBLE, MW DOUBLE, TPSA DOUBLE, HBD INT, HBA INT, FuncGroups INT, HCount INT, "
               "RCount INT, DOU DOUBLE, RingStrain INT, p_np STRING",
}
FEATURES = {
    "bace": ["LogP", "MW", "HBD", "Charge", "EWG_count", "AG_count"],
    "bbbp": ["LogP", "MW", "HBD", "HBA", "TPSA", "AroAtoms"],
    "clintox": ["LogP", "TPSA", "DOU", "HCount", "HBA", "HBD", "RCount"],
}


def save_model(model: PipelineModel, path: str) -> None:
    """S3: ``joblib.dump`` becomes a PipelineModel directory (overwritten)."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def write_metrics(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Printed scores, ROC points and importances become parquet tables."""
    df.write.mode(mode).parquet(path)


RUN_KEY = ("run", "split", "metric")


def commit_metrics(df: DataFrame, path: str, run: str) -> None:
    """S4 with a run key: metric rows (split, metric and their values) become the
    partitions (run, split, metric) of one table.

    A run replaces only its own partitions, and only those it writes; other
    runs stay.  A retry of the same run writes the same partitions again, so a
    commit that failed half-way is repaired by repeating it."""
    missing = set(RUN_KEY[1:]) - set(df.columns)
    if missing:
        raise ValueError(f"metric rows need the columns {sorted(missing)}")
    (df.withColumn("run", F.lit(run)).repartition(*RUN_KEY).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy(*RUN_KEY).parquet(path))


def read_metrics(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The committed rows of all runs; ``schema`` names every column, the run key too."""
    return spark.read.schema(schema).parquet(path)
