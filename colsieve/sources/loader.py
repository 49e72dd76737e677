"""A labelled matrix from two delimited files, and what can be said of its targets.

Lines are read as text and split: a header of tens of thousands of columns never becomes a schema.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MISSING = ("", "NA", "NaN", "nan", "null")
NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
#: Numbers with more distinct values than this are a regression target.
MOST_CLASSES = 20


def read_matrix(spark: SparkSession, path: str, sep: str = ",", transposed: bool = False) -> DataFrame:
    """``(sample, feature, value)`` with names, from a file whose first column names its rows; ``transposed``: rows are features."""
    lines = spark.read.text(path).where(F.length("value") > 0)
    head = lines.first()
    if head is None:
        raise ValueError(f"{path} is empty")
    header = head["value"].split(sep)
    names = spark.createDataFrame([(i, h.strip('"')) for i, h in enumerate(header[1:])], "pos int, column string")
    cells = lines.where(F.col("value") != head["value"]).select(F.split("value", f"\\Q{sep}\\E", -1).alias("v"))
    rows = cells.select(F.regexp_replace(F.element_at("v", 1), '^"|"$', "").alias("row"), F.posexplode(F.slice("v", 2, len(header) - 1)).alias("pos", "text"))
    number = F.when(~F.trim("text").isin(*MISSING), F.expr("try_cast(trim(text) AS DOUBLE)"))
    out = rows.join(F.broadcast(names), "pos").select("row", "column", F.when(~F.isnan(number), number).alias("value"))
    sample, feature = ("column", "row") if transposed else ("row", "column")
    return out.select(F.col(sample).alias("sample"), F.col(feature).alias("feature"), "value")


def read_series_matrix(spark: SparkSession, path: str, prefix: str, sep: str = "\t") -> DataFrame:
    """Sample fields from a gzipped text: lines that start with ``prefix`` hold ``key: value`` for each sample in turn.

    Returns ``(pos, key, value)``; pivot by the keys that matter.
    """
    lines = spark.read.text(path).where(F.col("value").startswith(prefix))
    cells = lines.select(F.posexplode(F.slice(F.split("value", sep), 2, 1 << 30)).alias("pos", "cell")).withColumn("cell", F.regexp_replace("cell", '^"|"$', ""))
    pair = F.split("cell", ": ", 2)
    value = F.element_at(pair, 2)
    return cells.where(F.size(pair) == 2).select("pos", F.element_at(pair, 1).alias("key"), F.when(~value.isin(*MISSING), value).alias("value"))


def clean(long: DataFrame, samples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``long`` without samples of nulls only, then features of nulls only, then features of one value; and the three counts.

    ``samples`` lists all samples, so that one without any value is counted too.
    """
    full = long.groupBy("sample").agg(F.count("value").alias("_c")).where("_c > 0").select("sample")
    empty = samples.select("sample").join(full, "sample", "left_anti").agg(F.count(F.lit(1)).alias("samples_removed_all_nan"))
    kept = long.join(full, "sample", "left_semi")
    kinds = kept.groupBy("feature").agg(F.count("value").alias("_c"), (F.min("value") < F.max("value")).alias("_many"))
    counts = kinds.agg(F.count_if(F.col("_c") == 0).alias("features_removed_all_nan"), F.count_if((F.col("_c") > 0) & ~F.col("_many")).alias("features_removed_single_value"))
    good = kinds.where(F.coalesce("_many", F.lit(False))).select("feature")
    return kept.join(good, "feature", "left_semi"), empty.crossJoin(counts)


def align(samples: DataFrame, metadata: DataFrame, sample_id: str) -> tuple[DataFrame, DataFrame]:
    """Samples with metadata, and how many of either side have no partner: ``matched, only_features, only_metadata``."""
    ids = metadata.select(F.col(sample_id).cast("string").alias("sample"))
    both = samples.join(ids, "sample", "left_semi")
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    report = n(both, "matched").crossJoin(n(samples.join(ids, "sample", "left_anti"), "only_features")).crossJoin(n(ids.join(samples, "sample", "left_anti"), "only_metadata"))
    return both, report


def flat_features(long: DataFrame, least: float = 1e-2, feature: str = "feature") -> DataFrame:
    """``(feature, spread, flat)``: (max - min) / max |value|, flat under ``least``."""
    spread = (F.max("value") - F.min("value")) / F.nullif(F.max(F.abs("value")), F.lit(0.0))
    return long.groupBy(feature).agg(F.coalesce(spread, F.lit(0.0)).alias("spread")).withColumn("flat", F.col("spread") < least)


@F.pandas_udf(T.StringType())
def _three(values):  # noqa: ANN001, ANN202
    """Three decimals of the binary number, as Python writes it; a report has a row for each column."""
    return values.map(lambda v: None if v != v else f"{v:.3f}")


def _text(value: Column) -> Column:
    return F.when(value.isNotNull(), _three(value.cast("double")))


def target_report(metadata: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """A row for each column: what kind of target it is, and statistics as text.

    Text, and numbers of up to 20 values, are classes: binary with two, else multiclass (a single value counts as
    that too). Other numbers are a regression target. A column of nulls is unknown. One aggregation for all columns.
    """
    columns = columns or metadata.columns
    kinds = {f.name: isinstance(f.dataType, NUMBERS) for f in metadata.schema.fields}
    pairs = F.array(*[F.struct(F.lit(c).alias("target_name"), F.lit(kinds[c]).alias("number"), F.col(c).cast("string").alias("v"), (F.col(c).cast("double") if kinds[c] else F.lit(None).cast("double")).alias("x")) for c in columns])
    long = metadata.select(F.explode(pairs).alias("p")).select("p.*").withColumn("v", F.when(F.col("x").isNull() | ~F.isnan("x"), F.col("v"))).withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    stats = long.groupBy("target_name", "number").agg(
        F.count("v").alias("n_samples"), (F.count(F.lit(1)) - F.count("v")).alias("n_missing"), F.countDistinct("v").alias("_k"), F.avg("x").alias("_mean"), F.stddev_samp("x").alias("_std"), F.min("x").alias("_min"), F.max("x").alias("_max"),
        F.percentile("x", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("_q"),
    )
    few = ~F.col("number") | (F.col("_k") <= MOST_CLASSES)
    kind = F.when(F.col("_k") == 0, "unknown").when(few & (F.col("_k") == 2), "binary").when(few, "multiclass").otherwise("regression")
    typed = stats.withColumn("type", kind)
    # text columns may have any number of classes, so balance is counted apart, and names listed for few classes alone
    counts = long.where("v IS NOT NULL").groupBy("target_name", "v", "x").agg(F.count(F.lit(1)).alias("c"))
    sizes = counts.groupBy("target_name").agg((F.min("c") / F.max("c")).alias("_balance"))
    named = counts.join(F.broadcast(typed.where((F.col("_k") <= MOST_CLASSES) & F.col("type").isin("binary", "multiclass")).select("target_name")), "target_name", "left_semi")
    listed = named.groupBy("target_name").agg(F.array_sort(F.collect_list(F.struct("x", "v", "c"))).alias("_l"))
    listed = listed.select("target_name", F.array_join(F.transform("_l", lambda e: F.concat(e["v"], F.lit(": "), e["c"].cast("string"))), ", ").alias("class_counts"))
    out = typed.join(sizes, "target_name", "left").join(listed, "target_name", "left")
    classes, numbers = F.col("type").isin("binary", "multiclass"), F.col("type") == "regression"
    return out.select(
        "target_name", "type", "n_samples", "n_missing", F.when(classes, F.col("_k")).alias("n_classes"), "class_counts", F.when(classes, _text(F.col("_balance"))).alias("balance_ratio"),
        *[F.when(numbers, _text(v)).alias(n) for n, v in (("mean", F.col("_mean")), ("std", F.col("_std")), ("min", F.col("_min")), ("q1", F.col("_q")[0]), ("median", F.col("_q")[1]), ("q3", F.col("_q")[2]), ("max", F.col("_max")))],
    )


@dataclass
class DataLoader:
    """A matrix and its metadata from a configuration: ``paths{features, metadata}, sample_id_column, target_column``,
    and optionally ``separator, transpose_features``; or the name of a YAML or JSON file with them."""

    spark: SparkSession
    config: dict | str
    report: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        if isinstance(self.config, str):
            from colsieve.operators.runner import load_config

            self.config = load_config(self.config)
        c = self.config
        sep = c.get("separator", ",")
        long = read_matrix(self.spark, c["paths"]["features"], sep, c.get("transpose_features", False))
        meta = self.spark.read.csv(c["paths"]["metadata"], header=True, sep=sep, inferSchema=True, nanValue="NaN", nullValue="NA")
        sid = c["sample_id_column"]
        samples = long.select("sample").distinct()
        both, matched = align(samples, meta, sid)
        kept, counts = clean(long.join(both, "sample", "left_semi"), both)
        self.report = {**matched.first().asDict(), **counts.first().asDict(), "target_column": c["target_column"]}
        self.metadata = meta.withColumn("sample", F.col(sid).cast("string")).join(kept.select("sample").distinct(), "sample", "left_semi")
        self._long = kept
        self._names = [r["feature"] for r in kept.select("feature").distinct().orderBy("feature").collect()]
        self.report |= {"final_samples": kept.select("sample").distinct().count(), "final_features": len(self._names), "missing_values_remaining": kept.where("value IS NULL").count()}
        self.set_target(c["target_column"])

    @property
    def feature_names(self) -> list[str]:
        return list(self._names)

    @property
    def X(self) -> DataFrame:  # noqa: N802
        """``sample, features`` in the order of ``feature_names``; a missing value is null."""
        rows = self._long.groupBy("sample").agg(F.array_sort(F.collect_list(F.struct("feature", "value"))).alias("_v"))
        return rows.select("sample", F.transform("_v", lambda e: e["value"]).alias("features"))

    @property
    def y(self) -> DataFrame:
        return self.get_target(self.target_column)

    @property
    def matrix(self) -> DataFrame:
        """The wide layout with an ordinal sample id."""
        from pyspark.sql import Window as W

        rows = self.X.join(self.y, "sample")
        return rows.select((F.row_number().over(W.orderBy("sample")) - 1).cast("long").alias("sample_id"), "features", "label")

    def set_target(self, name: str) -> None:
        if name not in self.metadata.columns:
            raise ValueError(f"no target '{name}'. Available: {', '.join(self.get_available_targets())}")
        self.target_column = name

    def get_target(self, name: str) -> DataFrame:
        if name not in self.metadata.columns:
            raise ValueError(f"no target '{name}'. Available: {', '.join(self.get_available_targets())}")
        return self.metadata.select("sample", F.col(name).alias("label"))

    def get_available_targets(self) -> list[str]:
        return [c for c in self.metadata.columns if c != "sample"]

    def analyze_targets(self) -> DataFrame:
        return target_report(self.metadata, self.get_available_targets())

    def __len__(self) -> int:
        return self.report["final_samples"]

    def __getitem__(self, at):  # noqa: ANN001, ANN204
        """Rows of the matrix by an integer, a slice or a list of integers, in the order of sample names."""
        n = len(self)
        if isinstance(at, bool) or not isinstance(at, (int, slice, list)):
            raise TypeError(f"an index is an integer, a slice or a list, not {type(at).__name__}")
        if isinstance(at, int):
            if not -n <= at < n:
                raise IndexError(at)
            return self.matrix.where(F.col("sample_id") == at % n)
        places = list(range(*at.indices(n))) if isinstance(at, slice) else [i % n for i in at]
        return self.matrix.where(F.col("sample_id").isin(places))
