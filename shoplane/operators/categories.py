"""Category codes of any number of values (M5, M18): the dictionary is a table.

``StringIndexer`` brings every distinct label to the driver and keeps them in the
model and in the schema of each transformed frame. Here the distinct (column, value) pairs are
numbered where they are (``ordered_index``), stored beside the model as Parquet,
and joined to the rows; the driver sees one count a column.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasOutputCols
from pyspark.ml.util import (DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader,
                             MLWritable, MLWriter)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplane.operators.ordered import DEFAULT_ROWS_PER_BUCKET, ordered_index
from shoplane.operators.schema import col
from shoplane.operators.selection import measured_bytes
from shoplane.session import scratch_path


class CategoryIndexer(Estimator, HasInputCols, HasOutputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Codes 0..n-1 of each column's non-null values in ascending order of the text; null and unseen values get n, the
    slot that ``OneHotEncoder(dropLast=True)`` leaves out. The output columns' ML attributes say how many codes there are, not which."""

    rowsPerBucket = Param(Params._dummy(), "rowsPerBucket", "values per range bucket", TypeConverters.toInt)
    broadcastBytes = Param(Params._dummy(), "broadcastBytes", "measured size up to which a dictionary is broadcast", TypeConverters.toInt)

    @keyword_only
    def __init__(self, inputCols=None, outputCols=None, rowsPerBucket=DEFAULT_ROWS_PER_BUCKET, broadcastBytes=32 << 20):
        super().__init__()
        self._setDefault(rowsPerBucket=DEFAULT_ROWS_PER_BUCKET, broadcastBytes=32 << 20)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, df: DataFrame) -> "CategoryIndexerModel":
        pairs = F.array(*[F.struct(F.lit(i).alias("column"), col(c).cast("string").alias("value")) for i, c in enumerate(self.getInputCols())])
        values = df.select(F.inline(pairs)).where("value IS NOT NULL").distinct()  # partial: a hot value is one row a task
        return self.fitted(values.checkpoint(eager=True))

    def fitted(self, values: DataFrame) -> "CategoryIndexerModel":
        """The model of the distinct (column, value) pairs, which are read more than once."""
        coded = ordered_index(values, ["value"], ["column"], index_col="code", rows_per_bucket=self.getOrDefault("rowsPerBucket"))
        path = scratch_path(values.sparkSession, "categories")
        coded.select("column", "value", "code").write.parquet(path)
        dictionary = values.sparkSession.read.parquet(path)
        sizes = {r["column"]: r["n"] for r in dictionary.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}
        model = CategoryIndexerModel(inputCols=self.getInputCols(), outputCols=self.getOutputCols(),
                                     sizes=[sizes.get(i, 0) for i in range(len(self.getInputCols()))], broadcastBytes=self.getOrDefault("broadcastBytes"))
        model.dictionary = dictionary
        return model


class CategoryIndexerModel(Model, HasInputCols, HasOutputCols, MLWritable, MLReadable):
    """Joins each column's codes to the rows; ``dictionary`` is the table (column, value, code)."""

    sizes = Param(Params._dummy(), "sizes", "values of each column", TypeConverters.toListInt)
    broadcastBytes = Param(Params._dummy(), "broadcastBytes", "measured size up to which a dictionary is broadcast", TypeConverters.toInt)

    @keyword_only
    def __init__(self, inputCols=None, outputCols=None, sizes=None, broadcastBytes=32 << 20):
        super().__init__()
        self._setDefault(broadcastBytes=32 << 20)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})
        self.dictionary: DataFrame | None = None

    def _transform(self, df: DataFrame) -> DataFrame:
        small = measured_bytes(self.dictionary) <= self.getOrDefault("broadcastBytes")
        out = df
        for i, (c, o, n) in enumerate(zip(self.getInputCols(), self.getOutputCols(), self.getOrDefault("sizes"))):
            codes = self.dictionary.where(F.col("column") == i).select(F.col("value").alias("_category"), F.col("code").alias("_code"))
            out = out.join(F.broadcast(codes) if small else codes, col(c).cast("string") == F.col("_category"), "left")
            attribute = {"ml_attr": {"type": "nominal", "name": o, "num_vals": n + 1}}
            code = F.coalesce(F.col("_code"), F.lit(n)).cast("double")
            out = out.drop(o).withColumn(o, code).withMetadata(o, attribute).drop("_category", "_code")
        return out

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)


class _Writer(MLWriter):
    def __init__(self, model: CategoryIndexerModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        self.model.dictionary.write.parquet(f"{path}/dictionary")


class _Reader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> CategoryIndexerModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = self.cls()
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        model.dictionary = self.sparkSession.read.parquet(f"{path}/dictionary")
        return model


def named_slots(model: CategoryIndexerModel, first_slot: dict[str, int], prefix: dict[str, str]) -> DataFrame:
    """(slot, feature): the place and the name ``prefix_value`` of every category's slot in an assembled vector.
    ``first_slot`` and ``prefix`` are by output column; columns without a first slot are left out."""
    places = [(i, o) for i, o in enumerate(model.getOutputCols()) if o in first_slot]
    if not places:
        return model.dictionary.select(F.col("code").alias("slot"), F.col("value").alias("feature")).limit(0)
    starts = F.create_map(*[F.lit(x).cast("long") for i, o in places for x in (i, first_slot[o])])
    names = F.create_map(*[y for i, o in places for y in (F.lit(i).cast("long"), F.lit(prefix[o]))])
    column = F.col("column").cast("long")
    return model.dictionary.where(F.col("column").isin([i for i, _ in places])).select(
        (F.try_element_at(starts, column) + F.col("code")).alias("slot"), F.concat(F.try_element_at(names, column), F.lit("_"), F.col("value")).alias("feature"))
