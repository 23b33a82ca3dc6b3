"""Custom Spark ML stages where the built-ins differ from the required semantics.

* ``ExactMedianImputer`` — ``pyspark.ml.feature.Imputer(strategy='median')`` uses an
  approximate quantile; this one fits the exact median with the skew-safe distributed
  procedure in :mod:`pertinax.operators.stats`.
* ``PopulationStandardScaler`` — ``StandardScaler`` divides by the *sample* standard
  deviation; the original scaler uses the population one (σ = 0 -> 1).

Both fit with one distributed aggregate; the fitted state (one number per column) is stored
as list params, so pipelines containing them persist with the standard ML writer.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasOutputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class _Values(Params):
    values = Param(Params._dummy(), "values", "fitted value per column (NaN = none)",
                   typeConverter=TypeConverters.toListFloat)
    scales = Param(Params._dummy(), "scales", "fitted scale per column",
                   typeConverter=TypeConverters.toListFloat)


class ExactMedianImputerModel(Model, HasInputCols, HasOutputCols, _Values,
                              DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, inputCols=None, outputCols=None, values=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        out = {}
        for c, o, v in zip(self.getInputCols(), self.getOutputCols(), self.getOrDefault("values")):
            x = F.col(c).cast("double")
            # v != v (NaN): the column had no value at fit time; like a dropped all-missing
            # column it contributes a constant 0
            out[o] = F.coalesce(x, F.lit(0.0 if v != v else v))
        return df.withColumns(out)


class ExactMedianImputer(Estimator, HasInputCols, HasOutputCols,
                         DefaultParamsReadable, DefaultParamsWritable):
    """M4 as a pipeline stage: NULL -> exact median of the fitting data."""

    @keyword_only
    def __init__(self, inputCols=None, outputCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> ExactMedianImputerModel:
        from pertinax.operators.prep import fit_median
        cols = self.getInputCols()
        med = fit_median(df.select(*[F.col(c).cast("double").alias(c) for c in cols]), cols)
        vals = [float("nan") if med[c] is None else float(med[c]) for c in cols]
        return ExactMedianImputerModel(inputCols=cols, outputCols=self.getOutputCols(), values=vals)


class PopulationStandardScalerModel(Model, HasInputCols, HasOutputCols, _Values,
                                    DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, inputCols=None, outputCols=None, values=None, scales=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        out = {}
        for c, o, m, s in zip(self.getInputCols(), self.getOutputCols(),
                              self.getOrDefault("values"), self.getOrDefault("scales")):
            x = F.col(c).cast("double")
            out[o] = x if m != m else (x - F.lit(m)) / F.lit(s)
        return df.withColumns(out)


class PopulationStandardScaler(Estimator, HasInputCols, HasOutputCols,
                               DefaultParamsReadable, DefaultParamsWritable):
    """M7 as a pipeline stage: (x − μ) / σ_pop, σ = 0 -> 1."""

    @keyword_only
    def __init__(self, inputCols=None, outputCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> PopulationStandardScalerModel:
        from pertinax.operators.prep import fit_standardize
        cols = self.getInputCols()
        params = fit_standardize(df, cols)
        means = [float("nan") if params[c][0] is None else float(params[c][0]) for c in cols]
        scales = [float(params[c][1]) for c in cols]
        return PopulationStandardScalerModel(inputCols=cols, outputCols=self.getOutputCols(),
                                             values=means, scales=scales)
