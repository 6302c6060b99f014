"""Model persistence (S7, S9): a fitted ``PipelineModel`` (text stages, TF-IDF
vocabulary, encoders and regressor together) saved to / loaded from a path."""

from __future__ import annotations

from pyspark.ml import PipelineModel


def save_model(model: PipelineModel, path: str) -> str:
    """S7."""
    model.write().overwrite().save(path)
    return path


def load_model(path: str) -> PipelineModel:
    """S9."""
    return PipelineModel.load(path)
