"""Scoring with a pretrained model supplied by the caller, in Arrow batches."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from lexigrow.functions.numeric import softmax_positive


def linear_model_loader(weights, bias=(0.0, 0.0)):
    """A loader for a two-class linear model; ``weights`` has one row per class.

    Any function returning ``predict(batch) -> logits`` can stand in its place: it is called
    once per Python worker, so a large model is loaded there and not per batch.
    """
    matrix = np.asarray(weights, dtype=float)
    shift = np.asarray(bias, dtype=float)

    def load():
        def predict(batch: np.ndarray) -> np.ndarray:
            return batch @ matrix.T + shift

        return predict

    return load


def batch_scores(
    df: DataFrame,
    features: str,
    width: int,
    loader,
    keep: list[str],
    name: str = "BERT",
    batch_size: int = 16,
) -> DataFrame:
    """The ``keep`` columns and ``y_pred_prob_<name>``, the softmax of the model's logits."""
    score = predict_batch_udf(
        loader,
        return_type=ArrayType(DoubleType()),
        batch_size=batch_size,
        input_tensor_shapes=[[width]],
    )
    logits = df.select(*keep, score(F.col(features)).alias("__logits"))
    positive = softmax_positive(F.col("__logits")[0], F.col("__logits")[1])
    return logits.select(*keep, positive.alias(f"y_pred_prob_{name}"))
