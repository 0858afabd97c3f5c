"""Scoring by an ONNX model, in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TYPES = {"tensor(float)": np.float32, "tensor(double)": np.float64, "tensor(int64)": np.int64, "tensor(int32)": np.int32}


def score_onnx(rows: DataFrame, model: bytes, inputs: dict[str, tuple[str, tuple[int, ...]]], *keep: str, output: str | None = None, chunk: int = 256) -> DataFrame:
    """``keep`` columns and ``scores array<double>``: the model's output (the first one by default) for each row, flattened.

    ``inputs``: for each of the model's inputs the column that has it (a flat array without nulls) and its shape without the batch. A row whose
    array is null or of another length has null scores. ``model`` is the file's content, which is sent to each executor once; rows
    go through it ``chunk`` at a time.
    """
    shared = rows.sparkSession.sparkContext.broadcast(model)
    names = list(inputs)
    fits = F.lit(True)
    for column, shape in inputs.values():
        fits &= F.coalesce(F.size(column) == int(np.prod(shape)), F.lit(False))
    arrays = [F.when(fits, F.col(column)).alias(f"in{i}") for i, (column, _) in enumerate(inputs.values())]
    source = rows.select(*(F.col(c).alias(f"keep{i}") for i, c in enumerate(keep)), *arrays)
    kept = source.schema[: len(keep)]
    schema = ", ".join([*(f"keep{i} {f.dataType.simpleString()}" for i, f in enumerate(kept)), "scores array<double>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import onnxruntime

        options = onnxruntime.SessionOptions()
        options.intra_op_num_threads = options.inter_op_num_threads = 1  # tasks are what runs side by side
        session = onnxruntime.InferenceSession(shared.value, options, providers=["CPUExecutionProvider"])
        types = {x.name: _TYPES[x.type] for x in session.get_inputs()}
        wanted = [output or session.get_outputs()[0].name]
        for batch in batches:
            for at in range(0, batch.num_rows, chunk):
                part = batch.slice(at, chunk)
                columns = part.columns[len(keep) :]
                good = np.flatnonzero(columns[0].is_valid().to_numpy(zero_copy_only=False))
                scores = [None] * part.num_rows
                if len(good):
                    feed = {n: c.drop_null().flatten().to_numpy(zero_copy_only=False).astype(types[n]).reshape(len(good), *inputs[n][1]) for n, c in zip(names, columns, strict=True)}
                    found = session.run(wanted, feed)[0].reshape(len(good), -1).astype(np.float64)
                    for i, row in zip(good.tolist(), found.tolist(), strict=True):
                        scores[i] = row
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(scores, pa.list_(pa.float64()))], names=[*(f"keep{i}" for i in range(len(keep))), "scores"])

    return source.mapInArrow(run, schema).toDF(*keep, "scores")
