"""Streams: each new file once with errors kept apart, and training statistics as keyed state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def stream_folder(spark: SparkSession, root: str, job: Callable[[str], str], out: str, checkpoint: str) -> StreamingQuery:
    """Run job(text) on every new text file below root once; rows (path, result, error) go to out. One bad file doesn't stop the run."""
    files = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).load(root).select(F.col("_metadata.file_path").alias("path"), "value")

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = []
            for path, text in zip(pdf["path"], pdf["value"], strict=True):
                try:
                    rows.append((path, job(text), None))
                except Exception as e:  # kept with its file, as the contract of the job asks
                    rows.append((path, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "result", "error"])

    done = files.mapInPandas(run, "path string, result string, error string")
    return done.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_loss_weights(log: DataFrame, alpha: float = 0.2, strength: float = 1.0) -> DataFrame:
    """(sample, difficulty, weight) after each update of a stream log(sample, batch, ratio, lam), ratio being the loss over its batch mean: smoothed from 1 in order of batch."""

    def update(key, pdfs: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        d = state.get[0] if state.exists else 1.0
        for r in pd.concat(list(pdfs)).sort_values(["batch", "ratio"]).itertuples():
            d += alpha * r.lam * (r.ratio - d)
        state.update((d,))
        yield pd.DataFrame({"sample": [key[0]], "difficulty": [d], "weight": [1 + strength * max(d - 1, 0.0)]})

    kind = log.schema["sample"].dataType.simpleString()
    return log.groupBy("sample").applyInPandasWithState(update, f"sample {kind}, difficulty double, weight double", "d double", "update", "NoTimeout")


def stream_early_stopping(log: DataFrame, patience: int, min_delta: float) -> DataFrame:
    """(run, best_epoch, best_loss, stop_epoch) after each update of a stream log(run, epoch, loss)."""

    def update(key, pdfs: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        best, best_epoch, bad, stop = state.get if state.exists else (float("inf"), -1, 0, -1)
        for r in pd.concat(list(pdfs)).sort_values("epoch").itertuples():
            if stop >= 0:
                break
            if best - r.loss > min_delta:
                best, best_epoch, bad = float(r.loss), int(r.epoch), 0
            else:
                bad += 1
                if bad >= patience:
                    stop = int(r.epoch)
        state.update((best, best_epoch, bad, stop))
        yield pd.DataFrame({"run": [key[0]], "best_epoch": [best_epoch], "best_loss": [best], "stop_epoch": pd.array([stop if stop >= 0 else None], "Int64")})

    kind = log.schema["run"].dataType.simpleString()
    return log.groupBy("run").applyInPandasWithState(update, f"run {kind}, best_epoch long, best_loss double, stop_epoch long", "best double, best_epoch long, bad long, stop long", "update", "NoTimeout")
