"""Frame streams: the automatic shutter as a stateful operator (T1), with a batch twin, and the recognition queue."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple, dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Motion above MOVING is a movement, below REST a rest, below STILL a still frame; NEED still frames fire.
MOVING, REST, STILL, NEED = 7.0, 3.0, 2.2, 9
SHARP, DECAY, BRIGHT, PAUSE_MS = 0.72, 0.995, 35.0, 900

SHOTS = "camera string, ts timestamp, sharp double"
STATE = "still int, moving int, armed boolean, last_ms bigint, best double, seen timestamp"
FRAMES = ["camera", "ts", "motion", "sharp", "mean"]


@dataclass
class Shutter:
    """State of one camera."""

    still: int = 0
    moving: int = 0
    armed: bool = True
    last_ms: int = 0
    best: float = 0.0

    def step(self, ms: int, motion: float, sharp: float, mean: float) -> bool:
        """Whether this frame fires; a frame without sharpness counts with 0."""
        self.best = max(self.best * DECAY, sharp)
        if not self.armed:
            if motion > MOVING:
                self.moving += 1
            elif self.moving >= 2 and motion < REST and ms - self.last_ms > PAUSE_MS:
                self.armed = True
            return False
        self.still = self.still + 1 if motion < STILL else 0
        if self.still >= NEED and sharp >= self.best * SHARP and mean > BRIGHT:
            self.armed, self.moving, self.still, self.last_ms = False, 0, 0, ms
            return True
        return False


def _fire(frames: pd.DataFrame, shutter: Shutter) -> pd.DataFrame:
    """The frames, in order, at which the shutter fires."""
    ms = frames["ts"].astype("datetime64[us]").astype("int64") // 1000
    hit = [shutter.step(*row) for row in zip(ms, frames["motion"], frames["sharp"].fillna(0.0), frames["mean"])]
    return frames.loc[hit, ["camera", "ts", "sharp"]]


def _run(key: tuple, pdfs: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    *old, seen = state.get if state.exists else (*astuple(Shutter()), None)
    shutter = Shutter(*old)
    frames = pd.concat(list(pdfs)).drop_duplicates(FRAMES).sort_values(["ts", "motion", "mean", "sharp"], kind="stable")
    if seen is not None:
        frames = frames[frames["ts"] > pd.Timestamp(seen)]
    yield _fire(frames, shutter)
    if len(frames):
        seen = frames["ts"].iloc[-1].to_pydatetime()
    state.update((shutter.still, shutter.moving, shutter.armed, int(shutter.last_ms), float(shutter.best), seen))


def _frames(frames: DataFrame) -> DataFrame:
    return frames.select(*FRAMES).where("camera is not null and ts is not null and motion is not null and mean is not null")


def shots(frames: DataFrame) -> DataFrame:
    """T1 over a stream of frames: one row per shot. Within a trigger frames are taken by time and repeated ones count once; frames not later than those of an earlier trigger are left out, so that frames repeated across triggers count once too.

    The state of a camera is six values; one trigger brings a bounded slice of each camera.
    """
    return _frames(frames).groupBy("camera").applyInPandasWithState(_run, SHOTS, STATE, "append", "NoTimeout")


def _in_order(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    shutters: dict[str, Shutter] = {}
    for batch in batches:
        for camera, frames in batch.groupby("camera", sort=False):
            # cameras come one after the other, so that only the last one's state is needed again
            if camera not in shutters:
                shutters = {camera: Shutter()}
            yield _fire(frames, shutters[camera])


def shots_batch(frames: DataFrame) -> DataFrame:
    """T1 over a table: the same shots as one trigger over all of it; repeated frames count once.

    The machine is sequential by nature and its brightest sharpness never quite forgets, so nothing but a camera's whole past gives
    its state. A camera's frames therefore stream through one task in sorted batches, of which only the state is kept: memory is that
    of one batch, and a camera's time that of a single pass.
    """
    ordered = _frames(frames).distinct().repartition("camera").sortWithinPartitions("camera", "ts", "motion", "mean", "sharp")
    return ordered.mapInPandas(_in_order, SHOTS)


def work_queue(spark: SparkSession, source: str, schema: str, done_path: str, checkpoint: str, process) -> None:
    """Take what is new in ``source``, leave out what is done, store results; a page that fails is stored as empty, so it does not come again.

    ``process`` maps a DataFrame of (project, pos, ...) to (project, pos, text).
    """

    def batch(todo: DataFrame, _: int) -> None:
        own = todo.sparkSession
        try:
            done = own.read.parquet(done_path).select("project", "pos")
            todo = todo.join(done, ["project", "pos"], "left_anti")
        except Exception as e:  # nothing is done yet
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        todo = todo.dropDuplicates(["project", "pos"])
        todo.select("project", "pos").join(process(todo), ["project", "pos"], "left").withColumn("text", F.coalesce("text", F.lit(""))).write.mode("append").parquet(done_path)

    stream = spark.readStream.schema(schema).parquet(source)
    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
