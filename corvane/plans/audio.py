"""What one row of an audio manifest becomes: its samples, their rate, and the events within them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars, waveform
from ..operators import intervals


@dataclass
class AudioSpec:
    """Where a manifest's audio lies and how it is given out.

    root and path lead to the original; rates names the columns of resampled copies by rate, and with
    checked only those that exist count. A copy that cannot be read or is shorter than a second gives way to
    the original. folder is put in front of original paths that lack it; replace maps a rate to the
    folder that takes the place of another one (old, {rate: new}). start and end name the columns of a window. Events
    of the selection table that begin after the audio are dropped. label names its label column.
    """

    path: str
    root: str = ""
    sample_rate: int | None = None
    rates: dict[int, str] = field(default_factory=dict)
    checked: bool = True
    folder: str | None = None
    replace: tuple[str, dict[int, str]] | None = None
    start: str | None = None
    end: str | None = None
    method: str = "average"
    selection_table: str | None = None
    label: str = "Label"
    labels: Sequence[str] = ()

    def available_rates(self, columns: Sequence[str]) -> list[int]:
        return scalars.available_rates(list(columns), self.rates, self.checked)


def samples(df: DataFrame, spec: AudioSpec) -> DataFrame:
    """Rows with audio (one channel), sample_rate and error; with a selection table also events, and with labels the interval set."""
    original = F.col(spec.path)
    if spec.folder:
        original = scalars.with_folder(original, spec.folder)
    first = original
    if spec.replace and spec.sample_rate in spec.replace[1]:
        first = scalars.replace_once(original, spec.replace[0], spec.replace[1][spec.sample_rate])
    own = spec.rates.get(spec.sample_rate) if spec.sample_rate is not None else None
    if own in df.columns:
        first = F.coalesce(F.nullif(F.trim(own), F.lit("")), first)
    rows = df.withColumns({"_first": first, "_original": original})
    rows = waveform.read_audio(rows, "_first", spec.root, spec.start, spec.end, fall_back="_original").drop("_first", "_original")
    rows = waveform.mono(rows, "signal", "audio", spec.method).drop("signal", "channels").withColumn("audio", F.col("audio").cast("array<float>"))
    if spec.sample_rate is not None:
        rows = waveform.resample(rows, "audio", "sample_rate", spec.sample_rate, "audio")
        rows = rows.withColumn("sample_rate", F.when(F.col("audio").isNotNull(), F.lit(spec.sample_rate)))
    if spec.selection_table:
        duration = F.size("audio") / F.col("sample_rate")
        events = intervals.parse_selection_table(F.col(spec.selection_table), spec.label)
        rows = rows.withColumn("events", F.when(F.col("audio").isNotNull(), intervals.clip_to_duration(events, duration)))
        if spec.labels:
            rows = rows.withColumn("intervals", intervals.interval_set(F.col("events"), spec.labels))
    return rows
