"""The mel scale: linear below 1000 Hz, logarithmic above."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the scale.
STEP = 200 / 3  # Hz for one mel below the corner
CORNER_HZ = 1000.0
CORNER_MEL = CORNER_HZ / STEP
LOG_STEP = math.log(6.4) / 27


def hz_to_mel(hz: Column) -> Column:
    return F.when(hz >= CORNER_HZ, CORNER_MEL + F.log(hz / CORNER_HZ) / LOG_STEP).otherwise(hz / STEP)


def mel_to_hz(mel: Column) -> Column:
    return F.when(mel >= CORNER_MEL, CORNER_HZ * F.exp(LOG_STEP * (mel - CORNER_MEL))).otherwise(mel * STEP)
