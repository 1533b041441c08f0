"""Facts from external programs, run by the tasks. A missing program gives an error text, never a failed task."""

from __future__ import annotations

import subprocess

from pyspark.sql import Column
from pyspark.sql import functions as F

PROBE = ["ffprobe", "-v", "error", "-print_format", "json", "-show_format", "-show_streams"]
EXIF = ["exiftool", "-j"]


class ProgramError(RuntimeError):
    pass


def run_program(command: list[str], timeout: float) -> bytes:
    """Standard output. ProgramError carries the last five lines of standard error."""
    try:
        done = subprocess.run(command, capture_output=True, timeout=timeout, check=False)
    except FileNotFoundError as e:
        raise ProgramError(f"{command[0]} not found: is it installed?") from e
    except subprocess.TimeoutExpired as e:
        raise ProgramError(f"{command[0]} took over {timeout:g} s") from e
    if done.returncode:
        raise ProgramError(f"{command[0]}: " + "\n".join(done.stderr.decode("utf-8", "replace").splitlines()[-5:]))
    return done.stdout


def frame_times(duration: Column, n: int) -> Column:
    """The middles of n equal parts of a video, in seconds to the millisecond; 0 if the duration is unknown."""
    times = F.transform(F.sequence(F.lit(0), F.lit(max(n, 1) - 1)), lambda i: F.round(duration * (i + 0.5) / max(n, 1), 3))
    return F.when(duration > 0, times).otherwise(F.array(F.lit(0.0)))
