"""Text functions: names, descriptions, cleaning, truncation, paths and URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def trimmed(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def humanize(path: Column) -> Column:
    """Words from a file name: extension and digits dropped, camel case and separators split, ASCII lower case; "sound" if nothing is left."""
    name = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?s)\.[^.]*$", "")
    name = F.regexp_replace(F.translate(name, "_-", "  "), "(?<=[a-z])(?=[A-Z])", " ")
    name = F.translate(F.regexp_replace(name, "[0-9]", ""), _UPPER, _LOWER)
    name = trimmed(F.regexp_replace(name, r"(?U)\s+", " "))
    return F.when(name == "", F.lit("sound")).otherwise(name)


def describe_tags(tags: Column) -> Column:
    """The first three tags as a sentence."""
    text = F.concat(F.array_join(F.slice(tags, 1, 3), ", "), F.lit("."))
    return F.concat(F.upper(F.left(text, F.lit(1))), F.substring(text, 2, 1 << 30))


def describe_name(path: Column, short: Column | None = None) -> Column:
    """The description of a file that no tag describes; short: true for sounds too short to be tagged."""
    plain = F.concat(humanize(path), F.lit("."))
    return plain if short is None else F.when(short, F.concat(humanize(path), F.lit(" (short sound effect)."))).otherwise(plain)


def short_sound(duration: Column, gate: float = 0.35) -> Column:
    """Whether a sound is too short for the tagger; one of unknown length (null or 0) is not."""
    return F.coalesce((duration > 0) & (duration < gate), F.lit(False))


def clean_tags(tags: Column) -> Column:
    return F.filter(F.transform(tags, trimmed), lambda t: t.isNotNull() & (t != ""))


def truncated(text: Column, n: int) -> Column:
    """At most n characters, with an ellipsis where some were cut off."""
    return F.when(F.char_length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit("…"))).otherwise(text)


def confidence(score: Column) -> Column:
    return F.round(score, 3)


def path_order(path: Column) -> Column:
    """Sort key that orders paths component by component."""
    return F.split(path, "/")


def sidecar_path(path: Column, suffix: str) -> Column:
    return F.concat(path, F.lit(suffix))


def data_url(mime: Column, content: Column) -> Column:
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.regexp_replace(F.base64(content), r"[\r\n]", ""))


def chat_url(base: Column) -> Column:
    return F.concat(F.rtrim(base, F.lit("/")), F.lit("/chat/completions"))


def missing_binary(message: Column) -> Column:
    """Whether an error says that an external program is not installed."""
    return message.rlike("No such file|not found|is it installed")


def last_lines(text: Column, n: int = 5) -> Column:
    lines = F.split(F.regexp_replace(text, r"\n$", ""), "\n")
    return F.array_join(F.when(F.size(lines) > n, F.slice(lines, -n, n)).otherwise(lines), "\n")
