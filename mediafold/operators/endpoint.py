"""Enrichment by an OpenAI-compatible chat endpoint: settings, request bodies, retries and replies.

The call itself is a function given by the caller, so tests replay answers and no network is needed. The stage is not free of
effects: Spark may run a task again, so a service that counts calls should know rows by their content's hash.
"""

from __future__ import annotations

import base64
import json
import os
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediafold.operators.jsonspan import json_span

MODALITIES = ("vision", "audio", "video")
PREFIX = "MEDIAFOLD"
ATTEMPTS = 3
FIRST_WAIT = 0.25
#: (status, body) of a request's answer; an OSError for a failed connection.
Transport = Callable[[str, dict, "str | None", float], "tuple[int, str]"]


@dataclass(frozen=True)
class Endpoint:
    url: str
    model: str
    key: str | None = None
    max_tokens: int = 4096
    timeout: float = 120.0
    inline_cap: int = 24_000_000

    @property
    def chat_url(self) -> str:
        return self.url.rstrip("/") + "/chat/completions"


@dataclass(frozen=True)
class Overrides:
    """Flags: for all modalities and for each."""

    url: str | None = None
    model: str | None = None
    urls: Mapping[str, str] = field(default_factory=dict)
    models: Mapping[str, str] = field(default_factory=dict)


def setting(env: Mapping[str, str], name: str) -> str | None:
    """An empty setting counts as none."""
    return env.get(name) or None


def number(env: Mapping[str, str], name: str, default: float) -> float:
    try:
        return float(env[name])
    except (KeyError, ValueError):
        return default


def resolve(modality: str, flags: Overrides, env: Mapping[str, str] | None = None) -> Endpoint | None:
    """A modality's endpoint. URL and model each: the modality's flag, its environment setting, the common flag, the common setting; both are needed."""
    env = os.environ if env is None else env
    own = f"{PREFIX}_{modality.upper()}"
    url = flags.urls.get(modality) or setting(env, f"{own}_URL") or flags.url or setting(env, f"{PREFIX}_URL")
    model = flags.models.get(modality) or setting(env, f"{own}_MODEL") or flags.model or setting(env, f"{PREFIX}_MODEL")
    if not url or not model:
        return None
    return Endpoint(
        url, model, setting(env, f"{own}_KEY") or setting(env, f"{PREFIX}_KEY"), int(number(env, f"{PREFIX}_MAX_TOKENS", 4096)),
        number(env, f"{PREFIX}_TIMEOUT", 120.0), int(number(env, f"{PREFIX}_INLINE_CAP", 24e6)),
    )


def precedence(flag: Column, env: Column, common_flag: Column, common_env: Column) -> Column:
    """resolve() for columns."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in (flag, env, common_flag, common_env)))


def request_body(ep: Endpoint, ask: str, text: str, images: list[tuple[bytes, str]] = (), audio: tuple[bytes, str] | None = None, vision: bool = True) -> dict:
    """images: (content, MIME type); audio: (content, format). Raises ValueError for a part over the inline cap."""
    parts: list[dict] = []
    for content, mime in images if vision else ():
        if len(content) > ep.inline_cap:
            raise ValueError(f"image of {len(content)} bytes is over the inline cap of {ep.inline_cap}")
        parts.append({"type": "image_url", "image_url": {"url": f"data:{mime};base64,{base64.b64encode(content).decode()}"}})
    if audio is not None:
        if len(audio[0]) > ep.inline_cap:
            raise ValueError(f"audio of {len(audio[0])} bytes is over the inline cap of {ep.inline_cap}")
        parts.append({"type": "input_audio", "input_audio": {"data": base64.b64encode(audio[0]).decode(), "format": audio[1]}})
    content = [{"type": "text", "text": text}, *parts] if parts else text
    return {"model": ep.model, "max_tokens": ep.max_tokens, "temperature": 0, "messages": [{"role": "system", "content": ask}, {"role": "user", "content": content}]}


def http(url: str, body: dict, key: str | None, timeout: float) -> tuple[int, str]:
    head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})
    try:
        with urllib.request.urlopen(urllib.request.Request(url, json.dumps(body).encode(), head), timeout=timeout) as r:
            return r.status, r.read().decode("utf-8", "replace")
    except urllib.error.HTTPError as e:
        return e.code, e.read().decode("utf-8", "replace")


def short(text: str, n: int = 200) -> str:
    return text if len(text) <= n else text[:n] + "…"


def read_reply(status: int, body: str) -> tuple[dict | None, str, bool]:
    """The reply's object, or None with the error and whether to try again."""
    try:
        answer = json.loads(body)
    except ValueError:
        answer = None
    if not 200 <= status < 300:
        said = answer.get("error") if isinstance(answer, dict) else None
        said = said.get("message") if isinstance(said, dict) else None
        return None, f"HTTP {status}: {said if isinstance(said, str) else short(body)}", status == 429 or not 400 <= status < 500
    if not isinstance(answer, dict):
        return None, f"reply is no JSON: {short(body)}", True
    choices = answer.get("choices")
    message = choices[0].get("message", {}) if isinstance(choices, list) and choices and isinstance(choices[0], dict) else {}
    content = next((message[k] for k in ("content", "reasoning") if isinstance(message.get(k), str) and message[k].strip()), None)
    if content is None:
        return None, "reply has no content", True
    span = json_span(content)
    return (json.loads(span), "", False) if span else (None, f"no JSON object in the reply: {short(content)}", True)


@dataclass(frozen=True)
class Attempt:
    """One request of a row: its number, the answer's status (None if none came), what was wrong (None if nothing) and how long to wait before the next, in milliseconds (None if there is none)."""

    attempt: int
    status: int | None
    error: str | None
    wait_ms: int | None


def attempted(ask: Callable[[int], tuple[int, str]]) -> Iterator[tuple[Attempt, dict | None]]:
    """The states of a request, one for each attempt, the last with the reply's object if there is one. ask: the answer to the n-th attempt; an OSError if none came."""
    for n in range(1, ATTEMPTS + 1):
        status = None
        try:
            status, body = ask(n)
            reply, error, again = read_reply(status, body)
        except OSError as e:
            reply, error, again = None, str(e), True
        goes_on = reply is None and again and n < ATTEMPTS
        yield Attempt(n, status, error if reply is None else None, int(1000 * FIRST_WAIT * 2 ** (n - 1)) if goes_on else None), reply
        if not goes_on:
            return


def analyse(ep: Endpoint, body: dict, transport: Transport = http, sleep: Callable[[float], None] = time.sleep) -> tuple[dict | None, str | None, int]:
    """The reply's object or None, the last error and the number of attempts."""
    last, reply = Attempt(0, None, "", None), None
    for last, reply in attempted(lambda _: transport(ep.chat_url, body, ep.key, ep.timeout)):
        if last.wait_ms is not None:
            sleep(last.wait_ms / 1000)
    return reply, last.error, last.attempt


def bodies(rows: DataFrame, ep: Endpoint, ask: str, text_col: str, content_col: str, mime_col: str, vision: bool = True) -> DataFrame:
    """rows with body, the JSON of the request with the text and, as its MIME type says, an image, a sound or nothing attached; and body_error, why there is none."""

    @F.pandas_udf("body string, body_error string")
    def made(texts: pd.Series, contents: pd.Series, mimes: pd.Series) -> pd.DataFrame:
        out = []
        for text, content, mime in zip(texts, contents, mimes, strict=True):
            kind = mime.split("/")[0] if isinstance(mime, str) else ""
            try:
                body = request_body(ep, ask, text or "", [(content, mime)] if kind == "image" else [], (content, mime.split("/")[1]) if kind == "audio" else None, vision)
                out.append((json.dumps(body, ensure_ascii=False), None))
            except ValueError as e:
                out.append((None, str(e)))
        return pd.DataFrame(out, columns=["body", "body_error"])

    return rows.withColumn("_made", made(text_col, content_col, mime_col)).select(*(F.col(f"`{c}`") for c in rows.columns), "_made.body", "_made.body_error")


REPLIES = "array<struct<status:int,body:string>>"
LOG = "array<struct<attempt:int,status:int,error:string,wait_ms:int>>"


def replayed(rows: DataFrame, replies_col: str = "replies") -> DataFrame:
    """rows with log and reply (JSON text): what the requests come to if their answers are those of ``replies_col`` (``REPLIES``), one an attempt, the last again and again.

    A null status is a connection that failed. A row without answers has an empty log. Rows stay where they are; nothing is shuffled.
    """

    @F.pandas_udf(f"log {LOG}, reply string")
    def states(scripts: pd.Series) -> pd.DataFrame:
        out = []
        for script in scripts:
            log, reply = [], None
            if script is not None and len(script):

                def ask(n: int, script=script) -> tuple[int, str]:
                    r = script[min(n, len(script)) - 1]
                    if r["status"] is None:
                        raise OSError("connection failed")
                    return int(r["status"]), r["body"] or ""

                for state, reply in attempted(ask):
                    log.append({"attempt": state.attempt, "status": state.status, "error": state.error, "wait_ms": state.wait_ms})
            out.append((log, None if reply is None else json.dumps(reply, ensure_ascii=False)))
        return pd.DataFrame(out, columns=["log", "reply"])

    return rows.withColumn("_states", states(F.col(replies_col).cast(REPLIES))).select(*(F.col(f"`{c}`") for c in rows.columns), "_states.log", "_states.reply")


def over_inline_cap(size: Column, what: str, cap: int) -> Column:
    """An error text where a part is too large to be sent, else null."""
    return F.when(size > cap, F.concat(F.lit(f"{what} of "), size.cast("string"), F.lit(f" bytes is over the inline cap of {cap}")))


def clean(value):
    """Strings trimmed; of lists the strings that are not blank, trimmed; anything else unchanged."""
    if isinstance(value, str):
        return value.strip()
    return [x.strip() for x in value if isinstance(x, str) and x.strip()] if isinstance(value, list) else value


_REPLY = "llm_tags array<string>, llm_description string, llm_summary string, llm_model string, llm_failure string, llm_missing string, llm_media_error string, llm_attempts int, llm_ms long"


def _text(value: object) -> str | None:
    """A reply's field as text; what is no string stays as its JSON."""
    return value if value is None or isinstance(value, str) else json.dumps(value, ensure_ascii=False)


#: Of a file's path, kind, MIME type and duration: images (content, MIME type) and a sound (content, format) or None. Raises what says why it can't.
Attachments = Callable[[str, str, str, "float | None"], "tuple[list[tuple[bytes, str]], tuple[bytes, str] | None]"]


def enrich(
    rows: DataFrame, endpoints: Mapping[str, Endpoint], ask: str, transport: Transport = http, text_col: str = "prompt", modality_col: str = "modality", id_col: str = "path",
    attach: Attachments | None = None, vision: bool = True,
) -> DataFrame:
    """``id_col`` and the reply's fields for rows whose modality has an endpoint; for others llm_missing says so if any has one.

    attach: reads what goes with a request, for one row at a time, in the task that asks; rows then have type, mime and duration_s. Images are left out of
    the request if ``vision`` is false. A tag list that is one string counts as that tag.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for key, modality, text, kind, mime, duration in pdf.itertuples(index=False):
                began, ep = time.monotonic(), endpoints.get(modality)
                if ep is None:
                    out.append((key, None, None, None, None, None, f"no endpoint configured for {modality}" if endpoints else None, None, 0, 0))
                    continue
                images, sound = [], None
                if attach is not None and isinstance(mime, str):
                    try:
                        images, sound = attach(key, kind, mime, None if pd.isna(duration) else float(duration))
                    except (OSError, RuntimeError) as e:
                        out.append((key, None, None, None, None, None, None, str(e), 0, 0))
                        continue
                try:
                    reply, error, n = analyse(ep, request_body(ep, ask, text or "", images, sound, vision), transport)
                except ValueError as e:  # over the inline cap
                    reply, error, n = None, str(e), 0
                r = reply or {}
                tags = clean(r.get("tags"))
                tags = tags if isinstance(tags, list) else None if tags is None else [_text(tags)]
                words = [_text(clean(r.get(k))) for k in ("description", "summary")]
                out.append((key, tags, *words, ep.model if reply is not None else None, error, None, None, n, int(1000 * (time.monotonic() - began))))
            yield pd.DataFrame(out, columns=[id_col, *(x.split()[0] for x in _REPLY.split(", "))])

    kind = rows.schema[id_col].dataType.simpleString()
    extra = [F.col(c).cast(k).alias(f"_{c}") if attach else F.lit(None).cast(k).alias(f"_{c}") for c, k in (("type", "string"), ("mime", "string"), ("duration_s", "double"))]
    return rows.select(id_col, modality_col, text_col, *extra).mapInPandas(run, f"{id_col} {kind}, {_REPLY}")
