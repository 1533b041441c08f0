"""The rules for headers, probes, labels, endpoints and replies, applied to whole tables: each row's own numbers and texts make its case."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mediafold.functions.headers import image_dims
from mediafold.functions.mel import hz_to_mel, mel_to_hz
from mediafold.functions.metadata import exif_metadata, probe_metadata
from mediafold.functions.sniff import kind_of, mime_of, modality_of
from mediafold.functions.text import chat_url, describe_name, missing_binary, path_order, short_sound
from mediafold.operators.endpoint import Endpoint, bodies, over_inline_cap, precedence, replayed
from mediafold.operators.ordered import laid_out
from mediafold.operators.vocabulary import cache_key_column, split_labels
from mediafold.plans.describe import prompt_text
from mediafold.plans.tag_queries import human_sql
from mediafold.sources.external import frame_times


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: list[str], number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(number, F.lit(len(values))) + 1).cast("int"))


# A header of each rule, and its type.
HEADERS = {
    "FFD8FFE0": "image/jpeg", "89504E470D0A1A0A": "image/png", "47494638": "image/gif", "424D": "image/bmp", "664C6143": "audio/flac", "4F676753": "audio/ogg", "494433": "audio/mpeg",
    "FFFB9000": "audio/mpeg", "FFFE4100": "audio/mpeg", "FFDF4100": "none", "524946460000000057415645": "audio/wav", "524946460000000057454250": "image/webp", "524946460000000041564920": "video/avi",
    "524946460000000041494646": "none", "1A45DFA3": "video/x-matroska", "49492A00": "image/tiff", "4D4D002A": "image/tiff", "4D4D2A00": "none", "00000018667479704D344120": "audio/mp4",
    "00000018667479704D344220": "audio/mp4", "000000186674797061766966": "image/avif", "000000186674797061766973": "image/avif", "000000186674797068656963": "image/heic",
    "000000186674797068656978": "image/heic", "00000018667479706D696631": "image/heic", "00000018667479706D736631": "image/heic", "000000186674797069736F6D": "video/mp4", "0000": "none",
}


def sniff_all_kinds(spark, sf_dir):
    """Each text as the content behind one of the headers, by its number: every rule, and near misses."""
    rows = _table(spark, sf_dir, "documents")
    content = F.concat(F.unhex(_pick(list(HEADERS), F.col("doc_id"))), F.coalesce("text", F.lit("")).cast("binary"))
    mime = mime_of(content)
    return rows.select("doc_id", F.coalesce(mime, F.lit("none")).alias("mime"), F.coalesce(modality_of(kind_of(mime)), F.lit("none")).alias("modality"))


def _bytes(number: Column, n: int, big: bool) -> Column:
    """The n bytes of a number as hexadecimal digits."""
    parts = [F.lpad(F.hex(F.shiftright(number, 8 * k).bitwiseAND(F.lit(255).cast("long"))), 2, "0") for k in range(n)]
    return F.concat(*(reversed(parts) if big else parts))


def image_dims_parts(spark, sf_dir):
    """A header of one of four layouts for each part, with its number and size as width and height, read again."""
    w, h = (F.col("p_partkey") % 16000 + 1).cast("long"), (F.col("p_size") + 1).cast("long")
    riff = F.lit("524946460000000057454250")
    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), _bytes(w, 4, True), _bytes(h, 4, True), F.lit("0806000000"))
    extended = F.concat(riff, F.lit("565038580A00000000000000"), _bytes(w - 1, 3, False), _bytes(h - 1, 3, False), F.lit("0000"))
    lossy = F.concat(riff, F.lit("5650382000000000000000009D01"), _bytes(w, 2, False), _bytes(h, 2, False), F.lit("0000"))
    packed = (w - 1) + F.shiftleft(h - 1, 14)
    lossless = F.concat(riff, F.lit("5650384C000000002F"), _bytes(packed, 4, False), F.lit("0000000000"))
    form = F.col("p_partkey") % 5
    header = F.when(form == 0, png).when(form == 1, extended).when(form == 2, lossy).when(form == 3, lossless).otherwise(F.lit("424D"))
    dims = image_dims(F.unhex(header))
    return _table(spark, sf_dir, "part").select("p_partkey", dims["width"].alias("width"), dims["height"].alias("height"))


def frame_times_events(spark, sf_dir):
    """Each event's number as a video's length in eighths of a second: the times of four frames; one frame at 0 where it is 0."""
    rows = _table(spark, sf_dir, "events").withColumn("d", F.when(F.col("event_id") % 11 != 0, F.col("event_id") % 1000 / 8.0))
    return rows.select("event_id", F.posexplode(frame_times(F.col("d"), 4)).alias("i", "t")).select("event_id", F.col("i").cast("long").alias("i"), "t")


def mel_scale_events(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 15000 * 1.5).cast("double").alias("hz"))
    m = hz_to_mel(F.col("hz"))
    return rows.select("event_id", F.round(m, 6).alias("mel"), F.round(mel_to_hz(m), 6).alias("again"))


def probe_events(spark, sf_dir):
    """A container probe of each event, with its props among the tags: texts that are no numbers, negative rates, long texts, streams that lack fields."""
    m = F.col("event_id")
    duration = F.when(m % 5 == 0, F.lit("N/A")).otherwise(F.concat((m % 1000).cast("string"), F.lit(".25")))
    head = F.concat(F.lit('{"format":{"duration":"'), duration, F.lit('","bit_rate":"'), (m % 7 - 3).cast("string"), F.lit('","format_name":"'), F.col("event_type"), F.lit('","tags":{"props":'), F.col("props"))
    tags = F.concat(F.lit(',"title":"'), F.expr("repeat('x', cast(505 + event_id % 16 as int))"), F.lit('"}},"streams":'))
    video = F.concat(F.lit('[{"codec_type":"audio","codec_name":"aac","sample_rate":44100},{"codec_type":"video","codec_name":"h264","width":'), (m % 2000).cast("string"), F.lit(',"avg_frame_rate":"10/1"},{"codec_type":"video","codec_name":"late"}]}'))
    sound = F.concat(F.lit('[{"codec_type":"audio","sample_rate":"'), F.when(m % 2 == 0, F.lit("48000")).otherwise(F.lit("fast")), F.lit('"}]}'))
    raw = F.concat(head, tags, F.when(m % 3 == 0, F.lit("[]}")).when(m % 3 == 1, video).otherwise(sound))
    return _table(spark, sf_dir, "events").select("event_id", F.to_json(probe_metadata(raw)).alias("metadata"))


def exif_events(spark, sf_dir):
    """An EXIF tool's answer for each event: numbers, digits, negative numbers, long texts and the event's own props."""
    m = F.col("event_id")
    width = F.when(m % 3 == 0, F.concat(F.lit('"'), m.cast("string"), F.lit('"'))).when(m % 3 == 1, (-m).cast("string")).otherwise(m.cast("string"))
    raw = F.concat(
        F.lit('[{"SourceFile":"a","SourceFileSize":7,"ExifTool":"13","ExifToolVersion":13.25,"Comment":"'), F.expr("repeat('é', cast(250 + event_id % 12 as int))"), F.lit('","ISO":100,"ImageWidth":'), width,
        F.lit(',"ImageHeight":48,"Props":'), F.col("props"), F.lit('},{"Make":"second"}]'),
    )
    raw = F.when(m % 13 == 0, F.lit("[]")).otherwise(raw)
    return _table(spark, sf_dir, "events").select("event_id", F.to_json(exif_metadata(raw)).alias("metadata"))


def endpoint_precedence_customers(spark, sf_dir):
    """Each customer's number decides which of the four settings there are; an empty one counts as none."""
    k = F.col("c_custkey")

    def given(name: str, every: int, empty: int) -> Column:
        return F.when(k % every == 0, F.when(k % empty == 0, F.lit("")).otherwise(F.concat(F.lit(f"http://{name}/"), k.cast("string"), F.when(k % 5 == 0, F.lit("//")).otherwise(F.lit("")))))

    url = precedence(given("flag", 2, 4), given("env", 3, 9), given("all", 5, 10), given("all-env", 7, 21))
    return _table(spark, sf_dir, "customer").select("c_custkey", url.alias("url"), chat_url(url).alias("chat"))


_SAID = ("No such file or directory", "ffprobe not found", "broken header", "x: is it installed?", "Not Found", "")


def missing_binary_documents(spark, sf_dir):
    """Messages with a document's text around one of six phrases."""
    text = F.concat_ws(" ", F.col("text"), _pick(list(_SAID), F.col("doc_id")), F.col("lang"))
    return _table(spark, sf_dir, "documents").select("doc_id", missing_binary(text).alias("missing"))


def label_lists_documents(spark, sf_dir):
    """Each text as a list of labels, its sentences' commas and stops being the commas of the list; and the key of their vectors."""
    labels = split_labels(F.translate("text", ".\n", ",,"))
    rows = _table(spark, sf_dir, "documents").select("doc_id", labels.alias("labels"))
    return rows.select("doc_id", F.size("labels").cast("long").alias("n"), F.array_join("labels", "|").alias("labels"), cache_key_column(F.lit("tower.onnx"), F.col("labels")).alias("key"))


def short_sounds(spark, sf_dir):
    """Parts as sounds, their sizes as hundredths of a second: descriptions of those that no tag describes."""
    d = F.when(F.col("p_partkey") % 9 != 0, F.col("p_size") / 100.0)
    return _table(spark, sf_dir, "part").select("p_partkey", describe_name(F.col("p_name"), short_sound(d)).alias("description"))


def inline_cap_documents(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", over_inline_cap(F.octet_length("text").cast("long"), "image", 4000).alias("error"))


def component_order(spark, sf_dir):
    """The place of every page's address in path order."""
    rows = _table(spark, sf_dir, "pages").filter("url IS NOT NULL").select("url")
    return laid_out(rows, [path_order(F.col("url"))], "url").select("url", "position")


_STATUSES = (200, 503, 400, 429, 302, 200, 404)


def retry_conversations(spark, sf_dir):
    """Each conversation's first turns as the answers to its requests: assistants answer with an object, others in prose, and a turn's number decides the status."""
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns = turns.withColumn("at", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))).filter("at <= 3")  # no more are asked for, whatever their number
    status = F.element_at(F.array(*map(F.lit, _STATUSES)), ((F.col("conv_id") * 3 + F.col("turn")) % len(_STATUSES) + 1).cast("int"))
    said = F.when(F.col("role") == "assistant", F.concat(F.lit("Here: "), F.to_json(F.struct(F.array("role").alias("tags"), F.left("text", F.lit(40)).alias("summary"))))).otherwise(F.translate("text", "{}", "()"))
    body = F.when(status == 200, F.to_json(F.struct(F.array(F.struct(F.struct(said.alias("content")).alias("message"))).alias("choices")))).otherwise(F.lit("busy"))
    scripts = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("at", status.alias("status"), body.alias("body")))).alias("replies"))
    found = replayed(scripts.withColumn("replies", F.transform("replies", lambda r: F.struct(r["status"].alias("status"), r["body"].alias("body")))))
    joined = lambda name: F.array_join(F.transform("log", lambda a: a[name].cast("string")), ",", "-")
    return found.select("conv_id", F.size("log").cast("long").alias("attempts"), joined("status").alias("statuses"), joined("wait_ms").alias("waits"), F.get_json_object("reply", "$.tags[0]").alias("tag"), F.col("log")[F.size("log") - 1]["error"].alias("error"))


_CAP = 3000


def request_bodies(spark, sf_dir):
    """Each text as the content of an image, a sound or nothing that goes with the request, under a cap of 3000 bytes: what the request holds."""
    kind = _pick(["image/png", "audio/mp3", "none"], F.col("doc_id"))
    rows = _table(spark, sf_dir, "documents").select("doc_id", F.left("text", F.lit(50)).alias("said"), F.col("text").cast("binary").alias("content"), F.nullif(kind, F.lit("none")).alias("mime"))
    made = bodies(rows, Endpoint("http://x/v1", "m", inline_cap=_CAP), "Ask.", "said", "content", "mime")
    at = lambda path: F.get_json_object("body", path)
    parts = F.col("mime").isNotNull()
    said, url = F.when(parts, at("$.messages[1].content[0].text")).otherwise(at("$.messages[1].content")), at("$.messages[1].content[1].image_url.url")
    return made.select(
        "doc_id", at("$.model").alias("model"), at("$.max_tokens").cast("long").alias("max_tokens"), at("$.messages[0].content").alias("ask"), said.alias("said"), F.sha2(url, 256).alias("url_sha256"),
        at("$.messages[1].content[1].input_audio.format").alias("format"), F.sha2(at("$.messages[1].content[1].input_audio.data"), 256).alias("sound_sha256"), F.col("body_error").alias("error"),
    )


def prompt_texts(spark, sf_dir):
    """What the endpoint is told of each event as a file: its kind and its probe's facts, without the container's own tags."""
    m = F.col("event_id")
    raw = F.concat(F.lit('{"format":{"duration":"'), (m % 900).cast("string"), F.lit('.5","format_name":"'), F.col("event_type"), F.lit('","tags":'), F.col("props"), F.lit('}}'))
    rows = _table(spark, sf_dir, "events").select("event_id", _pick(["image", "video", "audio"], m).alias("kind"), F.to_json(probe_metadata(raw)).alias("metadata"))
    return rows.select("event_id", prompt_text(F.col("kind"), F.col("metadata")).alias("prompt"))


QUERIES = {
    f.__name__: f
    for f in (
        sniff_all_kinds, image_dims_parts, frame_times_events, mel_scale_events, probe_events, exif_events, endpoint_precedence_customers, missing_binary_documents, label_lists_documents, short_sounds,
        inline_cap_documents, component_order, retry_conversations, request_bodies, prompt_texts,
    )
}

_MEL = "CASE WHEN {0} >= 1000 THEN 15 + ln({0} / 1000.0) / (ln(6.4) / 27) ELSE {0} * 3 / 200.0 END"


def _given(name: str, every: int, empty: int) -> str:
    return f"CASE WHEN c_custkey % {every} = 0 AND c_custkey % {empty} <> 0 THEN 'http://{name}/' || c_custkey || CASE WHEN c_custkey % 5 = 0 THEN '//' ELSE '' END END"


def _object_sql(*parts: str) -> str:
    """An object of those of the parts that aren't null."""
    return "'{' || concat_ws(',', " + ", ".join(parts) + ") || '}'"


_MIME = f"{list(HEADERS.values())}[doc_id % {len(HEADERS)} + 1]"
_LABELS = r"list_filter(list_transform(string_split(translate(text, E'.\n', ',,'), ','), lambda x: trim(x, E' \t\n\r')), lambda x: x <> '')"

SQL = {
    "sniff_all_kinds": f"SELECT doc_id, {_MIME} AS mime, CASE split_part({_MIME}, '/', 1) WHEN 'image' THEN 'vision' ELSE split_part({_MIME}, '/', 1) END AS modality FROM documents",
    "image_dims_parts": "SELECT p_partkey, CASE WHEN p_partkey % 5 < 4 THEN p_partkey % 16000 + 1 END AS width, CASE WHEN p_partkey % 5 < 4 THEN (p_size + 1)::BIGINT END AS height FROM part",
    "frame_times_events": "SELECT event_id, i, CASE WHEN d > 0 THEN round(d * (i + 0.5) / 4, 3) ELSE 0.0 END AS t FROM (SELECT event_id, CASE WHEN event_id % 11 <> 0 THEN (event_id % 1000)::DOUBLE / 8 END AS d FROM events), range(0, 4) AS r(i) WHERE d > 0 OR i = 0",
    "mel_scale_events": f"SELECT event_id, round({_MEL.format('hz')}, 6) AS mel, round(hz, 6) AS again FROM (SELECT event_id, (event_id % 15000)::DOUBLE * 1.5 AS hz FROM events)",
    "probe_events": f"""SELECT event_id, {_object_sql(
        "CASE WHEN m % 3 = 1 THEN '\"audio_codec\":\"aac\"' WHEN m % 3 = 2 THEN '\"audio_codec\":null' END", "CASE WHEN m % 7 >= 3 THEN '\"bitrate\":' || (m % 7 - 3) END", "CASE WHEN m % 3 = 1 THEN '\"codec\":\"h264\"' END",
        "'\"container\":\"' || event_type || '\"'", "CASE WHEN m % 5 <> 0 THEN '\"duration_s\":' || (m % 1000) || '.25' END",
        "'\"format_tags\":{\"props\":' || replace(props, ' ', '') || CASE WHEN 505 + m % 16 <= 512 THEN ',\"title\":\"' || repeat('x', 505 + m % 16) || '\"' ELSE '' END || '}'",
        "CASE WHEN m % 3 = 1 THEN '\"fps\":\"10/1\",\"height\":null' END", "CASE WHEN m % 3 = 2 THEN '\"sample_rate\":' || CASE WHEN m % 2 = 0 THEN 48000 ELSE 0 END END", "CASE WHEN m % 3 = 1 THEN '\"width\":' || (m % 2000) END")} AS metadata
FROM (SELECT *, event_id AS m FROM events)""",
    "exif_events": f"""SELECT event_id, CASE WHEN m % 13 = 0 THEN '{{"exif":{{}}}}' ELSE {_object_sql(
        "'\"exif\":{' || CASE WHEN 2 * (250 + m % 12) <= 512 THEN '\"Comment\":\"' || repeat('é', 250 + m % 12) || '\",' ELSE '' END || '\"ExifToolVersion\":13.25,\"ISO\":100,\"ImageHeight\":48,\"ImageWidth\":' || CASE m % 3 WHEN 0 THEN '\"' || m || '\"' WHEN 1 THEN '' || -m ELSE '' || m END || ',\"Props\":' || replace(props, ' ', '') || '}'",
        "'\"height\":48'", "CASE WHEN m % 3 = 2 THEN '\"width\":' || m END")} END AS metadata FROM (SELECT *, event_id AS m FROM events)""",
    "endpoint_precedence_customers": f"SELECT c_custkey, url, rtrim(url, '/') || '/chat/completions' AS chat FROM (SELECT c_custkey, coalesce({_given('flag', 2, 4)}, {_given('env', 3, 9)}, {_given('all', 5, 10)}, {_given('all-env', 7, 21)}) AS url FROM customer)",
    "missing_binary_documents": f"SELECT doc_id, regexp_matches(concat_ws(' ', text, {list(_SAID)}[doc_id % {len(_SAID)} + 1], lang), 'No such file|not found|is it installed') AS missing FROM documents",
    "label_lists_documents": f"SELECT doc_id, len(l) AS n, array_to_string(l, '|') AS labels, left(sha256('tower.onnx' || array_to_string(list_transform(l, lambda x: x || chr(0)), '')), 16) AS key FROM (SELECT doc_id, {_LABELS} AS l FROM documents)",
    "short_sounds": f"SELECT p_partkey, {human_sql('p_name')} || CASE WHEN p_partkey % 9 <> 0 AND p_size > 0 AND p_size < 35 THEN ' (short sound effect).' ELSE '.' END AS description FROM part",
    "inline_cap_documents": "SELECT doc_id, CASE WHEN strlen(text) > 4000 THEN 'image of ' || strlen(text) || ' bytes is over the inline cap of 4000' END AS error FROM documents",
    "component_order": "SELECT url, row_number() OVER (ORDER BY string_split(url, '/'), url) - 1 AS position FROM pages WHERE url IS NOT NULL",
    "retry_conversations": f"""WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS at_, count(*) OVER (PARTITION BY conv_id) AS n, {list(_STATUSES)}[(conv_id * 3 + turn) % {len(_STATUSES)} + 1] AS status FROM conversations),
r AS (SELECT conv_id, a, status, role, text, CASE WHEN status = 200 AND role = 'assistant' THEN 1 ELSE 0 END AS good, CASE WHEN status BETWEEN 400 AND 499 AND status <> 429 THEN 1 ELSE 0 END AS ends FROM t JOIN range(1, 4) AS x(a) ON at_ = least(a, n)),
s AS (SELECT *, coalesce(sum(good + ends) OVER (PARTITION BY conv_id ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS over_ FROM r),
l AS (SELECT *, max(a) OVER (PARTITION BY conv_id) AS final FROM s WHERE over_ = 0)
SELECT conv_id, count(*) AS attempts, string_agg(status, ',' ORDER BY a) AS statuses, string_agg(CASE WHEN a < final THEN (250 * a)::VARCHAR ELSE '-' END, ',' ORDER BY a) AS waits,
       max(CASE WHEN good = 1 THEN 'assistant' END) AS tag,
       max(CASE WHEN a = final AND good = 0 THEN CASE WHEN status <> 200 THEN 'HTTP ' || status || ': busy' ELSE 'no JSON object in the reply: ' || CASE WHEN length(text) > 200 THEN left(translate(text, '{{}}', '()'), 200) || '…' ELSE translate(text, '{{}}', '()') END END END) AS error
FROM l GROUP BY conv_id""",
    "request_bodies": f"""WITH d AS (SELECT doc_id, text, ['image/png', 'audio/mp3', NULL][doc_id % 3 + 1] AS mime, strlen(text) AS n FROM documents),
e AS (SELECT *, CASE WHEN mime IS NOT NULL AND n > {_CAP} THEN split_part(mime, '/', 1) || ' of ' || n || ' bytes is over the inline cap of {_CAP}' END AS error FROM d)
SELECT doc_id, CASE WHEN error IS NULL THEN 'm' END AS model, CASE WHEN error IS NULL THEN 4096 END AS max_tokens, CASE WHEN error IS NULL THEN 'Ask.' END AS ask, CASE WHEN error IS NULL THEN left(text, 50) END AS said,
       CASE WHEN error IS NULL AND mime = 'image/png' THEN sha256('data:image/png;base64,' || base64(encode(text))) END AS url_sha256, CASE WHEN error IS NULL AND mime = 'audio/mp3' THEN 'mp3' END AS format,
       CASE WHEN error IS NULL AND mime = 'audio/mp3' THEN sha256(base64(encode(text))) END AS sound_sha256, error FROM e""",
    "prompt_texts": """SELECT event_id, ['Image file', 'Video (sample frames attached)', 'Audio file'][event_id % 3 + 1] || E'.\nMetadata:\n{\n  "container": "' || event_type || E'",\n  "duration_s": ' || (event_id % 900) || E'.5\n}' AS prompt FROM events""",
}
