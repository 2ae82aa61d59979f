"""Raw log lines to event rows: envelopes, nested messages, validity, quarantine.

Everything here is a column expression over one line or one event, without a
shuffle, and is the same for a batch and for a micro-batch of a stream.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from usagelens import schema
from usagelens.session import written

# The kind of envelope that carries events, and the event name of a
# message that gives none.
DATA_MESSAGE = "DATA_MESSAGE"
NAMELESS = "unknown"

# Event column -> key in the message's "attributes" object.
TEXT_ATTRIBUTES = {
    "event_timestamp": "event.timestamp",
    "organization_id": "organization.id",
    "session_id": "session.id",
    "user_id": "user.id",
    "user_email": "user.email",
    "terminal_type": "terminal.type",
    "model": "model",
    "tool_name": "tool_name",
    "decision": "decision",
    "success": "success",
}
WHOLE_ATTRIBUTES = (
    "input_tokens",
    "output_tokens",
    "cache_creation_tokens",
    "cache_read_tokens",
    "duration_ms",
    "prompt_length",
)
# Event column -> key in the message's "resource" object.
RESOURCES = {
    "user_practice": "user.practice",
    "user_profile": "user.profile",
    "host_name": "host.name",
    "os_type": "os.type",
    "service_version": "service.version",
}

# Position of a row in the load; also the order in which rows of one id compete.
ORDER = ("file", "block", "line_no", "pos")

# Every character that counts as white space.
_WHITE_SPACE = "".join(filter(str.isspace, map(chr, range(0x3001))))
_BARE_NUMBERS = r"([:\[,]\s*)(NaN|-?Infinity)(?=\s*[,}\]])"


def read_lines(spark: SparkSession, path: str | list[str], limit: int | None = None) -> DataFrame:
    """Text lines with their place in the load; only the first ``limit`` if given and not 0."""
    lines = with_place(spark.read.text(path).select("value", "_metadata"))
    return first_lines(lines, limit) if limit else lines


def first_lines(lines: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` lines by file and place, by counts and prefix sums without a sort.

    Lines are counted per file and block; a block's lines are numbered from the lines before
    it. Only the blocks' few figures meet in one task.
    """
    blocks = written(
        lines.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("line_no").alias("first")),
        "line-counts",
    )
    earlier = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n").over(earlier), F.lit(0))
    starts = blocks.select("file", "block", (before - F.col("first")).alias("shift"), before.alias("before"))
    chosen = starts.where(F.col("before") < limit).drop("before")
    numbered = lines.join(chosen, ["file", "block"])
    return numbered.where(F.col("line_no") + F.col("shift") < limit).select(lines.columns)


def with_place(lines: DataFrame) -> DataFrame:
    """Replace ``_metadata`` by file, split and line position."""
    return lines.select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line_no"),
    )


def strip(text: Column) -> Column:
    """Remove white space of every kind from both ends."""
    return F.btrim(text, F.lit(_WHITE_SPACE))


def unnest(lines: DataFrame) -> DataFrame:
    """One row per raw event, and one row (without ``pos``) per line that holds none.

    ``bad_line`` marks lines that are not a JSON object; blank lines and envelopes
    of another type are neither bad nor do they carry events.
    """
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    text = strip(F.col("value"))
    envelope = F.from_json(text, schema.ENVELOPE, options)
    opened = lines.withColumn("text", text).withColumn("envelope", envelope)
    events = F.when(F.col("envelope.messageType") == DATA_MESSAGE, F.col("envelope.logEvents"))
    bad = (F.col("text") != "") & F.col("envelope._corrupt").isNotNull()
    return opened.select(
        "file",
        "block",
        "line_no",
        "text",
        bad.alias("bad_line"),
        F.posexplode_outer(F.when(~bad, events)).alias("pos", "event"),
    )


def _member(*keys: str, kind: str = "variant") -> Column:
    """A value inside the parsed message; absent keys and wrong types give NULL."""
    return F.try_variant_get("msg", "$" + "".join(f'["{k}"]' for k in keys), kind)


def _is_object(*path: str, usual: tuple[str, ...] = ()) -> Column:
    """Whether a part of the message is an object: cheaply so where it has a usual key."""
    found = [_member(*path, key).isNotNull() for key in usual]
    return reduce(Column.__or__, [*found, _member(*path, kind="map<string,variant>").isNotNull()])


def parse_events(unnested: DataFrame) -> DataFrame:
    """Flatten events; ``valid`` is false for events that cannot be read.

    An event is readable when it has the keys ``id`` and ``timestamp`` (null counts
    as present), its message is a JSON object, ``attributes`` and ``resource`` are
    objects or absent, and its name is a string.
    """
    event = F.col("event")
    message = event["message"]
    # Bare NaN and Infinity are no JSON; quoting them keeps the rest of the message.
    quoted = F.regexp_replace(message, _BARE_NUMBERS, '$1"$2"')
    parsed = F.coalesce(F.try_parse_json(message), F.try_parse_json(quoted))
    # Later filters cannot move below a generator, so no message is parsed twice.
    opened = (
        unnested.select("*", F.explode(F.array(parsed)).alias("msg"))
        .withColumn("attributes", _member("attributes"))
        .withColumn("resource", _member("resource"))
        .withColumn("name", F.coalesce(_member("attributes", "event.name"), _member("body")))
    )
    name_ok = F.col("name").isNull() | (F.schema_of_variant("name") == "STRING")
    valid = (
        F.map_contains_key(event, "id")
        & F.map_contains_key(event, "timestamp")
        & F.col("msg").isNotNull()
        & (F.col("attributes").isNotNull() | F.col("resource").isNotNull() | _is_object())
        & (F.col("attributes").isNull() | _is_object("attributes", usual=("event.name",)))
        & (F.col("resource").isNull() | _is_object("resource", usual=("user.practice", "host.name")))
        & name_ok
    )
    name = F.coalesce(F.try_variant_get("name", "$", "string"), F.lit(NAMELESS))
    cost = F.nanvl(_member("attributes", "cost_usd", kind="double"), F.lit(None).cast("double"))
    source = _member("attributes", "source", kind="string")
    columns = {
        "id": event["id"],
        "timestamp": event["timestamp"].try_cast("bigint"),
        "event_name": F.substring_index(name, ".", -1),
        **{c: _member("attributes", k, kind="string") for c, k in TEXT_ATTRIBUTES.items()},
        **{c: _member("attributes", c, kind="bigint") for c in WHOLE_ATTRIBUTES},
        **{c: _member("resource", k, kind="string") for c, k in RESOURCES.items()},
        "cost_usd": F.when(F.abs(cost) < float("inf"), cost),
        "decision_source": F.coalesce(
            F.nullif(source, F.lit("")), _member("attributes", "decision_source", kind="string")
        ),
        "raw_message": message,
    }
    columns["event_ts"] = columns["event_timestamp"].try_cast("timestamp")
    return opened.select(
        *ORDER,
        "text",
        "bad_line",
        F.coalesce(valid, F.lit(False)).alias("valid"),
        *[columns[c].alias(c) for c in schema.PARSED_COLUMNS],
    )


def stage(lines: DataFrame) -> DataFrame:
    """Lines to flattened events with their marks."""
    return parse_events(unnest(lines))


def storable() -> Column:
    """Rows the event table accepts; only these claim their id."""
    return F.col("valid") & F.col("timestamp").isNotNull() & F.col("event_name").isNotNull()


def figures() -> dict[str, Column]:
    """Which rows of a staged frame each load figure counts.

    Lines of every kind, readable events, and skipped lines and events.
    """
    unread = F.col("pos").isNotNull() & ~F.col("valid")
    return {
        "lines_processed": F.coalesce("pos", F.lit(0)) == 0,
        "events_inserted": F.col("valid"),
        "events_skipped": F.col("bad_line") | unread,
    }


def summary(lines: DataFrame) -> DataFrame:
    """The load figures as one row, without writing anything."""
    return stage(lines).agg(*[F.count_if(c).alias(name) for name, c in figures().items()])


def tallies(staged: DataFrame, stored: Column) -> DataFrame:
    """Rows per load figure, per id that is to be stored, and of kind ``rows``, in one aggregate.

    ``id`` is NULL but for the kind ``id``. Figures and hot ids collapse before the
    shuffle, and as plain counts they stay right when tasks are run again.
    """
    nothing = F.lit(None).cast("string")
    kinds = [
        F.when(c, F.struct(F.lit(name).alias("kind"), nothing.alias("id")))
        for name, c in {**figures(), "rows": stored}.items()
    ]
    claim = F.struct(F.lit("id").alias("kind"), F.col("id").alias("id"))
    kinds.append(F.when(stored & F.col("id").isNotNull(), claim))
    marked = staged.select(F.explode(F.array_compact(F.array(*kinds))).alias("mark"))
    return marked.groupBy("mark.kind", "mark.id").agg(F.count("*").alias("copies"))


def quarantine(lines: DataFrame) -> DataFrame:
    """Lines and events that were skipped, with the reason."""
    reason = F.when(F.col("bad_line"), "line is not a JSON object").otherwise("event cannot be read")
    return (
        stage(lines)
        .where(figures()["events_skipped"])
        .select("file", F.col("text").alias("line"), "pos", "id", reason.alias("reason"))
    )
