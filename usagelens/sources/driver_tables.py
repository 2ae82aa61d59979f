"""The event and employee tables expressed over the benchmark star schema.

Purchases play the part of API requests, views of prompts, clicks of tool
decisions, signups of tool results and errors of API errors; ``props.k`` decides
which fields are NULL or empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Which event type stands for which event name.
EVENT_NAMES = {
    "purchase": "api_request",
    "view": "user_prompt",
    "click": "tool_decision",
    "signup": "tool_result",
    "error": "api_error",
}
ISO_MILLIS = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _email(user: Column) -> Column:
    return F.concat(F.lit("u"), user.cast("string"), F.lit("@example.org"))


def _raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What events are made of: a few narrow columns."""
    raw = _table(spark, sf_dir, "events").select(
        "event_id",
        F.date_trunc("millisecond", F.col("ts").cast("timestamp")).alias("event_ts"),
        "user_id",
        "event_type",
        "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )
    segment = _table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return raw.join(segment, raw.user_id == segment.c_custkey, "left").drop("c_custkey")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised events; columns a caller does not read are pruned from the scan."""
    return _raw_events(spark, sf_dir).select(*_normalised(F.col))


def _normalised(of: Callable[[str], Column]) -> list[Column]:
    """The columns of an event from its raw ones, which ``of`` gives by name."""
    kind, k, eid, uid = (of(c) for c in ("event_type", "k", "event_id", "user_id"))

    def only(condition: Column, value: Column) -> Column:
        return F.when(condition, value)

    purchase = kind == "purchase"
    name = F.coalesce(*[F.when(kind == a, F.lit(b)) for a, b in EVENT_NAMES.items()], kind)
    terminal = uid % 4
    return [
        eid.cast("string").alias("id"),
        F.unix_millis(of("event_ts")).alias("timestamp"),
        F.date_format(of("event_ts"), ISO_MILLIS).alias("event_timestamp"),
        of("event_ts").alias("event_ts"),
        name.alias("event_name"),
        F.lit("org-1").alias("organization_id"),
        only(
            k != 99, F.concat_ws("-", uid.cast("string"), F.to_date(of("event_ts")).cast("string"))
        ).alias("session_id"),
        uid.cast("string").alias("user_id"),
        F.when(k == 98, F.lit("")).when(k != 97, _email(uid)).alias("user_email"),
        only(k != 96, of("c_mktsegment")).alias("user_practice"),
        F.concat(F.lit("profile-"), (uid % 3).cast("string")).alias("user_profile"),
        F.when(terminal == 0, "vscode")
        .when(terminal == 1, "iterm")
        .when(terminal == 2, "tmux")
        .alias("terminal_type"),
        only(
            kind.isin("purchase", "error") & (k % 7 != 6),
            F.concat(F.lit("model-"), (k % 7).cast("string")),
        ).alias("model"),
        only(purchase & (k % 11 != 10), (k * 37 + eid % 101).cast("bigint")).alias("input_tokens"),
        only(purchase, (k * 11 + eid % 53).cast("bigint")).alias("output_tokens"),
        only(purchase & (k % 4 == 0), (k * 2).cast("bigint")).alias("cache_creation_tokens"),
        only(purchase & (k % 3 == 0), (k * 5).cast("bigint")).alias("cache_read_tokens"),
        only(purchase, of("value")).alias("cost_usd"),
        only(kind.isin("purchase", "signup"), eid % 1009).alias("duration_ms"),
        only(kind == "view", (k * 3).cast("bigint")).alias("prompt_length"),
        only(
            kind.isin("click", "signup"), F.concat(F.lit("tool-"), (k % 6).cast("string"))
        ).alias("tool_name"),
        only(kind == "click", F.when(eid % 50 == 0, "reject").otherwise("accept")).alias("decision"),
        only(kind == "click", F.lit("config")).alias("decision_source"),
        only(kind == "signup", F.when(eid % 20 == 0, "false").otherwise("true")).alias("success"),
        F.concat(F.lit("host-"), (uid % 5).cast("string")).alias("host_name"),
        F.lit("linux").alias("os_type"),
        F.lit("1.0.0").alias("service_version"),
    ]


def employees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Employee dimension: all customers, with a level and their nation as location.

    Every thirteenth has an address that no event bears, so some rows never match.
    """
    customer = _table(spark, sf_dir, "customer")
    nation = _table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    key = F.col("c_custkey")
    return customer.join(nation, customer.c_nationkey == nation.n_nationkey).select(
        F.when(key % 13 == 12, F.concat(F.lit("u"), key.cast("string"), F.lit("@example.com")))
        .otherwise(_email(key))
        .alias("email"),
        F.col("c_name").alias("full_name"),
        F.col("c_mktsegment").alias("practice"),
        F.concat(F.lit("L"), (key % 10 + 1).cast("string")).alias("level"),
        F.col("n_name").alias("location"),
    )


# --- the same events as raw input files ---------------------------------------
# Four events share an envelope. Some lines and events are damaged by rule, so that
# the load has something to refuse: every rule below is a remainder of the envelope
# number, which the SQL checks repeat.

EVENTS_PER_LINE = 4
#: Lines of a compressed file, at most; some 230 MB of text.
LINES_PER_FILE = 100_000
BLANK, CUT_OFF, CONTROL, UNREADABLE, UNDATED, RESENT = (
    (50, 1),
    (40, 3),
    (60, 5),
    (35, 2),
    (45, 4),
    (30, 7),
)
_ATTRIBUTES = {
    "event.name": "event_name",
    "event.timestamp": "event_timestamp",
    "organization.id": "organization_id",
    "session.id": "session_id",
    "user.id": "user_id",
    "user.email": "user_email",
    "terminal.type": "terminal_type",
    "model": "model",
    "input_tokens": "input_tokens",
    "output_tokens": "output_tokens",
    "cache_creation_tokens": "cache_creation_tokens",
    "cache_read_tokens": "cache_read_tokens",
    "cost_usd": "cost_usd",
    "duration_ms": "duration_ms",
    "prompt_length": "prompt_length",
    "tool_name": "tool_name",
    "decision": "decision",
    "source": "decision_source",
    "success": "success",
}
_RESOURCE = {
    "user.practice": "user_practice",
    "user.profile": "user_profile",
    "host.name": "host_name",
    "os.type": "os_type",
    "service.version": "service_version",
}


def _hits(rule: tuple[int, int]) -> Column:
    return F.col("g") % rule[0] == rule[1]


def _message(event: Column, cost: Column | None) -> Column:
    """A raw event as an object of an envelope; absent values are left out of the JSON."""
    of = F.struct(*_normalised(lambda c: event[c]))

    given = {c: of[c] for c in _ATTRIBUTES.values()}
    if cost is not None:
        given["cost_usd"] = cost

    message = F.to_json(
        F.struct(
            F.concat(F.lit("telemetry."), of["event_name"]).alias("body"),
            F.struct(*[given[c].alias(k) for k, c in _ATTRIBUTES.items()]).alias("attributes"),
            F.struct(*[of[c].alias(k) for k, c in _RESOURCE.items()]).alias("resource"),
        )
    )
    return F.struct(of["id"].alias("id"), of["timestamp"].alias("timestamp"), message.alias("message"))


def _lines(raw: DataFrame, cost: Column | None = None) -> DataFrame:
    """Envelopes of up to four events, with an unreadable or undated one added by rule.

    Raw columns are gathered, a tenth of the messages' size; those are made afterwards.
    """
    event = F.struct(F.col("event_id").alias("n"), F.struct(*raw.columns).alias("raw"))
    gathered = F.sort_array(
        F.transform(
            "gathered",
            lambda e: F.struct(e["n"].alias("n"), _message(e["raw"], cost).alias("event")),
        )
    )
    made_up = "struct<id:string,timestamp:bigint,message:string>"

    def added(prefix: str, stamp: Column, message: str) -> Column:
        name = F.concat(F.lit(prefix), F.col("g").cast("string"))
        return F.array(F.struct(name.alias("id"), stamp.alias("timestamp"), F.lit(message).alias("message")))

    none = F.array().cast(f"array<{made_up}>")
    unreadable = F.when(_hits(UNREADABLE), added("bad-", F.lit(1).cast("bigint"), "nope"))
    undated = F.when(_hits(UNDATED), added("undated-", F.lit(None).cast("bigint"), "{}"))
    return (
        raw.groupBy(F.floor(F.col("event_id") / EVENTS_PER_LINE).alias("g"))
        .agg(F.collect_list(event).alias("gathered"))
        .select(
            "g",
            F.concat(
                F.transform(gathered, lambda e: e["event"]),
                F.coalesce(unreadable, none),
                F.coalesce(undated, none),
            ).alias("logEvents"),
        )
    )


def _envelope(kind: str) -> Column:
    body = F.struct(F.lit(kind).alias("messageType"), F.col("logEvents"))
    return F.to_json(body, {"ignoreNullFields": "false"})


def write_logs(spark: SparkSession, sf_dir: str, path: str) -> list[str]:
    """Write the events as raw log files; returns the folders in the order they are loaded.

    The second folder sends some envelopes again at another cost: those copies lose. Files are
    compressed as a whole, so none has more than :data:`LINES_PER_FILE`.
    """
    raw = _raw_events(spark, sf_dir)
    first = _lines(raw)
    sent = _envelope("DATA_MESSAGE")
    extra = F.array_compact(
        F.array(
            F.when(_hits(BLANK), F.lit("   ")),
            F.when(_hits(CUT_OFF), F.substring(sent, 1, 25)),
            F.when(_hits(CONTROL), _envelope("CONTROL_MESSAGE")),
        )
    )
    lines = first.select(F.explode(F.concat(F.array(sent), extra)).alias("value"))
    again = _lines(raw, F.lit(9999.0)).where(_hits(RESENT))
    folders = [f"{path}/1-sent", f"{path}/2-sent-again"]
    for rows, folder in zip((lines, again.select(sent.alias("value"))), folders):
        rows.write.option("maxRecordsPerFile", LINES_PER_FILE).text(folder, compression="gzip")
    return folders


def write_employee_files(spark: SparkSession, sf_dir: str, path: str) -> list[str]:
    """Write the employees as CSV: a padded first version, then corrections for a third of them."""
    staff = employees(spark, sf_dir)
    third = F.pmod(F.xxhash64("email"), F.lit(3)) == 0
    padded = F.concat(F.lit("  "), F.col("full_name"), F.lit(" "))
    old_level = F.when(third, "L0").otherwise(F.col("level"))
    folders = [f"{path}/1-staff", f"{path}/2-corrections"]
    staff.withColumns({"full_name": padded, "level": old_level}).write.csv(
        folders[0], header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )
    staff.where(third).write.csv(folders[1], header=True)
    return folders
