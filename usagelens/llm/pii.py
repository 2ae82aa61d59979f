"""Personal data by bootstrapped contextual extraction.

Fixed base rules find the plain forms of e-mail addresses, IP numbers, payment cards and
phone numbers in every text. These are the seeds: the words around them induce lexical
patterns. The same words around other candidates tie patterns to instances: identifiers
in a loose form that no base rule accepts, and any further token with a digit or an
at-sign, as the kind that its characters make plausible, if any. Spark scores this graph in
rounds: a pattern that holds enough known instances of a kind is as good as their share of
all its instances, an instance as good as its trusted patterns together. Instances that are
believed are known in the next round and induce patterns of their own. Candidates that end
above a threshold join the base spans; base spans always stay.
"""

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from usagelens.llm.tables import arrow_schema, record_batch, spread_join, texts, unused
from usagelens.session import written

#: Kinds in the order of their listing.
KINDS = ("email", "ip", "card", "phone")

# --- fixed values: the base rules -------------------------------------------------------
# A run of digits has one possible start, so the rules for digits begin at its first one.
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
_IP = r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
_CARD = r"[0-9]([\x20-]?[0-9])+"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

# --- loose forms that the base rules do not accept --------------------------------------
_NAME = r"(?<![\w.%+-])[\w.%+-]+"
_LOOSE = {
    "email": [
        _NAME + r" ?(?:@|[\[(](?:at|@)[\])]) ?[A-Za-z0-9-]+"
        r"(?: ?(?:\.|[\[(](?:dot|\.)[\])]) ?[A-Za-z0-9-]{2,})+",
        _NAME + r" (?:at|AT) [A-Za-z0-9-]+(?: (?:dot|DOT) [A-Za-z0-9-]+)+",
    ],
    "ip": [r"(?<![0-9.])[0-9]{1,3}(?: ?[\[(](?:dot|\.)[\])] ?[0-9]{1,3}){3}(?![0-9])"],
    "card": [r"(?<![0-9._/])[0-9]{4}(?:[._/][0-9]{4}){2}[._/][0-9]{1,7}(?![0-9._/])"],
    "phone": [
        r"(?<![0-9+.-])(?:00|\()?[0-9]{2,5}\)?[ ./-][0-9]{3,4}[ ./-][0-9]{2,5}(?![0-9.-])"
    ],
}
_TOKEN = r"\S+"
_MARKS = ".,;:!?\"'()[]{}<>"
_AROUND = r"\w+|[^\w\s]"

#: Known instances a pattern needs, and the share of all its instances that they must be.
SUPPORT, TRUSTED = 5, 0.5
#: Rounds of scoring, and the score at which a candidate is believed.
ROUNDS, BELIEVED = 3, 0.8

FOUND = (
    "row_id long, doc_id long, key binary, base array<struct<kind: string, start: long, end: long>>, "
    "mentions array<struct<kind: string, start: long, end: long, seed: boolean, "
    "instance: long, patterns: array<string>>>"
)


def _luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    domain, low, at = re.compile(_DOMAIN), 0, text.find("@")
    while at >= 0:
        start = low + len(text[low:at].rstrip(_LOCAL))
        match = domain.match(text, at + 1) if start < at else None
        low = match.end() if match else at + 1
        if match:
            yield start, low
        at = text.find("@", low)


def _byte(part: str) -> bool:
    value = part.lstrip("0")
    return len(value) <= 3 and int(value or 0) <= 255


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base rules, by start and then kind; code points."""
    out = [("email", *span) for span in _emails(text)]
    for m in re.finditer(_IP, text):
        if all(map(_byte, m.group().split("."))):
            out.append(("ip", *m.span()))
    for m in re.finditer(_CARD, text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and _luhn(digits):
            out.append(("card", *m.span()))
    for m in re.finditer(_PHONE, text):
        if 9 <= sum(map(str.isdigit, m.group())) <= 15:
            out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def plausible(token: str) -> str:
    """The kind that a token may be of by its characters, else ``other``."""
    digits = re.sub("[^0-9]", "", token) if len(token) < 64 else ""
    if re.fullmatch(r"[\w.%+-]+@[\w.-]+", token):
        return "email"
    if re.fullmatch(r"[0-9]{1,3}(?:[-_:,][0-9]{1,3}){3}", token):
        return "ip" if all(int(p) < 256 for p in re.findall("[0-9]+", token)) else "other"
    if re.fullmatch(r"[0-9+()./:_-]+", token):
        if 12 <= len(digits) <= 19 and _luhn(digits):
            return "card"
        if 9 <= len(digits) <= 15:
            return "phone"
    return "other"


def loose_spans(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Candidates of no base rule: loose forms, then the remaining tokens with a digit or @."""
    out = []
    digit, at = re.search("[0-9]", text), "@" in text
    starts: list[int] = []
    ends: list[int] = []

    def block(spans):
        """Make the sorted, disjoint list of places that are taken."""
        old = list(zip(starts, ends))
        starts.clear(), ends.clear()
        for start, end in sorted(old + spans):
            if ends and start < ends[-1]:
                ends[-1] = max(ends[-1], end)
            else:
                starts.append(start), ends.append(end)

    def free(start: int, end: int) -> bool:
        i = bisect_left(starts, end)
        return i == 0 or ends[i - 1] <= start

    block([s[1:] for s in taken])
    written_out = at or any(w in text for w in ("at)", "at]", " dot ", " DOT "))
    for kind, rules in _LOOSE.items():
        if not (written_out if kind == "email" else digit):
            continue
        for rule in rules:
            new = []
            for m in re.finditer(rule, text):
                digits = re.sub(r"[^0-9]", "", m.group())
                fits = {
                    "email": True,
                    "ip": kind == "ip" and all(int(p) < 256 for p in re.findall(r"[0-9]+", m.group())),
                    "card": 12 <= len(digits) <= 19 and _luhn(digits),
                    "phone": 9 <= len(digits) <= 15,
                }[kind]
                if fits and free(*m.span()):
                    new.append(m.span())
            out += [(kind, *span) for span in new]
            if new:
                block(new)
    for m in re.finditer(_TOKEN, text) if digit or at else ():
        token = m.group()
        if re.search("[0-9@]", token):
            start = m.start() + len(token) - len(token.lstrip(_MARKS))
            token = token.strip(_MARKS)
            if token and free(start, start + len(token)):
                out.append((plausible(token), start, start + len(token)))
    return out


def _code(value: str) -> int:
    return int.from_bytes(hashlib.blake2b(value.encode(), digest_size=8).digest(), "big", signed=True)


def patterns_at(text: str, start: int, end: int) -> list[str]:
    """The two tokens before a mention and the two after it, as far as its line holds them."""
    left = text[max(0, start - 48) : start].rsplit("\n", 1)[-1].lower()
    right = text[end : end + 48].split("\n", 1)[0].lower()
    before = re.findall(_AROUND, left)[-2:]
    after = re.findall(_AROUND, right)[:2]
    out = ["< " + " ".join(before)] if before else []
    return out + (["> " + " ".join(after)] if len(after) == 2 else [])


def found(docs: DataFrame) -> DataFrame:
    """One row per document, columns as in :data:`FOUND`: its base spans and all mentions."""
    schema = docs.sparkSession.createDataFrame([], FOUND).schema
    arrow = arrow_schema(schema)

    def mention(text, span, seed):
        kind, start, end = span
        instance = _code(f"{kind} {text[start:end].lower()}")
        around = patterns_at(text, start, end)
        return dict(
            kind=kind, start=start, end=end, seed=seed, instance=instance, patterns=around
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        next_row = TaskContext.get().partitionId() << 40
        for batch in batches:
            bases, mentions = [], []
            for text in batch.column(1).to_pylist():
                spans = base_spans(text)
                bases.append([dict(kind=k, start=s, end=e) for k, s, e in spans])
                mentions.append(
                    [mention(text, s, True) for s in spans]
                    + [mention(text, s, False) for s in loose_spans(text, spans)]
                )
            n = batch.num_rows
            columns = {
                "row_id": list(range(next_row, next_row + n)),
                "doc_id": batch.column(0),
                "key": batch.column(2),
                "base": bases,
                "mentions": mentions,
            }
            next_row += n
            yield record_batch(columns, arrow)

    keyed = texts(docs)
    return keyed.select("doc_id", "text", _key(keyed["text"])).mapInArrow(run, schema)


def _key(text):
    return F.unhex(F.md5(F.coalesce(text.cast("string"), F.lit(""))))


def beliefs(rows: DataFrame) -> DataFrame:
    """``kind``, ``instance`` and ``belief`` of the candidates that trusted patterns hold.

    ``rows`` is a written table of :func:`found`. A copied document adds no support, as
    patterns count distinct instances. Only patterns that could ever have enough
    support keep their edges.
    """
    edges = written(
        rows.select(F.explode("mentions").alias("m"))
        .select("m.kind", "m.instance", "m.seed", F.explode("m.patterns").alias("pattern"))
        .groupBy("kind", "pattern", "instance")
        .agg(F.max(F.col("seed").cast("int")).alias("seed")),
        "pii-edges",
    )
    by_kind = edges.groupBy("pattern", "kind").agg(
        F.sum("seed").alias("seeds"), F.count("*").alias("n")
    )
    total = by_kind.groupBy("pattern").agg(F.sum("n").alias("total"))
    wanted = (F.col("kind") != "other") & (F.col("n") >= SUPPORT)
    patterns = written(by_kind.where(wanted).join(total, "pattern"), "pii-patterns")
    unknown = spread_join(
        edges.where("seed = 0"), patterns.select("pattern", "kind"), ["pattern", "kind"], "instance"
    )
    unknown = written(unknown.select("kind", "pattern", "instance"), "pii-graph")
    out = unknown.select("kind", "instance", F.lit(0.0).alias("belief")).limit(0)
    for _ in range(ROUNDS):
        held = (
            spread_join(unknown, out, ["kind", "instance"], "pattern")
            .groupBy("pattern", "kind")
            .agg(
                F.sum("belief").alias("more"),
                F.sum((F.col("belief") >= BELIEVED).cast("long")).alias("known"),
            )
        )
        trust = (F.col("seeds") + F.coalesce("more", F.lit(0.0))) / F.col("total")
        trusted = (
            patterns.join(held, ["pattern", "kind"], "left")
            .where(F.col("seeds") + F.coalesce("known", F.lit(0)) >= SUPPORT)
            .select("pattern", "kind", trust.alias("trust"))
            .where(F.col("trust") >= TRUSTED)
        )
        doubt = F.log(1 - F.least(F.col("trust"), F.lit(0.999)))
        out = written(
            spread_join(unknown, trusted, ["pattern", "kind"], "instance")
            .groupBy("kind", "instance")
            .agg((1 - F.exp(F.sum(doubt))).alias("belief")),
            "pii-beliefs",
        )
    return out


def extracted(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``key`` (a digest of the text), ``base`` and ``spans`` of every row.

    Spans are arrays of (kind, start, end).

    ``spans`` holds the base spans and the discovered ones, by start and then kind; offsets
    are code points, ends exclusive. Null and empty texts have none; repeated rows are
    treated alike; other columns are ignored; no row gives no row. A text is searched in
    time linear in its length, and all its mentions are one row.
    """
    rows = written(found(docs), "pii-found")
    loose = (
        rows.select("row_id", F.explode("mentions").alias("m"))
        .where("NOT m.seed AND m.kind <> 'other'")
        .select("row_id", "m.kind", "m.instance", "m.start", "m.end")
    )
    known = beliefs(rows).where(F.col("belief") >= BELIEVED).select("kind", "instance")
    added = (
        spread_join(loose, known, ["kind", "instance"], "row_id")
        .groupBy("row_id")
        .agg(F.collect_list(F.struct("kind", "start", "end")).alias("added"))
    )
    ranks = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])
    both = F.concat("base", F.coalesce("added", F.array().cast(rows.schema["base"].dataType)))
    by_place = F.array_sort(
        F.transform(
            both,
            lambda s: F.struct(
                s["start"].alias("start"), ranks[s["kind"]].alias("rank"), s["end"].alias("end"),
                s["kind"].alias("kind"),
            ),
        )
    )
    plain = F.transform(
        by_place,
        lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")),
    )
    return rows.join(added, "row_id", "left").select(
        "doc_id", "key", "base", plain.alias("spans")
    )


def listed(spans: str):
    """``kind:start:end`` of an array of spans, joined by commas."""
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.concat_ws(",", F.transform(F.col(spans), one))


def digests(rows: DataFrame) -> DataFrame:
    """Counts of all spans by kind, a checksum of the base spans and the list of all."""
    def count(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    return rows.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(listed("base"), 256).alias("base_sha256"),
        listed("spans").alias("spans"),
    )


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with each span of personal data replaced by its kind in brackets.

    Columns and rows stay; ``n_chars``, where present, is the new length. Null texts
    stay null. Of overlapping spans the first gives the name, and all are covered.
    """
    an_id, a_key, a_text, a_list = unused(docs, "pii_id", "pii_key", "pii_text", "pii_spans")
    spans = (
        extracted(docs)
        .where("size(spans) > 0")
        .select(F.col("doc_id").alias(an_id), F.col("key").alias(a_key), "spans")
        .dropDuplicates([an_id, a_key])
        .withColumnRenamed("spans", a_list)
    )

    @F.pandas_udf("string")
    def replace(text: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series(
            [t if f is None or t is None else without(t, f) for t, f in zip(text, found)]
        )

    same = F.col("doc_id").cast("long").eqNullSafe(F.col(an_id))
    keyed = docs.withColumn(a_text, _key(F.col("text")))
    joined = keyed.join(spans, same & (F.col(a_text) == F.col(a_key)), "left")
    out = joined.withColumn("text", replace(F.col("text").cast("string"), a_list))
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        same = F.col(a_list).isNull()
        out = out.withColumn("n_chars", F.when(same, F.col("n_chars")).otherwise(length))
    return out.select(docs.columns)


def without(text: str, spans: list) -> str:
    """``text`` with the spans, given in order, replaced."""
    parts, at = [], 0
    for span in spans:
        kind, start, end = span["kind"], span["start"], span["end"]
        if start >= at:
            parts += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*parts, text[at:]])
