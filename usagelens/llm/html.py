"""Main text of web pages by suffix arrays over the token streams of a host.

Each page becomes a list of blocks and a stream of word tokens. The streams of a host are
concatenated, a suffix array orders all positions by what follows, and neighbours in that
order that agree for long enough but lie on different pages are boilerplate: menus,
notices and footers that the host repeats. What they cover is removed and the unique
runs are kept. Elements that are never content (menus, forms, scripts) do not count as
text of their page.

The articles that pages mark as such have arrays of their own. An article may quote what
others say, so there a run is boilerplate only if nearly all different articles of the host have
it, and only whole blocks are removed: notices and calls to subscribe that no name gives away. An
article that consists of such runs for the most part is a near copy of others and stays whole.

A host is dealt into shards of bounded size, each with its own suffix array. Where a host
has several shards, runs that repeat only across them are found by a join on their hashes. A
run that nearly all articles of a host have is one that nearly all of some shard have,
so those the arrays find there are counted over the whole host.
"""

import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from usagelens.llm.tables import arrow_schema, map_columns, record_batch, spread_join
from usagelens.session import written

#: Words of a repeated substring, at least (a power of two), and words of a shard, about.
RUN, SHARD = 8, 500_000
#: Of the different articles of a host: the share that has a run of boilerplate, and how many at least.
SHARE, ARTICLES = 0.8, 6
#: Copies of an article that may meet in a shard; of more than that one is looked at.
COPIES = 64

# --- fixed values: element names and marks of HTML --------------------------------------
_RAW = set("script style noscript template svg iframe textarea title select".split())
_CHROME = set("nav footer aside form button dialog menu head".split())
_BLOCK = set(
    "p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd div section article main table thead tbody tr td th "
    "caption blockquote pre figure figcaption hr body html header nav footer aside form fieldset "
    "address details summary center menu dialog head".split()
)
_MARKS = set(
    "ad ads advert adverts advertisement advertising sponsored promo cookie cookies consent "
    "notice banner sidebar menu nav navbar navigation footer comment comments disqus share social "
    "related breadcrumb breadcrumbs newsletter subscribe popup modal widget contentinfo "
    "complementary search".split()
)
# Words that may stand beside a mark in one name without another meaning.
_BESIDE = set(
    "area bar block body bottom box button buttons container content float footer form group head "
    "header inner item items left link links list main outer panel post posts right section site "
    "slot sticky text thread title top unit wrap wrapper".split()
)
_MARKED = set("div section ul ol dl p table span header figure".split())

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^<>]*>|"
    r"<(?P<end>/?)(?P<name>[A-Za-z][A-Za-z0-9:-]*)"
    r"(?P<rest>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>",
    re.S,
)
# Where a raw element ends, in the page itself: changing its case may change its length.
_ENDS = {name: re.compile("</" + name, re.I | re.A) for name in _RAW}
_ATTRIBUTES = re.compile(r"\b(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)


def blocks(page: str) -> list[tuple[str, str]]:
    """(zone, text) of the page's blocks in order: ``main``, ``open`` or ``chrome``.

    ``main`` is a marked article, ``chrome`` what is never content, ``open`` all else. A tag
    that meets another ``<`` before it ends is text, so a page is read in linear time.
    """
    out: list[tuple[str, str]] = []
    held: list[str] = []
    main, chrome = 0, []
    at = 0

    def close():
        text = " ".join(html.unescape("".join(held)).split())
        held.clear()
        if text:
            out.append(("chrome" if chrome else "main" if main else "open", text))

    while True:
        tag = _TAG.search(page, at)
        held.append(page[at : tag.start() if tag else len(page)])
        if not tag:
            close()
            return out
        at, name = tag.end(), (tag["name"] or "").lower()
        if name in _RAW and not tag["end"]:
            held.append(" ")
            if not tag["rest"].endswith("/"):
                stop = _ENDS[name].search(page, at)
                at = stop.start() if stop else len(page)
            continue
        if name in _BLOCK or chrome and name == chrome[-1]:
            close()
        elif name == "br":
            held.append(" ")
        if not name or tag["rest"].endswith("/"):
            continue
        if tag["end"]:
            if chrome and name == chrome[-1]:
                chrome.pop()
            elif name in ("article", "main"):
                main, chrome = max(0, main - 1), []
        elif name in ("article", "main"):
            # An article ends what was left open before it.
            main, chrome = main + 1, chrome if main else []
        elif chrome:
            if name == chrome[-1]:
                chrome.append(name)
        elif name in _CHROME or name == "header" and not main or _marked(name, tag["rest"]):
            close()
            chrome.append(name)


def _marked(name: str, rest: str) -> bool:
    if name not in _MARKED:
        return False
    names = " ".join(m.strip("\"'") for m in _ATTRIBUTES.findall(rest)).lower().split()
    return any(_is_mark([w for w in re.split(r"[^a-z]+", n) if w]) for n in names)


def _is_mark(words: list[str]) -> bool:
    """Whether a name means chrome: a mark, alone or beside words of layout only."""
    return not _MARKS.isdisjoint(words) and (_MARKS | _BESIDE).issuperset(words)


def own_blocks(found: list[tuple[str, str]]) -> tuple[list[str], list[str]]:
    """The page's candidate blocks, and the texts that form its stream.

    With a marked article its blocks are the candidates and the rest is the stream;
    otherwise all that is not chrome is both.
    """
    zone = "main" if any(z == "main" for z, _ in found) else "open"
    return [t for z, t in found if z == zone], [t for z, t in found if z != "main"]


def repeated(
    tokens: np.ndarray, pages: np.ndarray, streams: np.ndarray | None = None
) -> np.ndarray:
    """Which positions lie in a run of :data:`RUN` tokens that some other page has too.

    Pages with one number in ``streams`` are copies of each other and count as one.
    """
    return covered(len(tokens), run_starts(tokens, pages, streams))


def covered(n: int, starts: np.ndarray) -> np.ndarray:
    """Which of ``n`` positions lie in a run that begins at one of ``starts``."""
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, starts, 1)
    np.add.at(depth, starts + RUN, -1)
    return np.cumsum(depth[:n]) > 0


def run_starts(
    tokens: np.ndarray, pages: np.ndarray, streams: np.ndarray | None = None, least: float = 2
) -> np.ndarray:
    """Where the runs begin that at least ``least`` pages have.

    The suffix array is built by prefix doubling and stopped where suffixes agree in
    ``RUN`` tokens, which is all that decides about coverage.
    """
    n = len(tokens)
    if n < RUN:
        return np.zeros(0, np.int64)
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    width = 1
    while width < RUN:
        after = np.zeros(n, np.int64)
        after[: n - width] = rank[width:] + 1
        rank = np.unique(rank * (n + 1) + after, return_inverse=True)[1].astype(np.int64)
        width *= 2
    inside = np.zeros(n, bool)
    inside[: n - RUN + 1] = pages[RUN - 1 :] == pages[: n - RUN + 1]
    suffixes = np.flatnonzero(inside)
    if not len(suffixes):
        return suffixes
    told = (pages if streams is None else streams)[suffixes]
    order = np.lexsort((told, rank[suffixes]))
    suffixes, told = suffixes[order], told[order]
    ordered = rank[suffixes]
    opens = np.concatenate(([True], ordered[1:] != ordered[:-1]))
    first = np.flatnonzero(opens)
    other = opens | np.concatenate(([True], told[1:] != told[:-1]))
    having = np.add.reduceat(other.astype(np.int64), first)
    shared = np.repeat(having >= least, np.diff(np.append(first, len(suffixes))))
    return suffixes[shared]


def run_codes(tokens: np.ndarray) -> np.ndarray:
    """A hash of the run that begins at each position."""
    tokens = np.asarray(tokens, np.int64).astype(np.uint64)
    n = max(0, len(tokens) - RUN + 1)
    code = np.zeros(n, np.uint64)
    for k in range(RUN):
        code = code * np.uint64(0x9E3779B97F4A7C15) + tokens[k : k + n]
    return code.astype(np.int64)


def _codes(words: list[str]) -> list[int]:
    return [hash_word(w) for w in words]


def hash_word(word: str) -> int:
    import zlib

    data = word.encode("utf-8", "surrogatepass")
    return zlib.crc32(data) << 31 ^ zlib.adler32(data)


PARSED = (
    "row_id long, page_id long, url string, host string, candidates array<string>, "
    "stream array<long>, declared boolean"
)


def parsed(pages: DataFrame) -> DataFrame:
    """One row per page: its candidate blocks and the codes of its stream's words.

    ``declared`` tells whether the candidates are a marked article; otherwise they are
    read from the stream itself.
    """
    schema = pages.sparkSession.createDataFrame([], PARSED).schema
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        next_row = TaskContext.get().partitionId() << 40
        for batch in batches:
            ids, urls, sources = (column.to_pylist() for column in batch.columns)
            out = {name: [] for name in arrow.names}
            for page_id, url, source in zip(ids, urls, sources):
                found = blocks(source)
                candidates, stream = own_blocks(found)
                declared = any(z == "main" for z, _ in found)
                if not declared:  # candidates first, so that their words can be told
                    chrome = [t for z, t in found if z == "chrome"]
                    stream = [*candidates, *chrome]
                host = re.search(r"//([^/:?#\s]+)", url or "")
                out["row_id"].append(next_row)
                out["page_id"].append(page_id)
                out["url"].append(url)
                out["host"].append(host[1].lower() if host else "")
                out["candidates"].append(candidates)
                out["stream"].append(_codes(" ".join(stream).split()))
                out["declared"].append(declared)
                next_row += 1
            yield record_batch(out, arrow)

    given = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    )
    return given.mapInArrow(run, schema)


def _sharded(rows: DataFrame) -> DataFrame:
    """The streams with their host's number of shards and their own one."""
    streams = rows.where("size(stream) > 0").select(
        "row_id", "host", "stream", "declared", F.xxhash64("stream").alias("same")
    )
    shards = F.ceil(F.sum(F.size("stream")) / SHARD).alias("shards")
    hosts = streams.groupBy("host").agg(shards)
    dealt = F.pmod(F.xxhash64("row_id"), F.col("shards")).alias("shard")
    return spread_join(streams, hosts, ["host"], "row_id").select("*", dealt)


def _within(streams: DataFrame) -> DataFrame:
    """``row_id`` and covered ``places`` of pages without a marked article, shard by shard."""

    def cover(shard: pd.DataFrame) -> pd.DataFrame:
        sizes = shard["stream"].map(len).to_numpy()
        page = np.repeat(np.arange(len(shard)), sizes)
        same = np.repeat(shard["same"].to_numpy(), sizes)
        inside = repeated(np.concatenate(shard["stream"].to_list()), page, same)
        flags = np.split(inside, np.cumsum(sizes)[:-1])
        places = [np.flatnonzero(f) for f in flags]
        out = pd.DataFrame({"row_id": shard["row_id"], "places": places})
        return out[~shard["declared"] & out["places"].map(len).gt(0)]

    return streams.groupBy("host", "shard").applyInPandas(
        cover, "row_id long, places array<long>"
    )


def _across(streams: DataFrame) -> DataFrame:
    """The same for runs that pages of different shards of one host share."""

    def windows(batch):
        out = {"host": [], "code": [], "row_id": [], "place": [], "declared": [], "same": []}
        columns = (batch[c] for c in ("host", "row_id", "stream", "declared", "same"))
        for host, row, stream, declared, same in zip(*columns):
            codes = run_codes(stream)
            n = len(codes)
            out["code"] += codes.tolist()
            out["place"] += range(n)
            once = {"host": host, "row_id": row, "declared": declared, "same": same}
            for name, value in once.items():
                out[name] += [value] * n
        return out

    split = streams.where("shards > 1").select("host", "row_id", "stream", "declared", "same")
    kinds = "host string, code long, row_id long, place long, declared boolean, same long"
    runs = map_columns(split, windows, kinds)
    shared = (
        runs.groupBy("host", "code")
        .agg(F.min("same").alias("first"), F.max("same").alias("last"))
        .where("first <> last")
        .select("host", "code")
    )
    spread = F.explode(F.sequence(F.col("place"), F.col("place") + RUN - 1))
    return (
        spread_join(runs.where("NOT declared"), shared, ["host", "code"], "row_id")
        .groupBy("row_id")
        .agg(F.collect_set("place").alias("starts"))
        .select("row_id", F.explode("starts").alias("place"))
        .select("row_id", spread.alias("place"))
        .groupBy("row_id")
        .agg(F.collect_set("place").alias("places"))
    )


def _words(text: Column) -> Column:
    return F.split(text, " ")


def _few_copies(articles: DataFrame) -> DataFrame:
    """The marked articles, of those that have many copies one."""
    equal = articles.groupBy("same").agg(F.min("row_id").alias("kept"), F.count("*").alias("n"))
    copied = written(equal.where(F.col("n") > COPIES).drop("n"), "copied-articles")
    both = spread_join(articles, copied, ["same"], "row_id", "left")
    return both.where("kept IS NULL OR kept = row_id").drop("kept")


def common_runs(articles: DataFrame) -> DataFrame:
    """By ``host``, the ``codes`` of the runs that nearly all of its different articles have.

    The arrays are over half the bits of a word's code, so they find those runs and by chance some
    more; whole codes are counted. What is small (figures of hosts, the runs) is written, so that
    its joins need not move articles.
    """
    few = _few_copies(articles)
    figures = [F.ceil(F.sum("words") / SHARD).alias("shards"), F.countDistinct("same").alias("articles")]
    hosts = written(few.groupBy("host").agg(*figures).where(F.col("articles") >= ARTICLES), "hosts")

    def find(shard: pd.DataFrame) -> pd.DataFrame:
        own = shard.drop_duplicates("same")
        page = np.repeat(np.arange(len(own)), own["halves"].map(len))
        tokens = np.concatenate(own["halves"].to_list())
        starts = run_starts(tokens, page, least=SHARE * len(own))
        codes = np.unique(run_codes(tokens)[starts])
        host = pd.Series([own["host"].iloc[0]] * len(codes), dtype=object)
        return pd.DataFrame({"host": host, "code": codes})

    def having(batch):
        out = {"host": [], "code": [], "same": []}
        columns = (batch[c] for c in ("host", "same", "stream", "codes"))
        for host, same, stream, codes in zip(*columns):
            asked = np.isin(run_codes(np.array(stream, np.int64) >> 16), codes)
            own = np.unique(run_codes(stream)[asked])
            out["host"] += [host] * len(own)
            out["code"] += own.tolist()
            out["same"] += [same] * len(own)
        return out

    codes = F.collect_set("code").alias("codes")
    halves = F.transform("stream", lambda w: F.shiftright(w, 16).cast("short")).alias("halves")
    dealt = F.pmod(F.xxhash64("same"), F.col("shards")).alias("shard")
    streams = few.select("row_id", "host", "same", halves)
    shards = spread_join(streams, hosts, ["host"], "row_id").select("host", dealt, "same", "halves")
    found = shards.groupBy("host", "shard").applyInPandas(find, "host string, code long")
    found = written(found.groupBy("host").agg(codes), "found-runs")
    asked = spread_join(few, found, ["host"], "row_id").select("host", "same", "stream", "codes")
    counted = map_columns(asked, having, "host string, code long, same long")
    counts = counted.groupBy("host", "code").agg(F.countDistinct("same").alias("n"))
    common = counts.join(hosts, "host").where(
        (F.col("n") >= ARTICLES) & (F.col("n") >= SHARE * F.col("articles"))
    )
    return written(common.groupBy("host").agg(codes), "common-runs")


def common_blocks(rows: DataFrame) -> DataFrame:
    """``row_id`` and the places of the ``common`` blocks of marked articles that have any.

    Common is a block that common runs cover, in an article that they cover by half at most.
    """
    text = F.array_join("candidates", " ")
    articles = rows.where("declared").select(
        "row_id",
        "host",
        "same",
        "words",
        F.transform(_words(text), lambda w: F.hash(w)).alias("stream"),
        F.transform("candidates", lambda block: F.size(_words(block))).alias("sizes"),
    )

    def cover(batch):
        out = {"row_id": [], "common": []}
        columns = (batch[c] for c in ("row_id", "stream", "sizes", "codes"))
        for row, stream, sizes, codes in zip(*columns):
            inside = covered(len(stream), np.flatnonzero(np.isin(run_codes(stream), codes)))
            whole = np.logical_and.reduceat(inside, np.cumsum(sizes) - sizes)
            if whole.any() and 2 * inside.sum() <= len(inside):
                out["row_id"].append(row)
                out["common"].append(np.flatnonzero(whole).tolist())
        return out

    asked = spread_join(articles, common_runs(articles), ["host"], "row_id")
    asked = asked.select("row_id", "stream", "sizes", "codes")
    return written(map_columns(asked, cover, "row_id long, common array<int>"), "common-blocks")


def unique_runs(candidates: list[str], places: list[int]) -> str:
    """The blocks without the words at ``places``, counted through all of them."""
    covered, at, out = set(places), 0, []
    for block in candidates:
        words = block.split(" ")
        kept = " ".join(w for i, w in enumerate(words, at) if i not in covered)
        at += len(words)
        if kept:
            out.append(kept)
    return "\n\n".join(out)


def main_text(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url`` and the main ``text`` of every page.

    White space inside a block is one space, blocks are joined by an empty line in page
    order, character references are decoded. A page with a marked article gives all of
    that article but its menus, forms, comments and the like, and blocks that nearly all
    articles of its host have; any other page gives the
    runs of its text that its host does not repeat. Null and empty pages give an empty
    text. A row without a url belongs to one host of its own. Copies of a page with the
    same words count as one page, so they do not remove one another. Very long pages are read in
    linear time. Other columns are ignored; no row gives no row.
    """
    text = F.array_join("candidates", " ")
    figures = {"same": F.xxhash64("host", "candidates"), "words": F.size(_words(text))}
    rows = written(parsed(pages).withColumns(figures), "pages-parsed", compression="zstd")
    streams = _sharded(rows)
    places = _within(streams).unionByName(_across(streams))
    merged = places.groupBy("row_id").agg(
        F.array_distinct(F.flatten(F.collect_list("places"))).alias("places")
    )

    @F.pandas_udf("string")
    def keep(candidates: pd.Series, places: pd.Series) -> pd.Series:
        return pd.Series([unique_runs(c, p) for c, p in zip(candidates, places)])

    left = F.filter("candidates", lambda _, i: ~F.array_contains("common", i))
    own = F.when(F.col("common").isNull(), F.col("candidates")).otherwise(left)
    none = F.array().cast("array<long>")
    marked = (
        rows.where("declared")
        .join(common_blocks(rows), "row_id", "left")
        .select("page_id", "url", F.concat_ws("\n\n", own).alias("text"))
    )
    other = (
        rows.where("NOT declared")
        .join(merged, "row_id", "left")
        .select("page_id", "url", keep("candidates", F.coalesce("places", none)).alias("text"))
    )
    return marked.unionByName(other)
