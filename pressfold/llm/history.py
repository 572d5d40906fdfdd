"""Each batch of records against everything accepted before.

Two records are the same article if their links lead to the same page, or if
one source gave them the same headline but for case, punctuation, white space,
labels and one slip of typing (a letter left out, added, replaced or swapped
with its neighbour) outside of numbers.

Headlines one slip apart are found with a segment index: a headline is cut into
``SEGMENTS`` parts, stored under source, numbers, length, place and content. A
slip leaves at least one part whole; what stands before a slip keeps its place,
what follows moves by the difference in length, so few substrings of a new
headline are looked up. Candidates must agree in the parities of their letters
up to two, then are verified. An entry that more than ``HOT`` headlines share is
split by a second key: the headline without one of its letters, which two
headlines one slip apart have in common; so headlines of one pattern are not
compared pair by pair. The index holds one entry for each distinct headline of a
source; accepting a batch appends its segments.

The stored history is divided into buckets by the hash of what is looked up.
Everything is asked for by the batch's own keys, entries, headlines and ids, and
only the buckets that these fall into are read, so a batch that is small against
the number of buckets reads the same from a long history as from a short one, as
long as the number of buckets was chosen with its length.

Which of a batch's records count as accepted depends on their order: rounds
decide each record as soon as everything before it that it matches is decided.

Defined results: a null or blank link matches no link; a null, blank or purely
punctuated title, or a null source, matches no headline; records without an id
are left out; of rows that repeat an id one counts; an empty history or batch
finds nothing in it.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import ClassVar
from urllib.parse import unquote

import pandas as pd
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pressfold.session import once, stored

SEGMENTS = 3
#: Headlines of fewer characters must agree exactly: one letter of them is a fifth of a name or more, another term and no slip.
SHORTEST = 6
#: Headlines of one entry from which on a second key divides them.
HOT = 64
#: Rows of history for each bucket of its stored tables, and the most buckets that are made by default; they change no result.
BUCKET_ROWS, MOST_BUCKETS = 200_000, 10_000

# Query fields that do not change a page.
TRACKING = re.compile(r"^(utm_\w+|fbclid|gclid|dclid|msclkid|yclid|igshid|mc_cid|mc_eid|ref|ref_src|source|share|spm)$")
# Words of labels that are no part of a headline.
LABELS = "new|updated?|repost(?:ed)?|re-?upload(?:ed)?|notice|announcement|breaking|edited|corrected|업데이트|재게시|재업로드|공지|신규|수정|속보|안내"
SITE_WORDS = r"(?:기술\s*블로그|테크\s*블로그|블로그|tech(?:nology)?\s+blog|engineering\s+blog|developers?\s+blog|blog)"
_HEAD_LABEL = re.compile(rf"^\W*[\[(【<]\s*(?:{LABELS})\s*[\])】>]\s*", re.IGNORECASE)
_TAIL_LABEL = re.compile(rf"\s*[\[(【<]\s*(?:{LABELS})\s*[\])】>]\W*$", re.IGNORECASE)
_SITE_TAIL = re.compile(r"^(.*\S)\s+(?:[-–—|:·•/»]+)\s+(.+?)\s*$", re.DOTALL)
_SITE_HEAD = re.compile(r"^\s*(\S.*?)\s+(?:[-–—|:·•/»]+)\s+(\S.*)$", re.DOTALL)
_SITE_WORDS_TAIL = re.compile(rf"\s*{SITE_WORDS}\s*$", re.IGNORECASE)
_OTHER = re.compile(r"[\W_]+")
_NUMBERS = re.compile(r"\d+")


def page_of(link: str | None) -> str | None:
    """The page a link leads to, however it is written, transported or tracked."""
    link = (link or "").strip()
    if not link:
        return None
    if "%" in link:
        link = unquote(link)
    link = link.lower().partition("#")[0]
    scheme, mark, rest = link.partition("://")
    rest = rest if mark else scheme
    rest, _, query = rest.partition("?")
    host, _, path = rest.partition("/")
    host = host.partition("@")[2] or host
    host = re.sub(r":\d*$", "", host).rstrip(".")
    host = re.sub(r"^(?:www\d?|m|amp)\.", "", host)
    path = "/".join(p for p in path.split("/") if p)
    fields = sorted({f for f in re.split("[&;]", query) if f and not TRACKING.match(f.partition("=")[0])})
    return f"{host}/{path}?{'&'.join(fields)}"


def headline_of(title: str | None, site: str | None) -> str:
    """The letters and digits of a headline in lower case, without labels; ``site`` is the source's name."""
    text = title or ""
    for _ in range(3):
        shorter = _TAIL_LABEL.sub("", _HEAD_LABEL.sub("", text))
        for found, label, rest in ((_SITE_TAIL.match(shorter), 2, 1), (_SITE_HEAD.match(shorter), 1, 2)) if site else ():
            name = _OTHER.sub("", _SITE_WORDS_TAIL.sub("", found.group(label)).lower()) if found else ""
            if name and name == _OTHER.sub("", site.lower()):
                shorter = found.group(rest)
                break
        if shorter == text:
            break
        text = shorter
    return _OTHER.sub("", text.lower())


def one_slip(a: str, b: str) -> bool:
    """Whether two different texts are one letter left out, added, replaced or swapped apart, outside of numbers."""
    if abs(len(a) - len(b)) > 1 or _NUMBERS.findall(a) != _NUMBERS.findall(b):
        return False
    if len(a) > len(b):
        a, b = b, a
    k = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    if len(a) < len(b):
        return not b[k].isdigit() and a[k:] == b[k + 1 :]
    if a[k:][:1].isdigit() or b[k:][:1].isdigit():
        return False
    return a[k + 1 :] == b[k + 1 :] or (a[k : k + 2] == b[k : k + 2][::-1] and a[k + 2 :] == b[k + 2 :])


def _bounds(length: int) -> list[tuple[int, int]]:
    """Start and size of each segment of a headline of ``length`` characters."""
    size, longer = divmod(length, SEGMENTS)
    out, at = [], 0
    for k in range(SEGMENTS):
        own = size + (k >= SEGMENTS - longer)
        out.append((at, own))
        at += own
    return out


def _hash(*parts: object) -> int:
    return xxhash.xxh3_64_intdigest("\x01".join(map(str, parts)).encode("utf-8", "surrogatepass")) - (1 << 63)


def segments(base: str, text: str) -> list[int]:
    """The entries of a headline in the index; ``base`` names its source and numbers."""
    return [_hash(base, len(text), k, text[a : a + n]) for k, (a, n) in enumerate(_bounds(len(text)))]


def probes(base: str, text: str) -> list[int]:
    """The entries under which headlines one slip away from ``text`` share a segment with it."""
    out = set()
    for length in (len(text) - 1, len(text), len(text) + 1):
        moved = len(text) - length
        for k, (a, n) in enumerate(_bounds(length)):
            shifts = {0} if k == 0 else {moved} if k == SEGMENTS - 1 else {0, moved}
            for s in shifts:
                if a + s >= 0 and a + s + n <= len(text):
                    out.add(_hash(base, length, k, text[a + s : a + s + n]))
    return sorted(out)


def parity(text: str) -> int:
    """A bit for each of 63 classes of letters that says whether they are odd in number."""
    bits = 0
    for c in text:
        bits ^= 1 << (ord(c) * 2654435761 >> 7) % 63
    return bits


def _digest(text: str) -> bytes:
    return xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass"))


def prepare(records: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """(id, page, head, base, text): keys of the page and of source and headline, the source with the numbers, the headline.

    ``records`` needs id, corporation_id, title and link; ``sources`` has id
    and name, which may follow a headline as a label.
    """
    own = once(records.select("id", "corporation_id", "title", "link").where("id is not null"), "id")
    if sources is None:
        own = own.withColumn("site", F.lit(None).cast("string"))
    else:
        names = sources.groupBy(F.col("id").alias("corporation_id")).agg(F.min("name").alias("site"))
        own = own.join(names, "corporation_id", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            pages, heads, bases, texts = [], [], [], []
            for corporation, title, link, site in zip(b["corporation_id"], b["title"], b["link"], b["site"], strict=True):
                page = page_of(link)
                text = headline_of(title, site) if title and not pd.isna(corporation) else ""
                source = str(int(corporation)) if text else ""
                pages.append(_digest(page) if page else None)
                heads.append(_digest(f"{source}\x01{text}") if text else None)
                bases.append(f"{source} {' '.join(_NUMBERS.findall(text))}" if text else None)
                texts.append(text or None)
            yield pd.DataFrame({"id": b["id"], "page": pages, "head": heads, "base": bases, "text": texts})

    columns = own.select("id", F.col("corporation_id").cast("double").alias("corporation_id"), "title", "link", "site")
    return columns.mapInPandas(run, "id bigint, page binary, head binary, base string, text string")


def headlines(prepared: DataFrame) -> DataFrame:
    """One row for each distinct headline of a source."""
    return prepared.where("head is not null").groupBy("head").agg(F.first("base").alias("base"), F.first("text").alias("text"))


def entries(heads: DataFrame, probe: bool) -> DataFrame:
    """(entry, head, parity) of the headlines' segments, or of the substrings to look up."""
    cut = probes if probe else segments

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"entries": [cut(x, t) for x, t in zip(b["base"], b["text"], strict=True)], "head": b["head"], "parity": [parity(t) for t in b["text"]]})

    found = heads.where(F.length("text") >= SHORTEST).select("head", "base", "text").mapInPandas(run, "entries array<bigint>, head binary, parity bigint")
    return found.select(F.explode("entries").alias("entry"), "head", "parity")


def variants(base: str, text: str) -> list[int]:
    """Hashes of a headline and of it without each of its letters; two headlines one slip apart share one of them."""
    return [_hash(base, text), *{_hash(base, text[:k] + text[k + 1 :]) for k, c in enumerate(text) if not c.isdigit()}]


def _divided(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """Entries (entry, head) by their second key."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"entry": b["entry"], "head": b["head"], "variants": [variants(x, t) for x, t in zip(b["base"], b["text"], strict=True)]})

    found = rows.join(texts, "head").select("entry", "head", "base", "text").mapInPandas(run, "entry bigint, head binary, variants array<bigint>")
    return found.select("entry", F.explode("variants").alias("variant"), "head")


def slips(new_heads: DataFrame, history: History) -> DataFrame:
    """(head, other): headlines of the batch with those of the history or the batch that are one slip away."""
    looked_up = stored(entries(new_heads, probe=True))
    stock = history.near("index", "entry", looked_up.select("entry")).select("entry", "head", "parity").unionByName(entries(new_heads, probe=False))
    stock = stored(stock)
    hot = stored(stock.groupBy("entry").count().where(F.col("count") > HOT).select("entry"))
    named = lambda rows: rows.withColumnsRenamed({"head": "other", "parity": "other_parity"})
    near = F.bit_count(F.col("parity").bitwiseXOR(F.col("other_parity"))) <= 2
    looks, stocks = (looked_up, stock) if hot.isEmpty() else (looked_up.join(hot, "entry", "left_anti"), stock.join(hot, "entry", "left_anti"))
    pairs = looks.join(named(stocks), "entry").where(near & (F.col("head") != F.col("other"))).select("head", "other")
    own = new_heads.select("head", "base", "text")
    if not hot.isEmpty():
        many = stock.join(hot, "entry", "left_semi")
        known = stored(history.near("heads", "head", many.select("head")).select("head", "base", "text").unionByName(own).dropDuplicates(["head"]))
        split = _divided(looked_up.join(hot, "entry", "left_semi"), own).join(named(_divided(many, known)), ["entry", "variant"])
        pairs = pairs.unionByName(split.where("head <> other").select("head", "other"))
    pairs = stored(pairs.distinct())
    texts = history.near("heads", "head", pairs.select(F.col("other").alias("head"))).select("head", "base", "text").unionByName(own).dropDuplicates(["head"]).select(F.col("head").alias("other"), F.col("text").alias("other_text"))
    pairs = pairs.join(own.select("head", "text"), "head").join(texts, "other")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.loc[[one_slip(x, y) for x, y in zip(b["text"], b["other_text"], strict=True)], ["head", "other"]]

    return pairs.select("head", "other", "text", "other_text").mapInPandas(run, "head binary, other binary")


def _keys(rows: DataFrame, *columns: str) -> DataFrame:
    """(key, columns) of the pages and headlines of rows."""
    kinds = F.array(F.concat(F.lit(b"p"), F.col("page")), F.concat(F.lit(b"h"), F.col("head")))
    return rows.select(F.explode(kinds).alias("key"), *columns).where("key is not null")


@dataclass
class History:
    """What is known of the accepted records: their keys, the records by id, distinct headlines and segments."""

    keys: DataFrame
    records: DataFrame
    heads: DataFrame
    index: DataFrame
    buckets: int = 0

    #: What each table is looked up by.
    COLUMNS: ClassVar[dict[str, str]] = {"keys": "key", "records": "id", "heads": "head", "index": "entry"}

    @staticmethod
    def of(prepared: DataFrame) -> History:
        heads = headlines(prepared)
        return History(_keys(prepared, "id"), prepared.select("id", "page", "head"), heads, entries(heads, probe=False))

    @staticmethod
    def read(spark: SparkSession, path: str) -> History:
        """The history kept in a folder by ``append``."""
        buckets = spark.read.parquet(f"{path}/layout").first()[0]
        return History(*(spark.read.parquet(f"{path}/{name}") for name in History.COLUMNS), buckets)

    def append(self, path: str, buckets: int | None = None) -> None:
        """Add these records to the history kept in a folder; a headline that it holds already may be stored again.

        The first call sets the number of buckets, by default one for each ``BUCKET_ROWS`` of its records, at most ``MOST_BUCKETS``.
        """
        spark = self.records.sparkSession
        try:
            buckets = spark.read.parquet(f"{path}/layout").first()[0]
        except AnalysisException:
            buckets = buckets or min(MOST_BUCKETS, 1 + self.records.count() // BUCKET_ROWS)
            spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.parquet(f"{path}/layout")
        for name, column in self.COLUMNS.items():
            rows = getattr(self, name).drop("bucket").withColumn("bucket", _bucket(column, buckets))
            rows.hint("rebalance", "bucket").write.mode("append").partitionBy("bucket").parquet(f"{path}/{name}")

    def near(self, name: str, column: str, wanted: DataFrame) -> DataFrame:
        """The rows of a table that have one of the wanted values; only the buckets of these are read."""
        rows = getattr(self, name)
        if self.buckets > 1:
            touched = [r[0] for r in wanted.select(_bucket(column, self.buckets).alias("b")).distinct().collect()]  # at most one for each bucket
            rows = rows.where(F.col("bucket").isin(touched)) if len(touched) < self.buckets else rows
        return rows.drop("bucket").join(wanted.select(column).distinct(), column, "left_semi")


def _bucket(column: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(buckets)).cast("int")


def _minima(keyed: DataFrame, *columns: str) -> DataFrame:
    """(key, column minima); every key is aggregated before the shuffle."""
    return keyed.groupBy("key").agg(*(F.min(c).alias(c) for c in columns))


def _best(found: DataFrame, *columns: str) -> DataFrame:
    return found.groupBy("id").agg(*(F.min(c).alias(c) for c in columns))


def check_batch(batch: DataFrame, history: History) -> DataFrame:
    """(first_id, dup_id) of the records of a prepared batch that were accepted before, in the batch or in the history."""
    batch = stored(batch)
    own_heads = stored(headlines(batch))
    near = slips(own_heads, history)

    # what each record looks at: its page, its headline and the headlines one slip away
    own_keys = _keys(batch, "id")
    near = stored(near.select("head", F.concat(F.lit(b"h"), F.col("other")).alias("key")))
    looks = own_keys.select("id", "key").unionByName(batch.select("id", "head").join(near, "head").select("id", "key"))

    # accepted records of the history: the smallest id of each key that the batch looks at
    past = history.near("keys", "key", own_keys.select("key").union(near.select("key")))
    of_key = stored(_minima(past.withColumnRenamed("id", "accepted"), "accepted"))
    new_of_key = _minima(own_keys.withColumnRenamed("id", "open"), "open")
    both = looks.join(of_key, "key", "left").join(new_of_key, "key", "left")
    state = _best(both.select("id", "accepted", "open"), "accepted", "open")
    # a record that sees neither an accepted record nor an earlier one of its batch is new and looks no further
    involved = state.where("accepted < id or open < id").select("id")
    touched = stored(looks.join(involved, "id", "left_semi").join(of_key, "key", "left").select("id", "key", "accepted"))
    certain = touched.where("accepted < id").groupBy("id").agg(F.min("accepted").alias("first_id"))
    decided = stored(certain)

    # batch records that may be accepted and be matched by others: those not decided as cases
    waiting = stored(touched.select("id").distinct().join(decided, "id", "left_anti"))
    inner = stored(touched.select("id", "key").join(waiting, "id", "left_semi"))
    offered = stored(own_keys.join(decided.select("id"), "id", "left_anti").join(inner.select("key").distinct(), "key", "left_semi"))
    while not waiting.isEmpty():  # every round decides the smallest that waits, at least
        # the smallest candidate of each key that is not a case; what is not waiting is accepted
        live = offered.join(waiting.withColumn("pending", F.lit(True)), "id", "left")
        minima = live.groupBy("key").agg(F.min(F.when(F.col("pending").isNull(), F.col("id"))).alias("accepted"), F.min("id").alias("open"))
        seen = stored(_best(inner.join(waiting, "id", "left_semi").join(minima, "key", "left").select("id", "accepted", "open"), "accepted", "open"))
        cases = seen.where("accepted < id").select("id", F.col("accepted").alias("first_id"))
        fresh = seen.where("(accepted is null or accepted >= id) and (open is null or open >= id)").select("id")
        decided = decided.unionByName(cases)
        waiting = stored(waiting.join(cases, "id", "left_anti").join(fresh, "id", "left_anti"))
        offered = stored(offered.join(cases, "id", "left_anti"))
    return _first_of_article(decided, batch, history, touched, of_key)


def _first_of_article(decided: DataFrame, batch: DataFrame, history: History, touched: DataFrame, of_key: DataFrame) -> DataFrame:
    """Replace the first match by the smallest accepted id of the article that the match belongs to."""
    cases = stored(decided.select("id", "first_id"))
    own = batch.select("id", "page", "head").join(cases, "id", "left_anti")
    posted = _keys(own, F.col("id").alias("least"))
    mine = stored(_minima(posted.unionByName(of_key.withColumnRenamed("accepted", "least")), "least"))
    matched = touched.select("id", "key").join(cases.select("id"), "id", "left_semi").join(mine, "key").where("least < id")
    # one step on: the other key of that record may belong to a smaller one
    first = stored(_best(matched.select("id", "least"), "least").select(F.col("id").alias("dup_id"), F.col("least").alias("id")))
    found = history.near("records", "id", first.select("id")).select("id", "page", "head").unionByName(own.join(first.select("id").distinct(), "id", "left_semi"))
    on = stored(_keys(first.join(found, "id"), "dup_id"))
    wanted = on.select("key").distinct()
    past = history.near("keys", "key", wanted).select("key", F.col("id").alias("least"))
    least = _minima(past.unionByName(posted.join(wanted, "key", "left_semi")), "least")
    return on.join(least, "key").groupBy("dup_id").agg(F.min("least").alias("first_id")).select("first_id", "dup_id")


def check_batches(batches: Iterable[DataFrame], history: History, path: str) -> DataFrame:
    """(first_id, dup_id) of prepared batches in their order, each against the history kept in the folder ``path``, to which its accepted records are added."""
    history.append(path)
    found = None
    for batch in batches:
        batch = stored(batch)
        cases = stored(check_batch(batch, History.read(batch.sparkSession, path)))
        History.of(stored(batch.join(cases.select(F.col("dup_id").alias("id")), "id", "left_anti"))).append(path)
        found = cases if found is None else found.unionByName(cases)
    return history.records.sparkSession.createDataFrame([], "first_id bigint, dup_id bigint") if found is None else found
