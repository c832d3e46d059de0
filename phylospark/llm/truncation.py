"""Texts that were cut off, by a backward character n-gram model.

The model reads backwards from a position: for each suffix of the text before it, of 1 to 18 characters, it knows how often the suffix
occurs in all texts, and how often a text or sentence ends there. For a value's final context the two are compared: the
chance of meeting it where a text just stops somewhere (as often as it occurs) against where one ends, backing off from long
suffixes to shorter ones, each value's own end left out. These log-odds are the column `context`. A column `length` has the evidence of a field's
limit, if values of the source stop at just this length (in characters or bytes) far more often than they go beyond: by how much its log-odds
are above the language's prior. The value is cut if their sum, `score`, is above the threshold of its language and column, the negative prior log-odds
of a cut, which are learnt by expectation maximization.

Counts are over all texts. The model has the suffixes that values end with, all of them at any size; only these are counted and shuffled. With at most
CONTEXTS of them scoring is a map over the values with the model at hand; with more, which no executor could hold, the model is a table that is joined
to the values' suffixes. Both give the same scores.

Defined results: null and blank texts are not cut and have no row in `scores`; repeated texts count once as ends of texts; a null
language or source is one of its own; languages are compared in lower case; a text is compared with what is inside of all texts, its own too.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from phylospark.operators.bitmaps import bitmap, in_bitmap
from phylospark.operators.ranges import HOT_ROWS, join_same, join_skewed, join_unique
from phylospark.runtime import is_small, materialize

ORDERS = (1, 2, 3, 4, 6, 8, 11, 14, 18)
#: Most suffixes of a model that is sent to all, 20 bytes each.
CONTEXTS = 1 << 23
#: Bits of the bitmap of wanted suffixes for each, and at most, as a power of two (32 MB). With more suffixes than BLOCK the texts are counted in several passes.
BITS_EACH, MOST_BITS = 16, 28
BLOCK = 1 << 25
#: Weight of the shorter suffix, in occurrences.
BACKOFF = 0.5
#: How much an end of a sentence counts as an end without its closing mark: about the share of complete texts written without one.
UNMARKED = 0.05
#: Most of a share of stops at a length that is believed: so little that a text ending with a closed sentence is never cut by its length alone.
MOST_STOP = 0.96
#: Rounds of scoring; from the second on, values found to be cut no longer serve as examples of ends.
ROUNDS = 2
#: Sizes of the log-odds' bins for learning the prior.
BIN = 0.25
#: What is believed of the share of cut values before any is seen: this share, with the weight of so many values.
START, WEIGHT = 0.05, 20
#: A limit in bytes cuts before the character that goes beyond it.
CHAR_BYTES = 4
#: Characters that are hashed at once, so that they stay in the processor's cache; occurrences of an order after which a task sums them up; sums that it holds.
CACHED, PENDING, HELD = 100_000, 1_000_000, 3_000_000
#: Characters at a text's end that are enough for its longest suffix, if so many are left after taking runs of digits and blanks together.
TAIL, ENOUGH = 256, 64

#: What a cut may leave behind a text: dots, a broken character, a piece of an entity; and marks that may close a part or a whole.
_LEFT_BEHIND = re.compile(r"(?:…|\.{2,}|\[(?:\.+|…)\]|�|&#?[A-Za-z0-9]{0,6}|[:;：；])\Z")
#: What no complete text ends with.
_OPEN = tuple(ord(c) for c in ",([{«“„-–—/、，（「『")
#: Closing marks inside of a text, which end a sentence if group 1 follows, blanks with a capital or an opening mark; full-width marks do with
#: anything. A run of marks is taken as a whole, whether it ends a sentence or not, so that long ones take no more than one pass.
_MARKS = re.compile(r"[.!?…][.!?…]*+[\"»”“’')\]]*+(?=(\s++[^\s\da-zà-öø-ÿа-я.,;:)\]])?)|([。！？])[。！？]*+[”」』）]*+")
_CLOSING = re.compile(r"[.!?…。！？]+[\"»”“’')\]」』）]*\Z")
_WINDOW = 40
_DIGITS, _BLANKS = re.compile(r"\d+"), re.compile(r"\s+")
_MUL = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(29)
#: Characters from here on are neither digits nor blanks and have no case.
_PLAIN = 0x20000


def _stripped(text: str) -> str:
    """Without blanks and what a cut left behind at the end."""
    while True:
        text = text.rstrip()
        tail = text[-_WINDOW:]
        m = _LEFT_BEHIND.search(tail)
        if not m:
            return text
        text = text[: len(text) - len(tail) + m.start()]


@functools.cache
def _classes() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By character: its lower case, whether it is a digit, whether it is a blank. The last entry stands for all from _PLAIN on."""
    chars = [chr(c) for c in range(_PLAIN)]
    lower = np.array([ord(x) if len(x := c.lower()) == 1 else ord(c) for c in chars] + [0], dtype=np.uint32)
    return lower, np.array([bool(_DIGITS.match(c)) for c in chars] + [False]), np.array([c.isspace() for c in chars] + [False])


class Prepared:
    """Texts as the model reads them, one behind the other: each after a line end, in lower case, with runs of digits as one 0 and runs of blanks as one blank."""

    def __init__(self, texts: list[str], ends: bool = True) -> None:
        texts = [_stripped(x).lstrip() for x in texts]
        raw = "\n" + "\n".join(texts) if texts else ""
        codes = np.frombuffer(raw.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        begin = np.concatenate([[0], np.cumsum([len(x) + 1 for x in texts])]).astype(np.int64)
        first = np.zeros(len(codes), dtype=bool)
        first[begin[:-1]] = True
        lower, digits, blanks = _classes()
        at = np.minimum(codes, _PLAIN)
        low, digit, blank = lower[at], digits[at], blanks[at] & ~first
        np.copyto(low, codes, where=at == _PLAIN)
        low[digit], low[blank] = ord("0"), ord(" ")
        keep = np.ones(len(codes), dtype=bool)
        keep[1:] = ~(digit[1:] & digit[:-1] | blank[1:] & blank[:-1])
        place = np.cumsum(keep) - 1
        self.codes = low[keep].astype(np.uint64)
        self.starts = np.concatenate([place[begin[:-1]], [len(self.codes)]])
        if not ends:
            return
        #: Positions of the last characters before and of closing marks.
        spans = [(m.start(), m.end()) for m in _MARKS.finditer(raw) if m[1] or m[2]]
        before, behind = (np.array(x, dtype=np.int64) for x in zip(*spans)) if spans else (np.zeros(0, dtype=np.int64),) * 2
        inside = ~np.isin(behind, begin)  # marks at a text's end are followed by another text
        final = []
        for x, end in zip(texts, begin[1:]):
            tail = x[-_WINDOW:]
            if last := _CLOSING.search(tail):
                final.append(end - len(tail) + last.start())
        self.before = place[np.concatenate([before[inside], np.array(final, dtype=np.int64)]) - 1]
        self.behind = place[behind[inside] - 1]

    def depth(self) -> np.ndarray:
        """For each position the number of characters of its text up to and with it."""
        return np.arange(len(self.codes)) - np.repeat(self.starts[:-1], np.diff(self.starts)) + 1


def _contexts(codes: np.ndarray, depth: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each order (its place in ORDERS) the positions with that many characters of their own text and the hashes of their suffixes, from which
    the next order goes on. What is sent back says which of them do."""
    h, known = np.zeros(len(at), dtype=np.uint64), 0
    for k, order in enumerate(ORDERS):
        enough = depth[at] >= order
        at, h = at[enough], h[enough]
        for j in range(known, order):
            h ^= codes[at - j] + np.uint64(j + 1)
            h *= _MUL
            h ^= h >> _SHIFT
        known = order
        going = yield k, at, h
        if going is not None:
            at, h = at[going], h[going]


def _marked(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes with the place of their order in ORDERS in the lowest four bits, so that one number says which suffix it is."""
    return ((h & ~np.uint64(15)) | np.uint64(k)).view(np.int64)


def _tail(text: str) -> str:
    """An end of the text from which its longest suffix can be read."""
    size = TAIL
    while size < len(text):
        tail = text[-size:]
        if len(_BLANKS.sub(" ", _DIGITS.sub("0", _stripped(tail))).lstrip()) >= ENOUGH:
            return tail
        size *= 8
    return text


def finals(df: DataFrame, key: str, text: str, lang: str, source: str) -> DataFrame:
    """key, lang, source, chars, bytes, text_hash, hs, whole: the suffixes each value ends with, by rising length; text_hash tells repeated texts; whole: it
    may be an example of an end."""
    t = F.col(text)
    rows = df.filter(t.isNotNull()).select(F.col(key).cast("bigint").alias("key"), F.lower(F.col(lang)).alias("lang"), F.col(source).cast("string").alias("source"), F.length(t).cast("bigint").alias("chars"), F.octet_length(t).cast("bigint").alias("bytes"), F.xxhash64(t).alias("text_hash"), t.alias("text"))
    n = len(rows.columns) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ready = Prepared([_tail(x) for x in b.column(n).to_pylist()], ends=False)
            some = np.flatnonzero(np.diff(ready.starts) > 1)
            last = ready.starts[some + 1] - 1
            table = np.zeros((len(some), len(ORDERS)), dtype=np.int64)
            known = np.zeros(table.shape, dtype=bool)
            row = np.zeros(len(ready.codes), dtype=np.int64)
            row[last] = np.arange(len(some))
            for k, at, h in _contexts(ready.codes, ready.depth(), last):
                table[row[at], k], known[row[at], k] = _marked(h, k), True
            offsets = np.concatenate([[0], np.cumsum(known.sum(axis=1))]).astype(np.int32)
            kept = [c.take(pa.array(some)) for c in b.columns[:n]]
            whole = ~np.isin(ready.codes[last], np.array(_OPEN, dtype=np.uint64))
            yield pa.RecordBatch.from_arrays([*kept, pa.ListArray.from_arrays(pa.array(offsets), pa.array(table[known])), pa.array(whole)], names=[*b.schema.names[:n], "hs", "whole"])

    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:n])
    return rows.mapInArrow(run, f"{ddl}, hs array<bigint>, whole boolean")


class Sums:
    """Occurrences and ends by suffix, summed up whenever many are pending."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.pending = 0

    def add(self, h: np.ndarray, e: np.ndarray) -> None:
        self.parts.append((h, np.ones(len(h)), e))
        self.pending += len(h)
        if self.pending > PENDING:
            self.total()

    def total(self) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        if not self.parts:
            return None
        if len(self.parts) > 1 or self.pending:
            h, n, e = (np.concatenate(x) for x in zip(*self.parts))
            group, values = pd.factorize(h)
            self.parts = [(values, *(np.bincount(group, weights=x, minlength=len(values)) for x in (n, e)))]
            self.pending = 0
        return self.parts[0]


def inner_counts(df: DataFrame, text: str, wanted: np.ndarray, bits: int) -> DataFrame:
    """h, n, e: how often a suffix occurs inside of texts, and how often a sentence ends there. Their ends are left out. wanted: a bitmap of the
    suffixes; whoever has a long one has its shorter ones, so a position goes on only as long as its suffixes are wanted. Each task sums up before the shuffle."""
    known = df.sparkSession.sparkContext.broadcast(wanted)
    schema = pa.schema([("h", pa.int64()), ("n", pa.int64()), ("e", pa.float64())])

    def count(texts: list[str], sums: list[Sums]) -> None:
        ready = Prepared(texts)
        weight = np.zeros(len(ready.codes))
        weight[ready.before] = UNMARKED
        weight[ready.behind] = 1.0
        inside = np.ones(len(ready.codes), dtype=bool)
        inside[ready.starts[1:] - 1] = False
        going = None
        found = _contexts(ready.codes, ready.depth(), np.flatnonzero(inside))
        try:
            while True:
                k, at, h = found.send(going)
                going = in_bitmap(known.value, (h >> np.uint64(4)).view(np.int64), bits)
                sums[k].add(_marked(h[going], k), weight[at[going]])
        except StopIteration:
            pass

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [Sums() for _ in ORDERS]
        held: list[str] = []
        size = seen = 0

        def given() -> Iterator[pa.RecordBatch]:
            for s in sums:
                if total := s.total():
                    yield pa.RecordBatch.from_arrays([pa.array(total[0]), pa.array(total[1].astype(np.int64)), pa.array(total[2])], schema=schema)

        for b in batches:
            for x in b.column(0).to_pylist():
                held.append(x)
                size += len(x)
                if size > CACHED:
                    count(held, sums)
                    held, seen, size = [], seen + size, 0
                    if seen > HELD and sum(len(s.parts[0][0]) for s in sums if s.parts) > HELD:
                        yield from given()
                        sums, seen = [Sums() for _ in ORDERS], 0
        if held:
            count(held, sums)
        yield from given()

    rows = df.filter(F.col(text).isNotNull()).select(F.col(text)).mapInArrow(run, "h bigint, n bigint, e double")
    return rows.groupBy("h").agg(F.sum("n").alias("n"), F.sum("e").alias("e"))


def _ends_of(values: DataFrame) -> DataFrame:
    """h, f: how many different texts end with a suffix as examples of an end, 0 for suffixes of others only."""
    texts = values.groupBy("text_hash").agg(F.first("hs").alias("hs"), F.first("whole").alias("whole"))
    rows = texts.select(F.col("whole").cast("int").alias("f"), F.explode("hs").alias("h"))
    return rows.groupBy("h").agg(F.sum("f").alias("f"))


class Model:
    """Suffixes in order, with how often each occurs and how often a text or sentence ends with it."""

    def __init__(self, h: np.ndarray, n: np.ndarray, e: np.ndarray) -> None:
        self.h, self.n, self.e = h, n.astype(np.float64), e.astype(np.float32)
        shortest = (h & 15) == 0  # all positions pass through the suffixes of one character that end some text: nearly all characters do
        total = self.n[shortest].sum()
        self.base = max(1e-9, min(0.5, float(self.e[shortest].sum()) / total)) if total else 0.5

    def without(self, h: np.ndarray, f: np.ndarray) -> Model:
        """The model without so many examples of ends."""
        n, e = self.n.copy(), self.e.copy()
        at = np.searchsorted(self.h, h)
        mine = at < len(self.h)
        mine[mine] = self.h[at[mine]] == h[mine]
        n[at[mine]] -= f[mine]
        e[at[mine]] -= f[mine]
        return Model(self.h, n, e)

    def score(self, hs: pa.ListArray, own: np.ndarray) -> np.ndarray:
        """As `log_odds`, of the values' suffixes."""
        flat = hs.flatten().to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(hs)), np.diff(hs.offsets.to_numpy()))
        at = np.minimum(np.searchsorted(self.h, flat), max(len(self.h) - 1, 0))
        known = self.h[at] == flat if len(self.h) else np.zeros(len(flat), dtype=bool)
        flat, row, at = flat[known], row[known], at[known]
        return log_odds(flat & 15, row, self.n[at], self.e[at], own, self.base)


def log_odds(order: np.ndarray, row: np.ndarray, n: np.ndarray, e: np.ndarray, own: np.ndarray, base: float) -> np.ndarray:
    """Log-odds of the values' final contexts for a stop against an end, from the counts of their suffixes, each with the place of its order and the
    value's row; own, by row: 1 where the value itself is one of the examples."""
    ns, es = np.zeros((2, len(ORDERS), len(own)))
    ns[order, row] = np.maximum(n - own[row], 0)
    es[order, row] = np.maximum(e - own[row], 0)
    p = np.full(len(own), base)
    for k in range(len(ORDERS)):
        p = (es[k] + BACKOFF * p) / (ns[k] + BACKOFF)
    return np.log(base / p)


def _wanted(suffixes: DataFrame, n: int) -> tuple[np.ndarray, int]:
    """A bitmap of n suffixes, and its bits as a power of two."""
    bits = min(MOST_BITS, max(16, math.ceil(math.log2(max(1, n) * BITS_EACH))))
    return bitmap(suffixes.select(F.shiftrightunsigned("h", 4).alias("h")), "h", bits), bits


def _counted(df: DataFrame, text: str, values: DataFrame, at_end: DataFrame, n: int, block: int) -> DataFrame:
    """h, n, e as `inner_counts`, of at least the n suffixes at_end. A pass takes the suffixes of a share of the values. It has with a suffix its shorter ones,
    so its counts are whole; a suffix of several passes is counted in each."""
    passes = max(1, math.ceil(n / block))
    if passes == 1:
        return inner_counts(df, text, *_wanted(at_end, n))
    parts = []
    for i in range(passes):
        some = materialize(_ends_of(values.filter(F.pmod("text_hash", F.lit(passes)) == i)).select("h"), "wanted")
        parts.append(materialize(inner_counts(df, text, *_wanted(some, some.count())).join(some, "h", "left_semi"), "inner"))
    return functools.reduce(DataFrame.unionByName, parts).groupBy("h").agg(F.max("n").alias("n"), F.max("e").alias("e"))


def trained(df: DataFrame, text: str, values: DataFrame, contexts: int = CONTEXTS, block: int = BLOCK) -> tuple[Model, DataFrame | None]:
    """The model of all texts, which the driver and each executor hold. With more than `contexts` suffixes that is the model of the shortest ones only,
    one character each, and a table h, n, e has all."""
    at_end = materialize(_ends_of(values), "suffixes")
    size = at_end.count()
    inner = _counted(df, text, values, at_end, size, block)
    found = at_end.join(inner, "h", "left").select("h", (F.coalesce("n", F.lit(0)) + F.col("f")).alias("n"), (F.coalesce("e", F.lit(0.0)) + F.col("f")).cast("float").alias("e"))
    table = materialize(found, "model") if size > contexts else None
    return _held(found if table is None else _shortest(table)), table


def _shortest(table: DataFrame) -> DataFrame:
    return table.filter(F.col("h").bitwiseAND(F.lit(15)) == 0)


def _held(table: DataFrame) -> Model:
    rows = table.toPandas()
    rows = rows.iloc[np.argsort(rows["h"].to_numpy(np.int64))]
    return Model(*(rows[c].to_numpy() for c in ("h", "n", "e")))


def without(model: Model, table: DataFrame | None, gone: DataFrame) -> tuple[Model, DataFrame | None]:
    """What `trained` gives, without the examples of ends `gone` (h, f)."""
    if table is None:
        rows = gone.toPandas()  # no more than the model has
        return model.without(rows["h"].to_numpy(np.int64), rows["f"].to_numpy(np.float64)), None
    f = F.coalesce("f", F.lit(0))
    table = materialize(table.join(gone.select("h", "f"), "h", "left").select("h", (F.col("n") - f).alias("n"), (F.col("e").cast("double") - f).cast("float").alias("e")), "model")
    return _held(_shortest(table)), table


def with_scores(values: DataFrame, model: Model) -> DataFrame:
    """The values with `context`, in place of one they have. Values that are `cut` are no examples."""
    known = values.sparkSession.sparkContext.broadcast(model)
    rows = values.drop("context")
    n = len(rows.columns)
    at = {c: rows.columns.index(c) for c in ("hs", "whole", "cut")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flag = {c: b.column(at[c]).to_numpy(zero_copy_only=False) for c in ("whole", "cut")}
            score = known.value.score(b.column(at["hs"]), (flag["whole"] & ~flag["cut"]).astype(np.float64))
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(score)], names=[*b.schema.names[:n], "context"])

    return rows.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields) + ", context double")


def with_joined_scores(values: DataFrame, table: DataFrame, base: float, hot_rows: int = HOT_ROWS) -> DataFrame:
    """As `with_scores` with a model that is a table. Values with the same longest suffix are scored once; suffixes and values that are hot are spread."""
    rows = values.drop("context").withColumn("_last", F.element_at("hs", -1))
    ends = rows.groupBy("_last").agg(F.first("hs").alias("hs"), F.count("*").alias("_rows")).select("_last", "_rows", F.explode("hs").alias("_h"))
    met = join_skewed(materialize(ends, "ends"), "_h", table, "h", "inner", hot_rows=hot_rows)
    met = met.groupBy("_last", "_rows").agg(F.collect_list(F.struct("_h", "n", "e")).alias("met"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(2)
            row = np.repeat(np.arange(len(b)), np.diff(lists.offsets.to_numpy()))
            h, n, e = (c.to_numpy(zero_copy_only=False) for c in lists.flatten().flatten())
            score = [pa.array(log_odds(h & 15, row, n.astype(np.float64), e, np.full(len(b), float(own)), base)) for own in (0, 1)]
            yield pa.RecordBatch.from_arrays([*b.columns[:2], *score], names=["_last", "_rows", "_other", "_own"])

    scored = materialize(met.mapInArrow(run, "_last bigint, _rows bigint, _other double, _own double"), "contexts")
    joined = join_unique(rows, scored, ["_last"], "_rows", hot_rows)
    return joined.select(*[c for c in rows.columns if c != "_last"], F.when(F.col("whole") & ~F.col("cut"), F.col("_own")).otherwise(F.col("_other")).alias("context"))


def with_lengths(values: DataFrame) -> DataFrame:
    """The values with `stop`: the share of the source's values of at least this length that stop just here, the larger of characters and bytes.

    The value itself is left out and repeated texts count once. A source's histogram has a row for each length, so no more than its longest text.
    """
    name = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))
    out = values.withColumn("_source", name)
    for unit, slack in (("chars", 1), ("bytes", CHAR_BYTES - 1)):
        hist = out.groupBy("_source", unit).agg(F.count_distinct("text_hash").alias("c"), F.count("*").alias("_rows"))
        w = Window.partitionBy("_source").orderBy(unit)
        near = F.sum("c").over(w.rangeBetween(-slack, slack))
        above = F.sum("c").over(w.rangeBetween(-slack, Window.unboundedFollowing))
        hist = materialize(hist.select("_source", unit, ((near - 1) / (above + 1)).alias(f"stop_{unit}"), "_rows"), "lengths")
        if is_small(hist):
            out = out.join(F.broadcast(hist.drop("_rows")), ["_source", unit])
        else:  # a limit may hold most of a source's values
            out = join_unique(out, hist, ["_source", unit], "_rows")
    return out.withColumn("stop", F.greatest("stop_chars", "stop_bytes")).drop("_source", "stop_chars", "stop_bytes")


def learn_prior(hist: list[tuple[float, float, int]], start: float = START, rounds: int = 50) -> float:
    """The share of cut values from (score, prior log-odds of the length or -inf, number), by expectation maximization."""
    score, known, n = (np.array(x, dtype=np.float64) for x in zip(*hist)) if hist else np.zeros((3, 0))
    p = start
    for _ in range(rounds):
        logit = score + np.maximum(known, math.log(p / (1 - p)))
        cut = float((n / (1 + np.exp(-np.clip(logit, -50, 50)))).sum())
        p = (cut + start * WEIGHT) / (float(n.sum()) + WEIGHT)
    return p


def priors(scored: DataFrame) -> DataFrame:
    """lang, prior: the log-odds of a cut. A language's histogram is bounded by the bins of the log-odds."""
    bins = scored.groupBy("lang", (F.round(F.col("context") / BIN) * BIN).alias("s"), (F.round(F.col("known") / BIN) * BIN).alias("k")).agg(F.count("*").alias("n"))

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        p = learn_prior(list(zip(pdf["s"], pdf["k"].fillna(-math.inf), pdf["n"])))
        return pd.DataFrame({"lang": [pdf["lang"].iloc[0]], "prior": [math.log(p / (1 - p))]})

    return bins.groupBy("lang").applyInPandas(learn, "lang string, prior double")


def scores(df: DataFrame, key: str, text: str, lang: str, source: str, column: str | None = None, contexts: int = CONTEXTS) -> DataFrame:
    """key, lang, source, column, context, length, score, threshold, cut for each value with any text. The threshold is the language's and column's."""
    values = materialize(finals(df, key, text, lang, source), "finals")
    model, table = trained(df, text, values, contexts)
    stop = F.least(F.lit(MOST_STOP), F.greatest(F.lit(0.0), F.col("stop")))
    known = F.when(stop > 0.1, F.log(stop / (1 - stop)))
    rows = with_lengths(values).select("key", "lang", "source", "text_hash", "hs", "whole", known.alias("known"), F.lit(False).alias("cut"))
    for n in range(ROUNDS):
        if n:
            model, table = without(model, table, _ends_of(rows.filter("cut")))
        rows = materialize(with_scores(rows, model) if table is None else with_joined_scores(rows, table, model.base), "scores")
        prior = materialize(priors(rows), "priors")
        joined = join_same(rows, prior, ["lang"], small=is_small(prior))
        length = F.greatest(F.lit(0.0), F.coalesce(F.col("known") - F.col("prior"), F.lit(0.0)))
        joined = joined.withColumn("length", length).withColumn("score", F.col("context") + F.col("length")).withColumn("threshold", -F.col("prior"))
        rows = joined.withColumn("cut", F.col("score") > F.col("threshold")).drop("prior")
        if n + 1 < ROUNDS:
            rows = rows.drop("length", "score", "threshold")
    return rows.select("key", "lang", "source", F.lit(column or text).alias("column"), "context", "length", "score", "threshold", "cut")
