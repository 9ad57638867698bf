"""Suffix-array dedup without the array: a depth-limited radix sort of suffixes.

Only the order of suffixes through ``window`` bytes matters: suffixes that are equal that far are the repeated
windows. The sort goes by most significant digits, and a suffix leaves it as soon as it is alone in its group:

1. First digit: the 100-byte string in the window with the smallest hash (the last of equals), its anchor. Equal
   windows have equal anchors at equal distances, so a suffix is grouped by its anchor, and one row stands for all
   windows that follow each other and have the same anchor (about 120 of them).
2. Anchors whose string occurs once end here. If the whole stretch that an anchor's windows cover occurs again,
   all of them are repeated.
3. The windows of the other anchors are refined in groups of 16 neighbouring distances: the bytes that all 16 share
   (385 of 400) must occur again, else the group ends; if all bytes that the 16 cover occur again, all are repeated.
4. Last digit: what is left is compared window by window, through the full depth.

Bytes are compared by 128 bits of hashes. A group is never collected: each pass counts its keys, combined before
the shuffle, and joins the keys that occur twice or more, so one passage in every document is one row of counts.
Texts are read whole; very long ones in chunks that overlap by a window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from evidencespark.llm.common import stored, text_bytes

ANCHOR = 100
#: Distances in one group of the third pass.
STEP = 16
#: Texts are hashed in runs, and very long ones in chunks, of about this many bytes (below 2 ** 22). Hashing takes some
#: hundred bytes of memory for each.
RUN_BYTES = 1 << 19
#: Rows of a batch that tasks take at once after the first pass: each has some hundred bytes, and as many windows.
PIECE_ROWS = 512
#: Most rows of a table of places that is broadcast to the texts; a larger one is joined by a shuffle.
BROADCAST_ROWS = 600_000

#: Bytes that continue a character.
_LATER_BYTES = bytes(range(0x80, 0xC0))
_BASE = np.uint64(0xB2E1F4C3A5978D6B)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_MIX = np.uint64(0x9E3779B97F4A7C15)
_PLACE = np.uint64((1 << 23) - 1)


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Hasher:
    """Hashes of any substrings of ``data``, from sums over its prefixes (modulo 2 ** 64)."""

    def __init__(self, data: np.ndarray, powers: tuple[np.ndarray, np.ndarray]):
        n = len(data)
        self.sums, self.back = np.zeros(n + 1, np.uint64), powers[1]
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[0][:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        length = (end - start).astype(np.uint64)
        return _mix((self.sums[end] - self.sums[start]) * self.back[start] + length)


def anchors(data: np.ndarray, offsets: np.ndarray, window: int, powers) -> np.ndarray:
    """Rows ``(text, anchor, first window, last window, anchor hash, stretch hash)`` of a run of texts.

    Places are counted in the run. Every window of ``window`` bytes inside a text belongs to one row.
    """
    n = len(data) - window + 1
    none = np.zeros((6, 0), np.int64)
    if n <= 0:
        return none
    hasher = Hasher(data, powers)
    m = len(data) - ANCHOR + 1
    at = np.arange(m)
    own = hasher.of(at, at + ANCHOR)
    ordered = (own & ~_PLACE) | (_PLACE - at.astype(np.uint64))
    w = window - ANCHOR + 1
    rows = np.concatenate((ordered, np.full(-m % w, np.uint64(2**64 - 1)))).reshape(-1, w)
    upto = np.minimum.accumulate(rows, axis=1).ravel()
    since = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(since[:n], upto[w - 1 : w - 1 + n])
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:n]
    start = np.flatnonzero(np.arange(n) + window <= offsets[1:][text])
    if not len(start):
        return none
    anchor = (_PLACE - (least[start] & _PLACE)).astype(np.int64)
    new = np.flatnonzero((anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)) + 1
    first, last = np.concatenate(([0], new)), np.concatenate((new, [len(start)])) - 1
    lo, hi, anchor = start[first], start[last], anchor[first]
    return np.stack([text[lo], anchor, lo, hi, own[anchor].view(np.int64), hasher.of(lo, hi + window).view(np.int64)])


def anchor_lists(texts: pa.Array, window: int, powers) -> Iterator[np.ndarray]:
    """:func:`anchors` of each run of ``texts``, with places counted in each text and texts in the array."""
    data, offsets = text_bytes(texts)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + RUN_BYTES, side="right")) - 1)
        if offsets[j] - offsets[i] <= RUN_BYTES:
            found = anchors(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], window, powers)
            found[1:4] -= (offsets[i:j] - offsets[i])[found[0]]
        else:  # one long text: windows that start in a chunk, and the bytes they need
            parts = []
            for at in range(0, int(offsets[j] - offsets[i]), RUN_BYTES):
                chunk = data[offsets[i] + at : min(offsets[j], offsets[i] + at + RUN_BYTES + window - 1)]
                part = anchors(chunk, np.array([0, len(chunk)]), window, powers)
                part[1:4] += at
                if parts and part.shape[1] and parts[-1].shape[1] and parts[-1][1, -1] == part[1, 0]:
                    parts[-1][3, -1], parts[-1][5, -1] = part[3, 0], parts[-1][5, -1] ^ part[5, 0]
                    part = part[:, 1:]
                parts.append(part)
            found = np.concatenate(parts, axis=1)
        found[0] += i
        yield found
        i = j


def pieces(batches: Iterator[pa.RecordBatch], rows: int = PIECE_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches cut into pieces of at most ``rows`` rows, so that a task's memory does not follow their size."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def _keyed(docs: DataFrame) -> DataFrame:
    """``(doc_id, text, key)``; the key names id and text, so that rows that repeat an id keep apart."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("doc_id", text.alias("text")).withColumn("key", F.xxhash64("doc_id", "text", F.octet_length("text")))


def _repeated(rows: DataFrame, *keys: str, example: tuple[str, ...] = ()) -> DataFrame:
    """The keys that occur in two rows or more, with the ``example`` columns of one of these rows."""
    some = [F.first(c).alias(f"_{c}") for c in example]
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("times"), *some).where("times > 1").drop("times")


def _with_places(texts: DataFrame, places: DataFrame, rows: int) -> DataFrame:
    """``texts`` inner joined with ``places`` by key: broadcast if these stand for few rows, else shuffled."""
    return texts.join(F.broadcast(places) if rows <= BROADCAST_ROWS else places, "key")


def repeated_windows(docs: DataFrame, window: int = 400) -> DataFrame:
    """``(key, start, end)``: stretches that cover exactly the bytes of windows that occur elsewhere as well."""
    if window < ANCHOR + STEP:
        raise ValueError(f"window must be at least {ANCHOR + STEP} bytes")
    texts = _keyed(docs)

    def find(batches):
        powers = _powers(RUN_BYTES + window, _BASE), _powers(RUN_BYTES + window, _INVERSE)
        for batch in batches:
            keys = batch.column(0).to_numpy()
            for found in anchor_lists(batch.column(1), window, powers):
                text, anchor, lo, hi, own, stretch = found
                columns = [keys[text], anchor, (anchor - lo) << 10 | (hi - lo), own, stretch]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "at", "span", "gram", "stretch"])

    first = texts.select("key", "text").mapInArrow(find, "key long, at long, span long, gram long, stretch long")
    first = stored(first, "anchors")
    grams = stored(_repeated(first, "gram"), "anchor-strings")
    second = stored(first.join(grams, "gram"), "repeated-anchors")
    stretches = stored(_repeated(second, "gram", "span", "stretch", example=("key", "at")), "stretches")
    whole = stretches.select("gram", "span", "stretch", F.lit(True).alias("whole"))
    second = stored(second.join(whole, ["gram", "span", "stretch"], "left"), "tested-anchors")
    back, width = F.shiftright("span", 10), F.col("span").bitwiseAND(1023)
    lo = F.col("at") - back
    whole = second.where("whole").select("key", lo.alias("start"), (lo + width + window).alias("end"))

    # What is left, with the bytes around it: from the first to past the last window of an anchor, and as far as
    # the groups of 16 distances reach beyond these.
    # One anchor of each repeated stretch goes along, for others may repeat a part of it.
    open_ = second.where("whole IS NULL").select("key", "at", "span", "gram")
    examples = stretches.select(F.col("_key").alias("key"), F.col("_at").alias("at"), "span", "gram")
    open_ = open_.unionByName(examples.join(open_.select("gram").distinct(), "gram", "left_semi"))
    open_ = open_.select("key", F.struct("at", "span", "gram").alias("p")).distinct()
    open_ = open_.groupBy("key").agg(F.sort_array(F.collect_list("p")).alias("places"), F.count(F.lit(1)).alias("n"))
    open_ = stored(open_, "open-anchors")
    rows = open_.agg(F.sum("n")).first()[0] or 0

    def cut(batches):
        kinds = [pa.int64()] * 5 + [pa.binary()]

        def given(out):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["key", "at", "span", "gram", "begin", "bytes"])

        for batch in batches:
            out = [[] for _ in range(6)]
            for key, text, places in zip(*(batch.column(i) for i in range(3)), strict=True):
                raw = text.as_py().encode()
                for p in places.as_py():
                    left = (p["span"] >> 10) + STEP
                    begin, end = max(0, p["at"] - left), min(len(raw), p["at"] + window + STEP)
                    for c, v in zip(out, (key.as_py(), p["at"], p["span"], p["gram"], begin, raw[begin:end]), strict=True):
                        c.append(v)
                    if len(out[0]) >= PIECE_ROWS:
                        yield given(out)
                        out = [[] for _ in range(6)]
            yield given(out)

    around = _with_places(texts.select("key", "text"), open_.select("key", "places"), rows).select("key", "text", "places")
    around = stored(around.mapInArrow(cut, "key long, at long, span long, gram long, begin long, bytes binary"), "contexts")

    def prefixes(batch, powers):
        """A batch's contexts as one array: its hasher, and where each begins in it less its place in the text."""
        raw = batch.column("bytes")
        sizes = np.array([len(x) for x in raw.to_pylist()], np.int64)
        starts = np.concatenate(([0], np.cumsum(sizes)))
        data = np.frombuffer(b"".join(raw.to_pylist()), np.uint8)
        return Hasher(data, powers(len(data))), starts[:-1] - batch.column("begin").to_numpy(), starts[1:], starts[:-1]

    def make_powers():
        have = [_powers(1, _BASE), _powers(1, _INVERSE)]

        def get(n):
            if len(have[0]) < n + 1:
                have[0], have[1] = _powers(n + 1, _BASE), _powers(n + 1, _INVERSE)
            return have

        return get

    def group_keys(batches):
        powers = make_powers()
        for batch in pieces(batches):
            hasher, shift, ends, starts = prefixes(batch, powers)
            at, span = batch.column("at").to_numpy(), batch.column("span").to_numpy()
            far = span >> 10
            near = far - (span & 1023)
            count = far // STEP - near // STEP + 1
            row = np.repeat(np.arange(len(at)), count)
            group = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(near // STEP, count)
            inner = at[row] + shift[row] - group * STEP
            core = hasher.of(inner, inner - STEP + 1 + window)
            begin, end = inner - STEP + 1, inner + window
            inside = (begin >= starts[row]) & (end <= ends[row])
            cover = np.where(inside, hasher.of(np.where(inside, begin, inner), np.where(inside, end, inner)).view(np.int64), 0)
            columns = [batch.column(c).to_numpy()[row] for c in ("key", "at", "span", "gram")]
            arrays = [*(pa.array(c) for c in columns), pa.array(group), pa.array(core.view(np.int64)), pa.array(cover, mask=~inside)]
            yield pa.RecordBatch.from_arrays(arrays, names=["key", "at", "span", "gram", "grp", "core", "cover"])

    third = around.select("key", "at", "span", "gram", "begin", "bytes")
    third = stored(third.mapInArrow(group_keys, "key long, at long, span long, gram long, grp long, core long, cover long"), "distance-groups")
    cores = stored(_repeated(third, "gram", "grp", "core"), "cores")
    covers = _repeated(third.where("cover IS NOT NULL"), "gram", "grp", "cover", example=("key", "at", "span", "core"))
    covers = stored(covers, "covers")
    whole_groups = covers.select("gram", "grp", "cover", F.lit(True).alias("whole"))
    third = third.join(cores, ["gram", "grp", "core"]).join(whole_groups, ["gram", "grp", "cover"], "left")
    third = stored(third.select("key", "at", "span", "gram", "grp", "core", "whole"), "tested-groups")
    # A group's own windows: its distances that the anchor has.
    most = F.least(F.col("grp") * STEP + STEP - 1, back)
    fewest = F.greatest(F.col("grp") * STEP, back - width)
    by_group = third.where("whole").select("key", (F.col("at") - most).alias("start"), (F.col("at") - fewest + window).alias("end"))

    last = third.where("whole IS NULL")
    examples = covers.select("gram", "grp", *[F.col(f"_{c}").alias(c) for c in ("key", "at", "span", "core")])
    examples = examples.join(last.select("gram", "grp", "core").distinct(), ["gram", "grp", "core"], "left_semi")
    last = last.select("key", "at", "span", "grp").unionByName(examples.select("key", "at", "span", "grp"))
    last = last.groupBy("key", "at", "span").agg(F.collect_set("grp").alias("groups"))
    last = stored(last, "open-groups")
    fine = around.join(F.broadcast(last) if last.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else last, ["key", "at", "span"])

    def window_keys(batches):
        powers = make_powers()
        for batch in pieces(batches):
            hasher, shift, _, _ = prefixes(batch, powers)
            at, span = batch.column("at").to_numpy(), batch.column("span").to_numpy()
            groups = batch.column("groups")
            sizes = np.diff(groups.offsets.to_numpy())
            row = np.repeat(np.arange(len(at)), sizes * STEP)
            far = np.repeat(groups.flatten().to_numpy() * STEP, STEP) + np.tile(np.arange(STEP), int(sizes.sum()))
            own = (far <= (span >> 10)[row]) & (far >= ((span >> 10) - (span & 1023))[row])
            row, far = row[own], far[own]
            begin = at[row] - far + shift[row]
            keys = hasher.of(begin, begin + window)
            columns = [batch.column("key").to_numpy()[row], at[row] - far, batch.column("gram").to_numpy()[row], keys.view(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "start", "gram", "window"])

    fine = fine.select("key", "at", "span", "gram", "begin", "bytes", "groups")
    fine = fine.mapInArrow(window_keys, "key long, start long, gram long, window long")
    windows = stored(_repeated(fine, "gram", "window"), "windows")
    fine = fine.join(windows, ["gram", "window"]).select("key", "start", (F.col("start") + window).alias("end"))
    return merged(stored(whole.unionByName(by_group).unionByName(fine).distinct(), "stretches-found"))


def merged(spans: DataFrame) -> DataFrame:
    """``(key, start, end)``: the maximal runs that ``spans`` cover; first in parts of a text, then in the text."""

    def islands(df, *keys):
        order = W.partitionBy(*keys).orderBy("start", "end")
        upto = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
        df = df.withColumn("new", F.when(F.col("start") <= upto, 0).otherwise(1))
        df = df.withColumn("run", F.sum("new").over(order))
        return df.groupBy(*keys, "run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("run")

    parts = islands(spans.withColumn("part", F.shiftright("start", 9)), "key", "part").drop("part")
    return stored(islands(stored(parts, "partly-merged"), "key"), "merged")


def remove_repeats(docs: DataFrame, window: int = 400) -> DataFrame:
    """``(doc_id, n_bytes, spans, kept, kept_chars)`` for each row of ``docs(doc_id, text)``.

    ``spans`` are the maximal runs ``[start, end)`` of bytes that some ``window``-byte string covers which also
    starts anywhere else, in the same or another text; ``kept`` are the other bytes. Texts are UTF-8 bytes, null is
    the empty text, texts shorter than the window keep all; ``kept_chars`` counts the characters that begin in ``kept``. Repeated rows are texts of their own: each makes the
    other repeated. Null ids and other columns do not matter; an empty table gives an empty result.
    """
    found = repeated_windows(docs, window)
    per_text = found.groupBy("key").agg(F.sort_array(F.collect_list(F.array("start", "end"))).alias("spans"))
    rows = found.limit(BROADCAST_ROWS + 1).count()
    texts = _keyed(docs)
    joined = texts.join(F.broadcast(per_text) if rows <= BROADCAST_ROWS else per_text, "key", "left")

    def cut(batches):
        for batch in pieces(batches):
            kept, chars = [], []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                raw = text.encode()
                if spans:
                    ends = [0, *(b for _, b in spans)]
                    begins = [*(a for a, _ in spans), len(raw)]
                    raw = b"".join(raw[a:b] for a, b in zip(ends, begins, strict=True))
                kept.append(raw)
                chars.append(len(raw) if raw.isascii() else len(raw.translate(None, _LATER_BYTES)))
            columns = [batch.column("doc_id"), batch.column("n_bytes"), batch.column("spans"), pa.array(kept, pa.binary()), pa.array(chars, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "spans", "kept", "kept_chars"])

    spans = F.coalesce("spans", F.array().cast("array<array<bigint>>"))
    joined = joined.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), spans.alias("spans"), "text")
    schema = StructType(
        [
            joined.schema["doc_id"],
            StructField("n_bytes", LongType()),
            StructField("spans", ArrayType(ArrayType(LongType()))),
            StructField("kept", BinaryType()),
            StructField("kept_chars", LongType()),
        ]
    )
    return joined.mapInArrow(cut, schema)
