"""Byte-level BPE encoding and decoding with a minimal acyclic transducer as lexicon.

The words that are frequent in the corpus are encoded once and compiled into a minimal acyclic automaton: equal
suffixes are shared, and each transition carries the number of accepted words that sort before it, so that the sum
along a path is the word's number, which selects its token ids. The automaton is one integer array in a file that
Spark hands to every executor and that tasks map into memory. Words outside it are merged exactly.

Encoding is exact for every text: the lexicon decides how fast a word is found, never its ids. A text is cut where
no merge can cross whatever stands on either side: before the last blank of white space, around a lone line feed, and
where letters, digits and signs meet. A slice of a few MB of texts is cut at once; Arrow finds its distinct words, these walk through the automaton
together, and the ids of the texts are gathered by their words. Rows are encoded where they lie; only the counts of
words are shuffled.
"""

from __future__ import annotations

import atexit
import heapq
import json
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from evidencespark.llm.common import free_name, text_bytes

#: White space as the tokenizer's pattern understands it.
_SPACE = r"\t-\r \x85\xa0  -     　"
_ANY = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
#: The same pattern for texts of ASCII and Latin letters, which the standard library matches faster.
_LATIN_LETTERS = "\xc0-\xd6\xd8-\xf6\xf8-ɏ"
_OTHER = re.compile(f"[^\x00-\x7f{_LATIN_LETTERS}]")
_LATIN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z{_LATIN_LETTERS}]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9{_LATIN_LETTERS}]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")

_NO_MERGE = 1 << 62

#: Most odd words (of several pre-tokens, or with rare letters) that a task remembers between slices.
MEMO_WORDS = 30_000
#: Texts are handled in slices of about this many bytes (one text at least).
SLICE_BYTES = 1 << 21
#: Encoding takes some thirty bytes of arrays for each byte of a slice, so its slices are smaller.
ENCODED_BYTES = 1 << 19
#: Words of up to this many bytes are counted and compiled.
WORD_BYTES = 64

#: Whether a byte begins a character that is never white space: ASCII, and lead bytes without any such character.
_SOLID = np.zeros(256, bool)
_SOLID[:128] = True
_SOLID[[*range(9, 14), 32]] = False
_SOLID[[*range(0xC3, 0xE1), *range(0xE4, 0xF8)]] = True
#: Kinds of bytes: 1 letter, 2 digit, 3 other ASCII, 4 apostrophe; 0 is white space, or unknown without its neighbours.
_KIND = np.zeros(256, np.uint8)
_KIND[:128] = 3
_KIND[[*range(65, 91), *range(97, 123)]] = 1
_KIND[48:58] = 2
_KIND[39] = 4
_KIND[[*range(9, 14), 32]] = 0


def pieces(text: str) -> list[str]:
    """The pre-tokens of a text; merges never cross them."""
    return (_ANY if _OTHER.search(text) else _LATIN).findall(text)


def _byte_letters() -> dict[str, int]:
    """The vocabulary file's letter of each byte: printable Latin-1 stands for itself, the rest for U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """The vocabulary: bytes of each id, the merges, and the added tokens. Its size is the file's, not the data's."""

    def __init__(self, path: str):
        spec = json.loads(Path(path).read_text(encoding="utf-8"))
        vocab, letters = spec["model"]["vocab"], _byte_letters()
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max(max(vocab.values()), *self.added.values(), 0)
        self.token_bytes = [b""] * size
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(letters[c] for c in token)
        for token, i in self.added.items():
            self.token_bytes[i] = token.encode()
        self.byte_ids = [vocab[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])]
        self.merges = {}  # left id << 20 | right id: rank << 20 | merged id
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges.setdefault(vocab[a] << 20 | vocab[b], rank << 20 | vocab[a + b])
        keys = np.array(sorted(self.merges), np.int64)
        self.pairs, self.merged = keys, np.array([self.merges[k] for k in keys.tolist()], np.int64)
        self.added = {t.encode(): i for t, i in self.added.items()}
        self.splitter = re.compile(b"|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None

    def merge(self, word: bytes) -> tuple[int, ...]:
        """The ids of one pre-token: the pair of lowest rank is merged, leftmost first, until none is left."""
        ids = [self.byte_ids[b] for b in word]
        if len(ids) > 64:
            return self._merge_long(ids)
        get = self.merges.get
        found = [get(a << 20 | b, _NO_MERGE) for a, b in zip(ids, ids[1:], strict=False)]
        while found:
            best = min(found)
            if best == _NO_MERGE:
                break
            i = found.index(best)
            ids[i : i + 2] = [new] = [best & 0xFFFFF]
            del found[i]
            if i:
                found[i - 1] = get(ids[i - 1] << 20 | new, _NO_MERGE)
            if i < len(found):
                found[i] = get(new << 20 | ids[i + 1], _NO_MERGE)
        return tuple(ids)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank and merged id of pairs of ids."""
        want = left << 20 | right
        if not len(self.pairs):
            return np.full(want.shape, _NO_MERGE)
        at = np.minimum(np.searchsorted(self.pairs, want), len(self.pairs) - 1)
        return np.where(self.pairs[at] == want, self.merged[at], _NO_MERGE)

    def merge_rows(self, ids: np.ndarray, size: np.ndarray) -> np.ndarray:
        """:meth:`merge` of many pre-tokens at once, as rows of ids with ``size`` used places; returns the sizes.

        A round merges the best pair of every row that has one; ``ids`` and ``size`` are changed in place.
        """
        live = np.flatnonzero(size > 1)
        row, count = ids[live], size[live]
        best_of = self._rank(row[:, :-1], row[:, 1:])
        best_of[np.arange(best_of.shape[1]) >= count[:, None] - 1] = _NO_MERGE
        while len(live):
            at = best_of.argmin(1)
            best = np.take_along_axis(best_of, at[:, None], 1)[:, 0]
            ended = best == _NO_MERGE
            if ended.any():
                ids[live[ended], : row.shape[1]], size[live[ended]] = row[ended], count[ended]
                on = ~ended
                live, row, count, best_of, at, best = live[on], row[on], count[on], best_of[on], at[on], best[on]
                if not len(live):
                    break
            each, last = np.arange(len(live)), row.shape[1] - 1
            places = np.arange(last + 1)
            row = np.take_along_axis(row, np.minimum(places + (places > at[:, None]), last), 1)
            best_of = np.take_along_axis(best_of, np.minimum(places[:-1] + (places[:-1] > at[:, None]), last - 1), 1)
            row[each, at] = new = best & 0xFFFFF
            count -= 1
            before = at > 0
            best_of[each[before], at[before] - 1] = self._rank(row[each[before], at[before] - 1], new[before])
            after = at < count - 1
            best_of[each[after], at[after]] = self._rank(new[after], row[each[after], at[after] + 1])
            width = int(count.max())
            row, best_of = row[:, :width], best_of[:, : width - 1]
            best_of[np.arange(width - 1) >= count[:, None] - 1] = _NO_MERGE
            if width < 2:
                ids[live, :width], size[live] = row, count
                break
        return size

    def encode_word(self, word: bytes) -> tuple[int, ...]:
        """The ids of a word: those of its pre-tokens, or the added token that it is."""
        if word in self.added:
            return (self.added[word],)
        parts = pieces(word.decode())
        return self.merge(word) if len(parts) == 1 else tuple(chain.from_iterable(self.merge(p.encode()) for p in parts))

    def _merge_long(self, ids: list[int]) -> tuple[int, ...]:
        """The same with a heap of candidate pairs, in n log n for a pre-token of n bytes."""
        n, get = len(ids), self.merges.get
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = []

        def offer(i, j):
            m = get(ids[i] << 20 | ids[j])
            if m is not None:
                heapq.heappush(heap, (m >> 20, i, ids[i], ids[j], m & 0xFFFFF))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
                offer(i, after[i])
            if before[i] >= 0:
                offer(before[i], i)
        return tuple(i for i in ids if i >= 0)


def compile_transducer(entries: dict[bytes, tuple[int, ...]]) -> np.ndarray:
    """The minimal acyclic transducer of ``entries`` as one int32 array (see :class:`Transducer` for its parts).

    Words are added in byte order; once no later word can pass through a state, the state is replaced by an equal
    one that exists already, so common suffixes are stored once.
    """
    words = sorted(w for w in entries if w)
    register: dict[tuple, int] = {}
    states: list[tuple] = []  # (final, ((label, target), ...)), children before parents
    open_: list[list] = [[False, []]]  # the states of the last word's path: [final, [(label, target)]]

    def close(down_to: int, word: bytes) -> None:
        while len(open_) > down_to + 1:
            final, arcs = open_.pop()
            key = (final, tuple(arcs))
            state = register.get(key)
            if state is None:
                state = register[key] = len(states)
                states.append(key)
            open_[-1][1].append((word[len(open_) - 1], state))

    last = b""
    for word in words:
        same = 0
        while same < len(last) and same < len(word) and last[same] == word[same]:
            same += 1
        close(same, last)
        open_.extend([False, []] for _ in word[same:])
        open_[-1][0] = True
        last = word
    close(0, last)
    states.append((open_[0][0], tuple(open_[0][1])))
    below = np.zeros(len(states), np.int64)  # words accepted from a state
    keys, targets, skips = [], [], []
    for i, (final, arcs) in enumerate(states):
        count = int(final)
        for label, target in arcs:
            keys.append(i << 8 | label)
            targets.append(target)
            skips.append(count)
            count += int(below[target])
        below[i] = count
    ids = [entries[w] for w in words]
    starts = np.concatenate(([0], np.cumsum([len(x) for x in ids], dtype=np.int64)))
    finals = [int(s[0]) for s in states]
    parts = [keys, targets, skips, finals, starts, list(chain.from_iterable(ids))]
    return np.concatenate([np.array([len(p) for p in parts], np.int32), *[np.asarray(p, np.int32) for p in parts]])


class Transducer:
    """A compiled lexicon, mapped from its file: ``keys`` (state and byte) to ``targets`` and ``skips``."""

    def __init__(self, packed: np.ndarray):
        sizes, at, parts = packed[:6], 6, []
        for n in sizes:
            parts.append(packed[at : at + n])
            at += n
        self.keys, self.targets, self.skips, self.finals, self.starts, self.ids = parts
        self.root = len(self.finals) - 1

    def find(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The number of each word ``data[begin : begin + size]``, -1 if it is not in the lexicon.

        All words take a step of their paths at a time; a word's ids are ``ids[starts[number] : starts[number + 1]]``.
        """
        n = len(begin)
        out = np.full(n, -1, np.int64)
        if not n or not len(self.keys):
            return out
        alive = np.flatnonzero(size > 0)
        state, number = np.full(n, self.root, np.int64), np.zeros(n, np.int64)
        step = 0
        while len(alive):
            want = (state[alive] << 8) | data[begin[alive] + step]
            at = np.minimum(np.searchsorted(self.keys, want.astype(np.int32)), len(self.keys) - 1)
            hit = self.keys[at] == want
            alive, at = alive[hit], at[hit]
            state[alive] = self.targets[at]
            number[alive] += self.skips[at]
            step += 1
            ended = size[alive] == step
            done = alive[ended]
            done = done[self.finals[state[done]] == 1]
            out[done] = number[done]
            alive = alive[~ended]
        return out


@dataclass(frozen=True)
class Lexicon:
    """What tasks need: the name of the transducer's file, as Spark distributes it, and the broadcast vocabulary."""

    file: str
    bpe: object


def gathered(values: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``values[b : b + s]`` of all ``begin`` and ``size``, one after another."""
    ends = np.cumsum(size)
    if not len(ends) or not ends[-1]:
        return values[:0]
    where = np.repeat(begin - (ends - size), size)
    where += np.arange(len(where))
    return values[where]


def word_borders(data: np.ndarray, fixed: np.ndarray) -> np.ndarray:
    """Where words begin: at the places ``fixed`` (of texts and added tokens), and where no merge can cross.

    These are the last blank of white space before a character that is none, both ends of a line feed that stands
    alone, and what parts letters, digits and other characters from each other (but not a letter from an apostrophe
    before it, as in contractions).
    """
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[fixed] = True
    edge[n] = True
    solid = _SOLID[data]
    cut = edge[:n].copy()
    if n > 1:
        cut[:-1] |= (data[:-1] == 32) & solid[1:] & ~edge[1:n]
        line = np.flatnonzero(data[1:-1] == 10) + 1
        ends_solid = (data[line - 1] < 128) & solid[line - 1] | (data[line - 1] >= 128) & (data[line - 1] < 192) & (line > 1) & (data[line - 2] >= 0xC3) & (data[line - 2] < 0xE0)
        line = line[ends_solid & solid[line + 1] & ~edge[line] & ~edge[line + 1]]
        cut[line] = True
        cut[line + 1] = True
        kind = _kinds(data)
        left, right = kind[:-1], kind[1:]
        cut[1:] |= (left != right) & (left > 0) & (right > 0) & (left < 4) & ((left != 3) | (right != 4))
    return np.flatnonzero(cut)


def _kinds(data: np.ndarray) -> np.ndarray:
    """The kind of each byte; both bytes of a Latin letter are letters."""
    kind = _KIND[data]
    latin = np.flatnonzero(data[:-1] == 0xC3)
    latin = latin[(data[latin + 1] != 0x97) & (data[latin + 1] != 0xB7)]
    kind[latin] = kind[latin + 1] = 1
    return kind


def one_kind(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which words are, after a blank or not, letters, digits or other signs only: one pre-token each."""
    if not len(begin):
        return np.zeros(0, bool)
    kind = _kinds(data)
    spaced = begin[(data[begin] == 32) & (size > 1)]
    kind[spaced] = kind[spaced + 1]
    least = np.minimum.reduceat(kind, begin)
    return (least == np.maximum.reduceat(kind, begin)) & (least > 0) & (least < 4)


def distinct_words(data: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct strings between ``begin`` (as bytes, begins and sizes in these), and the number of each string's."""
    offsets = np.append(begin, len(data)).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
    coded = words.dictionary_encode()
    _, ends, raw = coded.dictionary.buffers()
    ends = np.frombuffer(ends, np.int64)[: len(coded.dictionary) + 1]
    raw = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return raw, ends[:-1], np.diff(ends), coded.indices.to_numpy()


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``(word, n)``: how often each word of up to ``WORD_BYTES`` bytes occurs in the whole texts of all rows.

    Words that occur once in a slice of a few MB are not counted there, so ``n`` may be a little low for rare ones.
    """

    def count(batches):
        for batch in batches:
            for texts in slices(batch.column(0)):
                data, offsets = text_bytes(texts)
                if not len(data):
                    continue
                fixed = offsets[:-1][np.diff(offsets) > 0]
                raw, begin, size, which = distinct_words(data, word_borders(data, fixed))
                n = np.bincount(which, minlength=len(begin))
                often = np.flatnonzero((n > 1) & (size <= WORD_BYTES))
                words = pa.array([raw[a : a + b].tobytes() for a, b in zip(begin[often].tolist(), size[often].tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([words, pa.array(n[often], pa.int64())], names=["word", "n"])

    counted = docs.select(F.col(text_col).cast("string")).where(F.col(text_col).isNotNull()).mapInArrow(count, "word binary, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def slices(texts: pa.Array, most: int | None = None) -> Iterator[pa.Array]:
    """``texts`` in runs of about ``most`` bytes (one text at least), by default ``SLICE_BYTES``."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(sizes, (sizes[i - 1] if i else 0) + (most or SLICE_BYTES), side="right")))
        yield texts.slice(i, j - i)
        i = j


def build_lexicon(docs: DataFrame, vocabulary: str, text_col: str = "text", words: int = 65_536) -> Lexicon:
    """Count all words of ``docs``, and compile the ``words`` most frequent ones.

    The driver receives those ``words`` rows only, whatever the corpus. The compiled file stays on the driver, from
    where executors fetch it, until the application ends.
    """
    spark = docs.sparkSession
    bpe = Bpe(vocabulary)
    top = word_counts(docs, text_col).orderBy(F.desc("n"), "word").limit(words).collect()
    forms = (bytes(row["word"]) for row in top)
    entries = {w: bpe.encode_word(w) for w in forms if not (bpe.splitter and bpe.splitter.search(w))}
    folder = tempfile.mkdtemp(prefix="lexicon-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = Path(folder) / f"lexicon-{uuid.uuid4().hex}.npy"
    np.save(path, compile_transducer(entries))
    spark.sparkContext.addFile(str(path))
    return Lexicon(path.name, spark.sparkContext.broadcast(bpe))


class Coder:
    """Encodes and decodes in one task."""

    def __init__(self, transducer: Transducer, bpe: Bpe):
        self.transducer, self.bpe, self.memo = transducer, bpe, {}
        sizes = np.array([len(b) for b in bpe.token_bytes], np.int64)
        self.token_begin, self.token_size = np.cumsum(sizes) - sizes, sizes
        self.token_data = np.frombuffer(b"".join(bpe.token_bytes), np.uint8)
        self.byte_ids = np.array(bpe.byte_ids, np.int64)

    def _merged(self, word: bytes) -> tuple[int, ...]:
        ids = self.memo.get(word)
        if ids is None:
            ids = self.bpe.encode_word(word)
            if len(word) <= WORD_BYTES:
                if len(self.memo) >= MEMO_WORDS:
                    self.memo.clear()
                self.memo[word] = ids
        return ids

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts ``data[offsets[i] : offsets[i + 1]]``, and where each text's begin and end."""
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        fixed = offsets[:-1][np.diff(offsets) > 0]
        added = self._added(data, offsets)
        if added:
            fixed = np.unique(np.concatenate((fixed, [x for a, b in added for x in (a, b) if x < len(data)])))
        borders = word_borders(data, fixed)
        if added:  # nothing is cut inside of these
            first = np.array([a for a, _ in added])
            last = np.searchsorted(first, borders, side="right") - 1
            ends = np.array([b for _, b in added])
            borders = borders[(last < 0) | (borders == first[last]) | (borders >= ends[last])]
        raw, begin, size, which = distinct_words(data, borders)
        number = self.transducer.find(raw, begin, size)
        starts, count = self.transducer.starts, np.zeros(len(begin), np.int64)
        order, pool = [np.flatnonzero(number >= 0)], []
        known = number[order[0]]
        count[order[0]] = starts[known + 1] - starts[known]
        pool.append(gathered(self.transducer.ids, starts[known].astype(np.int64), count[order[0]]))
        # Words outside the lexicon: those that are one pre-token by their letters are merged together, by length.
        plain = (number < 0) & one_kind(raw, begin, size)
        for least, most in ((0, 4), (4, 8), (8, 16), (16, 32), (32, WORD_BYTES)):
            some = np.flatnonzero(plain & (size > least) & (size <= most))
            for part in np.array_split(some, -(-len(some) // 16_384)) if len(some) else ():
                place = np.minimum(begin[part][:, None] + np.arange(most), len(raw) - 1)
                rows = self.byte_ids[raw[place]]
                count[part] = self.bpe.merge_rows(rows, size[part])
                order.append(part)
                pool.append(rows[np.arange(most) < count[part][:, None]].astype(np.int32))
        others = np.flatnonzero((number < 0) & ~(plain & (size <= WORD_BYTES)))
        merged = [self._merged(raw[a : a + b].tobytes()) for a, b in zip(begin[others].tolist(), size[others].tolist(), strict=True)]
        count[others] = [len(x) for x in merged]
        pool.append(np.fromiter(chain.from_iterable(merged), np.int32))
        order = np.concatenate([*order, others])
        place = np.zeros(len(begin), np.int64)
        place[order] = np.cumsum(count[order]) - count[order]
        ids = gathered(np.concatenate(pool), place[which], count[which])
        upto = np.concatenate(([0], np.cumsum(count[which])))
        return ids, upto[np.searchsorted(borders, offsets)]

    def _added(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int]]:
        """Where added tokens stand in the texts."""
        if self.bpe.splitter is None:
            return []
        raw = data.tobytes()
        if self.bpe.splitter.search(raw) is None:
            return []
        return [m.span() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True) for m in self.bpe.splitter.finditer(raw, a, b)]

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """The texts of runs of ids, which ``ends`` parts; bytes that are no UTF-8 become U+FFFD."""
        size = self.token_size[ids]
        data = gathered(self.token_data, self.token_begin[ids], size)
        upto = np.concatenate(([0], np.cumsum(size)))[ends].astype(np.int64)
        texts = pa.Array.from_buffers(pa.large_string(), len(ends) - 1, [None, pa.py_buffer(upto), pa.py_buffer(data)])
        try:
            texts.validate(full=True)
        except pa.ArrowInvalid:
            raw = data.tobytes()
            texts = pa.array([raw[a:b].decode("utf-8", errors="replace") for a, b in zip(upto[:-1], upto[1:], strict=True)], pa.string())
        return texts.cast(pa.string())


def _coder(lexicon: Lexicon) -> Coder:
    return Coder(Transducer(np.load(SparkFiles.get(lexicon.file), mmap_mode="r")), lexicon.bpe.value)


#: What :func:`encode_texts` can return of a text, and the type of each.
OUTPUTS = {"ids": ArrayType(IntegerType(), False), "decoded": StringType(), "n_tokens": LongType(), "round_trip": BooleanType()}


def encode_texts(docs: DataFrame, lexicon: Lexicon, text_col: str = "text", outputs: tuple[str, ...] = ("ids",), keep_text: bool = True) -> DataFrame:
    """All columns of ``docs`` (without the text, on request) with ``outputs`` of the encoded texts.

    Outputs are ``ids`` (array of int), ``decoded`` (the text those ids give), ``n_tokens``, and ``round_trip`` (whether
    the decoded text is the text). Every whole text is encoded; a null text is an empty one, with no ids. Rows do not
    depend on each other, so repeated rows, null ids and further columns do not matter (a clashing column stays; the
    new one gets underscores before its name), and an empty table stays empty.
    """
    at = docs.columns.index(text_col)
    own = [i for i in range(len(docs.columns)) if keep_text or i != at]
    names = [free_name(docs, c) for c in outputs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(lexicon)
        for batch in batches:
            done = 0
            for texts in slices(batch.column(at), min(ENCODED_BYTES, SLICE_BYTES)):
                data, offsets = text_bytes(texts)
                ids, ends = coder.encode(data, offsets)
                found = {}
                if "decoded" in outputs or "round_trip" in outputs:
                    found["decoded"] = coder.decode(ids, ends)
                if "round_trip" in outputs:
                    found["round_trip"] = pc.equal(found["decoded"], pc.fill_null(texts, ""))
                if "n_tokens" in outputs:
                    found["n_tokens"] = pa.array(np.diff(ends), pa.int64())
                if "ids" in outputs:
                    found["ids"] = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
                columns = [batch.column(i).slice(done, len(texts)) for i in own]
                done += len(texts)
                yield pa.RecordBatch.from_arrays([*columns, *(found[c] for c in outputs)], names=fields.names)

    new = [StructField(n, OUTPUTS[c], False) for n, c in zip(names, outputs, strict=True)]
    fields = StructType([*(docs.schema.fields[i] for i in own), *new])
    return docs.mapInArrow(run, fields)


def decode_ids(encoded: DataFrame, lexicon: Lexicon, ids_col: str = "ids") -> DataFrame:
    """All columns of ``encoded`` with ``decoded``, the text of the ids (null or none: the empty text)."""
    at = encoded.columns.index(ids_col)
    name = free_name(encoded, "decoded")

    def run(batches):
        coder = _coder(lexicon)
        for batch in batches:
            ids = batch.column(at)
            ends = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False).astype(np.int64))))
            texts = coder.decode(ids.flatten().to_numpy(zero_copy_only=False), ends)
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=[*batch.schema.names, name])

    return encoded.mapInArrow(run, StructType([*encoded.schema.fields, StructField(name, StringType(), False)]))


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
