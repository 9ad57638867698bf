"""BPE with word ends (lower case, white space dropped), equal to the tokenizers library, for many texts at once.

Texts are cut at ASCII white space, and every distinct piece of a batch is worked on once. Pieces of ASCII and Latin
letters are lower-cased and cut by kinds of bytes, and their distinct words are merged together in numpy; all other pieces
(apostrophes, scripts where Unicode versions or composition matter, added tokens) go through the library itself. No piece
depends on another one: the vocabulary's pattern never spans white space, and white space composes with nothing.
"""

from __future__ import annotations

import json
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from evidencespark.llm.bpe import Bpe, gathered
from evidencespark.llm.common import text_bytes

#: Pieces that are cut here by their bytes: ASCII but the apostrophe, and Latin letters that composition leaves alone
#: (İ has a lower case of two characters). Everything else is left to the library.
_PLAIN = "^[\x21-\x26\x28-\x7e\xc0-\u012f\u0131-\u024f]*$"
#: Longer words are merged by the library, one by one.
_LONGEST = 64
_END = "</w>"
#: Kinds of bytes: letters are 1 (the rest of a character is of its first byte's kind), digits 2, line ends 0, others 3.
_KIND = np.full(256, 3, np.uint8)
_KIND[[*range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
_KIND[0x30:0x3A] = 2
_KIND[0x0A] = 0


def _word_places(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of lower-cased lines begin, and their sizes: runs of letters, single digits, runs of others."""
    kind = _KIND[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    signs = lead[(data[lead + 1] == 0x97) | (data[lead + 1] == 0xB7)]  # × and ÷
    kind[signs] = kind[signs + 1] = 3
    border = np.ones(len(data) + 1, bool)
    border[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
    begin = np.flatnonzero(border)
    size = np.diff(begin)
    used = kind[begin[:-1]] != 0
    return begin[:-1][used], size[used]


class WordBpe(Bpe):
    """A vocabulary with word ends; its size is the file's, not the data's."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        spec = json.loads(Path(path).read_text(encoding="utf-8"))
        self.library = Tokenizer.from_str(json.dumps(spec))
        self.library.no_truncation()
        self.library.no_padding()
        vocab = spec["model"]["vocab"]
        # The letters that stand for bytes: printable ones for themselves, the others from 256 on.
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [b for b in range(256) if b not in set(shown)]
        letter = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.inner = np.array([vocab[letter[b]] for b in range(256)], np.int64)
        self.last = np.array([vocab[letter[b] + _END] for b in range(256)], np.int64)
        merges = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            merges.setdefault(vocab[a] << 20 | vocab[b], rank << 20 | vocab[a + b])
        self.pairs = np.array(sorted(merges), np.int64)
        self.merged = np.array([merges[k] for k in self.pairs.tolist()], np.int64)
        self.added = [t["content"] for t in spec["added_tokens"]]

    def _by_library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [x.ids for x in self.library.encode_batch_fast(texts, add_special_tokens=False)] if texts else []
        counts = np.array([len(x) for x in found], np.int64)
        return np.array([i for x in found for i in x], np.int32), counts

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words of the pattern, one after another, and how many each has."""
        data, offsets = text_bytes(words)
        begin, size = offsets[:-1].astype(np.int64), np.diff(offsets).astype(np.int64)
        count, order, pool = np.zeros(len(words), np.int64), [], []
        for least, most in ((0, 4), (4, 8), (8, 16), (16, 32), (32, _LONGEST)):
            some = np.flatnonzero((size > least) & (size <= most))
            for part in np.array_split(some, -(-len(some) // 16_384)) if len(some) else ():
                places = np.minimum(begin[part][:, None] + np.arange(most), len(data) - 1)
                raw = data[places]
                rows = np.where(np.arange(most) == size[part][:, None] - 1, self.last[raw], self.inner[raw])
                count[part] = self.merge_rows(rows, size[part])
                order.append(part)
                pool.append(rows[np.arange(most) < count[part][:, None]].astype(np.int32))
        long = np.flatnonzero(size > _LONGEST)
        ids, count[long] = self._by_library(words.take(pa.array(long)).to_pylist())
        order, pool = np.concatenate([*order, long]).astype(np.int64), np.concatenate([*pool, ids])
        place = np.zeros(len(words), np.int64)
        place[order] = np.cumsum(count[order]) - count[order]
        return gathered(pool, place, count), count

    def _pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces without white space, one after another, and how many each has."""
        plain = pc.match_substring_regex(pieces, _PLAIN)
        for token in self.added:
            plain = pc.and_(plain, pc.invert(pc.match_substring(pieces, token)))
        plain = plain.to_numpy(zero_copy_only=False)
        here, other = np.flatnonzero(plain), np.flatnonzero(~plain)
        lines = "\n".join(pieces.take(pa.array(here)).to_pylist()).lower().encode()
        data = np.frombuffer(lines, np.uint8)
        starts, size = _word_places(data)
        ends = np.cumsum(size)
        raw = gathered(data, starts, size)
        words = pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(np.concatenate(([0], ends))), pa.py_buffer(raw)]).dictionary_encode()
        ids, count = self._words(words.dictionary)
        which = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        begin = np.cumsum(count) - count
        line_ends = np.append(np.flatnonzero(data == 0x0A), len(data)) if len(here) else np.zeros(0, np.int64)
        upto = np.concatenate(([0], np.cumsum(count[which])))[np.concatenate(([0], np.searchsorted(starts, line_ends)))]
        own, theirs = gathered(ids, begin[which], count[which]), self._by_library(pieces.take(pa.array(other)).to_pylist())
        counts, place = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        counts[here], counts[other] = np.diff(upto), theirs[1]
        place[here], place[other] = upto[:-1], len(own) + np.cumsum(theirs[1]) - theirs[1]
        return gathered(np.concatenate((own, theirs[0])), place, counts), counts

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all ``texts`` (null: empty), one after another, and the n + 1 places that part the texts."""
        cut = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        pieces = cut.flatten().dictionary_encode()
        ids, count = self._pieces(pieces.dictionary)
        which = pieces.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        begin = np.cumsum(count) - count
        upto = np.concatenate(([0], np.cumsum(count[which])))
        return gathered(ids, begin[which], count[which]), upto[cut.offsets.to_numpy().astype(np.int64)]
