"""Packing: best-fit decreasing into fixed-length sequences.

Each task tokenizes the documents of its input split and packs them by itself,
so packing needs no shuffle and its memory is bounded by ``block_pieces``:

* a document's ids (with the end id) are first cut into full windows, which are
  sequences of their own; what remains is one piece shorter than a window;
* pieces are gathered into blocks; each block is sorted by decreasing length
  (ties by doc_id) and every piece goes to the tightest open window with room;
* a segment tree indexed by remaining capacity counts the open windows of each
  capacity and finds the tightest one in logarithmic time.

The last windows of a block stay partly empty: a few sequences for each task.
Sequences are numbered by partition and then by order, so a task that runs
again after a lost executor numbers alike.

Words between white space are tokenized once and kept, as ids by bytes, in a
cache of at most ``CACHE_WORDS`` a Python worker (and the words of the texts in
hand): the tokenizer lower-cases, splits at white space and never merges across
it, so a text's ids are its words' ids joined.  Texts with the four separators
that Python and the tokenizer class differently, and texts with a special token's
string (``<|endoftext|>``, in whatever case), go through it whole.

Defined results: a null or empty text is the end id alone; repeated rows are
packed each; an empty table gives no sequence; other columns are not read.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterable, Iterator
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import prepare, worker_cache

SEQUENCE_TOKENS = 4096
END_ID = 2
BLOCK_PIECES = 200_000
CACHE_WORDS = 700_000
SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
          "sequence_id long, offset long")
_ODD_SPACE = "\x1c\x1d\x1e\x1f"
_TAIL = "!\"#$%&()*+,-./:;=?@[\\]^_{|}~"  # ASCII punctuation without ' and angle brackets
GROUP_CHARS = 1 << 20


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordTokenizer:
    """Ids of whole texts as little-endian uint32 bytes, by cached words.

    A word of letters with ASCII punctuation after it is two units for the
    tokenizer: such words go, in lower case and many at a time, to the
    tokenizer's model without the steps that would find that out again, and each
    unit's last id is one that ends a unit (``</w>``).  All other words go
    through the whole tokenizer."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        # tasks run side by side already: no threads of the library's own
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        # the tokenizer finds these in a text as it is, before it lower-cases
        self.special = tuple({t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()})
        self.parted = Tokenizer(self.tokenizer.model)  # takes units between spaces
        self.parted.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        self.ascii = Tokenizer(self.tokenizer.model)  # the byte letters of ASCII are themselves
        self.ascii.pre_tokenizer = WhitespaceSplit()
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends[[i for w, i in vocab.items() if w.endswith("</w>")]] = True
        self.cache: dict[str, bytes] = {}
        self.cache_words = cache_words

    def whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids
        return np.array(ids, dtype="<u4").tobytes()

    def learn(self, words: Iterable[str]) -> None:
        """Cache the ids of new lower-case words, cut where a unit ends."""
        plain, wide = ([], [], []), ([], [], [])  # words, their units, how many
        for w in words:
            known, parted, sizes = plain if w.isascii() else wide
            if w.isalpha():
                known.append(w)
                parted.append(w)
                sizes.append(1)
                continue
            core = w.rstrip(_TAIL)
            if core.isalpha():
                known.append(w)
                parted.append(f"{core} {w[len(core):]}")
                sizes.append(2)
            else:
                self.cache[w] = self.whole(w)
        for tokenizer, (known, parted, sizes) in ((self.ascii, plain), (self.parted, wide)):
            for a in range(0, len(known), 1000):
                part = known[a:a + 1000]
                text = " ".join(parted[a:a + 1000])
                ids = np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
                ends = np.flatnonzero(self.ends[ids]) + 1
                units = np.cumsum(sizes[a:a + 1000])
                if len(ends) != units[-1]:  # can't happen with letters; stay right if it does
                    self.cache.update((w, self.whole(w)) for w in part)
                    continue
                data, cuts = ids.tobytes(), (4 * ends[units - 1]).tolist()
                self.cache.update(zip(part, [data[s:e] for s, e in zip([0, *cuts], cuts)]))

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Ids of some texts.  The large cache is asked once for each of their
        distinct words; the texts are joined from that small table."""
        split = [plain_words(t, self.special) for t in texts]
        distinct = set().union(*[w for w in split if w])
        cache = self.cache
        ids = dict(zip(distinct, map(cache.get, distinct)))
        new = [w for w, x in ids.items() if x is None]
        if len(cache) + len(new) > self.cache_words:
            cache.clear()
        self.learn(new)
        for w in new:
            ids[w] = cache[w]
        known = ids.__getitem__
        return [self.whole(t) if w is None else b"".join(map(known, w)) for t, w in zip(texts, split)]


def plain_words(text: str, special: tuple[str, ...] = ()) -> list[str] | None:
    """The words of ``text`` in lower case, as the tokenizer would make them; None
    where Python's white space, lower case or composition may differ from its, or
    where a ``special`` string (lower-cased) is in it, in whatever case."""
    low = text.lower()
    if any(s in low for s in special):
        return None
    if not text.isascii() and (len(low) != len(text) or "\u03a3" in text or not is_normalized("NFC", text)):
        return None
    return None if any(c in text for c in _ODD_SPACE) else low.split()


class CapacityTree:
    """Open windows by remaining capacity: a segment tree of counts."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(self.size)]

    def _add(self, room: int, by: int) -> None:
        i = room + self.size
        while i:
            self.count[i] += by
            i >>= 1

    def put(self, room: int, window: int) -> None:
        self.open[room].append(window)
        self._add(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, window) of the tightest open window with room, removed."""
        i = need + self.size
        if not self.count[i]:
            while i > 1 and (i & 1 or not self.count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i <<= 1
                if not self.count[i]:
                    i += 1
        room = i - self.size
        self._add(room, -1)
        return room, self.open[room].pop()


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[tuple[int, int]]:
    """(window, offset) for each length, in the order given."""
    tree, places, windows = CapacityTree(capacity), [(0, 0)] * len(lengths), 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = tree.take(lengths[i])
        if found is None:
            room, window = capacity, windows
            windows += 1
        else:
            room, window = found
        places[i] = (window, capacity - room)
        if room > lengths[i]:
            tree.put(room - lengths[i], window)
    return places


def pack_ids(documents: Iterable[tuple[int | None, bytes]], first_sequence: int,
             capacity: int = SEQUENCE_TOKENS, block_pieces: int = BLOCK_PIECES) -> Iterator[list[tuple]]:
    """Blocks of packed pieces of (doc_id, ids as bytes)."""
    sequence, ready, block = first_sequence, [], []

    def flush():
        nonlocal sequence, block, ready
        block.sort(key=lambda p: (-p[2], p[0] is None, p[0]))
        windows = -1
        for p, (window, offset) in zip(block, best_fit_decreasing([p[2] for p in block], capacity)):
            ready.append((*p, sequence + window, offset))
            windows = max(windows, window)
        sequence += windows + 1
        block, out, ready = [], ready, []
        return out

    for doc_id, ids in documents:
        n = len(ids) // 4
        for start in range(0, n, capacity):
            piece = ids[4 * start:4 * (start + capacity)]
            row = (doc_id, start, len(piece) // 4, zlib.crc32(piece), n)
            if row[2] == capacity:
                ready.append((*row, sequence, 0))
                sequence += 1
            else:
                block.append(row)
        if len(block) >= block_pieces or len(ready) >= block_pieces:
            yield flush()
    yield flush()


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = SEQUENCE_TOKENS,
         end_id: int = END_ID, block_pieces: int = BLOCK_PIECES,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: its document's id, start, length, CRC-32 of its ids
    and token count, its sequence and its offset there."""
    prepare(docs.sparkSession)
    path, end = tokenizer or default_tokenizer(), np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # kept between tasks, with its words
        encode_many = worker_cache(f"packing {path}", lambda: WordTokenizer(path)).encode_many
        part = TaskContext.get().partitionId()

        def documents():
            for b in batches:
                ids, texts, size = [], [], 0
                for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                    ids.append(doc_id)
                    texts.append(text.as_py() or "")
                    size += len(texts[-1])
                    if size >= GROUP_CHARS:
                        yield from zip(ids, [x + end for x in encode_many(texts)])
                        ids, texts, size = [], [], 0
                yield from zip(ids, [x + end for x in encode_many(texts)])

        fields = [f.split()[0] for f in SCHEMA.split(", ")]
        for rows in pack_ids(documents(), part << 40, capacity, block_pieces):
            for a in range(0, len(rows), 50_000):
                cols = list(zip(*rows[a:a + 50_000]))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=fields)

    return docs.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`")).mapInArrow(run, SCHEMA)
