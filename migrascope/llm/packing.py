"""Packing documents into sequences by order-preserving dynamic programming.

A block is a run of documents in table order.  Its tokens form one line, on
which cuts may fall at document ends (free), at sentence ends (a small
penalty) and, inside sentences of over an eighth of a sequence, at every
256th part of one (a larger penalty).  With P(i)
the tokens before cut i and c(i) its penalty, the least cost of a packing that
ends at cut j is

    f(j) = c(j) + L - P(j) + min over P(j) - P(i) <= L of (f(i) + P(i)),

a minimum over a sliding window, kept by a monotone queue: each cut enters
and leaves it once.

A block never spans two input partitions, so there is no shuffle, and a lost
executor's partitions are packed again alike.  A block holds a bounded number
of tokens, so a task's memory doesn't depend on its input; what a block's
last sequence lacks is padding.

Defined cases: null text is empty, and its document is the end id alone;
repeated rows are packed each; rows without doc_id are packed like others; an
empty table gives no pieces; extra columns play no part.
"""

from __future__ import annotations

import re
import zlib
from unicodedata import is_normalized
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held

LENGTH = 4096
END_ID = 2
#: Cost in padded tokens of a cut between two sentences of one document, and inside a sentence.
SENTENCE_CUT, WORD_CUT = 8.0, 64.0
#: Tokens of a block.
BLOCK = 1_500_000
#: Distinct words whose ids a worker keeps.
REMEMBER = 800_000
#: Bytes of text tokenized at a time.
SPLIT = 1_000_000
PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"

#: Sentence and clause marks; a word of letters followed by these is two parts to the tokenizer as well.
MARKS = ".,;:!?"
STOPS = ".!?"

# Blanks to str.split, but not to the tokenizer.
CONTROLS = "\x1c\x1d\x1e\x1f"
WORD = re.compile(r"[^ \t-\r]+")


def _words(text: str, added: tuple[str, ...]) -> list[str]:
    """Blank-separated words, in lower case where that is the tokenizer's own.

    The tokenizer takes out its added tokens as they are spelt, composes marks
    (NFC) and lower-cases then.  So only a text without added tokens that is
    composed before and after may be lower-cased up front; else its ASCII
    words are, and the others are brought into normal form when first seen.
    """
    low = text.lower()
    whole = not any(a in low for a in added)
    if whole and not text.isascii():  # a last sigma depends on its neighbours in Python alone
        whole = "\u03a3" not in text and is_normalized("NFC", text) and is_normalized("NFC", low)
    if not whole:
        low = text
    words = WORD.findall(low) if any(c in low for c in CONTROLS) else low.split()
    return words if whole else [w.lower() if w.isascii() and not any(a in w.lower() for a in added) else w for w in words]


class _Numbers(dict):
    """Numbers words as they are first looked up, and lists the new ones."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        self.fresh.append(word)
        return n


class Encoder:
    """Token ids of whole texts, by the tokenizer's own ids of each distinct part.

    The tokenizer drops white space, never joins across it, and parts letters
    from marks.  So a text's ids are those of its blank-separated words in
    turn, and a word of letters with marks behind it is two parts; a word that
    holds an added token is one, encoded as it stands.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.added = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        # The same for what is in normal form, and for letters alone, which need no parting either.
        self.normal, self.plain = Tokenizer.from_file(path), Tokenizer.from_file(path)
        for t in (self.normal, self.plain):
            t.normalizer = normalizers.Sequence([])
            t.encode_special_tokens = True  # no word with an added token as it is spelt comes here
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self._reset()

    def _reset(self) -> None:
        self.word = _Numbers()
        self.part: dict[str, int] = {"": 0}
        self.of_word = np.zeros((0, 2), np.int32)  # parts of each word: itself and its marks
        self.start, self.size = np.zeros(1, np.int64), np.zeros(1, np.int64)
        self.stop = np.zeros(1, bool)  # the part ends a sentence
        self.flat = np.zeros(0, np.uint32)

    def _store(self, parts: list[str | tuple[str]]) -> None:
        """Keep the ids of new parts; letters are encoded as one text, whose words end at word-end tokens.

        A part is in normal form, or a 1-tuple of a word with added tokens as it is spelt.
        """
        spelt = np.array([isinstance(p, tuple) for p in parts])
        texts = [p[0] if isinstance(p, tuple) else p for p in parts]
        simple = np.array([p.isascii() and p.isalpha() for p in texts])
        letters = np.array([p.isalpha() for p in texts]) & ~simple
        size = np.zeros(len(parts), np.int64)
        found, order = [], []
        for tokenizer, kind in ((self.plain, simple), (self.normal, letters)):
            if kind.any():
                at = np.flatnonzero(kind)
                ids = np.array(tokenizer.encode_batch_fast([" ".join([texts[i] for i in at.tolist()])], add_special_tokens=False)[0].ids, np.uint32)
                ends = np.flatnonzero(self.last[ids]) + 1
                if len(ends) == len(at):  # else some letter is parted after all, and each is encoded alone
                    size[at] = np.diff(ends, prepend=0)
                    found.append(ids)
                    order.append(at)
        done = np.zeros(len(parts), bool)
        for at in order:
            done[at] = True
        for tokenizer, kind in ((self.normal, ~done & ~spelt), (self.tokenizer, spelt)):
            at = np.flatnonzero(kind)
            rest = tokenizer.encode_batch_fast([texts[i] for i in at.tolist()], add_special_tokens=False)
            size[at] = [len(e.ids) for e in rest]
            found.append(np.array([i for e in rest for i in e.ids], np.uint32))
            order.append(at)
        order = np.concatenate(order)
        start = np.empty(len(parts), np.int64)
        start[order] = len(self.flat) + np.cumsum(size[order]) - size[order]
        self.start, self.size = np.r_[self.start, start], np.r_[self.size, size]
        self.stop = np.r_[self.stop, [p[-1] in STOPS for p in texts]]
        self.flat = np.concatenate([self.flat, *found])

    def _parts(self, w: str) -> tuple[str | tuple[str], str]:
        """A word as the tokenizer takes it, and the marks behind it."""
        if any(a in w for a in self.added):
            return (w,), ""
        if not w.isascii() or w != w.lower():
            w = self.tokenizer.normalizer.normalize_str(w)
        if not w.isalpha():
            core = w.rstrip(MARKS)
            if core.isalpha():
                return core, w[len(core) :]
        return w, ""

    def _learn(self, words: list[str]) -> None:
        part, fresh = self.part, []
        known = part.get
        pairs: list[int] = []
        for w in words:
            for p in self._parts(w):
                n = known(p)
                if n is None:
                    n = part[p] = len(part)
                    fresh.append(p)
                pairs.append(n)
        self.of_word = np.concatenate([self.of_word, np.array(pairs, np.int32).reshape(-1, 2)])
        if fresh:
            self._store(fresh)

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per text its ids, the end id last, and the places after which a sentence ends."""
        split = [_words(t, self.added) for t in texts]
        if len(self.word) > REMEMBER:
            self._reset()
        flat_words = list(chain.from_iterable(split))
        code = np.fromiter(map(self.word.__getitem__, flat_words), np.int64, len(flat_words))
        if self.word.fresh:
            self._learn(self.word.fresh)
            self.word.fresh = []
        n = np.array([len(s) for s in split], np.int64)
        ends = np.zeros(0, np.int64)
        stop = np.zeros(0, bool)
        ids = np.zeros(0, np.uint32)
        if flat_words:
            part = self.of_word[code].ravel()
            start, size = self.start[part], self.size[part]
            ends = np.cumsum(size)
            at = np.repeat((start - (ends - size)).astype(np.int32), size)
            at += np.arange(len(at), dtype=np.int32)
            ids = self.flat[at]
            ends = ends[1::2]
            stop = self.stop[part[1::2]]
        cut = np.r_[0, np.cumsum(n)]
        edge = np.r_[0, ends][cut]
        out = []
        for k in range(len(texts)):
            a, b = cut[k], cut[k + 1]
            breaks = ends[a:b][stop[a:b]] - edge[k]
            out.append((np.append(ids[edge[k] : edge[k + 1]], np.uint32(END_ID)), breaks))
        return out


def cuts(sizes: list[int], breaks: list[np.ndarray], length: int = LENGTH) -> np.ndarray:
    """Where to cut the line of documents: ascending token places, 0 and the end included."""
    places, costs, at = [np.zeros(1, np.int64)], [np.zeros(1)], 0
    for size, br in zip(sizes, breaks, strict=True):
        inner = br[(br > 0) & (br < size)]
        cost = np.full(len(inner), SENTENCE_CUT)
        edge = np.r_[0, inner, size]
        long = np.flatnonzero(np.diff(edge) > length // 8)
        if len(long):  # long sentences may also be cut inside, at every 256th part of a sequence
            step = max(1, length // 256)
            extra = np.concatenate([np.arange(edge[i] + step, edge[i + 1], step) for i in long])
            inner = np.r_[inner, extra]
            cost = np.r_[cost, np.full(len(extra), WORD_CUT)]
            o = np.argsort(inner, kind="stable")
            inner, cost = inner[o], cost[o]
        places += [at + inner, np.array([at + size])]
        costs += [cost, np.zeros(1)]
        at += size
    p = np.concatenate(places)
    place, cost = p.tolist(), (np.concatenate(costs) + length).tolist()
    n = len(place)
    back = [0] * n
    # The queue's cuts and their keys f(i) + P(i), keys ascending; those before ``head`` are out of the window.
    queue, keys, head = [0], [0.0], 0
    for j in range(1, n):
        pj = place[j]
        low = pj - length
        while place[queue[head]] < low:
            head += 1
        i = queue[head]
        back[j] = i
        key = cost[j] + keys[head]  # f(j) + P(j)
        while len(keys) > head and keys[-1] >= key:
            keys.pop()
            queue.pop()
        queue.append(j)
        keys.append(key)
    chosen = [n - 1]
    while chosen[-1]:
        chosen.append(back[chosen[-1]])
    return p[chosen[::-1]]


def _pieces(doc_ids: list, docs: list[tuple[np.ndarray, np.ndarray]], first: int, length: int) -> tuple[list[tuple], int]:
    sizes = [len(d[0]) for d in docs]
    cut = cuts(sizes, [d[1] for d in docs], length)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    rows = []
    bounds = np.union1d(cut, np.r_[0, ends])
    a, b = bounds[:-1], bounds[1:]
    doc = np.searchsorted(ends, a, side="right")
    seq = np.searchsorted(cut, a, side="right") - 1
    for x, y, d, s in zip(a.tolist(), b.tolist(), doc.tolist(), seq.tolist(), strict=True):
        lo = x - int(begins[d])
        ids = docs[d][0][lo : lo + y - x]
        rows.append((doc_ids[d], lo, y - x, zlib.crc32(ids.astype("<u4").tobytes()), sizes[d], first + s, x - int(cut[s])))
    return rows, len(cut) - 1


def _packer(path: str, length: int, block: int):
    names = [x.split()[0] for x in PIECES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # it outlives the task, so the next one knows the words of this one
        encoder = held(f"encoder {path}", lambda: Encoder(path))
        task = TaskContext.get()
        sequence = (task.partitionId() if task else 0) << 36
        ids: list = []
        docs: list[tuple[np.ndarray, np.ndarray]] = []
        size_held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal ids, docs, size_held, sequence
            rows, n = _pieces(ids, docs, sequence, length)
            sequence += n
            ids, docs, size_held = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)

        for b in batches:
            some: list[str] = []
            size = 0
            for i, (d, t) in enumerate(zip(b.column(0), b.column(1), strict=True)):
                ids.append(d.as_py())
                some.append(t.as_py() or "")
                size += len(some[-1])
                if size >= SPLIT or i == b.num_rows - 1:
                    got = encoder.encode(some)
                    docs += got
                    size_held += sum(len(g[0]) for g in got)
                    some, size = [], 0
                    if size_held >= block:
                        yield from flush()
        if docs:
            yield from flush()

    return run


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, block: int = BLOCK) -> DataFrame:
    """Pieces of every document; sequence ids are unique, offsets in a sequence gapless from 0.

    ``tokenizer`` is the path of a public tokenizer file, the same on every machine.
    """
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(_packer(tokenizer, length, block), PIECES)


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    import public_tokenizers

    return pack(docs, str(public_tokenizers.path("word_bpe_49k.json")))
