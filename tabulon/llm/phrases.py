"""Phrases that stand together more often than chance, counted in quotient filters.

Words that occur often enough in their language get dense numbers, so a phrase
is a few packed bits: k word numbers of b bits each.  A counting quotient filter
holds phrases with their counts and loses nothing: the packed bits are permuted
invertibly (each word number in turn is xored with a hash of the others), the top
bits are the quotient, which says where an entry stands, and all other bits, the
full remainder, are stored beside the count.  Quotients cost one small run length
a slot instead of their bits in every entry.

Documents are read in batches of some MB.  A batch lists its words, cut into
ranges of a hash; one task joins a range over all batches, numbers the words that
are frequent, and answers each batch.  Then every batch counts its own phrases in
a filter, sorted by the permuted bits, and cuts it into ranges of the quotient;
one task merges the sorted filters of one range over all batches.  The
permutation spreads phrases evenly, so no phrase, however frequent, makes a range
larger than the others: it is one entry a batch.  The task answers each batch
with one bit an entry: frequent or not.  A phrase of k + 1 words can only be
frequent where both its phrases of k words are, so each length is counted at the
places that are left of the length before, and nothing is ever estimated.

The number of ranges follows the number of entries, so a range is a bounded
amount of memory; only cells (batch, range) that hold entries are sent, at most
one an entry, so on a very large corpus the exchange approaches an ordinary
shuffle by key and never passes it.

Results for odd input: a null text counts as empty; a null language is ``und``;
repeated rows and ids are counted each; texts are read whole at any length; no
word or phrase often enough, or an empty table, gives an empty result; other
columns of any name are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from .blocks import packed, unpacked
from .common import drop_written, mix64, table, written

LONGEST, LEAST, TOP = 5, 100, 2000
#: bytes of text a batch, entries a range (each at most as often as it occurs)
BYTES, RANGE = 24_000_000, 3_000_000
#: rounds of the permutation
ROUNDS = 3

#: an end of a piece (or of a language's name), and what stands between packed words: no bytes of UTF-8
_END, _GAP = b"\xff", b"\xfe"
_PLAIN = bytes.maketrans(bytes(range(65, 91)) + b".,;:!?\n\x0b\x0c\r", bytes(range(97, 123)) + _END * 10)


def words_and_ends(text: str | None) -> list[bytes]:
    """Lower-cased words, with an end mark between pieces."""
    return text.encode().translate(_PLAIN).replace(_END, b" \xff ").split() if text else []


# ------------------------------------------------------------ quotient filters

def field(limbs: list[np.ndarray], low: int, width: int) -> np.ndarray:
    """Bits low .. low + width - 1 (at most 64) of numbers kept as 64-bit limbs, lowest first."""
    k, shift = divmod(low, 64)
    out = limbs[k] >> np.uint64(shift) if k < len(limbs) else np.zeros_like(limbs[0])
    if shift + width > 64 and k + 1 < len(limbs):
        out = out | limbs[k + 1] << np.uint64(64 - shift)
    return out & np.uint64((1 << width) - 1)


def put(limbs: list[np.ndarray], low: int, width: int, value: np.ndarray) -> None:
    k, shift = divmod(low, 64)
    limbs[k] |= value << np.uint64(shift)
    if shift + width > 64:
        limbs[k + 1] |= value >> np.uint64(64 - shift)


def _scrambled(parts: list[np.ndarray], bits: int, steps) -> list[np.ndarray]:
    parts, mask = [p.copy() for p in parts], np.uint64((1 << bits) - 1)
    for step in steps:
        j = step % len(parts)
        h = np.full(len(parts[0]), 0x9E3779B97F4A7C15 * (step + 1) & (1 << 64) - 1, np.uint64)
        for i, p in enumerate(parts):
            if i != j:
                h = mix64(h ^ p)
        parts[j] ^= h & mask
    return parts


def permute(ids: list[np.ndarray], bits: int) -> list[np.ndarray]:
    """Word numbers (k arrays, below 2^bits) -> permuted k * bits bits as limbs."""
    k = len(ids)
    limbs = [np.zeros(len(ids[0]), np.uint64) for _ in range(-(-k * bits // 64))]
    for j, p in enumerate(_scrambled(ids, bits, range(ROUNDS * k))):
        put(limbs, j * bits, bits, p)
    return limbs


def restore(limbs: list[np.ndarray], bits: int, k: int) -> list[np.ndarray]:
    """The word numbers that :func:`permute` made ``limbs`` of."""
    return _scrambled([field(limbs, j * bits, bits) for j in range(k)], bits, reversed(range(ROUNDS * k)))


def grouped(limbs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorting order, begins of equal keys in it, and the group of every key."""
    order = np.argsort(limbs[0], kind="stable") if len(limbs) == 1 else np.lexsort(limbs)
    first = np.ones(len(order), bool)
    first[1:] = False
    for limb in limbs:
        s = limb[order]
        first[1:] |= s[1:] != s[:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(first) - 1
    return order, np.flatnonzero(first), group


def _small(a: np.ndarray) -> np.ndarray:
    """In the narrowest unsigned type that holds all values."""
    top = int(a.max(initial=0))
    return a.astype(next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if top <= np.iinfo(t).max))


class QuotientFilter:
    """Distinct permuted keys of ``width`` bits, sorted, with counts."""

    def __init__(self, limbs: list[np.ndarray], counts: np.ndarray, width: int):
        self.limbs, self.counts, self.width = limbs, counts, width

    def cells(self, cut: int):
        """(range, bytes) of the parts that have the same ``cut`` top bits."""
        at = field(self.limbs, self.width - cut, cut) if cut else np.zeros(len(self.counts), np.uint64)
        begin = np.flatnonzero(np.r_[len(at) > 0, at[1:] != at[:-1]])
        for lo, hi in zip(begin, np.r_[begin[1:], len(at)]):
            yield int(at[lo]), self._packed([x[lo:hi] for x in self.limbs], self.counts[lo:hi], self.width - cut)

    @staticmethod
    def _packed(limbs, counts, width: int) -> bytes:
        slots = min(len(counts).bit_length() - 1, width, 24)
        low = width - slots
        runs = np.bincount(field(limbs, low, slots).astype(np.int64), minlength=1 << slots) if slots else np.array([len(counts)])
        rest = {f"r{i}": _small(field(limbs, 64 * i, min(64, low - 64 * i))) for i in range(-(-low // 64))}
        return packed(runs=_small(runs), counts=_small(counts), **rest)

    @classmethod
    def unpack(cls, data: bytes, at: int, cut: int, width: int) -> QuotientFilter:
        a = unpacked(data)
        n, slots = len(a["counts"]), len(a["runs"]).bit_length() - 1
        limbs = [np.zeros(n, np.uint64) for _ in range(-(-width // 64))]
        low = width - cut - slots
        for i in range(-(-low // 64)):
            limbs[i] |= a[f"r{i}"].astype(np.uint64)
        if slots:
            put(limbs, low, slots, np.repeat(np.arange(1 << slots, dtype=np.uint64), a["runs"]))
        if cut:
            put(limbs, width - cut, cut, np.full(n, at, np.uint64))
        return cls(limbs, a["counts"].astype(np.int64), width)


def merged(filters: list[QuotientFilter]) -> tuple[QuotientFilter, np.ndarray]:
    """One filter with all counts added, and the entry of every entry given."""
    limbs = [np.concatenate(x) for x in zip(*(f.limbs for f in filters))]
    order, begin, group = grouped(limbs)  # a merge: the parts are sorted runs
    total = np.add.reduceat(np.concatenate([f.counts for f in filters])[order], begin)
    return QuotientFilter([x[order[begin]] for x in limbs], total, filters[0].width), group


# ------------------------------------------------------------ streams of words

def windows(ids: np.ndarray, k: int) -> np.ndarray:
    """Where k numbers begin that have no end mark (0) among them."""
    if len(ids) < k:
        return np.empty(0, np.int64)
    ends = np.concatenate([[0], np.cumsum(ids == 0)])
    return np.flatnonzero(ends[k:] == ends[:-k])


def counted(ids: np.ndarray, k: int, bits: int):
    """Filter of the phrases of k words, where they begin, and the entry of each."""
    at = windows(ids, k)
    limbs = permute([ids[at + j].astype(np.uint64) for j in range(k)], bits)
    order, begin, group = grouped(limbs)
    return QuotientFilter([x[order[begin]] for x in limbs], np.bincount(group, minlength=len(begin)), k * bits), at, group


def narrowed(ids: np.ndarray, at: np.ndarray, good: np.ndarray, k: int) -> np.ndarray:
    """The parts of ``ids`` in which every phrase of k words is good and that hold
    longer ones, with end marks between them."""
    at = at[good]
    if not len(at):
        return ids[:0]
    begin = np.flatnonzero(np.r_[True, np.diff(at) != 1])
    long_ = np.diff(np.r_[begin, len(at)])  # phrases in a row
    begin, long_ = at[begin[long_ > 1]], long_[long_ > 1]
    size = long_ + k  # words in a row, and the end mark
    stop = np.cumsum(size)
    out = np.repeat(begin - (stop - size), size) + np.arange(stop[-1] if len(stop) else 0)
    found = ids[np.minimum(out, len(ids) - 1)]
    found[stop - 1] = 0
    return found


def ranges_for(entries: int) -> int:
    """Top bits that cut ``entries`` into ranges of about RANGE."""
    return max(0, math.ceil(math.log2(max(1, entries) / RANGE)))


def packed_ids(ids: np.ndarray) -> bytes:
    """Word numbers by planes of bytes: frequent words have small numbers, so the
    upper planes are mostly 0."""
    width = max(1, -(-int(ids.max(initial=0)).bit_length() // 8))
    return packed(**{f"b{i}": (ids >> ids.dtype.type(8 * i)).astype(np.uint8) for i in range(width)})


def unpacked_ids(data: bytes) -> np.ndarray:
    planes = unpacked(data)
    kind = np.uint32 if len(planes) <= 4 else np.uint64
    out = np.zeros(len(planes["b0"]), kind)
    for i in range(len(planes)):
        out |= planes[f"b{i}"].astype(kind) << kind(8 * i)
    return out


class _Slots(dict):
    """Word -> number within its batch."""

    def __init__(self, lang: str, names: list):
        super().__init__({_END: 0})
        self.lang, self.names = lang.encode() + _END, names

    def __missing__(self, word: bytes) -> int:
        self.names.append(self.lang + word)
        self[word] = len(self.names)
        return len(self.names)


_BATCH = "batch long, words long, stream binary, places binary, names binary, counts binary"
_BATCH_ROWS = pa.schema([("batch", pa.int64()), ("words", pa.int64()), ("stream", pa.binary()), ("places", pa.binary()), ("names", pa.binary()), ("counts", pa.binary())])


def _hashes(names: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, names), np.uint64, len(names))


def _batch_row(batch: int, names: list, parts: list) -> pa.RecordBatch:
    """A batch's texts as numbers of its words, the most frequent first (0 ends a
    piece); its words and their counts in the order of their hashes, and the
    number of the word at each place of that order."""
    ids = np.concatenate(parts)
    counts = np.bincount(ids, minlength=len(names) + 1)[1:]
    number = np.zeros(len(names) + 1, np.uint32)
    number[np.argsort(-counts, kind="stable") + 1] = np.arange(1, len(names) + 1)
    order = np.argsort(_hashes(names), kind="stable")
    text = zstandard.ZstdCompressor(level=1).compress(_GAP.join([names[i] for i in order]))
    return table(_BATCH_ROWS, batch=[batch], words=[len(names)], stream=[packed_ids(number[ids])], places=[packed(at=number[order + 1])], names=[text], counts=[packed(n=_small(counts[order]))])


def _read(record_batches):
    batch, names, slots, parts, size = TaskContext.get().partitionId() << 24, [], {}, [], 0
    for b in record_batches:
        for lang, cell in zip(b.column(0).to_pylist(), b.column(1)):
            text = cell.as_py()
            if not text:
                continue
            if lang not in slots:
                slots[lang] = _Slots(lang, names)
            found = words_and_ends(text)
            found.append(_END)
            parts.append(np.fromiter(map(slots[lang].__getitem__, found), np.int32, len(found)))
            size += len(text)
            if size >= BYTES:
                yield _batch_row(batch, names, parts)
                batch, names, slots, parts, size = batch + 1, [], {}, [], 0
    if parts:
        yield _batch_row(batch, names, parts)


def _word_cells(cut: int):
    """Every batch's words and counts, cut into ranges of their hashes."""
    def split(record_batches):
        for b in record_batches:
            for batch, names, counts in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                raw = zstandard.ZstdDecompressor().decompress(names.as_py())
                names, counts = raw.split(_GAP) if raw else [], unpacked(counts.as_py())["n"]
                at = _hashes(names) >> np.uint64(64 - cut) if cut else np.zeros(len(names), np.uint64)
                begin = np.flatnonzero(np.r_[len(at) > 0, at[1:] != at[:-1]])
                cells = [(int(at[lo]), packed(text=np.frombuffer(_GAP.join(names[lo:hi]), np.uint8), n=counts[lo:hi]))
                         for lo, hi in zip(begin, np.r_[begin[1:], len(at)])]
                yield table(_STEP_ROWS, batch=[batch] * len(cells), range=[r for r, _ in cells], data=[d for _, d in cells])
    return split


_WORDS = "batch long, range long, data binary, number long, lang string, word string, n long"
_WORD_ROWS = pa.schema([("batch", pa.int64()), ("range", pa.int64()), ("data", pa.binary()), ("number", pa.int64()), ("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = len(self)
        return len(self) - 1


def _merge_words(least: int):
    """One range of words over all batches: answers (the number of every word
    asked for within the range, 0 if it is too rare), the words that are frequent
    (number, lang, word, n), and how many words each language has (number 0)."""
    def merge(key, rows):
        numbers, asked, total = _Numbers(), [], np.zeros(0, np.int64)
        for d in rows.column("data"):
            cell = unpacked(d.as_py())
            words = cell["text"].tobytes().split(_GAP)
            at = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
            if len(numbers) > len(total):
                total = np.concatenate([total, np.zeros(max(len(numbers) - len(total), len(total)), np.int64)])
            total[at] += cell["n"]  # words of a cell are distinct
            asked.append(at.astype(np.uint32))
        total = total[:len(numbers)]
        good = np.flatnonzero(total >= least)
        good = good[np.argsort(-total[good], kind="stable")]  # the most frequent first
        answer = np.zeros(len(numbers), np.uint32)
        answer[good] = np.arange(1, len(good) + 1)
        keys, langs = list(numbers), {}
        for k, n in zip(keys, total.tolist()):
            lang = k[:k.index(_END)]
            langs[lang] = langs.get(lang, 0) + n
        found = [keys[i].split(_END, 1) for i in good.tolist()]
        cells, m, at = len(asked), len(found), key[0].as_py()
        more = m + len(langs)
        return pa.Table.from_batches([table(
            _WORD_ROWS, batch=pa.array(rows.column("batch").to_pylist() + [None] * more, pa.int64()), range=[at] * (cells + more),
            data=[packed(id=_small(answer[a])) for a in asked] + [None] * more, number=pa.array([None] * cells + list(range(1, m + 1)) + [0] * len(langs), pa.int64()),
            lang=[None] * cells + [x.decode() for x, _ in found] + [x.decode() for x in langs], word=[None] * cells + [w.decode() for _, w in found] + [None] * len(langs),
            n=pa.array([None] * cells + total[good].tolist() + list(langs.values()), pa.int64()))])

    return merge


_STEP = "batch long, range long, data binary"
_STEP_ROWS = pa.schema([("batch", pa.int64()), ("range", pa.int64()), ("data", pa.binary())])


def _step(batch: int, ids: np.ndarray, k: int, bits: int, cut: int) -> pa.Table:
    """What a batch hands on: its words (range -1), and its filter of phrases of k
    words in cells."""
    if not len(ids):
        return pa.Table.from_batches([], _STEP_ROWS)
    found, at, _ = counted(ids, k, bits)
    if not len(at):
        return pa.Table.from_batches([], _STEP_ROWS)
    cells = [(-1, packed_ids(ids)), *found.cells(cut)]
    return pa.Table.from_batches([table(_STEP_ROWS, batch=[batch] * len(cells), range=[r for r, _ in cells], data=[d for _, d in cells])])


def word_number(number, at, ranges: int):
    """Number over all ranges of the word with a number in range ``at``: small for
    frequent words whatever their range."""
    return (number - 1) * ranges + at + 1


def _encode(ranges: int, bits: int, cut: int):
    """A batch's texts (range -1), its words' places (-2), and the answers on its
    words -> its texts as numbers of frequent words, and its filter of phrases of
    two words."""
    kind = np.uint32 if bits <= 32 else np.uint64

    def encode(key, rows):
        order = np.argsort(rows.column("range").to_numpy(), kind="stable")
        at, data = rows.column("range").to_numpy()[order], rows.column("data").take(pa.array(order))
        places, ids = unpacked(data[0].as_py())["at"], unpacked_ids(data[1].as_py())
        found = []
        for r, d in zip(at[2:].tolist(), data[2:]):
            a = unpacked(d.as_py())["id"].astype(np.int64)
            found.append(np.where(a > 0, word_number(a, r, ranges), 0).astype(kind))
        of = np.zeros(len(places) + 1, kind)  # number 0 ends a piece, as words that are too rare do
        of[places] = np.concatenate(found) if found else 0
        return _step(key[0].as_py(), _joined_ends(of[ids]), 2, bits, cut)

    return encode


def _joined_ends(ids: np.ndarray) -> np.ndarray:
    """Without words that stand alone between ends, and with one end mark for several."""
    word = np.r_[False, ids != 0, False]
    keep = word[1:-1] & (word[:-2] | word[2:])
    return ids[keep | (word[:-2] & ~word[1:-1])]


_FOUND = "batch long, range long, data binary, gram array<long>, n long"
_FOUND_ROWS = pa.schema([*_STEP_ROWS, ("gram", pa.list_(pa.int64())), ("n", pa.int64())])


def _merge(k: int, bits: int, cut: int, least: int):
    def merge(key, rows):
        batches, at = rows.column("batch").to_pylist(), key[0].as_py()
        parts = [QuotientFilter.unpack(d.as_py(), at, cut, k * bits) for d in rows.column("data")]
        total, group = merged(parts)
        good = total.counts >= least
        grams = np.stack(restore([x[good] for x in total.limbs], bits, k), 1).astype(np.int64)
        flags = np.split(good[group], np.cumsum([len(p.counts) for p in parts])[:-1])
        n, m = len(parts), len(grams)
        return pa.Table.from_batches([table(
            _FOUND_ROWS, batch=pa.array(batches + [None] * m, pa.int64()), range=pa.array([at] * n + [None] * m, pa.int64()),
            data=[np.packbits(f).tobytes() for f in flags] + [None] * m, gram=[None] * n + list(grams), n=pa.array([None] * n + total.counts[good].tolist(), pa.int64()))])

    return merge


def _advance(k: int, bits: int, cut: int, next_cut: int):
    """The words of a batch and the answers to its filter of phrases of k words ->
    the words that are left, and the filter of phrases of k + 1 words."""
    def advance(key, rows):
        order = np.argsort(rows.column("range").to_numpy(), kind="stable")
        data = rows.column("data").take(pa.array(order))
        ids = unpacked_ids(data[0].as_py())
        found, at, group = counted(ids, k, bits)
        top = field(found.limbs, found.width - cut, cut) if cut else np.zeros(len(found.counts), np.uint64)
        size = np.unique(top, return_counts=True)[1]
        good = np.concatenate([np.unpackbits(np.frombuffer(d.as_py(), np.uint8), count=n) for d, n in zip(data[1:], size, strict=True)]).astype(bool)
        return _step(key[0].as_py(), narrowed(ids, at, good[group], k), k + 1, bits, next_cut)

    return advance


def frequent_phrases(documents: DataFrame, longest: int = LONGEST, least: int = LEAST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(grams, dictionary, totals): gram (word numbers) and n of all words and
    phrases of up to ``longest`` words that occur ``least`` times in their
    language; lang, word, n, id; lang and n of all words."""
    spark = documents.sparkSession
    docs = documents.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    read = written(docs.mapInArrow(_read, _BATCH), "phrase-batches")
    cut = ranges_for(read.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0])
    cells = read.select("batch", "names", "counts").mapInArrow(_word_cells(cut), _STEP)
    words = written(cells.groupBy("range").applyInArrow(_merge_words(least), _WORDS), "phrase-words")
    numbered = words.filter("number > 0").withColumn("id", word_number(F.col("number"), F.col("range"), 1 << cut))
    dictionary = written(numbered.select("lang", "word", "n", "id"), "dictionary")
    size, entries = dictionary.agg(F.max("id"), F.sum("n")).first()
    totals = written(words.filter("number = 0").groupBy("lang").agg(F.sum("n").alias("n")), "word-totals")
    grams = [dictionary.select(F.array("id").alias("gram"), "n")]
    if size and longest > 1:
        bits, ranges = int(size).bit_length(), 1 << cut
        cut = min(ranges_for(entries), bits)
        texts = [read.select("batch", F.lit(r).cast("long").alias("range"), F.col(c).alias("data")) for r, c in ((-1, "stream"), (-2, "places"))]
        both = texts[0].unionByName(texts[1]).unionByName(words.filter("batch is not null").select("batch", "range", "data"))
        step = written(both.groupBy("batch").applyInArrow(_encode(ranges, bits, cut), _STEP), "phrases-2")
        drop_written(read)
        drop_written(words)
        for k in range(2, longest + 1):
            found = written(step.filter("range >= 0").groupBy("range").applyInArrow(_merge(k, bits, cut, least), _FOUND), f"phrases-{k}-found")
            grams.append(found.filter("gram is not null").select("gram", "n"))
            entries = found.agg(F.sum("n")).first()[0]
            if k == longest or not entries:
                break
            next_cut = min(ranges_for(entries), bits)
            both = step.filter("range = -1").unionByName(found.filter("gram is null").select("batch", "range", "data"))
            after = written(both.groupBy("batch").applyInArrow(_advance(k, bits, cut, next_cut), _STEP), f"phrases-{k + 1}")
            drop_written(step)
            step, cut = after, next_cut
        drop_written(step)
    all_ = grams[0]
    for g in grams[1:]:
        all_ = all_.unionByName(g)
    return written(all_, "grams") if len(grams) > 1 else all_, dictionary, totals


# ------------------------------------------------------------ scores

def _whole(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(38,0)")


def collocations(documents: DataFrame, longest: int = LONGEST, least: int = LEAST, top: int = TOP) -> DataFrame:
    """The first ``top`` phrases of every language: lang, rank, phrase, a, l, r, n, score."""
    grams, dictionary, totals = frequent_phrases(documents, longest, least)
    size = F.size("gram")
    lang = dictionary.select(F.col("id").alias("first"), "lang").join(totals, "lang")
    c = grams.filter(size > 1).select("gram", F.col("n").alias("a"), F.col("gram")[0].alias("first")).join(lang, "first").drop("first")
    cuts = c.select("*", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.select("*", F.slice("gram", F.lit(1), F.col("k")).alias("left"), F.slice("gram", F.col("k") + 1, size - F.col("k")).alias("right"))
    side = lambda as_, n: grams.select(F.col("gram").alias(as_), F.col("n").alias(n))
    cuts = cuts.join(side("left", "l"), "left").join(side("right", "r"), "right")
    # exact: whole decimals of 38 digits, whole division
    cuts = cuts.withColumn("over", _whole("a") * _whole("n") * _whole(F.lit(1000))).withColumn("under", _whole("l") * _whole("r"))
    cuts = cuts.withColumn("score", F.expr("over div under"))
    scored = cuts.groupBy("gram", "lang", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # a phrase in a longer one as frequent: one word longer will do, as counts never grow with length
    longer = grams.filter(size > 2).select(F.explode(F.array(F.slice("gram", F.lit(1), size - 1), F.slice("gram", F.lit(2), size - 1))).alias("gram"), F.col("n").alias("m"))
    longer = longer.groupBy("gram").agg(F.max("m").alias("m"))
    kept = scored.join(longer, "gram", "left").filter(F.col("m").isNull() | (F.col("m") < F.col("a"))).select("gram", "lang", "a", "n", "cut.score", "cut.l", "cut.r")
    order = [F.desc("score"), F.desc("a")]
    first = kept.withColumn("place", F.rank().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("place") <= top).drop("place")
    first = written(first, "phrases-first")
    words = first.select("gram", F.posexplode("gram").alias("pos", "id")).join(dictionary.select("id", "word"), "id")
    words = words.groupBy("gram").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    out = first.join(words, "gram").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order, F.asc("phrase"))).cast("long"))
    return out.filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
