"""A language model whose counts are only in a log-frequency Bloom filter, and scores by it."""

from __future__ import annotations

import ctypes
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.common import binaries, bounded_batches, checkpointed, forget, from_varints, groups, id_remainder, parts, read, to_varints, written

MODULUS, HELD = 7, 2
#: Words whose exact counts every worker holds, for base_score; the counts of the others are joined. The model itself has all words.
SHORTLIST = 1 << 18
#: Weights, as so many tokens, of the lower order in the mixtures of bigrams and trigrams; letters of a spelled word.
TWO, THREE, ORDER = 1000.0, 5.0, 4
#: Counts are quantised to powers of two; each level of an n-gram is a member of the filter.
BITS, HASHES, LEVELS = 12, 4, 48
#: Training tokens to a block of the filter, and to a task's table of n-grams.
BLOCK_TOKENS, TABLE_TOKENS = 1 << 21, 1 << 21
#: n-grams, or letters, that a worker turns into hashes, bits or varints at once; its arrays in between are no longer than that.
STEP = 1 << 18
#: Bytes of the filter that are broadcast at once; a larger one is probed in several passes over the texts.
BROADCAST_BYTES = 256 << 20
#: Levels of a count in an octave, where the list of words may end.
LEVEL_STEPS = 8
END = b" "
#: Letters of a spelled word: 0 its end, a-z, stop, comma, the lead byte of Latin letters, digits, second bytes of the
#: commonest of these letters, other bytes.
LETTERS = 48
_LETTER = np.full(256, LETTERS - 1, np.int64)
for _i in range(26):
    _LETTER[97 + _i] = _i + 1
_LETTER[[46, 44, 0xC3]] = 27, 28, 29
_LETTER[48:58] = 30
for _i, _b in enumerate("áàâäçèéêíîñóöúüß"):
    _LETTER[_b.encode()[1]] = 31 + _i
#: log10 of the chance of a byte given its letter class.
_WITHIN = np.zeros(256)
_WITHIN[48:58] = -1.0
_WITHIN[_LETTER == LETTERS - 1] = -np.log10((_LETTER == LETTERS - 1).sum())
_MARK = 10  # a byte that no word holds stands between spelled words


def words_of(text: bytes | None) -> list[bytes]:
    w = text.lower().split() if text else []
    w.append(END)
    return w


def _hash(w: bytes) -> int:
    return xxhash.xxh64_intdigest(w, seed=42)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class LogFrequencyFilter:
    """A blocked Bloom filter: an n-gram of count c is in it with the levels 1 .. 1 + floor(log2 c).

    A count is read by probing level after level until one is missing. A key's upper bits name its
    block, the lower 40 are looked up in it; a level's bits stand in one word of 64, so that a probe
    reads memory once. first: the number of the first block that is held.
    """

    def __init__(self, bits: np.ndarray, sizes: list[int], blocks: int, first: int = 0):
        self.bits, self.first = bits.view(np.uint64), first
        self.size = np.array(sizes, np.uint64) >> np.uint64(3)
        self.base = (np.cumsum(self.size) - self.size).astype(np.uint64)
        self.blocks, self.whole = blocks, len(sizes) == blocks

    @staticmethod
    def hashed(rest: np.ndarray, level: int) -> np.ndarray:
        return _mix(rest + np.uint64((level * 0x9E3779B97F4A7C15) & (2**64 - 1)))

    @staticmethod
    def places(h: np.ndarray) -> list[np.ndarray]:
        """The bits of a word that hashes set: their lowest parts of six bits; the upper half chooses the word."""
        return [(h >> np.uint64(6 * k)) & np.uint64(63) for k in range(HASHES)]

    @staticmethod
    def block_of(keys: np.ndarray, blocks: int) -> np.ndarray:
        return (keys >> np.uint64(64 - (blocks.bit_length() - 1))).astype(np.int64) if blocks > 1 else np.zeros(len(keys), np.int64)

    @staticmethod
    def build_block(rest: np.ndarray, counts: np.ndarray) -> np.ndarray:
        levels = np.empty(len(counts), np.uint8)
        for a in range(0, len(counts), STEP):
            levels[a : a + STEP] = np.frexp(counts[a : a + STEP].astype(np.float64))[1]  # 1 + floor(log2)
        size = max(64, -(-int(levels.sum(dtype=np.int64)) * BITS // 64) * 64)
        bits = np.zeros(size, bool)
        for a in range(0, len(rest), STEP):
            of, keys = levels[a : a + STEP], rest[a : a + STEP]
            for level in range(1, int(of.max()) + 1):
                h = LogFrequencyFilter.hashed(keys[of >= level], level)
                word = ((h >> np.uint64(32)) * np.uint64(size // 64) >> np.uint64(32)) << np.uint64(6)
                for place in LogFrequencyFilter.places(h):
                    bits[(word | place).astype(np.int64)] = True
        return np.packbits(bits, bitorder="little")

    def levels(self, keys: np.ndarray, step: int = 1 << 15) -> np.ndarray:
        """The highest level of each key in the filter, probed step keys at a time; 0 for one that isn't in it or in another block."""
        return np.concatenate([self._levels(keys[a : a + step]) for a in range(0, len(keys), step)] or [np.zeros(0, np.uint8)])

    def _levels(self, keys: np.ndarray) -> np.ndarray:
        level = np.zeros(len(keys), np.uint8)
        block = self.block_of(keys, self.blocks) - self.first
        alive = np.flatnonzero((block >= 0) & (block < len(self.size)))
        block, rest = block[alive], keys[alive] & _REST
        size, base = self.size[block], self.base[block]
        for j in range(1, LEVELS + 1):
            h = self.hashed(rest, j)
            mask = np.zeros(len(h), np.uint64)
            for place in self.places(h):
                mask |= np.uint64(1) << place
            left = np.flatnonzero((self.bits[((h >> np.uint64(32)) * size >> np.uint64(32)) + base] & mask) == mask)
            alive, rest, size, base = alive[left], rest[left], size[left], base[left]
            if not len(alive):
                break
            level[alive] = j
        return level


_REST = np.uint64((1 << 40) - 1)
#: What a level stands for: 1 for the first, the geometric mean of its octave for the others.
COUNT_OF = np.array([0.0, 1.0, *(1.414 * 2.0 ** np.arange(1, 255))])[:256]
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Kinds of letter counts in their table, by the number of letters.
SPELL = 8


def one(h: np.ndarray) -> np.ndarray:
    return _mix(h + np.uint64(1))


def pairs(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    return _mix(u * _STEP + v)


def triples(t: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    return _mix(pairs(t, u) * _STEP + v)


def before(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words one and two before each of texts in a row; before a text's first stand two ends."""
    u = np.append(_END, h[:-1])
    t = np.append(_END, u[:-1])
    return u, np.where(u == _END, _END, t)


_END = np.uint64(_hash(END))


class Model:
    """What a worker needs to score: the listed words with their exact counts, the letters' table, and a part of the filter."""

    def __init__(self, words: list[bytes], exact: list[int], letter: np.ndarray, n: int, others: int, once: int):
        self.id = {w: i for i, w in enumerate(words)}
        self.exact, self.letter, self.n, self.others, self.once = np.array(exact, float), letter, n, others, max(1, once)
        self.hashes = np.array([_hash(w) for w in words], np.uint64)

    def spelled(self, words: list[bytes]) -> np.ndarray:
        """log10 of the chance of each word's letters and its end."""
        if not words:
            return np.zeros(0)
        raw = np.frombuffer(bytes([_MARK]) + bytes([_MARK]).join(words) + bytes([_MARK]), np.uint8)
        mark = raw == _MARK
        c = np.where(mark, 0, _LETTER[raw])
        word = np.cumsum(mark) - 1
        code, ends = c.copy(), np.flatnonzero(mark)
        since = np.arange(len(raw)) - np.repeat(ends, np.diff(ends, append=len(raw)))
        since[ends] = np.append(0, np.diff(ends))  # a mark ends the word before
        for k in range(1, ORDER):
            back = np.where(since >= k, np.roll(c, k), 0)
            code += back * LETTERS**k
        lp = self.letter[code] + np.where(mark, 0.0, _WITHIN[raw])
        lp[0] = 0.0
        owner = np.where(mark, word - 1, word)
        return np.bincount(owner[1:], lp[1:], minlength=len(words))

    def score(self, ids: np.ndarray, far: np.ndarray, words: list[bytes], levels: np.ndarray) -> np.ndarray:
        """log10 probability of each token of texts in a row.

        ids: numbers of the listed words, others have the number behind the last, are at the places far
        and are words; levels: of each token as a single, behind one, and behind two words. Singles mix
        with the letters, as much for what is new as there are words of one occurrence; pairs with
        singles, triples with pairs. An n-gram whose parts are not known is a false hit of the filter.
        """
        c1, c2, c3 = COUNT_OF[levels.reshape(3, -1)]
        known = ids < len(self.exact)
        c1[known] = self.exact[ids[known]]
        spelled = np.zeros(len(ids))
        spelled[far] = 0.5 * 10.0 ** self.spelled(words) + 0.5 / self.others
        ends = self.exact[0]  # the end is the first listed word
        h1 = np.append(ends, c1[:-1])
        c2 = np.where((c1 > 0) & (h1 > 0), c2, 0)
        starts = np.append(True, ids[:-1] == 0)
        h2 = np.where(starts, ends, np.append(0, c2[:-1]))
        c3 = np.where((c2 > 0) & (h2 > 0), np.minimum(c3, c2), 0)
        p = (c1 + self.once * spelled) / (self.n + self.once)
        p = np.maximum(p, 1e-300)
        p = (c2 + TWO * p) / (np.maximum(h1, c2) + TWO)
        return np.log10((c3 + THREE * p) / (np.maximum(h2, c3) + THREE))


def count_words(docs: DataFrame) -> DataFrame:
    """(word, c) over texts in the column t; a table of counts is passed on whenever it has grown large."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: Counter = Counter()
        out = lambda: pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary()), pa.array(list(c.values()), pa.int64())], ["word", "c"])
        for b in batches:
            for t in b.column(0).to_pylist():
                c.update(words_of(t))
                if len(c) > 400_000:
                    yield out()
                    c.clear()
        yield out()

    return docs.select("t").mapInArrow(run, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


def _placed(keys: np.ndarray, blocks: int) -> np.ndarray:
    """Keys in the order of blocks: the block, and behind it the 40 bits that are looked up in it."""
    return LogFrequencyFilter.block_of(keys, blocks).astype(np.uint64) << np.uint64(40) | keys & _REST


def _rows(placed: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """(block, keys, counts) of distinct placed keys in order: for each block the differences of their lower bits, and counts, as varints."""
    block, rest = (placed >> np.uint64(40)).astype(np.int64), placed & _REST
    heads = np.flatnonzero(np.diff(block, prepend=-1))
    step = np.diff(rest, prepend=np.uint64(0))
    step[heads] = rest[heads]
    cut = np.append(heads, len(placed))
    (k, at), (c, of) = to_varints(step), to_varints(counts)
    return pa.RecordBatch.from_arrays([pa.array(block[heads].astype(np.int32)), binaries(k, at[cut]), binaries(c, of[cut])], ["block", "keys", "counts"])


def count_ngrams(train: DataFrame, blocks: int) -> DataFrame:
    """(block, keys, counts): the pairs and triples of words in the texts of the column t, summed over a table of a task's texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number: dict[bytes, int] = {}
        table, size = np.empty(2 * TABLE_TOKENS, np.uint64), 0

        def out() -> Iterator[pa.RecordBatch]:
            table[:size].sort()
            for a in range(0, size, STEP):  # a key on both sides of a cut is in both rows, which build_filter sums
                keys = table[a : min(a + STEP, size)]
                heads = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
                yield _rows(keys[heads], np.diff(heads, append=len(keys)))

        for b in (x for batch in batches for x in parts(batch, 0)):
            flat = [w for t in b.column(0).to_pylist() for w in words_of(t)]
            for w in set(flat).difference(number):
                number[w] = _hash(w)
            h = np.fromiter(map(number.__getitem__, flat), np.uint64, len(flat))
            if len(number) > 400_000:
                number.clear()
            u, t = before(h)
            for keys in (pairs(u, h), triples(t, u, h)):
                while len(keys):  # a long text may fill several tables
                    now = keys[: len(table) - size]
                    table[size : size + len(now)] = _placed(now, blocks)
                    keys, size = keys[len(now) :], size + len(now)
                    if size == len(table):
                        yield from out()
                        size = 0
        yield from out()

    return train.select("t").mapInArrow(run, "block int, keys binary, counts binary")


def count_singles(counts: DataFrame, blocks: int) -> DataFrame:
    """The words of counts(word, c) in the form of count_ngrams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, first = np.unique(_placed(one(np.array([_hash(w) for w in b.column(0).to_pylist()], np.uint64)), blocks), return_index=True)
            if len(keys):
                yield _rows(keys, b.column(1).to_numpy()[first])

    return counts.select("word", "c").mapInArrow(run, "block int, keys binary, counts binary")


def _letters(counts: DataFrame) -> DataFrame:
    """(kind, code, n) of the letters of all words in counts(word), each distinct word once, as a rare word is spelled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out() -> Iterator[pa.RecordBatch]:
            code = np.concatenate(held) if held else np.zeros(0, np.int64)
            held.clear()
            for k in range(1, ORDER + 1):
                at, t = np.unique(code % LETTERS**k, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), SPELL + k, np.int32)), pa.array(at), pa.array(t)], ["kind", "code", "n"])

        for b in batches:
            words = b.column(0).to_pylist()
            raw = np.frombuffer(b"".join(w + bytes([_MARK]) for w in words), np.uint8)
            mark = raw == _MARK
            own = np.cumsum(mark) - mark
            x = np.where(mark, 0, _LETTER[raw])
            size = np.bincount(own)
            since = np.arange(len(raw)) - np.repeat(np.cumsum(size) - size, size)
            code = x.copy()
            for k in range(1, ORDER):
                code += np.where(since >= k, np.roll(x, k), 0) * LETTERS**k
            held.append(code)
            if sum(map(len, held)) >= STEP:
                yield from out()
        yield from out()

    return counts.select("word").mapInArrow(run, "kind int, code bigint, n bigint").groupBy("kind", "code").agg(F.sum("n").alias("n"))


def letter_table(letters: DataFrame) -> np.ndarray:
    """log10 P(letter | the ORDER - 1 letters before) over LETTERS^ORDER codes, from letters(kind, code, n), mixed after Witten and Bell."""
    found = letters.toArrow()  # LETTERS^ORDER rows and those of the lower orders, at most
    kind, code, n = (found[c].to_numpy() for c in ("kind", "code", "n"))
    p = np.full((1, LETTERS), 1 / LETTERS)
    for k in range(1, ORDER + 1):
        g = np.zeros(LETTERS**k, np.float32)
        at = kind == SPELL + k
        g[code[at]] = n[at]
        g = g.reshape(-1, LETTERS)
        kinds = (g > 0).sum(1, keepdims=True) + 1
        p = ((g + kinds * np.tile(p, (len(g) // len(p), 1))) / (g.sum(1, keepdims=True) + kinds)).astype(np.float32)
    return np.log10(p).ravel()


def build_filter(ngrams: DataFrame) -> DataFrame:
    """(block, bits): the filter's blocks from ngrams(block, keys, counts); a task holds one block's entries, of about BLOCK_TOKENS tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, 1):
            keys = np.concatenate([np.cumsum(from_varints(x.as_py()), dtype=np.uint64) for x in t["keys"]])
            counts = np.concatenate([from_varints(x.as_py()) for x in t["counts"]]).view(np.int64)
            by = np.argsort(keys, kind="stable")
            keys = keys[by]
            counts = counts[by]
            del by
            heads = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            counts = np.add.reduceat(counts, heads)
            keys = keys[heads]
            del heads
            bits = LogFrequencyFilter.build_block(keys, counts)
            yield pa.RecordBatch.from_arrays([t["block"].slice(0, 1).combine_chunks(), pa.array([bits.tobytes()], pa.binary())], ["block", "bits"])

    return ngrams.repartition("block").sortWithinPartitions("block").mapInArrow(run, "block int, bits binary")


def filter_groups(sizes: dict[int, int], blocks: int, most: int) -> list[tuple[int, list[int]]]:
    """(first block, sizes of it and its followers) of each part of the filter that has most bytes or is one block."""
    out: list[tuple[int, list[int]]] = []
    for b in range(blocks):
        size = sizes.get(b, 8)
        if not out or sum(out[-1][1]) + size > most:
            out.append((b, []))
        out[-1][1].append(size)
    return out


def released() -> None:
    """Gives back to the system what this worker's earlier tasks have freed and its allocators keep, before something large is read."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only glibc has it
    if trim:
        trim(0)


class _Packed:
    """What a Model is made of, as it is broadcast: a worker reads a Model out of it, which goes when Spark removes the broadcast."""

    def __init__(self, *made_of):
        self.made_of = made_of

    def __reduce__(self):
        return Model, self.made_of


def score_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs.

    Training texts are those whose id's crc32 modulo MODULUS isn't HELD (a row without an id trains); a
    null or empty text is its end token. All words, pairs and triples of the training texts go into the
    filter with their quantised counts, blocks of it are built on the executors, and its size grows with
    them; at most broadcast_bytes (or a block) are sent to the workers at once, and a larger filter takes
    several passes over the texts. The score mixes triples, pairs, singles and letters. Exact word counts,
    for base_score, go to the workers for the SHORTLIST most frequent words; those of the others are
    joined to the documents' rare words. Repeated rows get a row each; an empty table gives an empty
    one; other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    d = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(id_remainder(F.col(doc_id), MODULUS) == HELD, F.lit(False)).alias("held_out"), F.col(text).cast("binary").alias("t"))
    train = d.filter("NOT held_out")
    counts = checkpointed(count_words(train))
    n, v, once = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.count_if(F.col("c") == 1)).first()
    # The list ends between two of the counts' levels, so no sort of all words is needed to find it.
    level, is_end = F.floor(F.log2("c") * LEVEL_STEPS), F.col("word") == F.lit(bytearray(END))
    lowest, listed = None, 0
    for at, size in sorted(((r["at"], r["count"]) for r in counts.groupBy(level.alias("at")).count().collect()), reverse=True):  # 64 * LEVEL_STEPS rows at most
        listed += size
        if listed > SHORTLIST:
            break
        lowest = at
    often = (level >= lowest) | is_end if lowest is not None else is_end
    top = counts.filter(often).toArrow()  # SHORTLIST rows at most, and the end
    top = sorted(zip(top["word"].to_pylist(), top["c"].to_pylist()), key=lambda r: (r[0] != END, -r[1], r[0])) or [(END, 0)]
    words, exact = [r[0] for r in top], [r[1] for r in top]
    rare = counts.filter(~often)
    others = v - len(exact) + once  # words outside the list, and by Good and Turing as many new ones as there are of one occurrence
    blocks = max(64, 1 << max(0, -(-n // BLOCK_TOKENS) - 1).bit_length())
    whole, at = written(build_filter(count_ngrams(train, blocks).unionByName(count_singles(counts, blocks))))
    sizes = {r[0]: r[1] for r in whole.select("block", F.octet_length("bits")).collect()}  # a number for each block
    shared = spark.sparkContext.broadcast(_Packed(words, exact, letter_table(_letters(counts)), n, max(1, others), once))

    def part(first: int, size: list[int]):
        """The filter's blocks from first on, of at most broadcast_bytes or one block's, for the workers."""
        bits, ends = np.zeros(sum(size), np.uint8), np.cumsum(size)
        for r in whole.filter(F.col("block").between(first, first + len(size) - 1)).toLocalIterator():
            k = r["block"] - first
            bits[ends[k] - size[k] : ends[k]] = np.frombuffer(r["bits"], np.uint8)
        return spark.sparkContext.broadcast((bits, size, blocks, first))

    def read_batch(b: pa.RecordBatch, model: Model):
        each = [words_of(t) for t in b.column(3).to_pylist()]
        flat = [w for ws in each for w in ws]
        ids = np.fromiter(map(model.id.get, flat, repeat(len(model.exact))), np.int64, len(flat))
        far = np.flatnonzero(ids == len(model.exact))
        odd = [flat[i] for i in far]
        hashes = np.array([_hash(w) for w in odd], np.uint64)
        h = np.append(model.hashes, np.uint64(0))[ids]
        h[far] = hashes
        return np.array([len(w) for w in each], np.int64), ids, far, odd, hashes, h

    def probed(b: pa.RecordBatch, size: np.ndarray, far: np.ndarray, h: np.ndarray, part: LogFrequencyFilter) -> np.ndarray:
        """Levels of the batch's n-grams (three rows) from this part and, in the column found, those before."""
        u, t = before(h)
        level = np.zeros((3, len(h)), np.uint8)
        level[0, far] = part.levels(one(h[far]))
        level[1] = part.levels(pairs(u, h))
        # A triple without its pair doesn't count; where the whole filter is here it needs no look.
        look = np.flatnonzero(level[1]) if part.whole else np.arange(len(h))
        level[2, look] = part.levels(triples(t[look], u[look], h[look]))
        if b.num_columns > 4:
            old = b.column(4).to_pylist()
            level = np.maximum(level, np.concatenate([np.frombuffer(x, np.uint8).reshape(3, -1) for x in old], axis=1) if old else level)
        return level

    def look_up(shared_part):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            released()
            model, part = shared.value, LogFrequencyFilter(*shared_part.value)
            for b in (x for batch in batches for x in parts(batch, 3)):
                size, _, far, _, _, h = read_batch(b, model)
                level, ends = probed(b, size, far, h, part), np.cumsum(size)
                found = pa.array([level[:, e - k : e].tobytes() for e, k in zip(ends, size)], pa.binary())
                yield pa.RecordBatch.from_arrays([*b.columns[:4], found], ["row_id", "doc_id", "held_out", "t", "found"])

        return run

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released()
        model, part = shared.value, LogFrequencyFilter(*last.value)
        base = np.log10((np.append(model.exact, 0) + 1) / (n + v + 1))
        seen = np.append(model.exact > 0, False)
        for b in (x for batch in batches for x in parts(batch, 3)):
            size, ids, far, odd, hashes, h = read_batch(b, model)
            starts = np.cumsum(size) - size
            sums = lambda x: np.add.reduceat(x, starts) if len(x) else np.zeros(0)
            of = np.repeat(np.arange(len(size)), size)[far]
            ends = pa.array(np.append(0, np.cumsum(np.bincount(of, minlength=len(size)))).astype(np.int32))
            known = np.where(ids == len(model.exact), 0.0, base[ids])  # the rare ones' share is joined
            score = model.score(ids, far, odd, probed(b, size, far, h, part)) if len(ids) else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array(size), pa.array(sums(seen[ids].astype(np.int64)), pa.int64()), pa.array(sums(known), pa.float64()),
                 pa.array(sums(score), pa.float64()), pa.ListArray.from_arrays(ends, pa.array(hashes.view(np.int64)))],
                ["row_id", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "odd"])

    kind = d.schema["doc_id"].dataType.simpleString()
    rows = d.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", "held_out", "t")
    *earlier, final = filter_groups(sizes, blocks, broadcast_bytes)
    for g in earlier:
        now = part(*g)
        rows = checkpointed(rows.mapInArrow(look_up(now), f"row_id bigint, doc_id {kind}, held_out boolean, t binary, found binary"))
        now.unpersist()
    last = part(*final)
    out = checkpointed(rows.mapInArrow(run, f"row_id bigint, doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double, odd array<bigint>"))
    forget(spark, at)
    least_base = float(np.log10(1 / (n + v + 1)))
    odd = out.select("row_id", F.explode("odd").alias("h")).join(rare.select(F.xxhash64("word").alias("h"), "c"), "h")
    gain = odd.groupBy("row_id").agg(F.count("*").alias("_k"), F.sum(F.log10(F.col("c") + 1)).alias("_g"))
    out = out.join(gain, "row_id", "left")
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("_k", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.size("odd") * F.lit(least_base) + F.coalesce("_g", F.lit(0.0))).alias("base_score"), "score")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(read(spark, sf_dir, "documents"))
