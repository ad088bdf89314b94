"""A positional inverted index of the training texts, searched for exact phrases and for phrases with words put in."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sluice.llm.common import apart, binaries, bounded_batches, checkpointed, forget, from_varints, having, parts, read, rows_by_key, to_varints, written

WINDOW = 10
#: Words that may stand between those of a window, in all, in a proximity match.
SLOP = 4
#: Words and documents of a segment of the index, and places left free behind a document: no phrase reaches over them.
SEGMENT_WORDS, SEGMENT_DOCS, GAP = 1 << 22, 1 << 16, 1024
#: A term with more places in a segment is dealt out by segment too, so that no partition holds all of a frequent term.
HOT = 4096
#: Words by which a phrase is followed one list at a time; the lists of the rest are looked up together.
PART = 3
#: Word bytes are digits, a-z and all that isn't ASCII; A-Z are lower-cased, the rest separates.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def tokens(text: bytes | str | None) -> list[bytes]:
    if text is None:
        return []
    return (text.encode() if isinstance(text, str) else text).translate(_TABLE).split()


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", segment_words: int = SEGMENT_WORDS) -> tuple[DataFrame, str]:
    """The index of all words of all texts, and where it stands in the shared folder; it serves any number of benchmarks.

    A row for each term and segment: term, seg, n, places (ascending, as varints of differences); and
    a row without a term for each document: seg, start (its first place), n_words, doc_id. A segment is
    a stretch of a task's documents, whose places are numbered on. Rows are dealt out by term (a
    frequent one's by segment too) and stand in the order of terms, so a term leads to its lists.
    """
    bounded_batches(docs.sparkSession)
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("t"))
    names = ["term", "seg", "salt", "n", "places", "doc_id", "start", "n_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment = TaskContext.get().partitionId() << 32
        kind = None

        def fresh():
            numbers: defaultdict[bytes, int] = defaultdict()
            numbers.default_factory = numbers.__len__
            return numbers, [], [], []

        def rows() -> Iterator[pa.RecordBatch]:
            size = np.array([len(x) for x in found], np.int64)
            start = np.cumsum(size + GAP) - size - GAP
            place = np.arange(size.sum()) + np.repeat(GAP * np.arange(len(size)), size)
            key = np.sort(np.concatenate(found).astype(np.int64) << 32 | place)  # by term, then place
            term, place = key >> 32, key & 0xFFFFFFFF
            heads = np.flatnonzero(np.diff(term, prepend=-1))
            step = np.diff(place, prepend=0)
            step[heads] = place[heads]
            raw, ends = to_varints(step)
            n = np.diff(heads, append=len(key))
            seg = pa.array(np.full(len(heads), segment))
            none = lambda t: pa.nulls(len(heads), t)
            out = pa.RecordBatch.from_arrays([pa.array(list(numbers), pa.binary()), seg, pa.array(np.where(n > HOT, segment + 1, 0)), pa.array(n), binaries(raw, ends[np.append(heads, len(key))]), none(kind), none(pa.int64()), none(pa.int64())], names)
            for k in range(0, out.num_rows, 16384):
                yield out.slice(k, 16384)
            none = lambda t: pa.nulls(len(size), t)
            ids = pa.chunked_array(docs_of, kind).combine_chunks()
            ids = ids if isinstance(ids, pa.Array) else pa.concat_arrays(ids.chunks)
            yield pa.RecordBatch.from_arrays([none(pa.binary()), pa.array(np.full(len(size), segment)), pa.array(segment + np.arange(len(size)) % 64), none(pa.int64()), none(pa.binary()), ids, pa.array(start), pa.array(size)], names)

        numbers, found, docs_of, words = *fresh()[:3], 0
        for b in (x for batch in batches for x in parts(batch, 1)):
            kind = b.column(0).type
            docs_of.append(b.column(0))
            for t in b.column(1).to_pylist():
                w = tokens(t)
                found.append(np.fromiter(map(numbers.__getitem__, w), np.int32, len(w)))
                words += len(w)
            if words >= segment_words or len(found) >= SEGMENT_DOCS - 1024:
                yield from rows()
                segment += 1
                numbers, found, docs_of, words = *fresh()[:3], 0
        if found:
            yield from rows()

    kind = d.schema["doc_id"].dataType.simpleString()
    index = d.mapInArrow(run, f"term binary, seg bigint, salt bigint, n bigint, places binary, doc_id {kind}, start bigint, n_words bigint")
    return written(index.repartition("term", "salt").sortWithinPartitions("term", "seg").drop("salt"))


def item_windows(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", width: int = WINDOW) -> DataFrame:
    """Distinct (item, phrase): the windows of width words, joined by a space; a text of fewer words is one, one of none has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                w = tokens(t)
                every = list({b" ".join(w[k : k + width]) for k in range(max(1, len(w) - width + 1))}) if w else []
                for k in range(0, len(every), 10_000):
                    some = every[k : k + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array([i] * len(some), pa.string()), pa.array(some, pa.binary())], ["item", "phrase"])

    items = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(text).cast("binary").alias("t")).filter("i IS NOT NULL AND t IS NOT NULL")
    return items.mapInArrow(run, "item string, phrase binary").distinct()


def _growth(phrase: bytes, n: list[int]) -> list[tuple[bytes, bytes, int]]:
    """How a phrase grows from its rarest word, each time by the rarer of the two words beside it: (part, word, side).

    A part is named by its words and the place of the rarest in it; phrases that overlap share parts.
    """
    w = phrase.split(b" ")
    a = b = r = min(range(len(w)), key=lambda k: (n[k], w[k], k))
    out = [(b"0 " + w[r], w[r], 0)]
    while b - a + 1 < len(w):
        if b + 1 == len(w) or a > 0 and n[a - 1] <= n[b + 1]:
            a -= 1
            word, side = w[a], -1
        else:
            b += 1
            word, side = w[b], 1
        out.append((b"%d " % (r - a) + b" ".join(w[a : b + 1]), word, side))
    return out


def _extend(rows: DataFrame, slop: int) -> DataFrame:
    """(node, seg, low, high): the requests' spans with the nearest place of their word on their side.

    rows: the lists (places) and the requests (child, side, words, low, high) of each term and segment, a list before its requests.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, at = np.zeros(0, np.int64), None
        for b in batches:
            out: list[tuple] = []
            for term, seg, listed, child, side, words, low, high in zip(*(b.column(k) for k in range(8))):
                if listed.is_valid:
                    places, at = np.cumsum(from_varints(listed.as_py()).astype(np.int64)), (term, seg)
                    continue
                if at != (term, seg):  # no list
                    continue
                low, high, side, n = low.values.to_numpy(), high.values.to_numpy(), side.as_py(), words.as_py()
                k = np.searchsorted(places, low) - 1 if side < 0 else np.searchsorted(places, high, "right")
                ok = (k >= 0) & (k < len(places))
                low, high, k = low[ok], high[ok], k[ok]
                low, high = (places[k], high) if side < 0 else (low, places[k])
                ok = high - low + 1 - n <= slop
                if ok.any():
                    out.append((child.as_py(), seg.as_py(), low[ok], high[ok]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.binary()), pa.array([r[1] for r in out], pa.int64()), *(pa.array([r[k] for r in out], pa.list_(pa.int64())) for k in (2, 3))], ["node", "seg", "low", "high"])

    return rows.mapInArrow(run, "node binary, seg bigint, low array<bigint>, high array<bigint>")


def _nearby(rows: DataFrame) -> DataFrame:
    """(node, seg, term, counts, near): for each span of a request the places of its word within `reach`, how many and which.

    rows: the lists and the requests (node, reach, low, high) of each term and segment, a list before its requests.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, at = np.zeros(0, np.int64), None
        for b in batches:
            out: list[tuple] = []
            for term, seg, listed, node, reach, low, high in zip(*(b.column(k) for k in range(7))):
                if listed.is_valid:
                    places, at = np.cumsum(from_varints(listed.as_py()).astype(np.int64)), (term, seg)
                    continue
                if at == (term, seg):
                    first = np.searchsorted(places, low.values.to_numpy() - reach.as_py())
                    n = np.searchsorted(places, high.values.to_numpy() + reach.as_py(), "right") - first
                    k = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
                    out.append((node.as_py(), seg.as_py(), term.as_py(), n, places[k]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.binary(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())))], ["node", "seg", "term", "counts", "near"])

    return rows.mapInArrow(run, "node binary, seg bigint, term binary, counts array<bigint>, near array<bigint>")


def _complete(rows: DataFrame, slop: int) -> DataFrame:
    """(phrase, words, seg, low, high) from, for each node and segment in this order, its spans, the places near them, its phrases.

    A phrase's remaining words are taken from the part outwards, each the nearest behind the last.
    """
    far = np.int64(1) << 33

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, low, high, near = None, np.zeros(0, np.int64), np.zeros(0, np.int64), {}
        for b in batches:
            out: list[tuple] = []
            for node, seg, kind, x, y, word, begin in zip(*(b.column(k) for k in range(7))):
                if kind.as_py() == 0:
                    at, low, high, near = (node, seg), x.values.to_numpy(), y.values.to_numpy(), {}
                elif at != (node, seg):
                    continue
                elif kind.as_py() == 1:
                    near[word.as_py()] = np.repeat(np.arange(len(low)), x.values.to_numpy()) * far + y.values.to_numpy()
                else:
                    w, a = word.as_py().split(b" "), begin.as_py()
                    l, h, of = low, high, np.arange(len(low))
                    for j in [*range(a - 1, -1, -1), *range(a + PART, len(w))]:
                        places = near.get(w[j], low[:0])
                        k = np.searchsorted(places, of * far + l) - 1 if j < a else np.searchsorted(places, of * far + h, "right")
                        ok = (k >= 0) & (k < len(places))
                        l, h, of, k = l[ok], h[ok], of[ok], k[ok]
                        ok = places[k] // far == of
                        l, h, of, k = l[ok], h[ok], of[ok], k[ok]
                        l, h = (places[k] % far, h) if j < a else (l, places[k] % far)
                    ok = h - l + 1 - len(w) <= slop
                    if ok.any():
                        out.append((word.as_py(), len(w), seg.as_py(), l[ok], h[ok]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.binary(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())))], ["phrase", "words", "seg", "low", "high"])

    return rows.mapInArrow(run, "phrase binary, words int, seg bigint, low array<bigint>, high array<bigint>")


def search(index: DataFrame, phrases: DataFrame, slop: int = 0) -> DataFrame:
    """phrase, seg, start, first, end, exact: where the words of phrases(phrase) stand in order with at most slop others between.

    A span is the shortest around a place of the phrase's rarest word; start names the document, first
    and end (behind the last word) count its words. Lists are intersected from the rarest term on: its
    places are spans of one word; two rounds join the spans with the list of the next word, in its
    segment, and keep those that reach near enough; the lists of the remaining words are then asked
    for what stands near the spans that are left. Spans of a part that phrases share are followed
    once. Only lists that are asked for leave the index, and phrases with an unknown word go first.
    """
    if not 0 <= slop < GAP - 1:
        raise ValueError(f"slop must be less than {GAP - 1}")

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            each = [x.split(b" ") for x in b.column(0).to_pylist()]
            size = np.array([len(w) for w in each], np.int64)
            of = np.repeat(np.arange(len(each)), size)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(of)), pa.array(np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)), pa.array([x for w in each for x in w], pa.binary())], ["phrase", "place", "term"])

    words = checkpointed(phrases.select("phrase").mapInArrow(placed, "phrase binary, place bigint, term binary"))
    lists, at = written(having(index.filter("term IS NOT NULL").select("term", "seg", "n", "places"), words.select("term")))
    known = lists.groupBy("term").agg(F.sum("n").alias("n"))
    counted = words.join(known, "term", "left").groupBy("phrase").agg(F.array_sort(F.collect_list(F.struct("place", "n"))).alias("w")).filter("forall(w, x -> x.n IS NOT NULL)")
    edge, leaf, need, rest = range(4)

    def grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for phrase, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                before = None
                steps = _growth(phrase, n)
                for level, (part, word, side) in enumerate(steps[:PART]):
                    rows.append((edge, level, before, part, word, side, None))
                    before = part
                if len(steps) <= PART:
                    rows.append((leaf, len(n), before, None, None, None, phrase))
                else:
                    begin = sum(side < 0 for _, _, side in steps[PART:])
                    rows.append((rest, None, before, None, None, begin, phrase))
                    rows += [(need, len(n) + slop, before, None, word, None, None) for _, word, _ in steps[PART:]]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.binary()))], ["kind", "level", "node", "child", "term", "side", "phrase"])

    ways = checkpointed(counted.select("phrase", F.transform("w", lambda x: x.n).alias("n")).mapInArrow(grown, "kind int, level int, node binary, child binary, term binary, side int, phrase binary").distinct())
    of_kind = lambda k, *c: ways.filter(F.col("kind") == k).select(*c)
    leaves = of_kind(leaf, "node", "phrase", F.col("level").alias("words"))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = pa.array([np.cumsum(from_varints(x).astype(np.int64)) for x in b.column(2).to_pylist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), at, at], ["node", "seg", "low", "high"])

    spans = lists.join(of_kind(edge, "level", "term", "child").filter("level = 0"), "term").select("child", "seg", "places").mapInArrow(first, "node binary, seg bigint, low array<bigint>, high array<bigint>")
    spans = checkpointed(spans)
    found = [spans.join(leaves, "node").select("phrase", "words", "seg", "low", "high")]
    none = lambda **c: [F.lit(None).cast(t).alias(k) for k, t in c.items()]

    def with_lists(asked: DataFrame) -> DataFrame:
        """asked(term, seg, places, ...) behind the lists that it asks for."""
        more = [F.lit(None).cast(asked.schema[c].dataType).alias(c) for c in asked.columns[3:]]
        wanted = having(lists, asked.select("term", "seg")).select("term", "seg", "places", *more)
        return wanted.unionByName(asked).repartition("term", "seg").sortWithinPartitions("term", "seg", F.col("places").isNull())

    for level in range(1, PART):
        asked = spans.join(of_kind(edge, "level", "node", "child", "term", "side").filter(F.col("level") == level), "node").select("term", "seg", *none(places="binary"), "child", "side", F.lit(level + 1).alias("words"), "low", "high")
        spans = checkpointed(_extend(with_lists(asked), slop))
        found.append(spans.join(leaves, "node").select("phrase", "words", "seg", "low", "high"))
    needed = of_kind(need, "node", "term", "level").groupBy("node", "term").agg(F.max("level").alias("reach"))
    near = _nearby(with_lists(spans.join(needed, "node").select("term", "seg", *none(places="binary"), "node", "reach", "low", "high")))
    where = spans.select("node", "seg", F.lit(0).alias("kind"), "low", "high", *none(word="binary", begin="int"))
    near = near.select("node", "seg", F.lit(1).alias("kind"), F.col("counts").alias("low"), F.col("near").alias("high"), F.col("term").alias("word"), *none(begin="int"))
    ends = spans.select("node", "seg").join(of_kind(rest, "node", "phrase", "side"), "node").select("node", "seg", F.lit(2).alias("kind"), *none(low="array<bigint>", high="array<bigint>"), F.col("phrase").alias("word"), F.col("side").alias("begin"))
    every = _complete(where.unionByName(near).unionByName(ends).repartition("node", "seg").sortWithinPartitions("node", "seg", "kind"), slop)
    for f in found:
        every = every.unionByName(f)
    every = checkpointed(every)
    forget(index.sparkSession, at)
    every = every.select("phrase", "seg", "words", F.inline(F.arrays_zip("low", "high")))
    docs = having(index.filter("term IS NULL").select("seg", F.col("start").alias("low")), every.select("seg"))
    rows = docs.select("seg", "low", *none(high="bigint", phrase="binary", words="int")).unionByName(every)
    rows = rows.withColumn("start", F.last(F.when(F.col("phrase").isNull(), F.col("low")), ignorenulls=True).over(W.partitionBy("seg").orderBy("low", F.col("phrase").isNotNull()))).filter("phrase IS NOT NULL")
    return rows.select("phrase", "seg", "start", (F.col("low") - F.col("start")).alias("first"), (F.col("high") + 1 - F.col("start")).alias("end"), (F.col("high") + 1 - F.col("low") == F.col("words")).alias("exact"))


def _items(spans: DataFrame, windows: DataFrame) -> DataFrame:
    """seg, start, items (sorted) of each document with spans (seg, start, phrase).

    Windows of the same items are one class, named by 128 bits, so items that share a passage are
    not multiplied by its windows, and documents with the same classes are looked up once.
    """
    named = windows.groupBy("phrase").agg(F.struct(F.count("*").alias("n"), F.bit_xor(F.xxhash64("item")).alias("a"), F.bit_xor(F.xxhash64(F.lit(1), "item")).alias("b")).alias("class"))
    named = checkpointed(named)
    members = named.groupBy("class").agg(F.min("phrase").alias("phrase")).join(windows, "phrase").select("class", "item")
    of_doc = checkpointed(spans.select("seg", "start", "phrase").distinct().join(named, "phrase").groupBy("seg", "start").agg(F.array_sort(F.collect_set("class")).alias("classes")))
    lists = of_doc.select("classes").distinct().select("classes", F.explode("classes").alias("class")).join(members, "class").select("classes", "item").distinct().groupBy("classes").agg(F.array_sort(F.collect_list("item")).alias("items"))
    return of_doc.join(lists, "classes").select("seg", "start", "items")


def find_contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
                       width: int = WINDOW, slop: int = SLOP, segment_words: int = SEGMENT_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items, items_sha256, contaminated, n_near_items for each row of docs.

    A word inside any exact occurrence of a window (width words of an item; all of a shorter one's) is
    hit. n_near_items counts the items of which a window of width words stands in the text in order
    with at most slop other words between, exact ones included. Equal items of one id are one item,
    items without an id or a word are left out. Null and empty texts have no words; repeated rows get a
    row each; without items or documents nothing is contaminated. Other columns of docs are ignored,
    whatever their names.
    """
    spark = docs.sparkSession
    index, at = build_index(docs, doc_id, text, segment_words)
    windows = checkpointed(item_windows(benchmark, item_id, item_text, width))
    spans = search(index, windows.select("phrase").distinct(), slop)
    whole = F.size(F.split(F.col("phrase").cast("string"), " ")) == width
    spans = checkpointed(spans.filter(F.col("exact") | whole))
    exact = spans.filter("exact")
    doc = W.partitionBy("seg", "start").orderBy("first", "end").rowsBetween(W.unboundedPreceding, -1)
    n_hit = exact.select("seg", "start", "first", "end").distinct().withColumn("to", F.coalesce(F.max("end").over(doc), F.lit(0))).groupBy("seg", "start").agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.greatest("first", "to"))).cast("long").alias("n_hit"))
    near = _items(spans.filter(whole), windows).select("seg", "start", F.size("items").cast("long").alias("n_near_items"))
    out = index.filter("term IS NULL").select("seg", "start", "doc_id", "n_words").join(n_hit, ["seg", "start"], "left").join(_items(exact, windows), ["seg", "start"], "left").join(near, ["seg", "start"], "left")
    none = F.array().cast("array<string>")
    out = out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", none).alias("items"), F.coalesce("n_near_items", F.lit(0)).cast("long").alias("n_near_items"))
    out = checkpointed(out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "n_near_items"))
    forget(spark, at)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the rows in which a window of the benchmark stands, exactly or with words put in; all columns as they are, whatever their names."""
    bad = find_contamination(docs.select(F.struct(F.col(doc_id).alias("i"), F.xxhash64(text).alias("t")).alias("key"), F.col(text).alias("text")), benchmark, "key", "text").filter("contaminated OR n_near_items > 0")
    return rows_by_key(docs, bad.select("doc_id.i", "doc_id.t").distinct(), doc_id, text, "left_anti")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "n_near_items")


_W = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
#: The next word of a window within its slop, the nearest; from the first word on.
_STEPS = "\n".join(
    f"""s{j} AS MATERIALIZED (SELECT w, any_value(x.ws) AS ws, x.k, a, min(pos.i) AS p FROM (SELECT *, unnest(range(1, {SLOP + 2})) AS r FROM s{j - 1}) x JOIN pos ON pos.k = x.k AND pos.i = x.p + r AND word = x.ws[{j}]
  WHERE pos.i - a < {SLOP} + {WINDOW} GROUP BY w, x.k, a),""" for j in range(2, WINDOW + 1))
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce({_W.format('text')}, []) AS ws FROM documents),
b AS (SELECT item_id::VARCHAR AS item, {_W.format('text')} AS ws FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
win AS (SELECT DISTINCT item, CASE WHEN len(ws) < {WINDOW} THEN len(ws) ELSE {WINDOW} END AS n, array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS s
  FROM (SELECT item, ws, unnest(range(1, greatest(len(ws) - {WINDOW - 1}, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
p AS (SELECT k, i, n, array_to_string(ws[i:i + n - 1], ' ') AS s FROM (SELECT k, ws, unnest(range(1, len(ws) + 1)) AS i FROM d), sizes WHERE i + n - 1 <= len(ws)),
m AS (SELECT k, i, n, item FROM p JOIN win USING (n, s)),
whole AS (SELECT row_number() OVER () AS w, s, string_split(s, ' ') AS ws FROM (SELECT DISTINCT s FROM win WHERE n = {WINDOW})),
pos AS MATERIALIZED (SELECT k, ws[i] AS word, i FROM (SELECT k, ws, unnest(range(1, len(ws) + 1)) AS i FROM d)),
s1 AS MATERIALIZED (SELECT w, ws, k, i AS a, i AS p FROM whole JOIN pos ON word = ws[1]),
{_STEPS}
near AS (SELECT k, count(DISTINCT item) AS n_near_items FROM (SELECT DISTINCT k, s FROM s{WINDOW} JOIN whole USING (w)) JOIN win USING (s) GROUP BY k),
hit AS (SELECT k, count(DISTINCT i + j) AS n_hit FROM (SELECT k, i, unnest(range(n)) AS j FROM (SELECT DISTINCT k, i, n FROM m)) GROUP BY k),
it AS (SELECT k, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT k, item FROM m) GROUP BY k)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
  coalesce(n_near_items, 0)::BIGINT AS n_near_items FROM d LEFT JOIN hit USING (k) LEFT JOIN it USING (k) LEFT JOIN near USING (k)
"""
