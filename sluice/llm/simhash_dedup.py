"""SimHash near-duplicates by meeting in the middle: a ball of half the radius around every fingerprint."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sluice.llm.common import apart, bounded_batches, checkpointed, groups, read, swept
from sluice.llm.components import connected_components

#: SimHash is of shingles of so many words.
SHINGLE = 3
#: The pipeline's stage links texts whose sets of five-word shingles have this similarity (Jaccard) at least;
#: those that SimHash finds need it of its own shingles.
STAGE_SHINGLE, STAGE_SIMILARITY = 5, 0.8
#: The other candidates share one of BANDS bands of ROWS minima each: a pair at 0.8 is missed with (1 - 0.8^5)^45 = 2e-8, one above less often.
BANDS, ROWS = 45, 5
#: Texts of a bucket are compared with each other in blocks of so many texts and shingles.
BLOCK_TEXTS, BLOCK_SHINGLES = 1024, 1 << 22


def _shingles(t: bytes | None, shingle: int) -> list[bytes]:
    w = t.lower().split() if t else []
    if len(w) <= shingle:
        return [b" ".join(w)] if w else []
    return list(map(b" ".join, zip(*[w[k:] for k in range(shingle)])))


def _simhash(texts: list[bytes | None], shingle: int, seed: int) -> np.ndarray:
    hashes: list[int] = []
    sizes = np.zeros(len(texts), np.int64)
    digest = partial(xxhash.xxh64_intdigest, seed=seed)
    for i, t in enumerate(texts):
        parts = _shingles(t, shingle)
        if not parts:
            continue
        hashes.extend(map(digest, parts))
        sizes[i] = len(parts)
    out = np.zeros(len(texts), np.uint64)
    full = np.flatnonzero(sizes)
    if len(full):
        h = np.array(hashes, np.uint64)
        starts = np.cumsum(sizes[full]) - sizes[full]
        ends = starts + sizes[full]
        place = np.uint64(1) << np.arange(64, dtype=np.uint64)
        for i, a, b in zip(full, starts, ends):  # a text at a time: 64 bytes a shingle is the most that is held
            n = np.zeros(64, np.int64)
            for c in range(a, b, 1 << 16):
                n += np.unpackbits(h[c : min(b, c + (1 << 16))].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            out[i] = place[2 * n > (b - a)].sum(dtype=np.uint64)
    return out.view(np.int64)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seeds: tuple[int, ...] = (42,), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, f0, f1, ... (long), one fingerprint for each seed; and th, a 64-bit hash of the text.

    Words are runs of anything but ASCII white space after A-Z are lower-cased; a text of fewer words
    than a shingle is one shingle, and a null text or one without words has fingerprint 0.
    """
    bounded_batches(docs.sparkSession)
    d = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("th"), F.col(text).cast("binary").alias("t"))
    kinds = dict(d.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(2).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(_simhash(texts, shingle, s)) for s in seeds]], ["doc_id", "th", *[f"f{k}" for k in range(len(seeds))]])

    return d.mapInArrow(run, f"doc_id {kinds['doc_id']}, th bigint, " + ", ".join(f"f{k} bigint" for k in range(len(seeds))))


def ball(word: Column, bits: int) -> Column:
    """The variants of a word within one bit, itself first."""
    return F.array(word, *[word.bitwiseXOR(F.lit(1 << k if k < 63 else -(1 << 63)).cast("long")) for k in range(bits)])


def within_two(words: DataFrame, bits: int, table: str | None = None) -> DataFrame:
    """Links (table, a, b) that connect all distinct words (column w) at most two bits apart.

    Words two bits apart share a variant one bit from both, and words that share a variant are at most
    two bits apart, so in a variant's bucket - bits + 1 words at the most - a star on the least word
    has the same components as all pairs; pairs are not expanded. Every link is verified.
    """
    keys = [table] if table else []
    near = words.select(*keys, "w", F.explode(ball(F.col("w"), bits)).alias("v"))
    star = near.withColumn("b", F.min("w").over(W.partitionBy(*keys, "v"))).filter("w <> b")
    return star.select(*keys, F.col("w").alias("a"), "b").distinct().filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2)


def fingerprint_components(nodes: DataFrame) -> DataFrame:
    """nodes, a row for each fingerprint (column fp), with root: the least fingerprint that links of two bits or fewer reach."""
    found = connected_components(within_two(nodes.select(F.col("fp").alias("w")), 64))
    return nodes.join(found, nodes["fp"] == found["node"], "left").select(*nodes.columns, F.coalesce("root", "fp").alias("root"))


def simhash_components(docs: DataFrame, shingle: int = SHINGLE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for each row of docs.

    64-bit fingerprints link at two or fewer differing bits; component_id is the least doc_id that can
    be reached. Equal fingerprints are one node, so thousands of copies are one row in the search, and
    repeated rows get a row each. Null ids are never a component's id unless it has no other.
    """
    fps = checkpointed(fingerprints(docs, shingle, (42,), doc_id, text).select("doc_id", F.col("f0").alias("fp")))
    nodes = checkpointed(fps.groupBy("fp").agg(F.min("doc_id").alias("first")))
    named = fingerprint_components(nodes)
    named = named.join(named.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _minima(hashes: np.ndarray) -> np.ndarray:
    """The least value of each of BANDS * ROWS functions over 64-bit hashes."""
    draw = np.random.default_rng(42)
    by, plus = (draw.integers(0, 1 << 32, (BANDS * ROWS, 1), np.uint32) for _ in range(2))
    h, least = hashes.astype(np.uint32), np.full(BANDS * ROWS, (1 << 32) - 1, np.uint32)
    for c in range(0, len(h), 2048):
        np.minimum(least, (h[c : c + 2048] * (by | np.uint32(1)) + plus).min(axis=1), out=least)
    return least


def _bands(minima: np.ndarray) -> np.ndarray:
    """A key for each band of each row of minima; equal bands of different places have different keys."""
    m = minima.reshape(-1, BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), m.shape[:2]).copy()
    for k in range(ROWS):
        key = (key ^ m[:, :, k]) * np.uint64(0xFF51AFD7ED558CCD)
        key ^= key >> np.uint64(33)
    return key.view(np.int64)


def shingle_sets(docs: DataFrame, shingle: int = STAGE_SHINGLE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, th (a 64-bit hash of the text), node (one of the set of shingles), size (of the set), bands (their keys), fp.

    Words and shingles are those of fingerprints, and fp is the fingerprint of simhash_components; a text
    without words has an empty set and no bands.
    """
    bounded_batches(docs.sparkSession)
    d = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("th"), F.col(text).cast("binary").alias("t"))
    kinds = dict(d.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, size, least = [], [], []
            for t in b.column(2):
                h = np.unique(np.array(list(map(xxhash.xxh64_intdigest, _shingles(t.as_py(), shingle))), np.uint64))
                node.append(xxhash.xxh3_64_intdigest(h.tobytes()))
                size.append(len(h))
                if len(h):
                    least.append(_minima(h))
            keys = iter(_bands(np.array(least, np.uint32)).tolist() if least else [])
            bands = pa.array([next(keys) if n else [] for n in size], pa.list_(pa.int64()))
            fp = pa.array(_simhash(b.column(2).to_pylist(), SHINGLE, 42))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.array(node, np.uint64).view(np.int64)), pa.array(size, pa.int64()), bands, fp], ["doc_id", "th", "node", "size", "bands", "fp"])

    return d.mapInArrow(run, f"doc_id {kinds['doc_id']}, th bigint, node bigint, size bigint, bands array<bigint>, fp bigint")


def similar(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b, shingle) of nodes whose texts (node, t) have sets of shingles of so many words of the similarity at least, compared by their bytes."""
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("t").alias("ta")), "a").join(texts.select(F.col("node").alias("b"), F.col("t").alias("tb")), "b").select("a", "b", "ta", "tb", "shingle")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y, n in zip(batch.column(2), batch.column(3), batch.column(4).to_pylist()):
                x, y = set(_shingles(x.as_py(), n)), set(_shingles(y.as_py(), n))
                both = len(x & y)
                linked.append(both >= similarity * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return both.mapInArrow(run, "a bigint, b bigint")


def _links(sizes: np.ndarray, sets: np.ndarray, roots: list[int], similarity: float) -> list[tuple[int, int]]:
    """Places (i, j) of texts that are similar enough, as few as join all groups that such pairs join.

    sizes: of the sets, which stand in a row in sets. All intersections are counted at once, by a
    product of the 0/1 matrix of texts and shingles; shingles of one text alone can't be shared.
    """
    n = len(sizes)
    _, of, many = np.unique(sets, return_inverse=True, return_counts=True)
    column = np.cumsum(many > 1) - 1
    shared = many[of] > 1
    row, column = np.repeat(np.arange(n), sizes)[shared], column[of[shared]]
    by = np.argsort(column, kind="stable")
    row, column = row[by], column[by]
    common = np.zeros((n, n), np.float32)
    for c in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        a, b = np.searchsorted(column, (c, c + 4096))
        m = np.zeros((n, min(4096, int(column[-1]) + 1 - c)), np.float32)
        m[row[a:b], column[a:b] - c] = 1
        common += m @ m.T
    linked = common >= similarity * (sizes[:, None] + sizes[None] - common)
    group = {r: r for r in roots}

    def top(r: int) -> int:
        while group[r] != r:
            group[r] = r = group[group[r]]
        return r

    own = np.unique(np.array(roots, np.int64), return_inverse=True)[1]
    out = []
    for i, j in zip(*np.nonzero(np.triu(linked & (own[:, None] != own[None]), 1))):
        a, b = top(roots[i]), top(roots[j])
        if a != b:
            group[a] = b
            out.append((int(i), int(j)))
    return out


def links_in_buckets(mixed: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Verified links (a, b) among the texts of each bucket of mixed(shingle, key, node, size, root, blocks), where groups (root) differ.

    Every two texts of a bucket are compared, in blocks of bounded texts and shingles, so a large bucket
    is many tasks; only links that join two groups leave a task, at most as many as it has groups. Sets
    are compared by their shingles' 64-bit hashes.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 64):
                part = b.slice(k, 64)
                sets = [np.unique(np.array(list(map(xxhash.xxh64_intdigest, _shingles(t.as_py(), n))), np.uint64)).view(np.int64) for t, n in zip(part.column(1), part.column(2).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(sets, pa.list_(pa.int64()))], ["node", "shingle", "set"])

    sets = texts.join(mixed.select("node", "shingle").distinct(), "node").select("node", "t", "shingle").mapInArrow(hashed, "node bigint, shingle int, set array<bigint>")
    dealt = mixed.withColumn("i", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("shingle", "key", F.least("i", "j").alias("low"), F.greatest("i", "j").alias("high"), "node", "root").join(checkpointed(sets), ["node", "shingle"])
    bucket = ["shingle", "key", "low", "high"]
    dealt = dealt.select(*bucket, "node", "root", "set").repartition(*bucket).sortWithinPartitions(*bucket, "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, 4):
            sets = t["set"].combine_chunks()
            sets = sets if isinstance(sets, pa.ListArray) else pa.concat_arrays(sets.chunks)
            found = _links(np.diff(sets.offsets.to_numpy()), sets.flatten().to_numpy(), t["root"].to_pylist(), similarity)
            node = t["node"].to_numpy()
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(node[[i for i, _ in found]]), pa.array(node[[j for _, j in found]])], ["a", "b"])

    return dealt.mapInArrow(run, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = STAGE_SHINGLE, similarity: float = STAGE_SIMILARITY) -> DataFrame:
    """doc_id, th, copies, keep for each (doc_id, text): whether it is the one of its group that stays.

    Texts are linked if their sets of shingles are similar enough; a link is verified on the sets
    themselves. SimHash comes first: the components of simhash_components are buckets, whose texts are
    compared by the three-word shingles that its fingerprints are of. It can't find all the rest: at a
    similarity of 0.8 of five-word shingles 64 bits differ in nine on average, and balls or bands that
    reach so far select nothing. So texts that share a band of minima are in a bucket as well, compared
    by five-word shingles. In a bucket all are compared with the least; then, where
    that leaves several groups, all with each other in blocks, of which only the links that join two groups
    go on: a group of thousands of near copies takes a link each. Texts of equal sets are one node.
    The least (doc_id, text hash) of a group stays; copies counts equal rows.
    """
    sets = checkpointed(shingle_sets(docs, shingle, doc_id, text))
    fps = sets.groupBy("doc_id", "th", "node").agg(F.count("*").alias("copies"))
    nodes = sets.groupBy("node").agg(F.min("size").alias("size"), F.first("bands").alias("bands"), F.min("th").alias("th"))
    by_bands = nodes.select("node", "size", F.lit(shingle).alias("shingle"), F.explode("bands").alias("key"))
    prints = sets.select("node", "size", "fp").distinct()
    by_simhash = prints.join(fingerprint_components(checkpointed(prints.select("fp").distinct())), "fp").select("node", "size", F.lit(SHINGLE).alias("shingle"), F.col("root").alias("key")).distinct()
    bucket = ["shingle", "key"]
    each = by_simhash.unionByName(by_bands).repartition(*bucket)  # one shuffle, which heads and members read
    heads = each.groupBy(*bucket).agg(F.min(F.struct("node", "size")).alias("head"), F.count("*").alias("n")).filter("n > 1")
    members = checkpointed(each.join(heads, bucket).select(*bucket, "node", "size", "head"))
    swept(docs.sparkSession)
    # by five-word shingles the sizes alone tell some apart; a set of three-word shingles has another size
    close = lambda x, y: (F.col("shingle") != shingle) | (F.least(x, y) >= F.lit(similarity) * F.greatest(x, y))
    stars = checkpointed(members.filter("node <> head.node").filter(close(F.col("size"), F.col("head.size"))).select(F.col("node").alias("a"), F.col("head.node").alias("b"), "shingle").distinct())
    # of the texts with one set of shingles any will do
    wanted = members.select("node").distinct().join(nodes.select("node", "th"), "node")
    texts = docs.select(F.xxhash64(text).alias("th"), F.col(text).cast("binary").alias("t")).join(wanted, "th").groupBy("node").agg(F.min("t").alias("t"))
    texts = checkpointed(texts)
    links = checkpointed(similar(stars, texts, similarity))
    swept(docs.sparkSession)
    found = connected_components(links)
    grouped = members.join(found, "node", "left").select(*bucket, "node", "size", F.coalesce("root", "node").alias("root"))
    mixed = grouped.groupBy(*bucket).agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n"), F.sum("size").alias("sum")).filter("low <> high")
    mixed = checkpointed(grouped.join(mixed.select(*bucket, F.ceil(F.greatest(F.col("n") / BLOCK_TEXTS, F.col("sum") / BLOCK_SHINGLES)).cast("int").alias("blocks")), bucket))
    swept(docs.sparkSession)
    found = connected_components(links.unionByName(links_in_buckets(mixed, texts, similarity)))
    swept(docs.sparkSession)
    labelled = fps.join(found, "node", "left").select("doc_id", "th", "copies", F.coalesce("root", "node").alias("root"))
    labelled = checkpointed(labelled)
    stays = labelled.groupBy("root").agg(F.min(F.struct("doc_id", "th")).alias("s")).select("s.*")
    keep = stays.withColumn("keep", F.lit(True)).withColumnRenamed("doc_id", "_i").withColumnRenamed("th", "_t")
    return labelled.join(keep, labelled["doc_id"].eqNullSafe(keep["_i"]) & (labelled["th"] == keep["_t"]), "left").select("doc_id", "th", "copies", F.coalesce("keep", F.lit(False)).alias("keep"))


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each group of near-duplicates, all columns as they are, whatever their names.

    Of rows with one id and text the one whose other columns have the least hash stays.
    """
    t, a, b, copies, row = apart(docs.columns, "t", "a", "b", "copies", "row")
    stays = near_duplicates(docs, doc_id, text).filter("keep").select(F.col("doc_id").alias(a), F.col("th").alias(b), F.col("copies").alias(copies))
    d = docs.withColumn(t, F.xxhash64(text))
    d = d.join(stays, d[doc_id].eqNullSafe(stays[a]) & (d[t] == stays[b])).drop(a, b, t)
    once, again = d.filter(f"{copies} = 1").drop(copies), d.filter(f"{copies} > 1").drop(copies)
    whole = F.struct(*[again[c] for c in docs.columns])
    again = again.groupBy(F.col(doc_id).alias(a), F.col(text).alias(b)).agg(F.min_by(whole, F.xxhash64(F.to_json(whole))).alias(row))
    return once.unionByName(again.select(f"{row}.*"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(read(spark, sf_dir, "documents"))
