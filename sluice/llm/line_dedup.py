"""Content-defined line chunks: repeated passages of lines are removed wherever they stand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sluice.llm.common import SPACE, apart, checkpointed, computed, read

#: A line of so many words is a chunk of its own, and may go though it is one line.
LONG_LINE = 50
#: A repeated passage of lines goes from so many words on, wherever it stands.
PASSAGE_WORDS = 50
#: Chunk hashes are looked up by this many buckets: the broadcast set of buckets can't outgrow it.
BUCKETS = 1 << 20


def word_count(line: Column, enough: int) -> Column:
    """A line's words, or any number from `enough` on if it has so many: the end of a long line isn't read.

    Where single spaces alone part the words they are counted by their spaces, which needs no array of words.
    """
    def words_in(bare: Column) -> Column:
        plain = ~F.contains(bare, F.lit("  "))
        for other in "\t\n\x0b\f\r":
            plain = plain & ~F.contains(bare, F.lit(other))
        spaces = F.octet_length(bare) - F.octet_length(F.replace(bare, F.lit(" "), F.lit("")))
        return F.when(bare == "", 0).when(plain, spaces + 1).otherwise(F.regexp_count(bare, F.lit(f"[^{SPACE}]+")))

    def count(c: Column) -> Column:
        return F.get(F.transform(F.array(F.trim(c)), words_in), F.lit(0))  # as a lambda's variable the text is cut once

    head = 8 * enough
    return F.when(F.length(line) <= head, count(line)).when(count(F.substring(line, 1, head)) >= enough, F.lit(enough)).otherwise(count(line))


def line_chunks(docs: DataFrame, text: Column, long_line: int = LONG_LINE) -> DataFrame:
    """docs with _chunks: array of (chunk: string, start: int, lines: int, eligible: boolean); joined by newlines they are the text.

    Each line has a rolling hash, of its and its predecessor's hash. A boundary stands after a line
    whose rolling hash is less than its two neighbours', and on both sides of a long line. So it
    depends on four lines alone, lines put in or taken out elsewhere shift no other boundary, and
    between two such boundaries stand two lines at least. Chunks of two lines or more, and long
    lines, are eligible.
    """
    df = computed(docs, _lines=F.split(F.coalesce(text, F.lit("")), "\n"))
    # A line of fewer bytes than so many words need isn't counted.
    is_long = lambda s: F.when(F.octet_length(s) < 2 * long_line - 1, F.lit(False)).otherwise(word_count(s, long_line) >= long_line)
    df = computed(df, _h=F.transform("_lines", lambda s: F.xxhash64(s)), _long=F.transform("_lines", is_long))
    df = computed(df, _r=F.transform("_h", lambda h, i: F.when(i == 0, F.lit((1 << 63) - 1)).otherwise(F.xxhash64(F.get("_h", i - 1), h))))  # no pair ends with line 0
    # Columns that are generated stand still: looking up an element doesn't evaluate them again.
    low = lambda i: F.coalesce(F.get("_r", i) < F.get("_r", i - 1), F.lit(False)) & (F.get("_r", i) < F.get("_r", i + 1))
    begins = lambda i: (i == 0) | F.get("_long", i) | F.get("_long", i - 1) | low(i - 1)
    df = computed(df, _starts=F.filter(F.sequence(F.lit(0), F.size("_lines") - 1), begins))
    lines = lambda a, k: F.coalesce(F.get("_starts", k + 1), F.size("_lines")) - a
    chunks = F.transform("_starts", lambda a, k: F.struct(
        F.array_join(F.slice("_lines", a + 1, lines(a, k)), "\n").alias("chunk"), a.alias("start"), lines(a, k).alias("lines"), ((lines(a, k) > 1) | F.get("_long", a)).alias("eligible")))
    return computed(df, _chunks=chunks).drop("_lines", "_h", "_long", "_r", "_starts")


def windows(docs: DataFrame, words: int) -> DataFrame:
    """_id, _th, _start, _n, _d for each window of docs (_id, _th, _text); equal windows have equal 128-bit digests _d.

    A window is the shortest run of lines with so many words from a line on, or up to a line. A
    passage of so many words that is repeated holds the windows from each of its lines on and up to
    each, as far as they reach the number inside it; together they are the whole passage, and they
    depend on nothing outside. So it is found at any offset. Blank lines begin and end no window and
    are not compared; those inside one are part of it.
    """
    each = F.transform(F.split("_text", "\n"), lambda s, i: F.struct(i.alias("_pos"), word_count(s, words).cast("long").alias("_w"), F.xxhash64(s).alias("_g"), F.xxhash64(F.lit(1), s).alias("_m")))
    # Equal rows are one document; they meet by document and not by line, so that what follows needs no other shuffle.
    lines = docs.select("_id", "_th", each.alias("_ls")).groupBy("_id", "_th").agg(F.first("_ls").alias("_ls")).select("_id", "_th", F.inline("_ls")).filter("_w > 0")
    lines = lines.select("_id", "_th", "_pos", "_w", F.concat(F.hex("_g"), F.lit("."), F.hex("_m")).alias("_m"))
    doc = W.partitionBy("_id", "_th")
    lines = lines.withColumn("_upto", F.sum("_w").over(doc.orderBy("_pos"))).withColumn("_before", F.expr("_upto - _w"))
    ahead, back = doc.orderBy("_before").rangeBetween(0, words - 1), doc.orderBy("_upto").rangeBetween(1 - words, 0)
    digest = lambda w: F.unhex(F.md5(F.array_join(F.collect_list("_m").over(w), ",")))
    window = lambda w, a, b: F.struct(F.sum("_w").over(w).alias("words"), a.alias("_start"), (b - a + 1).alias("_n"), digest(w).alias("_d"))
    both = lines.select("_id", "_th", window(ahead, F.col("_pos"), F.max("_pos").over(ahead)).alias("_a"), window(back, F.min("_pos").over(back), F.col("_pos")).alias("_b"))
    each = both.select("_id", "_th", F.explode(F.when(F.col("_a") == F.col("_b"), F.array("_a")).otherwise(F.array("_a", "_b"))).alias("_x")).filter(F.col("_x.words") >= words)
    return each.select("_id", "_th", "_x._start", "_x._n", "_x._d")


def _repeats(each: DataFrame, same: str) -> DataFrame:
    """_id, _th, _start, _n of the rows of each whose column `same` stands in a smaller (id, text hash, start); _h is a hash of it."""
    places = checkpointed(each.select("_id", "_th", "_start", "_n", "_h")) if same == "_chunk" else each  # windows are kept already
    twice = places.groupBy("_h").agg(F.count("*").alias("_c")).filter("_c > 1")
    buckets = twice.select(F.pmod("_h", F.lit(BUCKETS)).alias("_bucket")).distinct()  # BUCKETS rows at most
    candidates = lambda x: x.withColumn("_bucket", F.pmod("_h", F.lit(BUCKETS))).join(F.broadcast(buckets), "_bucket", "left_semi")
    stays = candidates(each).groupBy("_h", same).agg(F.min(F.struct("_id", "_th", "_start", "_n")).alias("_s")).select(*[F.col(f"_s.{c}").alias("_s" + c) for c in ("_id", "_th", "_start", "_n")])
    here = F.col("_id").eqNullSafe(F.col("_s_id"))
    for c in ("_th", "_start", "_n"):
        here = here & (F.col(c) == F.col("_s" + c))
    return candidates(places).select("_id", "_th", "_start", "_n").join(stays, here, "left_anti")


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", long_line: int = LONG_LINE, passage_words: int | None = None) -> DataFrame:
    """docs with text less its repeated chunks, n_lines, n_removed_lines, n_removed_chunks (long).

    Of equal eligible chunks the one in the smallest (id, text hash, place) stays, also within
    a document. Chunks with equal hashes are compared by their bytes before one goes. Hash counts are
    pre-aggregated; the texts of candidates alone are compared, by a grouping that is aggregated before
    its shuffle, and what stays is taken off by its place and not by its text, so no hot chunk meets in a task. Rows with equal id
    and text are one document and are treated alike. A null text stays null with 0 of everything; an
    empty text is one empty line. Blank lines belong to chunks as any other. Further columns of docs
    stay as they are, whatever their names; those named like the added columns are replaced.

    With passage_words, repeated passages of lines with so many words go too, by their windows in the
    same order, compared by digests of 128 bits; n_removed_chunks then counts the runs of lines that
    went. Any line that goes has an equal one at a smaller place, so none is lost altogether; of lines
    repeated over and over in a row one period stays.
    """
    kept = [c for c in docs.columns if c not in ("n_lines", "n_removed_lines", "n_removed_chunks")]
    others = [docs[c].alias(c) for c in kept if c != text]
    # The caller's columns stand in a struct meanwhile, whatever their names.
    d = docs.select(F.col(doc_id).alias("_id"), F.xxhash64(text).alias("_th"), F.col(text).alias("_text"), F.struct(*others, F.lit(0).alias(*apart(kept, "end"))).alias("_row"))
    texts = d.filter("_text IS NOT NULL").drop("_row")
    each = line_chunks(texts, F.col("_text"), long_line).select("_id", "_th", F.explode("_chunks").alias("_c")).filter("_c.eligible")
    each = each.select("_id", "_th", F.col("_c.start").alias("_start"), F.col("_c.lines").alias("_n"), F.xxhash64("_c.chunk").alias("_h"), F.col("_c.chunk").alias("_chunk"))
    gone = _repeats(each, "_chunk")
    if passage_words:
        gone = gone.unionByName(_repeats(checkpointed(windows(texts, passage_words).withColumn("_h", F.xxhash64("_d"))), "_d"))
    gone = gone.groupBy(F.col("_id").alias("_gid"), F.col("_th").alias("_gth")).agg(F.collect_set(F.struct("_start", "_n")).alias("_gone"))
    out = d.join(gone, d["_id"].eqNullSafe(gone["_gid"]) & (d["_th"] == gone["_gth"]), "left").drop("_gid", "_gth", "_id", "_th")
    hit = F.col("_gone").isNotNull()
    out = computed(out, _lines=F.when(hit, F.split(F.col("_text"), "\n")), _off=F.when(hit, F.array_sort(F.array_distinct(F.flatten(F.transform("_gone", lambda g: F.sequence(g._start, g._start + g._n - 1)))))))
    none = F.array(F.lit(-1))
    left = F.filter(F.zip_with(F.concat(none, "_off"), F.concat("_off", F.array(F.size("_lines"))), lambda a, b: F.struct((a + 2).alias("a"), (b - a - 1).alias("n"))), lambda s: s.n > 0)
    runs = F.size(F.filter(F.zip_with("_off", F.concat(none, F.slice("_off", 1, F.size("_off") - 1)), lambda b, a: (b > a + 1) | (b == 0)), lambda x: x))
    out = computed(out, _left=left)
    total = F.when(F.col("_text").isNull(), 0).otherwise(F.length("_text") - F.length(F.replace(F.col("_text"), F.lit("\n"), F.lit(""))) + 1).cast("long")
    new = F.when(hit, F.array_join(F.flatten(F.transform("_left", lambda s: F.slice("_lines", s.a, s.n))), "\n")).otherwise(F.col("_text"))
    count = lambda c: F.when(hit, c).otherwise(0).cast("long")
    return out.select(*[new.alias(c) if c == text else F.col("_row").getField(c).alias(c) for c in kept], total.alias("n_lines"), count(F.size("_off")).alias("n_removed_lines"), count(runs if passage_words else F.size("_gone")).alias("n_removed_chunks"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"), passage_words=PASSAGE_WORDS)
