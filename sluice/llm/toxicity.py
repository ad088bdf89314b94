"""Toxicity behind a noisy channel: character lattices of disguised words are decoded, then scored."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.common import bounded_batches, checkpointed, id_remainder, read, rows_by_key

#: Labelled rows of the training part that the word list is fitted on: those with the least hash of their id.
SAMPLE = 10_000
#: A word or stem is listed if at least this many sampled texts have it and its toxic share is so many deviations high; the highest are taken.
LEAST_TEXTS, LEAST_Z, MOST_WORDS = 3, 4.0, 500
#: Lengths of the beginnings of words that are features beside the words, for stems with many endings.
STEMS = (3, 4, 5, 6, 7)
THRESHOLD, MODULUS, HELD = 0.3, 4, 2
#: Characters (code points) of the language model: 0 white space, 1-26 a-z, 27 all else.
CLASSES = 28
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "*": "abcdefghijklmnopqrstuvwxyz", "#": "aeiou"}
#: Costs in log10 of the channel: a sign for a letter, a sign put in, a letter said again, a gap put in.
SIGN, PUT_IN, AGAIN, GAP = -0.4, -1.0, -0.1, -0.2
_CLASS = np.full(128, 27, np.int32)
_CLASS[list(b" \t\n\v\f\r")] = 0
for _i in range(26):
    _CLASS[97 + _i] = _CLASS[65 + _i] = _i + 1
#: Signs that end a plain word, and tokens that may hide one: a letter beside a sign or digit, a letter three times.
_ENDS = ".,;:!?\"'()[]{}<>%&~`^=/\\|-_*#$@+"
_NOISY = re.compile(r"[^\W\d_][0-9@$!|+(*#._\-]+[^\W\d_]|[0-9@$!|+(*#][^\W\d_]|[^\W\d_][013457@$!|+*]|([^\s])\1\1")
_SPACED = re.compile(r"(?<![^\s.,;:!?])(?:[^\W_][\s.\-_*]{1,2}|[@$!|][\s.\-_*]{1,2}){2,}(?:[^\W_]|[@$!|])(?![^\s.,;:!?])")
#: Where a noisy token may be: quick to find, then looked at by _NOISY.
_SIGNS, _THRICE = re.compile(r"[0-9@$|+*]|[!(#_.\-](?!\s)"), re.compile(r"(\S)\1\1")
_TOKEN = re.compile(r"\S+")
_LETTERS = re.compile(r"[^\W\d_]+")


def trigram_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(code, n): how often each three characters stand in the texts; one row for each of at most CLASSES^3 codes."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES**3, np.int64)
        for b in batches:
            raw = np.frombuffer(" \n ".join(t or "" for t in b.column(0).to_pylist()).encode("utf-32-le", "replace"), np.uint32)
            for a in range(0, len(raw), 1 << 22):
                c = _CLASS[np.minimum(raw[a : a + (1 << 22) + 2], 127)]
                if len(c) > 2:
                    total += np.bincount(c[:-2] * (CLASSES * CLASSES) + c[1:-1] * CLASSES + c[2:], minlength=CLASSES**3)
        code = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(total[code])], ["code", "n"])

    counted = docs.select(F.col(text).alias("t")).mapInArrow(run, "code bigint, n bigint")
    return counted.groupBy("code").agg(F.sum("n").alias("n"))


class Decoder:
    """Viterbi decoding of tokens under a character trigram model, each distinct token once in a while."""

    def __init__(self, logp: np.ndarray, most: int = 200_000):
        self.logp, self.most, self.memory = logp.tolist(), most, {}

    def __call__(self, token: str) -> str:
        if token not in self.memory:
            if len(self.memory) >= self.most:
                self.memory.clear()
            self.memory[token] = self.decode(token)
        return self.memory[token]

    @staticmethod
    def lattice(token: str) -> list[list[tuple[str, float]]]:
        """For each run of equal characters the texts it may stand for, with the channel's log10 probability."""
        out, i = [], 0
        while i < len(token):
            c, n = token[i], 1
            while i + n < len(token) and token[i + n] == c:
                n += 1
            if c.isspace():
                out.append([("", GAP), (" ", 0.0)])
            elif c in LEET:
                if len(LEET[c]) > 2:  # a mask hides as many letters as it has signs, up to two
                    one = [(x, SIGN - 1.0) for x in LEET[c]]
                    out += [[*one, ("", PUT_IN)]] * min(n, 2)
                else:
                    out.append([*((x * m, SIGN - 0.2 * (n != m)) for x in LEET[c] for m in ({1, 2} if n > 1 else {1})), ("", PUT_IN - (0 if not c.isdigit() else 1))])
            elif c.isalpha():
                out.append([(c * n, 0.0)] if n < 3 else [(c, AGAIN), (c * 2, AGAIN), (c * n, -3.0)])
            else:
                out.append([("", 0.0)] if not c.isdigit() else [("", PUT_IN)])
            i += n
        return out

    def decode(self, token: str) -> str:
        lp = self.logp
        states: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}  # text as a linked list
        for choices in [*self.lattice(token), [(" ", 0.0)]]:
            new: dict[tuple[int, int], tuple[float, tuple]] = {}
            for (a, b), (score, said) in states.items():
                for text, cost in choices:
                    x, y, s = a, b, score + cost
                    for c in text:
                        k = ord(c) - 96 if "a" <= c <= "z" else 0 if c == " " else 27
                        s += lp[(x * CLASSES + y) * CLASSES + k]
                        x, y = y, k
                    if (x, y) not in new or new[x, y][0] < s:
                        new[x, y] = (s, (said, text) if text else said)
            states = new
        _, said = max(states.values(), key=lambda v: v[0])
        parts = []
        while said:
            said, text = said
            parts.append(text)
        return "".join(reversed(parts)).strip()

    def restore(self, text: str) -> str:
        """The text in lower case, with disguised words decoded; all else stays."""
        low = text.lower()
        if _SPACED.search(low):
            low = _SPACED.sub(lambda m: self(m[0]), low)
        out, plain_ones, done = {}, set(), 0
        for at in sorted([*(m.start() for m in _SIGNS.finditer(low)), *(m.start() for m in _THRICE.finditer(low))]):  # tokens that may be noisy
            if at < done:
                continue
            a = at
            while a and not low[a - 1].isspace():
                a -= 1
            token = _TOKEN.match(low, a)[0]
            done = a + len(token)
            if token not in out and token not in plain_ones:
                plain = token.strip(_ENDS)
                if _NOISY.search(token.rstrip(".,;:!?\"')") if len(plain) > 1 else plain):
                    out[token] = self(self.core(token))
                else:
                    plain_ones.add(token)
        return low if not out else re.sub(r"\S+", lambda m: out.get(m[0], m[0]), low)

    @staticmethod
    def core(token: str) -> str:
        """The token without quotes and stops around it and without a run of three or more signs at its end."""
        return re.sub(r"([^\w\s])\1{2,}$", "", token.strip(".,;:?\"'()[]{}<>%&~`^=/\\").rstrip("!-_"))


def features(text: str | None, decoder: Decoder) -> set[str]:
    """The restored text's words, and their beginnings of STEMS letters, marked by a stroke."""
    words = set(_LETTERS.findall(decoder.restore(text))) if text else set()
    return words.union(*({w[:k] + "-" for w in words if len(w) > k} for k in STEMS))


class Listed:
    """The listed features of a text; those of each word are looked up once in a while."""

    def __init__(self, names, decoder: Decoder, most: int = 200_000):
        self.names, self.decoder, self.most, self.memory = frozenset(names), decoder, most, {}

    def __call__(self, text: str | None) -> set[str]:
        found: set[str] = set()
        memory = self.memory
        for w in set(_LETTERS.findall(self.decoder.restore(text))) if text else ():
            hits = memory.get(w)
            if hits is None:
                if len(memory) >= self.most:
                    memory.clear()
                hits = memory[w] = tuple(x for x in (w, *(w[:k] + "-" for k in STEMS if len(w) > k)) if x in self.names)
            found.update(hits)
        return found


def language_model(docs: DataFrame, text: str = "text") -> np.ndarray:
    """log10 P(c | a, b) over CLASSES^3 codes, from the counts of all documents, smoothed by the bigrams."""
    n = np.zeros(CLASSES**3)
    for code, count in trigram_counts(docs, text).collect():  # CLASSES^3 rows at most
        n[code] = count
    n = n.reshape(CLASSES, CLASSES, CLASSES)
    two = n.sum(0) + 0.5
    two /= two.sum(1, keepdims=True)
    return np.log10((n + 20 * two[None]) / (n.sum(2, keepdims=True) + 20)).ravel()


def _hits(some: DataFrame, shared, names: frozenset[str]) -> list[tuple[int, list[str]]]:
    """Label and listed features of each sampled text; the sample's bound is that of the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = Listed(names, Decoder(shared.value))
        for b in batches:
            found = [sorted(listed(t)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.string()))], ["y", "hits"])

    return [tuple(r) for r in some.mapInArrow(run, "y int, hits array<string>").collect()]


def _regress(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Weights of a penalised logistic regression by Newton's steps; the first column is the free constant."""
    w = np.zeros(x.shape[1])
    w[0] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    ridge = np.full(x.shape[1], penalty)
    ridge[0] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * (w - np.eye(1, len(w))[0] * w[0]))
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic") -> tuple[np.ndarray, dict[str, float], float, float]:
    """(language model, weights of listed features, weight of how many there are, constant).

    The language model counts every text. The features are chosen and weighed on at most sample
    labelled texts of the training part, equal texts once; a null label is none, of several the largest counts.
    """
    model = language_model(docs, text)
    known = labels.filter(F.col(toxic).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("_i")).agg(F.max(toxic).cast("int").alias("_y"))
    known = known.filter(id_remainder(F.col("_i"), MODULUS) != HELD).orderBy(F.xxhash64("_i"), "_i").limit(sample)
    some = docs.select(F.col(doc_id).alias("_i"), F.col(text).alias("t")).join(F.broadcast(known), "_i").groupBy("t").agg(F.max("_y").alias("y")).select("y", "t")
    some = checkpointed(some)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(shared.value)
        seen: dict[str, list[int]] = {}
        for b in batches:
            for y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for f in features(t, decoder) | {""}:  # every text has the empty word
                    c = seen.setdefault(f, [0, 0])
                    c[0] += 1
                    c[1] += y
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array([c[0] for c in seen.values()], pa.int64()), pa.array([c[1] for c in seen.values()], pa.int64())], ["w", "n", "k"])

    seen = checkpointed(some.mapInArrow(run, "w string, n bigint, k bigint").groupBy("w").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).filter(F.col("n") >= LEAST_TEXTS))
    whole = seen.filter("w = ''").first()
    if whole is None or not 0 < whole["k"] < whole["n"]:
        return model, {}, 0.0, -30.0 if whole is None or not whole["k"] else 30.0
    p = whole["k"] / whole["n"]
    z = (F.col("k") - F.col("n") * p) / F.sqrt(F.col("n") * (p * (1 - p)))
    best = [r["w"] for r in seen.filter("w <> ''").filter(z >= LEAST_Z).orderBy(F.desc(z), "w").limit(MOST_WORDS).collect()]
    place = {w: i + 2 for i, w in enumerate(best)}
    rows = sorted(_hits(some, shared, frozenset(best)))
    x, y = np.zeros((len(rows), len(best) + 2)), np.array([r[0] for r in rows], float)
    x[:, 0] = 1
    for i, (_, hits) in enumerate(rows):
        x[i, 1] = np.log1p(len(hits))
        x[i, [place[h] for h in hits]] = 1
    w = _regress(x, y)
    return model, {f: float(w[i]) for f, i in place.items()}, float(w[1]), float(w[0])


def score_toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """doc_id, th (hash of the text), held_out, score, predicted, n_signals for each row of docs.

    The score is a logistic function of the listed features in the restored text; a null or empty
    text has the constant's. A row without an id isn't held out. Labels are the only use of ids, and
    only of the training part; repeated rows get a row each, an empty table gives an empty one, no
    labels give scores near 0. Extra columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample, doc_id, text))
    d = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("th"), F.coalesce(id_remainder(F.col(doc_id), MODULUS) == HELD, F.lit(False)).alias("held_out"), F.col(text).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, weights, many, constant = shared.value
        listed = Listed(weights, Decoder(model))
        for b in batches:
            found = [sorted(listed(t)) for t in b.column(3).to_pylist()]
            scores = 1 / (1 + np.exp(-np.clip([constant + many * np.log1p(len(f)) + sum(weights[w] for w in f) for f in found], -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(scores, pa.float64()), pa.array((scores >= threshold).astype(np.int32)), pa.array([len(f) for f in found], pa.int32())],
                                             ["doc_id", "th", "held_out", "score", "predicted", "n_signals"])

    return d.mapInArrow(run, f"doc_id {dict(d.dtypes)['doc_id']}, th bigint, held_out boolean, score double, predicted int, n_signals int")


def drop_toxic(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the rows that are predicted toxic, all columns as they are, whatever their names."""
    bad = score_toxicity(docs, labels, doc_id, text).filter("predicted = 1").select(F.col("doc_id").alias("i"), F.col("th").alias("t")).distinct()
    return rows_by_key(docs, bad, doc_id, text, "left_anti")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted", "n_signals")
