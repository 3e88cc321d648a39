"""A quality classifier learnt from weak labels.

1. Nine heuristic labellers vote good, bad or nothing on every whole text. All texts count: their vote patterns, at most
   3^9 different ones, are tallied in Spark.
2. Expectation-maximisation over the tallies estimates the share of good documents and, for each labeller, how it votes on
   good and on bad ones, without any label. Each pattern gets its posterior.
3. A linear scorer over hashed features (words, word shapes, binned measures) is fitted to the posteriors of a seeded sample
   of documents, at most ``SAMPLE`` and ``SAMPLE_BYTES`` of text, and scores every whole text.

Defined results: a null or empty text, and one of white space, scores 0 and is not kept. Repeated rows and null ids are
scored each. A table without rows gives no rows. Columns other than the id and the text are handed on unseen; earlier
columns named score or kept are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import set_aside, ship, table, within, words_of

SAMPLE, SAMPLE_BYTES = 4000, 64 << 20
BUCKETS, EM_ROUNDS, FIT_ROUNDS, KEEP_FROM = 1 << 16, 60, 60, 0.5
LABELLERS = ("symbols", "capitals", "exclamations", "variety", "commonest", "word_length", "sentences", "letters", "runs")
SYMBOLS = "#*$%&|<>~^@=_\\{}"
_RUNS = re.compile(r"(.)\1+", re.S)


def _shape(word: str) -> str:
    """Letters become A or a, digits 0; runs become one."""
    return _RUNS.sub(r"\1", "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word))


class Profiler:
    """Counts and measures of texts; what one word adds is worked out once, and the store of words is bounded."""

    def __init__(self, most: int = 300_000):
        import numpy as np

        self.most, self.known, self.values = most, {}, np.zeros((0, 8), np.int64)

    @staticmethod
    def _about(w: str) -> tuple[int, ...]:
        last = w[-1]
        core = w[:-1] if last in ".,;:!?" else w
        # Nearly all words are letters in one of three shapes, with a mark behind them or not.
        if core.isalpha() and (core.islower() or core.isupper() or core[0].isupper() and core[1:].islower()):
            shape, upper = ("a", 0) if core.islower() else ("Aa", 1) if core[1:].islower() else ("A", len(core))
            letters, symbols, marks = len(core), 0, last == "!"
            shape += last if core is not w else ""
        else:
            shape, upper, letters = _shape(w), sum(map(str.isupper, w)), sum(map(str.isalpha, w))
            symbols, marks = sum(map(w.count, SYMBOLS)), w.count("!")
        return crc32(w.lower().encode("utf-8", "replace")) % BUCKETS, crc32(b"s" + shape.encode("utf-8", "replace")) % BUCKETS, len(w), symbols, upper, marks, last in ".!?", letters

    def __call__(self, texts: list[str | None]) -> list:
        """For each text (word buckets, shape buckets, counts, measures), or None without words."""
        import numpy as np

        if len(self.known) > self.most:
            self.known.clear()
            self.values = self.values[:0]
        known, new, found = self.known, [], []
        for text in texts:
            words = words_of(text)
            for w in set(words).difference(known):
                known[w] = len(known)
                new.append(self._about(w.decode("utf-8", "surrogatepass")))
            codes = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
            found.append((*np.unique(codes, return_counts=True), int((codes[1:] == codes[:-1]).sum())) if words else None)
        if new:
            self.values = np.concatenate([self.values, np.array(new, np.int64)])
        values = self.values
        out = []
        for x in found:
            if x is None:
                out.append(None)
                continue
            own, counts = values[x[0]], x[1]
            n = int(counts.sum())
            chars, symbols, upper, marks, ends, letters = (counts @ own[:, 2:]).tolist()
            measures = np.array([symbols / n, upper / max(1, letters), marks / n, len(counts) / n, int(counts.max()) / n, chars / n, ends / n, letters / max(1, chars), np.log10(n), x[2] / n])
            out.append((own[:, 0], own[:, 1], counts, measures))
        return out


def votes(measures) -> tuple[int, ...]:
    """1 for bad, 0 for good, 2 for no vote, in the order of LABELLERS. Short texts get few votes."""
    symbols, upper, marks, variety, commonest, length, ends, letters, size, runs = measures
    short = size < 1.3

    def vote(bad: bool, good: bool) -> int:
        return 1 if bad else 0 if good else 2

    return (
        vote(symbols > 0.2, symbols < 0.05),
        vote(upper > 0.4 and not short, upper < 0.2),
        vote(marks > 0.3 and not short, marks < 0.1),
        # Long texts use words again.
        vote(not short and variety < 0.25 and variety * 10**size < 400, variety > 0.4),
        vote(not short and commonest > 0.25, commonest < 0.15),
        vote(length > 12 or length < 2.2, 3 < length < 7.5),
        vote(not short and (ends > 0.5), 0.02 < ends < 0.4),
        vote(letters < 0.7 and not short, letters > 0.85),
        vote(not short and runs > 0.1, runs < 0.02),
    )


def pattern(measures) -> int:
    code = 0
    for v in votes(measures):
        code = 3 * code + v
    return code


def unpacked(codes):
    import numpy as np

    out = []
    for _ in LABELLERS:
        codes, v = np.divmod(codes, 3)
        out.append(v)
    return np.stack(out[::-1], axis=1)


def estimate(codes: list[int], counts: list[int]) -> tuple[dict[int, float], list[dict]]:
    """Posterior of good for each vote pattern, and each labeller's accuracies on good and bad documents."""
    import numpy as np

    if not codes:
        return {}, []
    v, n = unpacked(np.array(codes, np.int64)), np.array(counts, float)
    hot = (v[:, :, None] == np.arange(3)).astype(float)
    # To begin with, a single vote of bad makes a document likely bad.
    good = np.where((v == 1).any(axis=1), 0.1, 0.95)
    for _ in range(EM_ROUNDS):
        tables, shares = [], []
        for p in (1 - good, good):
            weight = n * p
            tables.append(np.log((np.einsum("i,ijk->jk", weight, hot) + 0.5) / (weight.sum() + 1.5)))
            shares.append(np.log((weight.sum() + 1) / (n.sum() + 2)))
        bad_log, good_log = (s + np.einsum("ijk,jk->i", hot, t) for s, t in zip(shares, tables, strict=True))
        good = 1 / (1 + np.exp(np.clip(bad_log - good_log, -50, 50)))
    accuracy = lambda t, k: float(np.exp(t[k]) / (np.exp(t[0]) + np.exp(t[1])))
    about = [{"labeller": name, "on_good": accuracy(tables[1][j], 0), "on_bad": accuracy(tables[0][j], 1)} for j, name in enumerate(LABELLERS)]
    return dict(zip(codes, good.tolist(), strict=True)), about


def _bins(measures):
    """A bucket for each measure's bin."""
    return [crc32(f"m{i}:{round(float(x) * (2 if i in (5, 8) else 10))}".encode()) % BUCKETS for i, x in enumerate(measures)]


def vector(profile):
    """(buckets, values): words by their share of logarithms, shapes by share of words, binned measures."""
    import numpy as np

    words, shapes, counts, measures = profile
    logs = np.log1p(counts)
    bins = _bins(measures)
    return np.concatenate([words, shapes, bins]), np.concatenate([0.5 * logs / np.sqrt((logs**2).sum()), 2 * counts / counts.sum(), np.full(len(bins), 0.5)])


def fit(parts: list, targets: list[float], together: int = 100):
    """Weights of the hashed linear scorer, the last one for the intercept, from vectors and their targets; ``together`` vectors are unpacked at a time."""
    import numpy as np

    weights = np.zeros(BUCKETS + 1)
    if not parts:
        return weights
    y = np.array(targets)
    square = np.full(BUCKETS + 1, 1e-8)
    for _ in range(FIT_ROUNDS):
        slope = np.zeros(BUCKETS + 1)
        for first in range(0, len(parts), together):
            some = parts[first : first + together]
            sizes = [len(a) for a, _ in some]
            at, x = np.concatenate([a for a, _ in some]).astype(np.int64), np.concatenate([b for _, b in some])
            row = np.repeat(np.arange(len(some)), sizes)
            p = 1 / (1 + np.exp(-np.clip(np.bincount(row, weights=weights[at] * x, minlength=len(some)) + weights[-1], -50, 50)))
            off = y[first : first + together] - p
            slope[:-1] += np.bincount(at, weights=off[row] * x, minlength=BUCKETS)
            slope[-1] += off.sum()
        slope = slope / len(y) - 1e-6 * weights
        square += slope**2
        weights += 0.3 * slope / np.sqrt(square)
    return weights


def _patterns(batches: Iterator) -> Iterator:
    import pyarrow as pa

    profiler = Profiler()
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            found = [pattern(p[3]) for p in profiler(batch.slice(at, 512).column(0).to_pylist()) if p is not None]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32())], ["pattern"])


def _vectors(batches: Iterator) -> Iterator:
    """(by, text) to (by, pattern, buckets, values): vectors as bytes, of 16-bit and 64-bit numbers."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        # A store of words for a few texts at a time: it is no larger than theirs.
        for at in range(0, batch.num_rows, 200):
            part = batch.slice(at, 200)
            found = [(by, p, *vector(p)) for by, p in zip(part.column("by").to_pylist(), Profiler()(part.column("text").to_pylist()), strict=True) if p is not None]
            columns = [
                pa.array([by for by, *_ in found], pa.int64()), pa.array([pattern(p[3]) for _, p, *_ in found], pa.int32()),
                pa.array([a.astype(np.uint16).tobytes() for *_, a, _ in found], pa.binary()), pa.array([x.tobytes() for *_, x in found], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["by", "pattern", "buckets", "values"])


def train(docs: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES, seed: str = "quality"):
    """The scorer's weights, and what the estimate says of the labellers. docs: (doc_id, text)."""
    import numpy as np

    spark = docs.sparkSession
    ship(spark)
    tallies = docs.select("text").mapInArrow(_patterns, "pattern int").groupBy("pattern").count().collect()
    posterior, about = estimate([r.pattern for r in tallies], [r["count"] for r in tallies])
    # The least hashes of whole rows: repeated rows count once, and the driver gets what the bounds say at any size.
    hashed = docs.select(F.xxhash64(F.lit(seed), "doc_id", "text").alias("by"), "text")
    first = hashed.groupBy("by").agg(F.max(F.octet_length("text")).alias("size")).where("size > 0").orderBy("by").limit(sample).collect()
    taken = [(first[i].by,) for i in within([r["size"] for r in first], sample_bytes)]
    chosen = spark.createDataFrame(taken, "by long")
    # Texts stay with the executors: the driver holds packed vectors alone.
    rows = hashed.join(F.broadcast(chosen), "by").dropDuplicates(["by"]).mapInArrow(_vectors, "by long, pattern int, buckets binary, values binary").collect() if taken else []
    rows.sort(key=lambda r: r.by)
    parts = [(np.frombuffer(r.buckets, np.uint16), np.frombuffer(r["values"], np.float64)) for r in rows]
    return fit(parts, [posterior.get(r.pattern, 0.5) for r in rows]), about


def classify(docs: DataFrame, weights, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of docs with score and kept."""
    import numpy as np

    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))
    rest = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("score", "kept")])
    place = rest.columns.index(text_col)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        profiler, w = Profiler(), shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                scores = []
                for p in profiler(part.column(place).to_pylist()):
                    if p is None:
                        scores.append(0.0)
                        continue
                    buckets, values = vector(p)
                    scores.append(float(1 / (1 + np.exp(-np.clip(w[buckets.astype(np.int64)] @ values + w[-1], -50, 50)))))
                kept = [s >= KEEP_FROM for s in scores]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores, pa.float64()), pa.array(kept, pa.bool_())], [*part.schema.names, "score", "kept"])

    return rest.mapInArrow(run, T.StructType([*rest.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("kept", T.BooleanType())]))


def keep_good(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs that the classifier keeps, with their own columns."""
    weights, _ = train(docs.select("doc_id", "text"), sample)
    own, (text,), restored = set_aside(docs, "text")
    return restored(classify(own, weights, text_col=text).where("kept"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    weights, _ = train(docs)
    return classify(docs, weights).select("doc_id", "score", "kept")
