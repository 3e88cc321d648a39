"""Toxic spans and document scores by a linear-chain conditional random field.

The model is fitted on a bounded sample of labelled rows, ``SAMPLE_TOXIC`` and ``SAMPLE_OTHER`` documents and
``SAMPLE_BYTES`` of text at most, near copies left out. Labels are given to documents, so tokens are labelled first: a token of a toxic document is toxic if its
word, or one of the word's beginnings, lies in toxic documents so much more often than the share of these documents
accounts for that chance is ruled out. A chain over the tokens of a sentence then learns from these labels, by gradient of
the exact likelihood; features are the word and its beginnings of 3 to 6 letters, so that unseen forms of a stem count.

Scoring takes the forward-backward marginals of every token of the whole text. The expected number of toxic tokens and the
largest marginal give the document's score through a logistic fit on the sample; tokens of marginal 0.5 or more are the
offending spans. Chains end with sentences and after ``CHAIN`` tokens.

Defined results: a null or empty text has no tokens, and the score of a document without toxic tokens. A row without a label,
or without an id, is never learnt from; labels that disagree make a document toxic. Without two kinds of labels to learn
from, all scores are the share of toxic labels (0 without any). Repeated rows are scored each. A table without rows gives no
rows. Columns other than those named are not looked at, and label, language, source and id are no inputs of a score.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, ship, table, within, words_of

SAMPLE_TOXIC, SAMPLE_OTHER, SAMPLE_BYTES, SENTENCES = 1000, 3000, 64 << 20, 16_000
CHAIN, FOLDS, RARE = 256, 5, 1e-6
ROUNDS, RATE, SHRINK = 60, 0.5, 1e-5
_WORDS = re.compile(WORD)
EDGES = ".,!?;:*$%&#|<>\"'()[]{}…«»“”‘’¡¿"


def normal(token: str) -> str:
    return token.strip(EDGES).lower()


class _Normals(dict):
    """Normal forms by token, each string once."""

    def __missing__(self, token: str) -> str:
        form = self[token] = self.own(normal(token))
        return form

    def __init__(self):
        super().__init__()
        self._held: dict[str, str] = {}

    def own(self, text: str) -> str:
        return self._held.setdefault(text, text)


def features(word: str) -> list[str]:
    return ["", "w" + word, *(f"{n}{word[:n]}" for n in range(3, 7) if len(word) >= n)]


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    #: Logarithms of the transitions 0-1, 1-0 and 1-1 against 0-0.
    moves: tuple[float, float, float] = (-3.0, 0.0, 0.0)
    #: Score of a document: intercept, by log(1 + expected toxic tokens), by largest marginal.
    document: tuple[float, float, float] = (-math.inf, 0.0, 0.0)

    def emission(self, word: str) -> float:
        return max(-30.0, min(30.0, sum(self.weights.get(f, 0.0) for f in features(word)))) if word else -30.0

    def score(self, expected, largest):
        import numpy as np

        a, b, c = self.document
        return 1 / (1 + np.exp(-np.clip(a + b * np.log1p(expected) + c * largest, -50, 50)))


def chains(ends, bounds):
    """Starts and lengths of chains: they end after the places in ends, with documents (at bounds) and after CHAIN tokens."""
    import numpy as np

    n = int(bounds[-1])
    cut = np.zeros(n + 1, bool)
    cut[ends + 1] = True
    cut[bounds] = True
    starts = np.unique(np.concatenate([np.flatnonzero(cut[:n]), [0] if n else []]).astype(np.int64))
    lengths = np.diff(np.concatenate([starts, [n]]))
    extra = (lengths - 1) // CHAIN
    if extra.any():
        starts = np.concatenate([starts] + [starts[extra >= k] + k * CHAIN for k in range(1, int(extra.max()) + 1)])
        starts.sort()
        lengths = np.diff(np.concatenate([starts, [n]]))
    return starts, lengths


def forward_backward(emissions, starts, lengths, moves):
    """Marginals of label 1, and the ratios of forward and of backward sums from which they come."""
    import numpy as np

    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    t01, t10, t11 = np.exp(moves)
    odds = np.exp(emissions)
    forward, backward = np.zeros(len(odds)), np.ones(len(odds))
    live = np.searchsorted(-lengths, -np.arange(1, (lengths[0] if len(lengths) else 0) + 1), side="right")
    for t, n in enumerate(live.tolist()):
        at = starts[:n] + t
        if t == 0:
            forward[at] = odds[at] * t01
        else:
            r = forward[at - 1]
            forward[at] = odds[at] * (t01 + r * t11) / (1 + r * t10)
    for t in range(len(live) - 2, -1, -1):
        at = starts[: live[t + 1]] + t
        x = odds[at + 1] * backward[at + 1]
        backward[at] = (t10 + t11 * x) / (1 + t01 * x)
    both = forward * backward
    return both / (1 + both), forward, backward


def learn_tokens(documents: list[set[str]], toxic: list[bool]) -> set[str]:
    """Words and beginnings that mark toxic documents beyond chance. documents: the words of each."""
    import numpy as np

    share = sum(toxic) / max(1, len(toxic))
    names: dict[str, int] = {}
    own: dict[str, list[int]] = {"": []}
    total, hits = [], []
    for words, label in zip(documents, toxic, strict=True):
        for w in words.difference(own):
            own[w] = [names.setdefault(f, len(names)) for f in features(w)[1:]]
        found = np.unique(np.array([f for w in words for f in own[w]], np.int64))
        total.append(found)
        if label:
            hits.append(found)
    count = lambda parts: np.bincount(np.concatenate([np.zeros(0, np.int64), *parts]), minlength=len(names))
    every, bad = count(total), count(hits)
    marked = set()
    spelled = list(names)
    for i in np.flatnonzero((bad >= 3) & (10 * bad >= 9 * every)).tolist():
        n, k = int(every[i]), int(bad[i])
        p = k / n
        # Chernoff's bound on the binomial tail: how rare so many toxic documents among n are by chance.
        tail = -n * (p * math.log(p / share) + ((1 - p) * math.log((1 - p) / (1 - share)) if p < 1 else 0)) if p > share else 0.0
        if tail < math.log(RARE):
            marked.add(spelled[i])
    return marked


def fit(texts: list[str | None], toxic: list[bool]) -> Model:
    """The model of a bounded list of labelled texts."""
    import numpy as np

    if not any(toxic) or all(toxic):
        share = sum(toxic) / max(1, len(toxic))
        return Model(document=(math.log(share / (1 - share)) if 0 < share < 1 else 50.0 if share else -50.0, 0.0, 0.0))
    texts, toxic = _without_copies(texts, toxic)
    # Every word of the sample is held once.
    normals = _Normals()
    tokens = [[normals.own(w) for w in _WORDS.findall(t or "")] for t in texts]
    marked = learn_tokens([set(map(normals.__getitem__, set(x))) for x in tokens], toxic)

    # Sentences with a toxic token, and as many others as the bound leaves, from all documents alike.
    sentences, labels = [], []
    rest_s, rest_l = [], []
    for words, label in zip(tokens, toxic, strict=True):
        at = 0
        for i, w in enumerate(words):
            if w[-1] in ".!?" or i == len(words) - 1 or i - at >= CHAIN - 1:
                own = list(map(normals.__getitem__, words[at : i + 1]))
                at = i + 1
                y = [bool(label) and any(f in marked for f in features(x)[1:]) for x in own]
                (sentences if any(y) else rest_s).append(own)
                (labels if any(y) else rest_l).append(y)
    order = np.random.default_rng(3)
    hit = order.permutation(len(sentences))[: SENTENCES // 2]
    miss = order.permutation(len(rest_s))[: SENTENCES - len(hit)]
    sentences, labels = [sentences[i] for i in hit] + [rest_s[i] for i in miss], [labels[i] for i in hit] + [rest_l[i] for i in miss]

    words: dict[str, int] = {}
    codes = np.array([words.setdefault(w, len(words)) for s in sentences for w in s], np.int64)
    y = np.array([v for s in labels for v in s], float)
    lengths = np.array([len(s) for s in sentences], np.int64)
    starts = np.cumsum(lengths) - lengths
    names: dict[str, int] = {}
    pairs = [(u, names.setdefault(f, len(names))) for w, u in words.items() for f in features(w)]
    word_of, feature_of = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
    weights, moves = np.zeros(len(names)), np.array([-3.0, 0.0, 0.0])
    square_w, square_m = np.full(len(names), 1e-8), np.full(3, 1e-8)
    first = np.zeros(len(codes), bool)
    first[starts] = True
    inner = np.flatnonzero(~first)
    before = np.where(first, 0.0, np.concatenate([[0.0], y[:-1]]))
    seen = np.array([((1 - before) * y).sum(), (before * (1 - y))[inner].sum(), (before * y)[inner].sum()])
    for _ in range(ROUNDS):
        unit = np.clip(np.bincount(word_of, weights=weights[feature_of], minlength=len(words)), -30, 30)
        p, r, b = forward_backward(unit[codes], starts, lengths, moves)
        x = np.exp(unit[codes]) * b
        t01, t10, t11 = np.exp(moves)
        last = np.where(first, 0.0, np.concatenate([[0.0], r[:-1]]))
        total = 1 + t01 * x + last * t10 + last * t11 * x
        expected = np.array([(t01 * x / total).sum(), (last * t10 / total).sum(), (last * t11 * x / total).sum()])
        by_word = np.bincount(codes, weights=y - p, minlength=len(words))
        slope = np.bincount(feature_of, weights=by_word[word_of], minlength=len(names)) / len(sentences) - SHRINK * weights
        square_w += slope**2
        weights += RATE * slope / np.sqrt(square_w)
        slope = (seen - expected) / len(sentences)
        square_m += slope**2
        moves += RATE * slope / np.sqrt(square_m)
    model = Model({f: float(weights[i]) for f, i in names.items() if abs(weights[i]) > 1e-3}, tuple(moves.tolist()))

    measured = np.array([m[:2] for m in Tagger(model).measure(texts)])
    x = np.column_stack([np.ones(len(texts)), np.log1p(measured[:, 0]), measured[:, 1]])
    target, fitted = np.array(toxic, float), np.array([-2.0, 0.0, 0.0])
    for _ in range(30):  # Newton's method, with a little shrinkage
        q = 1 / (1 + np.exp(-np.clip(x @ fitted, -50, 50)))
        step = np.linalg.solve(x.T @ (x * (q * (1 - q))[:, None]) + 0.5 * np.eye(3), x.T @ (target - q) - 0.5 * fitted)
        fitted = fitted + np.clip(step, -2, 2)
    model.document = tuple(fitted.tolist())
    return model


def _without_copies(texts, toxic):
    """Leaves out texts that share two or more of four minimal hashes of three-word shingles with an earlier one."""
    import numpy as np

    numbers: dict[str, int] = {}
    odd = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
    seen, keep = set(), []
    for i, text in enumerate(texts):
        words = _WORDS.findall(text or "")
        at = np.array([numbers.setdefault(w, len(numbers) + 1) for w in words] + [0] * max(0, 3 - len(words)), np.uint64)
        mixed = (at[:-2] * odd[0]) ^ (at[1:-1] * odd[1]) ^ (at[2:] * odd[2])
        mixed = (mixed ^ (mixed >> np.uint64(29))) * odd[3]
        least = [(k, int(((mixed ^ (mixed >> np.uint64(32))) * odd[k]).min())) for k in range(4)]
        if sum(x in seen for x in least) < 2:
            keep.append(i)
        seen.update(least)
    return [texts[i] for i in keep], [toxic[i] for i in keep]


class Tagger:
    """Scores texts, batch by batch. What a word adds is worked out once; the store of words is bounded."""

    def __init__(self, model: Model, most: int = 400_000):
        import numpy as np

        self.model, self.most, self.known = model, most, {}
        self.emissions, self.ends = np.zeros(0), np.zeros(0, bool)

    def measure(self, texts: list[str | None]) -> list[tuple[float, float, list]]:
        """(expected toxic tokens, largest marginal, places of tokens of 0.5 or more with their marginals) of each text."""
        import numpy as np

        if len(self.known) > self.most:
            self.known.clear()
            self.emissions, self.ends = self.emissions[:0], self.ends[:0]
        known, new, codes = self.known, [], []
        for text in texts:
            tokens = words_of(text)
            for w in set(tokens).difference(known):
                known[w] = len(known)
                new.append(w.decode("utf-8", "surrogatepass"))
            codes.append(np.fromiter(map(known.__getitem__, tokens), np.int64, len(tokens)))
        self.emissions = np.concatenate([self.emissions, np.array([self.model.emission(normal(w)) for w in new])])
        self.ends = np.concatenate([self.ends, np.array([w[-1] in ".!?" for w in new], bool)])
        emissions, ends = self.emissions, self.ends
        sizes = np.array([len(c) for c in codes], np.int64)
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        flat = np.concatenate([np.zeros(0, np.int64), *codes])
        starts, lengths = chains(np.flatnonzero(ends[flat]), bounds) if len(flat) else (flat, flat)
        p = forward_backward(emissions[flat], starts, lengths, self.model.moves)[0] if len(flat) else np.zeros(0)
        full = np.flatnonzero(sizes)
        expected, largest = np.zeros(len(texts)), np.zeros(len(texts))
        if len(full):
            expected[full], largest[full] = np.add.reduceat(p, bounds[full]), np.maximum.reduceat(p, bounds[full])
        hits = np.flatnonzero(p >= 0.5)
        of = np.searchsorted(bounds, hits, side="right") - 1
        places: list[list] = [[] for _ in texts]
        for i, h in zip(of.tolist(), hits.tolist(), strict=True):
            places[i].append((h - int(bounds[i]), float(p[h])))
        return list(zip(expected.tolist(), largest.tolist(), places, strict=True))


def sampled(docs: DataFrame, labels: DataFrame, toxic: int = SAMPLE_TOXIC, other: int = SAMPLE_OTHER, sample_bytes: int = SAMPLE_BYTES) -> tuple[list, list]:
    """Texts and labels of a seeded sample of the labelled rows outside fold 0, bounded in rows and bytes."""
    spark = docs.sparkSession
    known = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(fold("doc_id") != 0)
    by = F.xxhash64(F.lit("toxicity"), "doc_id")
    ids = known.where("toxic = 1").orderBy(by).limit(toxic).unionByName(known.where("toxic = 0").orderBy(by).limit(other))
    # At most toxic + other ids are broadcast, and as many sizes, then texts under the bound, come to the driver.
    sized = docs.select("doc_id", F.octet_length("text").alias("size")).join(F.broadcast(ids), "doc_id")
    sized = sized.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.coalesce(F.max("size"), F.lit(0)).alias("size")).orderBy(by).collect()
    taken = [(sized[i].doc_id, sized[i].toxic) for i in within([r["size"] for r in sized], sample_bytes)]
    if not taken:
        return [], []
    chosen = F.broadcast(spark.createDataFrame(taken, "doc_id long, toxic int"))
    rows = docs.select("doc_id", "text").join(chosen, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).collect()
    rows.sort(key=lambda r: r.doc_id)
    return [r.text for r in rows], [r.toxic == 1 for r in rows]


def fold(column: str):
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(FOLDS))


def tag(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, spans) of every row; a span has start, end (code points, end exclusive) and marginal."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        tagger = Tagger(shared.value)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("marginal", pa.float64())]))
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = part.column(1).to_pylist()
                found = tagger.measure(texts)
                spans = []
                for text, (_, _, places) in zip(texts, found, strict=True):
                    own = dict(places)
                    spans.append([{"start": m.start(), "end": m.end(), "marginal": own[i]} for i, m in enumerate(_WORDS.finditer(text)) if i in own] if own else [])
                scores = tagger.model.score(np.array([f[0] for f in found]), np.array([f[1] for f in found]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores, pa.float64()), pa.array(spans, kind)], ["doc_id", "score", "spans"])

    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return slim.mapInArrow(run, "doc_id long, score double, spans array<struct<start:int,end:int,marginal:double>>")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(*sampled(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic")))
    held_out = F.coalesce(fold("doc_id") == 0, F.lit(False)).alias("held_out")
    return tag(docs, model).select("doc_id", held_out, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("spans").cast("long").alias("n_spans"))
