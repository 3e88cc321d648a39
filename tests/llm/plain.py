"""Plain versions of operators, row by row and word by word, that the tests compare with."""

from __future__ import annotations

import base64
import gzip
import hashlib
import math
import re
from collections import Counter, defaultdict
from zlib import crc32

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
KINDS = ("assign", "access", "hex")


# ---- 1
def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = [("assign", m) for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
    found += [("access", m) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20] + [("hex", m) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(k, m.start(), m.end()) for k, m in found]


def _layers(text: str, places: list):
    """Each text that one step of unwrapping gives, with the places of its characters."""
    out, own, last = [], [], 0
    for m in re.finditer(r"(?:%[0-9A-Fa-f]{2})+", text):
        out.append(text[last : m.start()])
        own += places[last : m.start()]
        raw, i = bytes.fromhex(m[0].replace("%", "")), 0
        while i < len(raw):
            for n in (1, 2, 3, 4):
                try:
                    char = raw[i : i + n].decode()
                    break
                except UnicodeDecodeError:
                    continue
            else:
                n, char = 1, chr(raw[i])
            out.append(char)
            at = m.start() + 3 * i
            own.append((places[at][0], places[at + 3 * n - 1][1]))
            i += n
        last = m.end()
    if last:
        yield "".join(out) + text[last:], own + places[last:]
    out, own, last = [], [], 0
    for m in re.finditer(r"\\u([0-9A-Fa-f]{4})|&#([0-9]+);", text):
        out.append(text[last : m.start()] + chr(int(m[1], 16) if m[1] else int(m[2])))
        own += [*places[last : m.start()], (places[m.start()][0], places[m.end() - 1][1])]
        last = m.end()
    if last:
        yield "".join(out) + text[last:], own + places[last:]
    for m in re.finditer(r"[A-Za-z0-9+/_-]{12,}={0,2}", text):
        clean = m[0].rstrip("=").replace("-", "+").replace("_", "/")
        for first in range(len(clean)):
            part = clean[first:]
            part = part[: len(part) - (len(part) % 4 == 1)]
            data = base64.b64decode(part + "=" * (-len(part) % 4))
            whole = (places[m.start() + first][0], places[m.end() - 1][1])
            if data[:3] == b"\x1f\x8b\x08":
                inner = gzip.decompress(data).decode("utf-8", "replace")
                yield inner, [whole] * len(inner)
            if first < 4:
                plain, own, byte = data.decode("utf-8", "surrogateescape"), [], 0
                for c in plain:
                    n = len(c.encode("utf-8", "surrogateescape"))
                    own.append((places[m.start() + first + byte * 8 // 6][0], places[m.start() + first + ((byte + n) * 8 - 1) // 6][1]))
                    byte += n
                yield re.sub("[\udc80-\udcff]", "�", plain), own


def all_spans(text: str) -> set[tuple[str, int, int]]:
    found, seen = set(), set()

    def go(text, places):
        if not text or (text, places[0], places[-1]) in seen:
            return
        seen.add((text, places[0], places[-1]))
        found.update((k, places[a][0], places[b - 1][1]) for k, a, b in base_spans(text))
        for more in _layers(text, places):
            go(*more)

    go(text, [(i, i + 1) for i in range(len(text))])
    return found


# ---- 2
def targets(sizes: dict) -> dict:
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        level = (total - sum(fixed.values())) / max(1, sum(weight[s] for s in free))
        over = [s for s in free if level * weight[s] > 3 * sizes[s]]
        if not over:
            return fixed | {s: level * weight[s] for s in free}
        fixed |= {s: 3 * sizes[s] for s in over}


def times(docs: list[tuple]) -> list[int]:
    """How often the mix takes each of (id, source, size)."""
    sizes = Counter()
    for _, source, size in docs:
        sizes[source] += size
    wanted, out = targets(sizes), [0] * len(docs)
    key = [hashlib.md5(f"mix-1:{'' if i is None else i}".encode()).hexdigest() for i, _, _ in docs]
    for source, total in sizes.items():
        whole = min(3, math.floor(wanted[source] / total + 1e-12)) if total else 0
        rest = 0.0 if whole >= 3 else max(0.0, wanted[source] - whole * total)
        own = [n for n, d in enumerate(docs) if d[1] == source and d[2] > 0]
        taken = set()
        for _ in range(3):
            by_hash = defaultdict(list)
            for n in own:
                if n not in taken and docs[n][2] <= rest:
                    by_hash[key[n]].append(n)
            upto, fits = 0, 0
            for h in sorted(by_hash):
                upto += sum(docs[n][2] for n in by_hash[h])
                if upto > rest:
                    break
                fits = upto
                taken.update(by_hash[h])
            rest -= fits
        for n in own:
            out[n] = whole + (n in taken)
    return out


# ---- 3
def _plain_shape(word: str) -> str:
    signs = "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word)
    return "".join(c for i, c in enumerate(signs) if not i or signs[i - 1] != c)


def quality_measures(text: str | None):
    w = WORDS.findall(text or "")
    if not w:
        return None
    counts, n = Counter(w), len(w)
    letters, chars = sum(c.isalpha() for x in w for c in x), sum(map(len, w))
    return [
        sum(c in "#*$%&|<>~^@=_\\{}" for x in w for c in x) / n, sum(c.isupper() for x in w for c in x) / max(1, letters), sum(x.count("!") for x in w) / n, len(counts) / n,
        max(counts.values()) / n, chars / n, sum(x[-1] in ".!?" for x in w) / n, letters / chars, math.log10(n), sum(a == b for a, b in zip(w, w[1:], strict=False)) / n,
    ]


def quality_votes(m) -> tuple[int, ...]:
    symbols, upper, marks, variety, commonest, length, ends, letters, size, runs = m
    long_ = size >= 1.3
    bad = (symbols > 0.2, long_ and upper > 0.4, long_ and marks > 0.3, long_ and variety < 0.25 and variety * 10**size < 400, long_ and commonest > 0.25, length > 12 or length < 2.2, long_ and ends > 0.5, long_ and letters < 0.7, long_ and runs > 0.1)
    good = (symbols < 0.05, upper < 0.2, marks < 0.1, variety > 0.4, commonest < 0.15, 3 < length < 7.5, 0.02 < ends < 0.4, letters > 0.85, runs < 0.02)
    return tuple(1 if b else 0 if g else 2 for b, g in zip(bad, good, strict=True))


def quality_posteriors(votes: list[tuple]) -> dict[tuple, float]:
    """Expectation-maximisation, labeller by labeller."""
    tally = Counter(votes)
    good = {v: 0.1 if 1 in v else 0.95 for v in tally}
    for _ in range(60):
        of = {}
        for side in (0, 1):
            p = {v: good[v] if side else 1 - good[v] for v in tally}
            weight = sum(tally[v] * p[v] for v in tally)
            for j in range(9):
                for k in range(3):
                    of[side, j, k] = (sum(tally[v] * p[v] for v in tally if v[j] == k) + 0.5) / (weight + 1.5)
            of[side] = (weight + 1) / (sum(tally.values()) + 2)
        for v in tally:
            odds = [math.log(of[side]) + sum(math.log(of[side, j, k]) for j, k in enumerate(v)) for side in (0, 1)]
            good[v] = 1 / (1 + math.exp(max(-50, min(50, odds[0] - odds[1]))))
    return good


def quality_vector(text: str) -> dict[int, float]:
    w, out = WORDS.findall(text), defaultdict(float)
    counts = Counter(w)
    bucket = lambda s: crc32(s.encode("utf-8", "replace")) % 65536
    norm = math.sqrt(sum(math.log1p(c) ** 2 for c in counts.values()))
    for x, c in counts.items():
        out[bucket(x.lower())] += 0.5 * math.log1p(c) / norm
        out[bucket("s" + _plain_shape(x))] += 2 * c / len(w)
    for i, m in enumerate(quality_measures(text)):
        out[bucket(f"m{i}:{round(m * (2 if i in (5, 8) else 10))}")] += 0.5
    return out


def quality_scores(texts: list[str | None], sample: list[str]) -> list[float]:
    """The scores of texts, learnt from the votes on all of them and the vectors of a sample."""
    judged = [None if (m := quality_measures(t)) is None else quality_votes(m) for t in texts]
    good = quality_posteriors([v for v in judged if v is not None])
    rows = [(quality_vector(t), good[quality_votes(quality_measures(t))]) for t in sample]
    weights, square, own, own_square = defaultdict(float), defaultdict(lambda: 1e-8), 0.0, 1e-8
    score = lambda x: 1 / (1 + math.exp(-max(-50, min(50, sum(weights[f] * v for f, v in x.items()) + own))))
    for _ in range(60):
        slope, slope_own = defaultdict(float), 0.0
        for x, y in rows:
            d = (y - score(x)) / len(rows)
            slope_own += d
            for f, v in x.items():
                slope[f] += d * v
        for f in slope:
            g = slope[f] - 1e-6 * weights[f]
            square[f] += g * g
            weights[f] += 0.3 * g / math.sqrt(square[f])
        g = slope_own - 1e-6 * own
        own_square += g * g
        own += 0.3 * g / math.sqrt(own_square)
    return [0.0 if v is None else score(quality_vector(t)) for t, v in zip(texts, judged, strict=True)]


# ---- 6
def components(docs: list[tuple], size: int = 4) -> dict:
    """The least id that each id of (id, text) reaches; a null id counts as one document."""
    sets = defaultdict(list)
    for i, text in docs:
        w = WORDS.findall((text or "").translate(LOWER))
        sets[i].append({tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set())
    ids = sorted(sets, key=lambda i: (i is not None, i))
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[:n]:
            if any(a and b and 100 * len(a & b) >= 80 * len(a | b) for a in sets[i] for b in sets[j]):
                a, b = find(i), find(j)
                root[max(a, b, key=ids.index)] = min(a, b, key=ids.index)
    return {i: find(i) for i in ids}


# ---- 8
def lines_left(docs: list[tuple]) -> list[tuple[int, str]]:
    """For each (id, text) the number of lines dropped and the text that stays."""
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    holders = defaultdict(set)
    for i, t in docs:
        for line in (t or "").split("\n"):
            holders[key(line)].add(-1 if i is None else i)
    gone = lambda i, line: len(key(line)) >= 40 and len(holders[key(line)]) >= 5 and (-1 if i is None else i) != max(holders[key(line)])
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        left = [x for x in lines if not gone(i, x)]
        out.append((len(lines) - len(left), "\n".join(left)))
    return out


# ---- 10
def toxic_marks(documents: list[set[str]], toxic: list[bool]) -> set[str]:
    share, every, bad = sum(toxic) / len(toxic), Counter(), Counter()
    for words, label in zip(documents, toxic, strict=True):
        own = {f for w in words for f in ["w" + w, *(f"{n}{w[:n]}" for n in range(3, 7) if len(w) >= n)] if w}
        every.update(own)
        bad.update(own if label else ())
    out = set()
    for f, k in bad.items():
        n = every[f]
        p = k / n
        if k >= 3 and 10 * k >= 9 * n and p > share:
            log = p * math.log(p / share) + ((1 - p) * math.log((1 - p) / (1 - share)) if p < 1 else 0)
            if -n * log < math.log(1e-6):
                out.add(f)
    return out


def toxic_marginals(model, text: str | None, edges: str, longest: int) -> list[float]:
    """Marginals token by token, chain by chain, by sums over the states of a chain from both ends."""
    out, chain = [], []
    t = [[1.0, math.exp(model.moves[0])], [math.exp(model.moves[1]), math.exp(model.moves[2])]]

    def closed():
        e = []
        for w in chain:
            word = w.strip(edges).lower()
            own = ["", "w" + word, *(f"{n}{word[:n]}" for n in range(3, 7) if len(word) >= n)]
            e.append(max(-30.0, min(30.0, sum(model.weights.get(f, 0.0) for f in own))) if word else -30.0)
        fore, last = [], [1.0, 0.0]
        for x in e:
            now = [sum(last[a] * t[a][b] for a in (0, 1)) * (math.exp(x) if b else 1.0) for b in (0, 1)]
            last = [v / sum(now) for v in now]
            fore.append(last)
        back, after = [], [1.0, 1.0]
        for x in reversed(e):
            back.append(after)
            now = [sum(t[a][b] * (math.exp(x) if b else 1.0) * after[b] for b in (0, 1)) for a in (0, 1)]
            after = [v / sum(now) for v in now]
        for f, b in zip(fore, reversed(back), strict=True):
            out.append(f[1] * b[1] / (f[0] * b[0] + f[1] * b[1]))
        chain.clear()

    for w in WORDS.findall(text or ""):
        chain.append(w)
        if w[-1] in ".!?" or len(chain) == longest:
            closed()
    if chain:
        closed()
    return out
