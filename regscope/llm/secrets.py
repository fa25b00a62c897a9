"""Secret scans: fixed patterns, and a character convolutional network in numpy over every candidate.

The patterns give the base findings, which always stay. Candidates are the base findings, all runs of eight or more
key-like characters, and every value after a colon or an equals sign, whatever its characters and length. Each is judged
with its context: characters become trained vectors, one convolution runs over them, the left context, the candidate and
the right context are max-pooled apart, and two dense layers give a score. Windows slide over candidates longer than the
body's width, by half of it; the highest score counts, in training too.

The network is trained on labelled findings. Base findings are positive (each once more in the left context of a negative,
so that the candidate itself counts), and a table of further labelled spans may be given. Negative are short words that are
no candidate, alone and run together; what the scan will judge is never labelled negative by rule. Findings are split by
their body before anything is copied, so scores are calibrated (Platt) on bodies that training has not seen, and the
threshold is the highest that still finds ``RECALL`` of the held-out positives: of all of them, whatever their number.
"""

from __future__ import annotations

import itertools
import re
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regscope.llm.common import share, shared, slices, stored

KINDS = ("assign", "access", "hex", "model")
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # the runs of 32 or more: runs do not overlap, shorter ones fail
RUN = re.compile(r"[A-Za-z0-9+/_=-]{8,}")
VALUE = re.compile(r"""(?<![:=])[:=]++>?[ \t]*+(?:"([^"\n]+)"|'([^'\n]+)'|["']?([^\s"']+))""")
INNER = re.compile(r"""(?<=[:=])[^\s:=&?;,"']+""")  # values within a value
SHORT = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9]{2,7}(?![A-Za-z0-9+/_=-])")
JOINTS = ("", "-", "_", "/")

LEFT, BODY, RIGHT = 24, 32, 8
WIDTH = LEFT + BODY + RIGHT
SIGNS = 72  # character classes: 0 padding, 1 other, then the printable ones by rule
FILTERS, SPAN, DIM, HIDDEN = 24, 5, 8, 16
FINDINGS = 3000  # of each label, for training
TAUGHT = 16  # windows of one finding, in training
WORDS = 12  # short words of one text, in training
PLAIN = 4  # one in so many texts without findings gives short words
STEP = BODY // 2
RECALL = 0.95
LEVELS = 10_000  # steps of the threshold

_CLASS = np.ones(128, np.uint8)
for _i, _c in enumerate("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_=-.:"):
    _CLASS[ord(_c)] = 2 + _i
_CLASS[ord(" ")] = 71


def assigns(text: str) -> bool:
    """Whether the text has a sign that both patterns of assignments need."""
    return ":" in text or "=" in text


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of base findings, leftmost and non-overlapping in each kind."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 8] if assigns(text) else []
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def judged(text: str, start: int, kind: int, end: int) -> tuple[int, int]:
    """The part of a base finding that the network sees: the value of an assignment."""
    return (ASSIGN.match(text, start).start(1) if kind == 0 else start), end


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Candidates that are not within a base finding, each once."""
    found = {m.span() for m in RUN.finditer(text)}
    for m in VALUE.finditer(text) if assigns(text) else ():
        a, b = m.span(m.lastindex)
        found.add((a, b))
        found.update(i.span() for i in INNER.finditer(text, a, b))
    if not base:
        return sorted(found)
    starts = [a for a, _, _ in base]
    upto = list(itertools.accumulate((b for _, _, b in base), max))
    return sorted((a, b) for a, b in found if not (k := bisect_right(starts, a)) or upto[k - 1] < b)


def window(text: str, start: int, end: int) -> bytes:
    """Character classes of a candidate and its context, each part padded to its width."""
    classes = lambda s: _CLASS[np.minimum(np.frombuffer(s.encode("utf-32-le"), np.uint32), 127)]
    out = np.zeros(WIDTH, np.uint8)
    left, body, right = classes(text[max(0, start - LEFT) : start]), classes(text[start : min(end, start + BODY)]), classes(text[end : end + RIGHT])
    out[LEFT - len(left) : LEFT] = left
    out[LEFT : LEFT + len(body)] = body
    out[LEFT + BODY : LEFT + BODY + len(right)] = right
    return out.tobytes()


def bag(text: str, start: int, end: int) -> bytes:
    """All windows of a candidate, for training: at most ``TAUGHT``, evenly spread."""
    at = range(start, start + STEP * pieces(end - start), STEP)
    if len(at) > TAUGHT:
        at = [at[k * (len(at) - 1) // (TAUGHT - 1)] for k in range(TAUGHT)]
    return b"".join(window(text, a, min(end, a + BODY)) for a in at)


def pieces(n: int | np.ndarray) -> int | np.ndarray:
    """How many windows slide over ``n`` characters."""
    return np.maximum(0, -(-(n - BODY) // STEP)) + 1


def encoded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Character classes of texts one after another with padding between them, and each text's place."""
    gap = np.zeros(WIDTH, np.uint8)
    parts, places, at = [gap], [], WIDTH
    for text in texts:
        own = _CLASS[np.minimum(np.frombuffer(text.encode("utf-32-le"), np.uint32), 127)]
        parts += [own, gap]
        places.append(at)
        at += len(own) + WIDTH
    return np.concatenate(parts), np.array(places, np.int64)


def windows_at(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The rows that :func:`window` gives, for candidates of at most ``BODY`` characters."""
    out = np.empty((len(start), WIDTH), np.uint8)
    out[:, :LEFT] = codes[start[:, None] + np.arange(-LEFT, 0)]
    body = start[:, None] + np.arange(BODY)
    out[:, LEFT : LEFT + BODY] = np.where(body < end[:, None], codes[np.minimum(body, len(codes) - 1)], 0)
    out[:, LEFT + BODY :] = codes[end[:, None] + np.arange(RIGHT)]
    return out


@dataclass
class Network:
    parts: dict[str, np.ndarray]
    scale: float = 1.0
    shift: float = 0.0
    threshold: float = 1.1  # above every score: adds nothing

    @classmethod
    def fresh(cls, seed: int = 5) -> Network:
        r = np.random.default_rng(seed)
        draw = lambda *s: r.normal(0, (2 / s[0]) ** 0.5, s)
        parts = {"e": r.normal(0, 0.5, (SIGNS, DIM)), "c": draw(SPAN * DIM, FILTERS), "cb": np.zeros(FILTERS), "h": draw(3 * FILTERS, HIDDEN), "hb": np.zeros(HIDDEN), "o": draw(HIDDEN, 1), "ob": np.zeros(1)}
        return cls(parts)

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, tuple]:
        p = self.parts
        v = p["e"][x]
        v = np.lib.stride_tricks.sliding_window_view(np.pad(v, ((0, 0), (SPAN // 2, SPAN // 2), (0, 0))), SPAN, axis=1)
        v = v.transpose(0, 1, 3, 2).reshape(len(x), WIDTH, SPAN * DIM)
        a = np.maximum(0, v @ p["c"] + p["cb"])
        bounds = ((0, LEFT), (LEFT, LEFT + BODY), (LEFT + BODY, WIDTH))
        top = np.stack([a[:, i:j].argmax(axis=1) + i for i, j in bounds], axis=1)
        pooled = np.take_along_axis(a, top, axis=1).reshape(len(x), -1)
        hidden = np.maximum(0, pooled @ p["h"] + p["hb"])
        return (hidden @ p["o"] + p["ob"])[:, 0], (x, v, top, pooled, hidden)

    def gradients(self, slope: np.ndarray, state: tuple) -> dict[str, np.ndarray]:
        p = self.parts
        x, v, top, pooled, hidden = state
        n = len(x)
        g = {"o": hidden.T @ slope[:, None], "ob": slope.sum(keepdims=True)}
        back = (slope[:, None] @ p["o"].T) * (hidden > 0)
        g |= {"h": pooled.T @ back, "hb": back.sum(axis=0)}
        back = ((back @ p["h"].T) * (pooled > 0)).reshape(n, 3, FILTERS)
        full = np.zeros((n, WIDTH, FILTERS))
        rows = np.arange(n)[:, None, None]
        np.add.at(full, (rows, top, np.arange(FILTERS)[None, None, :]), back)
        g |= {"c": v.reshape(-1, SPAN * DIM).T @ full.reshape(-1, FILTERS), "cb": full.sum(axis=(0, 1))}
        dv = (full @ p["c"].T).reshape(n, WIDTH, SPAN, DIM)
        de = np.zeros((n, WIDTH + SPAN - 1, DIM))
        for k in range(SPAN):
            de[:, k : k + WIDTH] += dv[:, :, k]
        g["e"] = np.zeros_like(p["e"])
        np.add.at(g["e"], x, de[:, SPAN // 2 : SPAN // 2 + WIDTH])
        return g

    def outputs(self, x: np.ndarray) -> np.ndarray:
        """What :func:`forward` gives, from sums of tables of character pairs instead of products."""
        p = self.parts
        e = np.concatenate((p["e"], np.zeros((1, DIM))))  # the last stands for what is outside the window
        each = np.stack([e @ p["c"][k * DIM : (k + 1) * DIM] for k in range(SPAN)])
        pair = lambda i: (each[i][:, None] + each[i + 1][None]).reshape(-1, FILTERS).astype(np.float32)
        first, second, last = pair(0), pair(2), each[4].astype(np.float32)
        out = np.empty(len(x))
        for k in range(0, len(x), 512):
            c = np.pad(x[k : k + 512].astype(np.int32), ((0, 0), (SPAN // 2, SPAN // 2)), constant_values=SIGNS)
            a = first.take(c[:, :WIDTH] * (SIGNS + 1) + c[:, 1 : WIDTH + 1], axis=0)
            a += second.take(c[:, 2 : WIDTH + 2] * (SIGNS + 1) + c[:, 3 : WIDTH + 3], axis=0)
            a += last.take(c[:, 4:], axis=0)
            top = np.stack([a[:, i:j].max(axis=1) for i, j in ((0, LEFT), (LEFT, LEFT + BODY), (LEFT + BODY, WIDTH))], axis=1)
            pooled = np.maximum(0, top.astype(np.float64) + p["cb"]).reshape(len(c), -1)
            out[k : k + 512] = (np.maximum(0, pooled @ p["h"] + p["hb"]) @ p["o"] + p["ob"])[:, 0]
        return out

    def chances(self, out: np.ndarray) -> np.ndarray:
        """Calibrated scores from 0 to 1, rounded so that they do not depend on how rows are batched."""
        return np.round(1 / (1 + np.exp(-np.clip(self.scale * out + self.shift, -30, 30))), 6)

    def score(self, windows: list[bytes]) -> np.ndarray:
        if not windows:
            return np.zeros(0)
        return self.chances(self.outputs(np.frombuffer(b"".join(windows), np.uint8).reshape(-1, WIDTH)))

    def judge(self, codes: np.ndarray, start: np.ndarray, end: np.ndarray, rows: int = 16_384) -> np.ndarray:
        """The highest score of the windows that slide over each candidate."""
        n = pieces(end - start)
        upto = np.cumsum(n)
        best = np.zeros(len(start))
        for k in range(0, int(n.sum()), rows):
            row = np.arange(k, min(k + rows, int(upto[-1])))
            own = np.searchsorted(upto, row, side="right")
            at = start[own] + STEP * (row - upto[own] + n[own])
            score = self.chances(self.outputs(windows_at(codes, at, np.minimum(end[own], at + BODY))))
            np.maximum.at(best, own, score)
        return best


def highest(out: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The place of the highest output of each finding."""
    order = np.lexsort((out, np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))))
    return order[bounds[1:] - 1]


def learns(windows: np.ndarray) -> bool:
    """Whether a finding is on the learning side of the split, by its body."""
    return zlib.crc32(windows[:, LEFT : LEFT + BODY].tobytes()) % 10 < 7


def bare(windows: np.ndarray, other: np.ndarray) -> np.ndarray:
    """A finding's windows in the left context of another finding."""
    out = windows.copy()
    for n in range(min(len(out), -(-LEFT // STEP))):
        out[n, : LEFT - n * STEP] = other[0, n * STEP : LEFT]
    return out


def fit(windows: list[bytes], labels: list[int], steps: int = 400, batch: int = 128, seed: int = 5) -> Network:
    """A trained, calibrated network; one that adds nothing where findings of either label are too few (below 20, or 4
    on either side of the split).

    Each element of ``windows`` holds the windows of one finding; the one with the highest output learns.
    """
    net = Network.fresh(seed)
    y = np.array(labels, float)
    if min((y > 0).sum(), (y == 0).sum()) < 20:
        return net
    bags = [np.frombuffer(w, np.uint8).reshape(-1, WIDTH) for w in windows]
    r = np.random.default_rng(seed)
    seen = np.array([learns(b) for b in bags])
    parts = [np.flatnonzero(seen), np.flatnonzero(~seen)]
    for k, own in enumerate(parts):
        positive, negative = own[y[own] > 0], own[y[own] == 0]
        if min(len(positive), len(negative)) < 4:
            return net
        # positives once more in the left context of a negative
        bags += [bare(bags[i], bags[j]) for i, j in zip(positive, r.choice(negative, len(positive)), strict=True)]
        parts[k] = np.concatenate((own, np.arange(len(y), len(bags))))
        y = np.concatenate((y, np.ones(len(positive))))
    learn, held = parts

    def of(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([bags[i] for i in own]), np.cumsum([0] + [len(bags[i]) for i in own])

    sides = [learn[y[learn] > 0], learn[y[learn] == 0]]
    first = {k: np.zeros_like(v) for k, v in net.parts.items()}
    second = {k: np.zeros_like(v) for k, v in net.parts.items()}
    for t in range(1, steps + 1):
        own = np.concatenate([r.choice(s, batch // 2) for s in sides])
        x, bounds = of(own)
        out, state = net.forward(x)
        top = highest(out, bounds)
        slope = np.zeros(len(x))
        slope[top] = (1 / (1 + np.exp(-np.clip(out[top], -30, 30))) - y[own]) / len(own)
        for k, g in net.gradients(slope, state).items():
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            net.parts[k] -= 0.003 * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
    x, bounds = of(held)
    out = net.outputs(x)
    out = out[highest(out, bounds)]
    net.scale, net.shift = platt(out, y[held])
    good = np.sort(net.chances(out[y[held] > 0]))
    net.threshold = float(good[int((1 - RECALL) * len(good))]) if len(good) else 1.1
    return net


def platt(out: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and offset of a logistic curve from raw scores to chances, with Platt's smoothed targets."""
    n1, n0 = y.sum(), len(y) - y.sum()
    goal = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    w, z = np.zeros(2), np.stack((out, np.ones(len(out))), axis=1)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        bend = (z * (p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(2)
        step = np.linalg.solve(bend, z.T @ (p - goal) + 1e-3 * w)
        w -= step * min(1.0, 2.0 / max(1e-12, np.abs(step).max()))
    return max(1e-3, float(w[0])), float(w[1])


def labelled(text: str) -> dict[bytes, int]:
    """Windows of a text's labelled findings: its base findings, and up to ``WORDS`` short words that are no candidates.

    Texts without findings are so many that one in ``PLAIN`` (by a hash of the text) is enough to give words."""
    base = base_spans(text)
    mark = zlib.crc32(text.encode())
    if not base and mark % PLAIN:
        return {}
    judge = sorted(candidates(text, base) + [(a, b) for a, _, b in base])
    starts = [a for a, _ in judge]
    upto = list(itertools.accumulate((b for _, b in judge), max))
    free = lambda m: not (k := bisect_right(starts, m.end() - 1)) or upto[k - 1] <= m.start()
    seen: dict[bytes, int] = {}
    words = list(itertools.islice(filter(free, SHORT.finditer(text, mark % max(1, len(text)))), WORDS))
    for m in words[:4]:
        seen[bag(text, m.start(), m.end())] = 0
    for k in range(0, len(words) - 1, 4):
        own = words[k : k + 2 + mark % 3]
        run = JOINTS[(mark + k // 4) % len(JOINTS)].join(m[0] for m in own)
        before, after = text[max(0, own[0].start() - LEFT) : own[0].start()], text[own[-1].end() : own[-1].end() + RIGHT]
        seen[bag(before + run + after, len(before), len(before) + len(run))] = 0
    for a, kind, b in base:
        seen[bag(text, *judged(text, a, kind, b))] = 1
    return seen


def train(docs: DataFrame, labelled_spans: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", findings: int = FINDINGS) -> Network:
    """Train on at most ``findings`` labelled findings of each label, those with the least hash of all findings; the threshold
    comes from all held-out positives.

    ``labelled_spans`` (``doc_id, start, end, secret``; code points, end exclusive) adds findings of any shape; where it
    and the rules differ, secret counts. Null, empty and out-of-range spans are ignored. Without texts, or with too few
    findings, the network adds nothing to the base findings.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            seen: dict[bytes, int] = {}
            for text in batch.column("text").to_pylist():
                for w, y in labelled(text).items() if text else ():
                    seen[w] = max(y, seen.get(w, 0))
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int32())], ["w", "y"])

    def given(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = zip(*(batch.column(c).to_pylist() for c in ("text", "start", "end", "y")), strict=True)
            seen = [(bag(t, a, b), y) for t, a, b, y in rows if 0 <= a < b <= len(t)]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in seen], pa.binary()), pa.array([y for _, y in seen], pa.int32())], ["w", "y"])

    found = docs.select(F.col(text_col).alias("text")).mapInArrow(work, "w binary, y int")
    if labelled_spans is not None:
        spans = labelled_spans.select(F.col("doc_id").alias("at"), "start", "end", F.col("secret").cast("int").alias("y")).dropna()
        texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(spans, F.col("id") == F.col("at"))
        found = found.unionByName(texts.where("text IS NOT NULL").select("text", "start", "end", "y").mapInArrow(given, "w binary, y int"))
    found = stored(found.groupBy("w").agg(F.max("y").alias("y")))
    # counts of hash ranges tell below which hash the least findings lie; only those are sorted
    place = F.shiftright(F.xxhash64("w"), 48)
    sizes = found.groupBy("y", place.alias("range")).agg(F.count(F.lit(1)).alias("n")).orderBy("range").collect()  # at most 2 x 65,536
    upto = {y: np.cumsum([r["n"] for r in sizes if r["y"] == y]) for y in (0, 1)}
    last = {y: [r["range"] for r in sizes if r["y"] == y][: int(np.searchsorted(upto[y], findings)) + 1][-1:] or [0] for y in (0, 1)}
    least = lambda y: found.where((F.col("y") == y) & (place <= last[y][0])).orderBy(F.xxhash64("w"), "w").limit(findings)
    rows = least(0).unionByName(least(1)).collect()  # bounded by 2 x findings
    rows.sort(key=lambda r: (r["y"], bytes(r["w"])))
    net = fit([bytes(r["w"]) for r in rows], [r["y"] for r in rows])
    contexts = [w for r in rows if not r["y"] and not learns(np.frombuffer(w := bytes(r["w"]), np.uint8).reshape(-1, WIDTH))]
    if net.threshold <= 1 and upto[1][-1] > findings:  # the fit has not seen all held-out positives
        net.threshold = held_threshold(found.where("y = 1"), net, contexts)
    return net


def held_threshold(positives: DataFrame, net: Network, contexts: list[bytes]) -> float:
    """The highest threshold, in steps of 1/``LEVELS``, that finds ``RECALL`` of all held-out ``positives`` (``w``), each as it stands and once more in
    the left context of one of ``contexts``. Tasks count scores by level."""
    held = share(positives, (net, contexts))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, contexts = shared(held)
        others = [np.frombuffer(w, np.uint8).reshape(-1, WIDTH) for w in contexts]
        for batch in slices(batches, "w"):
            bags = [np.frombuffer(w, np.uint8).reshape(-1, WIDTH) for w in batch.column("w").to_pylist()]
            bags = [b for b in bags if not learns(b)]
            if not bags:
                continue
            bags += [bare(b, others[zlib.crc32(b.tobytes()) % len(others)]) for b in bags]
            out = net.outputs(np.concatenate(bags))
            score = net.chances(out[highest(out, np.cumsum([0] + [len(b) for b in bags]))])
            level, n = np.unique(np.rint(score * 1e6).astype(np.int64) * LEVELS // 10**6, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(level), pa.array(n.astype(np.int64))], ["level", "n"])

    rows = positives.select("w").mapInArrow(work, "level long, n long").groupBy("level").agg(F.sum("n").alias("n")).orderBy("level").collect()  # at most LEVELS + 1
    upto = np.cumsum([r["n"] for r in rows])
    return rows[int(np.searchsorted(upto, int((1 - RECALL) * upto[-1]), side="right"))]["level"] / LEVELS if rows else 1.1


def scan(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, spans``: all findings of each row's whole text as an array of (start, end, kind, score).

    Offsets count code points, ends are exclusive, order is by start and then kind (assign, access, hex, model). Base
    findings stay whatever their score; further candidates need the threshold, and their spans may overlap. Null and empty
    texts have no spans. Repeated rows are scanned each; other columns are ignored. Texts of any length are scanned whole;
    an empty table gives no rows. Identifiers may be of any type.
    """
    held = share(docs, net)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared(held)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("score", pa.float64())]))
        for batch in slices(batches, "text"):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            codes, places = encoded(texts)
            owners, starts, ends, kinds, lefts = (array("q") for _ in range(5))
            for i, text in enumerate(texts):
                base = base_spans(text)
                own = [(*judged(text, a, k, b), k, a) for a, k, b in base] + [(a, b, 3, a) for a, b in candidates(text, base)]
                for a, b, k, left in own:
                    owners.append(i)
                    starts.append(a)
                    ends.append(b)
                    kinds.append(k)
                    lefts.append(left)
            place = places[np.array(owners, np.int64)]
            scores = net.judge(codes, np.array(starts, np.int64) + place, np.array(ends, np.int64) + place)
            found: list[list[tuple]] = [[] for _ in texts]
            for j in np.flatnonzero((np.array(kinds) < 3) | (scores >= net.threshold)):
                found[owners[j]].append((lefts[j], kinds[j], ends[j], float(scores[j])))
            spans = [[{"start": a, "end": b, "kind": KINDS[k], "score": s} for a, k, b, s in sorted(own)] for own in found]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, kind)], ["doc_id", "spans"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(work, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, spans array<struct<start:long,end:long,kind:string,score:double>>")
