"""Document log-likelihood by a gated recurrent language model with a class-factored softmax.

Counts of all training tokens come from all training documents (one shuffle of per-task sums). The most
frequent words form the network's vocabulary; any other word is its unknown symbol times the word's
smoothed share among the words outside the vocabulary, so every text has a proper probability. Counts of
frequent words are sent to all tasks as a table of fixed size; rarer ones are joined by word.

The network (GRU) is trained by truncated backpropagation in numpy on all training documents, where they
lie: in each round every task trains on its share of them from the weights sent to all, and the weights are
averaged by the tokens they were trained on. One pass in ``ROUNDS`` rounds is made at every size. Documents are scored
side by side in lanes; the state is carried from window to window through the whole document.

Texts are read twice: once for the counts, once to be written as symbols of two bytes with all the counts say of a
document. Training and scoring read that table.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.llm.decontaminate import Lookup
from shelfspark.llm.registry import query, table
from shelfspark.llm.stats import fold
from shelfspark.llm.words import NONSPACE, chunks, words
from shelfspark.session import written

FOLDS, HELD = 10, 0
#: Words whose counts are sent to all tasks; all others are joined.
FREQUENT = 200_000
CLASSES, CLASS_WORDS = 32, 64
VOCABULARY = CLASSES * CLASS_WORDS
END, UNKNOWN = 0, 1
HIDDEN, EMBED = 16, 16
LANES, STEPS, RATE = 64, 16, 0.01
#: The pass over all training documents has so many rounds, each over another share of them.
ROUNDS = 4
#: Long text is laid out in more than ``LANES`` lanes, up to ``WIDE``, of at least so many tokens each.
WIDE, LANE_TOKENS = 512, 1024
#: Tokens a task lays out in lanes at a time; averaged weights are sums of whole numbers, so their order is of no effect.
TRAIN_TOKENS, FIXED = 1 << 19, 1 << 20
#: Weights travel in rows of so many.
WEIGHT_BLOCK = 4096
#: Parts by hash in which words of one count level are cut where not all of them are frequent.
CUTS = 1 << 14
SCORE_LANES, SCORE_STEPS, BLOCK_TOKENS = 512, 32, 2_000_000
SMOOTH = 0.1
FLUSH = 1_500_000


def token_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(h, c): occurrences of each word in all texts. Tasks add up before the shuffle."""

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged():
            h, c = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
            key, at = np.unique(h, return_inverse=True)
            return key, np.bincount(at, c, len(key)).astype(np.int64)

        def out(key, c):
            for a in range(0, len(key), 1 << 18):
                yield pa.RecordBatch.from_arrays([pa.array(key[a : a + (1 << 18)].view(np.int64)), pa.array(c[a : a + (1 << 18)])], ["h", "c"])

        size = 0
        for batch in batches:
            for part in chunks(batch, "t"):
                key, c = np.unique(words(part.column(0), NONSPACE).hash, return_counts=True)
                held.append((key, c))
                size += len(key)
                if size > FLUSH:
                    held = [merged()]
                    size = len(held[0][0])
                    if size > FLUSH // 2:
                        yield from out(*held[0])
                        held, size = [], 0
        if held:
            yield from out(*merged())

    found = docs.select(F.col(text).cast("string").alias("t")).mapInArrow(run, "h long, c long")
    return found.groupBy("h").agg(F.sum("c").alias("c"))


@dataclass
class Corpus:
    """Totals of the training tokens and the counts of the frequent words; ``symbol`` is a word's place in the network."""

    tokens: int
    distinct: int
    ends: int
    lookup: Lookup
    count: np.ndarray
    symbol: np.ndarray
    symbol_count: np.ndarray
    other_tokens: int
    other_distinct: int

    @staticmethod
    def of(counts: DataFrame, ends: int) -> Corpus:
        level = F.floor(F.log2("c") * 16).cast("int")
        levels = counts.groupBy(level.alias("level")).agg(F.count("*").alias("words"), F.sum("c").alias("c")).orderBy(F.desc("level")).collect()  # at most 1024 rows
        n, v = sum(r["c"] for r in levels), sum(r["words"] for r in levels)
        upto = np.cumsum([r["words"] for r in levels])
        whole = int(np.searchsorted(upto, FREQUENT, side="right"))  # levels that are frequent as a whole
        chosen = level >= (levels[whole - 1]["level"] if whole else 1 << 20)
        if whole < len(levels):
            # of the next level as many words as there is room for, by hash
            part = F.shiftrightunsigned("h", 50).cast("int")
            parts = counts.where(level == levels[whole]["level"]).groupBy(part.alias("part")).agg(F.count("*").alias("words")).orderBy("part").collect()  # CUTS rows
            room = FREQUENT - (int(upto[whole - 1]) if whole else 0)
            cut = int(np.searchsorted(np.cumsum([r["words"] for r in parts]), room, side="right"))
            chosen |= (level == levels[whole]["level"]) & (part < (parts[cut]["part"] if cut < len(parts) else CUTS))
        top = counts.where(chosen).toArrow()  # at most FREQUENT rows
        h, c = top.column("h").to_numpy().view(np.uint64), top.column("c").to_numpy()
        order = np.lexsort((h, -c))
        h, c = h[order], c[order]
        rank = np.where(np.arange(len(h)) < VOCABULARY - 2, np.arange(len(h)) + 2, UNKNOWN)
        by = np.argsort(h)
        inside = rank >= 2
        symbol_count = np.zeros(VOCABULARY, np.int64)
        symbol_count[rank[inside]] = c[inside]
        other = int(n - c[inside].sum())
        symbol_count[[END, UNKNOWN]] = ends, other
        return Corpus(int(n) + ends, int(v) + (ends > 0), ends, Lookup(h), c[by], rank[by].astype(np.int32), symbol_count, other, int(v - inside.sum()))

    def log_total(self) -> float:
        return float(np.log10(self.tokens + SMOOTH * (self.distinct + 1)))

    def log_other(self) -> float:
        return float(np.log10(self.other_tokens + SMOOTH * (self.other_distinct + 1)))


def _weighed(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``exp(z)`` in place and its sums over the rows; rows are shifted first where ``exp`` could leave the range of floats.

    Returns the shift of every row plus the log of its sum, and the sums.
    """
    shift = np.float32(0)
    if z.max() > 60 or z.min() < -60:
        shift = z.max(1)
        z -= shift[:, None]
    np.exp(z, out=z)
    s = z @ np.ones(z.shape[1], z.dtype)
    return shift + np.log(s), s


def _softmax_parts(z: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-probability of one place of each row, and the shares of all."""
    log = z[np.arange(len(z)), place]
    total, s = _weighed(z)
    z /= s[:, None]
    return log - total, z


class Network:
    """GRU over symbols; the output is the class of the next symbol times its place in the class."""

    def __init__(self, symbol_count: np.ndarray, seed: int = 5):
        rng = np.random.default_rng(seed)
        c = (symbol_count + 0.5).reshape(CLASS_WORDS, CLASSES).T  # frequent words spread over all classes
        self.p = {
            "embed": rng.normal(0, 0.1, (VOCABULARY, EMBED)),
            "x": rng.normal(0, 0.3, (EMBED, 3 * HIDDEN)),
            "h": rng.normal(0, 0.2, (HIDDEN, 3 * HIDDEN)),
            "b": np.zeros(3 * HIDDEN),
            "class": rng.normal(0, 0.05, (HIDDEN, CLASSES)),
            "class_b": np.log(c.sum(1) / c.sum()),
            "word": rng.normal(0, 0.05, (CLASSES, HIDDEN, CLASS_WORDS)),
            "word_b": np.log(c / c.sum(1, keepdims=True)),
        }
        self.p = {k: np.ascontiguousarray(v, np.float32) for k, v in self.p.items()}

    @staticmethod
    def of(p: dict[str, np.ndarray]) -> Network:
        net = Network.__new__(Network)
        net.p = p
        return net

    def gates(self) -> np.ndarray:
        return self.p["embed"] @ self.p["x"] + self.p["b"]

    def step(self, z: np.ndarray, h: np.ndarray):
        """Next state from the symbol's gate inputs ``z``; gates are update, reset, candidate."""
        w = self.p["h"]
        r = h @ w
        gate = 0.5 * np.tanh(0.5 * (z[:, : 2 * HIDDEN] + r[:, : 2 * HIDDEN])) + 0.5
        cand = np.tanh(z[:, 2 * HIDDEN :] + gate[:, HIDDEN:] * r[:, 2 * HIDDEN :])
        u = gate[:, :HIDDEN]
        return h + u * (cand - h), gate, cand, r

    def log_probability(self, states: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural log-probability of each target after its state; one product per class."""
        cls, place = target % CLASSES, target // CLASSES
        z = states @ self.p["class"]
        z += self.p["class_b"]
        out = z[np.arange(len(z)), cls]
        out -= _weighed(z)[0]
        order = np.argsort(cls, kind="stable")
        cut = np.searchsorted(cls[order], np.arange(CLASSES + 1))
        states, place, inner = states[order], place[order], np.empty(len(order), out.dtype)
        for k in range(CLASSES):
            own = slice(cut[k], cut[k + 1])
            if cut[k] < cut[k + 1]:
                z = states[own] @ self.p["word"][k]
                z += self.p["word_b"][k]
                one = z[np.arange(len(z)), place[own]]
                inner[own] = one - _weighed(z)[0]
        out[order] += inner
        return out

    def output_gradients(self, states: np.ndarray, target: np.ndarray, g: dict[str, np.ndarray]) -> tuple[float, np.ndarray]:
        """Loss of all targets; adds the gradients of the output and gives that of the states."""
        cls, place = target % CLASSES, target // CLASSES
        each = np.arange(len(target))
        log, share = _softmax_parts(states @ self.p["class"] + self.p["class_b"], cls)
        loss = -log.sum(dtype=np.float64)
        share[each, cls] -= 1
        g["class"], g["class_b"] = states.T @ share, share.sum(0)
        back = share @ self.p["class"].T
        g["word"], g["word_b"] = np.zeros_like(self.p["word"]), np.zeros_like(self.p["word_b"])
        order = np.argsort(cls, kind="stable")
        cut = np.searchsorted(cls[order], np.arange(CLASSES + 1))
        states, place, inner = states[order], place[order], np.zeros_like(back)
        for k in range(CLASSES):
            own = slice(cut[k], cut[k + 1])
            if cut[k] < cut[k + 1]:
                z = states[own] @ self.p["word"][k]
                z += self.p["word_b"][k]
                log, share = _softmax_parts(z, place[own])
                loss -= log.sum(dtype=np.float64)
                share[np.arange(len(share)), place[own]] -= 1
                g["word"][k], g["word_b"][k] = states[own].T @ share, np.ones(len(share), share.dtype) @ share
                np.matmul(share, self.p["word"][k].T, out=inner[own])
        back[order] += inner
        return float(loss), back

    def gradients(self, before: np.ndarray, target: np.ndarray, fresh: np.ndarray, h: np.ndarray, keep: np.ndarray | None = None) -> tuple[float, dict[str, np.ndarray], np.ndarray]:
        """Truncated backpropagation over one window (time, lane): mean loss, gradients and the state to carry on.

        Places outside ``keep`` (default: all count) are beyond the end of their lane.
        """
        steps, lanes = target.shape
        table_ = self.gates()
        kept, states, starts = [], np.empty((steps, lanes, HIDDEN), np.float32), np.empty((steps, lanes, HIDDEN), np.float32)
        for t in range(steps):
            start = np.where(fresh[t][:, None], np.float32(0), h)
            h, gate, cand, r = self.step(table_[before[t]], start)
            kept.append((gate, cand, r))
            starts[t], states[t] = start, h
        g: dict[str, np.ndarray] = {}
        own = np.flatnonzero(keep.ravel()) if keep is not None else slice(None)
        back = np.zeros((steps * lanes, HIDDEN), np.float32)
        loss, back[own] = self.output_gradients(states.reshape(-1, HIDDEN)[own], target.ravel()[own], g)
        back = back.reshape(steps, lanes, HIDDEN)
        z, rec = np.empty((steps, lanes, 3 * HIDDEN), np.float32), np.empty((steps, lanes, 3 * HIDDEN), np.float32)
        gh = np.zeros((lanes, HIDDEN), np.float32)
        for t in range(steps - 1, -1, -1):
            start, (gate, cand, r) = starts[t], kept[t]
            gh = gh + back[t]
            u, reset = gate[:, :HIDDEN], gate[:, HIDDEN:]
            gc = gh * u * (1 - cand * cand)
            gz, gr = z[t], rec[t]
            gz[:, :HIDDEN] = gh * (cand - start) * u * (1 - u)
            gz[:, HIDDEN : 2 * HIDDEN] = gc * r[:, 2 * HIDDEN :] * reset * (1 - reset)
            gz[:, 2 * HIDDEN :] = gc
            gr[:] = gz
            gr[:, 2 * HIDDEN :] *= reset
            gh = np.where(fresh[t][:, None], np.float32(0), gh * (1 - u) + gr @ self.p["h"].T)
        # one row of sums per symbol of the window
        used = before.ravel().astype(np.int16)
        order = np.argsort(used, kind="stable")
        used = used[order]
        at = np.flatnonzero(np.r_[True, used[1:] != used[:-1]])
        sums, used = np.add.reduceat(z.reshape(-1, 3 * HIDDEN)[order], at), used[at]
        g |= {"h": starts.reshape(-1, HIDDEN).T @ rec.reshape(-1, 3 * HIDDEN), "b": sums.sum(0), "x": self.p["embed"][used].T @ sums, "embed": np.zeros_like(self.p["embed"])}
        g["embed"][used] = sums @ self.p["x"].T
        n = steps * lanes if keep is None else len(own)
        return loss / n, {k: v / n for k, v in g.items()}, h

    def score(self, symbols: np.ndarray, ptr: np.ndarray) -> np.ndarray:
        """Natural log-probability of each text; ``ptr`` are the borders of the texts, each at least one symbol (its end)."""
        size = np.diff(ptr)
        lanes = min(SCORE_LANES, len(size))
        load = [(0, k) for k in range(lanes)]
        own: list[list[int]] = [[] for _ in range(lanes)]
        for d in np.argsort(-size, kind="stable").tolist():
            n, k = heapq.heappop(load)
            own[k].append(d)
            heapq.heappush(load, (n + int(size[d]), k))
        own.sort(key=lambda ds: -int(size[ds].sum()))
        order = np.concatenate([np.array(ds) for ds in own])
        n = size[order]
        at = np.repeat(ptr[order] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        target = symbols[at]
        border = np.r_[0, np.cumsum(n)]
        fresh = np.zeros(len(target), bool)
        fresh[border[:-1]] = True
        before = np.where(fresh, END, np.r_[END, target[:-1]])
        length = np.array([size[ds].sum() for ds in own])
        start = np.cumsum(length) - length
        table_ = self.gates()
        h = np.zeros((lanes, HIDDEN), np.float32)
        out = np.empty(len(target), np.float32)
        for a in range(0, int(length[0]), SCORE_STEPS):
            places, states = [], []
            for t in range(a, min(a + SCORE_STEPS, int(length[0]))):
                k = int(np.searchsorted(-length, -t, side="left"))  # lanes longer than t
                i = start[:k] + t
                h = h[:k]
                new = fresh[i]
                if new.any():
                    h = np.where(new[:, None], np.float32(0), h)
                h = self.step(table_[before[i]], h)[0]
                places.append(i)
                states.append(h)
            i = np.concatenate(places)
            out[i] = self.log_probability(np.concatenate(states), target[i])
        total = np.empty(len(size))
        total[order] = np.add.reduceat(out.astype(np.float64), border[:-1])
        return total


class Trainer:
    """Adam over windows of parallel lanes; a lane's state goes on from window to window."""

    def __init__(self, net: Network):
        self.net, self.count, self.tokens = net, 0, 0
        self.first = {k: np.zeros_like(v) for k, v in net.p.items()}
        self.second = {k: np.zeros_like(v) for k, v in net.p.items()}

    def fit(self, stream: np.ndarray, fresh: np.ndarray) -> float:
        """One pass over every symbol of whole texts, cut into lanes whose lengths differ by one at most; the mean loss."""
        if not len(stream):
            return 0.0
        lanes = min(max(LANES, min(WIDE, len(stream) // LANE_TOKENS)), len(stream))
        size = np.full(lanes, len(stream) // lanes)
        size[: len(stream) % lanes] += 1
        length, begin = int(size[0]), np.cumsum(size) - size
        keep = np.arange(length)[:, None] < size
        at = np.where(keep, begin + np.arange(length)[:, None], 0)
        target, new = stream[at], fresh[at]
        before = np.where(new, END, np.r_[END, stream[:-1]][at])
        h, sum_ = np.zeros((lanes, HIDDEN), np.float32), 0.0
        for a in range(0, length, STEPS):
            w = slice(a, a + STEPS)
            loss, g, h = self.net.gradients(before[w], target[w], new[w], h, None if keep[w].all() else keep[w])
            sum_ += loss * keep[w].sum()
            self._step(g)
        self.tokens += len(stream)
        return sum_ / len(stream)

    def _step(self, g: dict[str, np.ndarray]) -> None:
        self.count += 1
        rate, root = RATE / (1 - 0.9**self.count), 1 / np.sqrt(1 - 0.99**self.count)
        for k, v in g.items():
            first, second = self.first[k], self.second[k]
            first += np.float32(0.1) * (v - first)
            second += np.float32(0.01) * (v * v - second)
            self.net.p[k] -= np.float32(rate) * first / (np.sqrt(second) * np.float32(root) + np.float32(1e-5))


def symbols_of(texts: pa.Array, corpus: Corpus):
    """Symbols of all texts with their ends, borders, and per word: hash, count where frequent (else -1), symbol; words' borders."""
    w = words(texts, NONSPACE)
    at, key = corpus.lookup.find(w.hash)
    count = np.full(len(w.hash), -1, np.int64)
    symbol = np.full(len(w.hash), UNKNOWN, np.int32)
    count[at], symbol[at] = corpus.count[key], corpus.symbol[key]
    ptr = w.ptr + np.arange(len(w.ptr))
    all_ = np.full(int(ptr[-1]), END, np.int32)
    all_[np.arange(len(symbol)) + w.doc] = symbol
    return all_, ptr, w, count, symbol


def _trained(net):
    """Per task: the tokens it has read, all of its texts, and the weights after them, in rows of ``WEIGHT_BLOCK``."""

    def run(batches):
        own = Network.of({k: v.copy() for k, v in net.value.p.items()})
        trainer = Trainer(own)
        held, size = [], 0

        def fit():
            stream = np.concatenate(held)
            trainer.fit(stream, np.r_[True, stream[:-1] == END])

        for batch in batches:
            for text in _symbols(batch.column(0)):
                held.append(text)
                size += len(text)
                if size >= TRAIN_TOKENS:
                    fit()
                    held, size = [], 0
        if size:
            fit()
        if trainer.tokens:
            flat = np.concatenate([own.p[k].ravel() for k in sorted(own.p)]).astype(np.float64)
            fixed = np.rint(flat * FIXED).astype(np.int64) * trainer.tokens
            yield from _weight_rows({k: (trainer.tokens, fixed[a : a + WEIGHT_BLOCK] >> 24, fixed[a : a + WEIGHT_BLOCK] & 0xFFFFFF) for k, a in enumerate(range(0, len(fixed), WEIGHT_BLOCK))})

    return run


def _symbols(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(v.as_py(), np.int16).astype(np.int32) for v in column]


#: Sums of weights times tokens, in two parts so that no sum overflows.
WEIGHTS = "block int, n long, high array<long>, low array<long>"


def _weight_rows(sums: dict):
    if sums:
        keys = sorted(sums)
        kind = pa.list_(pa.int64())
        columns = [pa.array(keys, pa.int32()), pa.array([sums[k][0] for k in keys], pa.int64()), *(pa.array([sums[k][c] for k in keys], kind) for c in (1, 2))]
        yield pa.RecordBatch.from_arrays(columns, ["block", "n", "high", "low"])


def _added(batches):
    sums: dict = {}
    for batch in batches:
        for k, row in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
            high, low = (batch.column(c)[k].values.to_numpy() for c in (2, 3))
            n, a, b = sums.get(row[0], (0, 0, 0))
            sums[row[0]] = (n + row[1], a + high, b + low)
    yield from _weight_rows(sums)


def train(texts: DataFrame, corpus: Corpus) -> Network:
    """Network fitted on all of ``texts`` (round, symbols): one pass, in as many rounds at every size."""
    net = Network(corpus.symbol_count)
    for k in range(ROUNDS):
        model = texts.sparkSession.sparkContext.broadcast(net)
        found = texts.where(F.col("round") == k).select("symbols").mapInArrow(_trained(model), WEIGHTS)
        rows = found.repartition("block").mapInArrow(_added, WEIGHTS).collect()  # one row a block of weights
        model.destroy()
        if rows:
            rows.sort(key=lambda r: r["block"])
            flat = np.concatenate([(np.array(r["high"], np.float64) * (1 << 24) + np.array(r["low"], np.float64)) / (r["n"] * FIXED) for r in rows])
            border = np.cumsum([net.p[name].size for name in sorted(net.p)])[:-1]
            net = Network.of({name: v.reshape(net.p[name].shape).astype(np.float32) for name, v in zip(sorted(net.p), np.split(flat, border), strict=True)})
    return net


def _read(corpus, n_carry: int, names: list[str]):
    """Texts as symbols, with what the counts of frequent words say of them; rare words are left as hashes."""

    def run(batches):
        own = corpus.value
        log_count, log_end = np.log10(own.count + SMOOTH), np.log10(own.ends + SMOOTH)
        for batch in batches:
            for part in chunks(batch, "__text"):
                symbols, ptr, w, count, symbol = symbols_of(part.column(n_carry), own)
                n = len(w.ptr) - 1
                doc = w.doc
                frequent = count >= 0
                inside = symbol != UNKNOWN
                log = np.zeros(len(count))
                log[frequent] = log_count[own.lookup.find(w.hash[frequent])[1]]
                rare_doc, rare = doc[~frequent], w.hash[~frequent]
                by = np.lexsort((rare, rare_doc))
                rare_doc, rare = rare_doc[by], rare[by]
                new = np.r_[True, (rare_doc[1:] != rare_doc[:-1]) | (rare[1:] != rare[:-1])][: len(rare)]
                first = np.flatnonzero(new)
                times = np.diff(np.r_[first, len(rare)])
                rare_ptr = np.searchsorted(rare_doc[first], np.arange(n + 1))
                lists = [pa.ListArray.from_arrays(pa.array(rare_ptr, pa.int32()), v) for v in (pa.array(rare[first].view(np.int64)), pa.array(times, pa.int32()))]
                numbers = [w.counts + 1, np.bincount(doc[frequent], minlength=n) + (own.ends > 0), np.bincount(doc[~inside], minlength=n)]
                logs = [np.bincount(doc[inside], log[inside], n) + log_end, np.bincount(doc[frequent & ~inside], log[frequent & ~inside], n)]
                small = symbols.astype(np.int16)
                texts = pa.array([small[a:e].tobytes() for a, e in zip(ptr[:-1].tolist(), ptr[1:].tolist(), strict=True)], pa.binary())
                carried = [part.column(k) for k in range(n_carry)]
                arrays = [*carried, texts, *(pa.array(v, pa.int64()) for v in numbers), *(pa.array(v, pa.float64()) for v in logs), *lists]
                yield pa.RecordBatch.from_arrays(arrays, names)

    return run


READ = {
    "__symbols": T.BinaryType(),
    "__n": T.LongType(),
    "__known": T.LongType(),
    "__other": T.LongType(),
    "__inside": T.DoubleType(),
    "__frequent": T.DoubleType(),
    "__rare": T.ArrayType(T.LongType()),
    "__times": T.ArrayType(T.IntegerType()),
}


def as_symbols(docs: DataFrame, corpus, carry: list[str], text: str = "text") -> DataFrame:
    """The ``carry`` columns and :data:`READ` of every row, written once."""
    df = docs.select(*carry, F.col(text).cast("string").alias("__text"))
    schema = T.StructType([*df.schema.fields[:-1], *(T.StructField(n, k) for n, k in READ.items())])
    return written(df.mapInArrow(_read(corpus, len(carry), [*carry, *READ]), schema), "lm-symbols")


def _scored(net, names: list[str]):
    """The rows with the network's log-probability in place of the symbols, which come last."""

    def run(batches):
        def block(parts):
            rows = pa.Table.from_batches([p[0] for p in parts])
            texts = [t for p in parts for t in p[1]]
            found = net.value.score(np.concatenate(texts), np.r_[0, np.cumsum([len(t) for t in texts])]) / np.log(10)
            return pa.RecordBatch.from_arrays([*(rows.column(k).combine_chunks() for k in range(rows.num_columns - 1)), pa.array(found)], names)

        held, size = [], 0
        for batch in batches:
            last = batch.num_columns - 1
            upto = 0
            texts: list[np.ndarray] = []
            for k, text in enumerate(_symbols(batch.column(last))):
                texts.append(text)
                size += len(text)
                if size >= BLOCK_TOKENS:
                    held.append((batch.slice(upto, k + 1 - upto), texts))
                    yield block(held)
                    held, size, texts, upto = [], 0, [], k + 1
            if texts:
                held.append((batch.slice(upto), texts))
        if held:
            yield block(held)

    return run


def score_texts(docs: DataFrame, training: DataFrame | Column, key: str = "doc_id", text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The ``carry`` columns (default: the key), n_tokens, n_known, train_tokens, base_score and score of every row of ``docs``.

    ``training`` gives counts and the network: a frame with the same text column, or a condition on ``docs``, which are then
    read once for both. Null or empty text has one token, its end. Without training rows all counts are 0 and the scores are
    those of the smoothing alone. Repeated rows are scored each; texts of any length are read whole. Columns of ``docs`` that
    are not carried are ignored, whatever their names. Of words that share a count level at the border of the frequent ones,
    those of the lowest hashes are frequent.
    """
    spark = docs.sparkSession
    carry = carry or [key]
    shared = isinstance(training, Column)
    learned = docs.where(training) if shared else training
    counts = written(token_counts(learned, text), "token-counts")
    corpus = Corpus.of(counts, learned.count())
    sent = spark.sparkContext.broadcast(corpus)
    share = F.pmod(F.xxhash64(key, F.monotonically_increasing_id()), F.lit(ROUNDS)).cast("int")
    chosen = F.coalesce(training, F.lit(False)) if shared else F.lit(True)
    columns = lambda df, names: df.select(*names, F.when(chosen, share).alias("__round"), F.col(text).alias("__body"))
    texts = as_symbols(columns(docs, carry), sent, [*carry, "__round"], "__body") if shared else as_symbols(docs, sent, carry, text)
    lessons = texts if shared else as_symbols(columns(learned, []), sent, ["__round"], "__body")
    net = spark.sparkContext.broadcast(train(lessons.select(F.col("__round").alias("round"), F.col("__symbols").alias("symbols")), corpus))
    # the parts and row places of a written table are the same in every read
    rows = texts.withColumn("__row", F.monotonically_increasing_id())
    rare = rows.select("__row", F.explode(F.arrays_zip("__rare", "__times")).alias("r")).select("__row", F.col("r.__rare").alias("h"), F.col("r.__times").alias("times"))
    rare = rare.join(counts, "h", "left").select("__row", "times", F.coalesce("c", F.lit(0)).alias("c"))
    rare = rare.groupBy("__row").agg(F.sum(F.col("times") * F.log10(F.col("c") + SMOOTH)).alias("__log"), F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("__more"))
    kept = [*carry, "__row", "__n", "__known", "__other", "__inside", "__frequent"]
    narrow = rows.select(*kept, "__symbols")
    schema = T.StructType([*narrow.schema.fields[:-1], T.StructField("__net", T.DoubleType())])
    found = narrow.mapInArrow(_scored(net, [*kept, "__net"]), schema).join(rare, "__row", "left")
    log_rare = F.coalesce("__log", F.lit(0.0))
    return found.select(
        *carry,
        F.col("__n").alias("n_tokens"),
        (F.col("__known") + F.coalesce("__more", F.lit(0))).cast("long").alias("n_known"),
        F.lit(corpus.tokens).cast("long").alias("train_tokens"),
        (F.col("__inside") + F.col("__frequent") + log_rare - F.col("__n") * corpus.log_total()).alias("base_score"),
        (F.col("__net") + F.col("__frequent") + log_rare - F.col("__other") * corpus.log_other()).alias("score"),
    )


@query("op5_lm_score")
def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_texts(docs, fold("doc_id", FOLDS) != HELD)
    return scored.select("doc_id", (fold("doc_id", FOLDS) == HELD).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
