"""Personal data by fixed rules and a character BiLSTM with CRF transitions that adds to them.

The rules give the base spans, which always stay. The network reads windows of ``WINDOW`` characters that
overlap by half; every window is decoded (Viterbi), each character takes the tag of the window in whose middle
it lies, and spans are read from the stitched tags of the whole text, so a border never cuts one. Found spans must
hold what their kind demands (``plausible``) and touch no base span. That is a digit, an ``@`` or an ``(at)``, with
what may belong to it on both sides (``reaches``); cells of the grid outside of that, and not beside it, can hold
no span and are not computed.

The network is trained in numpy on windows of a bounded sample whose labels are the rules' spans, plain and
rewritten (other separators, spelled signs), so that it learns the form and its surroundings.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.llm.registry import query, table
from shelfspark.llm.stats import bounded
from shelfspark.llm.words import chunks

KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: The look-behind starts at the first digit of a run, where the leftmost match must start anyway.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_SIGN = re.compile(r"[0-9@]")
_DIGIT = re.compile(r"[0-9]")
#: Signs of which every plausible span holds one, how an address goes on behind one, and digits with the points of an ip.
GATE = r"[0-9@]|[(\[]at[)\]]"
_GATE = re.compile(GATE)
_AT = re.compile(r"@|[(\[]at[)\]]")
_HOST = re.compile(r"\s*[\w-]+(?:\s*(?:\.|[(\[]dot[)\]])\s*[\w-]+)*")
_POINTS = re.compile(r"[0-9]+(?:\s*\[?\.\]?\s*[0-9]+)+")

WINDOW, CELL, CONTEXT = 64, 32, 16
ALPHABET, EMBED, HIDDEN = 256, 8, 12
TAGS = 1 + 2 * len(KINDS)
#: Documents and windows the network is trained on, at most.
SAMPLE_DOCS, SAMPLE_WINDOWS = 600, 1536
EPOCHS, BATCH, RATE = 12, 96, 0.02
#: Small samples are passed through more often, up to so many steps.
LEAST_STEPS = 240


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2])
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def _emails(text: str):
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            yield "email", start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed rules, by start and then kind; failing matches are dropped and not retried."""
    if not _SIGN.search(text):
        return []
    out = list(_emails(text))
    for m in _IP.finditer(text):
        if all(len(p := x.lstrip("0")) < 3 or (len(p) == 3 and int(p) <= 255) for x in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_DIGIT.findall(m[0])) <= 15:
            out.append(("phone", m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def codes(text: str) -> np.ndarray:
    """Input symbols of the characters: ASCII as it is, all others in 127 classes; 0 lies beyond the text."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return np.where(c < 128, np.maximum(c, 1), 128 + c % 127).astype(np.int16)


def reaches(text: str) -> list[tuple[int, int]]:
    """Borders of all that can be one plausible span with a sign of it, as far as the sign's own cell may not cover it."""
    out, end = [], 0
    for m in _AT.finditer(text):
        start = m.start()
        while start > end and text[start - 1].isspace():
            start -= 1
        while start > end and not text[start - 1].isspace():
            start -= 1
        host = _HOST.match(text, m.end())
        out.append((start, host.end() if host else m.end()))
        end = m.end()
    return out + [m.span() for m in _POINTS.finditer(text) if m.end() - m.start() > CELL]


def cells(code: np.ndarray, reach: list[tuple[int, int]] | None = None) -> np.ndarray:
    """Grid cells that hold a digit or ``@`` or part of a reach, and their neighbours."""
    at = np.flatnonzero(((code >= 48) & (code <= 57)) | (code == 64)) // CELL
    at = np.unique(np.concatenate([at, *(np.arange(s // CELL, (e - 1) // CELL + 1) for s, e in reach or [])]))
    at = np.unique(np.concatenate([at - 1, at, at + 1]))
    return at[(at >= 0) & (at * CELL < len(code))]


def windows(code: np.ndarray, cell: np.ndarray) -> np.ndarray:
    """One row of ``WINDOW`` symbols per cell, the cell in its middle."""
    wide = np.zeros(CONTEXT + len(code) + WINDOW, np.int16)
    wide[CONTEXT : CONTEXT + len(code)] = code
    return wide[cell[:, None] * CELL + np.arange(WINDOW)[None, :]]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _allowed() -> np.ndarray:
    """0 where a tag may follow another, else a large negative number. Tag 0: outside; 1 + 2k begins kind k, 2 + 2k goes on."""
    out = np.zeros((TAGS, TAGS), np.float32)
    for k in range(len(KINDS)):
        inside = 2 + 2 * k
        out[:, inside] = -1e4
        out[[inside - 1, inside], inside] = 0
    return out


ALLOWED = _allowed()
START = np.where((np.arange(TAGS) > 0) & (np.arange(TAGS) % 2 == 0), -1e4, 0).astype(np.float32)


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


@dataclass
class Tagger:
    """Parameters of the network by name."""

    p: dict[str, np.ndarray]

    @staticmethod
    def new(seed: int = 7) -> Tagger:
        rng = np.random.default_rng(seed)
        p = {"embed": rng.normal(0, 0.3, (ALPHABET, EMBED)), "out": rng.normal(0, 0.2, (2 * HIDDEN, TAGS)), "bias": np.zeros(TAGS), "move": np.zeros((TAGS, TAGS))}
        for d in "fb":
            p[f"x{d}"] = rng.normal(0, 0.3, (EMBED, 4 * HIDDEN))
            p[f"h{d}"] = rng.normal(0, 0.3, (HIDDEN, 4 * HIDDEN))
            p[f"c{d}"] = np.r_[np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)]
        return Tagger({k: v.astype(np.float32) for k, v in p.items()})

    def _run(self, code: np.ndarray, d: str, keep: bool = False):
        """Hidden states (time first) of one direction; gates in the order input, forget, output, candidate."""
        table_ = self.p["embed"] @ self.p[f"x{d}"] + self.p[f"c{d}"]
        n, steps = code.shape
        h = c = np.zeros((n, HIDDEN), np.float32)
        out = np.empty((steps, n, HIDDEN), np.float32)
        kept = []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = table_[code[:, t]] + h @ self.p[f"h{d}"]
            gate, g = _sigmoid(z[:, : 3 * HIDDEN]), np.tanh(z[:, 3 * HIDDEN :])
            before, h_before = c, h
            c = gate[:, HIDDEN : 2 * HIDDEN] * c + gate[:, :HIDDEN] * g
            tc = np.tanh(c)
            h = gate[:, 2 * HIDDEN :] * tc
            out[t] = h
            if keep:
                kept.append((t, gate, g, before, tc, h_before))
        return out, kept

    def emissions(self, code: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._run(code, "f")[0], self._run(code, "b")[0]], 2)
        return both @ self.p["out"] + self.p["bias"]

    def decode(self, code: np.ndarray) -> np.ndarray:
        """Best tag path of each window."""
        e, move = self.emissions(code), self.p["move"] + ALLOWED
        steps, n, _ = e.shape
        back = np.empty((steps, n, TAGS), np.int8)
        score = e[0] + START
        for t in range(1, steps):
            all_ = score[:, :, None] + move[None]
            back[t] = all_.argmax(1)
            score = all_.max(1) + e[t]
        path = np.empty((n, steps), np.int8)
        path[:, -1] = score.argmax(1)
        each = np.arange(n)
        for t in range(steps - 1, 0, -1):
            path[:, t - 1] = back[t][each, path[:, t]]
        return path

    def gradients(self, code: np.ndarray, tag: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of the tag paths and its gradient."""
        p = self.p
        n, steps = code.shape
        runs = {d: self._run(code, d, True) for d in "fb"}
        both = np.concatenate([runs["f"][0], runs["b"][0]], 2)
        e = both @ p["out"] + p["bias"]
        move = p["move"] + ALLOWED
        alpha = np.empty_like(e)
        alpha[0] = e[0] + START
        for t in range(1, steps):
            alpha[t] = _logsumexp(alpha[t - 1][:, :, None] + move[None], 1) + e[t]
        total = _logsumexp(alpha[-1], 1)
        beta = np.zeros_like(e)
        g_move = np.zeros((TAGS, TAGS), np.float32)
        for t in range(steps - 1, 0, -1):
            ahead = (e[t] + beta[t])[:, None, :] + move[None]
            g_move += np.exp(alpha[t - 1][:, :, None] + ahead - total[:, None, None]).sum(0)
            beta[t - 1] = _logsumexp(ahead, 2)
        ge = np.exp(alpha + beta - total[None, :, None])
        each = np.arange(n)
        gold = (START[tag[:, 0]] + e[0, each, tag[:, 0]]).astype(np.float64)
        ge[0, each, tag[:, 0]] -= 1
        for t in range(1, steps):
            gold += e[t, each, tag[:, t]] + move[tag[:, t - 1], tag[:, t]]
            ge[t, each, tag[:, t]] -= 1
            np.subtract.at(g_move, (tag[:, t - 1], tag[:, t]), 1)
        ge /= n
        g = {"move": g_move / n, "out": both.reshape(-1, 2 * HIDDEN).T @ ge.reshape(-1, TAGS), "bias": ge.sum((0, 1)), "embed": np.zeros_like(p["embed"])}
        gh_all = ge @ p["out"].T
        for d, part in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, 2 * HIDDEN))):
            g_table = np.zeros((ALPHABET, 4 * HIDDEN), np.float32)
            g_h = np.zeros_like(p[f"h{d}"])
            gh = gc = np.zeros((n, HIDDEN), np.float32)
            for t, gate, cand, before, tc, h_before in reversed(runs[d][1]):
                gh = gh + gh_all[t][:, part]
                i, f, o = gate[:, :HIDDEN], gate[:, HIDDEN : 2 * HIDDEN], gate[:, 2 * HIDDEN :]
                gc = gc + gh * o * (1 - tc * tc)
                gz = np.concatenate([gc * cand * i * (1 - i), gc * before * f * (1 - f), gh * tc * o * (1 - o), gc * i * (1 - cand * cand)], 1)
                np.add.at(g_table, code[:, t], gz)
                g_h += h_before.T @ gz
                gh, gc = gz @ p[f"h{d}"].T, gc * f
            g[f"h{d}"], g[f"c{d}"], g[f"x{d}"] = g_h, g_table.sum(0), p["embed"].T @ g_table
            g["embed"] += g_table @ p[f"x{d}"].T
        return float((total - gold).mean()), g

    def fit(self, code: np.ndarray, tag: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> list[float]:
        """Adam over shuffled batches; gives the loss of each epoch."""
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        losses, step = [], 0
        least = -(-LEAST_STEPS // max(1, -(-len(code) // BATCH)))
        for _ in range(max(epochs, least) if len(code) else 0):
            order, sum_ = rng.permutation(len(code)), 0.0
            for k in range(0, len(order), BATCH):
                own = order[k : k + BATCH]
                loss, g = self.gradients(code[own], tag[own])
                sum_ += loss * len(own)
                step += 1
                for name, value in g.items():
                    value = np.clip(value, -1, 1)
                    first[name] = 0.9 * first[name] + 0.1 * value
                    second[name] = 0.98 * second[name] + 0.02 * value**2
                    self.p[name] = (self.p[name] - RATE * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.98**step)) + 1e-6)).astype(np.float32)
            losses.append(sum_ / len(order))
        return losses


def stitched(tagger: Tagger, text: str, code: np.ndarray, cell: np.ndarray, path: np.ndarray) -> list[tuple[str, int, int]]:
    """Spans of the whole text from the middles of its decoded windows."""
    tag = np.zeros(len(code) + CELL, np.int8)
    for c, line in zip(cell.tolist(), path, strict=True):
        tag[c * CELL : (c + 1) * CELL] = line[CONTEXT : CONTEXT + CELL]
    tag = tag[: len(code)]
    kind = np.where(tag > 0, (tag + 1) // 2, 0)
    begins = (kind > 0) & ((np.r_[0, kind[:-1]] != kind) | (tag % 2 == 1))
    # a begin at a cell's border just after the same kind goes on: the window before has seen the true begin
    start = np.flatnonzero(begins)
    start = start[(start % CELL != 0) | (np.r_[0, kind][start] != kind[start])]
    ends = np.flatnonzero((kind > 0) & (np.r_[kind[1:], 0] != kind)) + 1
    stops = np.unique(np.concatenate([start, ends]))
    return [(KINDS[kind[s] - 1], s, int(stops[np.searchsorted(stops, s, side="right")])) for s in start.tolist()]


_PARTS = re.compile(r"[0-9]+")


def plausible(kind: str, text: str) -> bool:
    """Whether a found span holds what its kind demands."""
    digits = "".join(_DIGIT.findall(text))
    if kind == "email":
        name, sign, host = re.split(r"\s*(@|[(\[]at[)\]])\s*", text, maxsplit=1) if re.search(r"@|[(\[]at[)\]]", text) else ("", "", "")
        return bool(sign) and bool(re.fullmatch(r"\S+", name)) and bool(re.fullmatch(r"[\w-]+(?:\s*(?:\.|[(\[]dot[)\]])\s*[\w-]+)+", host))
    if kind == "ip":
        parts = re.split(r"\s*\[?\.\]?\s*", text)
        return len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits) and bool(re.fullmatch(r"[0-9]+(?:[ ./_-]{1,2}[0-9]+)*", text))
    return 9 <= len(digits) <= 15 and bool(re.fullmatch(r"\(?[0-9]+\)?(?:[ ./()-]{1,2}[0-9]+\)?){2,}", text))


def all_spans(tagger: Tagger, texts: list[str]) -> list[list[tuple[str, int, int, bool]]]:
    """Base spans (True) and added ones (False) of each text, by start and kind. Windows of all texts are decoded together."""
    out = [[(*s, True) for s in base_spans(t)] for t in texts]
    picked = []
    for k, t in enumerate(texts):
        if _GATE.search(t):
            code = codes(t)
            picked.append((k, code, cells(code, reaches(t))))
    for a in range(0, len(picked), 256):
        group = picked[a : a + 256]
        rows = np.concatenate([windows(code, cell) for _, code, cell in group])
        path = np.concatenate([tagger.decode(rows[b : b + 2048]) for b in range(0, len(rows), 2048)])
        at = 0
        for k, code, cell in group:
            own = path[at : at + len(cell)]
            at += len(cell)
            if not own.any():
                continue
            taken = np.zeros(len(code) + 1, bool)
            for _, s, e, _ in out[k]:
                taken[s:e] = True
            for kind, s, e in stitched(tagger, texts[k], code, cell, own):
                body = texts[k][s:e]
                e -= len(body) - len(body.rstrip(" .,;"))
                if not taken[s:e].any() and plausible(kind, texts[k][s:e]):
                    out[k].append((kind, s, e, False))
            out[k].sort(key=lambda x: (x[1], KINDS.index(x[0])))
    return out


def _rewritten(text: str, kind: str, pick: int) -> str:
    """Another way to write the same datum."""
    forms = {
        "email": (text.replace("@", " @ "), text.replace("@", "(at)"), text.replace("@", "[at]").replace(".", "[dot]")),
        "ip": (text.replace(".", " . "), text.replace(".", "[.]"), text),
        "card": (".".join(re.findall("[0-9]{1,4}", "".join(_DIGIT.findall(text)))), "/".join(re.findall("[0-9]{1,4}", "".join(_DIGIT.findall(text)))), text),
        "phone": (text.lstrip("+"), text.lstrip("+").replace(" ", "."), text),
    }[kind]
    return forms[pick % 3]


def training_windows(text: str, pick: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows and tags of a text, its spans rewritten in two texts of three."""
    out, at, marks = [], 0, []
    size = 0
    for kind, s, e in base_spans(text):
        if s < at:
            continue
        body = text[s:e] if pick % 3 == 0 else _rewritten(text[s:e], kind, pick // 3 + s)
        out += [text[at:s], body]
        size += s - at
        marks.append((kind, size, size + len(body)))
        size += len(body)
        at = e
    text = "".join([*out, text[at:]])
    code = codes(text)
    tag = np.zeros(len(code), np.int16)
    for kind, s, e in marks:
        tag[s:e] = 2 + 2 * KINDS.index(kind)
        tag[s] -= 1
    cell = cells(code, reaches(text))
    rows, tags = windows(code, cell), windows(tag, cell)
    # a window that begins inside a span begins with its first tag
    inside = (tags[:, 0] > 0) & (tags[:, 0] % 2 == 0)
    tags[inside, 0] -= 1
    return rows, tags


def train(docs: DataFrame, key: str = "doc_id", text: str = "text") -> Tagger:
    """Network trained on at most ``SAMPLE_WINDOWS`` windows of at most ``SAMPLE_DOCS`` documents; none: untrained bias to outside."""

    def run(batches):
        for batch in batches:
            for t, pick in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, tags = training_windows(t, pick)
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in rows], pa.binary()), pa.array([r.tobytes() for r in tags], pa.binary()), pa.array([pick] * len(rows), pa.int32())], ["code", "tag", "pick"])

    held = docs.where(F.col(text).rlike(GATE)).select(F.col(key).alias("k"), F.col(text).alias("t"))
    some = bounded(held, SAMPLE_DOCS, "k").select("t", F.pmod(F.xxhash64("k"), F.lit(9)).cast("int").alias("p"))
    found = some.mapInArrow(run, "code binary, tag binary, pick int").orderBy(F.xxhash64("code", "pick")).limit(SAMPLE_WINDOWS).toArrow()
    tagger = Tagger.new()
    tagger.p["bias"][0] = 3.0
    code, tag = (np.frombuffer(b"".join(found.column(c).to_pylist()), np.int16).reshape(-1, WINDOW).astype(np.int64) for c in ("code", "tag"))
    tagger.fit(code, tag)
    return tagger


SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("base", T.BooleanType())])
_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))


def find_pii(docs: DataFrame, tagger: Tagger, carry: list[str] | None = None, text: str = "text") -> DataFrame:
    """The ``carry`` columns (default: all) and ``pii``: spans in code points, end exclusive, ``base`` marks those of the rules.

    Null or empty text has none; repeated rows each get theirs; a carried column named pii is replaced.
    """
    carry = [c for c in (carry if carry is not None else docs.columns) if c != "pii"]
    df = docs.select(*carry, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__text"))
    sent = docs.sparkSession.sparkContext.broadcast(tagger)

    def run(batches):
        for batch in batches:
            for part in chunks(batch, "__text"):
                spans = all_spans(sent.value, part.column(len(carry)).to_pylist())
                rows = [[{"kind": k, "start": s, "end": e, "base": b} for k, s, e, b in x] for x in spans]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(carry)], pa.array(rows, _SPAN)], [*carry, "pii"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields[:-1], T.StructField("pii", T.ArrayType(SPAN))]))


def redacted(text: str, spans: list[tuple[str, int, int, bool]]) -> str:
    """The text with each span, or run of overlapping spans, replaced by its first kind in brackets."""
    out, at = [], 0
    for kind, s, e, _ in spans:
        if s >= at:
            out += [text[at:s], f"[{kind.upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, tagger: Tagger, text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """``docs`` with all found spans replaced; a known ``n_chars`` follows the new length. Null text stays null."""
    columns = docs.columns
    packed = docs.select(F.struct(*columns).alias("__row"), F.col(text).cast("string").alias("__text"))
    sent = docs.sparkSession.sparkContext.broadcast(tagger)

    def run(batches):
        for batch in batches:
            for part in chunks(batch, "__text"):
                texts = part.column(1).to_pylist()
                spans = all_spans(sent.value, [t or "" for t in texts])
                new = [t if t is None or not s else redacted(t, s) for t, s in zip(texts, spans, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(new, pa.string())], ["__row", "__text"])

    found = packed.mapInArrow(run, packed.schema)
    length = F.length("__text").cast(docs.schema[n_chars].dataType)
    new = {text: F.col("__text"), n_chars: F.when(F.col("__row")[n_chars].isNotNull(), F.coalesce(F.when(F.col("__text") != F.col("__row")[text], length), F.col("__row")[n_chars]))}
    return found.select(*[new.get(c, F.col("__row")[c]).alias(c) for c in columns])


def joined(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


@query("op7_pii")
def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = find_pii(docs, train(docs), ["doc_id"])
    base = F.filter("pii", lambda s: s["base"])
    count = lambda kind: F.size(F.filter("pii", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")
    counts = [count(kind) for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("pii")).alias("spans"), F.size(F.filter("pii", lambda s: ~s["base"])).cast("long").alias("n_added"))
