"""Language identification with a bidirectional gated recurrent network over bytes (operator 1).

A text's UTF-8 bytes are cut into pieces of PIECE bytes that follow one another
without gaps; a gated recurrent network reads each piece forwards and another
one backwards, and from both states every byte position gets probabilities of
the languages.  A document's probabilities are the mean over all its positions.

The network is trained in numpy by backpropagation through time (Adam, mean
cross-entropy over positions) on pieces drawn from a bounded sample of labelled
documents; it is a few kilobytes and goes to the executors by broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kernelspark.llm import _text as T
from kernelspark.llm._util import lean

PIECE, LANES = 128, 2048
#: Labelled documents that the network is trained on at most, by order of a hash of their ids.
SAMPLE = 2_000
#: Of a longer text the network is trained on CUTS stretches of CUT characters at places given by a hash of its id; predictions read all of it.
CUT, CUTS = 1_024, 4
UNKNOWN = "und"


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Cell:
    """One direction. Gates z, r and the candidate n stand one below the other; columns are lanes.

    h' = n + z (h - n),  n = tanh(e_n + r (u_n h + c)),  z, r = sigmoid(e + u h)
    """

    e: np.ndarray  # (3H, 256): what a byte adds
    u: np.ndarray  # (3H, H)
    c: np.ndarray  # (H, 1)

    @classmethod
    def new(cls, hidden: int, rng: np.random.Generator) -> Cell:
        return cls(rng.normal(0, 0.3, (3 * hidden, 256)), rng.normal(0, 0.3, (3 * hidden, hidden)), np.zeros((hidden, 1)))

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, list]:
        """States after each byte of x (steps, lanes), and what backward() needs."""
        hidden = self.u.shape[1]
        h, states, kept = np.zeros((hidden, x.shape[1])), [], []
        for row in x:
            a, u = self.e[:, row], self.u @ h
            z, r = _sigmoid(a[:hidden] + u[:hidden]), _sigmoid(a[hidden : 2 * hidden] + u[hidden : 2 * hidden])
            v = u[2 * hidden :] + self.c
            n = np.tanh(a[2 * hidden :] + r * v)
            kept.append((h, z, r, n, v))
            h = n + z * (h - n)
            states.append(h)
        return np.array(states), kept

    def backward(self, x: np.ndarray, kept: list, grad: np.ndarray) -> list[np.ndarray]:
        """Gradients of e, u, c from those of the states."""
        du, dc, da = np.zeros_like(self.u), np.zeros_like(self.c), np.zeros((len(x), *self.e.shape[:1], x.shape[1]))
        back = np.zeros_like(grad[0])
        for t in range(len(x) - 1, -1, -1):
            h, z, r, n, v = kept[t]
            g = grad[t] + back
            dn = g * (1 - z) * (1 - n * n)
            dz, dr = g * (h - n) * z * (1 - z), dn * v * r * (1 - r)
            da[t] = np.concatenate((dz, dr, dn))
            step = np.concatenate((dz, dr, dn * r))
            du += step @ h.T
            dc += (dn * r).sum(1, keepdims=True)
            back = g * z + self.u.T @ step
        one = np.zeros((x.size, 256), np.float32)
        one[np.arange(x.size), x.ravel()] = 1
        de = da.transpose(1, 0, 2).reshape(len(self.e), -1).astype(np.float32) @ one
        return [de, du, dc]


@dataclass
class Network:
    langs: list[str]
    ahead: Cell
    behind: Cell
    w: np.ndarray  # (languages, 2H)
    b: np.ndarray  # (languages, 1)
    _fast: tuple = field(default=(), repr=False)

    @classmethod
    def new(cls, langs: list[str], hidden: int, seed: int) -> Network:
        rng = np.random.default_rng(seed)
        return cls(langs, Cell.new(hidden, rng), Cell.new(hidden, rng), rng.normal(0, 0.3, (len(langs), 2 * hidden)), np.zeros((len(langs), 1)))

    @property
    def weights(self) -> list[np.ndarray]:
        return [self.ahead.e, self.ahead.u, self.ahead.c, self.behind.e, self.behind.u, self.behind.c, self.w, self.b]

    def loss(self, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross-entropy over positions of x (steps, lanes) with languages y (lanes), and its gradients."""
        back_x = x[::-1]
        fwd, kept_f = self.ahead.forward(x)
        bwd, kept_b = self.behind.forward(back_x)
        both = np.concatenate((fwd, bwd[::-1]), axis=1)
        logits = np.einsum("ch,thb->tcb", self.w, both) + self.b
        logits -= logits.max(axis=1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=1, keepdims=True)
        lanes = np.arange(len(y))
        loss = float(-np.log(p[:, y, lanes] + 1e-12).mean())
        g = p
        g[:, y, lanes] -= 1
        g /= x.size
        dw = np.einsum("tcb,thb->ch", g, both)
        db = g.sum(axis=(0, 2))[:, None]
        d = np.einsum("ch,tcb->thb", self.w, g)
        hidden = self.ahead.u.shape[1]
        return loss, [*self.ahead.backward(x, kept_f, d[:, :hidden]), *self.behind.backward(back_x, kept_b, d[::-1, hidden:]), dw, db]

    def probabilities(self, x: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Sums over positions of the probabilities, (languages, lanes); lanes of x (steps, lanes) end after ``length`` bytes.

        In single precision, the halves of the sigmoids' arguments taken into the weights.
        """
        hidden = self.ahead.u.shape[1]
        if not self._fast:
            scale = np.concatenate((np.full((2 * hidden, 1), 0.5), np.ones((hidden, 1))))
            f = lambda a: np.ascontiguousarray(a, np.float32)
            self._fast = tuple((f(c.e * scale), f(c.u * scale), f(c.c)) for c in (self.ahead, self.behind)), (f(self.w), f(self.b))
        cells, (w, b) = self._fast
        steps, lanes = x.shape
        a, u, zr = np.empty((3 * hidden, lanes), np.float32), np.empty((3 * hidden, lanes), np.float32), np.empty((2 * hidden, lanes), np.float32)
        n, kept = np.empty((hidden, lanes), np.float32), np.empty((steps, hidden, lanes), np.float32)
        h = np.zeros((hidden, lanes), np.float32)

        def step(cell, row, h, out):
            e, uu, c = cell
            np.take(e, row, axis=1, out=a, mode="clip")
            np.matmul(uu, h, out=u)
            np.add(a[: 2 * hidden], u[: 2 * hidden], out=zr)
            np.tanh(zr, out=zr)
            np.multiply(zr, 0.5, out=zr)
            np.add(zr, 0.5, out=zr)
            np.add(u[2 * hidden :], c, out=n)
            np.multiply(n, zr[hidden:], out=n)
            np.add(n, a[2 * hidden :], out=n)
            np.tanh(n, out=n)
            np.subtract(h, n, out=out)
            np.multiply(out, zr[:hidden], out=out)
            np.add(out, n, out=out)

        for t in range(steps):
            step(cells[0], x[t], h, kept[t])
            h = kept[t]
        h, other, total = np.zeros((hidden, lanes), np.float32), np.empty((hidden, lanes), np.float32), np.zeros((len(w), lanes), np.float32)
        least = int(length.min()) if len(length) else 0
        logits, more = np.empty((len(w), lanes), np.float32), np.empty((len(w), lanes), np.float32)
        for t in range(steps - 1, -1, -1):
            step(cells[1], x[t], h, other)
            h, other = other, h
            if t >= least:
                h *= t < length  # nothing is read yet behind a lane's end
            np.matmul(w[:, :hidden], kept[t], out=logits)
            np.matmul(w[:, hidden:], h, out=more)
            logits += more
            logits += b
            np.exp(np.clip(logits, -60, 60, out=logits), out=logits)
            logits /= logits.sum(axis=0)
            if t >= least:
                logits *= t < length
            total += logits
        return total


def train(texts: list[bytes], langs: list[str], hidden: int = 8, steps: int = 160, lanes: int = 128, piece: int = 64, rate: float = 0.02, seed: int = 3) -> Network:
    """A network of the languages in langs. Each step draws pieces evenly over languages, anywhere in their texts."""
    names = sorted(set(langs))
    net = Network.new(names, hidden, seed)
    rng = np.random.default_rng(seed + 1)
    own = [[np.frombuffer(t, np.uint8) for t, g in zip(texts, langs, strict=True) if g == name] for name in names]
    first, second = [np.zeros_like(v) for v in net.weights], [np.zeros_like(v) for v in net.weights]
    for k in range(steps):
        y = rng.integers(0, len(names), lanes)
        x = np.full((lanes, piece), 32, np.uint8)
        for lane, c in enumerate(y):
            t = own[c][rng.integers(len(own[c]))]
            at = rng.integers(max(1, len(t) - piece + 1))
            part = t[at : at + piece]
            x[lane, : len(part)] = part
        _, grads = net.loss(x.T.copy(), y)
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        now = rate * min(1.0, 2 * (1 - k / steps))
        for v, g, m1, m2 in zip(net.weights, grads, first, second, strict=True):
            g = g * min(1.0, 1.0 / (norm + 1e-9))
            m1 += 0.1 * (g - m1)
            m2 += 0.01 * (g * g - m2)
            v -= now * (m1 / (1 - 0.9 ** (k + 1))) / (np.sqrt(m2 / (1 - 0.99 ** (k + 1))) + 1e-8)
    return net


def predict(net: Network, column: pa.Array) -> tuple[list[str], np.ndarray]:
    """The language and its probability of every text of a column, all of its bytes read."""
    import regex

    letter = regex.compile(r"\p{L}").search
    lang, score = [], []
    for a, b, data, offsets in T.blocks(column):
        size = np.diff(offsets)
        pieces = -(-size // PIECE)
        row = np.repeat(np.arange(b - a), pieces)
        start = offsets[:-1][row] + PIECE * (np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        length = np.minimum(offsets[1:][row] - start, PIECE)
        order = np.argsort(-length, kind="stable")
        padded = np.concatenate((data, np.zeros(PIECE, np.uint8)))
        total = np.zeros((len(net.langs), b - a))
        for s in range(0, len(order), LANES):
            at = order[s : s + LANES]
            steps = int(length[at].max())
            x = padded[start[at][None, :] + np.arange(steps)[:, None]]
            p = net.probabilities(x, length[at])
            for c in range(len(net.langs)):
                total[c] += np.bincount(row[at], weights=p[c], minlength=b - a)
        best = total.argmax(0)
        for k, t in enumerate(column.slice(a, b - a).to_pylist()):
            known = bool(t) and letter(t) is not None
            lang.append(net.langs[best[k]] if known else UNKNOWN)
            score.append(min(1.0, float(total[best[k], k] / size[k])) if known else 0.0)
    return lang, np.array(score)


def held_out(doc_id) -> F.Column:
    """Documents that are never learnt from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _stretches(text, doc_id) -> F.Column:
    """The part of a text that goes to the driver for training: CUT * CUTS characters and a few spaces at most."""
    room = F.length(text) - F.lit(CUT)
    cuts = [F.substring(text, (F.pmod(F.xxhash64(F.lit(k), doc_id), room.cast("long")) + 1).cast("int"), F.lit(CUT)) for k in range(CUTS)]
    return F.when(F.length(text) <= CUT * CUTS, text).otherwise(F.concat_ws(" ", *cuts))


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document.

    The network learns from text and lang of labelled documents that are not
    held out, at most ``sample`` of them by order of a hash of their ids, and of
    each at most CUTS stretches of CUT characters; rows without id are not learnt from.  Null texts and texts without a letter are
    ``und`` with score 0, and so is every text where no language is labelled.
    Repeated rows are predicted alike.  An empty table gives no rows.  Columns
    other than doc_id, text and lang are not read.
    """
    spark = docs.sparkSession
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & (F.length("text") > 0))
    got = known.select("doc_id", F.col("lang").cast("string").alias("lang"), F.xxhash64(F.lit(17), "doc_id").alias("h")).orderBy("h", "doc_id").limit(sample)
    chosen = known.select("doc_id", _stretches(F.col("text").cast("string"), F.col("doc_id")).alias("text")).join(F.broadcast(got), "doc_id").select("h", "doc_id", "text", "lang").orderBy("h", "doc_id", "lang", "text").limit(sample).collect()
    net = train([r.text.encode() for r in chosen], [r.lang for r in chosen]) if chosen else None
    shared = spark.sparkContext.broadcast(net)

    def each(batches) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            n = batch.num_rows
            lang, score = predict(net, batch.column("text")) if net and n else ([UNKNOWN] * n, np.zeros(n))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lean(each), "doc_id long, held_out boolean, lang_pred string, score double")
