"""Language-model scores: a gated recurrent model with a class-factored softmax.

Token counts cover all training documents.  Words of the model's vocabulary are the
most frequent ones, and an end token; any other word is the class OTHER, inside which
it has its share of the counts, so that the model gives every text a probability:
    P(w) = P(class | state) P(w | class, state)          for a vocabulary word,
    P(w) = P(OTHER | state) (c + 0.5) / (N' + 0.5 (V' + 1))   for another one,
N' and V' being the tokens and distinct tokens outside the vocabulary.

Every text is split twice, once for the counts and once into token ids, which are written;
training and scoring read these.

The weights are trained in numpy by truncated backpropagation: every partition trains
on its own share of the training documents, weights are averaged by tokens, and the
next round goes on from there.  Scoring carries the state of a document from window to
window, so every token is judged by all that precedes it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm.common import fold_of, written

#: Words of the vocabulary, words of a class, size of embedding and state.
VOCABULARY, CLASS_WORDS, SIZE = 4096, 64, 32
#: Windows of so many tokens (in training and in scoring) over so many texts at once; tokens that a task buffers.
WINDOW, SCORE_WINDOW, TRAIN_LANES, LANES, BUFFER = 32, 64, 256, 256, 1 << 22
#: Training cuts longer texts into sequences of so many tokens; scoring never does.
SEQUENCE = 512
#: Rounds, among which the training documents are dealt, the step size, and the least tokens of a step.
ROUNDS, STEP, STEP_TOKENS = 4, 8e-3, 1024
#: A word with a greater share of the tokens than one in so many is known to every task;
#: so at most this many words are broadcast.
COMMON = 1 << 20
#: Bytes of text that a task splits at once, and rows whose outputs are worked on at once.
SLICE, BLOCK = 1 << 23, 1 << 10
#: Equal tokens of a window up to so many are summed place by place, more of them token by token.
REPEATS = 32
#: How token ids are written; a vocabulary is smaller than this can hold.
TOKEN = np.dtype("<u2")
OTHER, END = 0, 1  # the first two tokens; the end token also precedes a text
END_WORD = b""
CHUNK = 1 << 10


def sliced(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about SLICE bytes."""
    rows = max(1, batch.num_rows * SLICE // max(batch.nbytes, 1))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(the words of all texts, how many each text has); a null text has none."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))  # A-Z alone are lowered, ASCII white space alone splits
    words, sizes = parts.flatten().cast(pa.binary()), pc.list_value_length(parts).to_numpy()
    real = pc.binary_length(words).to_numpy() > 0  # white space at an end leaves an empty part
    if not real.all():
        words, upto = words.filter(pa.array(real)), np.append(0, np.cumsum(real))
        ends = np.cumsum(sizes)
        sizes = upto[ends] - upto[ends - sizes]
    return words, sizes


# ---------------------------------------------------------------- counts

def token_counts(training: DataFrame) -> DataFrame:
    """(word binary, n) over all training texts; the end token is the empty word."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch):
                found = words_of(part.column("text"))[0].value_counts()
                yield pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], ["word", "n"])
                yield pa.RecordBatch.from_arrays([pa.array([END_WORD], pa.binary()), pa.array([part.num_rows], pa.int64())], ["word", "n"])

    return training.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


# ---------------------------------------------------------------- the network

def layout(outputs: int) -> dict[str, tuple[int, ...]]:
    classes = 2 + -(-max(outputs - 2, 0) // CLASS_WORDS)  # OTHER and END have a class each
    return {"E": (outputs, SIZE), "Wx": (SIZE, 3 * SIZE), "Wh": (SIZE, 3 * SIZE), "b": (3 * SIZE,), "bh": (SIZE,),
            "Wc": (SIZE, classes), "bc": (classes,), "Wo": (max(classes - 2, 0), SIZE, CLASS_WORDS), "bo": (max(classes - 2, 0), CLASS_WORDS)}


def initial(counts: np.ndarray, other: float) -> dict[str, np.ndarray]:
    """Small random weights; the output biases give the counts' own probabilities.

    ``counts`` are those of OTHER (ignored), END and the vocabulary words in their order.
    """
    random, shapes = np.random.default_rng(0), layout(len(counts))
    weights = {k: (random.standard_normal(s) * 0.1).astype(np.float32) if len(s) > 1 and k != "bo" else np.zeros(s, np.float32)
               for k, s in shapes.items()}
    padded = np.zeros(shapes["bo"], np.float64)
    padded.ravel()[:len(counts) - 2] = counts[2:] + 0.5
    mass = np.concatenate([[other + 0.5, counts[1] + 0.5], padded.sum(1)])
    weights["bc"][:] = np.log(mass / mass.sum())
    weights["bo"][:] = np.where(padded > 0, np.log(np.maximum(padded, 0.5) / np.maximum(padded.sum(1, keepdims=True), 0.5)), -30)
    return weights


def flat(weights: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([weights[k].ravel() for k in layout(len(weights["E"]))])


def unflat(values: np.ndarray, outputs: int) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, s in layout(outputs).items():
        n = int(np.prod(s))
        out[k] = np.ascontiguousarray(values[at:at + n].reshape(s), np.float32)
        at += n
    return out


def _softmax(x: np.ndarray, targets: np.ndarray, bounded: bool, gradient: bool) -> np.ndarray:
    """Log probability of each row's target; ``x`` becomes its gradient, or is left overwritten.

    ``bounded`` says that no value is beyond what an exponential of 32 bits can hold.
    """
    if not bounded:
        x -= x.max(1, keepdims=True)
    values, places = x.reshape(-1), np.arange(0, x.size, x.shape[1]) + targets
    chosen = values.take(places)
    np.exp(x, out=x)
    total = x @ np.ones(x.shape[1], np.float32)
    if gradient:
        x *= np.reciprocal(total)[:, None]
        values[places] -= 1
    return chosen - np.log(total)


def _small(kernel: np.ndarray, bias: np.ndarray) -> bool:
    """Whether all outputs stay within +-60, states being within +-1."""
    return kernel.size == 0 or float(np.abs(kernel).sum(-2).max() + np.abs(bias).max()) < 60


def _gates(matrix: np.ndarray) -> np.ndarray:
    """(3, rows, SIZE): the columns of the update gate, the reset gate and the candidate apart."""
    return np.ascontiguousarray(matrix.reshape(len(matrix), 3, SIZE).transpose(1, 0, 2))


def _joined(gates: np.ndarray) -> np.ndarray:
    return gates.transpose(1, 0, 2).reshape(gates.shape[1], 3 * SIZE)


def _sums(parts: list[np.ndarray], ids: np.ndarray, distinct: int) -> np.ndarray:
    """Rows of equal ids (0 to ``distinct`` - 1, none missing) summed, the parts side by side."""
    order, counts = np.argsort(ids.astype(TOKEN), kind="stable"), np.bincount(ids, minlength=distinct)
    first, ranked = np.cumsum(counts) - counts, np.argsort(-counts, kind="stable")
    many = int((counts > REPEATS).sum())
    out, rest = np.empty((distinct, len(parts) * SIZE), np.float32), ranked[many:]
    sums = np.zeros((len(parts), len(rest), SIZE), np.float32)
    for i, part in enumerate(parts):
        for g in ranked[:many].tolist():
            rows = part.take(order[first[g]:first[g] + counts[g]], axis=0)
            out[g, i * SIZE:(i + 1) * SIZE] = np.ones(len(rows), np.float32) @ rows
    for nth in range(int(counts[rest].max(initial=0))):
        rows = order[first[rest[:int((counts[rest] > nth).sum())]] + nth]
        for part, total in zip(parts, sums, strict=True):
            total[:len(rows)] += part.take(rows, axis=0)
    out[rest] = sums.transpose(1, 0, 2).reshape(len(rest), len(parts) * SIZE)
    return out


class Gated:
    """A gated recurrent unit with a class-factored output.

    Arrays of a window are made once and used again: what a call gives holds until the next.
    """

    #: The gates are reckoned with these signs: 1 / (1 + e^x) for two of them, 2 / (1 + e^x) - 1 for the candidate.
    SIGNS = np.array([-1, -1, -2], np.float32)[:, None, None]

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w, self.fixed, self.shared, self.rooms = weights, None, None, {}

    def _room(self, name: str, *shape: int) -> np.ndarray:
        size = int(np.prod(shape))
        if name not in self.rooms or len(self.rooms[name]) < size:
            self.rooms[name] = np.empty(size, np.float32)
        return self.rooms[name][:size].reshape(shape)

    def _fixed(self, changed: bool):
        """The recurrent gates and their bias, and which outputs are small."""
        if changed or self.fixed is None:
            w = self.w
            self.fixed = (_gates(w["Wh"]) * self.SIGNS, w["bh"] * self.SIGNS[2, 0], _small(w["Wc"], w["bc"]), _small(w["Wo"], w["bo"]))
        return self.fixed

    def _shares(self, embedded: np.ndarray) -> np.ndarray:
        """(3, rows, SIZE): what embedded tokens add to the gates."""
        out = np.matmul(embedded, _gates(self.w["Wx"]) * self.SIGNS)
        out += _gates(self.w["b"][None]) * self.SIGNS
        return out.astype(np.float32, copy=False)

    def states(self, inputs: np.ndarray, fresh: np.ndarray, state: np.ndarray, keep: bool = False):
        """The state after each input (steps x lanes); ``fresh`` marks where a text begins.

        With ``keep`` also (state before, gates, recurrent candidate (times -2), candidate)
        of each step, the distinct inputs and every input's place among them.
        """
        recurrent, bias, *_ = self._fixed(keep)  # kept for gradients: the weights have moved
        if keep:
            found = np.flatnonzero(np.bincount(inputs.ravel()))
            place = np.zeros(len(self.w["E"]), np.int64)
            place[found] = np.arange(len(found))
            inputs, shares = place[inputs], self._shares(self.w["E"][found])
        else:
            if self.shared is None:
                self.shared = self._shares(self.w["E"])
            shares = self.shared
        steps, shape, begins = len(inputs), (*inputs.shape, SIZE), fresh.any(1).tolist()
        out, room = self._room("states", *shape), self._room
        kept = (room("before", *shape), room("zr", steps, 2, *shape[1:]), room("gn", *shape), room("n", *shape)) if keep else None
        g, x = room("g", 3, *shape[1:]), room("x", 3, *shape[1:])
        before, zr, n = room("s", *shape[1:]), room("zr1", 2, *shape[1:]), room("n1", *shape[1:])
        with np.errstate(over="ignore"):  # beyond 32 bits the reciprocal is 0, as it should be
            for t in range(steps):
                if keep:
                    before, zr, n = kept[0][t], kept[1][t], kept[3][t]
                if keep or begins[t]:
                    np.copyto(before, state)
                    state = before
                if begins[t]:
                    state[fresh[t]] = 0
                np.matmul(state, recurrent, out=g)
                shares.take(inputs[t], axis=1, out=x, mode="clip")
                np.add(g[:2], x[:2], out=zr)
                np.exp(zr, out=zr)
                zr += 1
                np.reciprocal(zr, out=zr)
                gn = np.add(g[2], bias, out=kept[2][t] if keep else g[2])
                np.multiply(zr[1], gn, out=n)
                n += x[2]
                np.exp(n, out=n)  # an exponential costs half as much as a tanh here
                n += 1
                np.divide(2, n, out=n)
                n -= 1
                after = np.subtract(state, n, out=out[t])
                after *= zr[0]
                after += n
                state = after
        return out, state.copy(), (*kept, found, inputs) if keep else None

    def log_probabilities(self, h: np.ndarray, targets: np.ndarray, gradient: dict[str, np.ndarray] | None = None):
        """Natural log of P(target | state) of every row, and with ``gradient`` that of the states."""
        w, learns = self.w, gradient is not None
        *_, small_classes, small_words = self._fixed(False)
        words = targets - 2
        groups = np.where(words < 0, targets, words // CLASS_WORDS + 2)
        logs, ones = np.empty(len(h)), np.ones(max(len(h), 1), np.float32)
        back = self._room("back", len(h), SIZE) if learns else None
        for at in range(0, len(h), BLOCK):
            own = h[at:at + BLOCK]
            x = np.matmul(own, w["Wc"], out=self._room("classes", len(own), w["Wc"].shape[1]))
            x += w["bc"]
            logs[at:at + BLOCK] = _softmax(x, groups[at:at + BLOCK], small_classes, learns)
            if learns:
                gradient["Wc"] += own.T @ x
                gradient["bc"] += ones[:len(x)] @ x
                np.matmul(x, w["Wc"].T, out=back[at:at + BLOCK])
        # words of the vocabulary, class by class; small classes are worked on together
        order = np.flatnonzero(words >= 0)
        order = order[np.argsort(groups[order].astype(TOKEN), kind="stable")]
        own_h, place = h.take(order, axis=0), words[order] % CLASS_WORDS
        sizes = np.bincount(groups[order], minlength=2)[2:]
        found, stops = np.flatnonzero(sizes).tolist(), np.cumsum(sizes)[sizes > 0].tolist()
        parts, run, start = np.empty(len(order)), [], 0
        own_back = self._room("own_back", len(order), SIZE) if learns else None
        for i, (g, stop) in enumerate(zip(found, stops, strict=True)):
            run.append((g, stops[i - 1] - start if i else 0, stop - start))
            if stop - start < BLOCK and i + 1 < len(found):
                continue
            own, x = own_h[start:stop], self._room("words", stop - start, CLASS_WORDS)
            for c, a, b in run:
                np.matmul(own[a:b], w["Wo"][c], out=x[a:b])
                x[a:b] += w["bo"][c]
            parts[start:stop] = _softmax(x, place[start:stop], small_words, learns)
            if learns:
                for c, a, b in run:
                    gradient["Wo"][c] += own[a:b].T @ x[a:b]
                    gradient["bo"][c] += ones[:b - a] @ x[a:b]
                    np.matmul(x[a:b], w["Wo"][c].T, out=own_back[start + a:start + b])
            run, start = [], stop
        logs[order] += parts
        if learns:
            back[order] += own_back
        return logs, back

    def gradients(self, inputs, targets, valid, fresh, state):
        """Gradients of the summed loss over one window, the state after it, and its tokens."""
        w, s, room = self.w, SIZE, self._room
        grad = {k: np.zeros_like(v) for k, v in w.items()}
        h, last, (before, zr, gn, n, found, places) = self.states(inputs, fresh, state, keep=True)
        at = np.flatnonzero(valid.ravel())
        if len(at) == inputs.size:
            dh_out = self.log_probabilities(h.reshape(-1, s), targets.ravel(), grad)[1].reshape(h.shape)
        else:
            dh_out = np.zeros((inputs.size, s), np.float32)
            dh_out[at] = self.log_probabilities(h.reshape(-1, s)[at], targets.ravel()[at], grad)[1]
            dh_out = dh_out.reshape(h.shape)
        turned, begins = np.ascontiguousarray(_gates(w["Wh"]).transpose(0, 2, 1)), fresh.any(1).tolist()
        d = room("d", 4, *h.shape)  # of z, r, the recurrent candidate, the candidate
        dh, one, two, through = np.zeros(state.shape, np.float32), room("one", *state.shape), room("two", *state.shape), room("g", 3, *state.shape)
        for t in range(len(inputs) - 1, -1, -1):
            dh += dh_out[t]
            z, r = zr[t]
            kept = np.multiply(dh, z, out=one)  # what the state before gets directly
            dn = np.subtract(dh, kept, out=d[3, t])  # dh (1 - z) (1 - n^2)
            np.multiply(n[t], n[t], out=two)
            np.subtract(1, two, out=two)
            dn *= two
            np.subtract(before[t], n[t], out=two)  # dh (before - n) z (1 - z)
            two *= kept
            np.subtract(1, z, out=d[0, t])
            d[0, t] *= two
            np.multiply(dn, r, out=d[2, t])
            np.subtract(1, r, out=two)  # dn gn r (1 - r), gn being kept times -2
            two *= gn[t]
            two *= d[2, t]
            np.multiply(two, np.float32(-0.5), out=d[1, t])
            np.matmul(d[:3, t], turned, out=through)
            np.add(kept, through[0], out=dh)
            dh += through[1]
            dh += through[2]
            if begins[t]:
                dh[fresh[t]] = 0
        d = d.reshape(4, -1, s)
        grad["Wh"] += _joined(np.matmul(before.reshape(-1, s).T, d[:3]))
        grad["bh"] += np.ones(inputs.size, np.float32) @ d[2]
        # the shares of equal tokens are summed before they meet the weights
        rows = _sums([d[0], d[1], d[3]], places.ravel(), len(found))
        grad["b"] += rows.sum(0)
        grad["Wx"] += w["E"][found].T @ rows
        grad["E"][found] += rows @ w["Wx"].T
        return grad, last, len(at)


class Adam:
    def __init__(self, weights: dict[str, np.ndarray]):
        self.w, self.t, self.held, self.tokens = weights, 0, None, 0
        self.m, self.v = ({k: np.zeros_like(x) for k, x in weights.items()} for _ in range(2))

    def add(self, grad: dict[str, np.ndarray], tokens: int) -> None:
        """Step once the summed gradients cover enough tokens."""
        self.held = grad if self.held is None else {k: self.held[k] + g for k, g in grad.items()}
        self.tokens += tokens
        if self.tokens >= STEP_TOKENS:
            self.step(self.held, self.tokens)
            self.held, self.tokens = None, 0

    def step(self, grad: dict[str, np.ndarray], tokens: int) -> None:
        """One step along the mean of the gradients, whose norm is held to 5."""
        self.t += 1
        norm = np.sqrt(sum(float(np.dot(g.ravel(), g.ravel())) for g in grad.values())) / tokens
        scale = np.float32(min(1.0, 5.0 / (norm + 1e-9)) / tokens)
        rate = np.float32(STEP * np.sqrt(1 - 0.999 ** self.t) / (1 - 0.9 ** self.t))
        for k in grad:
            flat_ones = [x.reshape(-1) for x in (grad[k], self.m[k], self.v[k], self.w[k])]
            for at in range(0, grad[k].size, 1 << 14):  # a part at a time, which stays in the cache
                g, m, v, w = (x[at:at + (1 << 14)] for x in flat_ones)
                g *= scale
                change = g - m
                change *= np.float32(0.1)
                m += change
                np.multiply(g, g, out=change)
                change -= v
                change *= np.float32(0.001)
                v += change
                np.sqrt(v, out=change)
                change += np.float32(1e-6)
                np.divide(m, change, out=change)
                change *= rate
                w -= change


# ---------------------------------------------------------------- windows over texts

def windows(texts: list[np.ndarray], lanes: int = LANES, steps: int = WINDOW):
    """(inputs, targets, text of each token or -1, fresh) of successive windows.

    Texts (arrays of token ids) are dealt to lanes, longest first to
    the shortest lane; a lane runs through its texts one after the other, so a text's
    windows follow each other and its state is carried.
    """
    lanes = max(1, min(lanes, len(texts)))
    held, loads = [[] for _ in range(lanes)], np.zeros(lanes, np.int64)
    for i in sorted(range(len(texts)), key=lambda i: -len(texts[i])):
        lane = int(loads.argmin())
        held[lane].append(i)
        loads[lane] += len(texts[i])
    order = np.argsort(-loads, kind="stable")
    held, loads = [held[i] for i in order], loads[order]
    longest = int(loads.max(initial=0))
    targets, owner = np.zeros((longest, lanes), np.int32), np.full((longest, lanes), -1, np.int32)
    fresh = np.zeros((longest, lanes), bool)
    for lane, own in enumerate(held):
        at = 0
        for i in own:
            targets[at:at + len(texts[i]), lane] = texts[i]
            owner[at:at + len(texts[i]), lane] = i
            fresh[at, lane] = True
            at += len(texts[i])
    inputs = np.full_like(targets, END)
    inputs[1:] = np.where(fresh[1:], END, targets[:-1])
    for at in range(0, longest, steps):
        busy = int((loads > at).sum())  # lanes are sorted by load: the first ones are busy
        part = slice(at, at + steps), slice(0, busy)
        yield inputs[part], targets[part], owner[part], fresh[part]


def text_scores(model: Gated, texts: list[np.ndarray]) -> np.ndarray:
    """Natural log of the probability of every text's token classes and vocabulary words."""
    total, state = np.zeros(len(texts)), np.zeros((max(1, min(LANES, len(texts))), SIZE), np.float32)
    for inputs, targets, owner, fresh in windows(texts, steps=SCORE_WINDOW):
        h, state, _ = model.states(inputs, fresh, state[:inputs.shape[1]])
        at = np.flatnonzero(owner.ravel() >= 0)
        logs, _ = model.log_probabilities(h.reshape(-1, SIZE)[at], targets.ravel()[at])
        total += np.bincount(owner.ravel()[at], weights=logs, minlength=len(texts))
    return total


# ---------------------------------------------------------------- training and scoring in Spark

class Knowledge:
    """What every task knows: totals, common words with their counts, the vocabulary being the first of them."""

    def __init__(self, tokens: int, distinct: int, words: list[bytes], counts: list[int]):
        self.tokens, self.distinct = tokens, distinct
        known = dict(zip(words, counts, strict=True))
        self.end = known.pop(END_WORD, 0)
        ranked = sorted(known, key=lambda w: (-known[w], w))
        self.words, self.counts = pa.array(ranked, pa.binary()), np.array([known[w] for w in ranked], np.int64)
        self.inside = min(VOCABULARY, len(ranked))
        self.vocabulary = np.array([0, self.end, *self.counts[:self.inside]], np.float64)
        self.other_tokens = tokens - int(self.vocabulary.sum())
        self.other_distinct = distinct - self.inside - (self.end > 0)


def encoded(rows: DataFrame, given) -> DataFrame:
    """Every row's token ids, the sums of its common words' logarithms and its rare words, in place of its text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        know = given.value
        logs = np.log10(np.append(know.counts, 0) + 0.5)  # the last is for rare words, which are added later
        logs[-1] = 0.0
        end = float(np.log10(know.end + 0.5))
        for batch in batches:
            for part in sliced(batch):
                yield coded(part, know, logs, end)

    def coded(part, know, logs, end):
        n = part.num_rows
        words, sizes = words_of(part.column("text"))
        at = pc.fill_null(pc.index_in(words, know.words), -1).to_numpy()
        owner = np.repeat(np.arange(n), sizes)
        rare, outside = at < 0, (at < 0) | (at >= know.inside)
        ids = np.full(len(at) + n, END, TOKEN)
        ids[np.arange(len(at)) + owner] = np.where(outside, OTHER, at + 2)
        n_rare, own = np.bincount(owner[rare], minlength=n), logs[at]
        ends = np.append(0, np.cumsum(sizes + 1) * TOKEN.itemsize).astype(np.int32)
        columns = {
            "doc_id": part.column("doc_id"), "held_out": part.column("held_out"), "turn": part.column("turn"),
            "ids": pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(ids)]),
            "n_tokens": pa.array(sizes + 1, pa.int64()), "n_other": pa.array(np.bincount(owner[outside], minlength=n), pa.int64()),
            "n_common": pa.array(sizes - n_rare, pa.int64()),
            "common_log": pa.array(np.bincount(owner, own, n) + end, pa.float64()),
            "other_log": pa.array(np.bincount(owner[outside], own[outside], n), pa.float64()),
            "rare": pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n_rare)), pa.int32()), words.filter(pa.array(rare)))}
        return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    turn = F.pmod(F.xxhash64("doc_id", "text"), F.lit(ROUNDS))  # null ids are told apart by their texts
    return rows.withColumn("turn", turn.cast("int")).mapInArrow(
        run, "doc_id long, held_out boolean, turn int, ids binary, n_tokens long, n_other long, n_common long, "
             "common_log double, other_log double, rare array<binary>")


def buffered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[pa.RecordBatch], list[np.ndarray]]]:
    """(slices of batches, the token ids of their texts), of BUFFER tokens and the rest of the last text."""
    held, size = [], 0

    def out():
        return held, [np.frombuffer(ids, TOKEN) for part in held for ids in part.column("ids").to_pylist()]

    for batch in batches:
        upto, at = np.append(0, np.cumsum(pc.binary_length(batch.column("ids")).to_numpy() // TOKEN.itemsize, dtype=np.int64)), 0
        while at < batch.num_rows:
            stop = min(int(np.searchsorted(upto, upto[at] + BUFFER - size)), batch.num_rows)
            held.append(batch.slice(at, stop - at))
            size += int(upto[stop] - upto[at])
            at = stop
            if size >= BUFFER:
                yield out()
                held, size = [], 0
    if held:
        yield out()


def _trained(outputs: int, weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        net = Gated(unflat(weights.value.copy(), outputs))
        adam = Adam(net.w)
        for _, texts in buffered(batches):
            pieces = [ids[i:i + SEQUENCE] for ids in texts for i in range(0, len(ids), SEQUENCE)]
            state = np.zeros((max(1, min(TRAIN_LANES, len(pieces))), SIZE), np.float32)
            for inputs, targets, owner, fresh in windows(pieces, TRAIN_LANES):
                grad, state, n = net.gradients(inputs, targets, owner >= 0, fresh, state[:inputs.shape[1]])
                adam.add(grad, n)
                seen += n
        if seen:
            values = flat(net.w)
            parts = [values[i:i + CHUNK].tobytes() for i in range(0, len(values), CHUNK)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([seen] * len(parts), pa.int64()),
                                              pa.array(parts, pa.binary())], ["chunk", "seen", "part"])
    return run


def _averaged(table: pa.Table) -> pa.Table:
    parts = np.array([np.frombuffer(p, np.float32) for p in table.column("part").to_pylist()], np.float64)
    mean = np.average(parts, axis=0, weights=table.column("seen").to_numpy()).astype(np.float32)
    return pa.table([pa.array(table.column("chunk").to_pylist()[:1], pa.int32()), pa.array([mean.tobytes()], pa.binary())], ["chunk", "part"])


def train(coded: DataFrame, knowledge: Knowledge) -> np.ndarray:
    """The weights after all rounds, which together take every training document once."""
    spark = coded.sparkSession
    values = flat(initial(knowledge.vocabulary, max(knowledge.other_tokens, 0)))
    for round_ in range(ROUNDS):
        rows = (coded.filter(~F.col("held_out") & (F.col("turn") == round_)).select("ids")
                .mapInArrow(_trained(len(knowledge.vocabulary), spark.sparkContext.broadcast(values)), "chunk int, seen long, part binary")
                .groupBy("chunk").applyInArrow(_averaged, "chunk int, part binary").collect())  # the size of the model
        if rows:
            values = np.concatenate([np.frombuffer(r.part, np.float32) for r in sorted(rows, key=lambda r: r.chunk)])
    return values


def score_texts(docs: DataFrame, fold: int = 1) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document.

    Training documents are those whose fold is not ``fold``.  A null or empty text is its
    end token alone.  Without training documents the base gives every token probability 1
    (N and V are 0) and the model is its initial state.  Repeated rows each give a row;
    other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold_of(F.col("doc_id")) == fold).alias("held_out"), "text")
    counts = written(token_counts(rows.filter(~F.col("held_out"))), "lm-counts")
    totals = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    common = counts.filter((F.col("n") * COMMON > totals.n) | (F.length("word") == 0)).toArrow()
    knowledge = Knowledge(totals.n, totals.v, common.column("word").to_pylist(), common.column("n").to_pylist())
    coded = written(encoded(rows, spark.sparkContext.broadcast(knowledge)).withColumn("row", F.monotonically_increasing_id()), "lm-coded")
    weights, outputs = spark.sparkContext.broadcast(train(coded, knowledge)), len(knowledge.vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Gated(unflat(weights.value.copy(), outputs))
        for parts, texts in buffered(batches):
            scores, at = text_scores(net, texts) / np.log(10), 0
            for part in parts:
                own = pa.array(scores[at:at + part.num_rows], pa.float64())
                yield part.drop_columns(["ids"]).append_column("model_log", own)
                at += part.num_rows

    kept = ("row", "doc_id", "held_out", "n_tokens", "n_other", "n_common", "common_log", "other_log")
    scored = written(coded.select(*kept, "ids").mapInArrow(
        run, ", ".join(f"{c} {coded.schema[c].dataType.simpleString()}" for c in kept) + ", model_log double"), "lm-scored")
    # rare words: none has more than one in COMMON of the tokens, so no key is hot
    rare = (coded.select("row", F.explode("rare").alias("word")).join(counts, "word", "left")
            .groupBy("row").agg(F.sum(F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("rare_log"), F.count("n").alias("rare_known")))
    base = float(np.log10(totals.n + 0.5 * (totals.v + 1)))
    other = float(np.log10(max(knowledge.other_tokens, 0) + 0.5 * (max(knowledge.other_distinct, 0) + 1)))
    tail = F.coalesce("rare_log", F.lit(0.0))
    return scored.join(rare, "row", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("n_common") + F.coalesce("rare_known", F.lit(0)) + (1 if knowledge.end else 0)).cast("long").alias("n_known"),
        F.lit(totals.n).cast("long").alias("train_tokens"),
        (F.col("common_log") + tail - F.col("n_tokens") * base).alias("base_score"),
        (F.col("model_log") + F.col("other_log") + tail - F.col("n_other") * other).alias("score"))
