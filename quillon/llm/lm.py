"""Language-model scores by a gated recurrent network with a class-factored softmax.

Counts of all training tokens are taken by Spark and stay a table. The `SHORT` commonest tokens are
the network's words; every other token is the word "rest", whose probability is shared out by the
counts, so the model gives a proper distribution over the known tokens and one unseen token. It is
trained in numpy by truncated backpropagation: a bounded sample of training documents gives the weights to
start from, then it learns from every training document, whatever its length. For that they are dealt to
parts by a hash; each part goes on from the same network in a task of its own, and the networks are averaged
by their tokens. Documents are scored whole, in windows that hand
on the state.

Tokens outside the `most_top` commonest are joined with the table of counts, which may grow without
bound; only the commonest (a fixed number) are sent to every task.

Defined cases: null texts are empty (just the end token); repeated rows are scored each; an empty
table gives no rows; without training documents all tokens are unseen and the score is the base score.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from itertools import repeat

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import commonest, cut, give_back, id_text, through

SHORT, CLASSES, EMB, HID = 2048, 40, 16, 24
REST, END = 0, 1  # ids of the network's words; the end token is held as the empty token
STEPS = 64


def tokens_of(text: str | None) -> list[bytes]:
    """bytes.split() and bytes.lower() know just the ASCII white space and letters that are asked for."""
    return text.encode().lower().split() if text else []


def cut_up(texts) -> tuple:
    """`tokens_of` every text of an Arrow array, without the ends: the different tokens (and perhaps the empty string),
    the place of each token among them, and how many each text has."""
    import pyarrow as pa
    import pyarrow.compute as pc

    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words, at = lists.flatten(), lists.offsets.to_numpy()
    coded = words.dictionary_encode()
    codes = coded.indices.to_numpy()
    # white space at either end of a text leaves an empty string there
    empty = pc.index(coded.dictionary, pa.scalar("", coded.dictionary.type)).as_py()
    if empty >= 0:
        real = codes != empty
        codes, at = codes[real], np.append(0, np.cumsum(real))[at]
    return coded.dictionary.cast(pa.binary()), codes, np.diff(at)


def count(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", most: int = 300_000) -> DataFrame:
    """token, n (in training documents), n_all: summed on each task before rows are moved."""

    def run(batches):
        import pyarrow as pa

        def summed(parts):
            rows = pa.Table.from_batches(parts).group_by("token", use_threads=False).aggregate([("n", "sum"), ("n_all", "sum")])
            return pa.table([rows.column(c).combine_chunks() for c in ("token", "n_sum", "n_all_sum")], names).to_batches()

        names, held = ["token", "n", "n_all"], []
        for b in batches:
            tokens, codes, size = cut_up(b.column(0))
            known = b.column(1).to_numpy(zero_copy_only=False).astype(bool)
            n_all, n = (np.bincount(c, minlength=len(tokens)) for c in (codes, codes[np.repeat(known, size)]))
            some = np.flatnonzero(n_all)
            ends = pa.RecordBatch.from_arrays([pa.array([b""], pa.binary()), pa.array([int(known.sum())]), pa.array([len(known)])], names)
            held += [ends, pa.RecordBatch.from_arrays([tokens.take(pa.array(some)), pa.array(n[some]), pa.array(n_all[some])], names)]
            if sum(x.num_rows for x in held) > most:
                held = summed(held)
                if sum(x.num_rows for x in held) > most:
                    yield from held
                    held = []
        if held:
            yield from summed(held)

    rows = id_text(docs, id_col, text_col)
    parts = through(rows.select("text", F.coalesce(learn, F.lit(False)).alias("known")), run, "token binary, n long, n_all long")
    return parts.groupBy("token").agg(F.sum("n").alias("n"), F.sum("n_all").alias("n_all"))


def step(u: np.ndarray, h: np.ndarray, g: np.ndarray, out: np.ndarray, hu: np.ndarray) -> np.ndarray:
    """The next state (lanes x HID) into out, what the second gate lets through of the last; g (3 x lanes x HID) becomes gates and candidate."""
    np.matmul(h, u, out=hu)
    zr, n = g[:2], g[2]
    zr += hu[:2]
    np.tanh(zr, out=zr)
    zr *= 0.5
    zr += 0.5
    np.multiply(zr[1], hu[2], out=out)
    n += out
    np.tanh(n, out=n)
    np.subtract(h, n, out=out)
    out *= zr[0]
    out += n
    return hu[2]


def by_word(words: np.ndarray) -> np.ndarray:
    """The order of the words, whose classes are runs; 16 bits are sorted by radix."""
    return np.argsort(words.astype(np.uint16), kind="stable")


def log_softmax(w: np.ndarray, b: np.ndarray, h: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Over w's rows for each row of h, that of its own row; so many at a time as stay near the processor."""
    out = np.empty(len(own), np.float32)
    plain = np.abs(w).sum(axis=1).max() < 60 and np.abs(b).max() < 20  # states are within -1 and 1
    some, rows = np.exp(b), np.arange(1024)
    for lo in range(0, len(own), len(rows)):
        e = w @ h[lo : lo + len(rows)].T
        of, n = own[lo : lo + len(rows)], e.shape[1]
        if not plain:
            e += b[:, None]
            e -= e.max(axis=0)
        out[lo : lo + n] = e.reshape(-1)[of * n + rows[:n]]
        np.exp(e, out=e)
        out[lo : lo + n] -= np.log(some @ e if plain else e.sum(axis=0))
    return out + b[own] if plain else out


def apart(w: np.ndarray) -> np.ndarray:
    """rows x 3 HID -> 3 x rows x HID."""
    return np.ascontiguousarray(w.reshape(len(w), 3, HID).transpose(1, 0, 2))


class Net:
    """Words are numbered so that each class is a run of ids: class 0 is "rest", class 1 the end."""

    def __init__(self, freq: np.ndarray, seed: int = 3):
        rng, v = np.random.default_rng(seed), len(freq)
        words = max(0, v - 2)
        self.edges = np.unique(np.concatenate([[0, 1, 2], 2 + np.round(words * (np.arange(1, CLASSES - 1) / (CLASSES - 2)) ** 1.5).astype(int), [v]]))
        self.edges = self.edges[self.edges <= v]
        self.cls = np.searchsorted(self.edges, np.arange(v), "right") - 1
        log = np.log(freq + 0.5)
        mass = np.array([np.logaddexp.reduce(log[a:b]) for a, b in zip(self.edges[:-1], self.edges[1:])])
        f = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s).astype(np.float32)
        self.p = {"emb": rng.normal(0, 0.3, (v, EMB)).astype(np.float32), "wx": f(EMB, 3 * HID), "bx": np.zeros(3 * HID, np.float32), "u": f(HID, 3 * HID), "wc": f(HID, len(mass)) * 0.1, "bc": (mass - mass.max()).astype(np.float32), "ww": np.zeros((v, HID), np.float32), "bw": (log - mass[self.cls]).astype(np.float32)}

    def copy(self) -> Net:
        """One with weights of its own."""
        own = object.__new__(Net)
        own.edges, own.cls, own.p = self.edges, self.cls, {k: v.copy() for k, v in self.p.items()}
        return own

    def gates(self, words: np.ndarray | slice = slice(None)) -> tuple:
        """What each of the words and each state put into the gates, gate by gate; halves for the two that are squashed by a sigmoid."""
        half = np.float32([0.5, 0.5, 1])[:, None, None]
        table = self.p["emb"][words] @ (apart(self.p["wx"]) * half)
        table += apart(self.p["bx"][None]) * half
        return table, apart(self.p["u"]) * half

    def states(self, h: np.ndarray, inputs: np.ndarray, gates: tuple | None = None) -> np.ndarray:
        """h: lanes x HID; inputs: steps x lanes -> steps x lanes x HID. After an end there is no state behind a word."""
        table, u = gates or self.gates()
        out = np.empty((*inputs.shape, HID), np.float32)
        h0, g, hu = (np.empty((*k, *out.shape[1:]), np.float32) for k in ((), (3,), (3,)))
        for t, x in enumerate(inputs):
            np.multiply(h, (x != END).astype(np.float32)[:, None], out=h0)
            for k in range(3):
                np.take(table[k], x, axis=0, out=g[k], mode="clip")
            step(u, h0, g, out[t], hu)
            h = out[t]
        return out

    def log_prob(self, h: np.ndarray, words: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
        """Natural log of each word's probability after its state, the row of h at its place (or of `at`)."""
        p, order = self.p, by_word(words)
        words, h = words[order], h[order if at is None else at[order]]
        own = log_softmax(np.ascontiguousarray(p["wc"].T), p["bc"], h, self.cls[words])
        ends = np.searchsorted(words, self.edges)
        for k in range(2, len(self.edges) - 1):
            lo, hi, a, b = ends[k], ends[k + 1], self.edges[k], self.edges[k + 1]
            if hi > lo and b - a > 1:
                own[lo:hi] += log_softmax(p["ww"][a:b], p["bw"][a:b], h[lo:hi], words[lo:hi] - a)
        out = np.empty_like(own)
        out[order] = own
        return out

    def score(self, docs: list[np.ndarray]) -> np.ndarray:
        """Natural log-likelihood of each document; its words end with END.

        Documents stand one after the other in lanes, each the longest that is left in the lane with the fewest words.
        """
        total = np.zeros(len(docs))
        if not len(docs):
            return total
        lens = np.array([len(d) for d in docs], np.int64)
        room = [(0, k) for k in range(min(len(docs), max(64, int(lens.sum()) // 1024)))]
        lane = [[] for _ in room]
        for i in np.argsort(-lens, kind="stable").tolist():
            n, k = room[0]
            lane[k].append(i)
            heapq.heapreplace(room, (n + int(lens[i]), k))
        size = np.zeros(len(lane), np.int64)
        size[[k for _, k in room]] = [n for n, _ in room]
        by = np.argsort(-size, kind="stable")
        size, order = size[by], [i for k in by.tolist() for i in lane[k]]
        start = np.cumsum(size) - size
        flat, doc = np.concatenate([docs[i] for i in order]).astype(np.int64), np.repeat(order, lens[order])
        gates, t = self.gates(), 0
        h = np.zeros((len(lane), HID), np.float32)
        while t < size[0]:
            lanes = int(np.searchsorted(-size, -t, "left"))  # those with more than t words
            steps = min(max(STEPS, 16384 // lanes), int(size[0]) - t)
            at = start[:lanes] + t + np.arange(steps)[:, None]
            before = flat[np.minimum(at, len(flat)) - 1]
            if not t:
                before[0] = END
            s = self.states(h[:lanes], before, gates=gates)
            h = s[-1]
            real = np.flatnonzero((t + np.arange(steps)[:, None]) < size[:lanes])
            at = at.reshape(-1)[real]
            total += np.bincount(doc[at], self.log_prob(s.reshape(-1, HID), flat[at], real), len(docs))
            t += steps
        return total

    def train(self, docs: list[np.ndarray], lanes: int = 64, steps: int = 16, passes: int = 2, rate: float = 0.005) -> None:
        """Truncated backpropagation over lanes of whole documents; each starts from no state.

        Lanes are of one length; the last is filled with the first words again.
        """
        rng = np.random.default_rng(5)
        sizes = {k: v.size for k, v in self.p.items()}
        flat_p = np.concatenate([v.ravel() for v in self.p.values()])
        flat_g, m1, m2, n = np.zeros_like(flat_p), np.zeros_like(flat_p), np.zeros_like(flat_p), 0
        ends = np.cumsum([0, *sizes.values()])
        view = lambda a: {k: a[lo:hi].reshape(v.shape) for (k, v), lo, hi in zip(shapes.items(), ends[:-1], ends[1:])}
        shapes = self.p
        p, grad = view(flat_p), view(flat_g)
        self.p = p
        two = np.empty(24_000, np.float32)
        for turn in range(passes):
            order = rng.permutation(len(docs))
            flat = np.concatenate([docs[i] for i in order]).astype(np.int64)
            lanes = max(1, min(lanes, len(flat) // (4 * steps)))
            long = -(-len(flat) // lanes)
            if not long:
                return
            words = np.ascontiguousarray(np.resize(flat, lanes * long).reshape(lanes, long).T)
            before = np.concatenate([np.full((1, lanes), END), words[:-1]])
            h, hu = np.zeros((lanes, HID), np.float32), np.empty((3, lanes, HID), np.float32)
            for t in range(0, long, steps):
                w, x = words[t : t + steps], before[t : t + steps].reshape(-1)
                size = len(w), lanes, HID
                go = (x != END).astype(np.float32).reshape(len(w), lanes, 1)  # a document's first word has no state behind it
                at = by_word(x)
                new = np.diff(x[at], prepend=-1) > 0
                first, place = np.flatnonzero(new), np.empty(len(at), np.int64)
                place[at] = np.cumsum(new) - 1
                own = x[at[first]]  # x is own[place]
                table, u = self.gates(own)
                gates = np.empty((3, *size), np.float32)
                for k in range(3):
                    np.take(table[k], place, axis=0, out=gates[k].reshape(-1, HID), mode="clip")
                s, h0, hm = (np.empty(size, np.float32) for _ in range(3))
                for i in range(len(w)):
                    np.multiply(h, go[i], out=h0[i])
                    hm[i] = step(u, h0[i], gates[:, i], s[i], hu)
                    h = s[i]
                ds = self._output_gradient(s.reshape(-1, HID), w.reshape(-1), grad).reshape(size)
                z, r, c = gates
                # the factors of a state's gradient for the gated state, the two gates and the candidate, for all steps at once
                by, some = np.empty((4, *size), np.float32), np.empty(size, np.float32)
                np.subtract(1, z, out=some)
                np.multiply(c, c, out=by[3])
                np.subtract(1, by[3], out=by[3])
                by[3] *= some
                np.multiply(by[3], r, out=by[0])
                np.subtract(h0, c, out=by[1])
                by[1] *= z
                by[1] *= some
                np.subtract(1, r, out=some)
                some *= hm
                np.multiply(by[0], some, out=by[2])
                z *= go
                dh, u = np.zeros((lanes, HID), np.float32), np.ascontiguousarray(apart(p["u"])[[2, 0, 1]].transpose(0, 2, 1))
                for i in range(len(w) - 1, -1, -1):
                    dh += ds[i]
                    by[:, i] *= dh
                    dh *= z[i]
                    np.matmul(by[:3, i], u, out=hu)
                    hu[0] += hu[1]
                    hu[0] += hu[2]
                    hu[0] *= go[i]
                    dh += hu[0]
                # products step by step, which are quicker than one over all rows
                grad["u"].reshape(HID, 3, HID)[:, [2, 0, 1]] = (h0.transpose(0, 2, 1) @ by[:3]).sum(axis=1).transpose(1, 0, 2)
                emb = np.ones((len(w), lanes, EMB + 1), np.float32)  # the last column meets the biases
                emb[:, :, :-1] = p["emb"][x.reshape(len(w), lanes)]
                both = (emb.transpose(0, 2, 1) @ by[1:]).sum(axis=1).transpose(1, 0, 2).reshape(EMB + 1, -1)
                grad["wx"][...], grad["bx"][...] = both[:-1], both[-1]
                to_word = by[1:].reshape(3, -1, HID) @ apart(p["wx"]).transpose(0, 2, 1)
                to_word[0] += to_word[1]
                to_word[0] += to_word[2]
                grad["emb"][...] = 0
                grad["emb"][own] = np.add.reduceat(to_word[0][at], first, axis=0)
                n += 1
                now = rate * (1 - 0.8 * (turn * long + t) / (passes * long))
                # m1, m2: running sums of the gradient and of its square; so many weights at a time as stay near the processor
                to = np.sqrt(0.01 / (1 - 0.99**n))
                by, least = np.float32(now * 0.1 / (1 - 0.9**n) / to), np.float32(1e-8 / to)
                for lo in range(0, len(flat_p), len(two)):
                    fp, fg, f1, f2 = (f[lo : lo + len(two)] for f in (flat_p, flat_g, m1, m2))
                    some = two[: len(fp)]
                    f1 *= 0.9
                    f1 += fg
                    np.multiply(fg, fg, out=some)
                    f2 *= 0.99
                    f2 += some
                    np.sqrt(f2, out=some)
                    some += least
                    np.divide(f1, some, out=some)
                    some *= by
                    fp -= some
        self.p = {k: v.copy() for k, v in p.items()}

    def _output_gradient(self, h: np.ndarray, words: np.ndarray, g: dict) -> np.ndarray:
        """That of the states; those of the output's weights go into g."""
        p, order, each, n = self.p, by_word(words), np.float32(1 / len(words)), len(words)
        words, row, classes, v = words[order], np.arange(n), len(p["bc"]), len(p["bw"])
        cls = self.cls[words]
        # rows of states, once for the classes and once for the words within them; the last column meets the biases
        hs = np.ones((2, n, HID + 1), np.float32)
        hs[:, :, :-1] = h[order]
        hs = hs.reshape(2 * n, -1)
        top = np.empty((classes + v, HID + 1), np.float32)
        top[:classes, :-1], top[:classes, -1], top[classes:, :-1], top[classes:, -1] = p["wc"].T, p["bc"], p["ww"], p["bw"]
        # a block for the classes and one for each class, one after the other in one buffer
        size, ends = np.diff(self.edges), np.searchsorted(words, self.edges)
        some = np.diff(ends)
        cells = np.where((np.arange(len(size)) >= 2) & (size > 1), size * some, 0)
        start = classes * n + np.cumsum(cells) - cells
        flat = np.empty(classes * n + int(cells.sum()), np.float32)
        blocks = [(flat[: classes * n].reshape(classes, n), slice(0, n), slice(0, classes))]
        for k in np.flatnonzero(cells).tolist():
            lo, a, b = int(start[k]), int(ends[k]), int(ends[k + 1])
            blocks.append((flat[lo : lo + (b - a) * int(size[k])].reshape(-1, b - a), slice(n + a, n + b), slice(classes + int(self.edges[k]), classes + int(self.edges[k + 1]))))
        for e, at, own in blocks:
            np.matmul(top[own], hs[at].T, out=e)
        if max(flat.max(), -flat.min()) > 60:
            for e, _, _ in blocks:
                e -= e.max(axis=0)
        np.exp(flat, out=flat)
        # sums and gradients from powers that are not yet divided by their sum: the states' rows are, instead
        back = np.zeros((2 * n, HID + 1), np.float32)
        top[:, -1] = 1
        for e, at, own in blocks:
            np.matmul(e.T, top[own], out=back[at])
        total = back[:, -1].copy()
        inner = np.flatnonzero(cells[cls])
        by = np.zeros((2 * n, 1), np.float32)
        np.divide(each, total[:, None], out=by, where=total[:, None] > 0)
        back *= by
        hs *= by
        flat[cls * n + row] -= total[:n]
        k = cls[inner]
        flat[start[k] + (words[inner] - self.edges[k]) * some[k] + inner - ends[k]] -= total[n + inner]
        both = np.zeros_like(top)
        for e, at, own in blocks:
            np.matmul(e, hs[at], out=both[own])
        g["wc"][...], g["bc"][...], g["ww"][...], g["bw"][...] = both[:classes, :-1].T, both[:classes, -1], both[classes:, :-1], both[classes:, -1]
        top *= each
        back[:n] -= top[cls]
        back[n + inner] -= top[classes + words[inner]]
        out = np.empty((n, HID), np.float32)
        out[order] = back[:n, :-1] + back[n:, :-1]
        return out


class Scorer:
    """What each task needs: the commonest tokens with their counts, and the network."""

    def __init__(self, top: list[tuple[bytes, int]], tokens: int, types: int):
        self.n, self.types = tokens, types
        rest = sorted((t for t in top if t[0] != b"" and t[1] > 0), key=lambda t: (-t[1], t[0]))
        short, tail = rest[:SHORT], rest[SHORT:] + [t for t in top if t[0] != b"" and t[1] <= 0]
        end = next((c for t, c in top if t == b""), 0)
        self.slot = {t: i for i, (t, _) in enumerate(short + tail, 2)}
        self.counts = np.array([0, end, *[c for _, c in short], *[c for _, c in tail]], float)
        self.known = self.counts > 0
        self.words = 2 + len(short)
        in_short = end + sum(c for _, c in short)
        self.base_bottom = tokens + 0.1 * (types + 1)
        self.rest_bottom = tokens - in_short + 0.1 * max(0, types - len(short) - bool(end)) + 0.1
        self.net = Net(np.concatenate([[max(1.0, tokens - in_short)], self.counts[1 : self.words]])) if tokens else None

    def ids(self, tokens: list[bytes]) -> np.ndarray:
        """Place among the commonest tokens or -1; the last is the end."""
        get = self.slot.get
        out = np.fromiter(map(get, tokens, repeat(-1)), np.int32, len(tokens))
        return np.append(out, np.int32(END))

    def for_net(self, ids: np.ndarray) -> np.ndarray:
        return np.where((ids < 0) | (ids >= self.words), REST, ids)

    def packed(self, ids: np.ndarray) -> bytes:
        """The network's words in 16 bits each."""
        return self.for_net(ids).astype("<u2").tobytes()


def learn_more(scorer: Scorer, rows: DataFrame, share: int = 1, chars_a_part: int = 4_000_000, rate: float = 0.002) -> None:
    """Train the network on all rows (h, text), or on those whose hash falls into one part of `share`, repeated rows once.

    Parts hold about chars_a_part characters, or one longer document; their texts are moved as the network's words,
    and rows can hold these already (h, chars, ids, as `encode` gives them).
    Of each only the weights come back, as one row; as many tasks as the square root of the parts add these up one by one,
    so the driver gets no more networks than that.
    """
    if share > 1:
        rows = rows.where(F.pmod(F.xxhash64("h"), F.lit(share)) == 0)
    parts = -(-(rows.agg(F.sum("chars" if "ids" in rows.columns else F.length("text"))).first()[0] or 0) // chars_a_part)
    if not parts:
        return
    context, order = rows.sparkSession.sparkContext, sorted(scorer.net.p)
    box = context.broadcast(scorer.net)
    if "ids" not in rows.columns:
        words = context.broadcast(scorer)

        def to_words(batches):
            import pyarrow as pa

            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([words.value.packed(words.value.ids(tokens_of(t.as_py()))) for t in b.column(1)], pa.binary())], ["h", "ids"])

        rows = through(rows.select("h", "text"), to_words, "h long, ids binary")

    def run(table):
        import pyarrow as pa

        by = np.unique(table.column("h").to_numpy(), return_index=True)[1]
        docs = [np.frombuffer(i.as_py(), "<u2") for i in table.column("ids").take(pa.array(by))]
        net, n = box.value.copy(), sum(map(len, docs))
        net.train(docs, lanes=128, passes=1, rate=rate)
        flat = np.concatenate([*(net.p[k].ravel() for k in order), [1]]).astype(float) * n
        give_back()
        return pa.table({"part": table.column("part")[:1], "weights": pa.array([flat.tobytes()], pa.binary())})

    def added(batches):
        import pyarrow as pa

        total = 0
        for b in batches:
            for w in b.column(0):
                total = total + np.frombuffer(w.as_buffer())
        if np.size(total) > 1:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["weights"])

    dealt = rows.select("h", "ids", F.pmod("h", F.lit(parts)).alias("part")).repartition(parts, "part")
    learned = dealt.groupBy("part").applyInArrow(run, "part long, weights binary").repartition(1 + math.isqrt(parts), "part")
    flat = sum(np.frombuffer(r.weights) for r in cut(through(learned.select("weights"), added, "weights binary"), "lm-weights").collect())
    box.unpersist()
    flat = (flat[:-1] / flat[-1]).astype(np.float32)
    ends = np.cumsum([scorer.net.p[k].size for k in order])
    scorer.net.p = {k: w.reshape(scorer.net.p[k].shape) for k, w in zip(order, np.split(flat, ends[:-1]))}


def vocabulary(counts: DataFrame, most_top: int = 200_000) -> Scorer:
    """The commonest tokens with their counts, and a network that has learned nothing yet."""
    n = counts.where("n > 0").agg(F.sum("n"), F.count("*")).first()
    top = [(bytes(r.token), r.n) for r in commonest(counts, "n_all", most_top).select("token", "n").collect()]
    return Scorer(top, n[0] or 0, n[1])


def begin(scorer: Scorer, rows: DataFrame, most_docs: int = 3000, most_chars: int = 20_000) -> None:
    """Train the network from its start on about `most_docs` rows of up to `most_chars` characters, those whose hash
    falls into one part of so many. Rows are those of `learn_more`: (h, text), or (h, chars, ids) as `encode` gives them."""
    ready = "ids" in rows.columns
    short = rows.where((F.col("chars") if ready else F.length("text")) <= most_chars)
    part = max(1, -(-short.count() // most_docs))
    sample = sorted(short.where(F.pmod("h", F.lit(part)) == 0).dropDuplicates(["h"]).select("h", "ids" if ready else "text").collect())
    docs = [np.frombuffer(r.ids, "<u2") if ready else scorer.for_net(scorer.ids(tokens_of(r.text))) for r in sample]
    scorer.net.train(docs or [np.array([END])])


def fit(docs: DataFrame, counts: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", most_top: int = 200_000, most_docs: int = 3000, most_chars: int = 20_000, share: int = 1) -> Scorer:
    """The network starts from about `most_docs` training documents of up to `most_chars` characters, those
    whose hash falls into one part of so many, and goes on with all training documents, whole; repeated rows
    once. With a `share` above 1 it goes on with one in so many, the same ones each time, and with 0 with none."""
    scorer = vocabulary(counts, most_top)
    if scorer.net:
        rows = id_text(docs, id_col, text_col).where(learn & F.col("text").isNotNull()).select(F.xxhash64("doc_id", "text").alias("h"), "text")
        begin(scorer, rows, most_docs, most_chars)
        if share:
            learn_more(scorer, rows, share)
    return scorer


ROWS = "doc_id long, held_out boolean, learn boolean, h long, chars long, n_tokens long, n_known long, base double, score double, rare array<binary>, ids binary"


def names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def encode(docs: DataFrame, scorer: Scorer, held_out: Column, learn: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document, written once: its network's words, what the counts alone say of it, and its tokens that are
    not among the commonest."""
    box = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(batches):
        import pyarrow as pa

        import pyarrow.compute as pc

        s = box.value
        top = pa.array(list(s.slot), pa.binary())
        slots = np.append(np.fromiter(s.slot.values(), np.int32, len(s.slot)), np.int32(-1))
        # by slot, the last for tokens that are not among the commonest
        log, known = np.append(np.log10(s.counts + 0.1), 0), np.append(s.known, False)
        short = s.for_net(np.append(np.arange(len(s.counts)), -1)).astype("<u2")
        for b in batches:
            tokens, codes, size = cut_up(b.column(1))
            size = size + 1
            start = np.cumsum(size) - size
            place = pc.fill_null(pc.index_in(tokens, top), len(s.slot)).to_numpy()
            word = np.ones(int(size.sum()), bool)
            word[start + size - 1] = False
            i = np.full(len(word), END, np.int32)
            i[word] = slots[place][codes]
            add = lambda x: np.add.reduceat(x, start) if len(x) else np.zeros(0, x.dtype)
            each = log[i]
            base = add(each) - add((i >= 0).astype(np.int64)) * np.log10(s.base_bottom)
            tail = i >= s.words
            shared = add(np.where(tail, each, 0)) - add(tail.astype(np.int64)) * np.log10(s.rest_bottom) if s.net else base
            other = i < 0
            ends = np.append(0, np.cumsum(add(other.astype(np.int64))))
            rare = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), tokens.take(pa.array(codes[other[word]])))
            bounds = np.append(0, 2 * np.cumsum(size)).astype(np.int32)
            ids = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(bounds), pa.py_buffer(short[i])])
            new = [pa.array(size, pa.int64()), pa.array(add(known[i].astype(np.int64))), pa.array(base), pa.array(shared), rare, ids]
            yield pa.RecordBatch.from_arrays([b.column(0), *b.columns[2:], *new], names(ROWS))

    rows = id_text(docs, id_col, text_col, held_out=held_out, learn=F.coalesce(learn, F.lit(False)))
    rows = rows.select("doc_id", "text", "held_out", "learn", F.xxhash64("doc_id", "text").alias("h"), F.length("text").cast("long").alias("chars"))
    return cut(through(rows, run, ROWS).withColumn("row", F.monotonically_increasing_id()), "lm-rows")


def score(docs: DataFrame, counts: DataFrame, scorer: Scorer, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: the columns of the contract."""
    return score_rows(encode(docs, scorer, held_out, F.lit(False), id_col, text_col), counts, scorer)


def score_rows(rows: DataFrame, counts: DataFrame, scorer: Scorer) -> DataFrame:
    """The columns of the contract for the rows of `encode`."""
    box = rows.sparkSession.sparkContext.broadcast(scorer.net)

    def run(batches):
        import pyarrow as pa

        from quillon.llm.tokens import chunks

        for b in batches:
            docs = [i.as_py() for i in b.column("ids")]
            size = sum(map(len, docs))
            # chunks of about one size: a small last one would have few lanes
            for lo, hi in chunks(docs, size / max(1, -(-size // 2_600_000)) + max(map(len, docs), default=0)):
                part = b.slice(lo, hi - lo)
                net = box.value.score([np.frombuffer(i, "<u2") for i in docs[lo:hi]]) / np.log(10) if box.value else 0
                all_ = part.column("score").to_numpy() + net
                yield pa.RecordBatch.from_arrays([*part.columns[:-2], pa.array(all_)], part.schema.names[:-1])

    keep = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double"
    scored = through(rows.select(*names(keep), "ids"), run, keep)
    # only the tokens that are not among the commonest meet the whole table
    rare = rows.select("row", F.explode("rare").alias("token")).join(counts.where("n > 0").select("token", "n"), "token", "left")
    n = F.coalesce(F.col("n"), F.lit(0))
    sums = rare.groupBy("row").agg(F.count("*").alias("r"), F.sum((n > 0).cast("long")).alias("r_known"), F.sum(F.log10(n + 0.1)).alias("r_log"))
    rest = scorer.rest_bottom if scorer.net else scorer.base_bottom
    bottom = lambda x: F.coalesce(F.col("r_log") - F.col("r") * F.lit(float(np.log10(x))), F.lit(0.0))
    return scored.join(sums, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("r_known", F.lit(0))).alias("n_known"), F.lit(scorer.n).cast("long").alias("train_tokens"),
        (F.col("base") + bottom(scorer.base_bottom)).alias("base_score"), (F.col("score") + bottom(rest)).alias("score"),
    )


def run(docs: DataFrame, learn: Column, held_out: Column, share: int = 1, most_top: int = 200_000, **bounds) -> DataFrame:
    """As `fit` and `score`, but texts are cut into tokens once for both."""
    counts = cut(count(docs, learn), "lm-counts")
    scorer = vocabulary(counts, most_top)
    rows = encode(docs, scorer, held_out, learn)
    if scorer.net:
        known = rows.where("learn and chars is not null")
        begin(scorer, known, **bounds)
        if share:
            learn_more(scorer, known, share)
    return score_rows(rows, counts, scorer)
