"""A character-level bidirectional LSTM with CRF transitions, in numpy.

Signs come as small integers, 0 is padding behind a window. A sign goes in as the
sum of three short vectors: its own and those that its two neighbours have for this
place. Both directions run in one loop: arrays are laid out (direction, unit,
window), so every gate is one contiguous block and all gates take one tanh. The
two states of a position give the scores of the tags. The CRF lets a span of one
kind touch the outside only: O to O, O to k, k to k and k to O have learned
weights, other steps don't exist. Training minimizes the negative log likelihood
of whole windows with Adam; decoding is Viterbi.
"""

from __future__ import annotations

import numpy as np

FAR = np.float32(-1e4)
#: Length of the vectors of signs.
EMBED = 16
#: Places whose vectors are put together at once; so many stay in a CPU's cache.
BLOCK = 32


class Tagger:
    def __init__(self, signs: int, kinds: int, hidden: int = 24, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.signs, self.kinds, self.hidden = signs, kinds, hidden
        n = hidden
        gates = rng.normal(0, 0.5, (2, 4 * n, n + EMBED + 1))
        gates[:, :, :n] = rng.normal(0, 0.5 / np.sqrt(n), (2, 4 * n, n))
        gates[:, :, -1] = 0
        gates[:, n : 2 * n, -1] = 0.5  # gates keep at first
        self.p = {
            "near": rng.normal(0, 0.3, (3, signs, EMBED)),  # of the sign before, the sign itself, the sign behind
            "gates": gates,  # in, keep, out, new; the last column is the bias
            "out": rng.normal(0, 0.2, (kinds + 1, 2 * n)),
            "bias": np.array([1.0, *[0.0] * kinds]),
            "cross": np.array([[0.5, -2.0, 0.5, -0.5]] * kinds),  # of each kind: O to k, k to k, k to O; last: O to O
        }
        self.p["near"][:, 0] = 0
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self._rooms: dict[str, np.ndarray] = {}

    # ---- the network

    def _room(self, name: str, shape: tuple[int, ...], kind: np.dtype) -> np.ndarray:
        """An array whose memory the next call for this name gets again; new memory costs more than what is written to it."""
        size = int(np.prod(shape))
        held = self._rooms.get(name)
        if held is None or held.size < size or held.dtype != kind:
            held = self._rooms[name] = np.empty(size, kind)
        return held[:size].reshape(shape)

    def _inputs(self, x: np.ndarray, out: np.ndarray) -> np.ndarray:
        """(T, EMBED, B) of signs x (T, B), in `out`; padding and what is beyond the window's ends count nothing."""
        near, steps = self.p["near"], len(x)
        for at in range(0, steps, BLOCK):
            to = min(at + BLOCK, steps)
            first, last = max(at, 1), min(to, steps - 1)
            e = near[1].take(x[at:to], 0)
            e[first - at :] += near[0].take(x[first - 1 : to - 1], 0)
            e[: last - at] += near[2].take(x[at + 1 : last + 1], 0)
            out[at:to] = e.transpose(0, 2, 1)
        return out

    def _states(self, x: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """States (T, 2, H, B) of signs x (T, B), which last until the next call; `keep` gets what the gradient needs."""
        steps, width = x.shape
        n, gates = self.hidden, self.p["gates"]
        kind = gates.dtype
        room = self._room if keep is None else lambda _, shape, kind: np.empty(shape, kind)
        e = self._inputs(x, room("inputs", (steps, EMBED, width), kind))
        into = np.zeros((2, n + EMBED + 1, width), kind)
        into[:, -1] = 1
        c, bent = np.zeros((2, n, width), kind), np.empty((2, n, width), kind)
        z = np.empty((2, 4 * n, width), kind)
        h = into[:, :n]
        i, f, o, g, three = z[:, :n], z[:, n : 2 * n], z[:, 2 * n : 3 * n], z[:, 3 * n :], z[:, : 3 * n]
        out = room("states", (steps, 2, n, width), kind)
        pads = x == 0
        padded = pads.any(1).tolist()
        if keep is not None:
            keep.update(z=np.empty((steps, 2, 4 * n, width), kind), c=np.empty((steps, 2, n, width), kind), bent=np.empty((steps, 2, n, width), kind), into=np.empty((steps, 2, n + EMBED + 1, width), kind))
        for t in range(steps):
            back = steps - 1 - t
            into[0, n:-1], into[1, n:-1] = e[t], e[back]
            if keep is not None:
                keep["into"][t], keep["c"][t] = into, c
            np.matmul(gates, into, out=z)
            np.tanh(z, out=z)
            three += 1
            c *= f
            np.multiply(i, g, out=bent)
            c += bent
            c *= 0.5
            np.tanh(c, out=bent)
            np.multiply(o, bent, out=h)
            if keep is not None:
                keep["z"][t], keep["bent"][t] = z, bent
            if padded[back]:
                # a window starts afresh at its own end, whatever it is batched with
                h[1, :, pads[back]] = 0
                c[1, :, pads[back]] = 0
            out[t, 0], out[back, 1] = h[0], h[1]
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Scores (T, 1 + kinds, B) of the tags; tag 0 is outside."""
        states = self._states(x)
        out = np.matmul(self.p["out"], states.reshape(len(x), 2 * self.hidden, -1))
        out += self.p["bias"][:, None]
        return out

    def decode(self, x: np.ndarray) -> np.ndarray:
        """The best tags (T, B)."""
        return self.viterbi(self.scores(x), x == 0)

    def moves(self) -> np.ndarray:
        """(from, to) weights of all steps; those that don't exist are far below."""
        cross, tags = self.p["cross"], self.kinds + 1
        move = np.full((tags, tags), FAR, cross.dtype)
        move[0, 0] = cross[:, 3].sum()
        for k in range(self.kinds):
            move[0, k + 1], move[k + 1, k + 1], move[k + 1, 0] = cross[k, :3]
        return move

    def open_places(self, scores: np.ndarray, reach: int = 16) -> np.ndarray:
        """Where the best path for scores (1 + kinds, N) may be inside a span; everywhere else it is surely outside.

        The path must be outside at both ends. Let a sign's gain be what it adds inside a
        span of a kind against outside. In the best path a span can't be made better by
        leaving it earlier, entering it later or breaking it in two. So a sign is outside
        if every stretch of up to `reach` signs that begins or ends with it loses, and the
        stretch of `reach` signs on either side loses more than a break costs.
        Gains are taken from the kind that has most at each sign, which can only leave more open.
        """
        into, stay, leave = (self.p["cross"][:, i].astype(np.float64) for i in range(3))
        quiet = float(self.p["cross"][:, 3].sum())
        whole = into + leave - stay - quiet  # what a span gains besides its signs
        size = scores.shape[1]
        gain = scores[1] + np.float32(stay[0])
        for k in range(1, self.kinds):
            np.maximum(gain, scores[k + 1] + np.float32(stay[k]), out=gain)
        gain -= scores[0]
        gain -= np.float32(quiet)
        total = np.zeros(size + 2 * reach + 1)
        np.cumsum(gain, dtype=np.float64, out=total[reach + 1 : reach + 1 + size])
        total[reach + 1 + size :] = total[reach + size]
        most, least, width = total, total, 1  # of `width` sums from a place on
        while width < reach:
            most, least, width = np.maximum(most[:-width], most[width:]), np.minimum(least[:-width], least[width:]), 2 * width
        now = slice(reach + 1, reach + 1 + size)
        ahead = most[now.start : now.start + size] - total[now.start - 1 : now.stop - 1]
        behind = total[now] - least[now.start - width : now.start - width + size]
        across = total[now.start + reach : now.stop + reach] - total[now.start - reach - 1 : now.stop - reach - 1]
        least_gain = -1e-3 - max(whole.max(), 0.0)
        return (ahead >= least_gain) | (behind >= least_gain) | (across >= min(whole.min(), 0.0) - 1e-3)

    def viterbi(self, scores: np.ndarray, pads: np.ndarray) -> np.ndarray:
        """The best tags (T, B) for scores (T, 1 + kinds, B); `pads` marks what lies behind the ends."""
        e = scores
        steps, _, width = e.shape
        into, stay, leave = (self.p["cross"][:, i, None] for i in range(3))
        quiet = self.p["cross"][:, 3].sum()
        best_o, best_k = np.empty((steps, width), np.float32), np.empty((steps, self.kinds, width), np.float32)
        best_o[0], best_k[0] = e[0, 0], e[0, 1:]
        left, come, top = np.empty((self.kinds, width), np.float32), np.empty((self.kinds, width), np.float32), np.empty(width, np.float32)
        padded = pads.any(1)
        for t in range(1, steps):
            o, k = best_o[t - 1], best_k[t - 1]
            np.add(k, leave, out=left)
            np.maximum.reduce(left, 0, out=top)
            np.add(o, quiet, out=best_o[t])
            np.maximum(best_o[t], top, out=best_o[t])
            best_o[t] += e[t, 0]
            np.add(o, into, out=come)
            np.add(k, stay, out=best_k[t])
            np.maximum(best_k[t], come, out=best_k[t])
            best_k[t] += e[t, 1:]
            if padded[t]:
                m = pads[t]
                best_o[t, m], best_k[t][:, m] = o[m], k[:, m]
        tags = np.empty((steps, width), np.int8)
        tag = np.concatenate([best_o[-1:], best_k[-1]]).argmax(0)
        tags[-1] = tag
        for t in range(steps - 1, 0, -1):
            o, k = best_o[t - 1], best_k[t - 1]
            inside = np.flatnonzero(tag)
            new = np.zeros(width, np.int64)
            if len(inside):
                kind = tag[inside] - 1
                new[inside] = np.where(k[kind, inside] + stay[kind, 0] > o[inside] + into[kind, 0], tag[inside], 0)
            np.add(k, leave, out=left)
            from_k = (tag == 0) & (left.max(0) > o + quiet)
            if from_k.any():
                new[from_k] = left[:, from_k].argmax(0) + 1
            if padded[t]:
                new = np.where(pads[t], tag, new)  # behind its end a window waits with the tag it ended in
            tag = new
            tags[t - 1] = tag
        return tags

    # ---- training

    def loss(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood a window, and its gradients. Padding must be labelled 0."""
        n, p = self.hidden, self.p
        keep: dict = {}
        states = self._states(x, keep)
        steps, width = x.shape
        both = states.reshape(steps, 2 * n, width)
        e = np.matmul(p["out"], both) + p["bias"][:, None]
        pads = x == 0
        if pads.any():
            e.transpose(0, 2, 1)[pads] = [0, *[-30] * self.kinds]
        grad_e, grad_move, value = self._crf(e, y)
        grad_e.transpose(0, 2, 1)[pads] = 0
        grad = {k: np.zeros_like(v) for k, v in p.items()}
        grad["out"] = np.matmul(grad_e, both.transpose(0, 2, 1)).sum(0)
        grad["bias"] = grad_e.sum((0, 2))
        for k in range(self.kinds):
            grad["cross"][k] = grad_move[0, k + 1], grad_move[k + 1, k + 1], grad_move[k + 1, 0], grad_move[0, 0]
        down = np.matmul(p["out"].T, grad_e).reshape(steps, 2, n, width)
        table = p["gates"].transpose(0, 2, 1)
        dh, dc = np.zeros((2, n, width), e.dtype), np.zeros((2, n, width), e.dtype)
        da = np.empty((2, 4 * n, width), e.dtype)
        de = np.zeros((steps, EMBED, width), e.dtype)
        padded = pads.any(1)
        for t in range(steps - 1, -1, -1):
            back = steps - 1 - t
            dh[0] += down[t, 0]
            dh[1] += down[back, 1]
            if padded[back]:
                dh[1, :, pads[back]] = 0
                dc[1, :, pads[back]] = 0
            z, bent = keep["z"][t], keep["bent"][t]
            i, f, o, g = z[:, :n], z[:, n : 2 * n], z[:, 2 * n : 3 * n], z[:, 3 * n :]
            dc += dh * o * (1 - bent * bent)
            dc *= 0.5
            np.multiply(dc * g, i * (2 - i), out=da[:, :n])
            np.multiply(dc * keep["c"][t], f * (2 - f), out=da[:, n : 2 * n])
            np.multiply(dh * bent, o * (2 - o), out=da[:, 2 * n : 3 * n])
            np.multiply(dc * i, 1 - g * g, out=da[:, 3 * n :])
            grad["gates"] += np.matmul(da, keep["into"][t].transpose(0, 2, 1))
            up = np.matmul(table, da)
            dh = up[:, :n]
            dc *= f
            de[t] += up[0, n:-1]
            de[back] += up[1, n:-1]
        flat = de.transpose(0, 2, 1)
        for j, (signs, part) in enumerate(((x[:-1], flat[1:]), (x, flat), (x[1:], flat[:-1]))):
            signs = signs.ravel()
            for c in range(EMBED):
                grad["near"][j, :, c] = np.bincount(signs, part[:, :, c].ravel(), self.signs)
        grad["near"][:, 0] = 0
        return value, grad

    def _crf(self, e: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Gradients by scores and moves, and the mean loss; scaled sums of products instead of logarithms."""
        steps, tags, width = e.shape
        move = self.moves()
        step = np.exp(move)
        top = e.max(1, keepdims=True)
        chance = np.exp(e - top)
        fore, back = np.empty_like(e), np.empty_like(e)
        scale = np.empty((steps, width), e.dtype)
        now = chance[0]
        for t in range(steps):
            if t:
                now = (step.T @ fore[t - 1]) * chance[t]
            scale[t] = now.sum(0)
            np.divide(now, scale[t], out=fore[t])
        back[-1] = 1
        for t in range(steps - 2, -1, -1):
            back[t] = (step @ (back[t + 1] * chance[t + 1])) / scale[t + 1]
        whole = np.log(scale).sum(0) + top.sum((0, 1))
        column = y[:, None, :].astype(np.int64)
        gold = np.take_along_axis(e, column, 1).sum((0, 1)) + move[y[:-1], y[1:]].sum(0)
        grad = fore * back
        np.put_along_axis(grad, column, np.take_along_axis(grad, column, 1) - 1, 1)
        ahead = back[1:] * chance[1:] / scale[1:, None, :]
        pairs = step * np.matmul(fore[:-1], ahead.transpose(0, 2, 1)).sum(0)
        np.subtract.at(pairs, (y[:-1].ravel(), y[1:].ravel()), 1)
        return grad / width, pairs / width, float((whole - gold).mean())

    def fit(self, windows, epochs: int = 10, batch: int = 64, rate: float = 0.01, seed: int = 3, workers: int = 1, say=None) -> list[float]:
        """Trains on (signs, tags) of windows, those of like length together; the rate falls to a twentieth. Returns the mean losses.

        With several workers each of them takes its share of every batch.
        """
        rng = np.random.default_rng(seed)
        lengths = np.array([len(x) for x, _ in windows])
        step, total, losses = 0, epochs * -(-len(windows) // batch), []
        m = {k: np.zeros_like(w) for k, w in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        with _Team(self, windows, workers) as team:
            for epoch in range(epochs):
                order = np.argsort(lengths + rng.uniform(0, 8, len(lengths)))
                groups = [order[at : at + batch] for at in range(0, len(order), batch)]
                sums = []
                for g in rng.permutation(len(groups)):
                    value, grad = team.loss(groups[g])
                    sums.append(value)
                    norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
                    step += 1
                    now = rate * (0.05 + 0.95 * 0.5 * (1 + np.cos(np.pi * step / total))) * min(1, step / 50)
                    for k, g in grad.items():
                        g = g * min(1.0, 5.0 / (norm + 1e-9))
                        m[k] = 0.9 * m[k] + 0.1 * g
                        v[k] = 0.999 * v[k] + 0.001 * g * g
                        self.p[k] -= (now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
                losses.append(float(np.mean(sums)))
                if say:
                    say(f"epoch {epoch + 1}: loss {losses[-1]:.4f}")
        return losses

    def loss_of(self, windows, rows) -> tuple[float, dict[str, np.ndarray]]:
        x = np.zeros((max(len(windows[r][0]) for r in rows), len(rows)), np.int64)
        y = np.zeros_like(x)
        for i, r in enumerate(rows):
            signs, tags = windows[r]
            x[: len(signs), i], y[: len(tags), i] = signs, tags
        return self.loss(x, y)

    # ---- files

    def save(self, path: str) -> None:
        np.savez_compressed(path, shape=np.array([self.signs, self.kinds, self.hidden]), **{k: v.astype(np.float16) for k, v in self.p.items()})

    @classmethod
    def load(cls, source) -> Tagger:
        """From a path or an open file."""
        with np.load(source) as held:
            signs, kinds, hidden = map(int, held["shape"])
            made = cls(signs, kinds, hidden)
            made.p = {k: held[k].astype(np.float32) for k in made.p}
        return made


class _Team:
    """Processes that each hold the windows and give the gradients of their share of a batch."""

    def __init__(self, tagger: Tagger, windows, workers: int):
        self.tagger, self.windows, self.number = tagger, windows, workers
        self.pipes, self.processes = [], []

    def __enter__(self) -> _Team:
        import multiprocessing

        context = multiprocessing.get_context("fork")
        for _ in range(self.number if self.number > 1 else 0):
            here, there = context.Pipe()
            process = context.Process(target=self._serve, args=(there,), daemon=True)
            process.start()
            self.pipes.append(here)
            self.processes.append(process)
        return self

    def _serve(self, pipe) -> None:
        while (job := pipe.recv()) is not None:
            self.tagger.p, rows = job
            pipe.send(self.tagger.loss_of(self.windows, rows))

    def loss(self, rows: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        if not self.pipes:
            return self.tagger.loss_of(self.windows, rows)
        shares = [s for s in np.array_split(rows, len(self.pipes)) if len(s)]
        for pipe, share in zip(self.pipes, shares, strict=False):
            pipe.send((self.tagger.p, share))
        got = [pipe.recv() for pipe, _ in zip(self.pipes, shares, strict=False)]
        weights = [len(s) / len(rows) for s in shares]
        return sum(w * g[0] for w, g in zip(weights, got, strict=True)), {k: sum(w * g[1][k] for w, g in zip(weights, got, strict=True)) for k in self.tagger.p}

    def __exit__(self, *_) -> None:
        for pipe, process in zip(self.pipes, self.processes, strict=True):
            pipe.send(None)
            process.join()
