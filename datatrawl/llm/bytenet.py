"""A byte-level convolutional network in numpy, shared by language ID and the quality classifier.

A window of bytes becomes vectors from a learned table (and a flag where a word repeats the one
before); filters of several widths pass over it; each filter's largest answer is kept, and a dense
layer makes logits of those. Training is plain backpropagation with Adam: through a maximum, a
gradient reaches one place for each filter.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

PAD = 256            # the byte after the end of a text
_ROWS = 1 << 14      # filter places that are computed at once, to stay in the cache


@dataclass
class Shape:
    """`window` bytes, filters of these `widths` (`filters` of each) every `stride` bytes."""

    window: int = 256
    widths: tuple[int, ...] = (2, 3, 5)
    filters: int = 16
    stride: int = 2
    embed: int = 8
    flags: int = 0       # further input channels beside the byte's vector
    classes: int = 2

    @property
    def channels(self) -> int:
        return self.embed + self.flags

    @property
    def features(self) -> int:
        return self.filters * len(self.widths)


class ByteNet:
    def __init__(self, shape: Shape, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.shape = shape
        widest, ch = max(shape.widths), shape.channels
        # Narrow filters are wide ones with zeros behind.
        mask = np.zeros((widest, ch, shape.features), np.float32)
        for k, width in enumerate(shape.widths):
            mask[:width, :, k * shape.filters:(k + 1) * shape.filters] = 1
        self.mask = mask.reshape(widest * ch, shape.features)
        draw = lambda *size, scale: (rng.standard_normal(size) * scale).astype(np.float32)
        self.params = {
            "embed": draw(PAD + 1, shape.embed, scale=0.5),
            "filter": draw(widest * ch, shape.features, scale=1 / math.sqrt(3 * ch)) * self.mask,
            "bias": np.zeros(shape.features, np.float32),
            "dense": draw(shape.features, shape.classes, scale=1 / math.sqrt(shape.features)),
            "out": np.zeros(shape.classes, np.float32),
        }

    def _input(self, x: np.ndarray, flags: np.ndarray | None) -> np.ndarray:
        """(windows, window + widest - 1, channels) of the bytes `x`, padded at the end."""
        n = len(x)
        padded = np.full((n, self.shape.window + max(self.shape.widths) - 1), PAD, x.dtype)
        padded[:, :x.shape[1]] = x
        if not self.shape.flags:
            return self.params["embed"][padded]
        out = np.zeros((*padded.shape, self.shape.channels), np.float32)
        out[:, :, :self.shape.embed] = self.params["embed"][padded]
        if flags is not None:
            out[:, :x.shape[1], self.shape.embed:] = flags
        return out

    def _patches(self, inputs: np.ndarray) -> np.ndarray:
        """(windows, places, widest * channels): what each filter sees at each place, no copy."""
        s = self.shape
        a, b, c = inputs.strides
        places = (s.window + s.stride - 1) // s.stride
        return np.lib.stride_tricks.as_strided(
            inputs, (len(inputs), places, max(s.widths) * s.channels), (a, b * s.stride, c))

    def pool(self, x: np.ndarray, flags: np.ndarray | None = None) -> np.ndarray:
        """(windows, features): each filter's largest answer, not below 0.

        `x` (windows, window) holds bytes, PAD behind a text's end.
        """
        out = np.empty((len(x), self.shape.features), np.float32)
        step = max(1, _ROWS // (self.shape.window // self.shape.stride))
        for at in range(0, len(x), step):
            part = self._patches(self._input(x[at:at + step], None if flags is None else flags[at:at + step]))
            flat = np.ascontiguousarray(part).reshape(-1, part.shape[-1])
            answers = (flat @ self.params["filter"]).reshape(len(part), part.shape[1], -1)
            out[at:at + step] = answers.max(1)
        return np.maximum(out + self.params["bias"], 0)

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        return pooled @ self.params["dense"] + self.params["out"]

    def train(self, x: np.ndarray, group: np.ndarray, target: np.ndarray, flags: np.ndarray | None = None,
              epochs: int = 8, batch: int = 64, rate: float = 4e-3, seed: int = 11) -> None:
        """Fits the windows `x`; those of one `group` (0, 1, ... in order) are pooled together.

        `target` has a class for each group.
        """
        rng = np.random.default_rng(seed)
        bounds = np.searchsorted(group, np.arange(len(target) + 1))
        moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.params.items()}
        step, total = 0, epochs * math.ceil(len(target) / batch)
        for _ in range(epochs):
            order = rng.permutation(len(target))
            for at in range(0, len(order), batch):
                chosen = order[at:at + batch]
                rows = np.concatenate([np.arange(bounds[g], bounds[g + 1]) for g in chosen])
                owner = np.repeat(np.arange(len(chosen)), bounds[chosen + 1] - bounds[chosen])
                grads = self._gradients(x[rows], None if flags is None else flags[rows], owner, target[chosen])
                step += 1
                pace = rate * min(1.0, 2 * (1 - step / (total + 1)))
                for k, g in grads.items():
                    m, v = moments[k]
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    self.params[k] -= pace * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-7)

    def _gradients(self, x, flags, owner, target) -> dict[str, np.ndarray]:
        s, p = self.shape, self.params
        inputs = self._input(x, flags)
        patches = self._patches(inputs)
        answers = np.ascontiguousarray(patches).reshape(-1, patches.shape[-1]) @ p["filter"]
        answers = answers.reshape(len(x), -1, s.features)
        place = answers.argmax(1)                                     # (windows, features)
        top = np.take_along_axis(answers, place[:, None], 1)[:, 0]
        # The largest over the windows of each group, and the window that has it.
        n, f = len(target), np.arange(s.features)
        starts = np.searchsorted(owner, np.arange(n))
        best = np.maximum.reduceat(top, starts, axis=0)
        is_best = top == best[owner]
        row = np.full((n, s.features), -1)
        for w in range(len(x) - 1, -1, -1):
            row[owner[w], is_best[w]] = w
        raw = best + p["bias"]
        pooled = np.maximum(raw, 0)
        logits = pooled @ p["dense"] + p["out"]
        prob = np.exp(logits - logits.max(1, keepdims=True))
        prob /= prob.sum(1, keepdims=True)
        d_logits = prob
        d_logits[np.arange(n), target] -= 1
        d_logits /= n
        d_pooled = (d_logits @ p["dense"].T) * (raw > 0)              # (groups, features)
        at = place[row, f]                                            # filter places
        seen = patches[row, at]                                       # (groups, features, widest * ch)
        d_filter = np.einsum("gfk,gf->kf", seen, d_pooled) * self.mask
        d_seen = d_pooled[:, :, None] * p["filter"].T[None]           # (groups, features, widest * ch)
        d_seen = d_seen.reshape(n, s.features, -1, s.channels)[..., :s.embed]
        padded = np.full((len(x), s.window + max(s.widths) - 1), PAD, np.int64)
        padded[:, :x.shape[1]] = x
        taps = padded[row[:, :, None], at[:, :, None] * s.stride + np.arange(max(s.widths))]
        d_embed = np.zeros_like(p["embed"])
        np.add.at(d_embed, taps.reshape(-1), d_seen.reshape(-1, s.embed))
        return {"embed": d_embed, "filter": d_filter, "bias": d_pooled.sum(0),
                "dense": pooled.T @ d_logits, "out": d_logits.sum(0)}


def text_windows(data: bytes, offsets: np.ndarray, window: int, step: int, flags: np.ndarray | None = None):
    """Windows of many texts: (windows, window) bytes with PAD behind, each one's text, and their
    part of `flags` (one for each byte of `data`) if given.

    Text i is data[offsets[i]:offsets[i + 1]]. A window begins every `step` bytes until the whole
    text is covered; an empty text has one window of PAD.
    """
    lengths = np.diff(offsets)
    counts = 1 + np.maximum(0, -(-(lengths - window) // step))
    owner = np.repeat(np.arange(len(lengths)), counts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    begin = offsets[:-1][owner] + nth * step
    held = np.minimum(window, offsets[1:][owner] - begin)
    padded = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(window, np.uint8)])
    rows = np.lib.stride_tricks.sliding_window_view(padded, window)[begin].astype(np.int16)
    short = np.flatnonzero(held < window)
    if len(short):
        rows[short] = np.where(np.arange(window) < held[short, None], rows[short], PAD)
    if flags is None:
        return rows, owner, None
    padded = np.concatenate([flags, np.zeros(window, flags.dtype)])
    kept = np.lib.stride_tricks.sliding_window_view(padded, window)[begin] * (rows != PAD)
    return rows, owner, kept[:, :, None]


def repeat_flags(data: bytes, offsets: np.ndarray) -> np.ndarray:
    """1 for each byte of a word that equals the word before it in its text, else 0."""
    b = np.frombuffer(data, np.uint8)
    if not len(b):
        return np.zeros(0, np.float32)
    space = (b == 32) | (b == 10) | (b == 9) | (b == 13)
    starts = ~space
    edge = np.zeros(len(b), bool)
    edge[offsets[:-1][offsets[:-1] < len(b)]] = True
    starts[1:] &= space[:-1] | edge[1:]
    first = np.flatnonzero(starts)
    if len(first) < 2:
        return np.zeros(len(b), np.float32)
    stop = np.minimum.reduceat(np.where(space, np.arange(len(b)), len(b)), first)
    text_end = offsets[np.searchsorted(offsets, first, "right")]
    size = np.minimum(stop, text_end) - first
    # Sums of bytes weighted by their place tell words apart well enough for a flag.
    summed = np.concatenate([[0], np.cumsum(b.astype(np.int64))])
    weighted = np.concatenate([[0], np.cumsum(b.astype(np.int64) * np.arange(len(b)))])
    one = summed[first + size] - summed[first]
    two = weighted[first + size] - weighted[first] - one * first
    same = np.zeros(len(first), bool)
    same[1:] = ((size[1:] == size[:-1]) & (one[1:] == one[:-1]) & (two[1:] == two[:-1])
                & (text_end[1:] == text_end[:-1]))
    change = np.zeros(len(b) + 1, np.int32)
    np.add.at(change, first[same], 1)
    np.add.at(change, (first + size)[same], -1)
    return np.cumsum(change[:-1]).astype(np.float32)


def spread_windows(text: bytes, window: int, step: int, most: int) -> list[int]:
    """Begins of at most `most` windows, evenly over the whole text, among those of `text_windows`."""
    count = 1 + max(0, -(-(len(text) - window) // step))
    if count <= most:
        return [k * step for k in range(count)]
    return [round(k * (count - 1) / (most - 1)) * step for k in range(most)] if most > 1 else [0]


def to_rows(parts: list[bytes], window: int) -> np.ndarray:
    """(len(parts), window) of byte strings no longer than `window`, PAD behind."""
    rows = np.full((len(parts), window), PAD, np.int16)
    for i, part in enumerate(parts):
        rows[i, :len(part)] = np.frombuffer(part, np.uint8)
    return rows


def arrow_bytes(texts) -> tuple[bytes, np.ndarray]:
    """The UTF-8 bytes of an Arrow string array without nulls, and where each text begins and ends."""
    import pyarrow as pa

    texts = texts.cast(pa.large_string())
    _, ends, data = texts.buffers()
    offsets = np.frombuffer(ends, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    if data is None or not len(texts):
        return b"", np.zeros(len(texts) + 1, np.int64)
    return data[int(offsets[0]):int(offsets[-1])].to_pybytes(), offsets - offsets[0]
