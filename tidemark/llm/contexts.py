"""Words of the running text as bits, predicted from the words before them.

A word of the training texts has a code: six bits for the size of its count, then its place among the
words with such a count.  Every bit of every running word is predicted from three contexts: none, the
two words before, and those with a byte of the hash of the third.  What a context has seen is the
number of training words that stood in it and took this way or the other, frequencies counted; a
training word is predicted without itself.  Predictions are added up in the logistic domain with
weights that a gate (how often the contexts were seen at this bit) selects; weights are learned online,
bit by bit, and an adaptive map refines what was mixed.

Words are dealt by the two words before them, so all that a context has seen is in one shard.  Shards
are as many as the text needs and their tables hold what was seen; nothing is dropped or overwritten.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .common import concat_ranges, groups_of, mix

SIZE_BITS, PLACE_BITS = 6, 40
DEPTH = SIZE_BITS + PLACE_BITS
SIZES = 1 << SIZE_BITS
#: Running words that a shard takes, about.
SHARD_WORDS = 1 << 20
#: Rows whose bits are predicted with the same weights.
CHUNK = 1 << 14
RATE = 0.16
LEVELS, STRETCHED = 4, 24
#: Steps per nat of an answer, which is sent in 16 bits.
COST_STEP = 1024


# ---------------------------------------------------------------- arrays in rows


def packed(a: np.ndarray) -> bytes:
    """The array compressed, all its first bytes before all second ones."""
    flat = np.ascontiguousarray(a)
    split = np.ascontiguousarray(flat.view(np.uint8).reshape(-1, flat.itemsize).T)
    return flat.size.to_bytes(8, "little") + pa.compress(split.tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes, kind) -> np.ndarray:
    kind = np.dtype(kind)
    size = int.from_bytes(data[:8], "little")
    split = np.frombuffer(pa.decompress(data[8:], decompressed_size=size * kind.itemsize, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(split.reshape(kind.itemsize, -1).T).view(kind).reshape(-1)


def column_of(table: pa.Table, name: str, kind) -> list[np.ndarray]:
    return [unpacked(x, kind) for x in table.column(name).to_pylist()]


# ---------------------------------------------------------------- codes of words


def bit_length(x: np.ndarray) -> np.ndarray:
    """Bits of integers below 2 ** 53."""
    return np.frexp(x.astype(np.float64))[1].astype(np.int64)


def sizes_of(counts: np.ndarray) -> np.ndarray:
    """The class of a count: its binary logarithm, rounded down."""
    return bit_length(counts) - 1


class Coder:
    """Codes of ranks, given the words and tokens of each class of counts; frequent classes have the first ranks."""

    def __init__(self, words: np.ndarray, tokens: np.ndarray):
        self.words, self.tokens = words.astype(np.int64), tokens.astype(np.float64)
        self.start = np.cumsum(self.words[::-1])[::-1] - self.words
        self.bits = np.array([max(int(v) - 1, 0).bit_length() for v in self.words], np.int64)
        self.tree = [self.tokens.reshape(1 << d, -1).sum(axis=1) for d in range(SIZE_BITS + 1)]
        self.n_words = int(self.words.sum())

    def classes(self, ranks: np.ndarray) -> np.ndarray:
        return SIZES - np.searchsorted(self.start[::-1], ranks, side="right")

    def codes(self, ranks: np.ndarray) -> np.ndarray:
        b = self.classes(ranks)
        return b << PLACE_BITS | (ranks - self.start[b]) << (PLACE_BITS - self.bits[b])

    def alone(self, ranks: np.ndarray) -> np.ndarray:
        """Natural log probability of each word without a context."""
        b = self.classes(ranks)
        return np.log(self.tokens[b] / max(self.tokens.sum(), 1.0)) - np.log(self.words[b])

    def ways(self, codes: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """What lies on the code's own side of the bit at this depth, and on the other."""
        if depth < SIZE_BITS:
            side = codes >> (DEPTH - depth - 1)
            return self.tree[depth + 1][side], self.tree[depth + 1][side ^ 1]
        b, width = codes >> PLACE_BITS, 1 << (DEPTH - depth - 1)
        end = self.words[b] << (PLACE_BITS - self.bits[b])
        own = codes & ((1 << PLACE_BITS) - 1) & ~(width - 1)
        rest = np.where(depth - SIZE_BITS < self.bits[b], end - (own ^ width), 0)
        return np.clip(end - own, 0, width).astype(np.float64), np.clip(rest, 0, width).astype(np.float64)


# ---------------------------------------------------------------- what a run asks


class Asks:
    """The different (third word's byte, two words before, word, held out) of a run's tokens, by shard.

    ``ranks`` are those of the run's words, -1 where training texts don't hold the word.  A token is
    asked for where it and the two words before it have ranks; before a text stands a word of its own.
    """

    def __init__(self, which: np.ndarray, per: np.ndarray, held: np.ndarray, ranks: np.ndarray, n_words: int, shards: int):
        place = np.arange(len(which)) - np.repeat(np.cumsum(per) - per, per)
        known = np.concatenate([ranks, [n_words]])
        before = []
        for k in (1, 2, 3):
            at = np.full(len(which), len(ranks), np.int64)
            at[k:] = np.where(place[k:] >= k, which[:-k], len(ranks))
            before.append(known[at])
        one, two, three = before
        del before, place, at
        order, out = np.argsort(ranks, kind="stable"), np.repeat(held, per)
        nth = np.empty(len(ranks), np.int64)
        nth[order] = np.arange(len(ranks))
        self.asked = np.flatnonzero((ranks[which] >= 0) & (one >= 0) & (two >= 0))
        one, two, three, word, out = (x[self.asked] for x in (one, two, three, nth[which], out))
        pair, context = np.unique(one.astype(np.uint64) << np.uint64(32) | two.astype(np.uint64), return_inverse=True)
        shard = (mix(pair + np.uint64(1)) % np.uint64(shards)).astype(np.int64)
        dealt = np.argsort(shard.astype(np.uint16) if shards <= 1 << 16 else shard, kind="stable")
        place_of = np.empty(len(pair), np.int64)
        place_of[dealt] = np.arange(len(pair))
        pair, shard, context = pair[dealt], shard[dealt], place_of[context]
        near = (mix((three + 2).astype(np.uint64)) >> np.uint64(56)).astype(np.int64)
        width = max(len(order) - 1, 1).bit_length()
        key = (context << width | word) << 9 | near << 1 | out
        del one, two, three, word, out, context, near
        keys, self.inverse, times = np.unique(key, return_inverse=True, return_counts=True)
        held_out = (keys & 1).astype(bool)
        of = keys >> (9 + width)
        self.pair, self.asks = pair, np.bincount(of, minlength=len(pair))
        self.near, self.times = (keys >> 1 & 255).astype(np.uint8), np.where(held_out, 0, times)
        self.word = ranks[order[keys >> 9 & ((1 << width) - 1)]]
        self.cuts = groups_of(shard)
        self.shards = shard[self.cuts[:-1]]
        self.ends = np.concatenate([[0], np.cumsum(self.asks)])

    def rows(self) -> list[tuple[int, list[bytes]]]:
        """(shard, arrays) of every shard that is asked."""
        done = []
        for s, i, j in zip(self.shards, self.cuts[:-1], self.cuts[1:], strict=False):
            a, b = self.ends[i], self.ends[j]
            arrays = [self.pair[i:j], self.asks[i:j].astype(np.uint32), self.near[a:b], self.times[a:b].astype(np.uint32), self.word[a:b].astype(np.uint32)]
            done.append((int(s), [packed(x) for x in arrays]))
        return done

    def answered(self, plain: np.ndarray, which: np.ndarray, costs: np.ndarray) -> np.ndarray:
        """Natural log probability of each token: as answered, or else that of the word without a context."""
        out = plain[which]
        out[self.asked] = costs[self.inverse] / -float(COST_STEP)
        return out


KINDS = (np.uint64, np.uint32, np.uint8, np.uint32, np.uint32)


def answers(table: pa.Table, coder: Coder) -> pa.Table:
    """One shard: for each run that asked, the cost of its asks in steps."""
    pair, asks, near, times, word = (column_of(table, c, kind) for c, kind in zip("abcde", KINDS, strict=True))
    per = [len(x) for x in word]
    whole = np.repeat(np.concatenate(pair), np.concatenate(asks).astype(np.int64))
    cost = -context_logs(whole, np.concatenate(near), np.concatenate(times).astype(np.int64), np.concatenate(word).astype(np.int64), coder)
    steps = np.clip(np.ceil(cost * COST_STEP), 0, 65535).astype(np.uint16)
    parts = np.split(steps, np.cumsum(per)[:-1])
    return pa.table({"run": table.column("run"), "shard": table.column("shard"), "costs": pa.array([packed(x) for x in parts], pa.binary())})


# ---------------------------------------------------------------- prediction


def seen_with(common: np.ndarray, times: np.ndarray, depth: int) -> np.ndarray:
    """Training words that share a row's context and the first ``depth`` bits; ``common``: bits shared with the row before."""
    starts = np.flatnonzero(common < depth)
    return np.repeat(np.add.reduceat(times, starts), np.diff(np.append(starts, len(times))))


def level(seen: np.ndarray) -> np.ndarray:
    return np.minimum(bit_length(seen), LEVELS - 1)


def shared_bits(context: np.ndarray, codes: np.ndarray) -> np.ndarray:
    out = np.full(len(codes), -1, np.int64)
    out[1:] = np.where(context[1:] == context[:-1], DEPTH - bit_length(codes[1:] ^ codes[:-1]), -1)
    return out


class Mixer:
    """Weights by gate and the map that refines their sum; both learn from what was predicted before."""

    def __init__(self):
        self.weights = np.full((LEVELS * LEVELS, 3), 0.5)
        self.right, self.all = (np.zeros((LEVELS * LEVELS, STRETCHED)) for _ in range(2))
        self.start = 1 / (1 + np.exp(-np.arange(STRETCHED) / 2.0))

    def log_p(self, gate: np.ndarray, x: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Natural log probability of the way that was taken, of which the rows of ``x`` are in favour; rows
        with ``times`` are learned from after that."""
        weight = self.weights.T.astype(np.float32)
        dot = np.clip(weight[0][gate] * x[0] + weight[1][gate] * x[1] + weight[2][gate] * x[2], -20, 20)
        bucket = np.minimum(np.rint(np.abs(dot) * 2).astype(np.int64), STRETCHED - 1)
        cell = gate * STRETCHED + bucket
        likely = ((self.right + 20 * self.start) / (self.all + 20)).astype(np.float32).ravel()[cell]
        p = 1 / (1 + np.exp(-dot))
        log_p = np.log((p + np.where(dot > 0, likely, np.where(dot < 0, 1 - likely, 0.5))) / 2)
        share = np.maximum(np.bincount(gate, times, LEVELS * LEVELS), 1)[:, None]
        error = (1 - p) * times
        self.weights += RATE * np.stack([np.bincount(gate, error * row, LEVELS * LEVELS) for row in x], axis=1) / share
        self.right += np.bincount(cell, times * ((dot > 0) + 0.5 * (dot == 0)), self.right.size).reshape(self.right.shape)
        self.all += np.bincount(cell, times, self.all.size).reshape(self.all.shape)
        return log_p


def context_logs(pair: np.ndarray, near: np.ndarray, times: np.ndarray, ranks: np.ndarray, coder: Coder) -> np.ndarray:
    """Natural log probability of each ask; ``times`` it stood in training texts, 0 for one of held-out texts.
    All asks of a pair are here.  Equal ones are added up, and the result does not depend on their order."""
    order, word = np.unique(ranks, return_inverse=True)
    codes, result = coder.codes(order), coder.alone(order)[word]
    _, context, asks = np.unique(pair, return_inverse=True, return_counts=True)
    # what stands alone in its context has nothing to be predicted from, and nothing to tell
    more = np.flatnonzero((asks > 1)[context] | (times > 1))
    if not len(more):
        return result
    context, word, near, times = (x[more] for x in (context, word, near, times))
    width = max(len(order) - 1, 1).bit_length()
    keys, inverse = np.unique((context << width | word) << 9 | near.astype(np.int64) << 1 | (times == 0), return_inverse=True)
    times = np.bincount(inverse, times, len(keys))
    codes = codes[keys >> 9 & ((1 << width) - 1)]
    context, near = keys >> (9 + width), keys >> 1 & 255
    logs = np.empty(len(keys))
    mixer = Mixer()
    starts = groups_of(context)
    cut = starts[np.concatenate([[0], np.flatnonzero(np.diff(starts[:-1] // CHUNK)) + 1, [len(starts) - 1]])]
    for i, j in zip(cut[:-1], cut[1:], strict=True):
        logs[i:j] = _gained(context[i:j], near[i:j], times[i:j], codes[i:j], coder, mixer)
    result[more] += logs[inverse]
    return result


def _gained(context: np.ndarray, near: np.ndarray, times: np.ndarray, codes: np.ndarray, coder: Coder, mixer: Mixer) -> np.ndarray:
    """What the contexts add to the log probability of each row; rows are in order of context and code."""
    gain, row, own = np.zeros(len(codes)), np.arange(len(codes)), (times > 0).astype(np.float64)
    other_order = np.lexsort((codes, near, context))
    common, common3 = shared_bits(context, codes), shared_bits((context << 8 | near)[other_order], codes[other_order])
    seen, seen3 = seen_with(common, times, 0), np.empty(len(codes))
    seen3[other_order] = seen_with(common3, times[other_order], 0)
    for depth in range(DEPTH):
        # a row that is alone on its way is coded without its contexts from there on
        live = seen > own
        if np.count_nonzero(live) <= 0.75 * len(live):
            starts = np.flatnonzero(common < depth)
            keep = np.repeat(np.maximum.reduceat(live, starts), np.diff(np.append(starts, len(live))))
            kept3 = keep[other_order]
            other_order = (np.cumsum(keep) - 1)[other_order[kept3]]
            common, common3 = common[keep], common3[kept3]
            row, own, times, codes, seen, seen3, live = (x[keep] for x in (row, own, times, codes, seen, seen3, live))
        if not len(row):
            break
        mine, rest = coder.ways(codes, depth)
        at = np.flatnonzero(live & (rest > 0))
        if not len(at):
            if depth >= SIZE_BITS and not live.any():
                break
            continue
        on, on3 = seen_with(common, times, depth + 1), np.empty(len(row))
        on3[other_order] = seen_with(common3, times[other_order], depth + 1)
        took, took3, left, left3 = (x[at] for x in (on - own, on3 - own, seen - on, seen3 - on3))
        x = np.log(np.stack([mine[at] / rest[at], (took + 0.4) / (left + 0.4), (took3 + 0.4) / (left3 + 0.4)]).astype(np.float32))
        log_p = mixer.log_p(level(took + left) * LEVELS + level(took3 + left3), x, times[at])
        gain[row[at]] += log_p + np.log1p(rest[at] / mine[at])
        seen, seen3 = on, on3
    return gain
