"""SentencePiece segmentations sampled without replacement, and their decoding.

Every way to cut a text into pieces of the vocabulary is a path through a lattice. The paths'
probabilities are perturbed with Gumbel noise, and the k paths of the largest perturbed values are
k samples without replacement. They are found best first (A*): the perturbed value of a set of
paths is drawn from the set's total probability, which backward sums over the lattice give exactly,
and a set that has been opened leaves one smaller set behind at each piece of the path it gave. The
noise depends on the row's key alone, so a row's samples do not depend on its neighbours.

No piece runs across a line break or from a non-space into a space, so the lattice is a chain of
words: backward sums are made once for each distinct word of a batch. Words, documents and paths
are handled side by side in arrays.
"""

from __future__ import annotations

import array
import copy
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import BYTE_KEYS, mix64, slices, string_parts

#: Bytes of text whose words share one lattice, and bytes that one step samples or decodes.
LATTICE_BYTES, STEP_BYTES = 1 << 21, 5 << 17
#: Positions with more bytes than this to their word's end have their sums made one by one, since
#: array steps over the few long words would hold little.
LONG = 2048
#: Up to so many words are walked one by one, with the same draws and sums as in arrays.
NARROW = 12
#: A byte of a character without a piece costs so much more than the rarest piece.
BYTE_PENALTY = 3.0
#: Pieces of merge rank r weigh (r + RANK_SHIFT) ** -1, as in a list of words by frequency.
RANK_SHIFT = 10.0
_TABLE_BITS = 19
_BASE = np.uint64(0x9E3779B97F4A7C15)


class Vocabulary:
    """Pieces as bytes (the space mark is a space), log weights, and a hash table of their prefixes."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.vocab_size()
        self.bytes: list[bytes] = [b""] * size
        self.byte_ids = np.zeros(256, np.int32)
        weight, rank, plain = np.full(size, -np.inf), np.zeros(size), []
        for i in range(size):
            if model.is_byte(i):
                value = int(model.id_to_piece(i)[3:5], 16)
                self.bytes[i], self.byte_ids[value] = bytes([value]), i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.bytes[i] = model.id_to_piece(i).replace("▁", " ").encode()
                rank[i] = min(-model.get_score(i), float(size))  # merge rank; user-defined pieces come last
                plain.append(i)
                lead = self.bytes[i].lstrip(b" ")
                if b" " in lead or (b"\n" in lead and len(lead) > 1):
                    raise ValueError("a piece runs across words; the lattice of this model is not a chain of words")
        plain = np.array(plain)
        weight[plain] = -np.log(rank[plain] + RANK_SHIFT)
        weight[plain] -= np.log(np.exp(weight[plain]).sum())
        self.weight = weight
        self.byte_weight = float(weight[plain].min()) - BYTE_PENALTY
        sizes = np.array([len(x) for x in self.bytes], np.int64)
        self.sizes, self.starts = sizes, np.cumsum(sizes) - sizes
        self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.lengths = sorted({len(self.bytes[i]) for i in plain})
        # every prefix of a piece: the piece that it is, or -2, and whether a longer piece starts with it
        known: dict[bytes, int] = {self.bytes[i]: int(i) for i in plain}
        longer = {self.bytes[i][:n] for i in plain for n in range(1, len(self.bytes[i]))}
        slots = 1 << _TABLE_BITS
        self._keys, self._ids, self._more = np.zeros(slots, np.uint64), np.full(slots, -1, np.int32), np.zeros(slots, bool)
        taken = set()
        for prefix in known.keys() | longer:
            data, h = np.frombuffer(prefix, np.uint8), np.zeros(1, np.uint64)
            for k in range(len(data)):
                h = rolled(h, data[k : k + 1])
            key = int(prefix_key(h, len(data))[0])
            if key in taken:
                raise ValueError("two prefixes of pieces have the same hash")
            taken.add(key)
            at = key >> (64 - _TABLE_BITS)
            while self._ids[at] != -1:
                at = (at + 1) & (slots - 1)
            self._keys[at], self._ids[at], self._more[at] = key, known.get(prefix, -2), prefix in longer

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(piece of each key, -2 for a mere prefix, -1 for neither; whether a longer piece starts so)."""
        at = (keys >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)
        out = self._ids[at]
        wrong = np.flatnonzero((out != -1) & (self._keys[at] != keys))
        while len(wrong):
            at[wrong] = (at[wrong] + 1) & ((1 << _TABLE_BITS) - 1)
            out[wrong] = self._ids[at[wrong]]
            wrong = wrong[(out[wrong] != -1) & (self._keys[at[wrong]] != keys[wrong])]
        return out, self._more[at] & (out != -1)


def rolled(h: np.ndarray, byte: np.ndarray) -> np.ndarray:
    """Hashes of spans that grow by one byte."""
    return h * _BASE + BYTE_KEYS[byte]


def prefix_key(h: np.ndarray, length: int) -> np.ndarray:
    return (h ^ (h >> np.uint64(29)) ^ np.uint64(length)) * np.uint64(0xD6E8FEB86659FD93)


class Hashes:
    """Cheap hashes of spans; those of equal bytes and length are equal."""

    def __init__(self, data: np.ndarray):
        n = len(data) + 1
        powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, _BASE)]), dtype=np.uint64)
        self._inverse = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, np.uint64(pow(int(_BASE), -1, 2**64)))]), dtype=np.uint64)
        self._sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE_KEYS[data] * powers[: n - 1], dtype=np.uint64)])

    def span(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        x = (self._sums[ends] - self._sums[starts]) * self._inverse[starts]
        return (x ^ (x >> np.uint64(29)) ^ (ends - starts).astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)


@dataclass
class Lattice:
    """Edges of each position of the distinct words, in slots; a word of n bytes has n + 1 positions.

    Positions are numbered by the bytes that are left to their word's end, so that those whose sums
    depend on earlier ones only lie side by side."""

    number: np.ndarray  # of each byte position, words one after the other
    base: np.ndarray  # first byte position of each word
    target: np.ndarray  # (positions, slots) where an edge leads
    piece: np.ndarray  # (positions, slots) its piece
    share: np.ndarray  # (positions, slots) its probability given the position
    last: int  # positions before this number are word ends

    @classmethod
    def build(cls, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, vocabulary: Vocabulary) -> Lattice:
        sizes = ends - starts
        base = np.cumsum(sizes + 1) - (sizes + 1)
        count = int((sizes + 1).sum())
        left = np.repeat((sizes + base).astype(np.int32), sizes + 1) - np.arange(count, dtype=np.int32)
        order = np.argsort(left.astype(np.uint16) if count and left.max() < 1 << 16 else left, kind="stable").astype(np.int32)
        number = np.empty(count, np.int32)
        number[order] = np.arange(count, dtype=np.int32)
        bounds = np.concatenate([[0], np.cumsum(np.bincount(left))]) if count else np.zeros(2, np.int64)
        source = np.repeat((starts - base).astype(np.int32), sizes + 1) + np.arange(count, dtype=np.int32)
        lead = data[np.minimum(source, max(len(data) - 1, 0))] if len(data) else np.zeros(count, np.uint8)
        char = _CHAR_SIZE[lead]
        char[left == 0] = 0
        orphan = char > 0  # characters without a piece of their own
        alive = np.flatnonzero(left > 0).astype(np.int32)
        edges, degree = [], np.zeros(count, np.int8)
        h = np.zeros(len(alive), np.uint64)
        for length in range(1, vocabulary.lengths[-1] + 1):
            if not len(alive):
                break
            h = rolled(h, data[source[alive] + (length - 1)])
            found, more = vocabulary.find(prefix_key(h, length))
            hit = found >= 0
            where, found = alive[hit], found[hit]
            edges.append((where, degree[where], length, found, vocabulary.weight[found].astype(np.float32)))
            degree[where] += 1
            orphan[where[char[where] == length]] = False
            more &= left[alive] > length
            alive, h = alive[more], h[more]
        spelled = np.flatnonzero(orphan)
        reach = np.minimum(char[spelled], left[spelled]).astype(np.int64)
        spelled = np.repeat(spelled, reach) + np.arange(int(reach.sum())) - np.repeat(np.cumsum(reach) - reach, reach)
        edges.append((spelled, degree[spelled], 1, vocabulary.byte_ids[data[source[spelled]]] if len(spelled) else np.zeros(0, np.int32), np.full(len(spelled), vocabulary.byte_weight, np.float32)))
        degree[spelled] += 1
        width = max(1, int(degree.max()) if count else 1)
        target, piece, share = np.zeros((count, width), np.int32), np.zeros((count, width), np.int32), np.full((count, width), -np.inf, np.float32)
        for where, slot, length, what, weight in edges:
            flat = number[where].astype(np.int64) * width + slot
            target.reshape(-1)[flat] = number[where + length]
            piece.reshape(-1)[flat] = what
            share.reshape(-1)[flat] = weight
        # backward sums; every position shares its sum among its edges
        sums = np.zeros(count)
        levels = min(len(bounds) - 1, LONG + 1)
        for lo, hi in zip(bounds[1:levels], bounds[2 : levels + 1], strict=True):
            y = sums[target[lo:hi]]
            y += share[lo:hi]
            top = y.max(axis=1)
            dead = np.isneginf(top)
            top[dead] = 0.0
            y -= top[:, None]
            x = share[lo:hi]
            np.exp(y.astype(np.float32), out=x)
            total = x.sum(axis=1)
            total[dead] = 1.0
            x /= total[:, None]
            sums[lo:hi] = np.where(dead, -np.inf, top + np.log(total))
        if bounds[levels] < count:
            cls._one_by_one(share, target, sums, int(bounds[levels]))
        share[: bounds[1]] = 0.0
        return cls(number, base, target, piece, share, int(bounds[1]))

    @staticmethod
    def _one_by_one(share: np.ndarray, target: np.ndarray, sums: np.ndarray, at: int) -> None:
        """The same sums for positions from ``at`` on, where levels hold too few for array steps."""
        known = array.array("d", sums[:at].tobytes())
        for lo in range(at, len(sums), 1 << 14):
            rows = share[lo : lo + (1 << 14)]
            made = []
            for weights, ends in zip(rows.tolist(), target[lo : lo + (1 << 14)].tolist(), strict=True):
                x = [w + known[e] for w, e in zip(weights, ends, strict=True)]
                top = max(x)
                if top == -math.inf:
                    known.append(top)
                    made.append([0.0] * len(x))
                    continue
                x = [math.exp(v - top) for v in x]
                total = sum(x)
                known.append(top + math.log(total))
                made.append([v / total for v in x])
            rows[:] = made
        sums[:] = np.frombuffer(known, np.float64)

    @staticmethod
    def pick(rows: np.ndarray, u: np.ndarray) -> np.ndarray:
        """A slot of each row of shares, by a number from 0 to the row's sum each."""
        slot, running = np.zeros(len(rows), np.int8), rows[:, 0].copy()
        for j in range(1, rows.shape[1]):
            slot += u >= running
            running += rows[:, j]
        past = np.flatnonzero(u >= running)  # rounding: the last slot that has a share
        slot[past] = rows.shape[1] - 1 - (rows[past, ::-1] > 0).argmax(axis=1)
        return slot


_CHAR_SIZE = np.select([np.arange(256) < 0x80, np.arange(256) < 0xC0, np.arange(256) < 0xE0, np.arange(256) < 0xF0], [1, 0, 2, 3], 4).astype(np.int8)


def _uniform(seed: np.ndarray, counter: np.ndarray) -> np.ndarray:
    bits = mix64(seed + mix64(counter.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)))
    return ((bits >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


@dataclass
class Paths:
    """One path of each document: nodes in order, and the first node of each document."""

    node: np.ndarray  # position in the lattice
    slot: np.ndarray
    place: np.ndarray  # byte in the document
    word: np.ndarray  # word of the batch
    first: np.ndarray


class Sampler:
    """Samples of all documents of a batch, round by round."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, seeds: np.ndarray, vocabulary: Vocabulary):
        n = len(offs) - 1
        grown = offs + np.arange(n + 1)
        text = np.full(int(grown[-1]), 0x20, np.uint8)  # a space goes before each text, as in training
        lead = np.zeros(len(text), bool)
        lead[grown[:-1]] = True
        text[~lead] = data
        before = np.concatenate([[0], text[:-1]]) if len(text) else text
        cut = lead | ((text == 0x20) & (before != 0x20)) | (text == 0x0A) | (before == 0x0A)
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(text))
        hashes = Hashes(text).span(starts, ends)
        _, one, self.kind = np.unique(hashes, return_index=True, return_inverse=True)
        self.lattice = Lattice.build(text, starts[one], ends[one], vocabulary)
        self.size = ends - starts
        self.words = np.searchsorted(starts, grown)
        self.doc = np.repeat(np.arange(n), np.diff(self.words))
        self.at = starts - grown[self.doc]
        self.seeds, self.count, self.vocabulary = seeds, n, vocabulary

    def part(self, lo: int, hi: int) -> Sampler:
        """The documents from ``lo`` up to ``hi``, with the same lattice."""
        out, w = copy.copy(self), slice(self.words[lo], self.words[hi])
        out.kind, out.size, out.at, out.doc = self.kind[w], self.size[w], self.at[w], self.doc[w] - lo
        out.words, out.seeds, out.count = self.words[lo : hi + 1] - w.start, self.seeds[lo:hi], hi - lo
        return out

    def fresh(self, words: np.ndarray, skip: np.ndarray, stream: int) -> tuple[np.ndarray, ...]:
        """Nodes, slots, places and words of a random path through each word from byte ``skip`` on."""
        x = self.lattice
        node = x.number[x.base[self.kind[words]] + skip]
        place, live = (self.at[words] + skip).astype(np.int64), np.arange(len(words), dtype=np.int32)
        out = []
        open_ = node >= x.last
        node, place, live = node[open_], place[open_], live[open_]
        seed = self.seeds[self.doc[words[live]]]
        while len(live) > NARROW:
            slot = x.pick(x.share[node], _uniform(seed, place + (stream << 48)).astype(np.float32))
            out.append((live, node, slot, place))
            flat = node.astype(np.int64) * x.share.shape[1] + slot
            place = place + self.vocabulary.sizes[x.piece.reshape(-1)[flat]]
            node = x.target.reshape(-1)[flat]
            open_ = node >= x.last
            node, place, live, seed = node[open_], place[open_], live[open_], seed[open_]
        for one in zip(live.tolist(), node.tolist(), place.tolist(), seed, strict=True):
            out.append(self._walk(*one, stream))
        if not out:
            return tuple(np.zeros(0, np.int64) for _ in range(4))
        live, node, slot, place = (np.concatenate([o[k] for o in out]) for k in range(4))
        order = np.argsort(live, kind="stable")
        return node[order], slot[order], place[order], words[live[order]]

    def _walk(self, live: int, node: int, place: int, seed: np.uint64, stream: int) -> tuple[np.ndarray, ...]:
        """The rest of one word's random path, piece by piece."""
        x, sizes = self.lattice, self.vocabulary.sizes
        nodes, slots, places, base, u = [], [], [], place, []
        while node >= x.last:
            if place - base >= len(u):
                base, size = place, min(1 << 16, 4 * len(u) + 64)
                u = _uniform(np.full(size, seed), base + np.arange(size) + (stream << 48)).astype(np.float32).tolist()
            running = x.share[node].cumsum()
            slot = int(np.searchsorted(running, np.float32(u[place - base]), "right"))
            if slot == len(running):
                slot = int(np.flatnonzero(x.share[node])[-1])
            nodes.append(node)
            slots.append(slot)
            places.append(place)
            place += int(sizes[x.piece[node, slot]])
            node = int(x.target[node, slot])
        return np.full(len(nodes), live), np.array(nodes, np.int64), np.array(slots, np.int8), np.array(places, np.int64)

    def run(self, k: int) -> list[tuple[np.ndarray, Paths, np.ndarray, np.ndarray, np.ndarray]]:
        """For each round (documents that have a sample, paths, log probability, perturbed value,
        inclusion score)."""
        x, n = self.lattice, self.count
        key = -np.log(-np.log(_uniform(self.seeds, np.full(n, 1 << 60))))
        docs = np.arange(n)
        whole = np.arange(len(self.doc))
        node, slot, place, word = self.fresh(whole, np.zeros(len(whole), np.int64), 1)
        paths = Paths(node, slot, place, word, np.searchsorted(self.doc[word], np.arange(n + 1)))
        banned = np.zeros((n, 0), np.int64)
        # sets of paths left behind: perturbed value, round of the path, node of the path, slots ruled out
        cap = k + 1
        held_key, held_round, held_at, held_ban = np.full((n, 2 * cap + 1), -np.inf), np.zeros((n, 2 * cap + 1), np.int64), np.zeros((n, 2 * cap + 1), np.int64), np.zeros((n, 2 * cap + 1), np.int64)
        rounds, since, out = [], np.zeros(n, np.int64), []
        for r in range(k):
            share = x.share[paths.node, paths.slot].astype(np.float64)
            logs = np.log(np.maximum(share, 1e-300))
            running = np.concatenate([[0.0], np.cumsum(logs)])
            ahead = running[:-1] - np.repeat(running[paths.first[:-1]], np.diff(paths.first))
            logp = running[paths.first[1:]] - running[paths.first[:-1]]
            rounds.append((paths, ahead))
            out.append((docs, paths, logp, key))
            # new sets, at the nodes from where this path is its own: all edges but the path's
            size = np.diff(paths.first)
            index = np.arange(len(share)) - np.repeat(paths.first[:-1], size)
            rest = 1.0 - share
            small = np.flatnonzero(rest < 1e-3)  # small ones are added up
            rows = x.share[paths.node[small]]
            rows[np.arange(len(rows)), paths.slot[small]] = 0.0
            rest[small] = rows.sum(axis=1)
            if r:
                turn = paths.first[:-1][since < size] + since[since < size]  # where it left the earlier path
                ban = banned[since < size] | np.int64(1) << paths.slot[turn].astype(np.int64)
                rest[turn] = (x.share[paths.node[turn]] * (((ban[:, None] >> np.arange(x.share.shape[1])) & 1) == 0)).sum(axis=1)
                rest[index < np.repeat(since, size)] = 0.0
            # a set's perturbed value falls with log(-log u) - phi, phi being its log probability
            with np.errstate(divide="ignore"):
                phi = ahead + np.log(rest)
            u = _uniform(np.repeat(self.seeds[docs], size), paths.place + ((r + 1) << 48) + (1 << 61))
            late = np.log(-np.log(u)) - phi
            full = np.flatnonzero(size)
            for c in range(k - r):  # later samples, and the first one left out
                if not len(full):
                    break
                least = np.full(len(docs), np.inf)
                least[full] = np.minimum.reduceat(late, paths.first[:-1][full])
                hit = np.flatnonzero((late == np.repeat(least, size)) & (late < np.inf))
                owner = np.searchsorted(paths.first, hit, "right") - 1
                owner, one = np.unique(owner, return_index=True)
                hit, d = hit[one], docs[owner]
                held_key[d, cap + c] = phi[hit] - np.log(np.exp(np.minimum(phi[hit] - key[owner], 700.0)) - np.log(u[hit]))
                held_round[d, cap + c], held_at[d, cap + c] = r, index[hit]
                held_ban[d, cap + c] = (np.int64(1) << paths.slot[hit].astype(np.int64)) | (np.where(index[hit] == since[owner], banned[owner], 0) if r else 0)
                late[hit] = np.inf
            order = np.argsort(-held_key, axis=1, kind="stable")
            held_key, held_round, held_at, held_ban = (np.take_along_axis(h, order, axis=1) for h in (held_key, held_round, held_at, held_ban))
            held_key[:, cap:] = -np.inf
            if r == k - 1:
                break
            # the best set of each document gives its next path
            docs = np.flatnonzero(np.isfinite(held_key[:, 0]))
            key, which, where, banned = held_key[docs, 0].copy(), held_round[docs, 0].copy(), held_at[docs, 0].copy(), held_ban[docs, 0].copy()
            held_key[docs, 0] = -np.inf
            order = np.argsort(-held_key, axis=1, kind="stable")
            held_key, held_round, held_at, held_ban = (np.take_along_axis(h, order, axis=1) for h in (held_key, held_round, held_at, held_ban))
            parts, new_node, new_slot, new_place, new_word = [], [], [], [], []
            row_of = []
            for old in range(r + 1):
                sel = np.flatnonzero(which == old)
                if not len(sel):
                    continue
                given = out[old][0]
                path = rounds[old][0]
                row = np.searchsorted(given, docs[sel])
                start, size = path.first[row], where[sel]
                take = np.repeat(start, size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
                parts.append((np.repeat(sel, size), path.node[take], path.slot[take], path.place[take], path.word[take]))
                new_node.append(path.node[start + size])
                new_place.append(path.place[start + size])
                new_word.append(path.word[start + size])
                row_of.append(sel)
            if not len(docs):
                break
            row_of, new_node, new_place, new_word = (np.concatenate(v) for v in (row_of, new_node, new_place, new_word))
            allowed = x.share[new_node] * (((banned[row_of, None] >> np.arange(x.share.shape[1])) & 1) == 0)
            u = _uniform(self.seeds[docs[row_of]], new_place + ((r + 2) << 48) + (1 << 62)).astype(np.float32)
            new_slot = x.pick(allowed, u * allowed.sum(axis=1))
            parts.append((row_of, new_node, new_slot, new_place, new_word))
            # the rest of the word, and the words after it
            skip = np.zeros(len(self.doc), np.int64)
            begin = new_word
            skip[begin] = new_place - self.at[begin] + self.vocabulary.sizes[x.piece[new_node, new_slot]]
            size = self.words[docs[row_of] + 1] - begin
            todo = np.repeat(begin, size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            node, slot, place, word = self.fresh(todo, skip[todo], r + 2)
            back = np.full(n, -1)
            back[docs] = np.arange(len(docs))
            parts.append((back[self.doc[word]], node, slot, place, word))
            owner, node, slot, place, word = (np.concatenate([p[j] for p in parts]) for j in range(5))
            order = np.argsort(owner, kind="stable")
            owner = owner[order]
            paths = Paths(node[order], slot[order], place[order], word[order], np.searchsorted(owner, np.arange(len(docs) + 1)))
            since = where
        threshold = held_key[:, 0]  # the first value that was left out
        scored = []
        for docs, paths, logp, key in out:
            included = -np.expm1(-np.exp(np.minimum(logp - threshold[docs], 700.0)))
            scored.append((docs, paths, logp, key, np.where(np.isfinite(threshold[docs]), included, 1.0)))
        return scored

    def ids(self, paths: Paths) -> np.ndarray:
        return self.lattice.piece[paths.node, paths.slot]


_vocabularies: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


def sample_segmentations(docs: DataFrame, model: str, samples: int = 3, key: str = "doc_id", carry: list[str] | None = None) -> DataFrame:
    """``docs`` (text, ``key``, any more columns; those in ``carry``, or all) with one row per sample.

    Added are sample (from 0, by falling perturbed value), ids (little-endian 32-bit piece ids),
    n_pieces, log_prob, perturbed and inclusion (the chance of being among the samples, given the
    value left out). A text with fewer segmentations than ``samples`` gives each of them, with
    inclusion 1. A null or empty text is the space mark alone. Rows with equal keys and texts give
    equal samples, whatever rows lie beside them; a null key is a key like any other. Added columns
    replace those of the same name. Work grows in proportion to a text's length, words of any length
    included; a task holds about 150 bytes for each byte of a text without a space.
    """
    added = ["sample", "ids", "n_pieces", "log_prob", "perturbed", "inclusion"]
    docs = docs.drop(*added).withColumn("__seed", F.xxhash64(F.col(key)))
    names = [f.name for f in docs.schema.fields if f.name != "__seed" and (carry is None or f.name in carry)]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(model)
        for whole in batches:
            for large in slices(whole, "text", LATTICE_BYTES):
                data, offs = string_parts(large.column(large.schema.get_field_index("text")))
                seeds = mix64(large.column(large.schema.get_field_index("__seed")).to_numpy().astype(np.uint64))
                sampler, at = Sampler(data, offs, seeds, words), 0
                for b in slices(large, "text", STEP_BYTES):
                    some, at = sampler.part(at, at + b.num_rows), at + b.num_rows
                    for k, (rows, paths, logp, key_, score) in enumerate(some.run(samples)):
                        raw, first = some.ids(paths).astype("<i4"), paths.first
                        ids = [raw[x:y].tobytes() for x, y in zip(first[:-1], first[1:], strict=True)]
                        kept = [b.column(b.schema.get_field_index(c)).take(pa.array(rows)) for c in names]
                        yield pa.RecordBatch.from_arrays([*kept, pa.array(np.full(len(rows), k), pa.int32()), pa.array(ids, pa.binary()), pa.array(np.diff(first)), pa.array(logp), pa.array(key_), pa.array(score)], [*names, *added])

    return docs.select(*dict.fromkeys([*names, "text", "__seed"])).mapInArrow(run, f"{ddl}, sample int, ids binary, n_pieces long, log_prob double, perturbed double, inclusion double")


def decode(rows: DataFrame, model: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``rows`` with the text of the piece ids in ``ids``; null ids give a null text."""
    rows = rows.drop(text)
    names = [f.name for f in rows.schema.fields]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(model)
        for whole in batches:
            for b in slices(whole, ids, STEP_BYTES):
                column = b.column(names.index(ids))
                data, offs = string_parts(column)
                piece = data.view("<i4") if len(data) else np.zeros(0, np.int32)
                size = words.sizes[piece]
                take = np.repeat(words.starts[piece] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
                raw = words.flat[take].tobytes()
                at = np.concatenate([[0], np.cumsum(size)])[offs // 4]
                out = [raw[x + 1 : y] if y > x else b"" for x, y in zip(at[:-1], at[1:], strict=True)]
                decoded = pa.array([x.decode("utf-8", "replace") for x in out], pa.string())
                if column.null_count:
                    decoded = pa.array([x if ok else None for x, ok in zip(decoded.to_pylist(), column.is_valid().to_pylist(), strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([*b.columns, decoded], [*names, text])

    return rows.mapInArrow(run, f"{ddl}, `{text}` string")
