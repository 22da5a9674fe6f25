"""Sampling segmentations of texts into the pieces of a SentencePiece vocabulary, and decoding them.

A text's segmentations are the paths through the lattice of all pieces that match it (the
processor's own normalisation first; characters without a piece go to byte pieces). A piece of
rank r weighs -ln(r + 10) / temperature, so a path's weight is a log-probability up to the
lattice's total, which one backward pass gives.

Gumbel top-k without replacement: giving every path its weight plus Gumbel noise and taking the
k largest draws k distinct paths in proportion to their probabilities. The noise is drawn
lazily, from the top: a prefix holds the maximum over its paths. Going down, the next piece is
drawn in proportion, and with it the maximum; all other pieces at that place are one waiting node,
whose maximum is drawn under the condition that it lies below (it is that of the total
probability of what it stands for). A best-first (A-star) search opens the waiting node of the
largest maximum: a further piece is drawn from it, the rest waits on. So only the prefixes of drawn
paths are ever opened. The (k + 1)-th maximum is the threshold from which a path's inclusion
score follows, 1 - exp(-exp(log-probability - threshold)).

Only runs of word marks stand after a piece's first character, so no piece crosses into the
next mark: the lattice falls apart into segments, whose nodes are built once each, for many
segments at a time, and kept (``KEEP`` nodes at most). Descents go through all segments of
all texts of a batch at once, one piece a step.

Random numbers are a hash of the row's key, the place in the text and what they are drawn for, so
results don't depend on partitions, batches or retries.

Nulls and edge cases: a null text is the empty one and has one segmentation, of no pieces; a
text with fewer than k segmentations gives them all, each with inclusion 1; the inclusion of a
path whose log-probability lies 745 or more below the threshold (long texts) underflows to 0; rows with equal keys
and texts draw the same; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from noteloom.llm.shared import KEPT, mix, only, slices
from noteloom.llm.textscan import span_hashes

RANK_SHIFT = 10.0
KEEP = 1_500_000
MARK = "\u2581".encode()
_lattices: dict[tuple[str, float], "Lattice"] = {}
KEPT.append(_lattices)
SAMPLE = "sample int, ids array<int>, log_prob double, perturbed double, inclusion double"
#: What a random number is drawn for.
_PIECE, _SIBLING, _ROOT = 1, 2, 3
#: Below the largest log-mass by this, a node can't come before others (53-bit draws exceed it by 36.8 at most).
_FAR = 45.0


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices start[i] .. start[i] + size[i] - 1, one range after another."""
    ends = np.cumsum(size)
    return np.repeat(start - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)


class _Grown:
    """An array that grows at its end."""

    def __init__(self, kind: str):
        self.data, self.n = np.zeros(1 << 12, kind), 0

    def add(self, values: np.ndarray) -> None:
        if self.n + len(values) > len(self.data):
            more = np.zeros(max(len(self.data) // 2, self.n + len(values) - len(self.data)), self.data.dtype)
            self.data = np.concatenate([self.data, more])
        self.data[self.n : self.n + len(values)] = values
        self.n += len(values)


class Lattice:
    """Nodes (places in segments) and ways (pieces that lead on), kept from batch to batch."""

    def __init__(self, path: str, temperature: float):
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        p, size = self.processor, self.processor.get_piece_size()
        pieces: dict[bytes, tuple[int, float]] = {}
        self.byte_ids = np.zeros(256, np.int32)
        shown: list[bytes] = []
        for i in range(size):
            piece = p.id_to_piece(i)
            shown.append(b"")
            if p.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                shown[-1] = bytes([int(piece[3:5], 16)])
            elif not (p.is_control(i) or p.is_unknown(i) or p.is_unused(i)):
                rank = min(-p.get_score(i), float(size))
                pieces[piece.encode()] = (i, -math.log(rank + RANK_SHIFT) / temperature)
                shown[-1] = piece.replace("\u2581", " ").encode()
        self.byte_weight = -math.log(size + RANK_SHIFT) / temperature
        #: Bytes that every id stands for.
        self.shown, self.shown_size = np.frombuffer(b"".join(shown), np.uint8), np.array([len(x) for x in shown], np.int64)
        self.shown_start = np.cumsum(self.shown_size) - self.shown_size
        begins = {piece[:i] for piece in pieces for i in range(1, len(piece))}
        every = sorted(begins | set(pieces))
        sizes = np.array([len(x) for x in every], np.int64)
        ends = np.cumsum(sizes)
        hashes = span_hashes(np.frombuffer(b"".join(every), np.uint8), ends - sizes, ends, False)
        order = np.argsort(hashes)
        self.known = hashes[order]
        self.known_id = np.array([pieces[x][0] if x in pieces else -1 for x in every], np.int64)[order]
        self.known_weight = np.array([pieces[x][1] if x in pieces else 0.0 for x in every])[order]
        self.known_more = np.array([x in begins for x in every])[order]
        # Where the hashes of each leading 18 bits begin, and how many there are at most.
        self.bucket = np.searchsorted(self.known, np.arange(1 << 18, dtype=np.uint64) << np.uint64(46))
        self.bucket_most = int(np.diff(np.append(self.bucket, len(every))).max())
        self.clear()

    def _known(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of each hash among the known ones, whether it is there)."""
        at = self.bucket[(h >> np.uint64(46)).astype(np.int64)]
        last = len(self.known) - 1
        for _ in range(self.bucket_most):
            at = np.minimum(at + (self.known[np.minimum(at, last)] < h), last)
        return at, self.known[at] == h

    def clear(self) -> None:
        self.segments: dict[int, int] = {}  # hash of a segment: its first node
        self.first, self.ways_of = _Grown("i4"), _Grown("i4")
        # By way: its node, cumulative probability there, log-probability, node it leads to (-1: the end), ids.
        self.node, self.cum, self.log_p, self.to = _Grown("i4"), _Grown("f8"), _Grown("f8"), _Grown("i4")
        self.ids_at, self.n_ids = _Grown("i4"), _Grown("u1")
        self.ids = _Grown("i4")
        self.ids.add(np.arange(len(self.shown_size), dtype=np.int32))

    def _build(self, data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """Nodes and ways of new segments data[s:e]; their first nodes."""
        size = e - s
        ends = np.cumsum(size)
        raw = data[_spread(s, size)]
        start_of = (raw & 0xC0) != 0x80
        place = np.flatnonzero(start_of)  # byte where each node stands
        n = len(place)
        node_at = np.cumsum(start_of) - 1
        seg = np.searchsorted(ends, place, "right")
        stop = ends[seg]
        after = np.minimum(np.append(place[1:], len(raw)), stop)  # where the character there ends
        after_of = np.zeros(len(raw) + 1, np.int64)
        after_of[place] = after
        owner, reach, number, weight = [], [], [], []
        single = np.zeros(n, bool)
        alive, end = np.arange(n), after.copy()
        first_step = True
        while len(alive):
            h = span_hashes(raw, place[alive], end, False)
            at, hit = self._known(h)
            whole = hit & (self.known_id[at] >= 0)
            owner.append(alive[whole])
            reach.append(end[whole])
            number.append(self.known_id[at[whole]])
            weight.append(self.known_weight[at[whole]])
            if first_step:
                single[alive[whole]] = True
                first_step = False
            on = hit & self.known_more[at] & (end < stop[alive])
            alive, end = alive[on], after_of[end[on]]
        lone = np.flatnonzero(~single)  # characters without a piece: their bytes
        width = (after - place)[lone]
        lone_at = self.ids.n + np.cumsum(width) - width
        self.ids.add(self.byte_ids[raw[_spread(place[lone], width)]])
        # Nodes are numbered by their distance from the segment's end, so that the backward pass takes
        # one slice a distance; a node's ways stand together, longest first.
        left = (node_at[stop - 1] - np.arange(n)).astype(np.int32)
        by = np.argsort(left, kind="stable")
        number_of = np.empty(n, np.int64)
        number_of[by] = np.arange(n)
        own = number_of[np.concatenate([*owner[::-1], lone])]
        to, w = np.concatenate([*reach[::-1], after[lone]]), np.concatenate([*weight[::-1], self.byte_weight * width])
        ids_at = np.concatenate([*number[::-1], lone_at])
        n_ids = np.ones(len(own), np.uint8)
        n_ids[len(own) - len(lone) :] = width
        order = np.argsort(own, kind="stable")
        own, to, w = own[order], to[order], w[order]
        ways = np.bincount(own, minlength=n)
        first = np.cumsum(ways) - ways
        nxt = np.where(to == stop[by][own], n, number_of[node_at[np.minimum(to, len(raw) - 1)]])
        below, terms = np.zeros(n + 1), np.empty(len(own))  # behind the last node stands the end, with 0
        edge = np.searchsorted(left[by], np.arange(left.max(initial=-1) + 2))
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
            x, y = int(first[a]), int(first[b]) if b < n else len(own)
            t = terms[x:y] = w[x:y] + below[nxt[x:y]]
            heads = first[a:b] - x
            top = np.maximum.reduceat(t, heads)
            below[a:b] = top + np.log(np.add.reduceat(np.exp(t - np.repeat(top, ways[a:b])), heads))
        log_p = np.minimum(terms - below[own], 0.0)
        total = np.cumsum(np.exp(log_p))
        cum = total - np.append(0.0, total)[first][own]
        cum[first + ways - 1] = 2.0  # whatever is drawn, the last way takes it
        base = self.first.n
        self.first.add(first + self.cum.n)
        self.ways_of.add(ways)
        self.node.add(own + base)
        self.cum.add(cum)
        self.log_p.add(log_p)
        self.to.add(np.where(nxt == n, -1, nxt + base))
        self.ids_at.add(ids_at[order])
        self.n_ids.add(n_ids[order])
        return number_of[node_at[np.append(0, ends[:-1])]] + base

    def nodes(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first node and byte where it begins of every segment, first segment of each text and the end)."""
        n = len(data)
        if n == 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
        mark = np.zeros(n, bool)
        mark[:-2] = (data[:-2] == MARK[0]) & (data[1:-1] == MARK[1]) & (data[2:] == MARK[2])
        begin = mark.copy()
        begin[3:] &= ~mark[:-3]
        begin[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
        s = np.flatnonzero(begin)
        e = np.append(s[1:], n)
        distinct, at, which = np.unique(span_hashes(data, s, e, False), return_index=True, return_inverse=True)
        if self.first.n > KEEP:
            self.clear()
        keys = distinct.tolist()
        found = np.array([self.segments.get(k, -1) for k in keys], np.int64)
        new = np.flatnonzero(found < 0)
        if len(new):
            found[new] = self._build(data, s[at[new]], e[at[new]])
            self.segments.update(zip(distinct[new].tolist(), found[new].tolist()))
        return found[which], s, np.searchsorted(s, offsets)

    def _draw(self, node: np.ndarray, u: np.ndarray) -> np.ndarray:
        """A way from each node, in proportion: the first whose cumulative probability exceeds u."""
        way = self.first.data[node].astype(np.int64)
        on = np.flatnonzero(self.cum.data[way] <= u)
        while len(on):
            way[on] += 1
            on = on[self.cum.data[way[on]] <= u[on]]
        return way

    def _descend(self, node: np.ndarray, seed: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From ``node`` of each segment (-1: nothing to do) to its end: (ways in turn, how many)."""
        steps = np.zeros(len(node), np.int64)
        act = np.flatnonzero(node >= 0)
        now, taken = node[act], []
        while len(act):
            way = self._draw(now, _uniform(seed[act], place[act] + len(taken), _PIECE))
            taken.append((act, way))
            steps[act] += 1
            now = self.to.data[way]
            on = now >= 0
            act, now = act[on], now[on]
        out = np.empty(int(steps.sum()), np.int64)
        begin = np.cumsum(steps) - steps
        for nth, (act, way) in enumerate(taken):
            out[begin[act] + nth] = way
        return out, steps

    def sample_batch(self, texts: list[str | None], k: int, seeds: np.ndarray) -> list[dict[str, np.ndarray]]:
        """For the 1st, 2nd .. k-th draw, of the texts that have so many: text, way list (flat and its
        bounds), log_prob, perturbed, and inclusion in all of them."""
        normal = [self.processor.normalize(x or "").encode() for x in texts]
        offsets = np.append(0, np.cumsum([len(x) for x in normal]))
        first, s, segs = self.nodes(np.frombuffer(b"".join(normal), np.uint8), offsets)
        n = len(texts)
        place = s - np.repeat(offsets[:-1], np.diff(segs))  # byte in the text; the steps inside are counted on from it
        text = np.repeat(np.arange(n), np.diff(segs))
        waiting: list[list[tuple]] = [[(-math.log(-math.log(x)), -1, 0, 0, 0.0, (), 0.0)] for x in _uniform(seeds, np.zeros(n, np.int64), _ROOT).tolist()]
        rounds: list[dict[str, np.ndarray]] = []
        where: list[np.ndarray] = []  # of each round: index of a text in it, -1 if it isn't
        for nth in range(k):
            live = [i for i in range(n) if waiting[i]]
            if not live:
                break
            # Open each text's best node: (maximum, round and step it branches from, segment, node, log-mass before, ways gone, their probability).
            opened = [waiting[i].pop(0) for i in live]
            who = np.array(live)
            salt = _salted(seeds, nth)
            node = np.full(len(first), -1, np.int64)
            begin_seg = np.array([segs[i] + x[3] for i, x in zip(live, opened)])
            chosen = np.full(len(live), -1, np.int64)
            if nth == 0:
                node[:] = first
            else:
                rest = _spread(begin_seg + 1, segs[who + 1] - begin_seg - 1)
                node[rest] = first[rest]
                for j, (i, x) in enumerate(zip(live, opened)):
                    chosen[j] = way = self._other_way(x[4], x[5], float(_uniform(salt[i : i + 1], np.array([x[2]]), _SIBLING + 4)[0]))
                    node[begin_seg[j]] = self.to.data[way]
            ways, steps = self._descend(node, salt[text], place)
            # Steps of each open text: those of the parent before the branch, the chosen way, the new ones.
            seg_end = np.append(0, np.cumsum(steps))
            fresh_at, fresh = seg_end[begin_seg], seg_end[segs[who + 1]] - seg_end[begin_seg]
            kept_at, kept, before = np.zeros(len(live), np.int64), np.zeros(len(live), np.int64), np.zeros(len(live))
            if nth:
                kept = np.array([x[2] for x in opened])
                before = np.array([x[6] for x in opened])
            size = kept + (chosen >= 0) + fresh
            bounds = np.append(0, np.cumsum(size))
            flat = ways if nth == 0 else np.empty(int(bounds[-1]), np.int64)
            if nth:
                flat[_spread(bounds[:-1] + size - fresh, fresh)] = ways[_spread(fresh_at, fresh)]
            for j, x in enumerate(opened):
                if x[1] >= 0:
                    parent = rounds[x[1]]
                    at = int(parent["bounds"][where[x[1]][live[j]]])
                    a = int(bounds[j])
                    flat[a : a + x[2]] = parent["flat"][at : at + x[2]]
                    flat[a + x[2]] = chosen[j]
            log_p = self.log_p.data[flat]
            total = np.append(0.0, np.cumsum(log_p))
            log_prob = total[bounds[1:]] - total[bounds[:-1]]
            best = np.array([x[0] for x in opened])
            rounds.append({"text": who, "flat": flat, "bounds": bounds, "log_prob": log_prob, "perturbed": best})
            index = np.full(n, -1, np.int64)
            index[who] = np.arange(len(who))
            where.append(index)
            # The segment of a new step: that of its place among the ways just drawn, or of the branch.
            seg_of = lambda step, own: np.where((nth > 0) & (step == kept[own]), begin_seg[own], np.searchsorted(seg_end, fresh_at[own] + step - (size - fresh)[own], "right") - 1)  # noqa: B023, E731
            self._wait(waiting, live, opened, nth, k - nth, flat, seg_of, bounds, kept, total, best, before, salt, segs)
        floor = np.array([x[0][0] if x else -np.inf for x in waiting])
        for got in rounds:
            gap = np.minimum(got["log_prob"] - floor[got["text"]], 700.0)
            got["inclusion"] = np.where(np.isinf(floor[got["text"]]), 1.0, -np.expm1(-np.exp(gap)))
        return rounds

    def _other_way(self, node: int, gone: tuple[int, ...], u: float) -> int:
        """A way from the node in proportion, none of those gone."""
        a = int(self.first.data[node])
        left = [w for w in range(a, a + int(self.ways_of.data[node])) if w not in gone]
        p = np.exp(self.log_p.data[left])
        return left[min(int(np.searchsorted(np.cumsum(p), u * p.sum(), "right")), len(left) - 1)]

    def _wait(self, waiting, live, opened, nth, room, flat, seg_of, bounds, kept, total, best, before, salt, segs) -> None:
        """Draw the maxima of what branches off the new steps and keep each text's ``room`` largest."""
        n_gone, names = np.array([len(x[5]) for x in opened]), np.array(live)
        # Log-mass before a step only falls along a text, so near steps are those up to some place.
        start, stop = bounds[:-1] + kept, bounds[1:]
        middle = np.clip(np.searchsorted(-total, _FAR - total[bounds[:-1]]), start, stop)
        for near in (True, False):
            if near:
                a, b = start, middle
            else:  # far nodes matter only to texts that have too few others
                need = np.array([len(waiting[i]) < room or waiting[i][room - 1][0] < 37.0 - _FAR for i in live], bool)
                a, b = middle, np.where(need, stop, middle)
            at, own = _spread(a, b - a), np.repeat(np.arange(len(live)), b - a)
            step, lead = at - bounds[own], total[at] - total[bounds[own]]
            branch = (step == kept[own]) & (nth > 0)
            node = self.node.data[flat[at]]
            spent = np.exp(self.log_p.data[flat[at]]) + np.where(branch, before[own], 0.0)
            some = (self.ways_of.data[node] > 1 + np.where(branch, n_gone[own], 0)) & (spent < 1.0)
            at, own, step, lead, branch, node, spent = (x[some] for x in (at, own, step, lead, branch, node, spent))
            if not len(at):
                continue
            late = np.log(-np.log(_uniform(salt[names[own]], step, _SIBLING)))
            value = -np.logaddexp(-best[own], late - lead - np.log1p(-spent))
            seg = seg_of(step, own)
            texts, heads = np.unique(own, return_index=True)
            group = np.repeat(np.arange(len(texts)), np.diff(np.append(heads, len(own))))
            first_few, left = [], value.copy()
            for _ in range(room):  # each text's largest, one after another
                high = np.maximum.reduceat(left, heads)
                x = np.flatnonzero((left == high[group]) & (left > -np.inf))
                if not len(x):
                    break
                x = x[np.unique(group[x], return_index=True)[1]]
                first_few += x.tolist()
                left[x] = -np.inf
            for x in first_few:
                j = int(own[x])
                gone = (*(opened[j][5] if branch[x] else ()), int(flat[at[x]]))
                waiting[live[j]].append((float(value[x]), nth, int(step[x]), int(seg[x] - segs[live[j]]), int(node[x]), gone, float(spent[x])))
            for i in live:
                waiting[i].sort(key=lambda x: -x[0])
                del waiting[i][room:]

    def ids_of(self, got: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts of a round in turn, where each text's begin and the end)."""
        size = self.n_ids.data[got["flat"]].astype(np.int64)
        at = self.ids_at.data[got["flat"]]
        if (size == 1).all():
            return self.ids.data[at], got["bounds"]
        ids = self.ids.data[_spread(at.astype(np.int64), size)]
        return ids, np.append(0, np.cumsum(size))[got["bounds"]]

    def bytes_of(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes that lists of ids stand for, where each list's begin and the end); the mark that the
        normalisation put before a text is left out."""
        size = self.shown_size[ids]
        raw = self.shown[_spread(self.shown_start[ids], size)]
        bounds = np.append(0, np.cumsum(size))[at]
        lead = np.zeros(len(at) - 1, np.int64)
        some = np.flatnonzero(np.diff(bounds) > 0)
        lead[some] = raw[bounds[:-1][some]] == 32
        return raw, np.stack([bounds[:-1] + lead, bounds[1:]])

    def sample(self, text: str | None, k: int, seed: str) -> list[tuple[list[int], float, float, float]]:
        """k distinct segmentations of one text at most: (ids, log-probability, perturbed one, inclusion score)."""
        out = []
        for got in self.sample_batch([text], k, _seeds([seed])):
            ids, _ = self.ids_of(got)
            out.append((ids.tolist(), float(got["log_prob"][0]), float(got["perturbed"][0]), float(got["inclusion"][0])))
        return out


def _seeds(names: list[str]) -> np.ndarray:
    raw = [x.encode() for x in names]
    ends = np.cumsum([len(x) for x in raw]).astype(np.int64)
    return span_hashes(np.frombuffer(b"".join(raw), np.uint8), ends - [len(x) for x in raw], ends, False)


def _salted(seeds: np.ndarray, nth: int) -> np.ndarray:
    return mix(seeds + np.uint64((nth + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))


def _uniform(seed: np.ndarray, place: np.ndarray, use: int) -> np.ndarray:
    """Numbers in (0, 1) from seed, place and what they are for."""
    h = mix(seed + (place.astype(np.uint64) * np.uint64(8) + np.uint64(use)) * np.uint64(0xD6E8FEB86659FD93))
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def lattice(path: str, temperature: float) -> Lattice:
    if (path, temperature) not in _lattices:
        _lattices[path, temperature] = Lattice(path, temperature)
    return _lattices[path, temperature]


def _drawn(rows: DataFrame, keys: list[str], text: str, model: str, k: int, temperature: float, seed: int, finish, schema: str, names: list[str]) -> DataFrame:
    """``finish(lattice, round)`` gives the columns behind the keys for every round of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source = lattice(model, temperature)
        for batch in slices(batches, 4000, 2 << 20):
            own = [c.to_pylist() for c in batch.columns[:-1]]
            seeds = _seeds([f"{seed}:" + ":".join(repr(c[i]) for c in own) for i in range(batch.num_rows)])
            for nth, got in enumerate(source.sample_batch(batch.columns[-1].to_pylist(), k, seeds), 1):
                kept = [c.take(pa.array(got["text"])) for c in batch.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(np.full(len(got["text"]), nth, np.int32)), *finish(source, got)], [*keys, "sample", *names])

    kinds = dict(rows.select(*keys).dtypes)
    return only(rows, *keys, text).mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in keys) + ", sample int, " + schema)


def sample_segmentations(rows: DataFrame, keys: list[str], text: str, model: str, k: int = 3, temperature: float = 1.0, seed: int = 1) -> DataFrame:
    """Up to k rows per input row: its keys, sample number, ids, log_prob, perturbed, inclusion."""

    def finish(source: Lattice, got: dict[str, np.ndarray]) -> list[pa.Array]:
        ids, at = source.ids_of(got)
        return [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids)), pa.array(got["log_prob"]), pa.array(got["perturbed"]), pa.array(got["inclusion"])]

    return _drawn(rows, keys, text, model, k, temperature, seed, finish, "ids array<int>, log_prob double, perturbed double, inclusion double", ["ids", "log_prob", "perturbed", "inclusion"])


def sample_digests(rows: DataFrame, keys: list[str], text: str, model: str, k: int = 3, temperature: float = 1.0, seed: int = 1) -> DataFrame:
    """The same samples as number of pieces, crc32 of the ids (little-endian, 32 bits) and crc32 of the
    text they decode to, so that ids stay in the task that drew them."""

    def finish(source: Lattice, got: dict[str, np.ndarray]) -> list[pa.Array]:
        ids, at = source.ids_of(got)
        raw = memoryview(np.ascontiguousarray(ids, "<i4")).cast("B")
        crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
        text, (start, stop) = source.bytes_of(ids, at)
        text = memoryview(text)
        decoded = [zlib.crc32(text[a:b]) for a, b in zip(start.tolist(), stop.tolist())]
        return [pa.array(got["log_prob"]), pa.array(got["perturbed"]), pa.array(got["inclusion"]), pa.array(np.diff(at), pa.int32()), pa.array(crc, pa.int64()), pa.array(decoded, pa.int64())]

    names = ["log_prob", "perturbed", "inclusion", "n_pieces", "ids_crc32", "text_crc32"]
    return _drawn(rows, keys, text, model, k, temperature, seed, finish, "log_prob double, perturbed double, inclusion double, n_pieces int, ids_crc32 long, text_crc32 long", names)


def encode_pieces(rows: DataFrame, keys: list[str], text: str, model: str) -> DataFrame:
    """The vocabulary's own segmentation: keys and ids."""
    kinds = dict(rows.select(*keys).dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1000):
            ids = lattice(model, 1.0).processor.encode([x or "" for x in batch.columns[-1].to_pylist()], num_threads=1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(ids, pa.list_(pa.int32()))], [*keys, "ids"])

    return only(rows, *keys, text).mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in keys) + ", ids array<int>")


def decode_pieces(rows: DataFrame, keys: list[str], model: str) -> DataFrame:
    """Texts of ``ids``: keys and text; null ids give null."""
    kinds = dict(rows.select(*keys).dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1000):
            decode = lattice(model, 1.0).processor.decode
            texts = [None if x is None else decode(x) if x else "" for x in batch.columns[-1].to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], [*keys, "text"])

    return only(rows, *keys, "ids").mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in keys) + ", text string")
