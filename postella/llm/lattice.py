"""Lattices of subword pieces over many short byte strings at once, in numpy.

Pieces come from an existing SentencePiece model. Its pieces never hold a space after another
character or a line break, so a text's lattice falls apart at these into *units*; equal units have equal
lattices and are built once. A unit falls apart further into *atoms*, wherever no piece crosses; so text without
spaces, such as Japanese, isn't one deep lattice. All atoms are walked together, a byte at a time; the few deep ones, which
pieces hold together over hundreds of bytes, are walked alone. What a unit gives doesn't depend on the units beside it.
Characters that no single piece covers are spelled in byte pieces, among
them a literal U+2581, which the model would otherwise read as a space; so decoding is lossless.
"""

from __future__ import annotations

import math
import re

import numpy as np

_B = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD1B54A32D192ED03)
UNIT = re.compile(rb"\n| *[^ \n]+| +")
SPACE = "▁"
#: Bytes of an atom beyond which it is walked alone.
DEEP = 256
_loaded: dict[str, "Pieces"] = {}


class Pieces:
    """Pieces of a model as byte strings, with log weights from their scores: in a merge vocabulary a
    score is minus the rank, and the weight is Zipf's, 1 / (1 + rank), normalised."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        self.raw: list[bytes] = [b""] * size
        self.byte = np.full(256, -1, np.int32)
        rank = np.full(size, np.inf)
        whole: list[int] = []
        for i in range(size):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte[int(p[3:5], 16)] = i
                self.raw[i] = bytes([int(p[3:5], 16)])
                rank[i] = size
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                raw = p.replace(SPACE, " ").encode()
                if b"\n" in raw or b" " in raw.lstrip(b" "):
                    continue
                self.raw[i] = raw
                rank[i] = -sp.get_score(i)
                whole.append(i)
        if (self.byte < 0).any():
            raise ValueError("the model has no byte pieces")
        with np.errstate(divide="ignore"):
            w = -np.log1p(rank)
        self.log = w - np.log(np.exp(w).sum())
        self.size = size
        # for each length the hashes of all prefixes of pieces, and the piece that ends there or -1
        found: dict[bytes, int] = {}
        for i in whole:
            for m in range(1, len(self.raw[i])):
                found.setdefault(self.raw[i][:m], -1)
            found[self.raw[i]] = i
        by: dict[int, list[tuple[int, int]]] = {}
        for p, i in found.items():
            h = 0
            for c in p:
                h = (h * int(_B) + c + 1) & 0xFFFFFFFFFFFFFFFF
            by.setdefault(len(p), []).append((h, i))
        self.prefixes = []
        for m in range(1, max(by) + 1):
            pairs = sorted(by[m])
            self.prefixes.append((np.array([h for h, _ in pairs], np.uint64), np.array([i for _, i in pairs], np.int32)))


def load(path: str) -> Pieces:
    """The pieces of a model, read once per worker."""
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


class Lattice:
    """All segmentations of the units. Node first byte + atom + p is byte p of an atom; edges are sorted by end."""

    def __init__(self, pieces: Pieces, units: list[bytes], log: np.ndarray | None = None):
        log = pieces.log if log is None else log
        n = len(units)
        size = np.fromiter(map(len, units), np.int64, n)
        buf = np.frombuffer(b"".join(units), np.uint8)
        self._start = np.cumsum(size) - size
        at = np.arange(len(buf), dtype=np.int32)
        room = np.repeat((self._start + size).astype(np.int32), size) - at  # bytes left in the unit
        h = np.zeros(len(buf), np.uint64)
        single = np.zeros(len(buf), bool)
        width = 1 + (buf >= 0xC0).astype(np.int8) + (buf >= 0xE0) + (buf >= 0xF0)
        lead = (buf & 0xC0) != 0x80
        from_, to, piece = [], [], []
        for m, (hashes, ids) in enumerate(pieces.prefixes, 1):
            at_room = room[at] >= m
            at, h = at[at_room], h[at_room]
            if not len(at):
                break
            h = h * _B + buf[at + m - 1] + np.uint64(1)
            j = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            hit = hashes[j] == h
            at, h, j = at[hit], h[hit], j[hit]
            ends = ids[j] >= 0
            s = at[ends]
            from_.append(s)
            to.append(s + m)
            piece.append(ids[j[ends]])
            single[s[width[s] == m]] = True
        bare = np.flatnonzero(lead & ~single)
        if len(bare):
            w = width[bare]
            s = (np.repeat(bare, w) + np.arange(int(w.sum())) - np.repeat(np.cumsum(w, dtype=np.int64) - w, w)).astype(np.int32)
            from_.append(s)
            to.append(s + 1)
            piece.append(pieces.byte[buf[s]])
        del at, h, room, single
        z = np.zeros(0, np.int32)
        s, e, p = np.concatenate([z, *from_]), np.concatenate([z, *to]), np.concatenate([z, *piece])
        del from_, to, piece
        # an atom begins where a character does that no piece crosses into
        over = np.bincount(s + 1, minlength=len(buf) + 1)[: len(buf) + 1] - np.bincount(e, minlength=len(buf) + 1)
        cut = lead & (np.cumsum(over[:-1]) == 0)
        cut[self._start] = True
        begin = np.flatnonzero(cut).astype(np.int32)
        atoms = len(begin)
        length = np.diff(np.r_[begin, len(buf)]).astype(np.int32)
        self._atoms = np.searchsorted(begin, np.r_[self._start, len(buf)])  # of each unit, with the end appended
        u = np.repeat(np.arange(atoms, dtype=np.int32), length)[s]
        del over, cut, lead
        order = np.argsort(e + u, kind="stable")
        s, e, u = s[order], e[order], u[order]
        self.source, self.target, self.piece = s + u, e + u, p[order].astype(np.int32)
        del order, p, s
        nth = np.arange(atoms, dtype=np.int32)
        self._first, self._last = begin + nth, begin + length + nth
        self._deep = length > DEEP
        self.nodes = len(buf) + atoms
        self.weight = log[self.piece]
        depth = np.where(self._deep[u], 0, e - begin[u])
        del e, u
        by = np.argsort(depth, kind="stable").astype(np.int32)
        cuts = np.r_[0, np.cumsum(np.bincount(depth, minlength=1))]
        self.alpha = np.full(self.nodes, -np.inf)
        self.alpha[self._first] = 0
        for d in range(1, len(cuts) - 1):
            k = by[cuts[d] : cuts[d + 1]]
            if len(k):
                self._sum(self.alpha, self.target[k], self.alpha[self.source[k]] + self.weight[k])
        for a in np.flatnonzero(self._deep):
            lo, source, target, weight = self._edges(a)
            self.alpha[lo : self._last[a] + 1] = _walk(self._last[a] + 1 - lo, source, target, weight)
        self.log_likelihood = np.add.reduceat(self.alpha[self._last], self._atoms[:-1]) if n else np.zeros(0)

    def _edges(self, a: int) -> tuple[int, list[int], list[int], list[float]]:
        """First node of the atom, and its edges with nodes counted from there."""
        lo = int(self._first[a])
        i, j = np.searchsorted(self.target, [lo + 1, self._last[a] + 1])
        return lo, (self.source[i:j] - lo).tolist(), (self.target[i:j] - lo).tolist(), self.weight[i:j].tolist()

    @staticmethod
    def _sum(into: np.ndarray, node: np.ndarray, values: np.ndarray) -> None:
        """into[node] = logsumexp of its values; equal nodes stand together."""
        at = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
        top = np.maximum.reduceat(values, at)
        safe = np.where(np.isfinite(top), top, 0)
        with np.errstate(divide="ignore"):
            into[node[at]] = safe + np.log(np.add.reduceat(np.exp(values - np.repeat(safe, np.diff(np.r_[at, len(node)]))), at))

    def expected(self, times: np.ndarray, size: int) -> np.ndarray:
        """Expected uses of each piece when unit u occurs times[u] times (forward-backward)."""
        nodes = self._last - self._first + 1
        beta = np.full(self.nodes, -np.inf)
        beta[self._last] = 0
        total = np.repeat(self.alpha[self._last], nodes)
        back = np.repeat(self._last, nodes) - np.arange(self.nodes)  # bytes to the atom's end
        back[np.repeat(self._deep, nodes)] = 0
        far = back[self.source]
        order = np.lexsort((self.source, far))
        cuts = np.r_[0, np.cumsum(np.bincount(far, minlength=1))]
        for d in range(1, len(cuts) - 1):
            k = order[cuts[d] : cuts[d + 1]]
            if len(k):
                self._sum(beta, self.source[k], beta[self.target[k]] + self.weight[k])
        for a in np.flatnonzero(self._deep):
            lo, source, target, weight = self._edges(a)
            end = int(self._last[a]) - lo
            by = sorted(range(len(source)), key=source.__getitem__, reverse=True)
            turned = _walk(end + 1, [end - target[i] for i in by], [end - source[i] for i in by], [weight[i] for i in by])
            beta[lo : lo + end + 1] = turned[::-1]
        post = np.exp(self.alpha[self.source] + self.weight + beta[self.target] - total[self.source])
        post *= np.repeat(np.repeat(times, np.diff(self._atoms)), nodes)[self.source]
        return np.bincount(self.piece, np.nan_to_num(post), size)

    def sampler(self) -> None:
        """Prepare backward sampling: for each node the running probabilities of the edges into it."""
        self.weight += self.alpha[self.source]
        self.weight -= self.alpha[self.target]
        cum = np.exp(self.weight)
        del self.weight
        self._ptr = np.searchsorted(self.target, np.arange(self.nodes + 1, dtype=np.int32)).astype(np.int32)
        # summed node by node: the r-th edges of all nodes at once
        rank = np.arange(len(cum), dtype=np.int32) - self._ptr[self.target]
        order = np.argsort(rank, kind="stable").astype(np.int32)
        cuts = np.r_[0, np.cumsum(np.bincount(rank, minlength=1))]
        for r in range(1, len(cuts) - 1):
            k = order[cuts[r] : cuts[r + 1]]
            cum[k] += cum[k - 1]
        self._cum = cum
        self._end = self._ptr[1:]

    def _choose(self, node: np.ndarray, key: np.ndarray) -> np.ndarray:
        """The edge into each node, drawn with its own random key."""
        from .common import mix

        r = (mix(key) >> np.uint64(11)).astype(np.float64) * 2.0**-53
        e = self._ptr[node]
        last = self._end[node] - 1
        more = np.flatnonzero((e < last) & (r >= self._cum[e]))
        while len(more):
            e[more] += 1
            more = more[(e[more] < last[more]) & (r[more] >= self._cum[e[more]])]
        return e

    def sample(self, unit: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One segmentation for each occurrence of a unit: pieces in order, and how many each occurrence has. The
        choice at a node is drawn with the occurrence's random key and the node's place in the unit."""
        many = np.diff(self._atoms)[unit]
        atom = np.repeat(self._atoms[unit] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        # so that key + node is the occurrence's key + the byte in the unit
        shift = np.repeat(key, many) - (np.repeat(self._start[unit], many) + atom).astype(np.uint64) * _STEP
        n = len(atom)
        node, stop = self._last[atom], self._first[atom]
        count = np.zeros(n, np.int64)
        deep: dict[int, np.ndarray] = {}
        for i in np.flatnonzero(self._deep[atom]):
            lo, hi = int(self._first[atom[i]]), int(self._last[atom[i]])
            nodes = np.arange(lo + 1, hi + 1)
            edge = self._choose(nodes, shift[i] + nodes.astype(np.uint64) * _STEP)
            back, path, x = (self.source[edge] - lo).tolist(), [], hi - lo
            while x:
                path.append(x - 1)
                x = back[x - 1]
            deep[int(i)] = self.piece[edge[path[::-1]]]
            count[i] = len(path)
        live = np.flatnonzero(~self._deep[atom])
        node = node[live]
        rounds: list[tuple[np.ndarray, np.ndarray]] = []
        while len(live):
            e = self._choose(node, shift[live] + node.astype(np.uint64) * _STEP)
            rounds.append((live, self.piece[e]))
            count[live] += 1
            node = self.source[e]
            on = node != stop[live]
            live, node = live[on], node[on]
        end = np.cumsum(count)
        out = np.empty(int(end[-1]) if n else 0, np.int32)
        for t, (who, piece) in enumerate(rounds):
            out[end[who] - 1 - t] = piece
        for i, piece in deep.items():
            out[end[i] - len(piece) : end[i]] = piece
        return out, np.add.reduceat(count, np.cumsum(many) - many) if len(unit) else count


def _walk(n: int, source: list[int], target: list[int], weight: list[float]) -> np.ndarray:
    """Log sums of all paths from node 0 to each of n nodes; edges are in the order of their targets."""
    out = [-math.inf] * n
    out[0] = 0.0
    i, m = 0, len(target)
    while i < m:
        t = target[i]
        values = []
        while i < m and target[i] == t:
            values.append(out[source[i]] + weight[i])
            i += 1
        top = max(values)
        if top > -math.inf:
            out[t] = top + math.log(sum([math.exp(v - top) for v in values]))
    return np.array(out)
