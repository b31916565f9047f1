"""SentencePiece encoding by sampled segmentations, and decoding.

A text's lattice has every piece of a given SentencePiece vocabulary as an arc, and bytes
where a character is no piece.  Encoding samples distinct segmentations without replacement:
an A-star search over the lattice whose hypotheses carry Gumbel-perturbed scores.  The best
child of a hypothesis inherits its score, so a search that is exact in the total weights
never turns back: each sample is one descent from the best open hypothesis, and what a
descent passes by stays open.  At each node all arcs that were not taken are one hypothesis,
opened only when it is the best.  The score of the best hypothesis left open is the
threshold that gives every sample its inclusion score.

Weights: a BPE vocabulary has ranks instead of probabilities; a piece of rank r weighs
1 / (r + 1), a byte as much as the last rank, all raised to ``ALPHA``.

Lattices are independent from one blank to the next, since no piece has a blank after
another character.  Distinct units of a batch are therefore built once; numbers are drawn by
hash from the row key, the sample, the unit and the step, so that a row's samples do not
depend on the batch it comes in.

Defined cases: NULL and empty texts have one sample, without pieces, of probability 1; a
text with fewer segmentations than asked for has as many as there are; rows of equal key and
text get equal samples; the character that SentencePiece writes for a blank is encoded by
its bytes, so decoding returns every text as it was; texts are used whole; an empty table
gives an empty one; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortscope.llm.common import give_back_memory, keep_memory, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SAMPLES = 2
ALPHA = 0.3
SEED = 1
BATCH_CHARS = 800_000
EARLY = 64                  # steps of a path that are always perturbed
DRAW_LIMIT = 37.0           # -log(-log(u)) of the largest number drawn with 52 bits
LONG = 48                   # characters of a unit whose weights are summed in logs
SCALE = 4.0                 # per character, so that shorter units neither vanish nor overflow
_BLANK = "▁"
_UNIT = re.compile(r"\x20+[^\x20]*|[^\x20]+")
_P1, _P2, _P3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9,
                                       0x94D049BB133111EB))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _P2
    x = (x ^ (x >> np.uint64(27))) * _P3
    return x ^ (x >> np.uint64(31))


def uniform(key: np.ndarray, *counters) -> np.ndarray:
    """Numbers in (0, 1) drawn by hash from a key and counters."""
    x = key
    for c, odd in zip(counters, (_P1, _P2, _P3)):
        x = x + (np.atleast_1d(c).astype(np.uint64) + np.uint64(1)) * odd
    x = _mix(x)
    return ((x >> np.uint64(12)).astype(np.float64) + 0.5) / 2.0 ** 52


class Vocabulary:
    """Pieces of a SentencePiece model, findable by the hash of their code points."""

    def __init__(self, model: bytes, alpha: float = ALPHA):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        ids = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i)
                                           or sp.is_unknown(i) or sp.is_unused(i))]
        self.byte_id = np.zeros(256, np.int32)
        self.bytes: list[bytes] = [b""] * n
        for i in range(n):
            if sp.is_byte(i):
                value = int(sp.id_to_piece(i)[1:-1], 16)
                self.byte_id[value], self.bytes[i] = i, bytes([value])
        for i in ids:
            self.bytes[i] = sp.id_to_piece(i).replace(_BLANK, " ").encode()
        ranked = any(sp.get_score(i) < -1000 for i in ids)      # ranks, not log probabilities
        weight = np.zeros(n)
        for rank, i in enumerate(ids):
            weight[i] = -np.log(rank + 1) if ranked else sp.get_score(i)
        self.size = np.array([len(b) for b in self.bytes])
        self.start = np.cumsum(self.size) - self.size
        self.spelled = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.weight = alpha * weight
        self.factor = np.exp(self.weight)
        self.byte_weight = float(alpha * (weight[ids].min() if ids else 0.0))
        spelled = [sp.id_to_piece(i).replace(_BLANK, " ") for i in ids]
        length = np.array([len(t) for t in spelled], np.int64)
        self.longest = int(length.max(initial=1))
        codes = np.frombuffer("".join(spelled).encode("utf-32-le", "surrogatepass"), np.uint32)
        first = np.cumsum(length) - length
        found, prefixes, h = np.zeros(len(ids), np.uint64), [], np.zeros(len(ids), np.uint64)
        for k in range(self.longest):           # all pieces, a character at a time
            on = np.flatnonzero(length > k)
            h[on] = h[on] * _P1 + _mix(codes[first[on] + k].astype(np.uint64) + _P2)
            found[on] = _mix(h[on])
            prefixes.append(found[on])
        prefixes = np.concatenate(prefixes)
        order = np.argsort(found)
        self.hashes, self.ids = found[order], np.array(ids, np.int64)[order]
        self.prefix_bits = self._bits(prefixes)
        lead = (self.hashes >> np.uint64(44)).astype(np.int64)
        self.held = np.bincount(lead, minlength=1 << 20).astype(np.int16)
        self.begin = np.searchsorted(lead, np.arange(1 << 20)).astype(np.int32)

    @staticmethod
    def _bits(hashes: np.ndarray) -> np.ndarray:
        """Which leading 20 bits occur; what is not among them need not be looked up."""
        out = np.zeros(1 << 20, bool)
        out[hashes >> np.uint64(44)] = True
        return out

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece of each mixed hash, -1 where there is none: the few pieces whose hash begins
        with the same 20 bits are compared one after another."""
        out = np.full(len(h), -1)
        lead = h >> np.uint64(44)
        at = np.flatnonzero(self.held[lead])
        slot = self.begin[lead[at]]
        left = self.held[lead[at]]
        while len(at):
            hit = self.hashes[slot] == h[at]
            out[at[hit]] = self.ids[slot[hit]]
            go = np.flatnonzero(~hit & (left > 1))
            at, slot, left = at[go], slot[go] + 1, left[go] - 1
        return out

    def decode(self, ids: np.ndarray, edge: np.ndarray) -> list[bytes]:
        """Texts, in UTF-8, of segmentations that follow each other; ``edge`` is where they
        begin and end.  The blank put before every text goes."""
        size = self.size[ids]
        end = np.cumsum(size)
        at = np.repeat(self.start[ids] - (end - size), size) + np.arange(end[-1] if len(end) else 0)
        data = self.spelled[at].tobytes()
        cuts = np.r_[0, end][edge].tolist()
        return [data[a + (data[a:a + 1] == b" " and a < b):b] for a, b in zip(cuts, cuts[1:])]


@lru_cache(2)
def vocabulary(model: bytes, alpha: float) -> Vocabulary:
    return Vocabulary(model, alpha)


class Lattices:
    """Lattices of distinct units: nodes of a unit follow each other, arcs are listed.

    Arcs into a node follow each other by size, nodes by depth, so that one pass over the
    list, depth by depth, sums the weights of all ways.  ``share`` is an arc's share of the
    weight of all ways to its node, ``piece`` its id or, for bytes, minus one minus the code
    point, ``begin`` and ``into`` its nodes.
    """

    def __init__(self, units: list[str], v: Vocabulary):
        codes = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        owner = np.repeat(np.arange(len(units)), sizes)
        self.first = np.cumsum(sizes + 1) - sizes - 1           # node where a unit begins
        self.last = self.first + sizes
        n = int(sizes.sum()) + len(units)
        node = np.arange(len(codes)) + owner                    # node before a character
        left = self.last[owner] - node                          # characters from it on
        mixed = _mix(codes.astype(np.uint64) + _P2)
        at, h = np.arange(len(codes)), np.zeros(len(codes), np.uint64)
        found_arcs = []                                         # (into, size, weight, piece)
        for size in range(1, v.longest + 1):
            ok = left[at] >= size
            at, h = at[ok], h[ok]
            if not len(at):
                break
            h = h * _P1 + mixed[at + size - 1]
            key = _mix(h)
            if size > 1:                                        # some piece goes on so
                ok = v.prefix_bits[key >> np.uint64(44)]
                at, h, key = at[ok], h[ok], key[ok]
            found = v.find(key)
            hit = np.flatnonzero(found >= 0)
            ids = found[hit]
            found_arcs.append((node[at[hit]] + size, size, v.factor[ids] * SCALE ** size, ids))
            if size == 1 and len(hit) < len(at):
                at_miss = at[found < 0]
                miss = codes[at_miss].astype(np.int64)
                n_bytes = 1 + (miss > 0x7F) + (miss > 0x7FF) + (miss > 0xFFFF)
                found_arcs.append((node[at_miss] + 1, 1, np.exp(v.byte_weight * n_bytes) * SCALE,
                                   -1 - miss))
        self._list(found_arcs, n, sizes)

    def _list(self, found, n: int, sizes: np.ndarray) -> None:
        depth = np.arange(n) - np.repeat(self.first, sizes + 1)
        long = np.repeat(sizes > LONG, sizes + 1)
        kind = np.int16 if depth.max(initial=0) < 2 ** 14 else np.int32
        # nodes of short units, by depth, then those of long ones
        order = np.argsort((depth + long * (LONG + 1)).astype(kind), kind="stable")
        self.count = np.zeros(n, np.int32)
        for into, *_ in found:
            self.count[into] += 1                               # at most one arc of a size
        upto = np.cumsum(self.count[order])
        self.start = np.empty(n, np.int64)
        self.start[order] = upto - self.count[order]
        total = int(upto[-1]) if n else 0
        self.share, self.piece = np.empty(total), np.empty(total, np.int32)
        self.into, self.begin = np.empty(total, np.int32), np.empty(total, np.int32)
        filled = np.zeros(n, np.int32)
        for into, size, weight, piece in found:
            slot = self.start[into] + filled[into]
            filled[into] += 1
            self.share[slot], self.piece[slot] = weight, piece
            self.into[slot], self.begin[slot] = into, into - size
        self.reach = np.empty(total, np.float32)
        key = (depth + long * (LONG + 1))[order]
        cuts = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True]) if n else [0]
        whole = np.ones(n)                                      # weight of all ways to a node
        whole[long] = 0.0                                       # in logs, for long units
        for low, high in zip(cuts[:-1], cuts[1:]):
            nodes = order[low:high]
            nodes = nodes[self.count[nodes] > 0]
            if len(nodes):
                self._depth(nodes, whole, bool(long[nodes[0]]))

    def _depth(self, nodes: np.ndarray, whole: np.ndarray, logs: bool) -> None:
        """Shares of the arcs into nodes of one depth."""
        count = self.count[nodes]
        low = self.start[nodes]
        arcs = slice(int(low[0]), int(low[-1] + count[-1]))
        edge = low - low[0]
        x = self.share[arcs]
        if logs:
            x = np.log(x) + whole[self.begin[arcs]]
            top = np.maximum.reduceat(x, edge)
            x = np.exp(x - np.repeat(top, count))
            total = np.add.reduceat(x, edge)
            whole[nodes] = top + np.log(total)
        else:
            x = x * whole[self.begin[arcs]]
            total = np.add.reduceat(x, edge)
            whole[nodes] = total
        x = x / np.repeat(total, count)
        self.share[arcs] = x
        upto = np.cumsum(x)
        reach = upto - np.repeat(upto[edge] - x[edge], count)
        reach[edge + count - 1] = 2.0                           # the last arc takes the rest
        self.reach[arcs] = reach

    def choose(self, node: np.ndarray, u: np.ndarray) -> np.ndarray:
        """Arc into each node by its share."""
        arc = self.start[node]
        open_ = np.flatnonzero(self.reach[arc] <= u)
        while len(open_):
            arc[open_] += 1
            open_ = open_[self.reach[arc[open_]] <= u[open_]]
        return arc


class Search:
    """Sampling of one batch of documents.

    A path is its steps, in the order of the documents' units and, within a unit, from its
    end to its begin: arc, log probability before the step, perturbed score of what the
    step passed by.
    """

    def __init__(self, keys: np.ndarray, texts: list[str], v: Vocabulary, seed: int):
        per_doc = [_UNIT.findall(" " + t) if t else [] for t in texts]
        counts = np.array([len(x) for x in per_doc], np.int64)
        units = list(chain.from_iterable(per_doc))
        ids = defaultdict(count().__next__)                     # numbered as they come
        self.unit = np.fromiter(map(ids.__getitem__, units), np.int64, len(units))
        self.lattice = Lattices(list(ids), v)
        self.doc = np.repeat(np.arange(len(texts)), counts)
        self.edge = np.r_[0, np.cumsum(counts)]
        self.place = np.arange(len(self.doc)) - self.edge[self.doc]
        self.seed = _mix(keys.astype(np.uint64) * _P1 + np.uint64(seed))
        self.n = len(texts)

    def walk(self, units: np.ndarray, node: np.ndarray, sample: int, step: np.ndarray):
        """Ancestral sampling from the given nodes back to the begin of their units."""
        lat, out = self.lattice, []
        first = lat.first[self.unit[units]]
        while len(units):
            u = uniform(self.seed[self.doc[units]], sample, self.place[units], step)
            arc = lat.choose(node, u)
            out.append((units, step, arc))
            node, step = lat.begin[arc], step + 1
            go = node > first
            units, node, step, first = units[go], node[go], step[go], first[go]
        if not out:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*out))

    def path(self, parts, sample: int, top: np.ndarray, k: int, fresh_from=None):
        """Join steps, in order, and perturb what the steps passed by.

        ``top`` is the score that the new steps inherit; steps before ``fresh_from`` (unit
        and step per document) were taken with an earlier sample and pass nothing new by.
        A draw adds at most ``DRAW_LIMIT`` to the location, so steps too deep to reach the
        k + 1 best are left out without being drawn.
        """
        lat = self.lattice
        unit, step, arc = (np.concatenate(x) for x in zip(*parts))
        # the steps of a unit are numbered without gaps: their order needs no sort
        edge_of = np.cumsum(np.bincount(unit, minlength=len(self.unit)))
        spot = np.r_[0, edge_of][unit] + step
        order = np.empty(len(unit), np.int64)
        order[spot] = np.arange(len(unit))
        unit, step, arc = unit[order], step[order], arc[order]
        doc = self.doc[unit]
        log_p = np.log(lat.share[arc])
        edge = np.searchsorted(doc, np.arange(self.n + 1))
        run = np.r_[0.0, np.cumsum(log_p)]
        before = run[:-1] - run[edge[doc]]
        score = np.full(len(unit), -np.inf)
        inside = np.arange(len(unit)) - edge[doc]
        old = np.zeros(len(unit), bool)
        if fresh_from is not None:
            at, of = fresh_from
            old = (unit < at[doc]) | ((unit == at[doc]) & (step <= of[doc]))
        early = (inside < EARLY) & ~old
        wanted = np.full((self.n, EARLY), -np.inf)
        for some in (early, None):
            if some is None:            # only steps that can still be among the best
                best = np.partition(wanted, EARLY - 1 - k, axis=1)[:, EARLY - 1 - k]
                some = (inside >= EARLY) & ~old & (before + DRAW_LIMIT >= best[doc])
            some = np.flatnonzero(some)
            others = np.where(lat.count[lat.into[arc[some]]] == 1, 0.0,
                              -np.expm1(np.minimum(log_p[some], 0.0)))
            with np.errstate(divide="ignore"):
                rest = before[some] + np.log(others)
            of_doc = doc[some]
            u = uniform(self.seed[of_doc], sample + 1000, self.place[unit[some]], step[some])
            score[some] = truncated_gumbel(rest, top[of_doc], u)
            first = inside[some] < EARLY
            wanted[of_doc[first], inside[some][first]] = score[some][first]
        return {"unit": unit, "step": step, "arc": arc, "before": before, "score": score,
                "edge": edge, "log_p": run[edge[1:]] - run[edge[:-1]]}

    def samples(self, k: int):
        """Per document, up to ``k`` samples: (path, score), and the score left open."""
        everything = np.arange(len(self.unit))
        zero = np.zeros(len(self.unit), np.int64)
        lat = self.lattice
        top = -np.log(-np.log(uniform(self.seed, 0, 0, 0)))
        ends = lat.last[self.unit] if len(self.unit) else zero
        paths = [self.path([self.walk(everything, ends, 0, zero)], 0, top, k)]
        tops, alive = [top], [np.ones(self.n, bool)]
        taken = np.zeros(0, np.int64)
        for sample in range(1, k + 1):
            best, where, which = self._best(paths)
            if sample == k:
                return paths, tops, alive, best
            docs = np.flatnonzero(best > -np.inf)
            mask = np.zeros(self.n, bool)
            mask[docs] = True
            at, of = np.full(self.n, -1), np.full(self.n, -1)
            new, taken = self._open(paths, docs, where, which, taken, best, sample, at, of)
            old = [(which[d], paths[which[d]]["edge"][d], where[d]) for d in docs]
            parts = [self._before(paths, old)]
            parts.append((at[docs], of[docs], new))
            go = docs[lat.begin[new] > lat.first[self.unit[at[docs]]]] if len(docs) else docs
            begin = np.zeros(self.n, np.int64)
            begin[docs] = lat.begin[new]
            parts.append(self.walk(at[go], begin[go], sample, of[go] + 1))
            later = everything[mask[self.doc] & (everything > at[self.doc])]
            parts.append(self.walk(later, lat.last[self.unit[later]], sample,
                                   np.zeros(len(later), np.int64)))
            paths.append(self.path(parts, sample, best, k, (at, of)))
            tops.append(best)
            alive.append(mask)

    def _best(self, paths):
        """Best open hypothesis of every document: score, step and path."""
        best = np.full(self.n, -np.inf)
        where, which = np.zeros(self.n, np.int64), np.zeros(self.n, np.int64)
        for k, p in enumerate(paths):
            size = np.diff(p["edge"])
            filled = np.flatnonzero(size)
            if not len(filled):
                continue
            high = np.maximum.reduceat(p["score"], p["edge"][filled])
            spot = np.flatnonzero(p["score"] == np.repeat(high, size[filled]))
            first = spot[np.searchsorted(spot, p["edge"][filled])]
            up = high > best[filled]
            of = filled[up]
            best[of], where[of], which[of] = high[up], first[up], k
        return best, where, which

    def _open(self, paths, docs, where, which, taken, best, sample, at, of):
        """Choose, per document, among the arcs not yet taken at its step, which then passes
        the others by; notes the steps in ``at`` and ``of`` and returns the arcs, and those
        taken so far as numbers of path, step and arc."""
        lat = self.lattice
        arc, before = np.zeros(len(docs), np.int64), np.zeros(len(docs))
        for k, p in enumerate(paths):
            mine = np.flatnonzero(which[docs] == k)
            step = where[docs[mine]]
            arc[mine], before[mine] = p["arc"][step], p["before"][step]
            at[docs[mine]], of[docs[mine]] = p["unit"][step], p["step"][step]
        if not len(docs):
            return arc, taken
        node = lat.into[arc]
        number = (which[docs] << 44 | where[docs]) << 8         # a node has fewer arcs
        taken = np.union1d(taken, number | (arc - lat.start[node]))
        count = lat.count[node].astype(np.int64)
        doc = np.repeat(np.arange(len(docs)), count)
        local = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
        free = ~np.isin(number[doc] | local, taken)
        doc, local = doc[free], local[free]
        arcs = lat.start[node[doc]] + local
        left = np.bincount(doc, minlength=len(docs))            # never none: the score was open
        edge = np.cumsum(left) - left
        share = lat.share[arcs]
        upto = np.cumsum(share)
        upto -= np.repeat(upto[edge] - share[edge], left)
        total = upto[edge + left - 1]
        place = self.place[at[docs]]
        u = uniform(self.seed[docs], sample + 2000, place, of[docs]) * total
        pick = np.minimum(np.bincount(doc, upto < np.repeat(u, left), len(docs)).astype(np.int64),
                          left - 1) + edge
        rest = np.where(left > 1, np.maximum(total - share[pick], 0.0), 0.0)
        u = uniform(self.seed[docs], sample + 3000, place, of[docs])
        with np.errstate(divide="ignore"):
            score = truncated_gumbel(before + np.log(rest), best[docs], u)
        for k, p in enumerate(paths):
            mine = np.flatnonzero(which[docs] == k)
            p["score"][where[docs[mine]]] = score[mine]
        return arcs[pick], np.union1d(taken, number | local[pick])

    @staticmethod
    def _before(paths, old):
        """Steps of earlier paths from the begin of a document up to the given ones."""
        if not old:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate([paths[k][name][a:b] for k, a, b in old])
                     for name in ("unit", "step", "arc"))

    def ids(self, p, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of a path in reading order, and where each document's begin."""
        unit = p["unit"]
        size = np.bincount(unit, minlength=len(self.unit))
        low = np.cumsum(size) - size
        # a unit's steps run from its end to its begin: turn each unit's steps round
        piece = self.lattice.piece[p["arc"][low[unit] + size[unit] - 1 - p["step"]]]
        edge = p["edge"]
        low = np.flatnonzero(piece < 0)
        if not len(low):
            return piece.astype(np.int32), edge
        missed, which = np.unique(piece[low], return_inverse=True)
        spelled = [v.byte_id[list(chr(-1 - x).encode("utf-8", "surrogatepass"))]
                   for x in missed.tolist()]
        wide = np.ones(len(piece), np.int64)
        wide[low] = np.array([len(s) for s in spelled])[which]
        at = np.r_[0, np.cumsum(wide)]
        out = np.zeros(at[-1], np.int32)
        out[at[:-1]] = np.maximum(piece, 0)
        padded = np.zeros((len(spelled), 4), np.int32)
        for i, s in enumerate(spelled):
            padded[i, :len(s)] = s
        for k in range(4):
            some = wide[low] > k
            out[at[low[some]] + k] = padded[which[some], k]
        return out, at[edge]


def truncated_gumbel(location: np.ndarray, top: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel number of the given location that is known to be below ``top``."""
    with np.errstate(over="ignore", invalid="ignore"):
        out = location - np.log(np.exp(np.minimum(location - top, 700.0)) - np.log(u))
    return np.where(location == -np.inf, -np.inf, np.minimum(out, top))


def log_inclusion(log_p: np.ndarray, threshold: np.ndarray) -> np.ndarray:
    """Log of the chance to score above the threshold: 1 - exp(-exp(log_p - threshold))."""
    x = log_p - threshold
    with np.errstate(divide="ignore", over="ignore"):
        return np.where(x < -30, x, np.log(-np.expm1(-np.exp(np.minimum(x, 50.0)))))


NAMES = ("doc_id", "sample", "ids", "log_prob", "perturbed", "log_inclusion", "decoded_sha256")
SCHEMA = ("doc_id bigint, sample int, ids array<int>, log_prob double, perturbed double, "
          "log_inclusion double")


def _rows(keys, texts, v, k, seed, check=False):
    """Record batch of all samples of a batch of documents."""
    search = Search(np.array([0 if i is None else i for i in keys], np.int64), texts, v, seed)
    paths, tops, alive, left = search.samples(k)
    batches = []
    for n, (p, top, mask) in enumerate(zip(paths, tops, alive)):
        docs = np.flatnonzero(mask)
        ids, edge = search.ids(p, v)
        lists = pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(ids))
        scores = (p["log_p"], top, log_inclusion(p["log_p"], left))
        cols = [pa.array(keys, pa.int64()), pa.array(np.full(len(keys), n + 1, np.int32)), lists,
                *[pa.array(np.round(x, 9)) for x in scores]]    # sums end in a batch's noise
        if check:
            cols.append(pa.array([hashlib.sha256(t).hexdigest() for t in v.decode(ids, edge)],
                                 pa.string()))
        rows = pa.RecordBatch.from_arrays(cols, NAMES[:len(cols)])
        batches.append(rows if len(docs) == len(keys) else rows.take(pa.array(docs)))
    return batches


def encode(docs: DataFrame, model: str = MODEL, samples: int = SAMPLES, alpha: float = ALPHA,
           seed: int = SEED, id_col: str = "doc_id", text: str = "text",
           check: bool = False) -> DataFrame:
    """``samples`` distinct segmentations of every document, one row each.

    ``check`` adds the SHA-256 of each segmentation's decoded text.  The driver reads the
    vocabulary and sends it with the task.
    """
    with open(model, "rb") as f:
        data = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(data, alpha)
        keys, texts, held = [], [], 0
        keep_memory()
        for batch in batches:
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                keys.append(key)
                texts.append(value.as_py() or "")
                held += len(texts[-1])
                if held >= BATCH_CHARS:
                    yield from _rows(keys, texts, v, samples, seed, check)
                    keys, texts, held = [], [], 0
        if keys:
            yield from _rows(keys, texts, v, samples, seed, check)
        give_back_memory()

    return docs.select(F.col(id_col).cast("long"), F.col(text)).mapInArrow(
        run, SCHEMA + (", decoded_sha256 string" if check else ""))


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """Add the text of every segmentation, as ``decoded``."""
    with open(model, "rb") as f:
        data = f.read()
    names = encoded.columns
    at = names.index("ids")

    def run(batches):
        v = vocabulary(data, ALPHA)
        for batch in batches:
            lists = batch.column(at)
            ids = lists.flatten().to_numpy(zero_copy_only=False)
            edge = np.r_[0, np.cumsum([len(x) if x.is_valid else 0 for x in lists])]
            texts = [t.decode("utf-8", "surrogatepass") for t in v.decode(ids, edge)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())],
                                             [*names, "decoded"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(run, f"{kinds}, decoded string")


def op4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), check=True).withColumn(
        "n_pieces", F.size("ids"))


QUERIES = {"op4_pieces": op4_pieces}
ORACLE: dict[str, str] = {}
