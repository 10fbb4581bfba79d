"""SentencePiece encoding and decoding with segmentations sampled without replacement.

The model's pieces span a lattice over the normalised text (a space becomes
the meta symbol, one is put in front).  A path's probability is the product of
its pieces' weights, normalised over the lattice by a backward pass, so the
lattice is a left-to-right tree of choices.  Its segmentations are drawn by
Gumbel top-k: an A* search over that tree in which a node's priority is the
largest perturbed log probability among its leaves.  Following the best child
costs no queue: the node's maximum is passed on unchanged, and each step leaves
behind one sibling group whose own maximum is a Gumbel truncated at it.  The
best group left behind is where the next distinct segmentation branches off.

The search runs over all texts of an Arrow batch at once.  No piece crosses a
word start, so the lattice of each distinct word is built once for a batch.
All random numbers are hashes of (row key, sample, place in the text): a row
gets the same samples on every run and in every partitioning.

Byte-pair models store merge ranks, not probabilities; the weight of a piece is
then 1 / (rank + 1) (Zipf's law).  Characters that are no piece go to byte
pieces.  Decoding is exact for every text, the meta symbol itself included.

``encode_best`` gives the one segmentation of the largest probability, ``decode``
the texts of token sequences; pieces and words are told apart by 64-bit hashes.

Defined cases: a null or empty text has one segmentation, without tokens; a
text with fewer than k segmentations gets each of them once; a null key is a
key of its own; equal keys with equal texts get equal samples; an empty table
gives an empty result; only the key and the text are read, and a key with the
name of a result column is returned as ``key``.  The model is a file that every
executor can read: its path is a parameter, and only the registered query asks
the public tokenizers' package for one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from episodia.llm import textkernel as tk
from episodia.llm.shared import folded, named, unfolded

U64 = np.uint64
META, LITERAL_META, SPACE = 0x2581, 0x110000, 0x20
FALLBACK_SCORE = -12.0  # of one byte piece
SAMPLES = 2
SLICE_BYTES = 1 << 17

SCHEMA = "sample int, n_tokens long, log_prob double, perturbed double, inclusion double, ids_sha256 string, round_trip boolean"


def default_model() -> str:
    """The public tokenizers' SentencePiece file, where that package is installed."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class HashTable:
    """64-bit keys to integers: sorted keys, entered at the bucket of their leading bits."""

    BITS = 17

    def __init__(self, found: dict[int, int]):
        keys = np.array(sorted(found), np.uint64)
        self.values = np.array([found[int(x)] for x in keys] + [-1], np.int64)
        self.first = np.searchsorted(keys >> U64(64 - self.BITS), np.arange((1 << self.BITS) + 1, dtype=np.uint64))
        self.deepest = int(np.diff(self.first).max())
        self.keys = np.append(keys, U64(0))

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``h`` of known keys, and their values."""
        bucket = (h >> U64(64 - self.BITS)).astype(np.int64)
        at, end = self.first[bucket], self.first[bucket + 1]
        left = np.flatnonzero(at < end)
        at, end = at[left], end[left]
        hits, values = [], []
        for _ in range(self.deepest):
            same = self.keys[at] == h[left]
            hits.append(left[same])
            values.append(self.values[at[same]])
            on = np.flatnonzero(~same & (at + 1 < end))
            left, at, end = left[on], at[on] + 1, end[on]
        return np.concatenate(hits), np.concatenate(values)


class Model:
    """Pieces of a SentencePiece model as hash tables over code points."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.byte_id = np.zeros(256, np.int64)
        self.text = [b""] * n
        score = np.array([sp.get_score(i) for i in range(n)])
        self.score = -np.log(np.minimum(-score, n) + 1.0) if score.min() < -100 else score
        keys: list[dict[int, int]] = []
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.text[i] = bytes([int(piece[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i)):
                assert chr(META) not in piece.lstrip(chr(META)), "a piece crosses a word start"
                self.text[i] = piece.replace(chr(META), " ").encode()
                h = np.zeros(1, np.uint64)
                for k, c in enumerate(piece):
                    if len(keys) == k:
                        keys.append({})
                    h = one_more(h, np.array([ord(c)]))
                    key = int(h[0])
                    keys[k][key] = i if k + 1 == len(piece) else keys[k].get(key, -1)
        self.tables = []
        for found in keys:
            self.tables.append(HashTable(found))
        self.size = np.array([len(x) for x in self.text], np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.size)])
        self.bytes = np.frombuffer(b"".join(self.text), np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of a token sequence, without the space put in front."""
        size = self.size[ids]
        first = np.repeat(self.at[ids] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) if len(ids) else np.zeros(0, np.int64)
        return self.bytes[first + np.arange(len(first))].tobytes()


def one_more(h: np.ndarray, cp: np.ndarray) -> np.ndarray:
    """64-bit hashes of strings with one more code point each."""
    return tk.mix((h ^ cp.astype(np.uint64)) * U64(0xD6E8FEB86659FD93) + U64(0x3C6EF372FE94F82B))


@lru_cache(maxsize=2)
def model(path: str) -> Model:
    return Model(path)


def uniform(key: np.ndarray, *places: np.ndarray | int) -> np.ndarray:
    """Hash of a key and places as a number in (0, 1)."""
    h = key
    for k, x in enumerate(places):
        h = tk.mix(h + U64(0x9E3779B97F4A7C15) + np.asarray(x).astype(np.uint64) * U64(2 * k + 0xD1B54A32D192ED03))
    return ((h >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53


class Lattices:
    """The lattices of a set of distinct words.

    A node is a place between characters; the edges (pieces) that leave a node
    lie together, the longest first, with the probability of each given its node.
    """

    def __init__(self, m: Model, chars: np.ndarray, lengths: np.ndarray):
        self.model = m
        ends = np.cumsum(lengths)
        word = np.repeat(np.arange(len(lengths)), lengths)
        n = len(chars)
        self.first = ends - lengths + np.arange(len(lengths))  # a node more than characters in each word
        left = ends[word] - np.arange(n)
        alive = np.flatnonzero((chars < LITERAL_META) & ((chars < 0xDC80) | (chars > 0xDCFF)))
        count = np.zeros(n, np.int32)
        levels: list[tuple[np.ndarray, np.ndarray]] = []
        h = np.zeros(len(alive), np.uint64)
        for k, known in enumerate(m.tables):
            on = left[alive] > k
            alive, h = alive[on], h[on]
            if not len(alive):
                break
            h = one_more(h, chars[alive + k])
            hit, got = known.find(h)
            alive, h = alive[hit], h[hit]
            whole = got >= 0
            at = alive[whole]
            levels.append((at, got[whole]))
            count[at] += 1
            if k == 0:
                single = np.zeros(n, bool)
                single[at] = True
        bare = np.flatnonzero(~single) if levels else np.arange(n)
        count[bare] += 1
        # characters by their distance from the word's end; each one's edges lie together, the longest first
        far = int(left.max(initial=0))
        rank = np.argsort(left.astype(np.uint16) if far < 65536 else left, kind="stable")
        starts = np.cumsum(count[rank]) - count[rank]
        total = int(count.sum())
        first_edge = np.empty(n, np.int64)
        first_edge[rank] = starts
        fill = first_edge.copy()
        self.id = np.full(total, -1, np.int32)
        size = np.ones(total, np.int32)
        for k in range(len(levels) - 1, -1, -1):
            at, got = levels[k]
            e = fill[at]
            self.id[e], size[e] = got, k + 1
            fill[at] += 1
        score = m.score[self.id]
        score[fill[bare]] = FALLBACK_SCORE * code_bytes(chars[bare])
        of = np.repeat(rank, count[rank])
        self.char, self.src = chars[of], of + word[of]
        self.dst = self.src + size
        nodes = rank + word[rank]
        self.edge0 = np.zeros(n + len(lengths), np.int64)
        self.edge0[nodes] = starts
        beta = np.zeros(n + len(lengths))
        self.log_p, self.p = np.empty(total), np.empty(total)
        per_node = count[rank]
        bounds = np.concatenate([[0], np.cumsum(np.bincount(left, minlength=far + 1)[1:])]).tolist()
        starts_end = np.append(starts, total)
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            if lo == hi:
                continue
            e0, e1 = int(starts_end[lo]), int(starts_end[hi])
            s = score[e0:e1] + beta[self.dst[e0:e1]]
            cut, times = starts[lo:hi] - e0, per_node[lo:hi]
            top = np.maximum.reduceat(s, cut)
            s -= np.repeat(top, times)
            w = np.exp(s)
            whole = np.add.reduceat(w, cut)
            log_whole = np.log(whole)
            beta[nodes[lo:hi]] = top + log_whole
            self.log_p[e0:e1] = s - np.repeat(log_whole, times)
            self.p[e0:e1] = w / np.repeat(whole, times)
        self.final = np.zeros(total, bool)  # the last edge of its node
        self.final[starts_end[1:] - 1] = True

    def best(self, node: int, stop: int) -> list[int]:
        """The edges of the most probable path between two nodes of a word."""
        worth, edge = {stop: 0.0}, {}
        for at in range(stop - 1, node - 1, -1):
            own = self.leaving_node(at)
            value = self.log_p[own] + np.array([worth[x] for x in self.dst[own].tolist()])
            k = int(np.argmax(value))
            worth[at], edge[at] = float(value[k]), own.start + k
        out = []
        while node < stop:
            out.append(edge[node])
            node = int(self.dst[edge[node]])
        return out

    def leaving_node(self, node: int) -> slice:
        return self.leaving(int(self.edge0[node]))

    def leaving(self, edge: int) -> slice:
        """The edges of the node that ``edge`` leaves."""
        lo = int(self.edge0[self.src[edge]])
        hi = lo
        while not self.final[hi]:
            hi += 1
        return slice(lo, hi + 1)

    def walk(self, node: np.ndarray, stop: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sampled edges from each start node to the end of its word: (walker, step, edge)."""
        who = np.flatnonzero(node < stop)
        node = node[who]
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        step = 0
        while len(who):
            u = uniform(key[who], step)
            edge = self.edge0[node]
            u -= self.p[edge]
            on = np.flatnonzero((u > 0) & ~self.final[edge])
            while len(on):
                edge[on] += 1
                u[on] -= self.p[edge[on]]
                on = on[(u[on] > 0) & ~self.final[edge[on]]]
            out.append((who, np.full(len(who), step), edge))
            node = self.dst[edge]
            on = np.flatnonzero(node < stop[who])
            who, node = who[on], node[on]
            step += 1
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*out))

    def tokens(self, edges: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of edges, and the text each belongs to; byte pieces are spelled out."""
        ids = self.id[edges]
        rough = np.flatnonzero(ids < 0)
        if not len(rough):
            return ids, doc
        spelled = [self.model.byte_id[np.frombuffer(code_utf8(int(c)), np.uint8)] for c in self.char[edges[rough]]]
        times = np.ones(len(ids), np.int64)
        times[rough] = [len(x) for x in spelled]
        place = np.cumsum(times) - times
        out = np.repeat(ids, times)
        for p, x in zip(place[rough].tolist(), spelled):
            out[p : p + len(x)] = x
        return out, np.repeat(doc, times)


def _left_behind(lat: Lattices, edges: np.ndarray, lo: int, log_t: float, key: np.ndarray, sample: int, want: int) -> list[tuple]:
    """The ``want`` best sibling groups along a path from step ``lo`` on, as (score, step).

    A uniform number has 53 bits, so an exponential one is at least 2**-54: a
    group whose mass cannot reach the scores found so far is not drawn, which
    leaves the result as it is.
    """
    found: list[tuple] = []
    before, least = float(lat.log_p[edges[:lo]].sum()), -np.log(2.0**-54)
    size = 256
    while lo < len(edges):
        new = np.arange(lo, min(lo + size, len(edges)))
        lp, p = lat.log_p[edges[new]], lat.p[edges[new]]
        total = before + np.cumsum(lp)
        with np.errstate(divide="ignore"):
            mass = total - lp + np.log1p(-np.minimum(p, 1.0))
        t = np.logaddexp(log_t, np.log(-np.log(uniform(key, new, sample, 99))) - mass)
        best = np.argpartition(t, want - 1)[:want] if want < len(t) else np.arange(len(t))
        found = sorted([*found, *((float(t[i]), int(new[i])) for i in best if np.isfinite(t[i]))])[:want]
        before, lo, size = float(total[-1]), lo + len(new), size * 4
        if len(found) == want and -least - before > found[-1][0]:
            break
    return found


def _all_left_behind(lat: Lattices, edges: np.ndarray, edge_at: np.ndarray, lo: np.ndarray, before: np.ndarray, log_t: np.ndarray, key: np.ndarray, sample: int, want: int, depth: int = 512) -> list[list[tuple]]:
    """``_left_behind`` for all texts of a batch: their first ``depth`` steps at once, the rest only where it can matter."""
    length = np.diff(edge_at)
    count = np.minimum(depth, length - lo)
    place = np.cumsum(count) - count
    who = np.repeat(np.arange(len(lo)), count)
    new = np.arange(int(count.sum())) - place[who] + lo[who]
    e = edges[edge_at[who] + new]
    lp = lat.log_p[e]
    run = np.concatenate([[0.0], np.cumsum(lp)])
    total = run[1:] - run[place[who]] + before[who]
    with np.errstate(divide="ignore"):
        mass = total - lp + np.log1p(-np.minimum(lat.p[e], 1.0))
    t = np.logaddexp(log_t[who], np.log(-np.log(uniform(key[who], new, sample, 99))) - mass)
    order = np.lexsort((t, who))
    top = order[np.arange(len(order)) - place[who] < want]
    top = top[np.isfinite(t[top])]
    out: list[list[tuple]] = [[] for _ in lo]
    for j, at, score in zip(who[top].tolist(), new[top].tolist(), t[top].tolist()):
        out[j].append((score, at))
    least = -np.log(2.0**-54)
    for j in np.flatnonzero(length > lo + depth).tolist():
        if len(out[j]) < want or -least - total[place[j] + count[j] - 1] <= out[j][-1][0]:
            out[j] = _left_behind(lat, edges[edge_at[j] : edge_at[j + 1]], int(lo[j]), float(log_t[j]), key[j : j + 1], sample, want)
    return out


def code_utf8(c: int) -> bytes:
    if c == LITERAL_META:
        return chr(META).encode()
    return chr(c).encode("utf-8", "surrogateescape")


def code_bytes(c: np.ndarray) -> np.ndarray:
    wide = 1 + (c >= 0x80).astype(np.int64) + (c >= 0x800) + ((c >= 0x10000) & (c != LITERAL_META))
    return np.where((c >= 0xDC80) & (c <= 0xDCFF), 1, wide)


def characters(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Normalised code points of non-empty texts, each with a meta symbol in front; the texts and their limits."""
    text = raw.tobytes().decode("utf-8", "surrogateescape")
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    full = np.flatnonzero(ends > starts)
    first = np.searchsorted(np.cumsum(code_bytes(cp)), starts[full], "right")
    cp[cp == META] = LITERAL_META
    cp[cp == SPACE] = META
    return np.insert(cp, first, META), full, first + np.arange(len(full))


class Units:
    """The words of a batch's non-empty texts, each of a lattice node range; equal words share their lattice."""

    def __init__(self, m: Model, texts: pa.Array):
        self.raw, self.starts, self.ends = tk.buffers(texts)
        cp, self.full, first = characters(self.raw, self.starts, self.ends)
        begins = np.zeros(len(cp), bool)
        begins[1:] = (cp[1:] == META) & (cp[:-1] != META)
        begins[first] = True
        unit = np.flatnonzero(begins)
        unit_end = np.append(unit[1:], len(cp)) if len(unit) else unit
        length = unit_end - unit
        _, at, self.word = np.unique(tk.range_hash(cp.astype("<i4").view(np.uint8), 4 * unit, 4 * unit_end), return_index=True, return_inverse=True)
        lengths = length[at]
        gather = np.repeat(unit[at] - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))
        self.lattices = Lattices(m, cp[gather], lengths)
        self.doc = np.searchsorted(first, unit, "right") - 1
        self.of_doc = np.searchsorted(self.doc, np.arange(len(self.full) + 1))
        self.start = self.lattices.first[self.word]
        self.stop = self.start + length


def best_batch(m: Model, texts: pa.Array) -> tuple[list[np.ndarray], list[float]]:
    """Token ids and log probability of each text's most probable segmentation."""
    u = Units(m, texts)
    ids, log_prob = [np.zeros(0, np.int64)] * len(u.starts), [0.0] * len(u.starts)
    lat = u.lattices
    known: dict[int, tuple[np.ndarray, float]] = {}
    for row, lo, hi in zip(u.full.tolist(), u.of_doc[:-1].tolist(), u.of_doc[1:].tolist()):
        parts = []
        for k in range(lo, hi):
            w = int(u.word[k])
            if w not in known:
                path = np.array(lat.best(int(u.start[k]), int(u.stop[k])), np.int64)
                known[w] = lat.tokens(path, np.zeros(len(path), np.int64))[0], float(lat.log_p[path].sum())
            parts.append(known[w])
        ids[row], log_prob[row] = np.concatenate([x for x, _ in parts]), sum(x for _, x in parts)
    return ids, log_prob


def sample_batch(m: Model, texts: pa.Array, keys: np.ndarray, k: int) -> dict[str, list]:
    """Up to ``k`` distinct segmentations of each text, best perturbed score first."""
    units = Units(m, texts)
    raw, starts, ends, full, doc = units.raw, units.starts, units.ends, units.full, units.doc
    n = len(full)
    out: dict[str, list] = {c: [] for c in ("row", "sample", "n_tokens", "log_prob", "perturbed", "inclusion", "ids", "round_trip")}

    def give(row, sample, log_prob, perturbed, ids, ok):
        for c, x in zip(out, (row, sample, len(ids), log_prob, perturbed, None, ids, ok)):
            out[c].append(x)

    for row in np.flatnonzero(ends == starts).tolist():
        give(row, 1, 0.0, float(-np.log(-np.log(uniform(keys[row : row + 1], 1)[0]))), np.zeros(0, np.int64), True)
        out["inclusion"][-1] = 1.0
    if not n:
        return out
    lat, unit_of_doc, start, stop = units.lattices, units.of_doc, units.start, units.stop
    key = tk.mix(keys[full] + U64(0xA5A5A5A5))
    spot = tk.mix(key[doc] + (np.arange(len(doc)) - unit_of_doc[doc]).astype(np.uint64) * U64(0xD1B54A32D192ED03))

    log_t = np.log(-np.log(uniform(key, 1)))  # log of exp(-G): the smaller, the better
    groups: list[list[tuple]] = [[] for _ in range(n)]  # sibling groups left: score, path, step, children gone
    paths: list[list[np.ndarray]] = [[] for _ in range(n)]
    branch: list[tuple | None] = [None] * n
    live = np.arange(n)
    for s in range(k):
        if not len(live):
            break
        # each live text's path: a head kept from an earlier one, then new steps to the end
        lo, turn, head_node = unit_of_doc[live].copy(), [], []
        heads = []
        for j, d in enumerate(live.tolist()):
            head = np.zeros(0, np.int64)
            if branch[d] is not None:
                head, at_unit = branch[d]
                lo[j] = at_unit
                turn.append(j)
                head_node.append(lat.dst[head[-1]])
            heads.append(head)
        count = unit_of_doc[live + 1] - lo
        place = np.cumsum(count) - count
        occ = np.repeat(lo - place, count) + np.arange(int(count.sum()))
        node = start[occ]
        node[place[turn]] = head_node
        walker, step, edge = lat.walk(node, stop[occ], spot[occ] + U64((s + 1) * 0x9E3779B9))
        steps = np.bincount(walker, minlength=len(occ))
        tail = np.empty(len(edge), np.int64)
        tail[(np.cumsum(steps) - steps)[walker] + step] = edge
        del walker, step, edge
        tail_at = np.concatenate([[0], np.cumsum(steps)])[np.append(place, len(occ))]
        found = [np.concatenate([heads[j], tail[tail_at[j] : tail_at[j + 1]]]) if len(heads[j]) else tail[tail_at[j] : tail_at[j + 1]] for j in range(len(live))]
        edges = np.concatenate(found)
        edge_at = np.concatenate([[0], np.cumsum([len(x) for x in found])])
        log_prob = np.add.reduceat(lat.log_p[edges], edge_at[:-1])
        ids, id_doc = lat.tokens(edges, np.repeat(np.arange(len(live)), np.diff(edge_at)))
        id_at = np.concatenate([[0], np.cumsum(np.bincount(id_doc, minlength=len(live)))])
        text_at = np.concatenate([[0], np.cumsum(m.size[ids])])[id_at].tolist()
        decoded = np.frombuffer(m.decode(ids), np.uint8)
        head_size = np.array([len(x) for x in heads])
        head_p = np.array([lat.log_p[x].sum() if len(x) else 0.0 for x in heads])
        left = _all_left_behind(lat, edges, edge_at, head_size, head_p, log_t[live], key[live], s, k - s)
        for j, d in enumerate(live.tolist()):
            row = int(full[d])
            ok = text_at[j + 1] - text_at[j] - 1 == ends[row] - starts[row] and np.array_equal(decoded[text_at[j] + 1 : text_at[j + 1]], raw[starts[row] : ends[row]])
            give(row, s + 1, float(log_prob[j]), float(-log_t[d]), ids[id_at[j] : id_at[j + 1]], bool(ok))
            paths[d].append(found[j])
            groups[d] += [(t, s, at, (int(found[j][at]),)) for t, at in left[j]]
        # the best group that is left is where the next segmentation branches off
        going = []
        for d in live.tolist():
            if not groups[d]:
                continue
            g = min(range(len(groups[d])), key=lambda i: groups[d][i][0])
            t, of, at, gone = groups[d].pop(g)
            if s == k - 1:
                log_t[d] = t
                going.append(d)
                continue
            path = paths[d][of]
            out_edges = lat.leaving(int(path[at]))
            p = lat.p[out_edges].copy()
            p[[e - out_edges.start for e in gone]] = 0.0
            c = np.cumsum(p)
            u = uniform(key[d : d + 1], at, s, len(gone), 55)[0] * c[-1]
            pick = int(min((c <= u).sum(), np.flatnonzero(p)[-1]))
            log_t[d] = t
            rest = c[-1] - p[pick]
            if np.count_nonzero(p) > 1 and rest > 0:
                before = float(lat.log_p[path[:at]].sum())
                e = float(np.log(-np.log(uniform(key[d : d + 1], at, s, len(gone), 56)[0])))
                groups[d].append((float(np.logaddexp(t, e - before - np.log(rest))), of, at, (*gone, out_edges.start + pick)))
            # the word that the branch lies in: as many word ends as the head has passed
            head = np.append(path[:at], out_edges.start + pick)
            passed = int((lat.src[path[1 : at + 1]] != lat.dst[path[:at]]).sum())
            branch[d] = (head, int(unit_of_doc[d]) + passed)
            going.append(d)
        live = np.array(going, np.int64)
    # the score of the first segmentation left out is the threshold of the inclusion scores
    bar = {int(full[d]): float(-log_t[d]) for d in live.tolist()}
    for i, row in enumerate(out["row"]):
        if out["inclusion"][i] is None:
            out["inclusion"][i] = float(-np.expm1(-np.exp(min(out["log_prob"][i] - bar[row], 700.0)))) if row in bar else 1.0
    return out


def _numbered_copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches with ``copy``, how many rows right before a row are equal to it, and a seed that depends on it.

    A row at the start of a part has number 1 (but in the first part), since its
    copy may be the last row of the part before: the two differ anyway.
    """
    before, count = None, 0
    start = int(TaskContext.get().partitionId() > 0)
    for b in batches:
        numbers = np.zeros(b.num_rows, np.int32)
        for i, own in enumerate(zip(b.column("seed").to_pylist(), b.column("same").to_pylist())):
            count = count + 1 if own == before else 0
            if before is None:
                count = start
            numbers[i], before = count, own
        seeds = b.column("seed").to_numpy().view(np.uint64)
        apart = np.where(numbers > 0, tk.mix(seeds + numbers.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), seeds)
        b = b.set_column(b.schema.get_field_index("seed"), "seed", pa.array(apart.view(np.int64)))
        yield b.append_column("copy", pa.array(numbers))


def _encoded(docs: DataFrame, key: str, text: str, fields: str, one, copies: bool = False) -> DataFrame:
    """The key (as ``key`` if it has the name of a result) and the columns that ``one(batch)`` gives with the rows they belong to."""
    results = T._parse_datatype_string(fields).fields
    name = "key" if key in [f.name for f in results] else key
    kind = docs.schema[key].dataType
    shape = T.StructType([T.StructField(name, kind), *results])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tk.slices(_numbered_copies(batches) if copies else batches, "text", SLICE_BYTES):
            row, cols = one(b)
            if copies:
                cols.append(b.column("copy").take(pa.array(row, pa.int64())))
            yield pa.RecordBatch.from_arrays([b.column("key").take(pa.array(row, pa.int64())), *cols], shape.names)

    same = [F.xxhash64(named(text)).alias("same")] if copies else []
    return docs.select(named(key).alias("key"), named(text).alias("text"), F.xxhash64(F.lit(41), named(key)).alias("seed"), *same).mapInArrow(run, shape)


def encode_samples(docs: DataFrame, path: str, k: int = SAMPLES, key: str = "doc_id", text: str = "text", ids: bool = False, copies: bool = False) -> DataFrame:
    """``key`` and up to ``k`` sampled segmentations of each row; with ``ids`` also the token ids.

    With ``copies``, equal rows that follow each other are copies of one document:
    each has its number in ``copy`` and samples of its own.
    """

    def one(b: pa.RecordBatch) -> tuple[list, list]:
        r = sample_batch(model(path), b.column("text"), b.column("seed").to_numpy().view(np.uint64), k)
        cols = [pa.array(r["sample"], pa.int32()), pa.array(r["n_tokens"], pa.int64()), *(pa.array(r[c], pa.float64()) for c in ("log_prob", "perturbed", "inclusion"))]
        cols += [pa.array([hashlib.sha256(x.astype("<i4").tobytes()).hexdigest() for x in r["ids"]], pa.string()), pa.array(r["round_trip"], pa.bool_())]
        return r["row"], cols + ([pa.array([x.astype(np.int32) for x in r["ids"]], pa.list_(pa.int32()))] if ids else [])

    return _encoded(docs, key, text, SCHEMA + (", ids array<int>" if ids else "") + (", copy int" if copies else ""), one, copies)


def encode_best(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, ids, log_prob``: the most probable segmentation of each row (ties: the longer piece first)."""

    def one(b: pa.RecordBatch) -> tuple[list, list]:
        ids, log_prob = best_batch(model(path), b.column("text"))
        return list(range(b.num_rows)), [pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())), pa.array(log_prob, pa.float64())]

    return _encoded(docs, key, text, "ids array<int>, log_prob double", one)


def decode(tokens: DataFrame, path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """``tokens`` with the text of their token ids (null for null; bytes that are no UTF-8 become U+FFFD); it replaces a column of that name."""
    rows = folded(tokens, ids)
    shape = T.StructType([rows.schema["row"], rows.schema["a0"], T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for b in batches:
            texts = [None if x is None else m.decode(np.array(x, np.int64))[1:].decode("utf-8", "replace") for x in b.column("a0").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("a0"), pa.array(texts, pa.string())], shape.names)

    return unfolded(rows.mapInArrow(run, shape), tokens.columns, {ids: "a0"}, {text: F.col("text")})


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode_samples(docs, default_model())
