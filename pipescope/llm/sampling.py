"""Sampled segmentations with a SentencePiece model: Gumbel top-k without replacement, and decoding.

A text's lattice has all pieces that match at each character, the space put in front included. It falls apart
into words, each a run of spaces with what follows up to the next space: a piece holds space marks only at its
front, or is a run of them (a model with other pieces is refused). The model orders its pieces by score and gives
no probabilities, so a piece weighs as Zipf's law has it, 1 / (rank + 3), to the power `power`, with its place in
falling order of score as rank. Sums of weights to the end of the word (backward pass) give each edge its exact
probability given the node, and a segmentation the product of them.

The k segmentations of a text are the k largest of all segmentations' Gumbel-perturbed log probabilities,
which is sampling without replacement. They are found by perturbed A-star search: the agenda holds regions of
the segmentation space (a fixed prefix, a node, edges excluded there) under the perturbed maximum of the region,
which is known before the region is looked into: a Gumbel variable located at the region's log mass and
truncated at its parent's maximum. The region on top gives the next segmentation, the prefix plus a free draw,
and is split into the regions that differ from it first at each of its nodes. The (k+1)-th maximum is the
threshold kappa of the inclusion score: 1 - exp(-exp(log_prob - kappa)).

All random numbers are hashes of the row key, the seed, the sample, the word and the step, so results do not
depend on batches, partitions or retries.

Defined cases: a null or empty text has one segmentation, the empty one; texts with fewer than k segmentations
give all of them, with inclusion 1; characters without a piece are their UTF-8 bytes; rows with one key and text
get the same samples, which are drawn once where such rows follow each other, as the epochs of a mix do; the space mark itself (U+2581) decodes to a space, as in the library; an empty table gives
no rows; only the named columns are read.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pipescope.llm.common import giving_back, in_small_batches, worker_cache
from pipescope.llm.pieces import text_parts

MARK = "▁"
MARKED_WORD = re.compile(f"{MARK}+[^{MARK}]*")
RANK_OFFSET = 3.0
PART_BYTES = 1_000_000  # of texts that are searched side by side
LATTICE_BYTES = 2_000_000  # of texts whose words share a lattice
SHARED_END = 32  # characters of word ends looked at for what words have in common
SCHEMA = ("key long, sample int, n_pieces int, log_prob double, perturbed double, inclusion double, ids array<int>, "
          "decoded boolean")
_MUL, _ADD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)
_SPREAD = np.uint64(0xBF58476D1CE4E5B9)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of `x`."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _seeds(seed, numbers) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mix(np.asarray(seed, np.uint64) + np.asarray(numbers).astype(np.uint64) * _MUL)


def _uniform(bits: np.ndarray) -> np.ndarray:
    """Numbers strictly between 0 and 1."""
    return ((bits >> np.uint64(12)).astype(np.float64) + 0.5) / 2.0**52


def _one_space(text: str) -> bool:
    """Whether a word begins at each space and nowhere else but in front."""
    return text != "" and text[0] != " " and "  " not in text and MARK not in text


def split_words(text: str) -> list[str]:
    """The words of a text, each without its first space mark; further marks of a run of spaces stay in front."""
    if not text:
        return []
    if _one_space(text):
        return text.split(" ")
    return [word[1:] for word in MARKED_WORD.findall(MARK + text.replace(" ", MARK))]


class _HashTable:
    """Values of 64-bit hashes, -1 for unknown ones. Open addressing, sparse, so that most look-ups are one step."""

    def __init__(self, values: dict[int, int]):
        self.shift = np.uint64(64 - max(4, (8 * len(values)).bit_length()))
        self.hashes = np.zeros((1 << (64 - int(self.shift))) + len(values) + 1, np.uint64)
        self.values = np.full(len(self.hashes), -1, np.int64)
        self.longest = 0
        for h, value in values.items():
            slot, steps = (h * int(_SPREAD) & 0xFFFFFFFFFFFFFFFF) >> int(self.shift), 0
            while self.values[slot] >= 0:
                slot, steps = slot + 1, steps + 1
            self.hashes[slot], self.values[slot] = h, value
            self.longest = max(self.longest, steps)

    def find(self, wanted: np.ndarray) -> np.ndarray:
        slot = ((wanted * _SPREAD) >> self.shift).astype(np.int64)
        out = np.where(self.hashes[slot] == wanted, self.values[slot], -1)
        rest = np.flatnonzero(out < 0)
        for _ in range(self.longest):
            rest = rest[self.values[slot[rest]] >= 0]  # an empty slot ends the search
            if not len(rest):
                break
            slot[rest] += 1
            hit = self.hashes[slot[rest]] == wanted[rest]
            out[rest[hit]] = self.values[slot[rest[hit]]]
            rest = rest[~hit]
        return out


class PieceModel:
    """The pieces of a SentencePiece model with their log weights, for look-up and for decoding."""

    def __init__(self, model: bytes, power: float):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_proto=model)
        pieces = [sp.id_to_piece(i) for i in range(len(sp))]
        usual = [i for i, p in enumerate(pieces) if p and not (
            sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        across = [pieces[i] for i in usual if MARK in pieces[i].lstrip(MARK)]
        if across:
            raise ValueError(f"pieces that go on beyond a word: {across[:5]}")
        usual.sort(key=lambda i: (-sp.get_score(i), i))
        weight = {i: -power * math.log(rank + RANK_OFFSET) for rank, i in enumerate(usual)}
        self.byte_id = {int(pieces[i][1:-1], 16): i for i in range(len(sp)) if sp.is_byte(i)}
        byte_weight = -power * math.log(len(usual) + RANK_OFFSET)
        norm = math.log(sum(map(math.exp, weight.values())) + len(self.byte_id) * math.exp(byte_weight))
        self.byte_weight = byte_weight - norm
        self.weights = np.full(len(sp), -np.inf)
        for i, w in weight.items():
            self.weights[i] = w - norm
        self.unknown = sp.unk_id()
        self.longest = max((len(pieces[i]) for i in usual), default=1)
        # of every piece and every front part of one: twice the id (or of no piece), plus one if a piece goes on
        self.no_piece = len(sp)
        entries: dict[int, int] = {}
        for i in usual:
            h = 0
            for size, char in enumerate(pieces[i], 1):
                h = (h * int(_MUL) + ord(char) + int(_ADD)) & 0xFFFFFFFFFFFFFFFF
                known = entries.get(h, 2 * self.no_piece)
                entries[h] = 2 * i + known % 2 if size == len(pieces[i]) else known | 1
        self.table = _HashTable(entries)
        raw = [bytes([int(p[1:-1], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) else p.replace(MARK, " ").encode()
               for i, p in enumerate(pieces)]
        self.raw_sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        self.raw_starts = np.cumsum(self.raw_sizes) - self.raw_sizes
        self.raw = np.frombuffer(b"".join(raw), np.uint8)

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bytes of many id sequences in a row, each still with the space before it, and where each ends."""
        lengths = self.raw_sizes[ids]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        data = self.raw[np.repeat(self.raw_starts[ids] - (ends - lengths), lengths) + np.arange(total)]
        return data.tobytes(), np.concatenate([[0], ends])[np.cumsum(sizes)]


class Lattice:
    """The lattices of many distinct words; a node is what is left of a word, and words that end alike share it.

    Edges are sorted by node, longest first. `upper` are the ends of the edges' shares of 2^32, in order within the
    node, so a 32-bit random number draws the first edge whose end is above it.
    """

    def __init__(self, model: PieceModel, words: pa.Array):
        order = pc.array_sort_indices(pc.utf8_reverse(words))  # words that end alike beside each other
        words = words.take(order)
        sizes = pc.utf8_length(words).to_numpy().astype(np.int64) + 1
        last = np.cumsum(sizes)
        chars = np.full(int(sizes.sum()), ord(MARK), np.uint32)
        rest = np.ones(len(chars), bool)
        rest[last - sizes] = False
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), "")[0].as_py()
        chars[rest] = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        places, node_of = self._nodes(chars, last, sizes)
        self.first = np.empty(len(words), np.int64)
        self.first[order.to_numpy()] = node_of[last - sizes]
        n = self.end = len(places)
        left = np.repeat(last, sizes)[places] - places  # characters to the end of the word
        found: list[tuple[int, np.ndarray, np.ndarray]] = []
        at, h, place, room = np.arange(n), np.zeros(n, np.uint64), places, left
        lone = np.ones(n, bool)
        for size in range(1, model.longest + 1):
            if size > 1:
                goes_on = np.flatnonzero(goes_on & (room >= size))
                at, h, place, room = at[goes_on], h[goes_on], place[goes_on], room[goes_on]
            h = h * _MUL + chars[place + (size - 1)] + _ADD
            entry = model.table.find(h)
            hit = np.flatnonzero((entry >= 0) & (entry < 2 * model.no_piece))
            found.append((size, at[hit], entry[hit] >> 1))
            if size == 1:
                lone[at[hit]] = False
            goes_on = (entry >= 0) & (entry & 1 == 1)
        unknown = np.flatnonzero(lone)
        byte_ids = [[model.byte_id.get(b, model.unknown) for b in chr(c).encode("utf-8", "surrogatepass")]
                    for c in chars[places[unknown]].tolist()]
        found.insert(0, (1, unknown, -1 - np.arange(len(unknown))))
        count = np.zeros(n, np.int64)
        for _, nodes, _ in found:
            count[nodes] += 1
        self.edge_first = np.concatenate([[0], np.cumsum(count)])
        free = self.edge_first[:-1].copy()
        start = np.repeat(np.arange(n), count)
        target, ids = (np.empty(len(start), np.int64) for _ in range(2))
        node_of = np.append(node_of, n)
        for length, nodes, of in reversed(found):
            place = free[nodes]
            beyond = places[nodes] + length
            target[place] = np.where(left[nodes] == length, n, node_of[beyond])
            ids[place] = of
            free[nodes] += 1
        self.start, self.target = start, target
        weight = model.weights[np.maximum(ids, 0)]
        # the ids an edge stands for: one, or the bytes of its character
        self.out_sizes, self.out_starts, self.out = np.ones(len(ids), np.int64), np.arange(len(ids)), ids
        self.plain = not len(unknown)
        if len(unknown):
            special = np.flatnonzero(ids < 0)
            n_bytes = np.fromiter(map(len, byte_ids), np.int64, len(byte_ids))[-1 - ids[special]]
            weight[special] = model.byte_weight * n_bytes
            self.out_sizes[special] = n_bytes
            self.out_starts = np.cumsum(self.out_sizes) - self.out_sizes
            self.out = np.repeat(ids, self.out_sizes)
            self.out[self.out < 0] = np.concatenate([byte_ids[b] for b in (-1 - ids[special]).tolist()])
        beta = self._backward(weight, left)
        self.log_prob = weight + beta[self.target] - beta[start]
        probability = np.exp(self.log_prob)
        above = probability.copy()
        edges = np.flatnonzero(np.diff(start, prepend=-1) == 0)
        place = edges - self.edge_first[start[edges]]
        i = 1
        while len(edges):  # in order within each node, whatever the batch
            now = place == i
            above[edges[now]] += above[edges[now] - 1]
            edges, place, i = edges[~now], place[~now], i + 1
        self.upper = np.minimum(above * 2.0**32, 2.0**32).astype(np.uint64)
        self.upper[self.edge_first[1:] - 1] = np.uint64(1 << 32)
        with np.errstate(divide="ignore"):
            rest = np.log1p(-np.minimum(probability, 1 - 1e-16))
        self.log_rest = np.where(count[start] == 1, -np.inf, rest)

    @staticmethod
    def _nodes(chars: np.ndarray, last: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each node among the characters, the first of those that share it, and the node of each place.

        `last` and `sizes` are the ends and sizes of words in the order of their reversed texts, with the mark in front, which
        is never shared.
        """
        stands_for = np.arange(len(chars))
        word, alike = np.arange(len(last)), np.zeros(len(last), bool)
        alike[1:] = True  # with the word before, as far as was looked
        for d in range(1, SHARED_END + 1):
            long = sizes[word] > d
            word, alike = word[long], alike[long]
            if not alike.any():
                break
            place = last[word] - d
            # a word that is like the one before has that one before it here too, unless it was too short
            alike[1:] &= (np.diff(word) == 1) & (chars[place[1:]] == chars[place[:-1]])
            alike[:1] = False
            stands_for[place] = place[np.maximum.accumulate(np.where(alike, 0, np.arange(len(word))))]
        own = stands_for == np.arange(len(chars))
        return np.flatnonzero(own), (np.cumsum(own) - 1)[stands_for]

    def _backward(self, weight: np.ndarray, left: np.ndarray) -> np.ndarray:
        """Log of the total weight from each node to the end of its word, from the ends backwards; `left` are the characters
        to there."""
        beta = np.zeros(self.end + 1)
        distance = left[self.start]
        if not len(distance):
            return beta
        small = int(distance.max()) < 1 << 16  # numbers of 16 bits are sorted in linear time
        order = np.argsort(distance.astype(np.uint16) if small else distance, kind="stable")
        cuts = np.concatenate([[0], np.cumsum(np.bincount(distance))])
        for d in range(1, len(cuts) - 1):
            e = order[cuts[d]:cuts[d + 1]]
            if len(e):
                nodes = self.start[e]
                heads = np.flatnonzero(np.diff(nodes, prepend=-1))
                beta[nodes[heads]] = np.logaddexp.reduceat(weight[e] + beta[self.target[e]], heads)
        return beta

    def walk(self, nodes: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Draw the rest of a word from each node: all edges in a row, and how many each walk has."""
        at, active, steps = nodes, np.arange(len(nodes)), []
        while len(active):
            bits = _seeds(seeds, len(steps) + 1) >> np.uint64(32)
            edges = self.edge_first[at]
            beyond = np.flatnonzero(bits >= self.upper[edges])
            while len(beyond):
                edges[beyond] += 1
                beyond = beyond[bits[beyond] >= self.upper[edges[beyond]]]
            steps.append((active, edges))
            at = self.target[edges]
            goes_on = np.flatnonzero(at != self.end)
            active, at, seeds = active[goes_on], at[goes_on], seeds[goes_on]
        counts = np.zeros(len(nodes), np.int64)
        for i, (walks, _) in enumerate(steps):
            counts[walks] = i + 1
        offsets = np.cumsum(counts) - counts
        out = np.zeros(int(counts.sum()), np.int64)
        for i, (walks, edges) in enumerate(steps):
            out[offsets[walks] + i] = edges
        return out, counts

    def ids(self, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of edges in a row, and how many each edge has."""
        sizes = self.out_sizes[edges]
        if self.plain:
            return self.out[edges], sizes
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.out[np.repeat(self.out_starts[edges] - (ends - sizes), sizes) + np.arange(total)], sizes


class _Search:
    """The agenda of one text."""

    def __init__(self, words: np.ndarray, seed: np.uint64):
        self.words, self.seed = words, seed
        self.agenda: list[tuple[float, int, int, int, tuple[int, ...]]] = []  # (-maximum, tie, sample, place, excluded)
        # edges, first edge of each word, log probability up to and with each edge, maximum
        self.samples: list[tuple[np.ndarray, np.ndarray, np.ndarray, float]] = []

    def add(self, lattice: Lattice, edges: np.ndarray, word_first: np.ndarray, maximum: float, most: int, drawn: tuple,
            parent: int = 0, split_at: int = 0, excluded: tuple[int, ...] = ()) -> None:
        """Take in a sample and the regions that differ from it first at its nodes from `split_at` on, where it leaves
        its parent.

        `drawn` has the log probabilities, the log rest masses and the Gumbel noise of the edges from there on.
        """
        log_prob, log_rest, noise = drawn
        number = len(self.samples)
        known = self.samples[parent][2][:split_at] if split_at else log_prob[:0]
        before = float(known[-1]) if split_at else 0.0
        upto = before + np.cumsum(log_prob)
        self.samples.append((edges, word_first, np.concatenate([known, upto]), maximum))
        if not len(log_prob):
            return
        mass = upto - log_prob + log_rest
        if excluded:
            taken = np.exp(lattice.log_prob[list(excluded) + [int(edges[split_at])]]).sum()
            node = lattice.start[edges[split_at]]
            left = lattice.edge_first[node + 1] - lattice.edge_first[node] - len(excluded) - 1
            mass[0] = before + math.log(max(1 - taken, 1e-300)) if left else -math.inf
        gumbel = mass + noise
        top = np.argpartition(gumbel, len(gumbel) - most)[-most:] if len(gumbel) > most else np.arange(len(gumbel))
        # truncation at the maximum keeps the order, so only the largest need it
        for i in top[gumbel[top] > -np.inf].tolist():
            value = -float(np.logaddexp(-maximum, -gumbel[i]))
            rule = excluded + (int(edges[split_at]),) if i == 0 else (int(edges[split_at + i]),)
            heapq.heappush(self.agenda, (-value, -number, number, split_at + i, rule))


def lattice_of(model: PieceModel, texts: Sequence[str]) -> tuple[Lattice, list[np.ndarray]]:
    """The lattice of all words of the texts, and the numbers of each text's words in it."""
    spaced = pa.array([t if _one_space(t) else " ".join(split_words(t)) if t else None for t in texts], pa.string())
    listed = pc.split_pattern(spaced, " ")
    counts = pc.fill_null(pc.list_value_length(listed), 0).to_numpy()
    flat = listed.flatten().dictionary_encode()
    numbers = flat.indices.to_numpy().astype(np.int64)
    return Lattice(model, flat.dictionary), [numbers[e - c:e] for e, c in zip(np.cumsum(counts).tolist(), counts.tolist())]


def sample_batch(model: PieceModel, texts: Sequence[str], seeds: np.ndarray, k: int) -> tuple[Lattice, list[_Search]]:
    """`search_batch` of texts with a lattice of their own."""
    lattice, listed = lattice_of(model, texts)
    return lattice, search_batch(lattice, listed, seeds, k)


def search_batch(lattice: Lattice, listed: Sequence[np.ndarray], seeds: np.ndarray, k: int) -> list[_Search]:
    """Run the search for all texts of a batch side by side, so that every draw is one vector operation. `listed` are the
    numbers of their words in the lattice."""
    searches = [_Search(words, s) for words, s in zip(listed, seeds)]

    def draws(number: int, of: list[int], first_edges: list[int], skip: list[int]):
        """Sample `number` of some searches from a given edge (-1: none) on: the rest of its word, then the words
        from `skip` on. Gives each search its edges, walk sizes and what `add` needs."""
        own = _seeds(seeds[of], 2 * number)
        heads = [lattice.end if e < 0 else int(lattice.target[e]) for e in first_edges]
        nodes = [lattice.first[searches[i].words[at:]] if head == lattice.end else
                 np.concatenate([[head], lattice.first[searches[i].words[at:]]]) for i, at, head in zip(of, skip, heads)]
        per = np.fromiter(map(len, nodes), np.int64, len(nodes))
        walk_ends = np.cumsum(per)
        # the number of each walk's word in its text
        begin = np.asarray(skip, np.int64) - (np.asarray(heads) != lattice.end)
        word = np.arange(int(per.sum())) - np.repeat(walk_ends - per, per) + np.repeat(begin, per)
        edges, sizes = lattice.walk(np.concatenate(nodes), _seeds(np.repeat(own, per), word))
        ends = np.concatenate([[0], np.cumsum(sizes)])[walk_ends]
        # put the given edges in front
        given = np.asarray(first_edges, np.int64)
        has = (given >= 0).astype(np.int64)
        if has.any():
            edges = np.insert(edges, (ends - np.diff(ends, prepend=0))[given >= 0], given[given >= 0])
            ends = ends + np.cumsum(has)
        n = np.diff(ends, prepend=0)
        place = np.arange(len(edges)) - np.repeat(ends - n, n)
        noise = -np.log(-np.log(_uniform(_seeds(np.repeat(_seeds(seeds[of], 2 * number + 1), n), place))))
        log_prob, log_rest = lattice.log_prob[edges], lattice.log_rest[edges]
        for e, size, w, p in zip(ends.tolist(), n.tolist(), walk_ends.tolist(), per.tolist()):
            part = slice(e - size, e)
            yield edges[part], sizes[w - p:w], (log_prob[part], log_rest[part], noise[part])

    everyone = list(range(len(searches)))
    if not everyone:
        return searches
    roots = -np.log(-np.log(_uniform(_seeds(_seeds(seeds, 2 * k + 1), 0))))
    for i, (edges, sizes, drawn) in zip(everyone, draws(0, everyone, [-1] * len(everyone), [0] * len(everyone))):
        searches[i].add(lattice, edges, np.cumsum(sizes) - sizes, float(roots[i]), k, drawn)
    for number in range(1, k):
        of = [i for i in everyone if searches[i].agenda]
        if not of:
            break
        choice = _uniform(_seeds(_seeds(seeds[of], 2 * k + 2), number)).tolist()
        chosen = []
        for i, u in zip(of, choice):
            s = searches[i]
            top, _, parent, place, excluded = heapq.heappop(s.agenda)
            node = int(lattice.start[s.samples[parent][0][place]])
            others = [e for e in range(int(lattice.edge_first[node]), int(lattice.edge_first[node + 1])) if e not in excluded]
            upto = np.cumsum(np.exp(lattice.log_prob[others]))
            edge = others[min(int(np.searchsorted(upto, u * upto[-1], side="right")), len(others) - 1)]
            word = int(np.searchsorted(s.samples[parent][1], place, side="right")) - 1
            chosen.append((-top, parent, place, excluded, edge, word))
        drawn_rows = draws(number, of, [c[4] for c in chosen], [c[5] + 1 for c in chosen])
        for i, (maximum, parent, place, excluded, edge, word), (edges, sizes, drawn) in zip(of, chosen, drawn_rows):
            s = searches[i]
            old_edges, old_first, _, _ = s.samples[parent]
            rest = place + 1 + np.cumsum(sizes) - sizes
            if lattice.target[edge] != lattice.end:  # the first walk finishes the word of the given edge
                rest = rest[1:]
            s.add(lattice, np.concatenate([old_edges[:place], edges]), np.concatenate([old_first[:word + 1], rest]), maximum, k, drawn,
                  parent, place, excluded)
    return searches


def worker_model(model: bytes, power: float) -> PieceModel:
    cache = worker_cache("piece_models")
    key = (hash(model), power)
    if key not in cache:
        cache.clear()
        cache[key] = PieceModel(model, power)
    return cache[key]


def _without_copies(batch: pa.RecordBatch) -> tuple[pa.RecordBatch, np.ndarray]:
    """(key, seed, text) without rows that have the key and text of the row before, and how often each row was there."""
    n = batch.num_rows
    copy = np.zeros(n, bool)
    if n > 1:
        key, text = (pc.fill_null(pc.equal(c.slice(1), c.slice(0, n - 1)), False) for c in (batch.column(0), batch.column(2)))
        copy[1:] = pc.and_(key, text).to_numpy(zero_copy_only=False)
    first = np.flatnonzero(~copy)
    return batch if len(first) == n else batch.take(pa.array(first)), np.diff(first, append=n)


def sample_segmentations(docs: DataFrame, model_path: str, *, k: int = 2, power: float = 1.0, seed: int = 7,
                         key: str = "doc_id", text: str = "text", with_ids: bool = True) -> DataFrame:
    """SCHEMA columns: up to k rows per row of `docs`, in falling order of the perturbed log probability.

    `decoded` tells whether the ids decode to the text again. `with_ids=False` gives null ids, for callers that
    need the scores alone.
    """
    with open(model_path, "rb") as stream:
        shared = docs.sparkSession.sparkContext.broadcast(stream.read())
    schema = pa.schema([("key", pa.int64()), ("sample", pa.int32()), ("n_pieces", pa.int32()), ("log_prob", pa.float64()),
                        ("perturbed", pa.float64()), ("inclusion", pa.float64()), ("ids", pa.list_(pa.int32())),
                        ("decoded", pa.bool_())])

    def sample(batches):
        model = worker_model(shared.value, power)
        for batch in batches:
            batch, times = _without_copies(batch)
            keys = batch.column(0).to_pylist()
            seeds = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for group, all_texts in text_parts(batch.column(2), LATTICE_BYTES):
                lattice, listed = lattice_of(model, all_texts)
                group_keys, group_seeds, group_times = keys[group], seeds[group], times[group]
                for part, texts in text_parts(batch.column(2).slice(group.start, len(all_texts)), PART_BYTES):
                    searches = search_batch(lattice, listed[part], group_seeds[part], k)
                    rows: dict[str, list] = {name: [] for name in schema.names}
                    paths = []
                    for own_key, s in zip(group_keys[part], searches):
                        kappa = -s.agenda[0][0] if s.agenda else -math.inf
                        for number, (edges, _, upto, maximum) in enumerate(s.samples):
                            log_prob = float(upto[-1]) if len(upto) else 0.0
                            paths.append(edges)
                            rows["key"].append(own_key)
                            rows["sample"].append(number)
                            rows["log_prob"].append(log_prob)
                            rows["perturbed"].append(maximum)
                            rows["inclusion"].append(-math.expm1(-math.exp(min(log_prob - kappa, 700.0))))
                    counts = np.fromiter(map(len, paths), np.int64, len(paths))
                    ids, sizes = lattice.ids(np.concatenate(paths))
                    id_ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum(counts)]
                    n_ids = np.diff(id_ends, prepend=0)
                    data, ends = model.decode(ids, n_ids)
                    begin = at = 0
                    for t, s in zip(texts, searches):
                        want = t.encode("utf-8", "surrogatepass")
                        for _ in s.samples:
                            end = int(ends[at])
                            rows["decoded"].append(data[begin + 1:end] == want)  # without the space put in front
                            begin, at = end, at + 1
                    offsets = pa.array(np.concatenate([[0], id_ends]), pa.int32())
                    lists = pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32))) if with_ids else pa.nulls(
                        len(paths), pa.list_(pa.int32()))
                    rows["n_pieces"], rows["ids"] = n_ids, lists
                    out = pa.RecordBatch.from_arrays(
                        [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(rows.values(), schema)], schema=schema)
                    n_times = np.repeat(group_times[part], [len(s.samples) for s in searches])
                    yield out
                    for more in range(1, int(n_times.max())):
                        yield out.filter(pa.array(n_times > more))
                    del searches, s, paths, rows, ids, sizes, data, ends, lists, offsets, out  # before the next part needs room

    chosen = docs.select(F.col(key).cast("long").alias("key"), F.xxhash64(F.col(key).cast("long"), F.lit(seed)).alias("seed"),
                         F.col(text).alias("text"))
    return in_small_batches(chosen).mapInArrow(lambda batches: giving_back(sample(batches)), SCHEMA)


def decode_ids(ids: Column, model_path: str, spark) -> Column:
    """The text of an array of ids."""
    with open(model_path, "rb") as stream:
        shared = spark.sparkContext.broadcast(stream.read())

    @F.arrow_udf("string")
    def decoded(lists: pa.Array) -> pa.Array:
        model = worker_model(shared.value, 1.0)
        sizes = np.fromiter((0 if x is None else x for x in lists.value_lengths().to_pylist()), np.int64, len(lists))
        data, ends = model.decode(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), sizes)
        starts = np.concatenate([[0], ends])[:-1] if len(ends) else []
        texts = [data[b + 1:e].decode("utf-8", "replace") for b, e in zip(starts, ends)]
        return pa.array([t if valid else None for valid, t in zip(lists.is_valid().to_pylist(), texts)], pa.string())

    return decoded(ids)
