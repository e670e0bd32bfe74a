"""Sampled SentencePiece segmentations without replacement, and decoding.

The segmentations of a text are the paths of a lattice whose edges are pieces; a path
has the product of its pieces' weights, over the sum of all paths, as probability.
With one Gumbel variable added to each path's log-probability, the k largest are k
paths drawn without replacement. The search for them never lists paths: the largest
value below a node is a Gumbel variable too, of the node's exact mass (the sum over
its completions, from a backward pass), held below its parent's. So the best path is
an ancestral sample; what it passes by at each step is one lazy node with a value of
its own; and the next path is found by opening the node of largest value, best first.

No piece crosses the border of two segments, so the backward pass is run once per
distinct segment, and the walks of many texts go through all lattices at once.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep, slices, table
from .tokens import MODEL, SPACE, model_bytes

#: Segments of texts that are sampled together.
TOGETHER = 100_000
#: Parts up to this length share states; their masses stay far from the ends of the range of doubles.
SHARED = 40
NONE = -math.inf


class Segments(dict):
    """segment -> the first states of its lattices, as packed integers, built when asked."""

    def __init__(self, owner: Lattices):
        super().__init__()
        self.owner = owner

    def __missing__(self, segment: str) -> bytes:
        found = self[segment] = array("i", map(self.owner.state, self.owner.cut(segment))).tobytes()
        return found


class Lattices:
    """Lattices under one model; emptied between texts once ``cached`` states are kept.

    Weights are the model's piece scores for unigram models. Byte-pair models order
    pieces only, so a piece of rank r has weight 1 / (r + 10). ``power`` sharpens (> 1)
    or flattens (< 1) the weights. A character that is no piece stands as its bytes.
    Segments are cut where no piece holds both neighbours: every path passes there.
    """

    def __init__(self, model: bytes, power: float, cached: int = 900_000):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(model)
        n = proto.normalizer_spec
        if not proto.trainer_spec.byte_fallback or n.precompiled_charsmap or n.remove_extra_whitespaces or not n.add_dummy_prefix or not n.escape_whitespaces:
            raise ValueError("segmentation needs a model with byte fallback and without normalization")
        bpe = proto.trainer_spec.model_type == 2
        normal = sorted((i for i, p in enumerate(proto.pieces) if p.type == 1), key=lambda i: -proto.pieces[i].score)
        self.weight = {proto.pieces[i].piece: (i, math.exp(power * (-math.log(rank + 10) if bpe else proto.pieces[i].score))) for rank, i in enumerate(normal)}
        #: Pieces, and None for what only begins one.
        self.known: dict[str, tuple[int, float] | None] = {p[:i]: None for p in self.weight for i in range(1, len(p))} | self.weight
        self.pairs = {p[i : i + 2] for p in self.weight for i in range(len(p) - 1)}
        self.longest = max(map(len, self.weight), default=1)
        self.factor = np.zeros(len(proto.pieces))
        for i, w in self.weight.values():
            self.factor[i] = w
        #: By length, hashes of what is or begins a piece, in order, and the pieces (-1: none).
        self.prefixes = []
        for size in range(1, self.longest + 1):
            texts = [p for p in self.known if len(p) == size]
            code = hashes(np.array(texts, dtype=f"<U{size}").view(np.uint32).reshape(-1, size))[:, -1]
            order = np.argsort(code)
            ids = np.array([self.known[t][0] if self.known[t] else -1 for t in texts], dtype=np.int32)
            self.prefixes.append((code[order], ids[order]))
        self.byte = [i for i, p in enumerate(proto.pieces) if p.type == 6]
        self.byte_weight = math.exp(-power * math.log(len(normal) + 10))
        self.raw = [p.piece.encode() for p in proto.pieces]
        for value, i in enumerate(self.byte):
            self.raw[i] = bytes([value])
        self.size = np.array(list(map(len, self.raw)), dtype=np.int64)
        self.blob, self.begins = np.frombuffer(b"".join(self.raw), dtype=np.uint8), np.cumsum(self.size) - self.size
        crossing = any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.weight)
        self.split = None if crossing else re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+" if any("\n" in p for p in self.weight) else f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")
        self.cached = cached
        self.clear()

    def clear(self) -> None:
        self.ids = Segments(self)
        self.suffixes: dict[str, int] = {}  # what is left of a part -> its state
        self.states = self.options = self.finished = 0
        self.new_text: list[str] = []  # new suffixes, their states and the states after one character (-1: end)
        self.new_id, self.new_chain = array("i"), array("i")
        self.new_options: list[tuple[int, float, int, int]] = []  # others: state, weight, piece, next state
        #: Of a state its first option, its chain and the mass of its completions; of an option the probability up to it and its own logarithm, piece, next state and its state's first option.
        self.store = {k: np.zeros(1024, t) for k, t in (("start", np.int32), ("chain", np.int32), ("mass", np.float64), ("upto", np.float64), ("log", np.float64), ("piece", np.int32), ("next", np.int32), ("begin", np.int32))}

    def full(self) -> bool:
        return max(self.states, len(self.ids)) > self.cached

    def cut(self, s: str) -> list[str]:
        pairs = self.pairs
        at = [i for i, pair in enumerate(map(add, s, s[1:]), 1) if pair not in pairs]
        return [s[i:j] for i, j in zip([0, *at], [*at, len(s)], strict=True)] if at else [s]

    def state(self, part: str) -> int:
        """The first state of a part. Parts that end alike share states; long parts keep theirs to themselves."""
        if (known := self.suffixes.get(part)) is not None:
            return known
        if len(part) > SHARED:
            return self.build_alone(part)
        get, add_text, add_id, add_chain, suffixes = self.suffixes.get, self.new_text.append, self.new_id.append, self.new_chain.append, self.suffixes
        first = state = self.states
        while part and (known := get(part)) is None:
            suffixes[part] = state
            add_text(part)
            add_id(state)
            state += 1
            add_chain(state)
            part = part[1:]
        self.new_chain[-1] = known if part else -1
        self.states = state
        return first

    def build_alone(self, s: str) -> int:
        """States of a long part, whose masses are scaled on the way."""
        n, base = len(s), self.states
        mass, last = [0.0] * n + [1.0], base + n - 1  # the state of position i is last - i
        self.states += n
        for i in range(n - 1, -1, -1):
            options = []
            if self.known.get(s[i]) is None:
                options.append(self.as_bytes(s[i], last - i - 1 if i + 1 < n else -1, mass[i + 1]))
            for j in range(i + 1, n + 1):
                if hit := self.known.get(s[i:j], 0):
                    options.append((hit[1] * mass[j], hit[0], last - j if j < n else -1))
                elif hit == 0:
                    break
            mass[i] = sum(o[0] for o in options)
            self.new_options += [(last - i, *o) for o in options]
            if not 1e-100 < mass[i] < 1e100:  # only ratios matter
                scale = mass[i]
                for j in range(i, n + 1):
                    mass[j] /= scale
        return last

    def as_bytes(self, c: str, after: int, mass: float) -> tuple[float, int, int]:
        """Weight, piece and next state of a character that stands as its bytes; makes states for those within."""
        raw = c.encode("utf-8", "surrogatepass")
        for b in raw[:0:-1]:
            self.new_options.append((self.states, 1.0, self.byte[b], after))
            after, self.states = self.states, self.states + 1
        return self.byte_weight ** len(raw) * mass, self.byte[raw[0]], after

    def finish(self) -> dict[str, np.ndarray]:
        """Give the new states their options, in order of falling probability, and return the whole store."""
        if not self.new_id and not self.new_options:
            return self.store
        old = self.finished
        state = np.array(self.new_id, dtype=np.int64)
        self.grow("chain", self.states)
        self.store["chain"][state] = np.array(self.new_chain, dtype=np.int32)
        chain = self.store["chain"]
        found: list[tuple[np.ndarray, ...]] = []
        bare = np.zeros(0, np.int64)
        if len(state):
            code = hashes(np.array(self.new_text, dtype=f"<U{self.longest}").view(np.uint32).reshape(len(state), self.longest))
            rows, to = np.arange(len(state)), chain[state]
            for size, (table, ids) in enumerate(self.prefixes, 1):
                at = np.minimum(np.searchsorted(table, code[rows, size - 1]), len(table) - 1)
                known = table[at] == code[rows, size - 1]
                piece = ids[at]
                hit = known & (piece >= 0)
                found.append((rows[hit], piece[hit], to[hit]))
                if size == 1:
                    bare = rows[~hit]
                on = known & (to >= 0)
                rows, to = rows[on], chain[to[on]]
                if not len(rows):
                    break
        row, piece, to = (np.concatenate(x).astype(np.int64) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
        factor, after = self.factor[piece], to.copy()
        extra = [(r, *self.as_bytes(self.new_text[r][0], int(chain[state[r]]), 1.0), int(chain[state[r]])) for r in bare.tolist()]
        if extra:
            r, f, b, nx, t = map(np.array, zip(*extra, strict=True))
            row, piece, to, factor, after = (np.concatenate(x) for x in ((row, r), (piece, b), (to, t), (factor, f), (after, nx)))
        # masses, from short suffixes to long ones; the end has mass 1
        self.grow("mass", self.states + 1)
        mass = self.store["mass"]
        mass[-1] = 1.0
        length = np.array(list(map(len, self.new_text)), dtype=np.int64)[row] if len(row) else row
        order = np.lexsort((row, length))
        row, piece, to, factor, after, length = (x[order] for x in (row, piece, to, factor, after, length))
        weight = np.empty(len(row))
        levels = np.flatnonzero(np.r_[True, np.diff(length) > 0]) if len(row) else []
        for a, b in zip(levels, [*levels[1:], len(row)][: len(levels)], strict=True):
            weight[a:b] = factor[a:b] * mass[to[a:b]]
            heads = np.flatnonzero(np.r_[True, np.diff(row[a:b]) > 0])
            mass[state[row[a:b][heads]]] = np.add.reduceat(weight[a:b], heads)
        of = state[row] if len(row) else row
        if self.new_options:
            o, w, p, nx = map(np.array, zip(*self.new_options, strict=True))
            of, weight, piece, after = (np.concatenate(x) for x in ((of, o), (weight, w), (piece, p), (after, nx)))
        of = of - old
        count = np.bincount(of, minlength=self.states - old)
        total = np.bincount(of, weights=weight, minlength=self.states - old)
        p = weight / total[of]
        order = np.argsort(of - p)
        p, start = p[order], np.cumsum(count) - count
        run = np.cumsum(p)
        upto = run - np.repeat(run[start] - p[start], count)
        upto[start + count - 1] = 2.0  # above any draw
        new = {"upto": upto, "log": np.log(np.maximum(p, 1e-300)), "piece": piece[order], "next": after[order], "begin": np.repeat(start, count) + self.options}
        self.grow("start", self.states)
        self.store["start"][old : self.states] = start + self.options
        for name, values in new.items():
            self.grow(name, self.options + len(values))
            self.store[name][self.options : self.options + len(values)] = values
        self.options += len(p)
        self.finished = self.states
        self.new_text.clear()
        self.new_options.clear()
        del self.new_id[:], self.new_chain[:]
        return self.store

    def grow(self, name: str, size: int) -> None:
        if size > len(self.store[name]):
            self.store[name] = np.resize(self.store[name], size * 3 // 2)

    def segments(self, text: str) -> list[str]:
        if not text:
            return []
        shown = SPACE + text.replace(" ", SPACE)
        return [shown] if self.split is None else self.split.findall(shown)

    def encode(self, text: str) -> np.ndarray:
        """The first states of the lattices that a text passes through."""
        return np.frombuffer(b"".join(map(self.ids.__getitem__, self.segments(text))), dtype=np.int32)

    def decode(self, pieces: np.ndarray) -> str:
        """The text of a sequence of piece ids: the pieces' bytes, gathered at once."""
        size = self.size[pieces]
        at = np.arange(int(size.sum())) + np.repeat(self.begins[pieces] - (np.cumsum(size) - size), size)
        return self.blob[at].tobytes().decode("utf-8", "replace").replace(SPACE, " ").removeprefix(" ")


def hashes(codes: np.ndarray) -> np.ndarray:
    """Of every row of characters the 64-bit hashes of its prefixes."""
    out = np.empty(codes.shape, dtype=np.uint64)
    h = np.zeros(len(codes), dtype=np.uint64)
    for i in range(codes.shape[1]):
        h = (h + codes[:, i] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        out[:, i] = h
    return out


def uniform(h: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from 64-bit keys: the finalizer of SplitMix64."""
    z = h ^ (h >> np.uint64(30))
    z *= np.uint64(0xBF58476D1CE4E5B9)
    z ^= z >> np.uint64(27)
    z *= np.uint64(0x94D049BB133111EB)
    z ^= z >> np.uint64(31)
    return ((z >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def keys(seed: np.ndarray | int, sample: int, place: np.ndarray | int) -> np.ndarray:
    """64-bit keys of draws: of a text's seed, a sample's number and a place in the text."""
    salt = np.uint64((sample + 1) * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF)
    return (np.array(seed, dtype=np.uint64, ndmin=1) ^ salt) + np.array(place, dtype=np.uint64, ndmin=1) * np.uint64(0x9E3779B97F4A7C15)


class Sampler:
    """Draws for one batch of texts, while the lattices stay as they are."""

    def __init__(self, lattices: Lattices):
        store = lattices.finish()
        self.start, self.upto, self.log = store["start"], store["upto"], store["log"]
        self.next, self.piece, self.begin = store["next"], store["piece"], store["begin"]

    def walk(self, states: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From each state to its lattice's end: all options taken, in order, and their number per state."""
        at, cur, steps = np.arange(len(states)), states, []
        n = np.zeros(len(states), dtype=np.int64)
        while len(at):
            u = uniform(h[at] + np.uint64(len(steps) * 0x2545F4914F6CDD1D & 0xFFFFFFFFFFFFFFFF))
            o = self.start[cur]
            over = np.flatnonzero(u > self.upto[o])
            while len(over):
                o[over] += 1
                over = over[u[over] > self.upto[o[over]]]
            steps.append((at, o))
            n[at] += 1
            cur = self.next[o]
            on = cur >= 0
            at, cur = at[on], cur[on]
        out, offset = np.empty(int(n.sum()), dtype=np.int32), np.cumsum(n) - n
        for k, (i, o) in enumerate(steps):
            out[offset[i] + k] = o
        return out, n

    def passed_by(self, logs: np.ndarray, before: np.ndarray, bound: np.ndarray | float, h: np.ndarray) -> np.ndarray:
        """Values of the nodes that steps pass by: of the mass left beside each step, held below ``bound``."""
        with np.errstate(divide="ignore", over="ignore"):
            phi = before + np.log1p(-np.minimum(1.0, np.exp(logs)))
            return np.where(np.isneginf(phi), NONE, phi - np.log(np.exp(phi - bound) - np.log(uniform(h))))


class Path:
    """One sampled path: options, the word of each, values passed by, and where it left its parent."""

    def __init__(self, options, words, value, passed, branch=-1, barred=()):
        self.options, self.words, self.value, self.passed, self.branch, self.barred = options, words, value, passed, branch, barred


def sample_batch(lattices: Lattices, words: list[np.ndarray], seeds: list[int], k: int) -> list[tuple[list[Path], float]]:
    """The k paths of largest value for each text, and the largest value left over."""
    s = Sampler(lattices)
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    first = np.concatenate(words) if len(words) else np.zeros(0, np.int32)
    ends = np.cumsum(sizes)
    place = np.arange(len(first)) - np.repeat(ends - sizes, sizes)
    seed = np.array(seeds, dtype=np.uint64)
    options, n = s.walk(first, keys(np.repeat(seed, sizes), 0, place + 1))
    total = np.r_[0, np.cumsum(n)]
    cuts = total[np.r_[0, ends]]  # of the texts among the options
    logs = s.log[options]
    before = np.zeros(len(logs))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if b - a > 1:  # each text by itself, so that its neighbours don't matter
            np.cumsum(logs[a : b - 1], out=before[a + 1 : b])
    of_text = np.repeat(np.arange(len(words)), np.diff(cuts))
    value = -np.log(-np.log(uniform(keys(seed, 0, 0))))
    step = np.arange(len(options)) - cuts[of_text]
    passed = s.passed_by(logs, before, value[of_text], keys(seed[of_text], 1000, step + 1))
    word_of = np.repeat(place, n)
    paths = [[Path(options[a:b], word_of[a:b], float(v), passed[a:b].copy())] for a, b, v in zip(cuts[:-1], cuts[1:], value, strict=True)]

    for j in range(1, k):
        todo, states, hashes, lengths = [], [], [], []
        for t, own in enumerate(paths):
            best = max(own, key=lambda p: p.passed.max(initial=NONE))
            if len(own) < j or best.passed.max(initial=NONE) == NONE:
                continue
            at = int(best.passed.argmax())
            bound, best.passed[at] = float(best.passed[at]), NONE
            barred = (*(best.barred if at == best.branch else ()), int(best.options[at]))
            o, choices = int(s.begin[best.options[at]]), []
            while True:
                if o not in barred:
                    choices.append(o)
                if s.upto[o] >= 2:
                    break
                o += 1
            odds = np.exp(s.log[choices])
            taken = choices[min(len(choices) - 1, int(np.searchsorted(np.cumsum(odds), float(uniform(keys(seeds[t], 2000 + j, at + 1))[0]) * odds.sum())))]
            word, after = int(best.words[at]), int(s.next[taken])
            start = ends[t] - sizes[t]
            rest = first[start + word + 1 : ends[t]]
            states.append(np.concatenate(([after], rest)) if after >= 0 else rest)
            hashes.append(keys(seeds[t], j, place[start + word + (after < 0) : ends[t]] + 1))
            lengths.append(len(states[-1]))
            todo.append((t, best, at, bound, barred, taken, word, after))
        if not todo:
            break
        more, m = s.walk(np.concatenate(states).astype(np.int32), np.concatenate(hashes))
        upto, w = np.r_[0, np.cumsum(m)], 0
        for (t, best, at, bound, barred, taken, word, after), size in zip(todo, lengths, strict=True):
            new = more[upto[w] : upto[w + size]]
            line = np.concatenate((best.options[:at], [np.int32(taken)], new))
            of_word = np.concatenate((best.words[: at + 1], np.repeat(np.arange(size) + word + (after < 0), m[w : w + size])))
            w += size
            log = s.log[line]
            run = np.concatenate(([0.0], np.cumsum(log)))
            values = np.full(len(line), NONE)
            values[at + 1 :] = s.passed_by(log[at + 1 :], run[at + 1 : -1], bound, keys(seeds[t], 1000 + j, np.arange(at + 1, len(line)) + 1))
            gone = (*barred, taken)
            if len(gone) < option_count(s, taken):
                left = math.log(max(1e-300, 1 - float(np.exp(s.log[list(gone)]).sum())))
                phi = float(run[at]) + left
                values[at] = phi - math.log(math.exp(min(700.0, phi - bound)) - math.log(float(uniform(keys(seeds[t], 1000 + j, at + 1))[0])))
            paths[t].append(Path(line, of_word, bound, values, at, gone[:-1]))
    return [(own, max(float(p.passed.max(initial=NONE)) for p in own)) for own in paths]


def option_count(s: Sampler, option: int) -> int:
    o = int(s.begin[option])
    n = 1
    while s.upto[o] < 2:
        o, n = o + 1, n + 1
    return n


def lattices_of(model: bytes, power: float, cached: int) -> Lattices:
    return keep(("lattices", model, power, cached), lambda: Lattices(model, power, cached))


def log_inclusion(log_prob: float, threshold: float) -> float:
    """Logarithm of the chance that a path's value exceeds the threshold."""
    if threshold == NONE:
        return 0.0
    x = log_prob - threshold
    return x if x < -30 else math.log(-math.expm1(-math.exp(min(x, 700.0))))


SAMPLES = "doc_id bigint, sample int, n_pieces bigint, log_prob double, perturbed double, log_inclusion double, pieces_hash string, decoded boolean"


def segmentations(docs: DataFrame, *, model: str = MODEL, k: int = 2, power: float = 1.0, seed: int = 0, pieces: bool = False, cached: int = 900_000) -> DataFrame:
    """``k`` distinct sampled segmentations of every whole text of ``docs`` (doc_id, text), fewer where there are fewer.

    Returns per sample: its number (from 1, in falling order of the perturbed value),
    pieces, log-probability, perturbed value, the logarithm of its inclusion score
    (the chance that its value exceeds the largest one left over), a hash of its piece
    ids, whether decoding them gives the text back, and the ids if ``pieces``. Draws
    depend on doc_id, ``seed`` and the text only: rows that repeat id and text get the
    same samples. Null and empty texts have one segmentation, without pieces. A
    character U+2581 decodes to a space, as in the library. Other columns are ignored.
    A worker keeps ``cached`` lattice states (some 0.5 KB each), which affects speed only.
    """
    data = model_bytes(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lattices_of(data, power, cached)
        for b in slices(batches):
            ids, texts = b.column("doc_id").to_pylist(), b.column("text")
            held: list[tuple[int | None, str, np.ndarray]] = []
            size = 0
            for doc, value in zip(ids, texts, strict=True):
                text = value.as_py() or ""
                held.append((doc, text, own.encode(text)))
                size += len(held[-1][2])
                if size >= TOGETHER:
                    yield sampled(own, held)
                    held, size = [], 0
                    if own.full():
                        own.clear()
            if held:
                yield sampled(own, held)
            if own.full():
                own.clear()

    def sampled(own: Lattices, held: list[tuple[int | None, str, np.ndarray]]) -> pa.RecordBatch:
        seeds = [xxhash.xxh3_64_intdigest(f"{seed}:{doc}") for doc, _, _ in held]
        out: list[tuple] = []
        drawn = sample_batch(own, [w for _, _, w in held], seeds, k)
        piece_of, log_of = own.store["piece"], own.store["log"]
        for (doc, text, _), (paths, left) in zip(held, drawn, strict=True):
            for i, p in enumerate(paths):
                got, log = piece_of[p.options], float(log_of[p.options].sum())
                out.append((doc, i + 1, len(got), log, p.value, log_inclusion(log, left), xxhash.xxh3_64_hexdigest(got.tobytes()), own.decode(got) == text.replace(SPACE, " "), *([got.tolist()] if pieces else [])))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), KINDS + ([pa.list_(pa.int32())] if pieces else []), strict=True)], [x.split()[0] for x in SAMPLES.split(", ")] + (["pieces"] if pieces else []))

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, SAMPLES + (", pieces array<int>" if pieces else ""))


KINDS = [pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.string(), pa.bool_()]


def op5_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of every row of ``documents``: doc_id, rank, number and hash of the pieces, probabilities, inclusion, and whether they decode to the text.

    Null and empty texts have the empty segmentation; texts of any length are sampled whole;
    rows that repeat an id draw alike from their texts; an empty table gives no rows; other
    columns are not read.
    """
    return segmentations(table(spark, sf_dir, "documents"))
