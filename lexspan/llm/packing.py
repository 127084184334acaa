"""Best-fit packing by a grouping genetic algorithm on islands."""

from __future__ import annotations

import random
import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_text, materialize, worker_cache

CAPACITY = 4096


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 bytes stand for themselves, the others follow from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Encoder:
    """Token ids of whole texts by a public tokenizer, as little-endian unsigned 32-bit integers.

    The tokenizer lower-cases, drops white space and splits on it, so a text is the sequence of its words' ids, and a word the
    sequence of the ids of its parts (a run of letters, a digit, a run of other characters). The model tokenizes each part once;
    words that normalisation could change, and words that may hold a special token, go through the whole tokenizer as they are
    written (special tokens are found before letters are lower-cased). Both caches are bounded and live as long as the worker.
    """

    PART = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
    #: Letters that stay composed and whose lower case doesn't depend on their neighbours.
    LATIN = r"[\x00-\u012f\u0131-\u024f]*"

    def __init__(self, path: str, most: int = 300_000, chunk: int = 1 << 20):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer, self.most, self.chunk = Tokenizer.from_file(path), most, chunk
        self.tokenize = self.tokenizer.model.tokenize
        self.split, self.latin = regex.compile(self.PART).findall, re.compile(self.LATIN).fullmatch
        self.letters = byte_letters()
        cache = worker_cache(f"encoder {path}")
        self.words, self.parts = cache.setdefault("words", Known()), cache.setdefault("parts", Known())
        self.words.encode, self.parts.encode = self.word, self.part

    def part(self, text: str) -> bytes:
        """Ids of a part of lower-case Latin text, which stays as it is when normalised."""
        shown = text if text.isascii() and text.isprintable() else "".join(map(self.letters.__getitem__, text.encode()))
        return array("I", [t.id for t in self.tokenize(shown)]).tobytes()

    def word(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        if "<|" in text or not self.latin(text):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        text, known = text.lower(), self.parts
        if text.isalpha():
            return known[text]
        last = text[-1]
        if text[:-1].isalpha() and not last.isalnum() and not last.isspace():
            return known[text[:-1]] + known[last]
        return b"".join(map(known.__getitem__, self.split(text)))

    def encode(self, texts: list[bytes]) -> Iterator[bytes]:
        """The ids of every text; beside the caches, memory is bounded by the longest text."""
        met = 0
        for text in texts:
            if met > self.chunk:
                met = 0
                self.parts.age(self.most // 2)
                self.words.age(self.most)
            met += len(text)
            found = text.lower().split() if b"<|" not in text else [w if b"<|" in w else w.lower() for w in text.split()]
            yield b"".join(map(self.words.__getitem__, found))


class Known(dict):
    """Ids by word or part; one that isn't there is encoded. What was met since the last time it grew old stays."""

    def __init__(self):
        self.encode, self.old = None, {}

    def __missing__(self, word):
        if (ids := self.old.get(word)) is None:
            ids = self.encode(word)
        self[word] = ids
        return ids

    def age(self, most: int) -> None:
        if len(self) > most:
            self.old = dict(self)
            self.clear()


def cut(docs: DataFrame, path: str, carry: list[str], capacity: int = CAPACITY, end: int = 1, text: str = "text") -> DataFrame:
    """One row per piece: ``carry`` and (piece, start, length, ids_crc32).

    A document's ids and the id ``end`` are cut every ``capacity`` tokens; the last piece may be shorter. A null text
    is empty and gives the piece that holds ``end`` alone.
    """

    def start():
        encoder, tail, step = Encoder(path), np.array([end], "<u4").tobytes(), 4 * capacity

        def work(texts: list[bytes | None]) -> dict[str, list]:
            out = []
            for ids in encoder.encode([t or b"" for t in texts]):
                ids += tail
                out.append([{"piece": i // step, "start": i // 4, "length": min(step, len(ids) - i) // 4, "ids_crc32": zlib.crc32(ids[i : i + step])} for i in range(0, len(ids), step)])
            return {"p": out}

        return work

    made = map_text(docs, start, "p array<struct<piece:int,start:long,length:long,ids_crc32:long>>", carry, text)
    return made.select(*[c for c in carry if c != "p"], F.explode("p").alias("p")).select(*[c for c in carry if c not in ("p", "piece", "start", "length", "ids_crc32")], "p.*")


def best_fit(sizes: list[int], items: list[int], bins: list[list[int]], free: list[int], capacity: int) -> None:
    """Put items, in their order, into the fullest bin that takes them, else into a new one; changes bins and free."""
    order = sorted((room, b) for b, room in enumerate(free) if room)
    for item in items:
        size = sizes[item]
        at = bisect_left(order, (size, -1))
        if at < len(order):
            room, b = order.pop(at)
            bins[b].append(item)
        else:
            room, b = capacity, len(bins)
            bins.append([item])
            free.append(capacity)
        free[b] = room - size
        if room > size:
            insort(order, (room - size, b))


def fitness(free: list[int], capacity: int) -> float:
    """Falkenauer's measure with power 2: mean squared fill, so few full bins beat many half-full ones."""
    fill = 1 - np.array(free, float) / capacity
    return float((fill * fill).mean()) if len(fill) else 1.0


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """No packing has fewer bins (Martello and Toth's L2): items over half a bin don't share one, and what they leave only takes so much of the rest."""
    sizes = np.sort(np.asarray(sizes, np.int64))
    upto = np.concatenate([[0], np.cumsum(sizes)])
    over = np.searchsorted(sizes, capacity // 2, "right")
    least = np.concatenate([[0], np.unique(sizes[:over])])
    alone = np.searchsorted(sizes, capacity - least, "right")  # from here on items leave no room for a small one
    alone = np.maximum(alone, over)
    small = upto[over] - upto[np.searchsorted(sizes, least, "left")]
    room = (alone - over) * capacity - (upto[alone] - upto[over])
    return int((len(sizes) - over + np.maximum(0, -(-(small - room) // capacity))).max(initial=0))


class Island:
    """A population of packings of the same items; a packing is a list of bins (lists of item numbers) and the room left in each.

    It begins with packings of random orders, each item in the fullest bin that takes it. A child takes whole bins that the father filled
    best and keeps the mother's bins that share no item with them; what that displaces is first exchanged for smaller items of bins that
    it fills better, and the rest is placed by best fit, largest first.
    """

    def __init__(self, sizes: np.ndarray, capacity: int, seed: int, population: int, start: list[list[list[int]]] = ()):
        self.sizes, self.capacity, self.r = [int(x) for x in sizes], capacity, random.Random(seed)
        self.least = lower_bound(sizes, capacity)
        self.people = [self.scored(bins, self.free(bins)) for bins in start]
        while len(self.people) < population and not self.done():
            order, bins, free = list(range(len(self.sizes))), [], []
            self.r.shuffle(order)
            best_fit(self.sizes, order, bins, free, capacity)
            self.people.append(self.scored(bins, free))
            self.people.sort(key=lambda p: p[:2])

    def free(self, bins: list[list[int]]) -> list[int]:
        return [self.capacity - sum(self.sizes[i] for i in b) for b in bins]

    def scored(self, bins: list[list[int]], free: list[int]) -> tuple[int, float, list[list[int]], list[int]]:
        return len(bins), -fitness(free, self.capacity), bins, free

    def done(self) -> bool:
        return bool(self.people) and self.people[0][0] <= self.least

    def cross(self, mother: tuple, father: tuple, share: float = 0.1) -> tuple:
        """Inject a share of the father's bins, the best filled ones with a little chance; drop the mother's bins that share an item."""
        _, _, theirs, room = father
        noise = self.capacity * 0.02
        order = sorted(range(len(theirs)), key=lambda b: room[b] + self.r.random() * noise)
        chosen = order[: max(1, int(len(theirs) * share * 2 * self.r.random()))]
        inside = {i for b in chosen for i in theirs[b]}
        bins, free, loose = [theirs[b] for b in chosen], [room[b] for b in chosen], []
        for b, f in zip(mother[2], mother[3]):
            if inside.isdisjoint(b):
                bins.append(b)
                free.append(f)
            else:
                loose += [i for i in b if i not in inside]
        return self.placed(bins, free, loose)

    def mutate(self, one: tuple, share: float = 0.05) -> tuple:
        """Empty the least-filled bins and a few others."""
        _, _, bins, free = one
        n = max(1, int(len(bins) * share))
        gone = set(sorted(range(len(bins)), key=lambda b: -free[b])[:n]) | set(self.r.sample(range(len(bins)), n))
        keep = [b for b in range(len(bins)) if b not in gone]
        return self.placed([bins[b] for b in keep], [free[b] for b in keep], [i for b in gone for i in bins[b]])

    def placed(self, bins: list[list[int]], free: list[int], loose: list[int]) -> tuple:
        """Bins are shared between packings, so they are copied before they change."""
        sizes, room = self.sizes, sorted((self.sizes[i], i) for i in loose)
        order = [b for b, f in enumerate(free) if f]
        self.r.shuffle(order)
        for b in order:  # an item, or two, give way to a displaced one that fills the bin better
            f, held = free[b], bins[b]
            best = None
            n = len(held)
            for x in range(n):
                s = sizes[held[x]]
                at = bisect_left(room, (s + f + 1, -1)) - 1
                if at >= 0 and room[at][0] > s and (best is None or room[at][0] - s > best[0]):
                    best = (room[at][0] - s, at, (x,))
                for y in range(x + 1, min(n, x + 6)):
                    t = s + sizes[held[y]]
                    at = bisect_left(room, (t + f + 1, -1)) - 1
                    if at >= 0 and room[at][0] > t and (best is None or room[at][0] - t > best[0]):
                        best = (room[at][0] - t, at, (x, y))
                if best is not None and best[0] == f:
                    break
            if best is not None:
                gain, at, out = best
                item = room.pop(at)[1]
                bins[b] = [i for x, i in enumerate(held) if x not in out] + [item]
                free[b] = f - gain
                for x in out:
                    insort(room, (sizes[held[x]], held[x]))
        bins = [list(b) for b in bins]
        best_fit(sizes, [i for _, i in reversed(room)], bins, free, self.capacity)
        return self.scored(bins, free)

    def evolve(self, generations: int) -> list[int]:
        """Bins of the best packing after every generation; ends early once it meets the lower bound."""
        history, size = [], len(self.people)
        for _ in range(generations):
            if self.done():
                break
            mother, father = (min(self.r.sample(range(size), min(2, size))) for _ in range(2))
            child = self.cross(self.people[mother], self.people[father])
            made = [child, self.mutate(self.people[0] if self.r.random() < 0.5 else child)]
            self.people = sorted(self.people + made, key=lambda p: p[:2])
            self.people = [p for k, p in enumerate(self.people) if k == 0 or p[:2] != self.people[k - 1][:2]][:size]
            size = len(self.people)
            history.append(self.people[0][0])
        return history


def pack(pieces: DataFrame, key: list[str], block: int = 4096, islands: int = 2, rounds: int = 3, generations: int = 12, population: int = 6, capacity: int = CAPACITY) -> DataFrame:
    """Append (sequence_id, offset) to pieces with a ``length`` of at most ``capacity``.

    Pieces of full length are sequences by themselves. The others are dealt by hash of ``key`` into blocks of about
    ``block`` pieces, so no task gets more whatever the input, and a block wastes part of one sequence at most. A block is evolved on
    several islands, ``generations`` of two children each in a round; between rounds each island's best packing moves to the next island of its block, and in
    the end the best island's packing is taken. An island stops when its best packing meets the lower bound.
    Pieces of equal length are ordered by the hash of ``key``.
    Rows are sorted by length and hash of ``key`` (which must be unique) within a block first, so a repeated task packs alike. An empty table gives an empty result.
    """
    short = pieces.filter(F.col("length") < capacity)
    hashed = F.xxhash64(*key)
    count = short.count()
    blocks = max(1, -(-count // block))
    short = short.withColumn("__b", F.pmod(hashed, F.lit(blocks)))
    # an island's rows are the sizes of its block: a position in the block's order stands for the piece
    sizes = short.groupBy("__b").agg(F.sort_array(F.collect_list(F.struct(F.lit(-1) * F.col("length"), hashed))).alias("rows"))
    world = sizes.select("__b", F.transform("rows", lambda x: -x["col1"]).alias("sizes"))
    tasks = min(blocks * islands, 64 * pieces.sparkSession.sparkContext.defaultParallelism)
    world = world.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1)))).withColumn("elites", F.expr("cast(array() as array<array<int>>)"))
    for turn in range(rounds):

        def live(batches, turn=turn):
            for frame in batches:
                out = []
                for row in frame.itertuples(index=False):
                    lengths = np.array(row.sizes, np.int64)
                    start = [decode(np.array(e)) for e in row.elites]
                    island = Island(lengths, capacity, 1000 * turn + row.island, population, start)
                    island.evolve(generations)
                    best = island.people[0][2]
                    out.append((row.b, row.island, row.sizes, len(best), code(best, len(lengths))))
                yield pd.DataFrame(out, columns=["__b", "island", "sizes", "n", "best"])

        lived = world.select(F.col("__b").alias("b"), "island", "sizes", "elites").repartition(tasks, "b", "island").mapInPandas(live, "__b long, island int, sizes array<long>, n int, best array<int>")
        lived = materialize(lived)
        if turn + 1 < rounds:
            guests = lived.select("__b", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), F.col("best").alias("guest"))
            world = lived.join(guests, ["__b", "island"]).select("__b", "island", "sizes", F.array("best", "guest").alias("elites"))
    best = lived.groupBy("__b").agg(F.min(F.struct("n", "island", "best")).alias("m")).select("__b", F.col("m.best").alias("best"))

    def give(frame: pd.DataFrame, best: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["__neg", "__h", ], kind="stable").reset_index(drop=True)
        bins = np.array(best["best"].iloc[0])
        order = np.lexsort((np.arange(len(bins)), bins))
        lengths = frame["length"].to_numpy()[order]
        upto = np.concatenate([[0], np.cumsum(lengths)])[:-1]
        first = np.concatenate([[True], bins[order][1:] != bins[order][:-1]]) if len(bins) else np.zeros(0, bool)
        begin = upto[first][np.cumsum(first) - 1]
        offset = np.empty(len(bins), np.int64)
        offset[order] = upto - begin
        return frame.assign(sequence_id=(frame["__b"].to_numpy().astype(np.int64) << 21) + 2 * bins, offset=offset).drop(columns=["__b", "__neg", "__h"])

    from pyspark.sql.types import LongType, StructType

    schema = StructType([*pieces.schema.fields]).add("sequence_id", LongType()).add("offset", LongType())
    sorted_rows = short.withColumn("__neg", -F.col("length")).withColumn("__h", hashed)
    packed = sorted_rows.groupBy("__b").cogroup(best.groupBy("__b")).applyInPandas(give, schema)
    alone = pieces.filter(F.col("length") >= capacity).withColumn("sequence_id", 2 * F.monotonically_increasing_id() + 1).withColumn("offset", F.lit(0).cast("long"))
    return packed.unionByName(alone)


def code(bins: list[list[int]], n: int) -> np.ndarray:
    """A packing as the bin number of every item."""
    out = np.empty(n, np.int32)
    for k, b in enumerate(bins):
        out[b] = k
    return out


def decode(numbers: np.ndarray) -> list[list[int]]:
    order = np.argsort(numbers, kind="stable")
    return [x.tolist() for x in np.split(order, np.flatnonzero(np.diff(numbers[order])) + 1)] if len(numbers) else []


def best_fit_packing(docs: DataFrame, path: str, carry: list[str] = ("doc_id",), capacity: int = CAPACITY, end: int = 1, text: str = "text") -> DataFrame:
    """Tokenize, cut and pack whole documents: one row per piece with its sequence and place.

    ``ids_crc32`` is the checksum of the piece's ids as little-endian unsigned 32-bit integers. Null and empty texts are one piece of the end
    token; very long ones are cut into full pieces, sequences by themselves, and a rest. Rows with null or repeated doc_ids are packed like others. Input columns named like the result's own are replaced.
    """
    pieces = materialize(cut(docs, path, list(carry), capacity, end, text).withColumn("__row", F.monotonically_increasing_id()))
    return pack(pieces, ["__row"], capacity=capacity).drop("__row")
