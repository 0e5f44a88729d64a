"""Operator 7 - best-fit packing by a grouping genetic algorithm.

Documents become id arrays with an end id; those longer than a sequence are cut
into whole sequences, the first piece taking the remainder. Pieces of equal
length are interchangeable, so the search never sees documents: its problem is
the histogram of piece lengths (at most ``capacity`` counts, whatever the size
of the corpus) and its solutions are *bin groups*, a fill pattern and how many
bins have it.

* Start: best-fit decreasing, exact fits and least-slack fits over the histogram, and best fits in perturbed orders.
* Crossover injects whole well-filled bin groups of one parent into another,
  removes the receiver's bins that would use a document twice, and best-fits the
  displaced documents into what is open.
* Mutation empties the worst and some other bin groups and packs them anew, by least slack or by best fit in a perturbed order.
* Islands are Spark tasks that evolve populations of their own; between epochs
  each island's elite migrates to its neighbour. The search ends when a
  solution meets the lower bound ceil(total / capacity), or when an epoch has brought no island fewer bins.

README shows what crossover, mutation and migration each contribute.

The chosen solution is laid over the pieces by rank: a piece's rank within its
length (its rank in its partition, plus the counts of the partitions before)
picks its bin and its place there. Ranks need no sort of the pieces and no task
that sees all pieces of a length.

Defined cases: NULL and empty texts are one piece of the end id; NULL or equal
doc_ids are packed like any others; an empty table gives no rows; pieces
of a full sequence stand alone.
"""

from __future__ import annotations

import json
import random
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textvec
from .common import keep, slim_batches, table, tidy
from .tokens import encoder, tokenizer_path

CAPACITY = 1024
END_ID = 2
ISLANDS = 4
EPOCHS = 4
GENERATIONS = 30
POPULATION = 8
#: Best solutions that an island takes along into its next epoch.
PASSED_ON = 4

#: A solution: [(lengths in descending order, number of such bins)].
Solution = list[tuple[tuple[int, ...], int]]


# --- the search, over counts of lengths ---------------------------------------


def best_fit(counts: Counter, capacity: int, open_bins: Solution = (), order: list[int] | None = None) -> Solution:
    """Puts the counted lengths into the open bins and new ones; each goes where the least room is left."""
    by_room: dict[int, list[list]] = {}
    for pattern, m in open_bins:
        by_room.setdefault(capacity - sum(pattern), []).append([list(pattern), m])
    for length in order or sorted(counts, reverse=True):
        n = counts[length]
        rooms = sorted(r for r in by_room if r >= length)
        for room in rooms:
            if not n:
                break
            fit, groups = room // length, by_room.pop(room)
            for i, (pattern, m) in enumerate(groups):
                if not n:
                    by_room.setdefault(room, []).extend(groups[i:])
                    break
                whole = min(m, n // fit)
                if whole:
                    by_room.setdefault(room - fit * length, []).append([pattern + [length] * fit, whole])
                    n, m = n - whole * fit, m - whole
                if m and n:  # fewer than one bin takes
                    by_room.setdefault(room - n * length, []).append([pattern + [length] * n, 1])
                    n, m = 0, m - 1
                if m:
                    by_room.setdefault(room, []).append([pattern, m])
        if n:
            fit = capacity // length
            if n // fit:
                by_room.setdefault(capacity - fit * length, []).append([[length] * fit, n // fit])
            if n % fit:
                by_room.setdefault(capacity - n % fit * length, []).append([[length] * (n % fit), 1])
    return merged([(tuple(p), m) for groups in by_room.values() for p, m in groups])


def tight_fit(counts: Counter, capacity: int) -> Solution:
    """Fills bins exactly where the largest length left has one or two partners that do so; the rest by best fit."""
    left, bins = Counter(counts), []
    for length in sorted(counts, reverse=True):
        while left[length]:
            left[length] -= 1
            room, partners = capacity - length, None
            if room == 0:
                partners = ()
            elif left[room]:
                partners = (room,)
            else:
                for a in range(min(room - 1, length), room // 2 - 1, -1):
                    b = room - a
                    if left[a] and left[b] and (a != b or left[a] > 1):
                        partners = (a, b)
                        break
            if partners is None:
                left[length] += 1
                break
            left[length] += 1
            pattern = (length, *partners)
            use = Counter(pattern)
            m = min(left[k] // c for k, c in use.items())
            for k, c in use.items():
                left[k] -= c * m
            bins.append((pattern, m))
    return best_fit(Counter({k: v for k, v in left.items() if v}), capacity, bins)


def slack_fit(counts: Counter, capacity: int) -> Solution:
    """Each bin starts with the largest length left and takes, of all sets of the others, one that leaves the least room.

    Sums that can be reached are bits of an integer, one per length added, the
    small ones first; read back from the large end, so that small lengths are kept.
    Each round uses up one length at least, so there are at most ``capacity`` rounds.
    """
    left, bins = Counter({k: v for k, v in counts.items() if v > 0}), []
    while left:
        top = max(left)
        left[top] -= 1
        room = capacity - top
        usable = sorted(k for k, v in left.items() if v > 0 and k <= room)
        mask, reach = (1 << room + 1) - 1, [1]
        for k in usable:
            sums, n, step = reach[-1], min(left[k], room // k), 1
            while n:  # up to n of them, in powers of two
                take = min(step, n)
                sums |= sums << k * take & mask
                n, step = n - take, 2 * step
            reach.append(sums)
        goal, pattern = reach[-1].bit_length() - 1, [top]
        for i in range(len(usable) - 1, -1, -1):
            k = usable[i]
            for c in range(min(left[k], goal // k), -1, -1):
                if reach[i] >> goal - c * k & 1:
                    pattern += [k] * c
                    goal -= c * k
                    break
        left[top] += 1
        use = Counter(pattern)
        m = min(left[k] // c for k, c in use.items())
        for k, c in use.items():
            left[k] -= c * m
            if not left[k]:
                del left[k]
        bins.append((tuple(pattern), m))
    return merged(bins)


def merged(bins: Solution) -> Solution:
    total: Counter = Counter()
    for pattern, m in bins:
        total[tuple(sorted(pattern, reverse=True))] += m
    return sorted(total.items())


def cost(bins: Solution, capacity: int) -> tuple[int, float]:
    """Number of bins, then how unevenly they are filled (less is better)."""
    n = sum(m for _, m in bins)
    return n, -sum(m * (sum(p) / capacity) ** 2 for p, m in bins) / max(n, 1)


def crossover(receiver: Solution, donor: Solution, counts: Counter, capacity: int, rng: random.Random) -> Solution:
    good = sorted(donor, key=lambda b: -sum(b[0]))
    good = good[: max(1, len(good) // 2)]
    rng.shuffle(good)
    left, child = Counter(counts), []

    def put(pattern, m):
        for length, c in need[pattern]:
            left[length] -= c * m
        child.append((pattern, m))

    need = {p: list(Counter(p).items()) for p, _ in [*good, *receiver]}
    for pattern, m in good[: rng.randint(1, len(good))]:
        put(pattern, m)
    for pattern, m in sorted(receiver, key=lambda b: (-sum(b[0]), rng.random())):
        m = min(m, *(left[length] // c for length, c in need[pattern]))
        # the emptiest bins are opened as well, so that displaced documents meet new company
        if m > 0 and (sum(pattern) >= 0.9 * capacity or rng.random() < 0.8):
            put(pattern, m)
    return best_fit(Counter({k: v for k, v in left.items() if v > 0}), capacity, child)


def perturbed_fit(counts: Counter, capacity: int, rng: random.Random, open_bins: Solution = ()) -> Solution:
    return best_fit(counts, capacity, open_bins, sorted(counts, key=lambda x: -x * rng.uniform(0.9, 1.1)))


def mutate(bins: Solution, capacity: int, rng: random.Random) -> Solution:
    """Empties the least filled groups and as many others, and packs them anew."""
    bins = sorted(bins, key=lambda b: -sum(b[0]))
    cut = max(1, len(bins) // rng.choice((4, 8, 16)))
    kept, loose = bins[:-cut], Counter()
    others = set(rng.sample(range(len(kept)), min(len(kept), cut)))
    for pattern, m in [*bins[-cut:], *(kept[i] for i in others)]:
        for length in pattern:
            loose[length] += m
    kept = [b for i, b in enumerate(kept) if i not in others]
    if rng.random() < 0.5:
        return merged([*kept, *slack_fit(loose, capacity)])
    return perturbed_fit(loose, capacity, rng, kept)


def evolve(counts: Counter, capacity: int, people: list[Solution], seed: int, crossing: bool = True, mutating: bool = True) -> list[Solution]:
    """One epoch of one island: its population, best first."""
    rng = random.Random(seed)
    bound = -(-sum(k * v for k, v in counts.items()) // capacity)
    rank = lambda b: cost(b, capacity)
    people = people[:POPULATION]
    people += [perturbed_fit(counts, capacity, rng) for _ in range(POPULATION - len(people))]
    for _ in range(GENERATIONS):
        people.sort(key=rank)
        if rank(people[0])[0] <= bound:
            break
        better, worse = sorted(rng.sample(range(POPULATION), 2))
        child = crossover(people[worse], people[better], counts, capacity, rng) if crossing else people[better]
        if mutating and (not crossing or rng.random() < 0.5):
            child = mutate(child, capacity, rng)
        if rank(child) < rank(people[-1]) and child not in people:
            people[-1] = child
    return sorted(people, key=rank)


def starts(counts: Counter, capacity: int) -> list[Solution]:
    return sorted((f(counts, capacity) for f in (best_fit, tight_fit, slack_fit)), key=lambda b: cost(b, capacity))


def migrated(islands: list[list[Solution]]) -> list[list[Solution]]:
    """Each island's own best, and in the last place that of its neighbour."""
    return [[*own[: PASSED_ON - 1], islands[i - 1][0]] for i, own in enumerate(islands)]


def search(spark: SparkSession, counts: dict[int, int], capacity: int = CAPACITY, islands: int = ISLANDS, epochs: int = EPOCHS) -> Solution:
    """Evolves islands as Spark tasks; what travels is histograms and bin groups, both bounded by the capacity."""
    full = counts.get(capacity, 0)
    rest = Counter({k: v for k, v in counts.items() if v and k != capacity})
    whole: Solution = [((capacity,), full)] if full else []
    if not rest:
        return whole
    people = [starts(rest, capacity)] * islands
    best = people[0][0]
    bound = -(-sum(k * v for k, v in rest.items()) // capacity)
    problem = json.dumps(sorted(rest.items()))
    for epoch in range(epochs):
        if cost(best, capacity)[0] <= bound:
            break
        rows = [(i, json.dumps(own)) for i, own in enumerate(people)]

        def island(batches: Iterator[pa.RecordBatch], epoch=epoch) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = []
                for i, text in zip(b.column("island").to_pylist(), b.column("people").to_pylist(), strict=True):
                    found = evolve(Counter(dict(json.loads(problem))), capacity, _solutions(text), 1000 * epoch + i)
                    out.append(json.dumps(found[:PASSED_ON]))
                yield pa.RecordBatch.from_arrays([b.column("island"), pa.array(out, pa.string())], names=["island", "people"])

        tasks = spark.createDataFrame(rows, "island int, people string").repartition(islands, "island")
        found = sorted(tasks.mapInArrow(tidy(island), "island int, people string").collect())  # PASSED_ON bounded solutions per island
        people = [_solutions(r["people"]) for r in found]
        before, best = best, min([best, *(p[0] for p in people)], key=lambda s: cost(s, capacity))
        if cost(best, capacity)[0] == cost(before, capacity)[0]:
            break
        people = migrated(people)
    return whole + best


def _solutions(text: str) -> list[Solution]:
    return [[(tuple(p), m) for p, m in s] for s in json.loads(text)]


# --- documents to pieces, pieces to places --------------------------------------

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long"


def pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, tokenizer: str = "byte_bpe_50k.json", with_ids: bool = False) -> DataFrame:
    """Pieces of all texts; part and rank number the pieces of each length inside a partition. with_ids adds the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, part = encoder(tokenizer_path(tokenizer)), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        end = np.array([end_id], "<u4").tobytes()
        for b in batches:
            cols: list[list] = [[] for _ in range(6 + with_ids)]
            doc_ids = b.column("doc_id").to_pylist()
            for lo, hi, buf, offsets in textvec.parts(b.column("text")):
                ids, bounds = enc.encode_part(buf, offsets)
                for i in range(lo, hi):
                    raw = ids[bounds[i - lo] : bounds[i - lo + 1]].tobytes() + end
                    n, at, piece = len(raw) // 4, 0, 0
                    while at < n:
                        size = (n - at) % capacity or capacity
                        own = raw[4 * at : 4 * (at + size)]
                        row = (doc_ids[i], piece, at, size, zlib.crc32(own), int(seen[size]))
                        for col, v in zip(cols, (*row, np.frombuffer(own, "<u4").tolist()) if with_ids else row, strict=True):
                            col.append(v)
                        seen[size] += 1
                        at, piece = at + size, piece + 1
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            arrays = [pa.array(c, k) for c, k in zip(cols, kinds, strict=False)]
            arrays.insert(5, pa.array(np.full(len(cols[0]), part, np.int32)))
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank", "ids"]
            yield pa.RecordBatch.from_arrays(arrays, names=names[: len(arrays)])

    schema = PIECES + (", ids array<long>" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), schema)


def _layout(bins: Solution) -> tuple[np.ndarray, np.ndarray]:
    """Where the pieces of each length go: sorted (length, first rank) keys, and (pieces per bin, first bin, offset) for each."""
    next_rank: Counter = Counter()
    rows, first_bin = [], 0
    for pattern, m in bins:
        offset = 0
        for length, c in sorted(Counter(pattern).items(), reverse=True):
            rows.append((length << 48 | next_rank[length], c, first_bin, offset))
            next_rank[length] += c * m
            offset += length * c
        first_bin += m
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 4)
    return table[:, 0], table[:, 1:]


def place(found: DataFrame, bins: Solution) -> DataFrame:
    """Adds sequence_id and offset to pieces."""
    spark = found.sparkSession
    sums = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    before = found.groupBy("part", "length").agg(F.count("*").alias("n")).select("part", "length", F.coalesce(sums, F.lit(0)).alias("before"))
    plan = spark.sparkContext.broadcast(_layout(bins))  # bounded by the capacity, as the solution is
    keep = [c for c in found.columns if c not in ("part", "rank")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, rows = plan.value
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("whole_rank").to_numpy()
            at = np.searchsorted(keys, length << 48 | rank, "right") - 1
            k = rank - (keys[at] & ((1 << 48) - 1))
            c, first_bin, offset = rows[at].T
            yield pa.RecordBatch.from_arrays(
                [*(b.column(n) for n in keep), pa.array(first_bin + k // c), pa.array(offset + k % c * length)], names=[*keep, "sequence_id", "offset"]
            )

    ranked = found.join(before, ["part", "length"]).withColumn("whole_rank", F.col("rank") + F.col("before"))
    schema = ", ".join(f"{n} {found.schema[n].dataType.simpleString()}" for n in keep) + ", sequence_id long, offset long"
    return ranked.select(*keep, "whole_rank").mapInArrow(tidy(run), schema)


def pack(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, tokenizer: str = "byte_bpe_50k.json", with_ids: bool = False) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids)."""
    found = keep(pieces(docs, capacity, end_id, tokenizer, with_ids))
    counts = {int(r["length"]): r["n"] for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    return place(found, search(docs.sparkSession, counts, capacity))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    slim_batches(spark)
    return pack(table(spark, sf_dir, "documents"))
