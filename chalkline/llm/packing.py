"""Packing of documents into as few sequences of CAPACITY tokens as possible, by bin completion.

Every whole text is tokenized and gets an end id; documents longer than CAPACITY are cut into pieces of it, the last piece
may be shorter. A piece's row has its length and checksum, its writing task (shard) and its number among that task's
pieces of its length; ids go along only if asked for.

Pieces of one length are alike, so the packing is solved on how many pieces there are of each length: CAPACITY rows at
most, whatever the data. Best-fit decreasing gives the incumbent, run on groups of equal bins. While it needs more
sequences than the lower bound, bin completion goes on: around the largest piece left it enumerates the fillings that no
other filling dominates, takes one for as many sequences as the pieces allow or for one, and turns back where the waste so
far is more than a better packing may have. The search ends at the bound, when all is tried, or after NODES fillings;
solve() says which. Each piece then finds its place alone: its rank among its length (offsets of shards, no window over
pieces) is looked up among runs of equal fillings.

Null and empty texts are the end id alone; repeated rows are packed each; null doc_ids stay; an empty table gives no rows;
other columns are left out.
"""

from __future__ import annotations

import sys
import types
import zlib
from bisect import bisect_left, insort
from collections import Counter
from itertools import accumulate

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chalkline.llm.common import bounded_batches, checkpointed, id_and_text, maybe_broadcast, shared_path
from chalkline.llm.tokens import LETTERS, MARKS, Numbers, Runs, _slices, byte_letters

TOKENIZER, CAPACITY, END_ID = "word_bpe_49k.json", 2048, 0
#: Words remembered by a worker at most; fillings tried by the search; steps of an enumeration around a piece, fillings kept of it.
WORDS, NODES, FILLINGS, BRANCHES = 700_000, 6000, 2000, 6
PLACED = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, shard int, nth long"

#: A word of Latin letters and at most one mark behind it, which are tokens apart.
PLAIN = rf"^(?P<word>[{LETTERS}]+)(?P<mark>[{MARKS}]?)$"
#: A word that no normalizer of case or composition changes.
LOWER = r"^[a-z\x{df}-\x{f6}\x{f8}-\x{ff}]+$"


class SpacedEncoder:
    """Ids of texts by a tokenizer that drops white space, so texts may be cut at it; remembers the ids of words.

    Its file must say so: a pre-tokenizer that removes what its pattern doesn't match, no pattern with white space, no
    added token that reaches over it. Texts of other tokenizers are tokenized whole.
    """

    def __init__(self, path: str, end_id: int = END_ID):
        import json

        from tokenizers import Tokenizer

        self.tokenizer, self.end_id = Tokenizer.from_file(path), end_id
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        cuts = [p for p in (spec.get("pre_tokenizer") or {}).get("pretokenizers") or () if p.get("type") == "Split"]
        within = all(not (t.get("lstrip") or t.get("rstrip") or t.get("single_word")) and t["content"].split() == [t["content"]] for t in spec.get("added_tokens") or ())
        self.by_words = len(cuts) == 1 and cuts[0].get("behavior") == "Removed" and bool(cuts[0].get("invert")) and r"[^\s" in cuts[0]["pattern"].get("Regex", "") and within and not spec["model"].get("dropout")
        self.apart = self.by_words and [self.whole([f"ab{m}"])[0] for m in MARKS] == [self.whole(["ab"])[0] + self.whole([m])[0] for m in MARKS]
        # what the pre-tokenizer does to a word of plain lower-case letters is to write its bytes as letters
        self.letters, probe = byte_letters(), "abßöÿz"
        self.by_model = self.by_words and self.whole([probe])[0] == [t.id for t in self.tokenizer.model.tokenize(probe.encode().decode("latin-1").translate(self.letters))]
        self.forget()

    def forget(self) -> None:
        self.words, self.runs = Numbers([""]), Runs()
        self.runs.add_lists([[]])

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def numbered(self, words) -> np.ndarray:
        import pyarrow as pa
        import pyarrow.compute as pc

        numbers = self.words.of(words.dictionary_encode())
        new, self.words.new = self.words.new, []
        if not new:
            return numbers
        plain = pc.match_substring_regex(pa.array(new, pa.string()), LOWER).to_pylist() if self.by_model else [False] * len(new)
        written = iter("\n".join(w for w, p in zip(new, plain) if p).encode().decode("latin-1").translate(self.letters).split(self.letters[10]))
        tokenize, others = self.tokenizer.model.tokenize, iter(self.whole([w for w, p in zip(new, plain) if not p]))
        flat, lengths = [], []
        for p in plain:  # flat, as a list for each word would be the garbage collector's to visit
            ids = [t.id for t in tokenize(next(written))] if p else next(others)
            flat += ids
            lengths.append(len(ids))
        self.runs.add(np.array(flat, np.int32), np.array(lengths, np.int64))
        return numbers

    def encode(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts (a pyarrow string array without nulls) one after another with the end id after each, and how many each has."""
        import pyarrow as pa
        import pyarrow.compute as pc

        if not self.by_words:
            found = [np.array([*x, self.end_id], np.int32) for x in self.whole(texts.to_pylist())]
            return np.concatenate([np.empty(0, np.int32), *found]), np.array(list(map(len, found)), np.int64)
        if len(self.words) > WORDS:
            self.forget()
        pieces = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        cuts = pieces.offsets.to_numpy().astype(np.int64)
        coded = pieces.flatten().dictionary_encode()
        distinct = coded.dictionary
        if self.apart:
            found = pc.extract_regex(distinct, PLAIN)
            marks = pc.fill_null(pc.struct_field(found, "mark"), "")
            parts = np.stack([self.numbered(pc.coalesce(pc.ascii_lower(pc.struct_field(found, "word")), distinct)), self.numbered(marks)], 1)
            flat, lengths = self.runs.take(parts.ravel())
            runs = Runs.of(flat, lengths.reshape(-1, 2).sum(1))
        else:
            runs = Runs.of(*self.runs.take(self.numbered(pa.array(distinct))))
        flat, lengths = runs.take(coded.indices.to_numpy())
        upto = np.r_[0, np.cumsum(lengths, dtype=np.int64)][cuts - cuts[0]]
        return np.insert(flat, upto[1:], self.end_id), np.diff(upto) + 1


def _encoder(path: str, end_id: int) -> SpacedEncoder:
    """One for each Python worker, tokenizer and end id, however many tasks it runs."""
    held = sys.modules.setdefault("_chalkline_spaced_encoders", types.ModuleType("_chalkline_spaced_encoders"))
    key = f"{path}:{end_id}"
    if key not in held.__dict__:
        held.__dict__[key] = SpacedEncoder(path, end_id)
    return held.__dict__[key]


def _cut(path: str, end_id: int, capacity: int, keep_ids: bool):
    def run(batches):
        import os

        import pyarrow as pa

        os.environ.update(RAYON_NUM_THREADS="1", TOKENIZERS_PARALLELISM="false")
        encoder, shard, seen = _encoder(path, end_id), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            texts = batch.column(1).cast(pa.string()).fill_null("")
            for k, n in _slices(batch.column(1)):
                flat, sizes = encoder.encode(texts.slice(k, n))
                number = -(-sizes // capacity)  # pieces of each document
                row = np.repeat(np.arange(n), number)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number)
                start = piece * capacity
                length = np.minimum(sizes[row] - start, capacity)
                at = (np.cumsum(sizes) - sizes)[row] + start
                words = flat.astype("<u4", copy=False)
                sums = [zlib.crc32(words[a:b]) for a, b in zip(at.tolist(), (at + length).tolist())]
                order = np.argsort(length, kind="stable")
                sort = length[order]
                first = np.searchsorted(sort, sort, "left")
                nth = np.empty(len(row), np.int64)
                nth[order] = seen[sort] + np.arange(len(row)) - first
                seen += np.bincount(length, minlength=capacity + 1)
                columns = [batch.column(0).slice(k, n).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length.astype(np.int32)), pa.array(sums, pa.int64()), pa.array(np.full(len(row), shard, np.int32)), pa.array(nth)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "shard", "nth"]
                if keep_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.r_[at, len(flat)].astype(np.int32)), pa.array(flat.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def write_pieces(docs: DataFrame, path: str, tokenizer_path: str | None = None, end_id: int = END_ID, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Write the pieces of all of docs (doc_id, text) to Parquet at path; gives them, read back."""
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path(TOKENIZER)
    spark = docs.sparkSession
    bounded_batches(spark)
    schema = PIECES + (", ids array<int>" if keep_ids else "")
    id_and_text(docs).mapInArrow(_cut(tokenizer_path, end_id, capacity, keep_ids), schema).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


# Packing of (length, number of pieces). A filling is ((length, copies), ...), longest first; a packing lists (filling, sequences).


def best_fit(numbers: dict[int, int], capacity: int) -> list[tuple[tuple, int]]:
    """Best-fit decreasing: each piece, longest first, into the sequence with the least room that takes it."""
    rooms: dict[int, Counter] = {}
    order: list[int] = []

    def put(room: int, filling: tuple, copies: int) -> None:
        if not rooms.get(room):
            rooms[room] = Counter()
            insort(order, room)
        rooms[room][filling] += copies

    for length in sorted(numbers, reverse=True):
        left = numbers[length]
        while left:
            i = bisect_left(order, length)
            if i == len(order):
                each = capacity // length  # a sequence takes as many as fit before a new one is begun
                full, rest = divmod(left, each)
                for copies, n in ((full, each), (1, rest)):
                    if copies and n:
                        put(capacity - n * length, ((length, n),), copies)
                left = 0
                continue
            room = order[i]
            filling, copies = next(iter(rooms[room].items()))
            each = min(room // length, left)
            used = min(copies, left // each)
            rooms[room][filling] -= used
            if not rooms[room][filling]:
                del rooms[room][filling]
            if not rooms[room]:
                order.pop(i)
            put(room - each * length, (*filling, (length, each)), used)
            left -= used * each
    return [(filling, copies) for group in rooms.values() for filling, copies in group.items()]


def lower_bound(numbers: dict[int, int], capacity: int) -> int:
    """Sequences that any packing needs: by tokens, and by pieces that can't share with those of threshold length and more."""
    most = -(-sum(x * n for x, n in numbers.items()) // capacity)
    for k in [x for x in numbers if 2 * x <= capacity]:
        alone = sum(n for x, n in numbers.items() if x > capacity - k)
        halves = [(x, n) for x, n in numbers.items() if capacity < 2 * x and x <= capacity - k]
        small = sum(x * n for x, n in numbers.items() if k <= x and 2 * x <= capacity)
        number = sum(n for _, n in halves)
        room = number * capacity - sum(x * n for x, n in halves)
        most = max(most, alone + number + max(0, -(-(small - room) // capacity)))
    return max(most, sum(n for x, n in numbers.items() if 2 * x > capacity))


def dominates(a: tuple, b: tuple) -> bool:
    """Whether b's pieces go into a's pieces as into bins, so that a is never worse than b."""

    def fits(bins: list[int], pieces: list[int]) -> bool:
        if not pieces:
            return True
        for i in range(len(bins)):
            if bins[i] >= pieces[0] and bins[i] not in bins[:i] and fits([*bins[:i], bins[i] - pieces[0], *bins[i + 1 :]], pieces[1:]):
                return True
        return False

    return fits([x for x, n in a for _ in range(n)], [x for x, n in b for _ in range(n)])


def fillings(numbers: dict[int, int], room: int, waste: int) -> tuple[list[tuple], bool]:
    """Undominated fillings of room that leave at most waste, least waste first; whether that is all of them."""
    if room and numbers.get(room):
        return [((room, 1),)], True  # one piece of just that length dominates every other filling
    lengths = sorted((x for x, n in numbers.items() if n and x <= room), reverse=True)
    below = [*accumulate((x * numbers[x] for x in reversed(lengths)), initial=0)][::-1]  # tokens of lengths[i:]
    negative = [-x for x in lengths]
    found, visits, perfect = [], 0, 0

    def extend(i: int, left: int, chosen: tuple) -> None:
        nonlocal visits, perfect
        visits += 1
        used = dict(chosen)
        if numbers.get(left, 0) > used.get(left, 0):  # it dominates whatever else fills what is left
            used[left] = used.get(left, 0) + 1
            found.append((0, tuple(sorted(used.items(), reverse=True))))
            perfect += 1
            return
        if left <= waste and not any(x <= left and numbers[x] > used.get(x, 0) for x in reversed(lengths)):
            found.append((left, chosen))
            perfect += not left
        for j in range(bisect_left(negative, -left, i), len(lengths)):
            if visits >= FILLINGS or perfect >= BRANCHES or left - below[j] > waste:
                return
            x = lengths[j]
            for n in range(min(numbers[x], left // x), 0, -1):
                extend(j + 1, left - n * x, (*chosen, (x, n)))
                if visits >= FILLINGS or perfect >= BRANCHES:
                    return

    extend(0, room, ())
    found = sorted(set(found), key=lambda f: (f[0], sum(n for _, n in f[1]), f[1]))
    kept: list[tuple] = []
    small = lambda f: sum(n for _, n in f) <= 8
    for _, chosen in found:
        if len(kept) < BRANCHES and not (small(chosen) and any(small(k) and dominates(k, chosen) for k in kept)):
            kept.append(chosen)
    return kept, visits < FILLINGS and perfect < BRANCHES and len(kept) < BRANCHES


def solve(numbers: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES) -> tuple[list[tuple[tuple, int]], bool]:
    """A packing of the pieces, and whether no better one exists."""
    numbers = {x: n for x, n in numbers.items() if n}
    best = best_fit(numbers, capacity)
    count, bound, total = sum(n for _, n in best), lower_bound(numbers, capacity), sum(x * n for x, n in numbers.items())
    if count == bound:
        return best, True
    whole = True

    def choices(left: dict[int, int], wasted: int) -> list[tuple[tuple, int, int]]:
        nonlocal whole
        largest = max(left)
        rest = left | {largest: left[largest] - 1}
        allowed = (count - 1) * capacity - total - wasted
        found, complete = fillings(rest, capacity - largest, allowed)
        whole &= complete
        out = []
        for f in found:
            pieces = Counter(dict(f))
            pieces[largest] += 1
            waste = capacity - sum(x * n for x, n in pieces.items())
            most = min(left[x] // n for x, n in pieces.items())
            most = min(most, allowed // waste) if waste else most
            out += [(tuple(sorted(pieces.items(), reverse=True)), q, waste) for q in dict.fromkeys((most, 1)) if q]
        return out

    # depth first, on a stack of iterators: (choices left, pieces left, waste so far); path: what was chosen above
    stack, path, tried = [(iter(choices(numbers, 0)), numbers, 0)], [], 0
    while stack and count > bound:
        options, left, wasted = stack[-1]
        option = next(options, None)
        if option is None or tried >= nodes:
            stack.pop()
            path = path[:-1]
            continue
        tried += 1
        filling, copies, waste = option
        wasted += waste * copies
        if wasted > (count - 1) * capacity - total:
            continue
        taken = dict(filling)
        remaining = {x: m for x, n in left.items() if (m := n - copies * taken.get(x, 0))}
        if not remaining:
            best = [*path, (filling, copies)]
            count = sum(n for _, n in best)
            continue
        path.append((filling, copies))
        stack.append((iter(choices(remaining, wasted)), remaining, wasted))
    return best, count == bound or whole and tried < nodes


def runs_of(packing: list[tuple[tuple, int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, pieces a sequence, first sequence, first place) of each run of pieces that fill alike, by length and rank."""
    ranks: Counter = Counter()
    rows, sequence = [], 0
    for filling, copies in packing:
        places = accumulate((x * n for x, n in filling), initial=0)
        for (length, n), place in zip(filling, places):
            rows.append((length, ranks[length], n, sequence, place))
            ranks[length] += n * copies
        sequence += copies
    return sorted(rows)


def _place(runs: list[tuple[int, int, int, int, int]]):
    table = np.array(runs, np.int64).reshape(-1, 5)
    keys = (table[:, 0] << 48) + table[:, 1]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            length, rank = (batch.column(i).to_numpy().astype(np.int64) for i in (3, 5))
            _, first, each, sequence, place = table[np.searchsorted(keys, (length << 48) + rank, "right") - 1].T
            nth = rank - first
            columns = [*batch.columns[:3], pa.array(length), batch.column(4), pa.array(sequence + nth // each), pa.array(place + nth % each * length), *batch.columns[6:8]]
            yield pa.RecordBatch.from_arrays(columns, [*PLACED[:5], "sequence_id", "offset", "shard", "nth"])

    return run


def place_pieces(pieces: DataFrame, capacity: int = CAPACITY, nodes: int = NODES) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of all pieces; shard, length and nth name a piece."""
    counted = checkpointed(pieces.groupBy("shard", "length").agg(F.count("*").alias("n")))
    numbers = dict(tuple(r) for r in counted.groupBy("length").agg(F.sum("n")).collect())  # capacity rows at most
    packing, _ = solve(numbers, capacity, nodes)
    before = Window.partitionBy("length").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each shard
    offsets = counted.select("shard", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    ranked = pieces.join(maybe_broadcast(offsets, counted.count()), ["shard", "length"])
    ranked = ranked.select(*PLACED[:5], (F.col("offset") + F.col("nth")).alias("rank"), "shard", "nth")
    return ranked.mapInArrow(_place(runs_of(packing)), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, shard int, nth long")


def packed_documents(docs: DataFrame, path: str | None = None, **options) -> DataFrame:
    """The places of all of docs' pieces in as few sequences as were found."""
    return place_pieces(write_pieces(docs, path or shared_path(docs.sparkSession, "pieces"), **options), options.get("capacity", CAPACITY))


def packed_sequences(pieces: DataFrame, places: DataFrame) -> DataFrame:
    """sequence_id, its ids and its segments (doc_id, piece, offset) of pieces written with their ids; one sequence is what meets in a task."""
    key = ["shard", "length", "nth"]
    joined = pieces.select(*key, "ids").join(places.select(*key, "doc_id", "piece", "sequence_id", "offset"), key)
    held = joined.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "doc_id", "piece", "ids"))).alias("parts"))
    return held.select("sequence_id", F.flatten("parts.ids").alias("ids"), F.transform("parts", lambda p: F.struct(p["doc_id"].alias("doc_id"), p["piece"].alias("piece"), p["offset"].alias("offset"))).alias("segments"))
