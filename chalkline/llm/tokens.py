"""Token ids in Parquet: one list column, dictionary-encoded, with row groups, pages and indexes of set sizes.

Documents are dealt by ranges of doc_id and sorted, so file after file holds them in ascending order. Each row has its
shard (the range) and its start within it besides the ids, so metadata can be read without the ids, and Parquet's page
indexes let a reader of a few doc_ids skip the other pages. Spark's own writer commits the files, so a lost executor's
files are written again.

Byte-level tokenizers: texts are cut into pieces between single spaces or line feeds, as the pre-tokenizer always cuts
before a single space between characters that aren't white space, and around a single line feed between such. So a
text's ids are those of its pieces in turn. A piece's word is tokenized once and remembered. Texts with any other white space, and all texts
where the tokenizer's file has another pre-tokenizer, a normalizer or added tokens that reach beyond a piece, are
tokenized whole.

Null texts count as empty and give the end id alone; rows of one doc_id are ordered by the hash of their text, then by
text, and all kept; null doc_ids come first; an empty table gives an empty file; other columns are left out.
"""

from __future__ import annotations

import json
import sys
import types
import zlib
from itertools import chain

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chalkline.llm.common import bounded_batches, checkpointed, id_and_text, maybe_broadcast, shared_path

TOKENIZER = "byte_bpe_50k.json"
END_ID = 0
#: Bytes of a row group; rows of a page (the grain of its index).
GROUP_BYTES, PAGE_ROWS = 64 << 20, 64
#: Words remembered by a worker at most (some 130 MB).
WORDS = 700_000
#: Bytes of texts that a worker tokenizes in one go.
SLICE_BYTES = 4 << 20
SCHEMA = "doc_id long, shard int, shard_start long, n_tokens int, ids array<int>"

#: White space other than single spaces and line feeds between other characters.
ODD_SPACE = r"^[ \n]|[ \n]$|[ \n][ \n]|[\t\v\f\r\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


#: A word of Latin letters and at most one mark behind it: the pre-tokenizer cuts between the two and nowhere else.
LETTERS, MARKS = r"A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}", ".,:;!?"
#: Stands for a text's end among the words; no word begins with two spaces.
END = "  "
PLAIN, WORD = rf"^\n?(?P<word>[{LETTERS}]+)(?P<mark>[{MARKS}]?)$", rf"^ ?[{LETTERS}]+$"


def cut_at_spaces(spec: dict) -> bool:
    """Whether a tokenizer's file makes ids of pieces between single spaces independent of each other."""
    pre = spec.get("pre_tokenizer") or {}
    by_pieces = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True)
    within = all(t["content"].split() == [t["content"]] and not (t.get("lstrip") or t.get("rstrip") or t.get("single_word")) for t in spec.get("added_tokens") or ())
    apart = all(any(not c.isalpha() and c not in MARKS for c in t["content"]) for t in spec.get("added_tokens") or ())
    return by_pieces and within and apart and not spec.get("normalizer") and not spec["model"].get("dropout")


def byte_letters() -> dict[int, str]:
    """Characters that byte-level vocabularies write for bytes, by a rule: printable ones stand for themselves, the others follow 255 in turn."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Numbers(dict):
    """Numbers of strings as they are met; new ones wait to be tokenized."""

    def __init__(self, known: list[str]):
        super().__init__((x, i) for i, x in enumerate(known))
        self.new: list[str] = []

    def __missing__(self, string: str) -> int:
        self[string] = number = len(self)
        self.new.append(string)
        return number

    def of(self, coded) -> np.ndarray:
        """Numbers of a dictionary-encoded pyarrow array."""
        distinct = coded.dictionary.to_numpy(zero_copy_only=False)  # much quicker than to_pylist
        return np.fromiter(map(self.__getitem__, distinct), np.int32, len(distinct))[coded.indices.to_numpy()]


class Runs:
    """Ids of numbered strings, one run after another."""

    def __init__(self):
        self.lengths, self.starts, self.ids = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32), np.zeros(1 << 18, np.int32)
        self.count = self.used = 0

    def add(self, flat: np.ndarray, lengths: np.ndarray) -> None:
        n = len(lengths)
        while self.count + n > len(self.lengths):
            self.lengths, self.starts = (np.concatenate([x, np.zeros_like(x)]) for x in (self.lengths, self.starts))
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.lengths[self.count : self.count + n] = lengths
        self.starts[self.count : self.count + n] = self.used + np.cumsum(lengths) - lengths
        self.ids[self.used : self.used + len(flat)] = flat
        self.count += n
        self.used += len(flat)

    def add_lists(self, lists: list[list[int]]) -> None:
        self.add(np.fromiter(chain.from_iterable(lists), np.int32), np.fromiter(map(len, lists), np.int64, len(lists)))

    @classmethod
    def of(cls, flat: np.ndarray, lengths: np.ndarray) -> Runs:
        runs = cls()
        runs.add(flat, lengths)
        return runs

    def take(self, at: np.ndarray, skip: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the numbers at one after another, and their lengths; the first id goes at the places skip."""
        lengths, starts = self.lengths[at], self.starts[at]
        if skip is not None:
            lengths[skip] -= 1
            starts[skip] += 1
        upto = np.cumsum(lengths, dtype=np.int64)
        total = int(upto[-1]) if len(upto) else 0
        return self.ids[np.arange(total) + np.repeat(starts - (upto - lengths), lengths)], lengths


class PieceEncoder:
    """Ids of texts by a tokenizer of the tokenizers library; remembers the ids of words.

    A piece is what stands after a space; one that begins with a line feed stands after that instead. The empty piece
    is the end of a text, a lone line feed is an empty text (its id is cut off like that before any text's first piece).
    A piece is a line feed or nothing, its word (the space before it included) or whatever else it is, and its mark.
    Pieces are far more than words, so a slice's distinct pieces are put together from their words by Arrow and numpy.
    """

    def __init__(self, path: str, end_id: int = END_ID):
        from tokenizers import Tokenizer

        self.tokenizer, self.end_id, self.letters = Tokenizer.from_file(path), end_id, byte_letters()
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.line = self.whole(["\n"])[0]
        self.by_pieces = cut_at_spaces(spec) and len(self.line) == 1
        self.forget_words()

    def forget_words(self) -> None:
        known = ["\n", *MARKS]
        self.words, self.parts = Numbers(["", *known, END]), Runs()
        self.parts.add_lists([[], *self.whole(known), [self.end_id]])

    def whole(self, texts: list[str]) -> list[list[int]]:
        """Ids of texts by the tokenizer as it is."""
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def piece_runs(self, pieces) -> Runs:
        """Ids of distinct pieces (a pyarrow string array), by their places."""
        import pyarrow as pa
        import pyarrow.compute as pc

        if len(self.words) > WORDS:
            self.forget_words()
        found, at_line = pc.extract_regex(pieces, PLAIN), pc.starts_with(pieces, "\n")
        body = pc.coalesce(pc.struct_field(found, "word"), pc.replace_substring_regex(pieces, r"^\n", ""))
        words = pc.binary_join_element_wise(pc.if_else(at_line, "", " "), body, "")
        words = pc.if_else(pc.equal(pieces, ""), pa.scalar(END), words)
        numbers = [
            at_line.to_numpy(zero_copy_only=False).astype(np.int32),  # the line feed's number is 1
            self.words.of(words.dictionary_encode()),
            self.words.of(pc.fill_null(pc.struct_field(found, "mark"), "").dictionary_encode()),
        ]
        self.learn_words()
        flat, lengths = self.parts.take(np.stack(numbers, 1).ravel())
        return Runs.of(flat, lengths.reshape(-1, 3).sum(1))

    def learn_words(self) -> None:
        """Tokenize the new words; one of Latin letters alone is one pre-token, which the tokenizer's model takes as it is."""
        import pyarrow as pa
        import pyarrow.compute as pc

        new, self.words.new = self.words.new, []
        if not new:
            return
        plain = pc.match_substring_regex(pa.array(new, pa.string()), WORD).to_pylist()
        written = "\n".join(w for w, p in zip(new, plain) if p).encode().decode("latin-1").translate(self.letters).split(self.letters[10])
        tokenize, others = self.tokenizer.model.tokenize, iter(self.whole([w for w, p in zip(new, plain) if not p]))
        flat, lengths, letters = [], [], iter(written)
        for p in plain:  # flat, as a list for each word would be the garbage collector's to visit
            ids = [t.id for t in tokenize(next(letters))] if p else next(others)
            flat += ids
            lengths.append(len(ids))
        self.parts.add(np.array(flat, np.int32), np.array(lengths, np.int64))

    def encode(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (a pyarrow string array without nulls) one after another, the end id after each, and how many each has."""
        import pyarrow as pa
        import pyarrow.compute as pc

        odd = pc.match_substring_regex(texts, ODD_SPACE).to_numpy(zero_copy_only=False) if self.by_pieces else np.ones(len(texts), bool)
        if odd.all():
            return self.encode_whole(texts)
        if odd.any():
            plain, rest = self.encode(texts.filter(pa.array(~odd))), self.encode_whole(texts.filter(pa.array(odd)))
            parts: list = [None] * len(texts)
            for (flat, sizes), at in ((plain, np.flatnonzero(~odd)), (rest, np.flatnonzero(odd))):
                for i, part in zip(at.tolist(), np.split(flat, np.cumsum(sizes)[:-1])):
                    parts[i] = part
            return np.concatenate(parts), np.array(list(map(len, parts)), np.int64)
        lines = pc.replace_substring(texts, "\n", " \n")
        pieces = pc.split_pattern(pc.binary_join_element_wise("\n", lines, " ", ""), " ")
        cuts = pieces.offsets.to_numpy().astype(np.int64)
        cuts -= cuts[0]
        coded = pieces.flatten().dictionary_encode()
        # a text's first piece was written after a line feed, whose id goes
        flat, lengths = self.piece_runs(coded.dictionary).take(coded.indices.to_numpy(), cuts[:-1])
        return flat, np.diff(np.r_[0, np.cumsum(lengths, dtype=np.int64)][cuts])

    def encode_whole(self, texts) -> tuple[np.ndarray, np.ndarray]:
        found = [np.array([*x, self.end_id], np.int32) for x in self.whole(texts.to_pylist())]
        return np.concatenate([np.empty(0, np.int32), *found]), np.array(list(map(len, found)), np.int64)


def _encoder(path: str, end_id: int) -> PieceEncoder:
    """One for each Python worker, tokenizer and end id, however many tasks it runs."""
    held = sys.modules.setdefault("_chalkline_encoders", types.ModuleType("_chalkline_encoders"))
    key = f"{path}:{end_id}"
    if key not in held.__dict__:
        held.__dict__[key] = PieceEncoder(path, end_id)
    return held.__dict__[key]


def _slices(texts):
    """(first row, rows) of parts of texts of about SLICE_BYTES."""
    import pyarrow.compute as pc

    part = (np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy()) // SLICE_BYTES) if len(texts) else np.empty(0, np.int64)
    firsts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(texts) else part
    return zip(firsts.tolist(), np.diff(np.r_[firsts, len(texts)]).tolist())


def _encode_batches(path: str, end_id: int):
    def run(batches):
        import os

        import pyarrow as pa

        os.environ.update(RAYON_NUM_THREADS="1", TOKENIZERS_PARALLELISM="false")
        encoder, shard, start = _encoder(path, end_id), TaskContext.get().partitionId(), 0
        for batch in batches:
            texts = batch.column(1).cast(pa.string()).fill_null("")
            for k, n in _slices(batch.column(1)):
                flat, sizes = encoder.encode(texts.slice(k, n))
                ends = np.cumsum(sizes)
                ids = pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(flat, pa.int32()))
                columns = [batch.column(0).slice(k, n), pa.array(np.full(n, shard, np.int32)), pa.array(start + ends - sizes), pa.array(sizes.astype(np.int32)), ids]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "shard", "shard_start", "n_tokens", "ids"])
                start += int(ends[-1])

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str | None = None, end_id: int = END_ID, partitions: int | None = None) -> None:
    """Write the ids of all of docs (doc_id, text) to Parquet files at path."""
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path(TOKENIZER)
    spark = docs.sparkSession
    bounded_batches(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # the hash cuts the range of a doc_id that many rows have; Spark samples ranges from whole rows, so it costs no reading
    order = ["doc_id", F.xxhash64("text"), "text"]
    dealt = id_and_text(docs).repartitionByRange(n, *order[:2]).sortWithinPartitions(*order)
    writer = dealt.mapInArrow(_encode_batches(tokenizer_path, end_id), SCHEMA).write
    options = {"compression": "zstd", "parquet.block.size": GROUP_BYTES, "parquet.page.row.count.limit": PAGE_ROWS, "parquet.enable.dictionary": "true", "parquet.dictionary.page.size": 1 << 20}
    writer.options(**options).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The files at path with start: the ids of all documents before."""
    rows = spark.read.schema(SCHEMA).parquet(path)
    totals = checkpointed(rows.groupBy("shard").agg(F.sum("n_tokens").alias("total")))
    sizes = sorted(tuple(x) for x in totals.collect())  # a row for each file
    before, at = [], 0
    for shard, total in sizes:
        before.append((shard, at))
        at += total
    offsets = spark.createDataFrame(before, "shard_id int, shard_offset long")
    joined = rows.join(maybe_broadcast(offsets, len(before)), F.col("shard") == F.col("shard_id"), "left")
    return joined.select("doc_id", (F.col("shard_offset") + F.col("shard_start")).alias("start"), F.col("n_tokens").cast("long").alias("n_tokens"), "ids")


def _checksum_batches(batches):
    import pyarrow as pa

    for batch in batches:
        ids = batch.column(3)
        values, cuts = ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False), ids.offsets.to_numpy()
        sums = [zlib.crc32(values[a:b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
        counts = pa.array(np.diff(cuts).astype(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), counts, pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def token_digests(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 (of the ids as little-endian unsigned 32-bit integers) of read_tokens()."""
    bounded_batches(tokens.sparkSession)
    return tokens.mapInArrow(_checksum_batches, "doc_id long, start long, n_tokens long, ids_crc32 long")


def stored_tokens(docs: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Write docs' ids, then give their digests from the files read back."""
    spark = docs.sparkSession
    path = path or shared_path(spark, "tokens")
    write_tokens(docs, path, **options)
    return token_digests(read_tokens(spark, path))
