"""Token ids in binary shards compressed by Re-Pair.

Documents are dealt to shards by ranges of doc_id. In a shard, the most frequent pairs of ids are replaced by nonterminals, again
and again, until no pair is left that is frequent: each round counts adjacent pairs, gives nonterminals to the most frequent and
replaces them from left to right.
No pair reaches over the end of a document, so a document's symbols can be decoded alone, and the stored expansion lengths give
the place of any id without decoding those before it.

A shard, little-endian: magic, nine unsigned 64-bit counts (partition, number in it, documents, ids, symbols, rules, first
nonterminal, symbol bits, doc_id missing flag), then rules (two u32 each), expansion lengths (u32), doc_ids (i64), one byte per
document for a null doc_id, symbol offsets (u64, one more than documents), the low 16 bits of the symbols (u16), and for each bit above them the bits of all symbols.

Defined results: a null or empty text is the end id alone. Documents without a doc_id come first. Rows that repeat a doc_id are
documents of their own, one after the other. A document longer than a shard is a shard of its own. An empty table gives no
shards and an empty result."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from redsieve.llm.blobs import read_blobs, write_blobs
from redsieve.llm.common import saved, shared_path, text_of
from redsieve.llm.ids import WORDS_SLICE, encoder, slices

MAGIC = b"REPAIR01"
_HEAD = struct.Struct("<8s9Q")

#: Ids of a shard, about.
SHARD_IDS = 1 << 21
#: The least count of a pair that gets a nonterminal: a rule and its length take twelve bytes, each place that it shortens saves two.
LEAST = 7
#: Nonterminals of a round, and bits of the places of its table of pairs.
MOST_NEW, SLOTS = 12_000, 19
#: Ids of the vocabulary: nonterminals come after them.
VOCABULARY = 49408


def _counted(keys: np.ndarray, nothing: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys but ``nothing``, which is the largest, and how often each occurs."""
    s = np.sort(keys)
    s = s[: np.searchsorted(s, nothing)]
    starts = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, dtype=np.int64)
    return s[starts], np.diff(starts, append=len(s))


def _every_second(at: np.ndarray) -> np.ndarray:
    """Which of ascending places stay, if a place next to one that stays goes."""
    new = np.diff(at, prepend=-2) != 1
    start = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
    return (np.arange(len(at)) - start) % 2 == 0


def _found(keys: np.ndarray, chosen: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """Places of the ``chosen`` among ``keys``, which of them stands there, and whether all were sought. Each has a slot of a table;
    of those that would share one, only the last is sought."""
    kind = keys.dtype.type
    slots = lambda k: (k * kind(0x9E3779B1 + 2 * salt)) >> kind(8 * keys.itemsize - SLOTS)
    owner, held = np.full(1 << SLOTS, -1, dtype=np.int32), np.full(1 << SLOTS, np.iinfo(keys.dtype).max, dtype=keys.dtype)
    own = slots(chosen)
    owner[own], held[own] = np.arange(len(chosen)), chosen
    at = slots(keys)
    places = np.flatnonzero(held[at] == keys)
    which = owner[at[places]]
    sought = int((owner[own] == np.arange(len(chosen))).sum()) == len(chosen)
    real = which >= 0  # an empty slot holds the key of nothing
    return places[real], which[real], sought


def compress(ids: np.ndarray, ends: np.ndarray, first: int = VOCABULARY, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """symbols, offsets of the documents in them, rules. ends: the place after each document's last id.

    Within, the ids that occur are numbered one after the other and nonterminals follow, so that most shards' pairs are numbers of
    four bytes. Rounds take the pairs of a count over a bar, which falls to a sixteenth each time; a rule that is replaced less than
    ``least`` times, as its places are taken by others, is left out of its round, until only such are left. Once every frequent pair has been replaced, only pairs
    with a symbol of the last round can be frequent, and only those are counted."""
    used = np.flatnonzero(np.bincount(ids, minlength=1)).astype(np.uint32)
    number = np.zeros(int(used[-1]) + 1 if len(used) else 1, dtype=np.uint32)
    number[used] = np.arange(len(used))
    base = len(used)
    s, ends, rules, n_rules = number[ids], np.asarray(ends, dtype=np.int64), [], 0
    bar, settled, new = None, False, base  # new: the first symbol of the last round
    salt = low = 0  # low: rounds under the last bar
    while True:
        wide = base + n_rules + min(len(s), MOST_NEW) >= 1 << 16
        kind, shift = (np.uint64, 32) if wide else (np.uint32, 16)
        s, nothing, salt = s.astype(kind, copy=False), np.iinfo(kind).max, salt + 1
        if settled:
            at = np.flatnonzero(s >= new)
            at = np.unique(np.concatenate([at - 1, at]))
            at = at[(at >= 0) & (at < len(s) - 1)]
            keys = (s[at] << kind(shift)) | s[at + 1]
            inside = np.searchsorted(ends, at + 1)
            keys[ends[np.minimum(inside, len(ends) - 1)] == at + 1] = nothing
        else:
            at = None
            keys = (s[:-1] << kind(shift)) | s[1:]
            keys[ends[:-1] - 1] = nothing
        found, n = _counted(keys, nothing)
        if bar is None:
            bar = max(least, int(n.max(initial=0)) // 16)
        while bar > least and not (n >= bar).any():
            bar = max(least, bar // 16)
        chosen, count = found[n >= bar], n[n >= bar]
        complete = bar == least and len(chosen) <= MOST_NEW
        if len(chosen) > MOST_NEW:
            chosen = np.sort(chosen[np.argsort(-count, kind="stable")[:MOST_NEW]])
        if not len(chosen):
            break
        places, which, sought = _found(keys, chosen, salt)
        places = places if at is None else at[places]
        keep = _every_second(places)
        places, which = places[keep], which[keep]
        low += bar == least
        often = np.bincount(which, minlength=len(chosen)) >= (least if low < 2 else 1)
        if not often.any():
            often[:] = np.bincount(which, minlength=len(chosen)) > 0
        renumbered = np.cumsum(often) - 1
        keep = often[which]
        places, which = places[keep], renumbered[which[keep]]
        settled = complete and sought and (low > 1 or bool(often.all()))  # a pair of which no place is left is gone
        new = base + n_rules
        s[places] = which.astype(kind) + kind(new)
        stay = np.ones(len(s), dtype=bool)
        stay[places + 1] = False
        s, ends = s[stay], ends - np.searchsorted(places, ends)
        chosen = chosen[often]
        rules.append(np.stack([chosen >> kind(shift), chosen & kind((1 << shift) - 1)], axis=1).astype(np.uint32))
        n_rules += len(chosen)
        bar = max(least, bar // 16)
    back = np.concatenate([used, first + np.arange(n_rules, dtype=np.uint32)]).astype(np.uint32)
    offsets = np.concatenate([[0], ends]).astype(np.uint64)
    return back[s], offsets, back[np.concatenate(rules)] if rules else np.zeros((0, 2), dtype=np.uint32)


def _lengths(rules: np.ndarray, first: int) -> np.ndarray:
    """Ids that each rule stands for; a rule's parts come before it."""
    out: list[int] = []
    for a, b in rules.tolist():
        out.append((out[a - first] if a >= first else 1) + (out[b - first] if b >= first else 1))
    return np.array(out, dtype=np.uint32)


def to_bytes(partition: int, number: int, doc_ids: list[int | None], ids: np.ndarray, ends: np.ndarray, first: int = VOCABULARY) -> bytes:
    symbols, offsets, rules = compress(ids, ends, first)
    width = max(16, (first + len(rules) - 1).bit_length())
    missing = np.array([d is None for d in doc_ids], dtype=np.uint8)
    head = _HEAD.pack(MAGIC, partition, number, len(doc_ids), len(ids), len(symbols), len(rules), first, width, int(missing.any()))
    parts = (rules.astype("<u4"), _lengths(rules, first).astype("<u4"), np.array([d or 0 for d in doc_ids], dtype="<i8"), missing, offsets.astype("<u8"), (symbols & symbols.dtype.type(0xFFFF)).astype("<u2"))
    parts += tuple(np.packbits((symbols >> symbols.dtype.type(k) & symbols.dtype.type(1)).astype(bool)) for k in range(16, width))
    return head + b"".join(p.tobytes() for p in parts)


@dataclass
class Shard:
    """What a file holds; document() and ids_at() decode only what they are asked for."""

    partition: int
    number: int
    doc_ids: list[int | None]
    n_ids: int
    first: int
    rules: np.ndarray
    lengths: np.ndarray
    offsets: np.ndarray
    symbols: np.ndarray

    def __post_init__(self) -> None:
        self._at = np.concatenate([[0], np.cumsum(self.lengths, dtype=np.int64)])
        whole: list[bytes] = []  # the ids of each rule
        part = lambda x: whole[x - self.first] if x >= self.first else x.to_bytes(4, "little")
        for a, b in self.rules.tolist():
            whole.append(part(a) + part(b))
        self._flat = np.frombuffer(b"".join(whole), dtype="<u4")

    def counts(self, symbols: np.ndarray) -> np.ndarray:
        """Ids that each symbol stands for."""
        out = np.ones(len(symbols), dtype=np.int64)
        rule = symbols >= self.first
        out[rule] = self.lengths[symbols[rule].astype(np.int64) - self.first]
        return out

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        n = self.counts(symbols)
        stop = np.cumsum(n)
        out = np.empty(int(stop[-1]) if len(stop) else 0, dtype="<u4")
        rule = symbols >= self.first
        out[(stop - 1)[~rule]] = symbols[~rule]
        which = symbols[rule].astype(np.int64) - self.first
        many, begin = n[rule], (stop - n)[rule]
        if len(which):
            inside = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
            out[np.repeat(begin, many) + inside] = self._flat[np.repeat(self._at[which], many) + inside]
        return out

    def document(self, k: int) -> np.ndarray:
        return self.expand(self.symbols[int(self.offsets[k]) : int(self.offsets[k + 1])])

    def ids_at(self, k: int, start: int, stop: int) -> np.ndarray:
        """Ids start to stop of document ``k``, of which only the symbols that reach into them are expanded."""
        symbols = self.symbols[int(self.offsets[k]) : int(self.offsets[k + 1])]
        upto = np.cumsum(self.counts(symbols))
        a, b = int(np.searchsorted(upto, start, side="right")), int(np.searchsorted(upto, stop, side="left")) + 1
        skipped = int(upto[a - 1]) if a else 0
        return self.expand(symbols[a:b])[start - skipped : stop - skipped]

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        everything = self.expand(self.symbols)
        upto = np.concatenate([[0], np.cumsum(self.counts(self.symbols))])
        at = upto[self.offsets.astype(np.int64)].tolist()
        for k, doc_id in enumerate(self.doc_ids):
            yield doc_id, everything[at[k] : at[k + 1]]


def from_bytes(data: bytes) -> Shard:
    magic, partition, number, n_docs, n_ids, n_symbols, n_rules, first, width, _ = _HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a shard")
    at = _HEAD.size

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(data, dtype=kind, count=n, offset=at)
        at += out.nbytes
        return out

    rules, lengths = take("<u4", 2 * n_rules).reshape(-1, 2), take("<u4", n_rules)
    doc_ids, missing = take("<i8", n_docs).tolist(), take("u1", n_docs)
    for k in np.flatnonzero(missing).tolist():
        doc_ids[k] = None
    offsets, symbols = take("<u8", n_docs + 1), take("<u2", n_symbols)
    for k in range(16, width):
        symbols = symbols.astype("<u4") | np.unpackbits(take("u1", (n_symbols + 7) // 8), count=n_symbols).astype("<u4") << np.uint32(k)
    return Shard(partition, number, doc_ids, n_ids, first, rules, lengths, offsets, symbols)


def write_shards(docs: DataFrame, path: str, vocabulary: str = "word_bpe_49k.json", end_id: int = 1, shard_ids: int = SHARD_IDS) -> None:
    """The ids of every text and the end id, in shards by ascending doc_id."""

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        partition, number = TaskContext.get().partitionId(), 0
        of = encoder(vocabulary)
        held: list[np.ndarray] = []
        doc_ids: list[int | None] = []
        lengths: list[np.ndarray] = []
        size = 0

        def full() -> pa.RecordBatch:
            blob = to_bytes(partition, number, doc_ids, np.concatenate(held), np.cumsum(np.concatenate(lengths)))
            return pa.RecordBatch.from_arrays([pa.array([blob], pa.binary())], ["shard"])

        for batch in batches:
            for part in slices(batch, WORDS_SLICE):
                ids, ends = of.encode_all(part["_t"], end_id)
                own = part["doc_id"].to_pylist()
                begin = 0
                while begin < len(own):
                    done = int(ends[begin - 1]) if begin else 0
                    stop = min(len(own), int(np.searchsorted(ends, done + shard_ids - size)) + 1)
                    held.append(ids[done : int(ends[stop - 1])])
                    lengths.append(np.diff(ends[begin:stop], prepend=done))
                    doc_ids += own[begin:stop]
                    size += len(held[-1])
                    begin = stop
                    if size >= shard_ids:
                        yield full()
                        held, doc_ids, lengths, size, number = [], [], [], 0, number + 1
        if held:
            yield full()

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("_t"))
    n = max(texts.rdd.getNumPartitions(), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = texts.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id")
    write_blobs(ordered.mapInArrow(shards, "shard binary"), "shard", path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files under ``path``."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "partition", "number", "_start", "n_tokens", "ids_crc32"]
        kinds = [pa.int64()] * 6
        for batch in batches:
            for k in range(batch.num_rows):
                shard = from_bytes(batch["content"][k].as_buffer().to_pybytes())
                rows, start = [], 0
                for doc_id, ids in shard.documents():
                    rows.append((doc_id, shard.partition, shard.number, start, len(ids), zlib.crc32(ids.tobytes())))
                    start += len(ids)
                if start != shard.n_ids:
                    raise ValueError(f"shard {shard.partition}, {shard.number}: {start} ids, its header has {shard.n_ids}")
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    rows = saved(read_blobs(spark, path).mapInArrow(decode, "doc_id long, partition long, number long, _start long, n_tokens long, ids_crc32 long"), "decoded")
    sizes = rows.groupBy("partition", "number").agg(F.sum("n_tokens").alias("_n"))  # a row per shard
    before = F.sum("_n").over(Window.orderBy("partition", "number").rowsBetween(Window.unboundedPreceding, -1))
    offsets = saved(sizes.select("partition", "number", F.coalesce(before, F.lit(0)).alias("_before")), "offsets")
    return rows.join(offsets, ["partition", "number"]).select("doc_id", (F.col("_before") + F.col("_start")).alias("start"), "n_tokens", "ids_crc32", "partition", "number")


def token_shards(docs: DataFrame, **parameters) -> DataFrame:
    """Writes the shards of ``docs`` in the shared folder and reads them back."""
    path = shared_path(docs.sparkSession, "shards")
    write_shards(docs, path, **parameters)
    return read_shards(docs.sparkSession, path)
