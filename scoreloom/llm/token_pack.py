"""Token ids of documents in blocks of Re-Pair grammars.

A block holds the ids of whole documents in ascending doc_id order. Frequent id pairs are replaced, round by
round, by nonterminals; the block keeps the remaining symbols, the rules, and how many ids each rule expands
to, so that any range of ids is decoded from the symbols that cover it alone. No rule crosses the end of a document.

File format: Parquet, one row per block.

=============== ===========================================================================
shard, block    place in the order of writing; blocks in order of (first_doc, shard, block)
first_doc       smallest doc_id of the block
n_ids           ids in the block
doc_ids         array of the block's documents, in order
doc_lens        array: ids of each document, end id included
alphabet        binary, little-endian uint32: the ids that occur, by symbol
rules           binary, little-endian uint32 pairs: the two symbols of each nonterminal; the first
                nonterminal is the symbol after the alphabet
rule_lens       binary, little-endian uint32: ids that each nonterminal expands to
wide            whether symbols take 4 bytes instead of 2
symbols         binary, little-endian: what is left of the ids
=============== ===========================================================================
"""

from __future__ import annotations

import os
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scoreloom.llm.tables import shared_folder
from scoreloom.llm.textwords import hash_runs, text_batches

END_ID = 2
BLOCK_IDS = 1 << 20
# A pair becomes a rule from this count on; rules of one round.
LEAST_COUNT, ROUND_RULES = 8, 4096
# Words whose ids a worker remembers.
CACHE_WORDS = 600_000

SCHEMA = (
    "shard int, block int, first_doc long, n_ids long, doc_ids array<long>, doc_lens array<long>, "
    "alphabet binary, rules binary, rule_lens binary, wide boolean, symbols binary"
)

# ASCII capitals are folded and the three other separators become spaces.
_PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t\n\r", b"abcdefghijklmnopqrstuvwxyz   ")
_SPACES = bytes.maketrans(b"\t\n\r", b"   ")
_PIECE = 1 << 21
_MARKS = b"!\"#$%&()*+,-./:;<=>?@[]^_`{|}~"
# Byte-level vocabularies name a byte by its Latin-1 character if that is visible, else by the next free one from 256 on.
_VISIBLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTE_NAMES = {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in _VISIBLE)}
_TOKENIZERS: dict[str, "WordEncoder"] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Ids of whole texts for a tokenizer that folds case and drops white space, so that a text's ids are those of its
    words in turn.

    Words are cut at space, tab and line ends only; whatever else is white space to the tokenizer stays inside a word
    and is left to it. ASCII capitals are folded beforehand, except in texts that could hold a special token. The
    marks after the last letter of a word are a piece of their own. A piece of text is cut into words, and
    equal words are found, by 64-bit hashes in numpy; the tokenizer gets each word once. Ids of words are
    remembered in two generations, so that frequent words stay known while memory is bounded.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.young: dict[int, bytes] = {}
        self.old: dict[int, bytes] = {}
        self.marks: dict[bytes, bytes] = {}

    def _ids(self, words: list[bytes]) -> list[bytes]:
        """Ids of single words, as bytes."""
        tokenize, out, batch = self.tokenizer.model.tokenize, [], []
        for k, w in enumerate(words):
            stem = w.rstrip(_MARKS)
            if len(stem) < len(w) and not stem.decode().isalpha():
                stem = w
            # A word of Latin letters is one piece; the normalizer only makes it small, and the pre-tokenizer renames its bytes.
            if stem.isalpha() and stem.islower():
                ids = array("I", [t.id for t in tokenize(stem.decode())]).tobytes()
            elif (text := stem.decode()).isalpha() and max(text) < "\u0250" and "\u0130" not in text:
                ids = array("I", [t.id for t in tokenize(text.lower().encode().decode("latin-1").translate(_BYTE_NAMES))]).tobytes()
            else:
                batch.append(k)
                out.append(b"")
                continue
            if len(stem) < len(w):
                tail = w[len(stem) :]
                if tail not in self.marks:
                    if len(self.marks) > 50_000:
                        self.marks = {}
                    self.marks[tail] = array("I", self.tokenizer.encode(tail.decode(), add_special_tokens=False).ids).tobytes()
                ids += self.marks[tail]
            out.append(ids)
        if batch:
            for k, e in zip(batch, self.tokenizer.encode_batch_fast([words[k].decode() for k in batch], add_special_tokens=False)):
                out[k] = array("I", e.ids).tobytes()
        return out

    def _known(self, keys: np.ndarray, raw: bytes, first: np.ndarray, length: np.ndarray) -> list[bytes]:
        """Ids of distinct words, given by hash and place."""
        if len(self.young) + len(keys) > CACHE_WORDS // 2:
            self.old, self.young = self.young, {}
        young, old, names = self.young, self.old, keys.tolist()
        found = list(map(young.get, names))
        missing = []
        for k, f in enumerate(found):
            if f is None:
                f = old.get(names[k])
                if f is None:
                    missing.append(k)
                else:
                    young[names[k]] = found[k] = f
        spans = zip(first[missing].tolist(), length[missing].tolist())
        for k, ids in zip(missing, self._ids([raw[a : a + n] for a, n in spans])):
            young[names[k]] = found[k] = ids
        return found

    def _piece(self, raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First byte and number of ids of every word, and all ids."""
        view = np.frombuffer(raw, dtype=np.uint8)
        hashes, first, length = hash_runs(view, view != 32)
        order = np.argsort(hashes)
        ordered = hashes[order]
        new = np.ones(len(ordered), dtype=bool)
        new[1:] = ordered[1:] != ordered[:-1]
        which = np.empty(len(ordered), dtype=np.int32)
        which[order] = np.cumsum(new, dtype=np.int32) - 1
        place = order[new]  # one place of each distinct word
        found = self._known(ordered[new], raw, first[place], length[place])
        flat = np.frombuffer(b"".join(found), dtype="<u4")
        size = np.fromiter(map(len, found), np.int32, len(found)) // 4
        begin, own = (np.cumsum(size, dtype=np.int32) - size)[which], size[which]
        shift = np.repeat(begin - (np.cumsum(own, dtype=np.int32) - own), own)
        shift += np.arange(len(shift), dtype=np.int32)
        return first, own, flat[shift]

    def encode(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and how many each text has."""
        plain = [(t or b"").translate(_SPACES if b"<|" in (t or b"") else _PLAIN) for t in texts]
        raw = b" ".join(plain) + b" "
        ends = np.cumsum([len(t) + 1 for t in plain]) if plain else np.empty(0, np.int64)
        firsts, owns, ids, low = [], [], [], 0
        while low < len(raw):
            high = raw.rfind(b" ", low, low + _PIECE) + 1 if low + _PIECE < len(raw) else len(raw)
            if high <= low:  # one word longer than a piece
                high = raw.index(b" ", low) + 1
            first, own, some = self._piece(raw[low:high])
            firsts.append(first + low)
            owns.append(own)
            ids.append(some)
            low = high
        upto = np.concatenate(([0], np.cumsum(np.concatenate(owns))))
        lens = np.diff(upto[np.searchsorted(np.concatenate(firsts), ends)], prepend=0)
        return np.concatenate(ids), lens


def encoder(path: str) -> WordEncoder:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordEncoder(path)
    return _TOKENIZERS[path]


def compress(ids: np.ndarray, lens: np.ndarray, least: int = LEAST_COUNT) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Re-Pair of the ids of consecutive documents: (alphabet, rules, rule_lens, symbols).

    A round counts all pairs of neighbouring symbols inside documents and makes rules of the most frequent ones; where
    chosen pairs overlap, the more frequent one is replaced, and every other one in a run of one symbol. Rounds go on
    until no pair occurs ``least`` times. Symbols take four bytes only when two bytes leave no room for a round's rules.
    """
    alphabet = np.flatnonzero(np.bincount(ids)) if len(ids) else np.empty(0, np.int64)
    symbol_of = np.zeros(int(alphabet[-1]) + 1 if len(alphabet) else 0, dtype=np.uint32)
    symbol_of[alphabet] = np.arange(len(alphabet), dtype=np.uint32)
    wide = False
    seq = symbol_of[ids]
    last = np.zeros(len(seq), dtype=bool)
    last[np.cumsum(lens)[np.asarray(lens) > 0] - 1] = True
    size = np.ones(len(alphabet), dtype=np.int64)
    left: list[np.ndarray] = []
    right: list[np.ndarray] = []
    made = 0
    while len(seq) > 1:
        if not wide:
            wide = len(alphabet) + made + ROUND_RULES > 1 << 16
            code_type, shift, spread, high = (np.uint64, 32, 0x9E3779B97F4A7C15, 48) if wide else (np.uint32, 16, 0x9E3779B1, 16)
            seq = seq.astype(code_type, copy=False)
        code = (seq[:-1] << code_type(shift)) | seq[1:]
        inner = ~last[:-1]
        ordered = np.sort(code[inner])
        if not len(ordered):
            break
        head = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        count = np.diff(np.append(head, len(ordered)))
        often = np.flatnonzero(count >= least)
        if not len(often):
            break
        pair, count = ordered[head[often]], count[often]
        best = np.lexsort((pair, -count))[:ROUND_RULES]  # most frequent first
        pair = pair[best]
        # A direct-address table finds the rank of a pair; of pairs that share a slot the first keeps it.
        slots = 1 << 16
        slot = (pair * code_type(spread)) >> code_type(high)
        _, keeps = np.unique(slot, return_index=True)
        pair, slot = pair[np.sort(keeps)], slot[np.sort(keeps)]
        rank_at = np.full(slots, len(pair), dtype=np.int32)
        rank_at[slot] = np.arange(len(pair), dtype=np.int32)
        pairs = np.append(pair, code_type(0))
        rank = rank_at[(code * code_type(spread)) >> code_type(high)]
        none = len(pair)
        there = np.flatnonzero((rank < none) & (pairs[rank] == code) & inner)
        rank = rank[there]
        beside = there[1:] == there[:-1] + 1
        run_start = np.concatenate(([True], ~(beside & (rank[:-1] == rank[1:]))))
        chosen = (np.arange(len(there)) - np.flatnonzero(run_start)[np.cumsum(run_start) - 1]) % 2 == 0
        chosen[1:] &= ~(beside & (rank[:-1] < rank[1:]))
        chosen[:-1] &= ~(beside & (rank[1:] < rank[:-1]))
        take, rank = there[chosen], rank[chosen]
        used = np.flatnonzero(np.bincount(rank, minlength=none))
        number = np.zeros(none, dtype=code_type)
        number[used] = len(alphabet) + made + np.arange(len(used))
        l, r = (pair[used] >> code_type(shift)).astype(np.int64), (pair[used] & code_type((1 << shift) - 1)).astype(np.int64)
        left.append(l)
        right.append(r)
        size = np.concatenate((size, size[l] + size[r]))
        made += len(used)
        seq[take] = number[rank]
        last[take] |= last[take + 1]
        stay = np.ones(len(seq), dtype=bool)
        stay[take + 1] = False
        seq, last = seq[stay], last[stay]
    rules = np.stack([np.concatenate(left), np.concatenate(right)], axis=1) if left else np.empty((0, 2), np.int64)
    return alphabet, rules, size[len(alphabet) :], seq.astype(np.uint64 if wide else np.uint32, copy=False)


def _flat(base: int, rules: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """Symbols with all nonterminals replaced, level by level."""
    seq = symbols.astype(np.int64)
    while (deep := seq >= base).any():
        place = np.cumsum(1 + deep) - 1 - deep  # where each symbol, or its first half, goes
        out = np.empty(len(seq) + int(deep.sum()), dtype=np.int64)
        rule = rules[seq[deep] - base]
        out[place[~deep]] = seq[~deep]
        out[place[deep]], out[place[deep] + 1] = rule[:, 0], rule[:, 1]
        seq = out
    return seq


def expand(alphabet: np.ndarray, rules: np.ndarray, sizes: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """The ids that symbols stand for; ``sizes``: expansion length of every symbol, the alphabet's included.

    Every rule is expanded once, one after the other, and the symbols are copied from there.
    """
    table = np.concatenate((alphabet, alphabet[_flat(len(alphabet), rules, np.arange(len(rules)) + len(alphabet))])).astype("<u4")
    begin = np.cumsum(sizes) - sizes
    own = sizes[symbols]
    shift = np.repeat((begin[symbols] - (np.cumsum(own) - own)).astype(np.int32), own)
    shift += np.arange(len(shift), dtype=np.int32)
    return table[shift]


class Block:
    """One row of the file, opened for reading."""

    def __init__(self, alphabet: bytes, rules: bytes, rule_lens: bytes, wide: bool, symbols: bytes):
        self.alphabet = np.frombuffer(alphabet, dtype="<u4")
        self.rules = np.frombuffer(rules, dtype="<u4").astype(np.int64).reshape(-1, 2)
        self.sizes = np.concatenate((np.ones(len(self.alphabet), np.int64), np.frombuffer(rule_lens, dtype="<u4").astype(np.int64)))
        self.symbols = np.frombuffer(symbols, dtype="<u4" if wide else "<u2")

    def ids(self) -> np.ndarray:
        return expand(self.alphabet, self.rules, self.sizes, self.symbols)

    def read(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` of the block, expanding only the symbols that cover them."""
        ends = np.cumsum(self.sizes[self.symbols])
        a, b = np.searchsorted(ends, start, side="right"), np.searchsorted(ends, stop, side="left") + 1
        first = int(ends[a - 1]) if a else 0
        return expand(self.alphabet, self.rules, self.sizes, self.symbols[a:b])[start - first : stop - first]


def _pack(tokenizer: str, end_id: int, block_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        shard, number = TaskContext.get().partitionId(), 0

        def block(ids: np.ndarray, docs: list[int | None], lens: np.ndarray) -> pa.RecordBatch:
            nonlocal number
            alphabet, rules, sizes, symbols = compress(ids, lens)
            wide = symbols.dtype == np.uint64
            row = [shard, number, docs[0], len(ids), docs, lens, alphabet.astype("<u4").tobytes(), rules.astype("<u4").tobytes(),
                   sizes.astype("<u4").tobytes(), wide, symbols.astype("<u4" if wide else "<u2").tobytes()]
            number += 1
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary(), pa.bool_(), pa.binary()]
            names = ["shard", "block", "first_doc", "n_ids", "doc_ids", "doc_lens", "alphabet", "rules", "rule_lens", "wide", "symbols"]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names)

        docs: list[int | None] = []
        parts, sizes, held = [], [], 0
        for batch in batches:
            for low, high, texts in text_batches(batch, "text"):
                docs += batch.column("doc_id").slice(low, high - low).to_pylist()
                ids, lens = encode(texts)
                parts.append(np.insert(ids, np.cumsum(lens), end_id))
                sizes.append(lens + 1)
                held += len(parts[-1])
                if held < block_ids:
                    continue
                ids, lens = np.concatenate(parts), np.concatenate(sizes)
                ends = np.cumsum(lens)
                done = at = 0
                while held - at >= block_ids:  # a block closes with the document that fills it
                    stop = int(np.searchsorted(ends, at + block_ids)) + 1
                    yield block(ids[at : ends[stop - 1]], docs[done:stop], lens[done:stop])
                    done, at = stop, int(ends[stop - 1])
                docs, parts, sizes, held = docs[done:], [ids[at:]], [lens[done:]], held - at
        if docs:
            yield block(np.concatenate(parts), docs, np.concatenate(sizes))

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> None:
    """Write the ids of ``docs`` (doc_id, text) to ``path`` in ascending doc_id order (nulls first).

    A null or empty text has the end id alone. Rows of one doc_id follow each other in order of their
    texts' hash, and such a run may span shards. A block closes with the document that fills it. An empty table
    writes no block.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("text")]
    (
        texts.repartitionByRange(*order[:2]).sortWithinPartitions(*order)
        .mapInArrow(_pack(tokenizer or default_tokenizer(), end_id, block_ids), SCHEMA).write.parquet(path)
    )


def block_starts(blocks: DataFrame) -> DataFrame:
    """(shard, block, start): ids before each block. Reads one small row per block, never their contents."""
    order = Window.orderBy(F.col("first_doc").asc_nulls_first(), "shard", "block")
    return blocks.select("first_doc", "shard", "block", "n_ids").select(
        "shard", "block", (F.sum("n_ids").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_ids")).alias("start"))


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            get = {n: batch.column(n)[row].as_py() for n in batch.schema.names}
            ids = Block(get["alphabet"], get["rules"], get["rule_lens"], get["wide"], get["symbols"]).ids()
            ends = np.cumsum(get["doc_lens"])
            starts = ends - get["doc_lens"]
            raw = memoryview(ids.tobytes())
            sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
            n = len(ends)
            yield pa.RecordBatch.from_arrays(
                [pa.array([get["shard"]] * n, pa.int32()), pa.array([get["block"]] * n, pa.int32()), pa.array(get["doc_ids"], pa.int64()),
                 pa.array(starts, pa.int64()), pa.array(get["doc_lens"], pa.int64()), pa.array(sums, pa.int64())],
                ["shard", "block", "doc_id", "inside", "n_tokens", "ids_crc32"],
            )


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the files."""
    blocks = spark.read.schema(SCHEMA).parquet(path)
    found = blocks.drop("first_doc", "n_ids").mapInArrow(_unpack, "shard int, block int, doc_id long, inside long, n_tokens long, ids_crc32 long")
    return found.join(block_starts(blocks), ["shard", "block"]).select(
        "doc_id", (F.col("start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def written_and_read(docs: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Write the documents' ids (to a new folder of the shared one, unless a path is given) and read them back."""
    spark = docs.sparkSession
    path = path or f"{shared_folder(spark)}/token-blocks-{uuid.uuid4().hex}"
    write_tokens(docs, path, **options)
    return read_digests(spark, path)
