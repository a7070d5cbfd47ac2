"""Token ids in static rANS shards: shared frequency tables, independent interleaved blocks."""

from __future__ import annotations

import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from wirefold.llm.common import hold, query, store, table, text_batches

#: Ids of a block, lanes that a block's ids are dealt to in turn, bits that a shard's frequencies
#: add up to, blocks coded side by side, bytes of text per shard.
BLOCK, LANES, BITS, GROUP, SHARD_BYTES = 65_536, 64, 18, 128, 16_000_000
END_ID = 0
#: Entries of a worker's word table, which starts afresh beyond that.
TABLE = 1_200_000
_LOW = np.uint64(1 << 31)
_U32 = np.uint64(32)


# --- tokens --------------------------------------------------------------------------------------
def _byte_letters() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies: visible Latin-1
    characters for themselves, the others in order from U+0100."""
    seen = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = (b for b in range(256) if b not in seen)
    return {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Words(dict):
    """Ids of the words seen last, as bytes; ``lead`` is the blank before them, or nothing. None for
    what holds other white space, or nothing."""

    LETTERS, CLOSING = "\u024F", ".,;:!?"

    def __init__(self, tokenizer, lead: str):
        super().__init__()
        self.tokenizer, self.tokenize, self.lead = tokenizer, tokenizer.model.tokenize, lead
        self.letters = _byte_letters()
        self.blank = self.letters[32] if lead else ""

    def __missing__(self, word: str) -> bytes | None:
        core = word.rstrip(self.CLOSING)
        if core.isalpha() and (core.isascii() or max(core) <= self.LETTERS):
            if len(core) < len(word):  # the pattern splits closing marks off
                ids = self[core] + self._piece(word[len(core):])
            else:
                ids = self._piece(self.blank + (core if core.isascii() else core.encode().decode("latin-1").translate(self.letters)))
        elif word.split() == [word]:
            ids = array("I", self.tokenizer.encode(self.lead + word, add_special_tokens=False).ids).tobytes()
        else:
            ids = None
        self[word] = ids
        return ids

    def _piece(self, piece: str) -> bytes:
        return array("I", [t.id for t in self.tokenize(piece)]).tobytes()


class WordTokens:
    """Ids of whole texts from a byte-level BPE file of the tokenizers library.

    The file's splitting pattern never joins a white space to what stands before it, so a text
    whose white space is single blanks and line ends between words is coded word by word (with
    the blank before it) and a line end by itself; any other text goes to the library whole. Words
    are remembered. Of new ones, Latin letters with or without closing marks (which the pattern
    splits into just these two) go to the library's BPE model, all others through its whole encoder.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # an added token (like the end of text) that holds or takes in white space joins words
        self.by_word = not any(t.lstrip or t.rstrip or t.single_word or t.content.split() != [t.content]
                               for t in self.tokenizer.get_added_tokens_decoder().values())
        self.line_end = self._library("\n")
        self.first, self.other = _Words(self.tokenizer, ""), _Words(self.tokenizer, " ")

    def clear(self) -> None:
        self.first.clear()
        self.other.clear()

    def _library(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, texts: list[str]):
        """Little-endian unsigned 32-bit ids of each text."""
        for text in texts:
            if not self.by_word:
                yield self._library(text)
                continue
            if len(self.first) + len(self.other) > TABLE:
                self.clear()
            first, other, lines = self.first.__getitem__, self.other.__getitem__, []
            try:
                for line in text.split("\n"):
                    words = line.split(" ")
                    lines.append(first(words[0]) + b"".join(map(other, words[1:])))
                yield self.line_end.join(lines)
            except TypeError:  # a word without ids of its own
                yield self._library(text)


_tokens: dict[str, WordTokens] = {}


def word_tokens(path: str | None = None) -> WordTokens:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    if path not in _tokens:
        _tokens[path] = WordTokens(path)
    hold(path, _tokens[path].clear)
    return _tokens[path]


# --- coder ---------------------------------------------------------------------------------------
def frequencies(counts: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Positive integers in proportion to positive ``counts`` that add up to 2^bits."""
    total = 1 << bits
    if len(counts) > total:
        raise ValueError(f"{len(counts)} different ids do not fit a table of {bits} bits")
    freq = np.maximum(1, np.floor(counts * (total / counts.sum()))).astype(np.int64)
    order = np.argsort(-counts, kind="stable")
    while (over := int(freq.sum()) - total) > 0:  # small ones were lifted to 1: take it off the large ones
        take = np.minimum(freq[order] - 1, np.maximum(1, freq[order] * over // max(1, int(freq.sum()))))
        take[np.cumsum(take) > over] = 0
        if not take.any():
            take[0] = min(over, int(freq[order[0]]) - 1)
        freq[order] -= take
    freq[order[0]] += total - int(freq.sum())
    return freq


def _encode_group(symbols: np.ndarray, n_blocks: int, steps: int, freq, start, bits) -> tuple:
    """``symbols``: ``n_blocks * steps * LANES`` table positions. -> states and words per block."""
    s = symbols.reshape(n_blocks, steps, LANES).transpose(1, 0, 2).reshape(steps, n_blocks * LANES)
    f, c, shift = freq.astype(np.uint64), start.astype(np.uint64), np.uint64(bits)
    limit = f << np.uint64(31 - bits + 32)
    x = np.full(n_blocks * LANES, _LOW, np.uint64)
    words = np.empty((steps, len(x)), np.uint32)
    sent = np.empty((steps, len(x)), bool)
    for t in range(steps - 1, -1, -1):
        row = s[t]
        full = sent[t] = x >= limit[row]
        words[t] = x.astype(np.uint32)
        x = np.where(full, x >> _U32, x)
        q, r = np.divmod(x, f[row])
        x = (q << shift) + r + c[row]
    out = []
    for b in range(n_blocks):
        own = slice(b * LANES, (b + 1) * LANES)
        out.append((x[own].astype("<u8").tobytes(), words[:, own][sent[:, own]].astype("<u4").tobytes()))
    return out


def _decode_group(blocks: list, steps: int, freq, start, lookup, bits) -> np.ndarray:
    """The table positions of blocks with ``steps`` rounds each, block after block."""
    n = len(blocks)
    x = np.concatenate([np.frombuffer(b[0], "<u8") for b in blocks]).reshape(n, LANES).astype(np.uint64)
    parts = [np.frombuffer(b[1], "<u4") for b in blocks]
    stream = np.concatenate([*parts, np.zeros(LANES, np.uint32)]).astype(np.uint64)
    at = np.concatenate([[0], np.cumsum([len(p) for p in parts])[:-1]]).astype(np.int64)[:, None]
    f, c = freq.astype(np.uint64), start.astype(np.uint64)
    mask, shift = np.uint64((1 << bits) - 1), np.uint64(bits)
    out = np.empty((n, steps, LANES), np.int32)
    for t in range(steps):
        slot = x & mask
        s = out[:, t] = lookup[slot]
        x = f[s] * (x >> shift) + slot - c[s]
        need = x < _LOW
        place = np.cumsum(need, axis=1)
        x = np.where(need, x << _U32 | stream[np.minimum(at + place - need, len(stream) - 1)], x)
        at = at + place[:, -1:]
    return out.reshape(n, steps * LANES)


def encode_ids(ids: np.ndarray, bits: int = BITS) -> dict:
    """One shard of ids: the shared table, and blocks that can each be decoded alone. A block holds
    its number of ids, the lanes' first states (its checkpoint), the word stream that all lanes
    read from, and the CRC-32 of its ids as little-endian unsigned 32-bit integers."""
    if not len(ids):
        return {"symbols": b"", "freqs": b"", "blocks": []}
    counts = np.bincount(ids)
    symbols = np.flatnonzero(counts)
    rank = np.zeros(len(counts), np.int32)
    rank[symbols] = np.arange(len(symbols))
    counts, where = counts[symbols], rank[ids]
    freq = frequencies(counts, bits)
    start = np.cumsum(freq) - freq
    pad = int(np.argmax(freq))
    blocks, whole = [], len(ids) // BLOCK
    for a in range(0, whole, GROUP):
        b = min(whole, a + GROUP)
        blocks += _encode_group(where[a * BLOCK:b * BLOCK], b - a, BLOCK // LANES, freq, start, bits)
    if rest := len(ids) % BLOCK:
        steps = -(-rest // LANES)
        last = np.full(steps * LANES, pad, where.dtype)
        last[:rest] = where[whole * BLOCK:]
        blocks += _encode_group(last, 1, steps, freq, start, bits)
    raw = ids.astype("<u4")
    return {"symbols": symbols.astype("<u4").tobytes(), "freqs": freq.astype("<u4").tobytes(),
            "blocks": [{"n_ids": len(own := raw[i * BLOCK:(i + 1) * BLOCK]), "states": states, "words": words,
                        "crc32": zlib.crc32(own.tobytes())} for i, (states, words) in enumerate(blocks)]}


def decode_ids(shard: dict, bits: int = BITS, blocks: slice = slice(None)) -> np.ndarray:
    """The ids of a shard, or of some of its blocks; raises if a checksum differs."""
    wanted = shard["blocks"][blocks]
    if not wanted:
        return np.empty(0, "<u4")
    symbols = np.frombuffer(shard["symbols"], "<u4")
    freq = np.frombuffer(shard["freqs"], "<u4").astype(np.int64)
    start = np.cumsum(freq) - freq
    lookup = np.repeat(np.arange(len(freq), dtype=np.int32), freq)
    out = []
    for a in range(0, len(wanted), GROUP):
        group = wanted[a:a + GROUP]
        for own in ([b for b in group if b["n_ids"] == BLOCK], [b for b in group if b["n_ids"] < BLOCK]):
            if own:
                steps = -(-own[0]["n_ids"] // LANES)
                rows = _decode_group([(b["states"], b["words"]) for b in own], steps, freq, start, lookup, bits)
                out += [symbols[r[:b["n_ids"]]] for r, b in zip(rows, own)]
    for b, ids in zip(wanted, out):
        if zlib.crc32(ids.tobytes()) != b["crc32"]:
            raise ValueError("a block's checksum does not match its ids")
    return np.concatenate(out)


# --- Spark ---------------------------------------------------------------------------------------
SHARD = ("shard long, doc_ids array<long>, doc_tokens array<long>, symbols binary, freqs binary, "
         "blocks array<struct<n_ids:long,states:binary,words:binary,crc32:long>>")
_ARROW = pa.schema([
    ("shard", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int64())),
    ("symbols", pa.binary()), ("freqs", pa.binary()),
    ("blocks", pa.list_(pa.struct([("n_ids", pa.int64()), ("states", pa.binary()), ("words", pa.binary()),
                                   ("crc32", pa.int64())])))])


def _encoder(path, end_id):
    end = np.array([end_id], "<u4").tobytes()

    def encode(batches):
        tokens = word_tokens(path)
        shard, doc_ids, sizes, raw = None, [], [], bytearray()
        for batch in batches:
            if not batch.num_rows:
                continue
            shard = batch.column("shard")[0].as_py()
            doc_ids += batch.column("doc_id").to_pylist()
            for ids in tokens.encode(batch.column("text").to_pylist()):
                raw += ids
                raw += end
                sizes.append(len(ids) // 4 + 1)
        if sizes:
            row = {"shard": shard, "doc_ids": doc_ids, "doc_tokens": sizes,
                   **encode_ids(np.frombuffer(raw, "<u4"))}
            yield pa.RecordBatch.from_pylist([row], schema=_ARROW)

    return encode


def write_shards(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """``docs(doc_id, text)`` -> the stored shard files, one row per shard in the columns ``SHARD``.

    Documents go in ascending ``doc_id`` order (null first; ties in the order of the input) to shards of about
    ``SHARD_BYTES`` of text, which are numbered in that order; each document's ids are followed by
    ``end_id``. One range shuffle of the texts; every task tokenises and codes its own shard with
    a frequency table that all of the shard's blocks share. A null text is empty and so holds the
    end id alone. Repeated rows are coded as often as they come; an empty table gives no shard.
    """
    text = F.coalesce("text", F.lit(""))
    total = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("n")).first().n
    n = max(1, -(-total // SHARD_BYTES))
    order = ["doc_id", "place"]  # the place in the input spreads the rows of a repeated id
    rows = (text_batches(docs).select(F.col("doc_id").cast("long"), text.alias("text"),
                                      F.monotonically_increasing_id().alias("place"))
            .repartitionByRange(n, *order).sortWithinPartitions(*order)
            .select(F.spark_partition_id().cast("long").alias("shard"), "doc_id", "text"))
    return store(rows.mapInArrow(_encoder(tokenizer, end_id), SHARD))


def _read(batches):
    for batch in batches:
        for row in batch.to_pylist():
            ids = decode_ids(row)
            ends = np.cumsum(row["doc_tokens"])
            raw = memoryview(ids.tobytes())
            crcs = [zlib.crc32(raw[4 * (e - n):4 * e]) for e, n in zip(ends.tolist(), row["doc_tokens"])]
            sizes = pa.array(row["doc_tokens"], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["shard"]] * len(crcs), pa.int64()), pa.array(row["doc_ids"], pa.int64()),
                 pa.array(ends - np.array(row["doc_tokens"]), pa.int64()), sizes, pa.array(crcs, pa.int64())],
                names=["shard", "doc_id", "at", "n_tokens", "ids_crc32"])


def read_shards(shards: DataFrame) -> DataFrame:
    """Decode shard files: per document ``doc_id, start`` (ids before it in all shards),
    ``n_tokens, ids_crc32``. Checksums of all blocks are verified on the way."""
    docs = shards.mapInArrow(_read, "shard long, doc_id long, at long, n_tokens long, ids_crc32 long")
    sizes = shards.select("shard", F.aggregate("doc_tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)  # one row per shard
    sizes = sizes.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_start"))
    return (docs.join(sizes, "shard")
            .select("doc_id", (F.col("shard_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"))


@query("op2_rans")
def op2_rans(spark, sf_dir):
    return read_shards(write_shards(table(spark, sf_dir, "documents")))
