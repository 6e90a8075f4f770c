"""Byte-level BPE encoding and decoding through one global shuffle of distinct words.

Texts are packed into chunks of about 2 MB and cut into pre-tokens. A chunk keeps the sequence of its pre-tokens as
positions in its own list of distinct words, and sends that list, split by word hash, to the places of the words. Every
word is encoded once where it lands, for all chunks, and the ids return to the chunks, where they are put together
by position. A word travels once per chunk, never once per occurrence, so frequent words make no hot task. A task holds
the distinct words of its places, so the number of places is to grow with the vocabulary of the corpus. Decoding
joins ids with the table of token bytes; it has one row per rank (50,256, a fixed bound), so that join is made where
the ids lie.

The vocabulary is read on the driver and sent to the tasks. Chunks are cut in scan order, which a retry repeats; the
sequences are cut out a second time rather than stored, as that costs less disk than it saves time. A chunk's name
holds a digest of its ids and texts: an input that two scans order differently fails, and never mixes chunks.

Defined cases: a null text is an empty one and has no ids. Repeated rows are encoded each. A text longer than a chunk is
a chunk of its own, as long as it is. An empty table gives an empty result. Columns other than the id and the text are
not carried.
"""

from __future__ import annotations

import base64
import hashlib
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lagwise.llm.chunks import pack, signed_chunks, unpack
from lagwise.llm.common import bounded_batches, documents

BLOCK_CHARS = 500_000
DIGESTS = ["n_tokens", "ids_sha256", "decoded_sha256"]
DIGEST_TYPES = "n_tokens long, ids_sha256 string, decoded_sha256 string"
# White space of Unicode, as the tokenizer's pattern understands it (fixed values).
WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
LETTER, NUMBER, OTHER, SPACE, BREAK = 0, 1, 2, 3, 4
QUOTE = ord("'")
_KINDS: list[np.ndarray] = []


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def kinds() -> np.ndarray:
    """Letter, number, other or white space for every code point; one more code point stands between texts."""
    if not _KINDS:
        table = np.full(0x110001, OTHER, np.uint8)
        names = [unicodedata.category(chr(i))[0] for i in range(0x110000)]
        table[:-1][np.array([n == "L" for n in names])] = LETTER
        table[:-1][np.array([n == "N" for n in names])] = NUMBER
        table[WHITE] = SPACE
        table[0x110000] = BREAK
        _KINDS.append(table)
    return _KINDS[0]


def starts(codes: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin, by the rules of the pattern: contractions; runs of one kind with one leading blank;
    white space, whose last character goes with what follows if it is a blank and stands alone if not."""
    kind = kinds()[codes]
    begin = np.ones(len(codes), bool)
    begin[1:] = kind[1:] != kind[:-1]
    begin |= kind == BREAK
    turn = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] < SPACE)) + 1
    begin[turn - 1] = True
    begin[turn[codes[turn - 1] == 32]] = False
    padded = np.concatenate([codes, np.full(2, 0x110000, codes.dtype)])
    quote = np.flatnonzero(begin & (codes == QUOTE))
    one, two = padded[quote + 1], padded[quote + 2]
    is_ = lambda x, chars: np.isin(x, [ord(c) for c in chars])
    single = is_(one, "stmd")
    double = (is_(one, "rv") & is_(two, "e")) | (is_(one, "l") & is_(two, "l"))
    begin[quote[single | double] + 1] = False
    for ends in (quote[single] + 2, quote[double & ~single] + 3):
        begin[ends[ends < len(codes)]] = True
    return begin


def cut(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct pre-tokens of some texts, the sequence of all pre-tokens as places in that list, and the number per text.

    Occurrences are matched by a 64-bit hash with the length mixed in; only one of each is made a string.
    """
    joined = "".join(texts)
    sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    plain = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    edges = np.cumsum(sizes)
    codes = np.insert(plain, edges, np.uint32(0x110000))
    begin = np.flatnonzero(starts(codes))
    lengths = np.diff(np.append(begin, len(codes)))
    real = codes[begin] != 0x110000
    per_text = np.diff(np.append(0, np.cumsum(real)[~real]))
    # Polynomial hashes of all runs: the running sum of code x r^-i between the ends, times r^(last).
    mixed = (codes.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(29)
    up, down = _powers(len(codes))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed * down)])
    begin, lengths = begin[real], lengths[real]
    hashed = (total[begin + lengths] - total[begin]) * up[begin] + lengths.astype(np.uint64) * np.uint64(0x94D049BB133111EB)
    _, first, place = np.unique(hashed, return_index=True, return_inverse=True)
    # A text's separator shifts its characters by one for every text before.
    shift = np.repeat(np.arange(len(texts)), per_text)
    at = (begin - shift)[first].tolist()
    return [joined[a : a + n] for a, n in zip(at, lengths[first].tolist())], place, per_text


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64."""
    if not _POWERS or len(_POWERS[0]) < n:
        r = 0xD6E8FEB86659FD93
        size = max(n, BLOCK_CHARS + 1000)
        up, down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, x, np.uint64)])) for x in (r, pow(r, -1, 1 << 64)))
        _POWERS[:] = [up, down]
    return _POWERS[0][:n], _POWERS[1][:n]


def _blocks(texts: list[str]) -> Iterator[list[str]]:
    block, size = [], 0
    for text in texts:
        block.append(text)
        size += len(text)
        if size >= BLOCK_CHARS:
            yield block
            block, size = [], 0
    if block:
        yield block


def sequence(texts: list[str], buckets: int) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Of one chunk: distinct words in order of (bucket, word), bucket edges, the sequence of places, pre-tokens per text."""
    seen: dict[str, int] = {}
    flows, counts = [], []
    for block in _blocks(texts):
        distinct, place, per_text = cut(block)
        own = np.fromiter((seen.setdefault(w, len(seen)) for w in distinct), np.int64, len(distinct))
        flows.append(own[place])
        counts.append(per_text)
    words = [w.encode("utf-8", "surrogatepass") for w in seen]
    bucket = np.fromiter((zlib.crc32(w) % buckets for w in words), np.int64, len(words))
    order = sorted(range(len(words)), key=lambda i: (bucket[i], words[i]))
    rank = np.empty(len(words), np.uint32)
    rank[order] = np.arange(len(words), dtype=np.uint32)
    edges = np.searchsorted(bucket[order], np.arange(buckets + 1)) if words else np.zeros(buckets + 1, np.int64)
    flow = rank[np.concatenate(flows)] if flows and words else np.empty(0, np.uint32)
    return [words[i] for i in order], edges, flow, np.concatenate(counts) if counts else np.empty(0, np.int64)


def _bytes_of(words: list[bytes]) -> tuple[np.ndarray, bytes]:
    return np.fromiter((len(w) for w in words), np.uint32, len(words)), b"".join(words)


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, buckets: int | None = None, digests: bool = False) -> DataFrame:
    """Rows (doc_id, ids): the token ids of every whole text.

    `buckets` is the number of word places, by default that of shuffle partitions; a task keeps the distinct words of
    its places. With `digests`, ids are decoded and reduced where they are put together, to (doc_id, n_tokens,
    ids_sha256, decoded_sha256): what `decode` gives, without a second Python worker beside the first.
    """
    import public_tokenizers

    if pattern != public_tokenizers.PATTERN:
        raise ValueError("pre-tokens are cut by the rules of public_tokenizers.PATTERN only")
    spark = docs.sparkSession
    bounded_batches(spark)
    count = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    sent = spark.sparkContext.broadcast(ranks)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    key, arrow_key = rows.schema["doc_id"].dataType.simpleString(), to_arrow_type(rows.schema["doc_id"].dataType)

    def word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, _, texts in signed_chunks(batches):
            words, edges, _, _ = sequence(texts, count)
            full = np.flatnonzero(edges[:-1] < edges[1:])
            if len(full):
                yield pa.RecordBatch.from_arrays([
                    pa.array([name] * len(full)), pa.array(full.astype(np.int32)), pa.array(edges[full].astype(np.int64)),
                    pa.array([pack(*_bytes_of(words[edges[b] : edges[b + 1]])) for b in full.tolist()], pa.binary()),
                ], ["chunk", "bucket", "start", "words"])

    def flow_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, ids, texts in signed_chunks(batches):
            words, _, flow, per_text = sequence(texts, count)
            blob = pack(ids, flow, per_text.astype(np.uint32), len(words))
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([blob], pa.binary())], ["chunk", "flow"])

    def encode_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        merger = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=sent.value, special_tokens={})
        known: dict[bytes, bytes] = {}
        for batch in batches:
            out = []
            for blob in batch.column(2):
                sizes, joined = unpack(blob.as_py())
                found, at = [], 0
                for n in sizes.tolist():
                    word = joined[at : at + n]
                    at += n
                    got = known.get(word)
                    if got is None:
                        got = known[word] = np.array(merger.encode_ordinary(word.decode("utf-8", "surrogatepass")), np.int32).tobytes()
                    found.append(got)
                lengths = np.fromiter(map(len, found), np.uint32, len(found)) // 4
                out.append(pack(lengths, np.frombuffer(b"".join(found), np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["chunk", "start", "ids"])

    def assemble(flows: pa.Table, found: pa.Table) -> pa.Table:
        if not flows.num_rows:
            raise RuntimeError("words came for a chunk that is not there: the input changed between two reads")
        names, flow, per_text, n_words = unpack(flows["flow"][0].as_py())
        starts_at, blobs = found["start"].to_numpy(), found["ids"]
        parts = [unpack(blobs[i].as_py()) for i in np.argsort(starts_at).tolist()]
        lengths = np.concatenate([p[0] for p in parts]).astype(np.int64) if parts else np.empty(0, np.int64)
        ids = np.concatenate([p[1] for p in parts]) if parts else np.empty(0, np.int32)
        if len(lengths) != n_words:
            raise RuntimeError("a chunk's words did not all come back: the input changed between two reads")
        offset = np.cumsum(lengths) - lengths
        # All ids of the chunk in text order: for every pre-token, a run of the id table.
        runs = lengths[flow]
        ends = np.cumsum(runs)
        where = np.arange(ends[-1] if len(ends) else 0) + np.repeat(offset[flow] - (ends - runs), runs)
        whole, token_ends = ids[where], np.concatenate([[0], ends])
        edges = np.concatenate([[0], token_ends[np.cumsum(per_text)]])
        keys = pa.array(names, arrow_key)
        if digests:
            return pa.Table.from_arrays([keys, *_digests(whole, edges, _decoder(sent.value))], ["doc_id", *DIGESTS])
        return pa.Table.from_arrays([keys, pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(whole))], ["doc_id", "ids"])

    words = rows.mapInArrow(word_rows, "chunk string, bucket int, start long, words binary")
    found = words.repartition(count, "bucket").select("chunk", "start", "words").mapInArrow(encode_words, "chunk string, start long, ids binary")
    flows = rows.mapInArrow(flow_rows, "chunk string, flow binary")
    out = DIGEST_TYPES if digests else "ids array<int>"
    return flows.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(assemble, f"doc_id {key}, {out}")


def decode(encoded: DataFrame, ranks: dict[bytes, int], digests: bool = False) -> DataFrame:
    """Rows (doc_id, ids, decoded): the bytes behind stored ids. An id outside the table is an error.

    With `digests`, ids and bytes are reduced where they lie, to (doc_id, n_tokens, ids_sha256, decoded_sha256).
    """
    sent = encoded.sparkSession.sparkContext.broadcast(ranks)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, lists = batch.column(0), batch.column(1)
            flat, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            if digests:
                yield pa.RecordBatch.from_arrays([keys, *_digests(flat, ends, _decoder(sent.value))], ["doc_id", *DIGESTS])
                continue
            table = _decoder(sent.value)[0]
            texts = (b"".join(map(table.__getitem__, flat[a:b].tolist())) for a, b in zip(ends[:-1], ends[1:]))
            yield pa.RecordBatch.from_arrays([keys, lists, pa.array(texts, pa.binary())], ["doc_id", "ids", "decoded"])

    key = encoded.schema["doc_id"].dataType.simpleString()
    rest = DIGEST_TYPES if digests else "ids array<int>, decoded binary"
    return encoded.select("doc_id", "ids").mapInArrow(join, f"doc_id {key}, {rest}")


_DECODERS: dict[int, tuple[list[bytes], np.ndarray]] = {}


def _decoder(ranks: dict[bytes, int]) -> tuple[list[bytes], np.ndarray]:
    """The token-byte table and the decimal texts of all ids; made once per worker and vocabulary."""
    if id(ranks) not in _DECODERS:
        table = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            table[rank] = token
        _DECODERS.clear()
        _DECODERS[id(ranks)] = table, np.array([b"%d " % i for i in range(len(table))])
    return _DECODERS[id(ranks)]


def _digests(flat: np.ndarray, edges: np.ndarray, decoder: tuple[list[bytes], np.ndarray]) -> list[pa.Array]:
    """Of the runs of `flat` between edges: length, digest of the decimal ids, digest of the decoded bytes."""
    table, decimals = decoder
    ids_sums, text_sums = [], []
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        ids_sums.append(hashlib.sha256(ids_text(flat[a:b], decimals)).hexdigest())
        text_sums.append(hashlib.sha256(b"".join(map(table.__getitem__, flat[a:b].tolist()))).hexdigest())
    return [pa.array(np.diff(edges).astype(np.int64)), pa.array(ids_sums, pa.string()), pa.array(text_sums, pa.string())]


def ids_text(ids: np.ndarray, decimals: np.ndarray) -> bytes:
    """Decimal ids joined by one blank; `decimals` has b'<id> ' per id, padded with zero bytes."""
    return decimals[ids].tobytes().translate(None, b"\0")[:-1]


def op4_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return encode(documents(spark, sf_dir), ranks, public_tokenizers.PATTERN, digests=True)
