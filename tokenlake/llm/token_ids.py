"""Token ids in a byte-aligned variable-length format with separate control bytes (operator 7).

Ids are replaced by their rank in the corpus by descending frequency, so frequent tokens are small
numbers. A rank is stored in 1 to 4 bytes, little-endian, in the *data* stream; two bits per rank in the
*control* stream say how many. A control byte describes four ranks, so a 256-row table gives the four
lengths and their sum at once, and numpy decodes whole documents without a loop over tokens.

The file format is a Parquet dataset of (shard, doc_id, n_tokens, control, data), one row per document,
shards and rows in ascending doc_id order, beside a dataset of (rank, id). Spark writes both, so a lost
executor's tasks are written again and nothing is read by a path that only one machine has.

Texts are cut where the byte-level pre-tokenizer always cuts too: before a space behind another
character, before a full stop or comma after a letter or digit, around a single line break; a doubtful place is not cut.
Each different piece is tokenized once per worker (a worker's tasks share its memory, which ``MAX_PIECES`` bounds) and its
ids are looked up afterwards: cuts and look-ups are numpy operations over the bytes of many documents, pieces are compared whole.

Defined results: null or empty text encodes to the end id alone; rows with the same doc_id are
documents of their own; null doc_id comes first; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tokenlake.llm.common import written
from tokenlake.llm.ngrams import MULTIPLIER, mixed, portions

END_ID = 2
#: pieces that a worker remembers, about 100 bytes each; more start a new memory
MAX_PIECES = 2_000_000
#: documents whose ids are put together at a time
DOCS_AT_ONCE = 256
#: bytes of text looked at together
BYTES_AT_ONCE = 1 << 21
#: bytes that a piece in the table may have; longer ones stand in a dict
SHORT = 15

# what a byte is
SPACE, STOP, BREAK, WHITE, WORD, MAY_BE_WHITE, LATIN = (1 << k for k in range(7))
_KIND = np.zeros(256, np.uint8)
for _bytes, _kind in (
    (b" ", SPACE), (b".,", STOP), (b"\n", BREAK), (b" \t\n\v\f\r\x1c\x1d\x1e\x1f", WHITE),
    (bytes(k for k in range(128) if chr(k).isalnum()), WORD),
    (b"\xc2\xe1\xe2\xe3", MAY_BE_WHITE), (bytes(range(0xC3, 0xC9)), LATIN),
):
    _KIND[list(_bytes)] |= _kind
_KEPT = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)  # the first k bytes of a little-endian word


def cut_places(raw: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """First byte of every piece of the texts that begin at ``begin`` in ``raw`` and fill it.

    A text is cut where the pre-tokenizer always cuts and a piece does not end in white space, on which the cut
    would depend: before a space or line break behind anything else, before a full stop or comma behind
    a letter or digit, and behind a line break between other characters.
    """
    n, kind = len(raw), _KIND[raw]
    solid, word = (kind & WHITE) == 0, (kind & WORD) > 0  # whether the character of a byte is no white space; whether a letter or digit ends with it
    lead = np.flatnonzero(kind & MAY_BE_WHITE)
    if len(lead):
        around = np.append(raw, np.zeros(2, np.uint8))
        second = around[lead + 1]
        two = (raw[lead] == 0xC2) & ((second == 0x85) | (second == 0xA0))
        three = (raw[lead] == 0xE1) & (second == 0x9A) | (raw[lead] == 0xE2) & (second <= 0x81) | (raw[lead] == 0xE3) & (second == 0x80)
        for k in range(3):
            solid[(lead + k)[three | two & (k < 2)]] = False
    lead = np.flatnonzero(kind & LATIN)
    if len(lead):  # letters up to U+024F, but for the signs of multiplication and division
        lead = lead[(raw[lead] != 0xC3) | (raw[lead + 1] & 0xDF != 0x97)]
        word[lead + 1] = True
    at = np.flatnonzero(kind & (SPACE | STOP | BREAK))
    at = at[at > 0]
    cut = np.zeros(n + 1, bool)
    cut[at] = np.where(kind[at] & STOP, word[at - 1], solid[at - 1])
    behind = at[(kind[at] & BREAK > 0) & (at < n - 1)] + 1
    cut[behind] |= solid[behind - 2] & solid[behind]
    cut[begin] = True
    return np.flatnonzero(cut[:n])


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _extended(held: np.ndarray, n: int, new: np.ndarray) -> np.ndarray:
    """``held``, of which ``n`` values count, with ``new`` behind them; room is doubled at least, so little is copied."""
    if n + len(new) > len(held):
        held = np.concatenate([held[:n], np.zeros(n + 2 * len(new) + 1024, held.dtype)])
    held[n : n + len(new)] = new
    return held


class PieceEncoder:
    """Ids of whole texts, through a memory of pieces already tokenized."""

    def __init__(self, path: str) -> None:
        self.tokenizer = _tokenizer(path)
        vocabulary = self.tokenizer.get_vocab()  # byte-level: one character for each byte
        self.token_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.token_bytes[list(vocabulary.values())] = [len(t) for t in vocabulary]
        self._forget()

    def _forget(self) -> None:
        self.known, self.used, self.taken, self.ids = 0, 0, 0, np.zeros(0, np.uint32)
        self.table = np.zeros((1 << 16, 3), np.uint64)  # two words of a short piece, its length in the highest byte; then its value
        self.long: dict[bytes, tuple[int, int]] = {}

    def _learn(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Tokenizes new pieces: where the ids of each stand in ``ids``, and how many. Pieces that begin with a space and do not end in white space
        go through the tokenizer many at a time, since it cuts before each; the bytes of the tokens tell where a piece ends."""
        joined = np.fromiter((p[0] == 0x20 < p[-1] and (p[-1] < 0x80 or not p.decode()[-1].isspace()) for p in pieces), bool, len(pieces))
        rows = np.flatnonzero(joined)
        groups, alone = [rows[a : a + 256].tolist() for a in range(0, len(rows), 256)], np.flatnonzero(~joined)
        given = [b"".join([pieces[k] for k in g]).decode() for g in groups] + [pieces[k].decode() for k in alone.tolist()]
        encoded = self.tokenizer.encode_batch_fast(given, add_special_tokens=False)
        counts, starts, flat, used = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64), [], self.used
        for group, e in zip(groups, encoded[: len(groups)], strict=True):
            ids = np.array(e.ids, np.uint32)
            ends = np.cumsum([len(pieces[k]) for k in group])
            at = np.append(0, np.searchsorted(np.cumsum(self.token_bytes[ids]), ends) + 1)
            starts[group], counts[group] = used + at[:-1], np.diff(at)
            flat.append(ids)
            used += len(ids)
        lists = [e.ids for e in encoded[len(groups) :]]
        counts[alone] = n = np.fromiter(map(len, lists), np.int64, len(lists))
        starts[alone] = used + np.cumsum(n) - n
        flat.append(np.fromiter(chain.from_iterable(lists), np.uint32, int(n.sum())))
        used += int(n.sum())
        self.ids = _extended(self.ids, self.used, np.concatenate(flat))
        self.known, self.used = self.known + len(pieces), used
        return starts, counts

    def _slots(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(slot, whether the piece is there) of short pieces; where it is not, the slot is the free one at which the search ended."""
        mask = len(self.table) - 1
        slot = (mixed(low * MULTIPLIER + high) & np.uint64(mask)).astype(np.int64)
        row = self.table[slot]
        found, free = (row[:, 0] == low) & (row[:, 1] == high), row[:, 1] == 0
        left = np.flatnonzero(~(found | free))
        while len(left):
            slot[left] = (slot[left] + 1) & mask
            row = self.table[slot[left]]  # the next ones
            found[left] = (row[:, 0] == low[left]) & (row[:, 1] == high[left])
            left = left[~found[left] & (row[:, 1] != 0)]
        return slot, found

    def _put(self, rows: np.ndarray) -> None:
        """Different short pieces that are not in the table, into it; it stays at least half empty."""
        self.taken += len(rows)
        if 2 * self.taken > len(self.table):
            rows = np.concatenate([self.table[self.table[:, 1] != 0], rows])
            self.table = np.zeros((1 << (4 * self.taken - 1).bit_length(), 3), np.uint64)
        while len(rows):
            slot, _ = self._slots(rows[:, 0], rows[:, 1])
            slot, one = np.unique(slot, return_index=True)  # of pieces that ask for one slot, one goes there
            self.table[slot] = rows[one]
            rows = np.delete(rows, one, axis=0)

    def _short(self, raw: np.ndarray, words: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Value (16 times the place of its ids, and their number) of each short piece; pieces not seen before are tokenized first."""
        low = words[at] & _KEPT[np.minimum(size, 8)]
        high = words[at + 8] & _KEPT[np.maximum(size - 8, 0)] | size.astype(np.uint64) << np.uint64(56)
        slot, found = self._slots(low, high)
        value = self.table[slot, 2].astype(np.int64)
        new = np.flatnonzero(~found)
        if len(new):
            new = new[np.lexsort((low[new], high[new]))]
            first = np.ones(len(new), bool)
            first[1:] = (low[new][1:] != low[new][:-1]) | (high[new][1:] != high[new][:-1])
            one = new[first]
            text = raw.tobytes()
            starts, counts = self._learn([text[a : a + n] for a, n in zip(at[one].tolist(), size[one].tolist(), strict=True)])
            learnt = starts * 16 + counts
            self._put(np.stack([low[one], high[one], learnt.astype(np.uint64)], axis=1))
            value[new] = learnt[np.cumsum(first) - 1]
        return value

    def _whole(self, pieces: list[bytes]) -> list[tuple[int, int]]:
        """(place, number) of the ids of each long piece."""
        new = [p for p in dict.fromkeys(pieces) if p not in self.long]
        if new:
            starts, counts = self._learn(new)
            self.long.update(zip(new, zip(starts.tolist(), counts.tolist(), strict=True), strict=True))
        return [self.long[p] for p in pieces]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        raw = [t.encode() for t in texts]
        return [ids for a, b in portions(raw, BYTES_AT_ONCE) for ids in self._encoded(raw[a:b])]

    def _encoded(self, texts: list[bytes]) -> list[np.ndarray]:
        if self.known > MAX_PIECES or self.used > 8 * MAX_PIECES:  # full
            self._forget()
        size = np.array([len(t) for t in texts], np.int64)
        begin = np.cumsum(size) - size
        raw = np.frombuffer(b"".join([*texts, bytes(2 * 8)]), np.uint8)
        words = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))  # eight bytes from each byte on
        n = len(raw) - 2 * 8
        at = cut_places(raw[:n], begin)
        length = np.diff(np.append(at, n))
        starts, counts = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        short, long = np.flatnonzero(length <= SHORT), np.flatnonzero(length > SHORT)
        value = self._short(raw, words, at[short], length[short])
        starts[short], counts[short] = value >> 4, value & 15
        if len(long):
            text = raw.tobytes()
            pairs = self._whole([text[a : a + k] for a, k in zip(at[long].tolist(), length[long].tolist(), strict=True)])
            starts[long], counts[long] = np.array(pairs, np.int64).T
        ends = np.cumsum(counts)
        flat = self.ids[np.repeat(starts - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)]
        return np.split(flat, np.append(0, ends)[np.searchsorted(at, begin)][1:])


@lru_cache(maxsize=1)
def worker_encoder(path: str) -> PieceEncoder:
    """The encoder of this Python worker: the tasks that it runs one after another share what it has learnt."""
    return PieceEncoder(path)


def _shrink(ids: np.ndarray) -> bytes:
    """Ids as bytes: two each if all fit, else four, the width first."""
    if ids.max(initial=0) < 1 << 16:
        return b"\2" + ids.astype("<u2").tobytes()
    return b"\4" + ids.astype("<u4").tobytes()


def _grown(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype(np.uint32)


def tokenized(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """(doc_id, n_tokens, ids): whole texts through the tokenizer, the end id appended."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(path)
        for whole in batches:
            for at in range(0, whole.num_rows, DOCS_AT_ONCE):
                batch = whole.slice(at, DOCS_AT_ONCE)
                rows = [np.append(ids, np.uint32(end_id)) for ids in encoder.encode([t or "" for t in batch["text"].to_pylist()])]
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"], pa.array([len(r) for r in rows], pa.int64()), pa.array([_shrink(r) for r in rows], pa.binary())],
                    ["doc_id", "n_tokens", "ids"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def frequency_ranks(tokens: DataFrame) -> DataFrame:
    """(rank, id): ids by descending count over all documents, then ascending id. At most one row per vocabulary entry."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            rows = batch["ids"].to_pylist()
            for at in range(0, len(rows), DOCS_AT_ONCE):
                seen = np.bincount(np.concatenate([_grown(raw) for raw in rows[at : at + DOCS_AT_ONCE]]))
                if len(seen) > len(total):
                    total = np.pad(total, (0, len(seen) - len(total)))
                total[: len(seen)] += seen
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total[ids])], ["id", "n"])

    counts = tokens.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    return counts.select((F.row_number().over(Window.orderBy(F.col("n").desc(), "id")) - 1).cast("long").alias("rank"), "id")


def _in_fours(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(control bytes of each document, place of each rank): a document's ranks begin with a control byte of their own."""
    fours = -(-counts // 4)
    shift = 4 * (np.cumsum(fours) - fours) - (np.cumsum(counts) - counts)
    return fours, np.arange(counts.sum()) + np.repeat(shift, counts)


def _cuts(sizes: np.ndarray) -> list[tuple[int, int]]:
    ends = np.cumsum(sizes)
    return list(zip((ends - sizes).tolist(), ends.tolist(), strict=True))


def encode_many(ranks: np.ndarray, counts: np.ndarray) -> list[tuple[bytes, bytes]]:
    """(control, data) of each document; ``ranks`` are all their ranks, below 2^32, ``counts`` of each."""
    size = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)  # bytes - 1
    fours, place = _in_fours(counts)
    padded = np.zeros(4 * int(fours.sum()), np.uint8)
    padded[place] = size
    padded = padded.reshape(-1, 4)
    control = (padded[:, 0] | padded[:, 1] << 2 | padded[:, 2] << 4 | padded[:, 3] << 6).astype(np.uint8).tobytes()
    quads = ranks.astype("<u4").view(np.uint8).reshape(-1, 4)
    data = quads[np.arange(4) <= size[:, None]].tobytes()
    upto = np.concatenate([[0], np.cumsum(size.astype(np.int64) + 1)])[np.concatenate([[0], np.cumsum(counts)])]
    return [(control[a:b], data[c:d]) for (a, b), (c, d) in zip(_cuts(fours), _cuts(np.diff(upto)), strict=True)]


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of an array of ranks below 2^32."""
    return encode_many(ranks, np.array([len(ranks)]))[0]


#: control byte -> lengths of its four ranks
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1).astype(np.uint8)


def decode_many(controls: list[bytes], data: list[bytes], counts: np.ndarray) -> np.ndarray:
    """The ranks of documents, all at once: lengths by table lookup, starts by a running sum."""
    length = LENGTHS[np.frombuffer(b"".join(controls), np.uint8)].reshape(-1)[_in_fours(counts)[1]]
    start = np.cumsum(length, dtype=np.int64) - length
    raw = np.frombuffer(b"".join(data), np.uint8)
    if int(length.sum(dtype=np.int64)) != len(raw):
        raise ValueError("a token file's data do not fit its control bytes")
    words = raw[start].astype(np.uint32)
    for k in range(1, 4):
        more = np.flatnonzero(length > k)
        words[more] |= raw[start[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return words


def decode_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` ranks of one document."""
    return decode_many([control], [data], np.array([n]))


def write_token_files(docs: DataFrame, path: str, end_id: int = END_ID) -> tuple[DataFrame, DataFrame]:
    """Writes the dataset and returns (files, ranks) read back from the shared folder.

    ``path`` is a tokenizer file that every executor has. The rank table has one row per vocabulary
    entry at most (50,257 for the files here), which bounds what is sent to the executors.
    """
    tokens = written(tokenized(docs, path, end_id), "tokens", compression="zstd")
    ranks = written(frequency_ranks(tokens).coalesce(1), "token-ranks")
    table = _id_to_rank(ranks)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, DOCS_AT_ONCE):
                batch = whole.slice(at, DOCS_AT_ONCE)
                ids = [_grown(raw) for raw in batch["ids"].to_pylist()]
                pairs = encode_many(table.value[np.concatenate(ids)], np.array([len(x) for x in ids]))
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"], batch["n_tokens"], pa.array([p[0] for p in pairs], pa.binary()), pa.array([p[1] for p in pairs], pa.binary())],
                    ["doc_id", "n_tokens", "control", "data"],
                )

    by_id = F.col("doc_id").asc_nulls_first()
    ordered = tokens.repartitionByRange(by_id).sortWithinPartitions(by_id, "n_tokens", "ids")
    files = ordered.mapInArrow(coded, "doc_id long, n_tokens long, control binary, data binary")
    files = files.withColumn("shard", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id())
    return written(files, "token-files", compression="zstd"), ranks


def _id_to_rank(ranks: DataFrame):
    """Broadcast array from id to rank; its size is that of the vocabulary."""
    rows = ranks.toArrow()
    ids, at = rows["id"].to_numpy(), rows["rank"].to_numpy()
    table = np.zeros(int(ids.max(initial=0)) + 1, np.uint32)
    table[ids] = at
    return ranks.sparkSession.sparkContext.broadcast(table)


def read_token_files(files: DataFrame, ranks: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files: start counts the ids of all documents before."""
    rows = ranks.orderBy("rank").toArrow()
    table = files.sparkSession.sparkContext.broadcast(rows["id"].to_numpy().astype("<u4"))

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            crc = []
            for at in range(0, whole.num_rows, DOCS_AT_ONCE):
                batch = whole.slice(at, DOCS_AT_ONCE)
                counts = batch["n_tokens"].to_numpy()
                ids = table.value[decode_many(batch["control"].to_pylist(), batch["data"].to_pylist(), counts)]
                crc += [zlib.crc32(ids[a:b]) for a, b in _cuts(counts)]
            batch = whole
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["shard"], batch["row"], batch["n_tokens"], pa.array(crc, pa.int64())],
                                             ["doc_id", "shard", "row", "n_tokens", "ids_crc32"])

    read = files.mapInArrow(decoded, "doc_id long, shard int, row long, n_tokens long, ids_crc32 long")
    sums = files.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("shard", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    upto = F.sum("n_tokens").over(Window.partitionBy("shard").orderBy("row").rowsBetween(Window.unboundedPreceding, 0))
    return (
        read.withColumn("upto", upto)
        .join(sums, "shard")
        .select("doc_id", (F.col("offset") + F.col("upto") - F.col("n_tokens")).alias("start"), "n_tokens", "ids_crc32")
    )
