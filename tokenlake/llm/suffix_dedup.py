"""Exact substring dedup with difference-cover suffix arrays (operator 4).

Every byte that a 50-byte string covers which also starts in a document with a smaller doc_id is
removed; strings are judged on the input and never cross documents.

1. *Anchors.* In each 50-byte string the 18-byte gram with the smallest hash is its anchor, so equal
   strings have equal anchors. Documents send their anchors to buckets by gram, as packed arrays: hashes
   of the gram, of four 42-byte strings around it, of the whole context (all 50-byte strings around
   the gram), and the doc_id. An anchor whose whole context stands in a smaller document is settled: all of
   the context goes. Of the rest, only anchors can matter of which one of the four strings stands in
   another document too: wherever a 50-byte string has its gram, it holds 0 and 24, 8 and 16, 16 and 8
   or 24 and 0 of the bytes before and behind.
2. *Suffix arrays.* The contexts of those anchors, cut to the strings that have them as their anchor, meet by gram, in blocks of bounded size. Each block is
   sorted by the difference-cover algorithm: triples at positions 1 and 2 modulo 3 are sorted and
   named, the names are sorted by recursion, the remaining suffixes are merged in, and neighbours are
   compared on their first 50 bytes. Strings of one class with a smaller doc_id in it are removed.
   A gram with many contexts is dealt over several blocks, whose classes are joined by digest.
3. *Removal.* Runs are united per document and the rest is hashed.

Only step 2 compares bytes; a false match in step 1 needs equal hashes of 120 bits in one document
pair. A hot gram does not gather in step 1: a task sends each context once and settles its own repeats, and of
more than ``HOT`` contexts of a gram in one task only those go to the gram's bucket that others
need to meet.

Defined results: null text is empty; texts under 50 bytes lose nothing; rows without doc_id neither
lose bytes nor cause it; rows of one doc_id never remove each other's bytes; empty tables give no rows.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenlake.llm.common import written
from tokenlake.llm.ngrams import MULTIPLIER, SpanHashes, mixed, portions, texts_of

LENGTH, GRAM = 50, 18
#: bytes before and behind a gram of the strings that one of must be shared
AROUND = ((0, 24), (8, 16), (16, 8), (24, 0))
SPAN = LENGTH - GRAM  # bytes of a 50-byte string beside its anchor
#: bytes of a long text, or of several short ones, looked at together
PIECE = 1 << 21
#: anchors in a bucket, on average; contexts of a gram in one block; symbols of a block
BUCKET_ANCHORS, BLOCK_CONTEXTS, BLOCK_SYMBOLS = 400_000, 4096, 1 << 20
HOT = 64
SETTLED, ALIVE = 0, 1
_ANCHOR = np.dtype([("gram", "<u8"), ("around", "<u2", (4,)), ("context", "<u2")])
_RECORD = np.dtype([("gram", "<u4"), ("high", "u1"), ("around", "<u2", (4,)), ("context", "<u2")])


def _sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """best of every ``width`` neighbours, by doubling."""
    n = 1
    while 2 * n <= width:
        x = best(x[:-n], x[n:])
        n *= 2
    return best(x[: len(x) - (width - n)], x[width - n :]) if n < width else x


class Anchors:
    """Anchors of texts. ``of`` gives (text, position, anchor fields) in text and position order."""

    def __init__(self) -> None:
        self.hashes = SpanHashes()

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        parts = [self._part(texts[a:b], a) for a, b in portions(texts, PIECE)]
        parts = [p for group in parts for p in group]
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, int), np.zeros(0, int), np.zeros(0, _ANCHOR))

    def _part(self, texts: list[bytes], base: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        if len(texts) > 1 or len(texts[0]) <= 2 * PIECE:
            doc, at, anchor = self._anchors(texts, [0] * len(texts), [len(t) for t in texts], [0] * len(texts), [len(t) for t in texts])
            yield doc + base, at, anchor
            return
        text, last = texts[0], -1
        for lo in range(0, len(text), PIECE):  # a long text, piece by piece, with the bytes around each piece
            first, hi = max(0, lo - LENGTH), min(len(text), lo + PIECE)
            doc, at, anchor = self._anchors([text[first : hi + 2 * LENGTH]], [lo - first], [hi - first], [first], [len(text)])
            new = at > last
            last = at[-1] if len(at) else last
            yield doc[new] + base, at[new], anchor[new]

    def _anchors(self, texts, lo, hi, first, size):
        """Anchors of the 50-byte strings that start in lo .. hi of each text; the text is the part from ``first`` of ``size`` bytes."""
        raw = np.frombuffer(b"\0".join([*texts, bytes(LENGTH)]), np.uint8)
        begin = np.cumsum([0] + [len(t) + 1 for t in texts])[:-1]
        ends = begin + np.array([len(t) for t in texts])
        self.hashes.load(raw)
        upto, down, n = self.hashes.upto, self.hashes.down, len(raw)
        gram = mixed((upto[GRAM:] - upto[:-GRAM]) * down[: n - GRAM + 1]) | np.uint64(1)
        least = _sliding(gram, SPAN + 1, np.minimum)
        starts = np.zeros(len(least) + 1, np.int32)
        a = begin + np.array(lo)
        b = np.maximum(a, np.minimum(begin + np.array(hi), ends - LENGTH + 1))
        np.add.at(starts, a, 1)
        np.add.at(starts, b, -1)
        least[np.cumsum(starts[:-1]) == 0] = 0  # strings that reach over an end have no anchor
        pad = np.zeros(SPAN, np.uint64)
        at = np.flatnonzero(_sliding(np.concatenate([pad, least, pad]), SPAN + 1, np.maximum) == gram)
        doc = np.searchsorted(begin, at, side="right") - 1
        left, right = np.minimum(at - begin[doc], SPAN), np.minimum(ends[doc] - at, LENGTH)
        clip = (left * 64 + right).astype(np.uint64)  # a context cut by an end is another context
        out = np.empty(len(at), _ANCHOR)
        out["gram"] = gram[at]
        for k, (near, far) in enumerate(AROUND):
            near, far = np.minimum(left, near), np.minimum(right, GRAM + far)
            out["around"][:, k] = mixed(self.hashes.of(at - near, at + far) ^ (near * 64 + far).astype(np.uint64)) >> np.uint64(48)
        out["context"] = mixed(self.hashes.of(at - left, at + right) ^ clip) >> np.uint64(48)
        return doc, at - begin[doc] + np.array(first)[doc], out


def _runs(changes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, end) of each run among ``n`` rows; ``changes`` tells for all rows but the first whether a run begins."""
    first = np.flatnonzero(np.concatenate([[True], changes])[:n])
    return first, np.append(first[1:], n)[: len(first)]


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, first of each group in that order): rows with equal keys stand together."""
    h = keys[0].astype(np.uint64)
    for k in keys[1:]:
        h = mixed(h * MULTIPLIER + k.astype(np.uint64))
    order = np.argsort(h)
    h = h[order]
    return order, np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])[: len(h)])


def _per_group(order: np.ndarray, first: np.ndarray, x: np.ndarray, of) -> np.ndarray:
    """of (a ufunc) over each group's x, given back to every row."""
    if not len(order):
        return x[:0]
    out = np.empty(len(order), x.dtype)
    out[order] = np.repeat(of.reduceat(x[order], first), np.diff(np.append(first, len(order))))
    return out


def _alike(x: np.ndarray) -> list[np.ndarray]:
    """The fields that tell one context from another, but for the gram."""
    return [np.ascontiguousarray(x["around"]).view("<u8")[:, 0], x["context"]]


def _settled(gram, rest: np.ndarray, doc: np.ndarray) -> np.ndarray:
    order, first = _groups(gram, *_alike(rest))
    return doc > _per_group(order, first, doc, np.minimum)


def _met(doc: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Whether another document has the same keys."""
    order, first = _groups(*keys)
    return _per_group(order, first, doc, np.minimum) != _per_group(order, first, doc, np.maximum)


def _edge(doc: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Rows with the smallest or the largest doc of their group."""
    order, first = _groups(*keys)
    return (doc == _per_group(order, first, doc, np.minimum)) | (doc == _per_group(order, first, doc, np.maximum))


def _key(anchor: np.ndarray, gram40: np.ndarray) -> np.ndarray:
    """64 bits of an anchor's fields, the lowest free for its state."""
    around, context = _alike(anchor)
    return mixed(mixed(around * MULTIPLIER + context.astype(np.uint64)) + gram40) & ~np.uint64(1)


_PACK = "bucket int, state int, docs binary, records binary"


def _sent(buckets: int, hot: int):
    """Packs the anchors of each portion by bucket; what is settled or alive already goes anywhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors()
        for batch in batches:
            ids = batch["doc_id"].to_numpy(zero_copy_only=False)
            texts = texts_of(batch)
            for a, b in portions(texts, 4 * PIECE):
                doc, _, found = anchors.of(texts[a:b])
                doc = ids[a:b][doc]
                order, first = _groups(found["gram"], *_alike(found), doc)
                found, doc = found[order[first]], doc[order[first]]  # a document's repeats count once
                gram = found["gram"]
                settled = _settled(gram, found, doc)
                rest = np.flatnonzero(~settled)
                g, d = gram[rest], doc[rest]
                order, first = _groups(g)
                many = _per_group(order, first, np.ones(len(g), np.int64), np.add) > hot
                alive = np.zeros(len(gram), bool)
                crowd = rest[many]
                g, d = gram[crowd], doc[crowd]
                edge = np.zeros(len(crowd), bool)  # first or last with a string; the others share all four
                for k in range(len(AROUND)):
                    edge |= _edge(d, g, found["around"][crowd, k])
                alive[crowd] = ~edge
                to = ((gram >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)
                loose = settled | alive
                to[loose] = (mixed(doc[loose].view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
                state = np.where(settled, SETTLED, np.where(alive, ALIVE, -1))
                record = np.empty(len(found), _RECORD)
                record["gram"], record["high"] = gram & np.uint64(0xFFFFFFFF), (gram >> np.uint64(32)) & np.uint64(0xFF)
                for k in ("around", "context"):
                    record[k] = found[k]
                order = np.argsort(to * 4 + state, kind="stable")
                place = to[order] * 4 + state[order] + 1
                cut, ends = _runs(place[1:] != place[:-1], len(place))
                rows = [(int(to[order[s]]), int(state[order[s]]), _narrow(doc[order[s:e]]), record[order[s:e]].tobytes()) for s, e in zip(cut, ends, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)]
                    if rows else [pa.array([], t) for t in (pa.int32(), pa.int32(), pa.binary(), pa.binary())],
                    ["bucket", "state", "docs", "records"],
                )

    return run


def _narrow(ids: np.ndarray) -> bytes:
    """Ids as the smallest and 32-bit differences where they fit, else whole."""
    least = ids.min()
    if int(ids.max()) - int(least) < 1 << 32:
        return least.astype("<i8").tobytes() + (ids - least).astype("<u4").tobytes()
    return ids.astype("<i8").tobytes()


def _wide(raw: bytes, n: int) -> np.ndarray:
    if len(raw) == 8 + 4 * n and (n != 1 or len(raw) != 8 * n):
        return np.frombuffer(raw, "<i8", 1)[0] + np.frombuffer(raw, "<u4", offset=8).astype(np.int64)
    return np.frombuffer(raw, "<i8")


def _judged(parts: int):
    """Buckets of anchors in, (part of doc_ids, doc_ids and keys with state) of the settled and the alive out."""

    def judge(rows: list[tuple[int, bytes, bytes]]) -> Iterator[tuple[int, bytes]]:
        records = [np.frombuffer(r[2], _RECORD) for r in rows]
        docs = np.concatenate([_wide(r[1], len(x)) for r, x in zip(rows, records, strict=True)])
        state = np.repeat([r[0] for r in rows], [len(x) for x in records])
        records = np.concatenate(records)
        gram = records["high"].astype(np.uint64) << np.uint64(32) | records["gram"]
        open_ = np.flatnonzero(state < 0)
        g, doc = gram[open_], docs[open_]
        settled = _settled(g, records[open_], doc)
        state[open_[settled]] = SETTLED
        rest = open_[~settled]
        g, doc = gram[rest], docs[rest]
        met = np.zeros(len(rest), bool)
        for k in range(len(AROUND)):
            met |= _met(doc, g, records["around"][rest, k])
        state[rest[met]] = ALIVE
        told = np.flatnonzero(state >= 0)
        key = _key(records[told], gram[told]) | state[told].astype(np.uint64)
        part = docs[told] % parts
        order = np.lexsort((docs[told], part))
        for s, e in zip(*_runs(np.diff(part[order]) != 0, len(order)), strict=True):
            chosen = order[s:e]
            yield int(part[chosen[0]]), docs[told][chosen].astype("<i8").tobytes() + key[chosen].tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None

        def out() -> pa.RecordBatch:
            rows = list(judge(held))
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["part", "told"])

        for batch in batches:
            for b, *row in zip(*(batch[k].to_pylist() for k in ("bucket", "state", "docs", "records")), strict=True):
                if held and b != now:
                    yield out()
                    held = []
                now = b
                held.append(row)
        if held:
            yield out()

    return run


_FOUND = "kind int, doc_id long, row long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string, spans binary, gram long, start long, context binary"
_FOUND_NAMES = tuple(f.split()[0] for f in _FOUND.split(", "))


def _united(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of half-open ranges; ranges that touch are one run."""
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order]) if len(hi) else hi
    new = np.flatnonzero(np.concatenate([[True], lo[1:] > hi[:-1]])[: len(lo)])
    return lo[new], hi[np.append(new[1:], len(lo)) - 1] if len(lo) else hi


def _rest(text: bytes, lo: np.ndarray, hi: np.ndarray) -> tuple[int, int, str]:
    """(bytes removed, runs, digest of what is left)."""
    digest, at = hashlib.sha256(), 0
    for a, b in zip(lo.tolist(), hi.tolist(), strict=True):
        digest.update(text[at:a])
        at = b
    digest.update(text[at:])
    return int((hi - lo).sum()), len(lo), digest.hexdigest()


def _row_id(text: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little", signed=True)


def _located(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a part was told, then its documents: one row per document and one per context that is alive."""
    anchors, part = Anchors(), None
    told_docs = told_keys = None
    waiting: list[bytes] = []
    for batch in batches:
        parts, kinds = batch["part"].to_pylist(), batch["kind"].to_pylist()
        out: dict[str, list] = defaultdict(list)
        at = 0
        while at < len(parts):
            if parts[at] != part:
                part, waiting, told_docs = parts[at], [], None
            if kinds[at] == 0:
                waiting.append(batch["told"][at].as_py())
                at += 1
                continue
            if told_docs is None:
                split = [(np.frombuffer(w[: len(w) // 2], "<i8"), np.frombuffer(w[len(w) // 2 :], "<u8")) for w in waiting]
                told_docs = np.concatenate([x[0] for x in split]) if split else np.zeros(0, np.int64)
                told_keys = np.concatenate([x[1] for x in split]) if split else np.zeros(0, np.uint64)
                order = np.argsort(_spread(told_docs, told_keys))
                told_docs, told_keys, waiting = told_docs[order], told_keys[order], []
            to = at
            while to < len(parts) and parts[to] == part and kinds[to] == 1:
                to += 1
            ids, texts = batch["doc_id"].slice(at, to - at).to_pylist(), texts_of(batch.slice(at, to - at))
            for a, b in portions(texts, 4 * PIECE):
                _locate(anchors, ids[a:b], texts[a:b], told_docs, told_keys, out)
                if len(out["kind"]) > 20_000:
                    yield _found_batch(out)
                    out = defaultdict(list)
            at = to
        if out:
            yield _found_batch(out)


def _found_batch(out: dict[str, list]) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    fields = [f.split() for f in _FOUND.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(out[n], kinds[k]) for n, k in fields], [n for n, _ in fields])


def own_strings(doc: np.ndarray, at: np.ndarray, gram: np.ndarray, size: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) start of the 50-byte strings that have the anchor of each of ``rows`` as theirs.

    ``doc``, ``at`` and ``gram`` are all anchors in order, ``size`` the bytes of each anchor's text. A string has another anchor
    if one with a smaller hash stands in it, so the strings of an anchor follow one another.
    """
    here, own = at[rows], gram[rows]
    first, last = np.maximum(here - SPAN, 0), np.minimum(here, size[rows] - LENGTH)
    for step in (-1, 1):
        left, k = np.arange(len(rows)), step
        while len(left):
            there = rows[left] + k
            left, there = left[(there >= 0) & (there < len(at))], there[(there >= 0) & (there < len(at))]
            near = (doc[there] == doc[rows[left]]) & (np.abs(at[there] - here[left]) <= SPAN)
            left, there = left[near], there[near]
            less = gram[there] < own[left]
            if step < 0:
                first[left[less]] = np.maximum(first[left[less]], at[there[less]] + 1)
            else:
                last[left[less]] = np.minimum(last[left[less]], at[there[less]] - SPAN - 1)
            left, k = left[~less], k + step  # the nearest one is what counts
    return first, last


def _told(told_docs: np.ndarray, told_keys: np.ndarray, ids: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Whether each (id, key) was told; what was told is in order of :func:`_spread`."""
    if not len(told_docs):
        return np.zeros(len(key), bool)
    whole = _spread(told_docs, told_keys)
    place = np.minimum(np.searchsorted(whole, _spread(ids, key)), len(whole) - 1)
    return (told_docs[place] == ids) & (told_keys[place] == key)


def _spread(ids: np.ndarray, key: np.ndarray) -> np.ndarray:
    return mixed(ids.view(np.uint64) * MULTIPLIER + key)


def _locate(anchors: Anchors, ids: list, texts: list[bytes], told_docs: np.ndarray, told_keys: np.ndarray, out: dict[str, list]) -> None:
    doc, at, found = anchors.of(texts)
    key = _key(found, found["gram"] & np.uint64(0xFFFFFFFFFF))
    first = np.searchsorted(doc, np.arange(len(texts) + 1))

    def add(n: int = 1, **columns: list) -> None:
        for name in _FOUND_NAMES:
            out[name].extend(columns.get(name) or [None] * n)

    size = np.array([len(t) for t in texts], np.int64)
    known = np.array([i is not None for i in ids], bool)
    doc_ids = np.array([0 if i is None else i for i in ids], np.int64)[doc]
    settled = _told(told_docs, told_keys, doc_ids, key | np.uint64(SETTLED)) & known[doc]
    alive = _told(told_docs, told_keys, doc_ids, key | np.uint64(ALIVE)) & known[doc] & ~settled
    rows = np.flatnonzero(alive)
    starts, last = own_strings(doc, at, found["gram"], size[doc], rows)
    ends, grams = (last + LENGTH).tolist(), found["gram"][rows].view(np.int64).tolist()
    starts, cut = starts.tolist(), np.searchsorted(rows, first).tolist()
    spots = np.flatnonzero(settled)
    gone = np.searchsorted(spots, first).tolist()
    lows, highs = np.maximum(at[spots] - SPAN, 0), np.minimum(at[spots] + LENGTH, size[doc[spots]])
    none = np.zeros(0, np.int64)
    for k, (i, text) in enumerate(zip(ids, texts, strict=True)):
        lo, hi = _united(lows[gone[k] : gone[k + 1]], highs[gone[k] : gone[k + 1]]) if gone[k] < gone[k + 1] else (none, none)
        a, b = cut[k], cut[k + 1]
        if a == b:
            removed, runs, digest = _rest(text, lo, hi)
            add(kind=[0], doc_id=[i], n_bytes=[len(text)], n_removed=[removed], n_spans=[runs], kept_sha256=[digest])
            continue
        row, n = _row_id(text), b - a
        add(kind=[1], doc_id=[i], row=[row], n_bytes=[len(text)], text=[text.decode()], spans=[np.concatenate([lo, hi]).astype("<i8").tobytes()])
        contexts = [text[x:y] for x, y in zip(starts[a:b], ends[a:b], strict=True)]
        add(n, kind=[2] * n, doc_id=[i] * n, row=[row] * n, gram=grams[a:b], start=starts[a:b], context=contexts)


def ordered(keys: np.ndarray, bound: int) -> np.ndarray:
    """The order of keys from 0 to ``bound``, ties by place. Where both fit one number, keys are sorted with their places, which numpy does much faster."""
    bits = max(len(keys) - 1, 1).bit_length()
    if bound >= 1 << (63 - bits):
        return np.argsort(keys, kind="stable")
    return np.sort(keys << bits | np.arange(len(keys))) & ((1 << bits) - 1)


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffix array of positive symbols by the difference cover {1, 2} modulo 3."""
    n = len(s)
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    t = np.concatenate([s.astype(np.int64), [0, 0, 0]])
    one, two = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.concatenate([one, two])
    symbols = int(t.max()) + 1
    if symbols < 1 << 21:  # three symbols fit one number
        triple = (t[sample] * symbols + t[sample + 1]) * symbols + t[sample + 2]
    else:
        pairs = t[sample + 1] * symbols + t[sample + 2]
        triple = t[sample] * (len(sample) + 1) + np.unique(pairs, return_inverse=True)[1]
    order = ordered(triple, int(triple.max()))
    triple = triple[order]
    new = np.concatenate([[True], triple[1:] != triple[:-1]])
    names = np.empty(len(sample), np.int64)
    names[order] = np.cumsum(new)
    if new.sum() < len(sample):
        order = suffix_array(names)  # names of class 1, then of class 2, are a string with the same order
    sorted_sample = sample[order]
    rank = np.zeros(n + 3, np.int64)
    rank[sorted_sample] = np.arange(1, len(sample) + 1)
    zero = np.arange(0, n, 3)
    zero = zero[ordered(t[zero] * (n + 4) + rank[zero + 1], symbols * (n + 4))]
    ones, twos = sorted_sample[sorted_sample % 3 == 1], sorted_sample[sorted_sample % 3 == 2]
    width = np.int64(n + 4)
    before_one = np.searchsorted(t[ones] * width + rank[ones + 1], t[zero] * width + rank[zero + 1])
    tails = [t[x + 1] * width + rank[x + 2] for x in (twos, zero)]
    if symbols * symbols * (n + 4) < 1 << 63:  # two symbols and a rank fit one number
        width *= symbols
    else:
        _, tail = np.unique(np.concatenate(tails), return_inverse=True)
        tails = [tail[: len(twos)], tail[len(twos) :]]
    before_two = np.searchsorted(t[twos] * width + tails[0], t[zero] * width + tails[1])
    out = np.full(len(zero) + len(sample), -1, np.int64)
    out[np.arange(len(zero)) + before_one + before_two] = zero
    out[out < 0] = sorted_sample
    return out[out < n]


#: where eight bytes are taken to compare 50: the last eight overlap
_WORDS_AT = (*range(0, LENGTH - 7, 8), LENGTH - 8)


def equal_strings(contexts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, offset, class) of every 50-byte string in the contexts; equal strings have one class."""
    size = np.array([len(c) for c in contexts])
    text = np.frombuffer(b"\0".join(contexts) + b"\0", np.uint8)
    begin = np.cumsum(size + 1) - size - 1
    raw = text.astype(np.int64) + 2
    raw[begin + size] = 1  # the end of a context sorts before every byte
    order = suffix_array(raw)
    end = np.repeat(begin + size, size + 1)  # of the context that a byte is in
    order = order[(np.arange(len(raw)) + LENGTH <= end)[order]]
    owner = np.repeat(np.arange(len(contexts)), size + 1)[order]
    new = np.zeros(len(order), bool)
    new[:1] = True
    words = np.ndarray((max(len(text) - 7, 0),), "<u8", text, strides=(1,))  # eight bytes from each byte on
    for at in _WORDS_AT:
        word = words[order + at]
        new[1:] |= word[1:] != word[:-1]
    return owner, order - begin[owner], np.cumsum(new) - 1


_MATCHED = "doc_id long, row long, lo long, hi long, digest binary"


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of whole (gram, deal) groups; a run per matched stretch, and for dealt grams the strings that might match elsewhere."""

    def block(rows: list[tuple]) -> pa.RecordBatch:
        doc, start, deals = (np.array([r[k] for r in rows], np.int64) for k in (0, 2, 4))
        owner, offset, same = equal_strings([r[3] for r in rows])
        first = np.flatnonzero(np.concatenate([[True], same[1:] != same[:-1]])[: len(same)])
        least = np.repeat(np.minimum.reduceat(doc[owner], first), np.diff(np.append(first, len(same)))) if len(same) else same
        matched = doc[owner] > least
        o, p = owner[matched], (start[owner] + offset)[matched]
        order = np.lexsort((p, o))
        o, p = o[order], p[order]
        cut, ends = _runs((o[1:] != o[:-1]) | (p[1:] != p[:-1] + 1), len(o))
        last = ends - 1
        out = [(rows[k][0], rows[k][1], a, b + LENGTH, None) for k, a, b in zip(o[cut].tolist(), p[cut].tolist(), p[last].tolist(), strict=True)]
        for k, q in zip(owner[~matched & (deals[owner] > 1)].tolist(), offset[~matched & (deals[owner] > 1)].tolist(), strict=True):
            text = rows[k][3][q : q + LENGTH]
            out.append((rows[k][0], rows[k][1], rows[k][2] + q, rows[k][2] + q + LENGTH, hashlib.blake2b(text, digest_size=16).digest()))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], [f.split()[0] for f in _MATCHED.split(", ")])

    held, size, now = [], 0, None
    names = ("doc_id", "row", "start", "context", "deals", "gram", "deal")
    for batch in batches:
        for row in zip(*(batch[k].to_pylist() for k in names), strict=True):
            if row[5:] != now and size > BLOCK_SYMBOLS:
                yield block(held)
                held, size = [], 0
            now = row[5:]
            held.append(row)
            size += len(row[3]) + 1
    if held:
        yield block(held)


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of a document, then the document: its final row."""
    runs, now = [], None
    for batch in batches:
        out = []
        for i, row, text, spans, lo, hi in zip(*(batch[k].to_pylist() for k in ("doc_id", "row", "text", "spans", "lo", "hi")), strict=True):
            if (i, row) != now:
                runs, now = [], (i, row)
            if text is None:
                runs.append((lo, hi))
                continue
            raw = text.encode()
            known = np.frombuffer(spans, "<i8").reshape(2, -1)
            extra = np.array(runs, np.int64).reshape(-1, 2)
            removed = _rest(raw, *_united(np.concatenate([known[0], extra[:, 0]]), np.concatenate([known[1], extra[:, 1]])))
            out.append((i, len(raw), *removed))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names)


def remove_repeats(docs: DataFrame, hot: int = HOT, block_contexts: int = BLOCK_CONTEXTS) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256), one row per document."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    n_bytes = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = 1 + n_bytes // (BUCKET_ANCHORS * (SPAN + 2) // 2)
    workers = int(spark.conf.get("spark.sql.shuffle.partitions"))

    sent = docs.filter("doc_id IS NOT NULL").mapInArrow(_sent(buckets, hot), _PACK)
    judged = sent.repartition(workers, "bucket").sortWithinPartitions("bucket").mapInArrow(_judged(buckets), "part int, told binary")
    none = {name: F.lit(None).cast(kind).alias(name) for name, kind in (("doc_id", "long"), ("text", "string"), ("told", "binary"))}
    told = judged.select("part", F.lit(0).alias("kind"), none["doc_id"], none["text"], "told")
    part = F.coalesce(F.pmod("doc_id", F.lit(buckets)), F.lit(0)).cast("int").alias("part")
    rows = told.unionByName(docs.select(part, F.lit(1).alias("kind"), "doc_id", "text", none["told"]))
    located = rows.repartition(workers, "part").sortWithinPartitions("part", "kind").mapInArrow(_located, _FOUND)
    found = written(located, "repeats", compression="zstd")

    contexts = found.filter("kind = 2").select("gram", "doc_id", "row", "start", "context")
    many = contexts.groupBy("gram").agg(F.ceil(F.count("*") / block_contexts).alias("deals")).filter("deals > 1")
    # one of ``block_contexts`` contexts at most is a row of ``many``, so the contexts are dealt where they are, without a shuffle of their own
    dealt = contexts.join(F.broadcast(many), "gram", "left").withColumn("deals", F.coalesce("deals", F.lit(1)))
    dealt = dealt.withColumn("deal", F.pmod(F.xxhash64("doc_id"), F.col("deals")))
    blocks = dealt.repartition(workers, "gram", "deal").sortWithinPartitions("gram", "deal").mapInArrow(_compared, _MATCHED)
    matched = written(blocks, "repeats-matched", compression="zstd")

    strings = matched.filter("digest IS NOT NULL")
    least = strings.groupBy("digest").agg(F.min("doc_id").alias("least"))
    across = strings.join(least, "digest").filter("doc_id > least")
    runs = matched.filter("digest IS NULL").unionByName(across.drop("least")).select("doc_id", "row", "lo", "hi")

    whole = found.filter("kind = 1").select("doc_id", "row", "text", "spans")
    both = whole.unionByName(runs, allowMissingColumns=True).repartition(workers, "doc_id")
    ordered = both.sortWithinPartitions("doc_id", "row", F.col("text").isNotNull())
    rest = ordered.mapInArrow(_removed, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return found.filter("kind = 0").select(rest.columns).unionByName(rest)
