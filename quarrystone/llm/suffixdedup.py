"""Suffix-array dedup: remove what repeats from documents with smaller ids.

A byte goes if a string of ``length`` bytes that covers it also starts in a
document with a smaller id. Which strings are equal is read off suffix arrays;
which suffixes have to be sorted together is found first, over all documents:

1. Every window of ``length`` bytes holds one anchor, its k-gram of least hash,
   so equal windows have equal anchors. Documents are dealt into groups of a
   few MB, and each sends the hashes of its anchors to buckets.
2. A bucket tells each group which of its anchors other documents have too, and
   which of those are frequent.
3. Groups send the stretches around shared anchors, each different one once
   with its least id, to buckets again. Equal stretches merge there. Windows
   that more than one stretch has, by hash, are suffix sorted in pieces, and
   windows adjacent in the order that agree in ``length`` bytes are one string;
   its least id is the least of all stretches that hold it.
4. Groups get the least ids back and cut their documents.

A passage in a third of all documents is sent once by each group. A frequent
anchor, say of a common phrase with other words around it everywhere, would
bring all its stretches to one bucket: these are dealt by the ``FINE`` least
k-grams of a window instead, which equal windows share as well. Groups and
buckets grow in number with the input, not in size.

Rows travel as Arrow tables, so ids and passed columns are never converted.
"""

from __future__ import annotations

import ctypes
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns, table
from .gsaca import suffix_array

LENGTH = 50
#: Bytes of an anchor.
ANCHOR = 16
#: Text bytes of a group and of a bucket's share, about.
GROUP_BYTES = 4_000_000
BUCKET_BYTES = 3_000_000
#: Bytes of stretches that are suffix sorted at a time; equal windows are never apart, as pieces are cut by window hash.
SORT_BYTES = 2_000_000
#: Runs of windows at an anchor, over all documents, from which on it is frequent; so many stretches are about half a bucket's share.
FREQUENT = 16_384
#: Least k-grams of a window by which windows at a frequent anchor are dealt.
FINE = 4
#: Bytes of text whose hashes are held at a time.
_SLAB = 1 << 16
_NO_ID = np.iinfo(np.int64).max
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_LAST24 = _U((1 << 24) - 1)
#: Bytes of an anchor's hash that are sent; two anchors taken for one only send more than is needed.
_HASH_BYTES = 6


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(31))) * _U(0x7FB5D329728EA185)
    h = (h ^ (h >> _U(27))) * _U(0x81DADEF4BC2DD44D)
    return h ^ (h >> _U(33))


def gram_hashes(raw: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of the k bytes from each position on."""
    power = {1: raw.astype(_U) + _U(1)}
    size = 1
    while size * 2 <= k:
        power[size * 2] = _joined(power[size], size, power[size], size)
        size *= 2
    out, have = power[size], size
    for part in sorted(power, reverse=True):
        if have + part <= k and (k - have) & part:
            out, have = _joined(out, have, power[part], part), have + part
    return _mixed(out)


def _joined(x: np.ndarray, nx: int, y: np.ndarray, ny: int) -> np.ndarray:
    n = max(0, min(len(x), len(y) - nx))
    return x[:n] * _U(pow(_BASE, ny, 1 << 64)) + y[nx : nx + n]


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of ``width`` keys from each position on."""
    size = 1
    while size * 2 <= width:
        keys, size = np.minimum(keys[:-size], keys[size:]), size * 2
    return np.minimum(keys[: len(keys) - (width - size)], keys[width - size :]) if width > size else keys


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64."""
    up, down = np.full(n, _U(_BASE)), np.full(n, _U(pow(_BASE, -1, 1 << 64)))
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


_BYTE = np.random.default_rng(11).integers(0, 1 << 63, 256, np.uint64) * _U(2) + _U(1)


class _Keys:
    """Keys of the stretches of a piece of text: a 64-bit polynomial hash of the bytes mixed with the anchor's."""

    def __init__(self, length: int):
        self.length = length
        self.up, self.down = _powers(_SLAB + length)

    def __call__(self, piece: np.ndarray, begin: np.ndarray, counts: np.ndarray, anchors: np.ndarray) -> np.ndarray:
        sums = np.concatenate((np.zeros(1, _U), np.cumsum(_BYTE[piece] * self.up[: len(piece)])))
        stretch = (sums[begin + counts - 1 + self.length] - sums[begin]) * self.down[begin]
        return _mixed(stretch + anchors * _U(3) + counts.astype(_U))


def _sent(anchors: np.ndarray) -> np.ndarray:
    return anchors >> _U(64 - 8 * _HASH_BYTES)


def runs(raw: np.ndarray, ends: np.ndarray, length: int, keyed: bool = True, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first window, number of windows, key) for each run of windows that share an anchor.

    ``raw`` holds documents one after the other and ``ends`` the end of its
    document for each byte; no window crosses one. ``key`` stands for the
    bytes of the run; 0 unless ``keyed``. No run crosses a slab.
    """
    found: list[list[np.ndarray]] = [[], [], [], []]
    keys_of = _Keys(length)
    for a in range(0, max(0, len(raw) - length + 1), _SLAB):
        piece = raw[a : a + _SLAB + length - 1]
        grams = gram_hashes(piece, anchor)
        keys = (grams >> _U(24) << _U(24)) | np.arange(len(grams), dtype=_U)
        at = (_least(keys, length - anchor + 1) & _LAST24).astype(np.int64)
        valid = np.flatnonzero(ends[a : a + len(at)] - np.arange(a, a + len(at)) >= length)
        if not len(valid):
            continue
        own = at[valid]
        first = np.flatnonzero(np.concatenate(([True], (own[1:] != own[:-1]) | (valid[1:] != valid[:-1] + 1))))
        counts = np.diff(np.append(first, len(valid)))
        begin = valid[first]
        anchors = grams[own[first]]
        key = keys_of(piece, begin, counts, anchors) if keyed else np.zeros(len(begin), _U)
        for to, part in zip(found, (_sent(anchors), begin + a, counts, key), strict=True):
            to.append(part)
    kinds = (_U, np.int64, np.int64, _U)
    return tuple(np.concatenate(f) if f else np.zeros(0, k) for f, k in zip(found, kinds, strict=True))


def finer_runs(raw: np.ndarray, anchors: np.ndarray, first: np.ndarray, counts: np.ndarray, length: int, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs cut where the ``FINE`` least k-grams of their windows change: (hash of those and the anchor, first, number, key, run it was cut from)."""
    found: list[list[np.ndarray]] = [[], [], [], [], []]
    keys_of, grams_in = _Keys(length), length - anchor + 1
    slab = first // _SLAB
    for number in np.unique(slab).tolist():
        own = np.flatnonzero(slab == number)
        a = number * _SLAB
        piece = raw[a : a + _SLAB + length - 1]
        grams = gram_hashes(piece, anchor)
        of = np.repeat(own, counts[own])
        windows = np.repeat(first[own] - a - np.concatenate(([0], np.cumsum(counts[own])[:-1])), counts[own]) + np.arange(len(of))
        tags = np.empty(len(of), _U)
        views = sliding_window_view(grams, grams_in)
        for i in range(0, len(of), 4096):
            least = np.partition(views[windows[i : i + 4096]], FINE - 1, axis=1)[:, :FINE]
            tags[i : i + 4096] = _mixed(_mixed(least).sum(1, dtype=_U) + anchors[of[i : i + 4096]])
        head = np.flatnonzero(np.concatenate(([True], (tags[1:] != tags[:-1]) | (of[1:] != of[:-1]))))
        n = np.diff(np.append(head, len(of)))
        for to, part in zip(found, (_sent(tags[head]), windows[head] + a, n, keys_of(piece, windows[head], n, tags[head]), of[head]), strict=True):
            to.append(part)
    kinds = (_U, np.int64, np.int64, _U, np.int64)
    return tuple(np.concatenate(f) if f else np.zeros(0, k) for f, k in zip(found, kinds, strict=True))


def _in(values: np.ndarray, members: np.ndarray) -> np.ndarray:
    """Which values are among the sorted members."""
    if not len(members):
        return np.zeros(len(values), bool)
    at = np.searchsorted(members, values)
    at[at == len(members)] = 0
    return members[at] == values


class _Group:
    """Documents of a group, a table with columns id and text, in the order of their ids, one after the other."""

    def __init__(self, rows: pa.Table, length: int, keyed: bool = True):
        self.length = length
        ids = rows["id"].fill_null(_NO_ID).to_numpy()
        self.order = np.argsort(ids, kind="stable")
        self.ids = ids[self.order]
        texts = rows["text"].take(pa.array(self.order)).fill_null(b"").combine_chunks()
        _, at, data = texts.buffers()
        width = np.int64 if pa.types.is_large_binary(texts.type) else np.int32
        borders = np.frombuffer(at, width)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
        self.raw = np.frombuffer(data, np.uint8)[borders[0] : borders[-1]] if data is not None else np.zeros(0, np.uint8)
        self.begins, self.ends = borders[:-1] - borders[0], borders[1:] - borders[0]
        self.anchors, self.first, self.counts, self.keys = runs(self.raw, np.repeat(self.ends.astype(np.int32 if len(self.raw) < 1 << 31 else np.int64), self.ends - self.begins), length, keyed)
        self.docs = np.searchsorted(self.ends, self.first, side="right")

    def anchor_sets(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Anchors, sorted; whether more than one document of the group has them; their runs, 255 at most."""
        order = np.argsort(self.anchors, kind="stable")
        own, docs = self.anchors[order], self.docs[order]
        head = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1]))) if len(own) else np.zeros(0, np.int64)
        last = np.append(head, len(own))[1:] - 1
        return own[head], docs[head] != docs[last], np.minimum(last + 1 - head, 255).astype(np.uint8)

    def keep(self, shared: np.ndarray, frequent: np.ndarray) -> None:
        """Only the runs at shared anchors stay, finer ones at frequent anchors; ``number`` tells which have the same bytes."""
        at = np.flatnonzero(_in(self.anchors, shared))
        often = _in(self.anchors[at], frequent)
        cut, at = at[often], at[~often]
        finer = finer_runs(self.raw, self.anchors[cut], self.first[cut], self.counts[cut], self.length)
        parts = zip((self.anchors, self.first, self.counts, self.keys), finer, strict=False)
        docs = np.concatenate((self.docs[at], self.docs[cut][finer[4]]))
        self.anchors, self.first, self.counts, self.keys = (np.concatenate((x[at], y)) for x, y in parts)
        # In the order of documents, which come by id, so the first run of a number has its least id.
        order = np.argsort(self.first, kind="stable")
        self.anchors, self.first, self.counts, self.keys = (x[order] for x in (self.anchors, self.first, self.counts, self.keys))
        self.docs = docs[order]
        _, self.head, self.number = np.unique(self.keys, return_index=True, return_inverse=True)


def _pack(*arrays: np.ndarray | bytes) -> bytes:
    parts = [a if isinstance(a, bytes) else a.tobytes() for a in arrays]
    body = b"".join(parts)
    return struct.pack(f"<{len(parts)}q", *map(len, parts)) + pa.compress(body, "zstd", asbytes=True)


def _unpack(blob: bytes, n: int) -> list[bytes]:
    sizes = struct.unpack_from(f"<{n}q", blob)
    body, at, out = pa.decompress(memoryview(blob)[8 * n :], sum(sizes), "zstd", asbytes=True), 0, []
    for size in sizes:
        out.append(body[at : at + size])
        at += size
    return out


def _planes(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of integers, byte by byte, so that equal high bytes compress away."""
    return np.ascontiguousarray(values.astype("<i8" if values.dtype.kind == "i" else "<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _from_planes(blob: bytes, width: int, kind=np.int64) -> np.ndarray:
    out = np.zeros((len(blob) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(blob, np.uint8).reshape(width, -1).T
    return out.view(kind).ravel()


def _hashes(blob: bytes) -> np.ndarray:
    return _from_planes(blob, _HASH_BYTES, _U)


def _steps(ascending: np.ndarray) -> bytes:
    return _planes(np.diff(ascending, prepend=0).astype(np.int64), 4)


def _from_steps(blob: bytes) -> np.ndarray:
    return np.cumsum(_from_planes(blob, 4))


def equal_windows(stretches: list[bytes], length: int = LENGTH, sort_bytes: int = SORT_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, labels) of windows that occur in more than one place of ``stretches``, which differ from each other.

    Places are offsets in the concatenation of all stretches; windows of one
    label are one string, and the windows of a string come in one piece.
    """
    joined = b"".join(stretches)
    raw = np.frombuffer(joined, np.uint8)
    if len(raw) < length:
        return
    kind = np.int32 if len(raw) < 1 << 31 else np.int64
    sizes = np.array([len(s) for s in stretches], kind)
    end_of = np.repeat(np.cumsum(sizes, dtype=kind), sizes)
    starts = np.flatnonzero(end_of - np.arange(len(raw), dtype=kind) >= length).astype(kind)
    # In slabs, as hashing holds many times what it hashes.
    hashed = np.concatenate([gram_hashes(raw[a : a + _SLAB + length - 1], length) for a in range(0, len(raw) - length + 1, _SLAB)])[starts]
    twice = np.sort(hashed)
    twice = np.unique(twice[1:][twice[1:] == twice[:-1]])
    again = _in(hashed, twice)
    starts, hashed = starts[again].astype(np.int64), hashed[again]
    pieces = max(1, -(-len(starts) * 3 // sort_bytes))
    part = (hashed >> _U(32)) % _U(pieces)
    for p in range(pieces):
        chosen = starts[part == p]
        if not len(chosen):
            continue
        # Neighbouring windows of a stretch are one text to sort, and equal texts are sorted once.
        cut = np.flatnonzero(np.concatenate(([True], (chosen[1:] != chosen[:-1] + 1) | (end_of[chosen[1:]] != end_of[chosen[:-1]]))))
        counts = np.diff(np.append(cut, len(chosen)))
        texts: dict[bytes, int] = {}
        at, begins = 0, np.empty(len(cut), np.int64)
        for i, (a, c) in enumerate(zip(chosen[cut].tolist(), counts.tolist(), strict=True)):
            t = joined[a : a + c - 1 + length]
            begins[i] = begin = texts.setdefault(t, at)
            if begin == at:
                at += len(t) + 1
        text = b"\xff".join(texts)  # a byte that UTF-8 never has
        place = np.repeat(begins - cut, counts) + np.arange(len(chosen))
        window = np.zeros(len(text), bool)
        window[place] = True
        ranked = suffix_array(text)
        ranked = ranked[window[ranked]]
        views = sliding_window_view(np.frombuffer(text, np.uint8), length)
        new = np.ones(len(ranked), np.int64)
        for i in range(1, len(ranked), 8192):
            rows = views[ranked[i - 1 : i + 8192]]
            new[i : i + 8192] = (rows[1:] != rows[:-1]).any(1)
        label = np.zeros(len(text), np.int64)
        label[ranked] = np.cumsum(new) - 1
        yield chosen, label[place]


def _release() -> None:
    """Give back what the last group held: workers are reused, and what they hold counts."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def _blobs(rows: pa.Table) -> list[bytes]:
    return rows["blob"].to_pylist()


_BLOB = pa.schema([("bucket", pa.int64()), ("g", pa.int64()), ("blob", pa.binary())])
_LIST = pa.schema([("g", pa.int64()), ("blob", pa.binary())])
_NOTED = pa.schema([("g", pa.int64()), ("note", pa.bool_()), ("blob", pa.binary())])


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.table([[r[i] for r in rows] for i in range(len(schema))], schema=schema)


def _find_shared(rows: pa.Table, frequent: int) -> pa.Table:
    """Of a bucket's anchors, by group: those that more than one document has, and those of them that are frequent."""
    lists = []
    for blob in _blobs(rows):
        own, several, n = _unpack(blob, 3)
        lists.append((_hashes(own), np.frombuffer(several, bool), np.frombuffer(n, np.uint8)))
    every, which = np.unique(np.concatenate([own for own, _, _ in lists]), return_inverse=True)
    groups = np.bincount(which, minlength=len(every))
    inside = np.bincount(which, weights=np.concatenate([several for _, several, _ in lists]), minlength=len(every))
    often = np.bincount(which, weights=np.concatenate([n for _, _, n in lists]), minlength=len(every))
    shared = (groups > 1) | (inside > 0)
    told = every[shared], every[shared & (often >= frequent)]
    kept = [(g, [own[_in(own, some)] for some in told]) for g, (own, _, _) in zip(rows["g"].to_pylist(), lists, strict=True)]
    return _table([(g, _pack(*[_planes(k, _HASH_BYTES) for k in own])) for g, own in kept if len(own[0])], _LIST)


def _least_ids(rows: pa.Table, length: int) -> pa.Table:
    """For each group the least ids of the windows of the stretches it sent."""
    own: dict[bytes, int] = {}
    least: list[int] = []
    sent = []
    for g, blob in zip(rows["g"].to_pylist(), _blobs(rows), strict=True):
        numbers, ids, sizes, text = _unpack(blob, 4)
        ids, sizes = _from_planes(ids, 8).tolist(), _from_planes(sizes, 4)
        at, mine = 0, np.empty(len(ids), np.int64)
        for i, size in enumerate(sizes.tolist()):
            s = text[at : at + size]
            at += size
            n = own.setdefault(s, len(least))
            if n == len(least):
                least.append(ids[i])
            elif ids[i] < least[n]:
                least[n] = ids[i]
            mine[i] = n
        sent.append((g, numbers, mine))
    stretches = list(own)
    sizes = np.array([len(s) for s in stretches], np.int64)
    begins = np.cumsum(sizes) - sizes
    at_place = np.repeat(np.array(least, np.int64), sizes)
    # Windows that only copies of one stretch have keep its least id; the others share the least of theirs.
    changed = np.zeros(len(sizes), bool)
    stretch_of = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    for places, labels in equal_windows(stretches, length):
        low = np.full(labels.max() + 1, _NO_ID)
        np.minimum.at(low, labels, at_place[places])
        changed[stretch_of[places[at_place[places] != low[labels]]]] = True
        at_place[places] = low[labels]
    out = []
    plain = np.array(least, np.int64)
    for g, numbers, mine in sent:
        apart = np.flatnonzero(changed[mine])
        detail = [at_place[begins[n] : begins[n] + sizes[n] - length + 1] for n in mine[apart].tolist()]
        counts = np.array([len(d) for d in detail], np.int32)
        out.append((g, False, _pack(numbers, _planes(plain[mine], 8), apart.astype(np.int32), counts, _planes(np.concatenate(detail), 8) if detail else b"")))
    return _table(out, _NOTED)


def _whole_letters(raw: np.ndarray, a: int, b: int, x: int, y: int) -> tuple[int, int]:
    """The span [x, y) of the text [a, b), wider by the bytes of UTF-8 letters that it cuts in two."""
    while x > a and raw[x] & 0xC0 == 0x80:
        x -= 1
    while y < b and raw[y] & 0xC0 == 0x80:
        y += 1
    return x, y


def _dedup(docs: DataFrame, id_col: str, text_col: str, length: int, keep: list[str], letters: bool, group_bytes: int, frequent: int) -> DataFrame:
    """(id, n_bytes, spans, kept, keep0, keep1, ...), whatever the names of the columns in ``keep``."""
    kinds = dict(docs.dtypes)
    of = dict(zip(docs.columns, columns(docs), strict=True))
    total = docs.agg(F.sum(F.octet_length(of[text_col].cast("string")))).first()[0] or 0
    groups, buckets = max(1, -(-total // group_bytes)), max(1, -(-total // BUCKET_BYTES))
    dealt = docs.select(of[id_col].cast("long").alias("id"), of[text_col].cast("string").cast("binary").alias("text"), *[of[c].alias(f"keep{i}") for i, c in enumerate(keep)])
    # One exchange serves all passes over the documents, so it has all columns.
    dealt = dealt.withColumn("g", F.pmod(F.xxhash64("id", "text"), F.lit(groups))).groupBy("g")

    def of_bucket(hashes: np.ndarray) -> np.ndarray:
        return (hashes % _U(buckets)).astype(np.int64)

    def send_anchors(rows: pa.Table) -> pa.Table:
        _release()
        every, several, n = _Group(rows, length, keyed=False).anchor_sets()
        g, to = rows["g"][0].as_py(), of_bucket(every)
        order = np.argsort(to, kind="stable")
        every, several, n, to = every[order], several[order], n[order], to[order]
        starts = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1]))) if len(to) else np.zeros(0, np.int64)
        ends = np.append(starts, len(to))[1:]
        return _table([(int(to[a]), g, _pack(_planes(every[a:z], _HASH_BYTES), several[a:z], n[a:z])) for a, z in zip(starts.tolist(), ends.tolist(), strict=True)], _BLOB)

    def send_stretches(key, rows: pa.Table, lists: pa.Table) -> pa.Table:
        if not len(rows) or not len(lists):
            return _table([], _BLOB)
        _release()
        g, told = key[0].as_py(), [_unpack(b, 2) for b in _blobs(lists)]
        shared, often = (np.unique(np.concatenate([_hashes(own[i]) for own in told])) for i in (0, 1))
        group = _Group(rows, length)
        group.keep(shared, often)
        head = group.head
        ids, sizes = group.ids[group.docs[head]], (group.counts[head] - 1 + length).astype(np.int32)
        begins, out = group.first[head], [(-1 - g, g, _pack(_planes(shared, _HASH_BYTES), _planes(often, _HASH_BYTES)))]
        to, text = of_bucket(group.anchors[head]), group.raw.tobytes()
        order = np.argsort(to, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(to[order])) + 1) if len(order) else []:
            sent = b"".join([text[x:y] for x, y in zip(begins[own].tolist(), (begins[own] + sizes[own]).tolist(), strict=True)])
            out.append((int(to[own[0]]), g, _pack(_steps(own), _planes(ids[own], 8), _planes(sizes[own], 4), sent)))
        return _table(out, _BLOB)

    def sort_bucket(rows: pa.Table) -> pa.Table:
        if rows["bucket"][0].as_py() < 0:  # a group's note to itself
            return _table([(g, True, blob) for g, blob in zip(rows["g"].to_pylist(), _blobs(rows), strict=True)], _NOTED)
        _release()
        return _least_ids(rows, length)

    def cut(key, rows: pa.Table, results: pa.Table) -> pa.Table:
        _release()
        group = _Group(rows, length)
        told = list(zip(results["note"].to_pylist(), _blobs(results), strict=True))
        notes = [blob for note, blob in told if note]
        spans: list[list[dict]] = [[] for _ in range(len(group.ids))]
        kept = [group.raw[a:b].tobytes() for a, b in zip(group.begins.tolist(), group.ends.tolist(), strict=True)]
        if notes:
            group.keep(*[_hashes(x) for x in _unpack(notes[0], 2)])
            plain, detail = np.full(len(group.head), _NO_ID), {}
            for note, blob in told:
                if not note:
                    own, least, apart, counts, values = _unpack(blob, 5)
                    own = _from_steps(own)
                    plain[own] = _from_planes(least, 8)
                    at, values = 0, _from_planes(values, 8)
                    for i, n in zip(own[np.frombuffer(apart, np.int32)].tolist(), np.frombuffer(counts, np.int32).tolist(), strict=True):
                        detail[i] = values[at : at + n]
                        at += n
            own_id = group.ids[group.docs]
            special = np.isin(group.number, np.fromiter(detail, np.int64, len(detail)))
            whole = np.flatnonzero(~special & (plain[group.number] < own_id))
            gone, upto = [group.first[whole]], [group.first[whole] + group.counts[whole] - 1 + length]
            for r in np.flatnonzero(special).tolist():
                at = np.flatnonzero(detail[int(group.number[r])] < own_id[r]) + group.first[r]
                gone.append(at)
                upto.append(at + length)
            edge = np.zeros(len(group.raw) + 1, np.int32)
            np.add.at(edge, np.concatenate(gone), 1)
            np.add.at(edge, np.concatenate(upto), -1)
            removed = np.cumsum(edge[:-1], dtype=np.int32) > 0
            # No window crosses documents, but two removed runs may meet at a border.
            for d in np.unique(np.searchsorted(group.ends, np.flatnonzero(removed), side="right")).tolist():
                a, b = int(group.begins[d]), int(group.ends[d])
                own = removed[a:b]
                turns = np.flatnonzero(np.diff(np.concatenate(([0], own.view(np.int8), [0]))))
                spans[d] = [{"start": x, "end": y} for x, y in zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True)]
                if letters:
                    own = own.copy()
                    for s in spans[d]:
                        x, y = _whole_letters(group.raw, a, b, a + s["start"], a + s["end"])
                        own[x - a : y - a] = True
                kept[d] = group.raw[a:b][~own].tobytes()
        order = pa.array(group.order)
        passed = {f"keep{i}": rows[f"keep{i}"].take(order) for i in range(len(keep))}
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        made = {"n_bytes": pa.array(group.ends - group.begins), "spans": pa.array(spans, span), "kept": pa.array(kept, rows["text"].type)}
        return pa.table({"id": rows["id"].take(order), **passed, **made})

    blob = "bucket long, g long, blob binary"
    lists = dealt.applyInArrow(send_anchors, blob).groupBy("bucket").applyInArrow(lambda rows: _find_shared(rows, frequent), "g long, blob binary")
    sent = dealt.cogroup(lists.groupBy("g")).applyInArrow(send_stretches, blob)
    results = sent.groupBy("bucket").applyInArrow(sort_bucket, "g long, note boolean, blob binary")
    out = ", ".join(["id long", *[f"keep{i} {kinds[c]}" for i, c in enumerate(keep)], "n_bytes long", "spans array<struct<start: long, end: long>>", "kept binary"])
    return dealt.cogroup(results.groupBy("g")).applyInArrow(cut, out)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, keep: tuple[str, ...] = (), letters: bool = False, group_bytes: int = GROUP_BYTES, frequent: int = FREQUENT) -> DataFrame:
    """For each row: id, n_bytes, spans (removed byte ranges [start, end), maximal), kept (the other bytes) and ``keep``.

    With ``letters`` a UTF-8 letter of which a byte goes is left out of
    ``kept`` as a whole; spans are as they are.

    Null texts are empty. A null id counts as larger than any other (so
    2^63 - 1 is not to be used as one); rows of one id, and rows of null ids,
    remove nothing from each other. Texts shorter than ``length`` bytes stay
    whole. Columns named in ``keep`` are passed on unchanged under their
    names, others are ignored; an empty table gives an empty one.
    """
    found = _dedup(docs, id_col, text_col, length, list(keep), letters, group_bytes, frequent)
    return found.select("id", "n_bytes", "spans", "kept", *[F.col(f"keep{i}").alias(c) for i, c in enumerate(keep)])


def op8_suffixdedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return dedup(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "n_bytes", gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: texts without what they repeat from documents with smaller ids, ``n_chars`` to match.

    A character of which a byte goes goes whole. Documents of which nothing
    but white space is left go, null and empty texts among them. All other
    columns are passed on unchanged, whatever their names; a null id counts as
    the largest, repeated rows lose nothing to each other, and an empty table
    gives an empty one.
    """
    rest = [c for c, kind in docs.dtypes if c not in ("text", "n_chars") and kind != "void"]
    found = _dedup(docs, "doc_id", "text", LENGTH, rest, True, GROUP_BYTES, FREQUENT)
    text = F.col("kept").cast("string")
    made = {c: F.col(f"keep{i}") for i, c in enumerate(rest)} | {"text": text, "n_chars": F.char_length(text).cast("long")}
    return found.where(text.rlike(r"[^\x20\x09-\x0D]")).select(*[made.get(c, F.lit(None)).alias(c) for c in docs.columns])


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents),
p AS (SELECT rid, doc_id, n, b, substr(h, 2 * b + 1, 1098) AS part FROM (SELECT *, unnest(range(0, greatest(n - 49, 0), 500)) AS b FROM d)),
w AS (SELECT rid, doc_id, b + s AS s, md5_number(substr(part, 2 * s + 1, 100)) AS k FROM (SELECT *, unnest(range(0, least(500, n - 49 - b))) AS s FROM p)),
m AS (SELECT k, min(doc_id) AS first_doc FROM w GROUP BY k),
r AS (SELECT w.rid, w.s FROM w JOIN m USING (k) WHERE m.first_doc < w.doc_id OR (w.doc_id IS NULL AND m.first_doc IS NOT NULL)),
i AS (SELECT rid, s, CASE WHEN s <= max(s) OVER (PARTITION BY rid ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 50 THEN 0 ELSE 1 END AS opens FROM r),
j AS (SELECT rid, s, sum(opens) OVER (PARTITION BY rid ORDER BY s) AS span FROM i),
x AS (SELECT rid, span, min(s) AS a, max(s) + 50 AS b FROM j GROUP BY rid, span),
g AS (SELECT rid, a, b, coalesce(lag(b) OVER (PARTITION BY rid ORDER BY a), 0) AS before FROM x),
c AS (SELECT g.rid, CAST(sum(b - a) AS BIGINT) AS gone, count(*) AS spans, string_agg(h[2 * before + 1:2 * a], '' ORDER BY a) || any_value(h[2 * (SELECT max(x.b) FROM x WHERE x.rid = g.rid) + 1:]) AS kept
  FROM g JOIN d USING (rid) GROUP BY g.rid)
SELECT doc_id, n AS n_bytes, coalesce(gone, 0) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN c USING (rid)
"""
