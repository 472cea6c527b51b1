"""Removal of byte strings that an earlier document holds, by sparse suffix arrays of content shards.

A byte goes if a string of ``LENGTH`` bytes covers it that also starts in a document with a smaller id.

1. Documents are dealt over text shards, which are written once as a bucketed table: later stages read a shard's texts
   where they lie and shuffle only messages.
2. Exact copies of a text are found by SHA-256 (ids and names only); only the copy with the least id is searched, the others
   go whole.
3. Every ``LENGTH``-byte string has an anchor: its ``GRAM``-byte part with the least hash (the last of equals).  Equal
   strings have equal anchors in the same place, and strings that start side by side mostly share one.  Text shards
   send the set of their anchors' hashes, and get back those that other shards have too.
4. Around anchors with company the distinct snippets of a text shard go, with their least and largest id, as rows to a
   content shard named by the anchor: all places of a string meet there, and a passage counts once a text shard however
   often it stands in it.  An anchor with over ``HOT`` snippets (a menu line in ever other surroundings) is split:
   its strings are named by themselves, those with company are found by a second exchange of hashes, and only these
   go, dealt over all content shards.
5. A content shard keeps a sparse suffix array: the suffixes that begin at anchors, sorted with their shared lengths, and the same of
   the texts before anchors read backwards.  A string equals those that lie in one run of both orders; the least id among
   them is what a place must be compared with.  Equal snippets are one before that, and one that is alone with its anchor
   needs no sorting: its strings are nowhere else.
6. Text shards get the least ids for their snippets and cut the covered bytes.

No step puts all places of a string in one row set: hashes and snippets are made distinct in their text shard before
they are shuffled, so the rows of one passage are at most one a text shard.  Shards are sized by the bytes of the input.

Result: a row a document: doc_id, n_bytes, removed_from[], removed_to[] (maximal byte ranges) and kept (the other bytes).

Defined cases: a null text is empty; nothing is removed from a row with a null id, and it removes nothing; texts
shorter than ``LENGTH`` stay; rows with one id never remove from each other; repeated rows are judged each and dealt over
the shards by row; a very long text is held whole by one task, in a shard with a few others; an empty table gives an
empty result; other columns are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytetext import BYTE_KEYS, edges, mix64, powers, slices, spread, utf8
from .tables import bucketed, salted_join, saved, table

LENGTH, GRAM = 50, 20
SHARD_BYTES, CONTENT_BYTES, HASH_BYTES = 6 << 20, 16 << 20, 256 << 20  # input a shard of texts, of snippets, of hashes stands for
HOT = 20_000
SLICE, PIECE = 1 << 17, 1 << 16  # bytes hashed, snippets sorted at once
ANCHOR, STRING, COPY, ANSWER = range(4)  # kinds of messages to a text shard
PACKED = "shard int, payload binary, ids array<long>, names array<binary>"
HASHES = "bucket long, shard int, h binary, n binary"
SNIPPETS = "bucket int, shard int, run int, skip int, lead byte, name long, anchor long, least long, most long, text binary"
ANSWERS = "shard int, run int, start int, stop int, least long"
RESULT = "doc_id long, n_bytes long, removed_from array<long>, removed_to array<long>, kept binary"
_OPTIONS = pa.ipc.IpcWriteOptions(compression="zstd")


def packed(**columns) -> bytes:
    """Columns as one compressed Arrow stream."""
    batch = pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], list(columns))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=_OPTIONS) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpacked(payload) -> pa.Table:
    return pa.ipc.open_stream(payload if isinstance(payload, pa.Buffer) else pa.py_buffer(payload)).read_all()


def rows_of(found: list[dict], schema: str) -> pa.Table:
    kinds = {"byte": pa.int8(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<binary>": pa.list_(pa.binary())}
    names = [c.split() for c in schema.split(", ")]
    return pa.table({n: pa.array([r[n] for r in found], kinds[k]) for n, k in names})


class Shard:
    """The documents of a text shard in a fixed order, and the anchors of those that are searched."""

    def __init__(self, frames: pa.Table, messages: pa.Table):
        copies = messages.filter(pc.equal(messages.column("kind"), COPY))
        first = dict(zip(copies.column("h").to_pylist(), copies.column("bucket").to_pylist(), strict=True))
        parts = pa.concat_tables([unpacked(p.as_buffer()) for p in frames.column("payload")]).combine_chunks()
        ids, size, names = parts.column("doc_id").to_pylist(), parts.column("n_bytes").to_numpy(), parts.column("name").to_pylist()
        data, at = utf8(parts.column("data"))
        raw = data.tobytes()
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, size[i], raw[at[i] : at[i + 1]]))
        self.ids, self.size = [ids[i] for i in order], size[order]
        self.copied = np.array([ids[i] is not None and names[i] in first and first[names[i]] < ids[i] for i in order], bool)
        held = np.where(self.copied, 0, (at[1:] - at[:-1])[order])  # a copy goes whole and is not searched
        self.offsets = np.concatenate([[0], np.cumsum(held)])
        self.data = np.frombuffer(b"".join([raw[at[i] : at[i] + n] for i, n in zip(order, held.tolist(), strict=True)]), np.uint8)
        self.searched = np.array([i is not None for i in self.ids], bool) & (held >= LENGTH)
        self.number = np.array([i if i is not None else 0 for i in self.ids], np.int64)
        self._find_anchors()

    def _find_anchors(self) -> None:
        """Runs of string starts with one anchor: first and last start, anchor hash, snippet hash."""
        first, last, lead, anchor, name = [], [], [], [], []
        width = LENGTH - GRAM + 1
        for i, j in slices(self.offsets, SLICE):
            base = int(self.offsets[i])
            data, n = self.data[base : self.offsets[j]], int(self.offsets[j]) - base
            if n < LENGTH:
                continue
            up, down = powers(n + 1)
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(BYTE_KEYS[data] * up[:n], out=sums[1:])
            h = mix64((sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1])
            low = np.uint64(0xFFFFFFFF)
            key = (h & ~low) | (low - np.arange(len(h), dtype=np.uint64))  # the least hash, then the last place
            m = 1
            while 2 * m <= width:
                key = np.minimum(key[:-m], key[m:])
                m *= 2
            key = np.minimum(key[: len(key) - (width - m)], key[width - m :])
            place = (low - (key & low)).astype(np.int64)  # of the anchor, for every start
            ok = np.zeros(n - LENGTH + 1, bool)
            for d in range(i, j):
                if self.searched[d]:
                    ok[self.offsets[d] - base : self.offsets[d + 1] - base - LENGTH + 1] = True
            new = ok.copy()
            new[1:] &= ~ok[:-1] | (place[1:] != place[:-1])
            stop = ok.copy()
            stop[:-1] &= ~ok[1:] | (place[1:] != place[:-1])
            a, b = np.flatnonzero(new), np.flatnonzero(stop)
            end = b + LENGTH
            first.append(a + base)
            last.append(b + base)
            lead.append((place[a] - a).astype(np.int8))
            anchor.append(mix64(h[place[a]] ^ np.uint64(0x9E3779B97F4A7C15)))
            name.append(mix64((sums[end] - sums[a]) * down[a] + (end - a).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)))
        join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        self.first, self.last, self.anchor, self.name = join(first, np.int64), join(last, np.int64), join(anchor, np.uint64), join(name, np.uint64)
        self.lead = join(lead, np.int8)  # bytes before the anchor
        self.doc = np.searchsorted(self.offsets, self.first, "right") - 1

    def strings(self, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of the string of LENGTH bytes at each place."""
        one, two = np.zeros(len(start), np.uint64), np.zeros(len(start), np.uint64)
        for k in range(LENGTH):
            key = BYTE_KEYS[self.data[start + k]]
            one, two = mix64(one + key), mix64(two * np.uint64(0xC2B2AE3D27D4EB4F) + key + np.uint64(k))
        return one, two

    def singled(self, firsts: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """run, place in it and two hashes of each string of the distinct runs around hot anchors."""
        apart = firsts[isin(short(self.anchor[firsts]), hot)]
        count = self.last[apart] - self.first[apart] + 1
        apart, skip = np.repeat(apart, count), spread(np.zeros(len(apart), np.int64), count)
        return apart, skip, *self.strings(self.first[apart] + skip)

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """For each run the first run with the same snippet (by both hashes), and which runs are first."""
        order = np.argsort(self.name, kind="stable")
        new = np.ones(len(order), bool)
        new[1:] = (self.name[order][1:] != self.name[order][:-1]) | (self.anchor[order][1:] != self.anchor[order][:-1])
        head = np.empty(len(order), np.int64)
        head[order] = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
        return head, np.flatnonzero(head == np.arange(len(head)))


def bucket_of(anchor: np.ndarray, buckets: int) -> np.ndarray:
    return (anchor % np.uint64(buckets)).astype(np.int64)


def short(anchor: np.ndarray) -> np.ndarray:
    return (anchor >> np.uint64(32)).astype(np.uint32)


def groups(keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(key, indices) of equal keys."""
    order = np.argsort(keys, kind="stable")
    cut = np.flatnonzero(keys[order][1:] != keys[order][:-1]) + 1
    for own in np.split(order, cut) if len(order) else []:
        yield int(keys[own[0]]), own


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents (shard, doc_id, name, data) as compressed frames, one for each shard of a batch; beside them id and name of those that may be copies."""
    for batch in batches:
        long = pc.greater_equal(pc.binary_length(batch.column(3)), LENGTH)
        may = pc.and_(long, pc.is_valid(batch.column(1)))
        out = []
        for shard, own in groups(batch.column(0).to_numpy()):
            part = batch.take(pa.array(own))
            named = part.filter(may.take(pa.array(own)))
            out.append({"shard": shard, "payload": packed(doc_id=part.column(1), n_bytes=pc.binary_length(part.column(3)).cast(pa.int64()), name=part.column(2), data=part.column(3)), "ids": named.column(1).to_pylist(), "names": named.column(2).to_pylist()})
        yield from rows_of(out, PACKED).to_batches()


def listed(anchor: np.ndarray, number: int, buckets: int) -> pa.Table:
    """Distinct short hashes of anchors with how often each is listed, by bucket."""
    keys, count = np.unique((bucket_of(anchor, buckets).astype(np.uint64) << np.uint64(32)) | short(anchor), return_counts=True)
    bucket, h, n = keys >> np.uint64(32), keys.astype(np.uint32), np.minimum(count, 65535).astype(np.uint16)
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return rows_of([{"bucket": int(bucket[a]), "shard": number, "h": h[a:b].tobytes(), "n": n[a:b].tobytes()} for a, b in zip(first, np.append(first[1:], len(keys)), strict=False)], HASHES)


def send_hashes(buckets: int):
    """Of a text shard each anchor's short hash and number of distinct snippets, by bucket."""

    def run(frames: pa.Table, messages: pa.Table) -> pa.Table:
        if not frames.num_rows:
            return rows_of([], HASHES)
        shard = Shard(frames, messages)
        return listed(shard.anchor[shard.distinct()[1]], frames.column("shard")[0].as_py(), buckets)

    return run


def send_strings(buckets: int):
    """The same of the single strings around hot anchors."""

    def run(frames: pa.Table, messages: pa.Table) -> pa.Table:
        _, hot = received(messages, ANCHOR)
        if not frames.num_rows or not len(hot):
            return rows_of([], HASHES)
        shard = Shard(frames, messages)
        return listed(shard.singled(shard.distinct()[1], hot)[2], frames.column("shard")[0].as_py(), buckets)

    return run


def received(messages: pa.Table, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted hashes with company of a kind, and those that are hot."""
    shared = messages.filter(pc.equal(messages.column("kind"), kind))
    h = np.concatenate([np.frombuffer(p.as_buffer(), np.uint32) for p in shared.column("h")] or [np.zeros(0, np.uint32)])
    hot = np.concatenate([np.frombuffer(p.as_buffer(), np.uint8) for p in shared.column("n")] or [np.zeros(0, np.uint8)]).astype(bool)
    return np.unique(h), np.unique(h[hot])


def find_shared(hot: int):
    """Of a bucket's hashes those of two or more text shards or with over ``hot`` snippets, for each shard; n: 1 for the latter, ``bucket`` their number."""

    def run(rows: pa.Table) -> pa.Table:
        parts = [np.frombuffer(p.as_buffer(), np.uint32) for p in rows.column("h")]
        owner = np.repeat(np.arange(len(parts), dtype=np.int32), [len(p) for p in parts])
        h, n = np.concatenate(parts), np.concatenate([np.frombuffer(p.as_buffer(), np.uint16) for p in rows.column("n")])
        order = np.argsort(h, kind="stable")
        h, owner, n = h[order], owner[order], n[order]
        begin = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        size = np.diff(np.append(begin, len(h)))
        many = np.add.reduceat(n.astype(np.int64), begin) > hot
        use, many = np.repeat((size > 1) | many, size), np.repeat(many, size)
        h, owner, many = h[use], owner[use], many[use].astype(np.uint8)
        shards = rows.column("shard").to_pylist()
        return rows_of([{"bucket": int(many[own].sum()), "shard": shards[k], "h": h[own].tobytes(), "n": many[own].tobytes()} for k, own in groups(owner)], HASHES)

    return run


def isin(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values the sorted array holds."""
    if not len(known):
        return np.zeros(len(values), bool)
    at = np.searchsorted(known, values)
    at[at == len(known)] = 0
    return known[at] == values


def padded(data: np.ndarray, width: int) -> np.ndarray:
    """The ``width`` bytes from every place on; a view, zeros behind the end."""
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(width, np.uint8)]), width)


def send_snippets(buckets: int):
    def run(frames: pa.Table, messages: pa.Table) -> pa.Table:
        if not frames.num_rows:
            return rows_of([], SNIPPETS)
        shard, number = Shard(frames, messages), frames.column("shard")[0].as_py()
        known, many = received(messages, ANCHOR)
        order = np.argsort(shard.anchor)
        a, d = shard.anchor[order], shard.number[shard.doc[order]]
        use, hot = np.zeros(len(a), bool), np.zeros(len(a), bool)
        if len(a):
            begin = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
            pair = np.minimum.reduceat(d, begin) < np.maximum.reduceat(d, begin)  # anchors of two documents of this shard
            runs = np.diff(np.append(begin, len(a)))
            use[order] = np.repeat(pair | isin(short(a[begin]), known), runs)
            hot[order] = np.repeat(isin(short(a[begin]), many), runs)
        head, firsts = shard.distinct()
        least, most = np.full(len(head), np.iinfo(np.int64).max), np.full(len(head), np.iinfo(np.int64).min)
        np.minimum.at(least, head, shard.number[shard.doc])
        np.maximum.at(most, head, shard.number[shard.doc])
        run = firsts[use[firsts] & ~hot[firsts]]
        whole = _snippets(shard, number, run, np.zeros(len(run), np.int64), shard.lead[run], shard.last[run] - shard.first[run] + LENGTH, shard.anchor[run], shard.name[run], least, most, buckets)
        run, skip, anchor, name = shard.singled(firsts, many)
        own = isin(short(anchor), received(messages, STRING)[0])
        order = np.argsort(anchor, kind="stable")  # strings of two documents of this shard
        if len(order):
            begin = np.flatnonzero(np.concatenate([[True], anchor[order][1:] != anchor[order][:-1]]))
            pair = np.minimum.reduceat(least[run[order]], begin) < np.maximum.reduceat(most[run[order]], begin)
            own[order] |= np.repeat(pair, np.diff(np.append(begin, len(order))))
        run, skip, anchor, name = run[own], skip[own], anchor[own], name[own]
        single = _snippets(shard, number, run, skip, np.zeros(len(run), np.int8), np.full(len(run), LENGTH), anchor, name, least, most, buckets)
        return pa.concat_tables([whole, single])

    return run


def _snippets(shard: Shard, number: int, run: np.ndarray, skip: np.ndarray, lead: np.ndarray, size: np.ndarray, anchor: np.ndarray, name: np.ndarray, least: np.ndarray, most: np.ndarray, buckets: int) -> pa.Table:
    wide = 2 * LENGTH - GRAM  # no snippet is longer
    data = padded(shard.data, wide)[shard.first[run] + skip][np.arange(wide) < size[:, None]]
    text = pa.BinaryArray.from_buffers(pa.binary(), len(run), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.py_buffer(data)])
    columns = [bucket_of(anchor, buckets).astype(np.int32), np.full(len(run), number, np.int32), run.astype(np.int32), skip.astype(np.int32), lead, name.view(np.int64), anchor.view(np.int64), least[run], most[run]]
    return pa.table([*map(pa.array, columns), text], names=[c.split()[0] for c in SNIPPETS.split(", ")])


def contexts(windows: np.ndarray, place: np.ndarray, size: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of ``size`` bytes at some places, sorted within groups: the rank of each, and by rank the length shared with the one before (-1 for a group's first)."""
    width = windows.shape[1]
    held = np.zeros((len(place), -(-width // 8) * 8), np.uint8)
    held[:, :width] = windows[place]
    held[:, :width][np.arange(width) >= size[:, None]] = 0
    order = np.lexsort((*held.view(">u8").astype(np.uint64).T[::-1], group))
    held, shared, rank = held[order], np.full(len(order), -1), np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    differs = held[1:] != held[:-1]
    shared[1:] = np.where(differs.any(axis=1), differs.argmax(axis=1), width)
    shared[1:][group[order][1:] != group[order][:-1]] = -1
    return rank, shared


def least_ids(right: tuple[np.ndarray, np.ndarray], left: tuple[np.ndarray, np.ndarray], lead: np.ndarray, size: np.ndarray, lowest: np.ndarray) -> np.ndarray:
    """The least id of all equal strings for every string start, snippet by snippet.

    A string that starts ``k`` bytes before its anchor equals those that share ``k`` bytes before and ``LENGTH - k`` from
    it on: those in one run of both orders.
    """
    starts = size - LENGTH + 1
    begin, number = np.cumsum(starts) - starts, np.arange(len(size))
    out = np.empty(int(starts.sum()), np.int64)
    run = lambda order, depth, own: np.maximum.accumulate(np.where(order[1] < depth, number, 0))[order[0][own]]
    for k in range(int(lead.max()) + 1):
        own = np.flatnonzero((lead >= k) & (lead - k < starts))
        if not len(own):
            continue
        key = run(right, LENGTH - k, own) * len(size) + run(left, k, own)
        order = np.argsort(key)
        first = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
        least = np.minimum.reduceat(lowest[own][order], first)
        out[(begin + lead - k)[own][order]] = np.repeat(least, np.diff(np.append(first, len(own))))
    return out


def compare(whole: pa.Table) -> pa.Table:
    """Least ids for the string starts of a content shard's snippets: (shard, run, start, stop, least)."""
    whole = whole.combine_chunks()
    name, anchor, least, most = (whole.column(c).to_numpy() for c in ("name", "anchor", "least", "most"))
    order = np.lexsort((anchor, name))
    new = np.ones(len(order), bool)
    new[1:] = (name[order][1:] != name[order][:-1]) | (anchor[order][1:] != anchor[order][:-1])
    begin = np.flatnonzero(new)
    snippet = np.empty(len(order), np.int64)  # the distinct snippet of each row
    snippet[order] = np.cumsum(new) - 1
    lowest = np.minimum.reduceat(least[order], begin)
    data, at = utf8(whole.column("text"))
    first = order[begin]
    size = at[first + 1] - at[first]
    # snippets that meet no other under their anchor hold the least id throughout
    by_anchor = np.argsort(anchor[first], kind="stable")
    sorted_anchor = anchor[first][by_anchor]
    same = np.zeros(len(first), bool)
    same[1:] = sorted_anchor[1:] == sorted_anchor[:-1]
    same[:-1] |= same[1:]
    many, group = by_anchor[same], sorted_anchor[same]
    lead = whole.column("lead").to_numpy()[first[many]].astype(np.int64)
    start = np.concatenate([[0], np.cumsum(size[many] - LENGTH + 1)])
    found = np.zeros(start[-1], np.int64)  # the least id of each string start
    onward, back = padded(data, LENGTH), padded(data[::-1], LENGTH - GRAM)
    bound = np.append(np.flatnonzero(np.diff(group, prepend=~group[:1])), len(group))  # of anchors
    for i, j in slices(bound, PIECE):
        i, j = int(bound[i]), int(bound[j])
        place = at[first[many[i:j]]] + lead[i:j]
        right = contexts(onward, place, size[many[i:j]] - lead[i:j], group[i:j])
        left = contexts(back, len(data) - place, lead[i:j], group[i:j])
        found[start[i] : start[j]] = least_ids(right, left, lead[i:j], size[many[i:j]], lowest[many[i:j]])
    # stretches of equal least ids within a snippet
    of = np.repeat(np.arange(len(many)), np.diff(start))
    cut = np.ones(len(of), bool)
    cut[1:] = (of[1:] != of[:-1]) | (found[1:] != found[:-1])
    stretch = np.flatnonzero(cut)
    end = np.append(stretch[1:], len(of))
    s_from = stretch - start[of[stretch]]
    alone = np.ones(len(first), bool)
    alone[many] = False
    alone = np.flatnonzero(alone)
    s_of = np.concatenate([many[of[stretch]], alone])
    by_snippet = np.argsort(s_of, kind="stable")
    s_of = s_of[by_snippet]
    s_least = np.concatenate([found[stretch], lowest[alone]])[by_snippet]
    s_to = np.concatenate([s_from + (end - stretch), size[alone] - LENGTH + 1])[by_snippet]
    s_from = np.concatenate([s_from, np.zeros(len(alone), np.int64)])[by_snippet]
    per = np.searchsorted(s_of, np.arange(len(first) + 1))
    many_of = per[snippet + 1] - per[snippet]
    k, who = spread(per[snippet], many_of), np.repeat(np.arange(len(snippet)), many_of)
    useful = s_least[k] < most[who]
    k, who = k[useful], who[useful]
    shard, run, skip = (whole.column(c).to_numpy()[who] for c in ("shard", "run", "skip"))
    return pa.table([pa.array(x.astype(t)) for x, t in ((shard, np.int32), (run, np.int32), (s_from[k] + skip, np.int32), (s_to[k] + skip, np.int32), (s_least[k], np.int64))], names=[c.split()[0] for c in ANSWERS.split(", ")])


def cut(frames: pa.Table, answers: pa.Table) -> pa.Table:
    """The result rows of a text shard; ``answers`` also holds its copies (kind, h, bucket)."""
    if not frames.num_rows:
        return rows_of([], RESULT)
    shard = Shard(frames, answers)
    answers = answers.filter(pc.equal(answers.column("kind"), ANSWER))
    n = len(shard.data)
    cover = np.zeros(n + 1, np.int32)
    if answers.num_rows:
        run, start, stop, least = (answers.column(c).to_numpy() for c in ("run", "start", "stop", "least"))
        order = np.argsort(run, kind="stable")
        run, start, stop, least = run[order], start[order], stop[order], least[order]
        head, _ = shard.distinct()
        upto = np.concatenate([[0], np.cumsum(np.bincount(run, minlength=len(head)))])
        held = np.flatnonzero(upto[head + 1] > upto[head])
        a, b = upto[head[held]], upto[head[held] + 1]
        k, who = spread(a, b - a), np.repeat(held, b - a)
        own = least[k] < shard.number[shard.doc[who]]
        k, who = k[own], who[own]
        np.add.at(cover, shard.first[who] + start[k], 1)
        np.add.at(cover, shard.first[who] + stop[k] - 1 + LENGTH, -1)
    gone = np.cumsum(cover[:-1], dtype=np.int32) > 0
    begin, end = edges(gone, shard.offsets)
    of = np.searchsorted(begin, shard.offsets)  # ranges before each document
    kept_at = shard.offsets - np.concatenate([[0], np.cumsum(end - begin)])[of]
    kept = shard.data[~gone]
    local = shard.offsets[np.searchsorted(shard.offsets, begin, "right") - 1] if len(begin) else begin
    copied = np.flatnonzero(shard.copied)  # they hold no bytes here, and go whole
    begin, end = np.insert(begin - local, of[copied], 0), np.insert(end - local, of[copied], shard.size[copied])
    edge = pa.array(of + np.concatenate([[0], np.cumsum(shard.copied)]), pa.int32())
    removed_from, removed_to = (pa.ListArray.from_arrays(edge, pa.array(x, pa.int64())) for x in (begin, end))
    return pa.table({"doc_id": pa.array(shard.ids, pa.int64()), "n_bytes": pa.array(shard.size, pa.int64()), "removed_from": removed_from, "removed_to": removed_to, "kept": pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(shard.ids), [None, pa.py_buffer(kept_at.astype(np.int64)), pa.py_buffer(kept)]).cast(pa.binary())})


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES, content_bytes: int = CONTENT_BYTES, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, removed_from[], removed_to[] and kept of every row."""
    spark = docs.sparkSession
    data = F.coalesce(F.col(f"`{text}`").cast("string").cast("binary"), F.lit(b""))
    base = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), data.alias("data"))
    size = base.agg(F.sum(F.length("data")).alias("bytes"), F.count("*").alias("rows")).first()
    whole, parts = size["bytes"] or 0, int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards, contents, hash_buckets = (max(parts, -(-whole // b)) for b in (shard_bytes, content_bytes, HASH_BYTES))
    shard = F.pmod(F.xxhash64("doc_id", "name", F.monotonically_increasing_id() % 1024), F.lit(shards)).cast("int")  # repeated rows are spread
    frames = base.withColumn("name", F.unhex(F.sha2("data", 256))).select(shard.alias("shard"), "doc_id", "name", "data").mapInArrow(pack, PACKED)
    texts = bucketed(frames, "shard", max(parts, -(-shards // 4)), "text-shards")
    by_shard = texts.groupBy("shard")
    # exact copies: the least id of every name that several ids have, for each shard that holds it
    light = texts.select("shard", F.inline(F.arrays_zip(F.col("ids").alias("id"), F.col("names").alias("name"))))
    first = light.groupBy("name").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.count("*").alias("n_rows")).where("least < most").select("name", "least", "n_rows")
    copies = salted_join(light.select("shard", "name").distinct(), first, "name", "n_rows", size["rows"], ["shard"])
    copies = saved(copies.select(F.col("least").alias("bucket"), "shard", F.col("name").alias("h"), F.lit(b"").alias("n"), F.lit(COPY).alias("kind")), "copies")
    hashes = by_shard.cogroup(copies.groupBy("shard")).applyInArrow(send_hashes(hash_buckets), HASHES)
    known = saved(hashes.groupBy("bucket").applyInArrow(find_shared(hot), HASHES).withColumn("kind", F.lit(ANCHOR)).unionByName(copies), "shared-anchors")
    if known.where(F.col("kind") == ANCHOR).agg(F.sum("bucket")).first()[0]:  # some anchor is hot
        strings = by_shard.cogroup(known.groupBy("shard")).applyInArrow(send_strings(hash_buckets), HASHES)
        known = known.unionByName(strings.groupBy("bucket").applyInArrow(find_shared(1 << 62), HASHES).withColumn("kind", F.lit(STRING)))
    snippets = by_shard.cogroup(known.groupBy("shard")).applyInArrow(send_snippets(contents), SNIPPETS)
    answers = snippets.groupBy("bucket").applyInArrow(compare, ANSWERS).withColumn("kind", F.lit(ANSWER))
    return by_shard.cogroup(answers.unionByName(copies, allowMissingColumns=True).groupBy("shard")).applyInArrow(cut, RESULT)


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate(F.zip_with("removed_to", "removed_from", lambda b, a: b - a), F.lit(0).cast("long"), lambda s, x: s + x)
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed_from").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
