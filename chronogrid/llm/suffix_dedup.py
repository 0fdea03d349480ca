"""Repeated-substring removal by a hash-compared suffix sort.

Every byte covered by a ``length``-byte string that also starts earlier is removed. Windows (the strings of that length) that
are equal hold the same smallest hash of ``gram`` bytes, so windows meet by that hash alone: neighbouring windows with one
smallest hash form a run, and a run is one row for some 35 bytes of text. That hash only brings windows together; it decides
nothing. Equal runs are settled by their order: in one task their bytes are compared, between tasks their 128-bit BLAKE2b
digests. Where runs under one hash differ, their bytes are brought together and their windows are sorted as suffixes: a
bottom-up mergesort compares two suffixes by the longest common extension, found by binary search over prefix polynomial
hashes; suffixes next to each other that agree on the full length are verified byte by byte, and a group in which that fails
is grouped by its bytes. Runs under a hash that has more than ``hot_bytes`` bytes of them are sorted and verified the same way
beside each other in the tasks that hold their documents; what is left, each window once a task, meets by its own digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronogrid.llm.common import free_name
from chronogrid.shared import materialise

LENGTH = 100
GRAM = 32
BASE = 0x9E3779B97F4A7C15
#: Bytes of one document handled at once; longer ones are read in overlapping pieces.
PIECE = 1 << 20
#: Bytes whose runs are compared with each other before they leave a task.
BATCH_BYTES = 4 << 20
#: Bytes of differing runs that are sorted at once in a task.
SORT_BYTES = 1 << 20
#: Bytes of differing runs under one hash from which they are not sorted in one place.
HOT_BYTES = 1 << 16
RUN = "v long, d1 long, d2 long, uid long, start long, c int, tie boolean"
CUT = "kind int, k1 long, k2 long, uid long, start long, n long, bytes binary"
CALM, WINDOW, SPAN = 0, 1, 2


class Powers:
    """Powers of the base and of its inverse modulo 2^64, grown as needed."""

    up = np.ones(1, dtype=np.uint64)
    down = np.ones(1, dtype=np.uint64)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = 1 << max(12, (n - 1).bit_length())
            inverse = pow(BASE, -1, 1 << 64)
            cls.up = np.cumprod(np.r_[np.ones(1, np.uint64), np.full(size - 1, BASE, np.uint64)])
            cls.down = np.cumprod(np.r_[np.ones(1, np.uint64), np.full(size - 1, inverse, np.uint64)])
        return cls.up, cls.down


class Text:
    """Bytes with prefix polynomial hashes: the hash of any substring takes two look-ups and a multiplication."""

    def __init__(self, data: np.ndarray) -> None:
        self.data = data
        up, self.down = Powers.get(len(data) + 1)
        self.prefix = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=self.prefix[1:])

    def hash(self, at: np.ndarray, size) -> np.ndarray:
        return (self.prefix[at + size] - self.prefix[at]) * self.down[at]

    def all_hashes(self, size: int) -> np.ndarray:
        n = len(self.data) - size + 1
        return (self.prefix[size:] - self.prefix[:n]) * self.down[:n]

    def order(self, p: np.ndarray, q: np.ndarray, length: int) -> np.ndarray:
        """-1, 0, 1 as the suffixes at p and q compare on ``length`` bytes: the common extension is found in halves."""
        out = np.zeros(len(p), dtype=np.int16)
        differ = np.flatnonzero(self.hash(p, length) != self.hash(q, length))
        p, q = p[differ], q[differ]
        common = np.zeros(len(p), dtype=np.int64)
        step = 1 << (length.bit_length() - 1)
        while step:
            fits = common + step <= length
            a, b = p + common, q + common
            size = np.where(fits, step, 0)
            common += np.where(fits & (self.hash(a, size) == self.hash(b, size)), step, 0)
            step >>= 1
        left, right = self.data[p + common].astype(np.int16), self.data[q + common].astype(np.int16)
        out[differ] = np.sign(left - right)
        return out


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` values in a row."""
    size = 1
    while 2 * size <= width:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    rest = width - size
    return np.minimum(h[:-rest], h[rest:]) if rest else h


def runs(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(smallest hash, hash of the run's bytes, first window, windows, whether the smallest hash repeats in it) by run, and
    the first windows of those that the same bytes one period before repeat: (run, first window, windows)."""
    none = np.zeros(0, dtype=np.int64)
    if len(data) < length:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), none, none, np.zeros(0, bool), (none, none)
    text, width = Text(data), length - gram + 1
    h = _mixed(text.all_hashes(gram))
    low = _least(h, width)
    first = np.flatnonzero(np.r_[True, low[1:] != low[:-1]])
    c = np.diff(np.r_[first, len(low)])
    v = low[first]
    span = c + width - 1
    offset = np.cumsum(span) - span
    places = np.repeat(first - offset, span) + np.arange(span.sum())
    tie = np.add.reduceat((h[places] == np.repeat(v, span)).astype(np.int32), offset) > 1
    long_ = tie & (c > width)
    done = (none, none)
    if long_.any():
        v, first, c, tie, done = _without_periods(data, h, v, first, c, tie, long_, length, width)
    frag = _mixed(text.hash(first, c + length - 1) + c.astype(np.uint64))
    return v, frag, first, c, tie, done


def _stretches(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of the stretches of true values."""
    edge = np.flatnonzero(np.diff(np.r_[False, mask, False].astype(np.int8)))
    return edge[::2], edge[1::2] - edge[::2]


def _without_periods(data, h, v, first, c, tie, long_, length, width):
    """Long runs are periodic: windows that the bytes of one period before repeat are settled, the others stay as runs."""
    out = [(v[~long_], first[~long_], c[~long_], tie[~long_])]
    spans = []
    for r in np.flatnonzero(long_):
        at, n = int(first[r]), int(c[r])
        gaps = np.diff(np.flatnonzero(h[at : at + n + width - 1] == v[r]))
        period = int(np.bincount(gaps[gaps <= length]).argmax()) if (gaps <= length).any() else 0
        again = np.zeros(n, dtype=bool)
        if 0 < period < n:
            own = data[at : at + n + length - 1]
            same = np.r_[0, np.cumsum(own[period:] == own[:-period])]
            again[period:] = same[length:][: n - period] - same[:-length][: n - period] == length
        a, m = _stretches(again)
        spans.append((a + at, m + length - 1))
        a, m = _stretches(~again)
        out.append((np.full(len(a), v[r], np.uint64), a + at, m, np.ones(len(a), bool)))
    v, first, c, tie = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.argsort(first, kind="stable")
    return v[order], first[order], c[order], tie[order], tuple(np.concatenate(x) for x in zip(*spans, strict=True))


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.int64)


def _digests(raw: bytes, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """128-bit digests of the parts of raw, as two columns of integers."""
    parts = (hashlib.blake2b(raw[a : a + n], digest_size=16).digest() for a, n in zip(at.tolist(), size.tolist(), strict=True))
    return np.frombuffer(b"".join(parts), dtype=np.int64).reshape(-1, 2)


def _utf8(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _emit_runs(length: int, gram: int):
    """The runs of every document. Of equal runs in one batch only the earliest goes on; the rest, which an earlier
    string repeats whatever else there is, leaves as settled spans (c < 0: minus the span's bytes)."""

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            parts, spans, held, size = [], [], [], 0
            order = np.argsort(pdf["uid"].to_numpy(), kind="stable")
            for i in order:
                uid, raw = int(pdf["uid"].iat[i]), _utf8(pdf["text"].iat[i])
                for at in range(0, max(len(raw) - length + 1, 0), PIECE):
                    piece = raw[at : at + PIECE + length - 1]
                    v, frag, first, c, tie, done = runs(np.frombuffer(piece, dtype=np.uint8), length, gram)
                    parts.append((v, frag, np.full(len(v), uid), first + at, c, tie, first + size))
                    spans.append((np.full(len(done[0]), uid), done[0] + at, done[1]))
                    held.append(piece)
                    size += len(piece)
                    if size > BATCH_BYTES:
                        yield _combined(parts, spans, b"".join(held), length)
                        parts, spans, held, size = [], [], [], 0
            if parts:
                yield _combined(parts, spans, b"".join(held), length)

    return go


def _combined(parts: list[tuple], spans: list[tuple], raw: bytes, length: int) -> pd.DataFrame:
    v, frag, uid, start, c, tie, at = (np.concatenate(x) for x in zip(*parts, strict=True))
    # rows are in order of (uid, start), so the first of equal runs is the earliest
    _, first, same = np.unique(frag, return_index=True, return_inverse=True)
    lead = first[same]
    copy = (lead != np.arange(len(v))) & (v == v[lead]) & (c == c[lead])
    i = np.flatnonzero(copy)
    copy[i[~_equal_bytes(raw, at[i], at[lead[i]], c[i] + length - 1)]] = False
    again = copy & ((uid != uid[lead]) | (start != start[lead]))
    u, a, n = (np.concatenate(x) for x in zip(*spans, (uid[again], start[again], c[again] + length - 1), strict=True))
    u, a, b = _merged(u, a, a + n)
    keep = ~copy
    d = _digests(raw, at[keep], c[keep] + length - 1)
    settled = pd.DataFrame({"v": _signed(_mixed(u.astype(np.uint64))), "d1": 0, "d2": 0, "uid": u, "start": a, "c": a - b, "tie": False})
    own = pd.DataFrame({"v": _signed(v[keep]), "d1": d[:, 0], "d2": d[:, 1], "uid": uid[keep], "start": start[keep], "c": c[keep], "tie": tie[keep]})
    return pd.concat([own, settled], ignore_index=True).astype({"c": np.int32})


def _equal_bytes(raw: bytes, p: np.ndarray, q: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the parts at p and q are equal byte by byte; parts that go on from one another are compared as one."""
    if not len(p):
        return np.zeros(0, dtype=bool)
    end = p + size
    new = np.r_[True, (p[1:] - q[1:] != p[:-1] - q[:-1]) | (p[1:] > end[:-1]) | (p[1:] < p[:-1])]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(p)] - 1
    view = memoryview(raw)
    ok = [view[a:b] == view[x : x + b - a] for a, b, x in zip(p[first].tolist(), end[last].tolist(), q[first].tolist(), strict=True)]
    return np.array(ok)[np.cumsum(new) - 1]


def _merged(uid: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of each document that touch or overlap become one."""
    if not len(uid):
        return uid, a, b
    order = np.lexsort((a, uid))
    uid, a, b = uid[order], a[order], b[order]
    new = np.r_[True, uid[1:] != uid[:-1]]
    base = np.cumsum(new) * (int(b.max()) + 1)
    reach = np.maximum.accumulate(b + base)
    new[1:] |= a[1:] + base[1:] > reach[:-1]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(uid)] - 1
    return uid[first], a[first], reach[last] - base[last]


def _settle(length: int):
    """Rows sorted by (v, d1, d2, uid, start). Later copies of a run are settled spans; the first copy is open where its hash
    has other runs or repeats in it. One row is held back between batches, however large a group is."""

    def out(kind: str, v, uid, start, c) -> pd.DataFrame:
        return pd.DataFrame({"settled": kind == "span", "v": v, "uid": uid, "start": start, "c": c})

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # the last first copy: (v, d1, d2, uid, start, c, open so far)
        for pdf in batches:
            c = pdf["c"].to_numpy(dtype=np.int64)
            span = c < 0
            if span.any():
                part = pdf[span]
                yield out("span", part["v"], part["uid"], part["start"], -c[span])
                pdf, c = pdf[~span], c[~span]
            if pdf.empty:
                continue
            v, d1, d2, uid, start = (pdf[k].to_numpy() for k in ("v", "d1", "d2", "uid", "start"))
            tie = pdf["tie"].to_numpy(dtype=bool)
            if held is not None:
                v, d1, d2, uid, start, c, tie = (np.r_[[x], y] for x, y in zip(held, (v, d1, d2, uid, start, c, tie), strict=True))
            lead = np.r_[True, (v[1:] != v[:-1]) | (d1[1:] != d1[:-1]) | (d2[1:] != d2[:-1])]
            at = np.flatnonzero(lead)
            of = at[np.cumsum(lead) - 1]
            again = ~lead & ((uid != uid[of]) | (start != start[of]))
            if again.any():
                u, a, b = _merged(uid[again], start[again], start[again] + c[again] + length - 1)
                yield out("span", 0, u, a, b - a)
            same = v[at][1:] == v[at][:-1]
            open_ = tie[at].astype(bool) | np.r_[False, same] | np.r_[same, False]
            done, last = at[:-1][open_[:-1]], at[-1]
            yield out("open", v[done], uid[done], start[done], c[done])
            held = (v[last], d1[last], d2[last], uid[last], start[last], c[last], open_[-1])
        if held is not None and held[6]:
            yield out("open", [held[0]], [held[3]], [held[4]], [held[5]])

    return go


def sort_suffixes(text: Text, at: np.ndarray, group: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Order of the suffixes ``at``, by group and then by their first ``length`` bytes; stable.

    A bottom-up mergesort of all groups at once: at each level an element's new place is its place in its own run plus its
    rank in the run beside it, found by binary search with the hash comparison.
    """
    order = np.argsort(group, kind="stable")
    start = np.flatnonzero(np.r_[True, group[order][1:] != group[order][:-1]]) if len(order) else np.zeros(0, np.int64)
    size = np.diff(np.r_[start, len(order)])
    base, many = np.repeat(start, size), np.repeat(size, size)
    width = 1
    while (live := np.flatnonzero(many > width)).size:
        rel = live - base[live]
        block = rel // width
        lo = (block ^ 1) * width
        hi = np.minimum(lo + width, many[live])
        lo = np.minimum(lo, hi)
        right = (block & 1).astype(bool)
        low, high = lo.copy(), hi.copy()
        own = at[order[live]]
        while (todo := np.flatnonzero(low < high)).size:
            mid = (low[todo] + high[todo]) // 2
            seen = text.order(at[order[base[live[todo]] + mid]], own[todo], length)
            before = (seen < 0) | ((seen == 0) & right[todo])
            low[todo] = np.where(before, mid + 1, low[todo])
            high[todo] = np.where(before, high[todo], mid)
        place = base[live] + (block // 2) * 2 * width + rel % width + low - lo
        moved = order.copy()
        moved[place] = order[live]
        order = moved
        width *= 2
    return order


def _windows(v: np.ndarray, uid: np.ndarray, start: np.ndarray, pieces: list[bytes], length: int, gram: int):
    """All windows of these runs, and whether an earlier one among them repeats each; equal windows have one v.

    Returns (uid, start, repeated, first, place in the joined bytes): first marks one window of each kind, the earliest.
    """
    sizes = np.array([len(x) for x in pieces])
    begin = np.cumsum(sizes) - sizes
    text = Text(np.frombuffer(b"".join(pieces), dtype=np.uint8))
    c = sizes - length + 1
    run = np.repeat(np.arange(len(pieces)), c)
    off = np.arange(len(run)) - np.repeat(np.cumsum(c) - c, c)
    at = begin[run] + off
    uid, start = uid[run], start[run] + off
    # a window's group: its smallest hash and where in it that is first met
    v = v.astype(np.uint64)
    h = _mixed(text.all_hashes(gram))
    here = h == np.repeat(v, sizes)[: len(h)]
    following = np.minimum.accumulate(np.where(here, np.arange(len(h)), len(h))[::-1])[::-1]
    group = _mixed(v[run] + (following[at] - at).astype(np.uint64) * np.uint64(BASE))
    # a window whose hash stands alone has no equal
    _, number, count = np.unique(text.hash(at, length) ^ group, return_inverse=True, return_counts=True)
    repeated, lead = np.zeros(len(at), dtype=bool), np.ones(len(at), dtype=bool)
    keep = np.flatnonzero(count[number] > 1)
    if len(keep):
        keep = keep[np.lexsort((start[keep], uid[keep]))]
        first = keep[_equal_to(text, at[keep], group[keep], length)]
        lead[keep] = first == keep
        repeated[keep] = (uid[keep] != uid[first]) | (start[keep] != start[first])
    return uid, start, repeated, lead, at


def _equal_to(text: Text, at: np.ndarray, group: np.ndarray, length: int) -> np.ndarray:
    """For each suffix the index of the first one that is equal on ``length`` bytes."""
    order = sort_suffixes(text, at, group, length)
    same = np.zeros(len(order), dtype=bool)
    same[1:] = (group[order][1:] == group[order][:-1]) & (text.order(at[order][1:], at[order][:-1], length) == 0)
    # verification: what the hashes call equal must be equal byte by byte
    cells = np.arange(length)
    false = False
    for i in range(1, len(order), 1 << 15):
        j = np.arange(i, min(i + (1 << 15), len(order)))
        j = j[same[j]]
        true = (text.data[at[order[j]][:, None] + cells] == text.data[at[order[j - 1]][:, None] + cells]).all(axis=1)
        false |= not true.all()
    out = np.empty(len(order), dtype=np.int64)
    if false:  # two strings under one hash: these windows are grouped by their bytes
        raw, seen = text.data.tobytes(), {}
        out[:] = [seen.setdefault((g, raw[a : a + length]), i) for i, (g, a) in enumerate(zip(group.tolist(), at.tolist(), strict=True))]
    else:  # stable sorting of windows in (uid, start) order leaves the earliest in front
        out[order] = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
    return out


def _spans(uid: np.ndarray, start: np.ndarray, size) -> pd.DataFrame:
    u, a, b = _merged(uid, start, start + size)
    return pd.DataFrame({"uid": u, "start": a, "n": b - a})


def _resolve(length: int, gram: int):
    """Rows of CUT sorted by (kind, k1, k2, uid, start). Runs: whole groups are gathered up to SORT_BYTES and sorted
    together. Windows: all but the first of equal digests are repeats."""

    def sort(held: list[pd.DataFrame]) -> pd.DataFrame:
        pdf = pd.concat(held, ignore_index=True)
        uid, start, repeated, _, _ = _windows(pdf["k1"].to_numpy(), pdf["uid"].to_numpy(), pdf["start"].to_numpy(), list(pdf["bytes"]), length, gram)
        return _spans(uid[repeated], start[repeated], length)

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size, last = [], 0, None
        for pdf in batches:
            kind = pdf["kind"].to_numpy()
            if (part := pdf[kind == SPAN]).size:
                yield part[["uid", "start", "n"]]
            if (part := pdf[kind == WINDOW]).size:
                k1, k2, uid, start = (part[k].to_numpy() for k in ("k1", "k2", "uid", "start"))
                if last is not None:
                    k1, k2, uid, start = (np.r_[[x], y] for x, y in zip(last, (k1, k2, uid, start), strict=True))
                new = np.r_[True, (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])]
                of = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
                again = ~new & ((uid != uid[of]) | (start != start[of]))
                if again.any():
                    yield _spans(uid[again], start[again], length)
                end = of[-1]
                last = (k1[end], k2[end], uid[end], start[end])
            pdf = pdf[kind == CALM]
            if pdf.empty:
                continue
            v = pdf["k1"].to_numpy()
            sizes = pdf["bytes"].str.len().to_numpy()
            ends = np.r_[np.flatnonzero(v[1:] != v[:-1]) + 1, len(v)]
            at = 0
            if held and held[-1]["k1"].iat[-1] != v[0] and size >= SORT_BYTES:
                yield sort(held)
                held, size = [], 0
            for end in ends[:-1]:
                size += int(sizes[at:end].sum())
                held.append(pdf.iloc[at:end])
                at = end
                if size >= SORT_BYTES:
                    yield sort(held)
                    held, size = [], 0
            held.append(pdf.iloc[at:])
            size += int(sizes[at:].sum())
        if held:
            yield sort(held)

    return go


def _cut_runs(length: int, gram: int):
    """Rows of CUT: the bytes of the open runs. Runs under a hot hash are sorted against the others of their batch; repeats
    leave as spans, and of the rest each window once, by its digest."""

    def calm(rows: list[tuple]) -> pd.DataFrame:
        v, uid, start, part = zip(*rows, strict=True)
        return pd.DataFrame({"kind": CALM, "k1": v, "k2": 0, "uid": uid, "start": start, "n": 0, "bytes": part})

    def hot(rows: list[tuple]) -> Iterator[pd.DataFrame]:
        v, uid, start, pieces = zip(*rows, strict=True)
        uid, start, repeated, lead, at = _windows(np.array(v), np.array(uid), np.array(start), list(pieces), length, gram)
        spans = _spans(uid[repeated], start[repeated], length)
        yield spans.assign(kind=SPAN, k1=_signed(_mixed(spans["uid"].to_numpy().astype(np.uint64))), k2=0, bytes=None)
        d = _digests(b"".join(pieces), at[lead], np.full(lead.sum(), length))
        yield pd.DataFrame({"kind": WINDOW, "k1": d[:, 0], "k2": d[:, 1], "uid": uid[lead], "start": start[lead], "n": length, "bytes": None})

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in CUT.split(", ")]
        many, many_size = [], 0
        for pdf in batches:
            few = []
            for uid, text, open_ in zip(pdf["uid"], pdf["text"], pdf["open"], strict=True):
                raw = _utf8(text)
                for x in open_:
                    a, end = x["start"], x["start"] + x["c"] + length - 1
                    if not x["hot"]:
                        few.append((x["v"], uid, a, raw[a:end]))
                        continue
                    while a < end - length + 1:  # a long run goes on in parts that share length - 1 bytes
                        part = raw[a : min(end, a + SORT_BYTES + length - 1)]
                        many.append((x["v"], uid, a, part))
                        many_size += len(part)
                        a += SORT_BYTES
                        if many_size >= SORT_BYTES:
                            yield from (y[names] for y in hot(many))
                            many, many_size = [], 0
                if len(few) > 20_000:
                    yield calm(few)[names]
                    few = []
            if few:
                yield calm(few)[names]
        if many:
            yield from (y[names] for y in hot(many))

    return go


def _with_uid(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, uid, text): uid orders documents as their ids do. Where ids repeat or are null, it numbers (id, text)."""
    if dict(docs.dtypes)[id_col] in ("tinyint", "smallint", "int", "bigint"):
        seen = docs.agg(F.count("*").alias("n"), F.count(id_col).alias("ids")).first()
        if seen["n"] == seen["ids"] == docs.select(id_col).distinct().count():
            return docs.select(F.col(id_col).alias("id"), F.col(id_col).cast("long").alias("uid"), F.col(text_col).alias("text"))
    keyed = docs.select(F.col(id_col).alias("id"), F.sha2(F.coalesce(text_col, F.lit("")), 256).alias("h"), F.col(text_col).alias("text"))
    numbers = keyed.select("id", "h").distinct().orderBy("id", "h").withColumn("uid", F.monotonically_increasing_id())
    numbers = materialise(numbers).withColumnsRenamed({"id": "id2", "h": "h2"})
    return keyed.join(numbers, keyed["id"].eqNullSafe(F.col("id2")) & (F.col("h") == F.col("h2"))).select("id", "uid", "text")


def repeated_spans(texts: DataFrame, length: int = LENGTH, gram: int = GRAM, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """(uid, start, n): spans whose union is every byte under a window that also starts earlier. texts: (uid, text)."""
    spark = texts.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = texts.select("uid", "text").mapInPandas(_emit_runs(length, gram), RUN)
    rows = rows.repartition(n, "v").sortWithinPartitions("v", "d1", "d2", "uid", "start")
    met = materialise(rows.mapInPandas(_settle(length), "settled boolean, v long, uid long, start long, c int"))
    spans = met.filter("settled").select("uid", "start", F.col("c").cast("long").alias("n"))
    open_ = met.filter("not settled").select("v", "uid", "start", "c")
    bytes_ = F.sum(F.col("c").cast("long") + length - 1)
    # written first, so that its size is known when the join is planned: few rows are broadcast and no hot key is dealt out
    hot = materialise(open_.groupBy("v").agg(bytes_.alias("n")).filter(F.col("n") > hot_bytes).select("v", F.lit(True).alias("hot")))
    tagged = open_.join(hot, "v", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    by_doc = tagged.groupBy("uid").agg(F.collect_list(F.struct("v", "start", "c", "hot")).alias("open"))
    cut = texts.select("uid", "text").join(by_doc, "uid").select("uid", "text", "open").mapInPandas(_cut_runs(length, gram), CUT)
    cut = cut.repartition(n, "k1").sortWithinPartitions("kind", "k1", "k2", "uid", "start")
    return spans.unionAll(cut.mapInPandas(_resolve(length, gram), "uid long, start long, n long"))


def kept_parts(raw: bytes, spans) -> tuple[bytes, int, int]:
    """(what is left, bytes removed, maximal removed runs) of a text and its spans (start << 32 | bytes)."""
    if spans is None or not len(spans):
        return raw, 0, 0
    x = np.sort(np.asarray(spans, dtype=np.int64))
    a = x >> 32
    _, a, b = _merged(np.zeros(len(a), dtype=np.int64), a, a + (x & 0xFFFFFFFF))
    kept, at = [], 0
    for i, j in zip(a, b, strict=True):
        kept.append(raw[at:i])
        at = j
    kept.append(raw[at:])
    return b"".join(kept), int((b - a).sum()), len(a)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, with_text: bool = False, **options) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256), and kept_text on demand, for each row of docs.

    Texts are UTF-8 bytes; null is empty; nothing shorter than ``length`` is removed. Null ids come before all others. Rows
    with one id and one text are one document seen again, and get equal results; rows with one id and other texts are
    ordered by a hash of the text. An empty table gives an empty result. kept_text drops bytes of characters that were cut.
    """
    texts = _with_uid(docs, id_col, text_col)
    spans = repeated_spans(texts, length, **options)
    by_doc = spans.groupBy("uid").agg(F.collect_list(F.shiftleft("start", 32).bitwiseOR(F.col("n"))).alias("spans"))
    out = "n_bytes:long,n_removed:long,n_spans:long,kept_sha256:string" + (",kept_text:string" if with_text else "")

    @F.pandas_udf(f"struct<{out}>")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        rows = []
        for text, own in zip(texts, spans, strict=True):
            raw = _utf8(text)
            kept, removed, count = kept_parts(raw, own)
            rows.append((len(raw), removed, count, hashlib.sha256(kept).hexdigest(), *([kept.decode("utf-8", "ignore")] if with_text else [])))
        return pd.DataFrame(rows, columns=[x.split(":")[0] for x in out.split(",")])

    joined = texts.join(by_doc, "uid", "left").select("id", cut("text", "spans").alias("_cut"))
    name = free_name(docs.select(id_col), "_cut")
    return joined.select(F.col("id").alias(id_col), F.col("_cut").alias(name)).select(id_col, f"{name}.*")
