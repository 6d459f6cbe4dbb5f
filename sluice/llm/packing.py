"""Best-fit packing with swap-based local search.

Documents become token pieces of at most `capacity`. Full pieces are sequences of their own. The others are dealt by
hash into groups of bounded size; in each, best fit decreasing opens the bins and a local search moves or exchanges
pieces (one for one, two for one, one for two) between underfull bins, each step raising the sum of squared fills,
until bins run empty. Bins left underfull give their pieces back for a second round over all groups.
"""

from __future__ import annotations

import bisect
import itertools
import os
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

CAPACITY, END_ID = 4096, 1
#: Pieces of a group that one task packs; the second round takes bins filled below this part of the capacity.
GROUP_PIECES, LOOSE_BELOW = 16_000, 0.98
#: Token runs that a worker's table holds at most; a full one starts anew. Longer ones are not kept.
TABLE_RUNS, KEPT_CHARS = 150_000, 64
#: Text bytes that are cut at once; each distinct run in them is looked up once.
CUT_BYTES = 4 << 20


def _byte_letters() -> dict[int, str]:
    """How byte-level vocabularies write each byte: printable Latin-1 as itself, others from U+0100 on in turn."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class Words:
    """Ids of texts by a table of distinct token runs.

    Merges never cross the runs that the tokenizer cuts a text into, so a text's ids are those of its runs in turn.
    Texts of ASCII and Latin letters, whose lower case and normal form are plain, are cut here and each distinct run
    goes through the merges once; any other text goes through the whole tokenizer, word by word.
    """

    _LETTERS = "a-zÀ-ÖØ-öø-įı-ſ"
    #: Texts that hold any of these, or a special token's opening, aren't plain.
    _OTHER = f"[^\\t\\n\\r -~A-Z{_LETTERS}]|<\\|"
    _RUNS = f"('s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^\\s0-9{_LETTERS}]+)"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tokenizers

        self.tokenizer = tokenizers.Tokenizer.from_file(path)
        self.merges = tokenizers.Tokenizer.from_file(path)
        self.merges.normalizer = tokenizers.normalizers.Sequence([])
        self.merges.pre_tokenizer = tokenizers.pre_tokenizers.WhitespaceSplit()
        pieces = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(pieces.values()) + 1, dtype=bool)
        self.ends[[i for p, i in pieces.items() if p.endswith("</w>")]] = True
        self.runs: dict[str, bytes] = {}
        self.letters = _byte_letters()

    def _fill(self, wanted: list[str]) -> None:
        """Sends the runs that the table lacks through the merges, many to a call; each ends at its one word end."""
        if len(self.runs) > TABLE_RUNS:
            self.runs.clear()
        new = [r for r in wanted if r not in self.runs]
        shown = [r if r.isascii() else r.encode().decode("latin-1").translate(self.letters) for r in new]
        calls = [" ".join(shown[i : i + 400]) for i in range(0, len(shown), 400)]
        raw = b"".join([np.array(e.ids, dtype="<u4").tobytes() for e in self.merges.encode_batch_fast(calls, add_special_tokens=False)])
        cuts = [0, *((np.flatnonzero(self.ends[np.frombuffer(raw, dtype="<u4")]) + 1) * 4).tolist()]
        if len(cuts) != len(new) + 1:
            raise ValueError("a run must end at its one word end")
        self.runs.update((r, raw[a:b]) for r, a, b in zip(new, cuts, cuts[1:], strict=False))

    def _plain(self, texts: pa.Array) -> list[bytes]:
        """Cuts the distinct words into runs, looks up the distinct runs, and joins ids back to words, then to texts."""
        pc = pa.compute
        words = pc.utf8_split_whitespace(texts)
        coded = words.flatten().dictionary_encode()
        cut = pc.utf8_split_whitespace(pc.replace_substring_regex(pc.utf8_lower(coded.dictionary), self._RUNS, "\\1 "))
        runs = cut.flatten().dictionary_encode()
        distinct = runs.dictionary.to_pylist()
        self._fill([r for r in distinct if r])
        own = [self.runs[r] if r else b"" for r in distinct]
        for r in distinct:
            if len(r) > KEPT_CHARS:
                del self.runs[r]
        size = np.fromiter(map(len, own), np.int64, len(own)) // 4
        of_words, ends = _joined(np.frombuffer(b"".join(own), dtype="<u4"), np.cumsum(size) - size, size, runs.indices.to_numpy())
        bounds = ends[_offsets(cut)]
        flat, ends = _joined(of_words, bounds[:-1], np.diff(bounds), coded.indices.to_numpy())
        raw, cuts = flat.tobytes(), (ends[_offsets(words)] * 4).tolist()
        return [raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def _any(self, text: str) -> bytes:
        """By white-space separated words, so that a very long text stays cheap."""
        words = re.split("[ \n\t\r]+", text)
        distinct = [w for w in dict.fromkeys(words) if w]
        known = {w: np.array(e.ids, dtype="<u4").tobytes() for w, e in zip(distinct, self.tokenizer.encode_batch_fast(distinct, add_special_tokens=False), strict=True)}
        return b"".join([known[w] for w in words if w])

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        """Ids of each text as little-endian 32-bit bytes."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        other = pa.compute.match_substring_regex(texts, self._OTHER)
        plain = texts.filter(pa.compute.invert(other))
        found = iter(self._plain(plain) if len(plain) else [])
        return [self._any(t.as_py()) if o else next(found) for t, o in zip(texts, other.to_pylist(), strict=True)]


def _offsets(lists: pa.ListArray) -> np.ndarray:
    out = lists.offsets.to_numpy()
    return out - out[0]


def _joined(ids: np.ndarray, first: np.ndarray, size: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches ids[first : first + size] of the items `at`, one after another, and where each ends."""
    n = size[at]
    ends = np.concatenate([[0], np.cumsum(n)])
    return ids[np.repeat(first[at] - ends[:-1], n) + np.arange(ends[-1])], ends


_TABLES: dict = {}


def _table(path: str) -> Words:
    """A worker's table, which its next tasks use again."""
    if path not in _TABLES:
        _TABLES[path] = Words(path)
    return _TABLES[path]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, row_no: the pieces of every document's ids and the end id."""
    common.ready(docs.sparkSession)
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(tokenizer)
        for batch in common.gathered(batches, CUT_BYTES):
            for a, b in common.blocks(batch, most=CUT_BYTES):
                part = batch.slice(a, b - a)
                out: list[tuple] = []
                for key, raw in zip(part.column("doc_id").to_pylist(), table.encode(pa.compute.fill_null(part.column("text"), "")), strict=True):
                    raw += end
                    n = len(raw) // 4
                    for k, start in enumerate(range(0, n, capacity)):
                        out.append((key, k, start, min(capacity, n - start), zlib.crc32(raw[start * 4 : (start + capacity) * 4])))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])
        common.give_back()

    found = common.slim(docs, "doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")
    return found.withColumn("row_no", F.monotonically_increasing_id())


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of indices by best fit decreasing: each piece goes where the least room remains."""
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = {}
    rooms: list[int] = []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        at = bisect.bisect_left(rooms, sizes[i])
        if at == len(rooms):
            bins.append([])
            room, b = capacity, len(bins) - 1
        else:
            room = rooms[at]
            b = by_room[room].pop()
            if not by_room[room]:
                del by_room[room], rooms[at]
        bins[b].append(i)
        if left := room - sizes[i]:
            if left not in by_room:
                bisect.insort(rooms, left)
                by_room[left] = []
            by_room[left].append(b)
    return bins


def least_bins(sizes: list[int], capacity: int) -> int:
    """A lower bound of the bins (Martello and Toth's): no piece of k or more fits beside one above capacity - k."""
    n = np.bincount(np.asarray(sizes, dtype=np.int64), minlength=capacity + 1)
    count, total = np.cumsum(n), np.cumsum(n * np.arange(capacity + 1))
    half, k = capacity // 2, np.arange(1, capacity // 2 + 1)
    # above half a capacity each has a bin of its own; what is left in those up to capacity - k may hold pieces of k to a half
    open_n, open_sum = count[capacity - k] - count[half], total[capacity - k] - total[half]
    over = total[half] - total[k - 1] - (open_n * capacity - open_sum)
    most = np.max(np.maximum(0, -(-over // capacity)), initial=0)
    return int(max(count[-1] - count[half] + most, -(-total[-1] // capacity)))


class _Takes:
    """What each bin can give back for a step: the distinct sizes of a piece or two of it, in flat arrays.

    A row's key is the size of a piece, or that of two and capacity + 1. A bin that changes writes its rows anew at the end; its old rows then belong to no bin.
    """

    def __init__(self, n: int, capacity: int):
        self.above = capacity + 1
        self.span: list[tuple[int, int]] = [(0, 0)] * n
        self.none, self.used = n, 0
        self.key, self.bin = np.zeros(1024, dtype=np.int64), np.full(1024, n, dtype=np.int64)

    def put(self, b: int, own: list[int]) -> None:
        first, last = self.span[b]
        self.bin[first:last] = self.none
        one, two = _sums(own)
        n = len(one) + len(two)
        if self.used + n > len(self.key):
            self._make_room(n)
        at = self.used
        self.key[at : at + len(one)], self.key[at + len(one) : at + n] = one, [s + self.above for s in two]
        self.bin[at : at + n] = b
        self.span[b], self.used = (at, at + n), at + n

    def _make_room(self, n: int) -> None:
        live = np.flatnonzero(self.bin[: self.used] != self.none)
        live = live[np.argsort(self.bin[live], kind="stable")]
        key, bins, most = self.key[live], self.bin[live], 2 * (len(live) + n)
        self.key, self.bin, self.used = np.zeros(most, dtype=np.int64), np.full(most, self.none, dtype=np.int64), len(live)
        self.key[: len(live)], self.bin[: len(live)] = key, bins
        held = np.bincount(bins, minlength=self.none)
        ends = np.cumsum(held)
        self.span = list(zip((ends - held).tolist(), ends.tolist(), strict=True))


def _sums(own: list[int]) -> tuple[list[int], list[int]]:
    """The distinct sizes of one piece and of two; a bin has few distinct sizes, whatever it holds."""
    n = Counter(own)
    return sorted(n), sorted({*map(sum, itertools.combinations(n, 2)), *(2 * s for s, k in n.items() if k > 1)})


def _above(sums: list[int], capacity: int) -> np.ndarray:
    """For each size from 0 to the capacity the smallest of the sums above it, or a size that fits nowhere."""
    return np.append(sums, 4 * capacity)[np.searchsorted(sums, np.arange(capacity + 1), side="right")]


def improve(bins: list[list[int]], sizes: list[int], capacity: int) -> list[list[int]]:
    """Local search between underfull bins; never opens a bin, and drops those that run empty.

    Every underfull bin gives, the emptiest first, over and over until no bin has a step left or the number of bins is
    the lower bound. A step is taken only if it raises the sum of squared fills.
    """
    bins = [list(b) for b in bins if b]
    least = least_bins([sizes[i] for b in bins for i in b], capacity)
    alive = len(bins)
    if alive <= least:
        return bins
    fill = np.array([sum(sizes[i] for i in b) for b in bins], dtype=np.int64)
    takes = _Takes(len(bins), capacity)
    for b in np.flatnonzero(fill < capacity).tolist():
        takes.put(b, [sizes[i] for i in bins[b]])
    stale, moved = False, True
    while moved and alive > least:
        moved = False
        for d in np.argsort(fill, kind="stable").tolist():
            if alive <= least:
                break
            if fill[d] >= capacity:
                continue
            while bins[d] and (step := _step(d, bins, fill, sizes, capacity, takes)):
                b, give, take = step
                gain = sum(sizes[i] for i in give) - sum(sizes[i] for i in take)
                bins[d] = [i for i in bins[d] if i not in give] + list(take)
                bins[b] = [i for i in bins[b] if i not in take] + list(give)
                fill[d] -= gain
                fill[b] += gain
                takes.put(b, [sizes[i] for i in bins[b]] if fill[b] < capacity else [])
                moved = stale = True
            if stale:
                takes.put(d, [sizes[i] for i in bins[d]])
                stale = False
                if not bins[d]:
                    fill[d] = capacity  # empty: neither gives nor takes
                    alive -= 1
    return [b for b in bins if b]


def _step(d: int, bins: list[list[int]], fill: np.ndarray, sizes: list[int], capacity: int, takes: _Takes) -> tuple | None:
    """A move, else a one-for-one, two-for-one or one-for-two, to the fullest bin that a step raises: (bin, given, taken)."""
    own = [sizes[i] for i in bins[d]]
    room = np.where(fill >= fill[d], capacity - fill, 0)
    room[d] = 0
    one, two = _sums(own)
    if len(fits := np.flatnonzero(room >= one[0])):
        b = int(fits[np.argmin(room[fits])])
        s = one[bisect.bisect_right(one, room[b]) - 1]
        return b, (bins[d][own.index(s)],), ()
    by_one, by_two = _above(one, capacity), _above(two, capacity)
    # a piece is worth taking for one or two, two pieces for one
    gain = np.concatenate([np.minimum(by_one, by_two), by_one]) - np.concatenate([np.arange(capacity + 1)] * 2)
    key, at = takes.key[: takes.used], takes.bin[: takes.used]
    there = np.append(room, 0)[at]
    ok = np.flatnonzero(gain[key] <= there)
    if not len(ok):
        return None
    k = int(ok[np.argmin(there[ok])])
    b, pair, t = int(at[k]), *divmod(int(key[k]), capacity + 1)
    theirs = [sizes[i] for i in bins[b]]
    taken = _pair(bins[b], theirs, t) if pair else (bins[b][theirs.index(t)],)
    if by_one[t] - t <= there[k]:
        return b, (bins[d][own.index(int(by_one[t]))],), taken
    return b, _pair(bins[d], own, int(by_two[t])), taken


def _pair(items: list[int], held: list[int], total: int) -> tuple[int, int]:
    """Two of the items whose sizes make the total."""
    seen: dict[int, int] = {}
    for i, s in zip(items, held, strict=True):
        if total - s in seen:
            return seen[total - s], i
        seen[s] = i
    raise ValueError("no two pieces make the total")


def _pack_group(frame: pd.DataFrame, capacity: int, last: bool) -> pd.DataFrame:
    frame = frame.sort_values(["length", "doc_id", "piece", "row_no"], kind="stable").reset_index(drop=True)
    sizes = frame["length"].tolist()
    bins = improve(best_fit(sizes, capacity), sizes, capacity)
    fills = [sum(sizes[i] for i in b) for b in bins]
    seq, offset = np.full(len(sizes), -1, dtype=np.int64), np.zeros(len(sizes), dtype=np.int64)
    for k, b in enumerate(bins):
        if last or fills[k] >= LOOSE_BELOW * capacity:
            at = 0
            for i in b:
                seq[i], offset[i] = k, at
                at += sizes[i]
    return frame.assign(seq=seq, offset=offset)


def _packer(capacity: int, last: bool, turn: int):
    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        out = _pack_group(frame.drop(columns="grp"), capacity, last)
        out["seq"] = np.where(out["seq"] < 0, -1, ((key[0] << 22) + out["seq"]) * 4 + turn)
        return out

    return run


def pack(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces (doc_id, piece, start, length, ids_crc32, row_no) with sequence_id and offset.

    Every piece gets a place; repeated rows are places of their own; an empty table gives no rows. A group's pieces
    are dealt by a hash of their row number, so that no document, size or copy makes a group large.
    """
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "row_no"]
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, row_no long"
    full = found.filter(F.col("length") >= capacity).select(*columns, (F.col("row_no") * 4).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = found.filter(F.col("length") < capacity).select(*columns)
    done = [full]
    for turn in (1, 2):
        n = rest.count()
        groups = max(1, -(-n // GROUP_PIECES))
        last = turn == 2 or groups == 1

        grouped = rest.withColumn("grp", F.pmod(F.xxhash64("row_no", F.lit(turn)), F.lit(groups))).groupBy("grp")
        packed = common.staged(grouped.applyInPandas(_packer(capacity, last, turn), f"{schema}, seq long, offset long"), "packed")
        done.append(packed.filter("seq >= 0").select(*columns, F.col("seq").alias("sequence_id"), "offset"))
        rest = packed.filter("seq < 0").select(*columns)
        if last:
            break
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset, row_no: all documents in few sequences.

    Null and empty texts are the end id alone. Longer documents than the capacity are cut into full pieces and a last
    one, however long they are; others stay whole. Ties are broken by doc_id, piece and row; repeated rows have places
    of their own; an empty table gives no rows. Other columns are ignored. sequence_id is a number without meaning.
    """
    return pack(common.staged(pieces(docs, tokenizer, capacity, end_id), "pieces"), capacity)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(common.documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json")).drop("row_no")
