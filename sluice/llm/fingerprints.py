"""Document fingerprints: a Merkle tree over units, paragraphs and sections.

A paragraph is a line; it holds units (a few sentences, joined at content-defined places, and of long ones
content-defined runs of characters); paragraphs form sections at content-defined places. Each node's digest covers its children's, so roots test equality, and two trees
are compared by descending only where digests differ. The fingerprint is the whole tree, so that it alone gives
likeness and the places of edits.
"""

from __future__ import annotations

import base64
import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: A sentence ends a unit if it ends a line or the last WINDOW of its characters choose so, one of JOINED on average.
#: Units beyond LONG characters are cut after characters that the last WINDOW of them choose, one of CUT on average, into
#: units of LEAST characters at least (the last may be shorter) and MOST at most, which a byte holds.
JOINED, LONG, WINDOW, CUT, LEAST, MOST = 3, 192, 8, 64, 32, 255
#: One paragraph of so many ends a section, by its digest.
SECTION = 4
#: Characters of a node's digest in a fingerprint: 9 bytes, of a unit 8 and its length.
NODE, _NODE_BYTES = 12, 9
#: Kinds of characters: 1 white space, 3 a sentence's end.
_KIND = np.zeros(0x3002, dtype=np.uint8)
_KIND[[*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = 1
_KIND[[ord(c) for c in ".!?\n"]] = 3
_POWERS = np.array([pow(0x9E3779B1, k + 1, 2**32) for k in range(WINDOW)], dtype=np.uint32)


@dataclass
class Units:
    """A text's units in order: their ends in characters, whether a sentence ends there and a line does, and 9 bytes each."""

    ends: np.ndarray
    sentence: np.ndarray
    line: np.ndarray
    raw: bytes


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
    return h >> np.uint32(16)


def _cuts(codes: np.ndarray, starts: list[int], ends: list[int]) -> list[int]:
    """Where units that are too long are cut: after characters that the last WINDOW of them choose, else after MOST."""
    h = np.zeros(len(codes), dtype=np.uint32)
    for k in range(min(WINDOW, len(codes))):
        h[k:] += (codes[: len(codes) - k] + np.uint32(1)) * _POWERS[k]
    marks = np.flatnonzero(_mixed(h) % np.uint32(CUT) == 0) + 1
    # LEAST is more than WINDOW, so what stands before a unit doesn't matter
    first, last = np.searchsorted(marks, np.array(starts) + LEAST).tolist(), np.searchsorted(marks, ends).tolist()
    marks, out = marks.tolist(), []
    for start, end, i, j in zip(starts, ends, first, last, strict=True):
        for at in [*marks[i:j], end]:
            while at - start > MOST:
                start += MOST
                if start < end:
                    out.append(start)
            if at < end and at - start >= LEAST:
                out.append(at)
                start = at
    return out


def _chosen(codes: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Whether the last characters of each sentence, none before its start, choose it as the end of a unit."""
    h, start = np.zeros(len(stops), dtype=np.uint32), np.concatenate([[0], stops[:-1]])
    for k in range(WINDOW):
        at = stops - 1 - k
        h += np.where(at >= start, codes[np.maximum(at, 0)] + np.uint32(1), np.uint32(0)) * _POWERS[k]
    return _mixed(h) % np.uint32(JOINED) == 0


def units(text: str) -> Units:
    """A sentence ends with the last of its . ! ? or line ends and the white space around them."""
    codes = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
    n = len(codes)
    kind = _KIND[np.minimum(codes, 0x3001)]
    trail = kind > 0
    last = trail.copy()
    last[:-1] &= ~trail[1:]
    runs = np.flatnonzero(last) + 1  # ends of runs of white space and sentence ends
    first = np.flatnonzero(trail & ~np.concatenate([[False], trail[:-1]]))
    counts, lines = np.concatenate([[0], np.cumsum(kind == 3)]), np.concatenate([[0], np.cumsum(codes == 10)])
    stops = runs[counts[runs] > counts[first]]
    own = first[counts[runs] > counts[first]]
    ends = stops[(lines[stops] > lines[own]) | _chosen(codes, stops)] if len(stops) else stops
    if n and (not len(ends) or ends[-1] < n):
        ends = np.append(ends, n)
    sentence = np.ones(len(ends), bool)
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    if len(long := np.flatnonzero(ends - starts > LONG)):
        cuts = np.array(_cuts(codes, starts[long].tolist(), ends[long].tolist()), dtype=ends.dtype)
        both = np.concatenate([ends, cuts])
        order = np.argsort(both, kind="stable")
        ends, sentence = both[order], np.concatenate([sentence, np.zeros(len(cuts), bool)])[order]
        starts = np.concatenate([[0], ends[:-1]])
    encoded = text.encode()
    if len(encoded) == n:
        begin, stop = starts.tolist(), ends.tolist()
    else:
        offset = np.concatenate([[0], np.cumsum(1 + (codes >= 0x80).view(np.uint8) + (codes >= 0x800).view(np.uint8) + (codes >= 0x10000).view(np.uint8), dtype=np.int64)])
        begin, stop = offset[starts].tolist(), offset[ends].tolist()
    leaf = np.zeros((len(ends), _NODE_BYTES), dtype=np.uint8)
    blake = hashlib.blake2b
    leaf[:, :8] = np.frombuffer(b"".join([blake(encoded[a:b], digest_size=8).digest() for a, b in zip(begin, stop, strict=True)]), dtype=np.uint8).reshape(-1, 8)
    leaf[:, 8] = ends - starts
    return Units(ends, sentence, lines[ends] > lines[starts], leaf.tobytes())


def changed(own: Units, text: str, m: int, head: str) -> Units:
    """The units of text[:m] + head, of which those of whole sentences before m are taken from the text's own."""
    # a sentence is whole where the character after it stands before m too
    k = int(np.searchsorted(own.ends, m - 1, side="right"))
    while k and not own.sentence[k - 1]:
        k -= 1
    start = int(own.ends[k - 1]) if k else 0
    rest = units(text[start:m] + head)
    return Units(np.concatenate([own.ends[:k], rest.ends + start]), np.concatenate([own.sentence[:k], rest.sentence]), np.concatenate([own.line[:k], rest.line]), own.raw[: k * _NODE_BYTES] + rest.raw)


@dataclass
class Tree:
    """root, characters, and sections: (digest, paragraphs), a paragraph (digest, its units of NODE characters each)."""

    root: str
    size: int
    sections: list[tuple[str, list[tuple[str, str]]]]

    def __str__(self) -> str:
        return f"{self.root}.{self.size}" + "".join("/" + s + "".join(":" + p + u for p, u in own) for s, own in self.sections)

    @staticmethod
    def read(print_: str) -> Tree:
        head, *sections = print_.split("/")
        root, _, size = head.partition(".")
        cut = lambda p: (p[:NODE], p[NODE:])
        return Tree(root, int(size), [(s[:NODE], [cut(p) for p in s[NODE + 1 :].split(":")]) for s in sections])


def _shown(raw: bytes) -> str:
    return base64.b64encode(raw, altchars=b"-_").decode()


def _node(kind: bytes, raw: bytes, size: int = _NODE_BYTES) -> bytes:
    return hashlib.blake2b(raw, digest_size=size, person=kind).digest()


def tree(own: Units) -> Tree:
    stops = np.flatnonzero(own.line) + 1
    if len(own.ends) and (not len(stops) or stops[-1] < len(own.ends)):
        stops = np.append(stops, len(own.ends))
    sections, tops, digests, held, start = [], [], [], [], 0

    def close() -> None:
        nonlocal digests, held
        tops.append(_node(b"section", b"".join(digests)))
        sections.append((_shown(tops[-1]), held))
        digests, held = [], []

    for stop in stops.tolist():
        raw = own.raw[start * _NODE_BYTES : stop * _NODE_BYTES]
        start = stop
        digests.append(_node(b"paragraph", raw))
        held.append((_shown(digests[-1]), _shown(raw)))
        if digests[-1][0] % SECTION == 0:
            close()
    if held:
        close()
    return Tree(_node(b"root", b"".join(tops), 16).hex(), int(own.ends[-1]) if len(own.ends) else 0, sections)


def fingerprint(text: str) -> str:
    """root.characters, then /section and its :paragraphs, each followed by its units; all nodes as NODE characters of base64."""
    return str(tree(units(text)))


def _differ(x: list[tuple], y: list[tuple]) -> tuple[list, list]:
    """The nodes (digest, children) of each list that the other lacks, copies counted."""
    out = []
    for own, other in ((x, Counter(d for d, _ in y)), (y, Counter(d for d, _ in x))):
        left = []
        for node in own:
            if other[node[0]] > 0:
                other[node[0]] -= 1
            else:
                left.append(node)
        out.append(left)
    return out[0], out[1]


def _weight(nodes: Counter) -> int:
    return sum(base64.b64decode(u, altchars=b"-_")[8] * n for u, n in nodes.items())


def alike(a: Tree, b: Tree) -> float:
    """Twice the characters in common units over those of both; 1 exactly when the roots are equal. Equal branches are not entered."""
    if a.root == b.root:
        return 1.0
    x, y = _differ(a.sections, b.sections)
    x, y = _differ([p for _, own in x for p in own], [p for _, own in y for p in own])
    m, n = (Counter(u[i : i + NODE] for _, u in own for i in range(0, len(u), NODE)) for own in (x, y))
    missing = _weight(m - n) + _weight(n - m)
    total = a.size + b.size
    return min(1 - missing / total, 1 - 1e-9) if total else 0.0


def likeness(a: str, b: str) -> float:
    return 1.0 if a == b else alike(Tree.read(a), Tree.read(b))


def differing(a: str, b: str) -> list[tuple[str, int, int, int, int]]:
    """Where two fingerprints differ: (level, from, to in a, from, to in b), numbered from the level's start in the text.

    Sections are aligned first; only those that differ are compared by paragraph, and only those by unit.
    """
    if a[:32] == b[:32]:
        return []

    def opened(nodes: list[tuple], level: int) -> list[tuple]:
        return [p for _, own in nodes for p in own] if level == 1 else [(u[i : i + NODE], None) for _, u in nodes for i in range(0, len(u), NODE)]

    def descend(x: list[tuple], y: list[tuple], level: int, before: list[tuple[int, int]]) -> list[tuple]:
        """before: for this level and those below, how many nodes stand in front of x and y."""
        out = []
        for tag, i, j, k, m in SequenceMatcher(None, [d for d, _ in x], [d for d, _ in y], autojunk=False).get_opcodes():
            if tag == "equal":
                continue
            if level < 2 and tag == "replace":
                fronts, inner = [(x[:i], y[:k])], []
                for below in range(level + 1, 3):
                    fronts.append(tuple(opened(f, below) for f in fronts[-1]))
                    inner.append((before[below - level][0] + len(fronts[-1][0]), before[below - level][1] + len(fronts[-1][1])))
                out += descend(opened(x[i:j], level + 1), opened(y[k:m], level + 1), level + 1, inner)
            else:
                ox, oy = before[0]
                out.append((("section", "paragraph", "unit")[level], ox + i, ox + j, oy + k, oy + m))
        return out

    return descend(Tree.read(a).sections, Tree.read(b).sections, 0, [(0, 0)] * 3)


def edited(text: str, following: str) -> str:
    """The text with its last quarter of code points replaced by the first as many of the following text."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k] if k else text


def _in_order(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, text, ahead) dealt by ranges of doc_id and sorted; each range ends with the row that follows it.

    Only the smallest doc_id of each range (one number a range) reaches the driver. Texts are shuffled once.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select(docs["doc_id"]).repartitionByRange(n, "doc_id")
    firsts = [r["least"] for r in ids.groupBy(F.spark_partition_id()).agg(F.min("doc_id").alias("least")).collect() if r["least"] is not None]
    starts = np.array(sorted(set(firsts)), dtype=np.int64)
    count = max(1, len(starts))

    @F.pandas_udf("array<int>")
    def ranges(ids: pd.Series, least: pd.Series) -> pd.Series:
        # null ids stand before all others, in the first range
        where = np.maximum(np.searchsorted(starts, ids.fillna(np.iinfo(np.int64).min).astype("int64").to_numpy(), "right") - 1, 0)
        first = np.isin(ids.fillna(0).astype("int64").to_numpy(), starts) & ids.notna().to_numpy() & ~least.to_numpy()
        return pd.Series([[int(w), int(w - 1)] if f else [int(w)] for w, f in zip(where, first, strict=True)])

    nulls = bool(docs.select(docs["doc_id"]).filter(F.col("doc_id").isNull()).limit(1).count())
    lowest = int(starts[0]) if len(starts) else 0
    is_lowest = (F.col("doc_id").isNull() if nulls else F.col("doc_id") == lowest)
    rows = docs.select(docs["doc_id"], F.coalesce(docs["text"], F.lit("")).alias("text"))
    own = ranges("doc_id", F.coalesce(F.col("doc_id") == lowest, F.lit(True)))
    dealt = rows.withColumn("r", F.when(is_lowest, F.array_union(own, F.array(F.lit(-1)))).otherwise(own))
    dealt = dealt.select("doc_id", "text", F.posexplode_outer("r").alias("k", "r"))
    dealt = dealt.select("doc_id", "text", (F.col("k") > 0).alias("ahead"), F.pmod(F.col("r"), F.lit(count)).alias("r"))
    return dealt.repartitionById(count, F.col("r").cast("int")).sortWithinPartitions("ahead", F.col("doc_id").asc_nulls_first(), "text").drop("r")


def prints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is that of the next larger doc_id (the last one's is the first; a lone document is its own).
    Null texts count as empty: no characters, the root over nothing, likeness 1 to another empty text. Very long texts
    are read whole. Rows of one doc_id follow each other by text, repeated rows included. An empty table gives no rows.
    Other columns are ignored.
    """
    common.ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
        before: tuple | None = None
        out: list[tuple] = []
        for batch in batches:
            for a, b in common.blocks(batch):
                for key, text, ahead in zip(*(c.to_pylist() for c in batch.slice(a, b - a).columns), strict=True):
                    own = units(text)
                    mine = tree(own)
                    if before is not None:
                        last_key, last_text, last_units, last_tree = before
                        old = edited(last_text, text)
                        k = len(last_text) // 4
                        other = last_tree if old == last_text else tree(changed(last_units, last_text, len(last_text) - k, text[:k]))
                        out.append((last_key, len(last_text), hashlib.sha256(old.encode()).hexdigest(), str(last_tree), str(other), alike(last_tree, other), alike(last_tree, mine)))
                    before = (key, text, own, mine)
                    if ahead:
                        before = None
                        break
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                    out = []
                if before is None:
                    return

    return _in_order(docs).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prints(common.documents(spark, sf_dir))
