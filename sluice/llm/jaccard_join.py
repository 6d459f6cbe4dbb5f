"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence.

Documents with equal sets of n-grams form one class. Classes then pass three bounds derived from sizes before any pair
is counted: a document links only if enough of its n-grams occur in another document at all; its candidates share one
of its rarest n - ceil(t n) + 1 n-grams; and sizes of linked documents differ by the threshold at most. What is left
falls into candidate components, cut into blocks of bounded size; each pair of blocks is one task that multiplies
their incidence matrices, a range of columns at a time, accumulates the overlap counts and drops pairs below the
bound. Large components are first thinned by exact comparison with leaders, so that a huge group of near copies costs
a comparison or two a document; what leaders don't settle goes to the product as well, so no link is lost: a component
whole, or apart by the rare n-grams that its documents share, whichever sends fewer rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from . import common
from .components import connected_components

WORDS, PERCENT = 5, 75
#: n-grams that one task of an exchange holds, about; documents of a block of the product; columns multiplied at once.
BUCKET_GRAMS, BLOCK_DOCS, COLUMNS = 1_000_000, 256, 8192
#: Candidate components beyond so many documents are thinned by leaders first, in so many rounds; there a document
#: looks for leaders under so many of its keys, the most common ones.
LARGE, ROUNDS, LEADER_KEYS = 1024, 3, 3
#: Rows of a slim table (16 bytes each) that is broadcast at most; a larger one is joined by shuffle.
BROADCAST_ROWS = 1_000_000
#: Text bytes of a block that the first exchange sends at once; its arrays take some twenty times as much.
SENT_BLOCK = 4 << 20
#: Hash bits besides the bucket that the first exchange sends; equal ones only weaken its bound.
_SENT_BYTES = 5

_P = [np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _P[2]
    x = (x ^ (x >> np.uint64(33))) * _P[3]
    return x ^ (x >> np.uint64(33))


def grams(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word n-grams; with fewer words the whole sequence is one; none without words."""
    own = text.encode().lower().split()  # of bytes: A-Z only, and ASCII white space only
    if not own:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, own), np.uint64, len(own))
    k = min(words, len(own))
    with np.errstate(over="ignore"):
        out = np.full(len(h) - k + 1, np.uint64(k))
        for i in range(k):
            out = out * _P[0] + _mix(h[i : len(h) - k + 1 + i] + _P[1])
        return np.unique(_mix(out))


def needed(n: int | np.ndarray, percent: int = PERCENT):
    """Common n-grams that a document with n of them needs at least in order to link with any other."""
    return -(-n * percent // 100)


def signature(g: np.ndarray) -> str:
    return xxhash.xxh3_128_hexdigest(g.tobytes())


def _pack40(x: np.ndarray) -> bytes:
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_SENT_BYTES].tobytes()


def _unpack40(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // _SENT_BYTES, 8), np.uint8)
    out[:, :_SENT_BYTES] = np.frombuffer(raw, np.uint8).reshape(-1, _SENT_BYTES)
    return out.reshape(-1).view("<u8")


def _credits(docs: DataFrame, words: int, buckets: int) -> DataFrame:
    """doc_id, n, sig, credit: of each row, its set's size and signature, and how many of its n-grams occur in another row.

    A block of rows sends each of its n-grams once: those in several rows without the row, others with it; so a common
    n-gram costs its bucket one entry a block. Buckets answer with one array of counts a block.
    """
    bits = np.uint64(40)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, turn = TaskContext.get().partitionId(), 0
        for batch in batches:
            for a, b in common.blocks(batch, most=SENT_BLOCK):
                own = batch.slice(a, b - a)
                sets = [grams(t, words) for t in pa.compute.fill_null(own.column(1), "").to_pylist()]
                sizes, sigs = np.array([len(s) for s in sets]), [signature(s) for s in sets]
                flat = np.concatenate(sets)
                sets = None
                row = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
                # buckets by high bits, then the sent bits below them
                bucket = ((flat >> bits) % np.uint64(buckets)).astype(np.int32)
                code = flat & ((np.uint64(1) << bits) - np.uint64(1))
                order = np.lexsort((code, bucket))
                bucket, code, row = bucket[order], code[order], row[order]
                new = np.ones(len(code), bool)
                new[1:] = (code[1:] != code[:-1]) | (bucket[1:] != bucket[:-1])
                start = np.flatnonzero(new)
                several = np.diff(np.append(start, len(code))) > 1
                credit = np.bincount(row[np.repeat(several, np.diff(np.append(start, len(code))))], minlength=len(sizes))
                bucket, code, row = bucket[start], code[start], row[start]
                block = (part << 24) + turn
                turn += 1
                cuts = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket))
                out = [(-1 - block, block, b"", b"", b"", own.column(0).to_pylist(), sizes.tolist(), sigs, credit.tolist())]
                for x, y in zip(cuts, cuts[1:], strict=False):
                    once = ~several[x:y]
                    out.append((int(bucket[x]), block, _pack40(code[x:y][once]), row[x:y][once].astype("<u4").tobytes(), _pack40(code[x:y][~once]), None, None, None, None))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _SENT, strict=True)], names=_SENT_NAMES)
        common.give_back()

    def answer(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        if key[0] < 0:  # a block's own rows pass through
            return frame[["block", "ids", "sizes", "sigs", "credit"]].assign(counts=None)
        once = [_unpack40(x) for x in frame["once"]]
        several = [_unpack40(x) for x in frame["several"]]
        # a code of several rows of a block counts twice, so that others that hold it are credited
        seen = np.sort(np.concatenate([*once, *several, *several]))
        shared = np.unique(seen[1:][seen[1:] == seen[:-1]])
        out = []
        for block, codes, rows in zip(frame["block"], once, frame["row"], strict=True):
            at = np.searchsorted(shared, codes)
            hit = np.zeros(len(codes), bool)
            hit[at < len(shared)] = shared[at[at < len(shared)]] == codes[at < len(shared)]
            if hit.any():
                out.append((block, np.bincount(np.frombuffer(rows, "<u4")[hit]).astype("<u4").tobytes()))
        nothing = pd.Series([None] * len(out), dtype=object)
        return pd.DataFrame({"block": pd.Series([b for b, _ in out], dtype="int64"), "ids": nothing, "sizes": nothing, "sigs": nothing, "credit": nothing, "counts": pd.Series([c for _, c in out], dtype=object)})

    def total(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        own = frame["counts"].isna()
        table = frame[own].iloc[0]
        credit = np.array(table["credit"], dtype=np.int64)
        for raw in frame["counts"][~own]:
            c = np.frombuffer(raw, "<u4")
            credit[: len(c)] += c
        return pd.DataFrame({"doc_id": pd.array(table["ids"], dtype="Int64"), "n": table["sizes"], "sig": table["sigs"], "credit": credit})

    sent = common.slim(docs, "doc_id", "text").mapInArrow(send, _SENT_DDL)
    answers = sent.groupBy("bucket").applyInPandas(answer, "block long, ids array<long>, sizes array<long>, sigs array<string>, credit array<long>, counts binary")
    return common.staged(answers.groupBy("block").applyInPandas(total, "doc_id long, n long, sig string, credit long"), "credits")


_SENT_DDL = "bucket long, block long, once binary, row binary, several binary, ids array<long>, sizes array<long>, sigs array<string>, credit array<long>"
_SENT_NAMES = ["bucket", "block", "once", "row", "several", "ids", "sizes", "sigs", "credit"]
_SENT = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int64()))


def _sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """idx, sig, n, grams (ascending) of one row of each wanted (doc_id, sig)."""
    n = wanted.count()
    small = F.broadcast(wanted) if n <= BROADCAST_ROWS else wanted
    found = docs.select(docs["doc_id"].alias("id"), docs["text"]).join(small.select(F.col("doc_id").alias("w"), "sig"), F.col("id").eqNullSafe(F.col("w"))).select("sig", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in common.blocks(batch):
                own = batch.slice(a, b - a)
                out = [(s, len(g), g.view(np.int64)) for s, t in zip(*(c.to_pylist() for c in own.columns), strict=True) if signature(g := grams(t or "", words)) == s]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.list_(pa.int64())), strict=True)], names=["sig", "n", "grams"])
        common.give_back()

    rows = found.mapInArrow(run, "sig string, n long, grams array<long>")
    # repeated rows and repeated ids give a class twice
    return common.staged(rows.withColumn("idx", F.monotonically_increasing_id()), "sets")


def _keys(sets: DataFrame, percent: int) -> DataFrame:
    """gram, idx, n: of each set the n-grams by which it must meet any other that it links with, rarest first.

    A document's order is by document frequency, then hash: the same for all. Frequencies are counted over all sets by
    n-gram; a set keeps those that another has too, and only if they are enough.
    """
    each = sets.select("idx", "n", F.explode("grams").alias("gram"))
    df = each.groupBy("gram").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    held = common.join_spread(each, df, "gram", "df", sets.agg(F.sum("n")).first()[0] or 0, ("idx", "gram"))
    own = held.groupBy("idx", "n").agg(F.sort_array(F.collect_list(F.struct("df", "gram"))).alias("g"))  # one document's n-grams at most
    lone = F.col("n") - F.size("g")  # those that no other has stand first in its order
    take = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - lone
    return common.staged(own.filter(take > 0).select("idx", "n", F.explode(F.slice("g", F.lit(1), take.cast("int"))).alias("g")).select("g.gram", "idx", "n"), "keys")


def _linked(inter, a, b, percent: int):
    return inter * 100 >= (a + b - inter) * percent


def _by_gram(keys: DataFrame, table: DataFrame) -> DataFrame:
    """keys with their n-gram's row in table, which counts the n-gram's keys in c; an n-gram of very many is spread."""
    return common.join_spread(keys, table, "gram", "c", keys.count(), ("gram", "idx")).drop("c")


def _groups(keys: DataFrame) -> DataFrame:
    """idx, grp: candidate components of the keys, a written table."""
    least = keys.groupBy("gram").agg(F.min("idx").alias("b"), F.count(F.lit(1)).alias("c"))
    edges = _by_gram(keys, least).filter("idx <> b").select(F.col("idx").alias("a"), "b").distinct()
    return common.staged(connected_components(edges).select(F.col("node").alias("idx"), F.col("component").alias("grp")), "groups")


def _lead(keys: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame | None, DataFrame]:
    """Links found by exact comparison with leaders, and idx, comp: the components that they make, of the sets in keys."""
    n = F.count(F.lit(1)).alias("c")
    own = Window.partitionBy("idx").orderBy(F.col("common").desc(), "gram")  # a document's keys
    links, comp = None, common.staged(keys.select("idx").distinct().withColumn("comp", F.col("idx")), "alone")
    common_ = _by_gram(keys, keys.groupBy("gram").agg(n).withColumn("common", F.col("c")))
    few = common.staged(common_.withColumn("k", F.row_number().over(own)).filter(F.col("k") <= LEADER_KEYS).select("gram", "idx", "n"), "leader-keys")
    arrays = sets.select("idx", "n", "grams")
    for turn in range(ROUNDS):
        here = common.staged(few.join(comp, "idx"), "here")
        lead = here.groupBy("gram").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min_by(F.struct("idx", "comp", "n"), F.xxhash64("idx", F.lit(turn))).alias("lead"), n).filter("lo <> hi").select("gram", "lead", "c")
        near = _by_gram(here, lead).filter((F.col("comp") != F.col("lead.comp")) & (F.least("n", "lead.n") * 100 >= F.greatest("n", "lead.n") * percent))
        met = near.groupBy("idx", F.col("lead.idx").alias("b")).agg(n)
        pairs = common.staged(met.groupBy("idx").agg(F.max_by("b", F.struct("c", "b")).alias("b")), "pairs")
        common.drop_staged(here)
        if pairs.isEmpty():
            break
        own_ = pairs.join(arrays, "idx").select("b", F.col("idx").alias("a"), F.col("n").alias("n_a"), F.col("grams").alias("g_a"))
        both = own_.join(arrays.select(F.col("idx").alias("b"), F.col("n").alias("n_b"), F.col("grams").alias("g_b")), "b")
        inter = F.size(F.array_intersect("g_a", "g_b"))
        found = both.select("a", "b", "n_a", "n_b", inter.alias("i")).filter(_linked(F.col("i"), F.col("n_a"), F.col("n_b"), percent)).select("a", "b")
        links = common.staged(found if links is None else links.unionByName(found), "links")
        groups = connected_components(links).select(F.col("node").alias("idx"), F.col("component").alias("c"))
        comp = common.staged(comp.select("idx").join(groups, "idx", "left").select("idx", F.coalesce("c", "idx").alias("comp")), "comps")
    return links, comp


def _apart(keys: DataFrame, comp: DataFrame) -> DataFrame:
    """idx, grp, comp: what the product still has to compare of documents (gram, idx, n) that make components comp.

    Keys whose documents are of one component can't give a new link. What is left falls into candidate components
    again; each is compared whole, or by key where that sends fewer rows (keys of the same documents count once): a
    chain of documents that share a little with the next one each is not compared all with all.
    """
    many = lambda c: F.col(c) * F.ceil(F.col(c) / BLOCK_DOCS)  # noqa: E731  rows that are sent for so many documents
    open_ = keys.join(comp, "idx").groupBy("gram").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("c")).filter("lo <> hi").select("gram", "c")
    left = common.staged(_by_gram(keys, open_), "open-keys")
    whole = _groups(left)
    wide = lambda seed: F.sum(F.xxhash64("idx", F.lit(seed)).cast("decimal(20,0)"))
    same = left.groupBy("gram").agg(F.count(F.lit(1)).alias("c"), F.min("idx").alias("idx"), F.max("idx").alias("last"), wide(1).alias("x"), wide(2).alias("y"))
    kept = same.groupBy("idx", "last", "c", "x", "y").agg(F.min("gram").alias("gram"))
    kept = common.staged(kept.join(whole, "idx").select("gram", "c", "grp"), "kept-keys")
    by_key = kept.groupBy("grp").agg(F.sum(many("c")).alias("by_key"))
    sizes = whole.groupBy("grp").agg(F.count(F.lit(1)).alias("size"))
    chosen = common.staged(by_key.join(sizes, "grp").filter(F.col("by_key") < many("size")).select("grp"), "by-key")
    one = whole.join(chosen, "grp", "left_anti").select("idx", "grp")
    many_ = _by_gram(left, kept.join(chosen, "grp", "left_semi").select("gram", "c")).select("idx", F.col("gram").alias("grp"))
    return one.unionByName(many_).join(comp, "idx").select("idx", "grp", "comp")


def _candidates(keys: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame | None]:
    """idx, grp, comp: groups of documents that may hold links, with the components that leaders found; and their links."""
    groups = _groups(keys)
    large = common.staged(groups.groupBy("grp").count().filter(F.col("count") > LARGE).select("grp"), "large")
    if large.isEmpty():
        return groups.withColumn("comp", F.col("idx")), None
    big = groups.join(large, "grp", "left_semi")
    big_keys = common.staged(keys.join(big.select("idx"), "idx", "left_semi"), "big-keys")
    links, comp = _lead(big_keys, sets, percent)
    members = groups.join(large, "grp", "left_anti").withColumn("comp", F.col("idx")).unionByName(_apart(big_keys, comp))
    return common.staged(members, "members"), links


def multiply(left: list[np.ndarray], right: list[np.ndarray], columns: int = COLUMNS) -> np.ndarray:
    """Overlap counts of each left with each right set: the product of their incidence matrices, `columns` at a time."""
    flat = np.concatenate([*left, *right])
    if not len(flat):
        return np.zeros((len(left), len(right)), np.int64)
    row = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in (*left, *right)])
    _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    common_ = np.cumsum(count > 1) - 1
    keep = count[column] > 1
    row, column = row[keep], common_[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(left), len(right)), np.float64)
    total = int(column[-1]) + 1 if len(column) else 0
    for a in range(0, total, columns):
        x, y = np.searchsorted(column, [a, a + columns])
        m = np.zeros((len(left) + len(right), min(columns, total - a)), np.float32)
        m[row[x:y], column[x:y] - a] = 1
        out += m[: len(left)] @ m[len(left) :].T
    return out.astype(np.int64)


def _band(n: F.Column, percent: int) -> F.Column:
    """Sizes whose documents can link differ by one band at most."""
    return F.floor(F.log(n.cast("double")) / np.log(100 / percent) + 1e-9).cast("int")


def _dealt(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """grp, idx, comp, lo, i, hi, j, left, right: each document at each pair of blocks (i of band lo, j of band hi) that it takes part in.

    A block holds about BLOCK_DOCS documents of a group and of similar size, and meets those of its own and the next band.
    """
    group = F.concat_ws("_", "grp", "band")
    rows = members.join(sets.select("idx", "n"), "idx").withColumn("band", _band(F.col("n"), percent))
    counts = common.staged(rows.groupBy("grp", "band").agg(F.count(F.lit(1)).alias("c"), F.ceil(F.count(F.lit(1)) / BLOCK_DOCS).cast("int").alias("blocks")), "blocks")
    beside = lambda step, name: counts.select("grp", (F.col("band") - step).alias("band"), F.col("blocks").alias(name))
    near = counts.join(beside(1, "above"), ["grp", "band"], "left").join(beside(-1, "below"), ["grp", "band"], "left").select(group.alias("group"), "c", "blocks", "above", "below")
    rows = common.join_spread(rows.withColumn("group", group), near, "group", "c", counts.agg(F.sum("c")).first()[0] or 0, ("group", "idx"))
    rows = rows.withColumn("k", F.pmod(F.xxhash64("idx"), F.col("blocks")).cast("int"))
    # the blocks that this one meets: its own band's, once a pair, and all of the band above; and it is met by those below
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    mine = F.transform(upto(F.col("blocks")), lambda j: F.struct(F.col("band").alias("lo"), F.least("k", j).alias("i"), F.col("band").alias("hi"), F.greatest("k", j).alias("j"), (F.col("k") <= j).alias("left"), (F.col("k") >= j).alias("right")))
    above = F.transform(upto(F.coalesce("above", F.lit(0))), lambda j: F.struct(F.col("band").alias("lo"), F.col("k").alias("i"), (F.col("band") + 1).alias("hi"), j.alias("j"), F.lit(True).alias("left"), F.lit(False).alias("right")))
    below = F.transform(upto(F.coalesce("below", F.lit(0))), lambda j: F.struct((F.col("band") - 1).alias("lo"), j.alias("i"), F.col("band").alias("hi"), F.col("k").alias("j"), F.lit(False).alias("left"), F.lit(True).alias("right")))
    return rows.select("grp", "idx", "comp", F.explode(F.concat(mine, above, below)).alias("t")).select("grp", "idx", "comp", "t.*")


def _product(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b: links between sets of one group (idx, grp, comp) that are not of one component yet."""
    dealt = _dealt(members, sets, percent).join(sets.select("idx", "grams"), "idx")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        x, y = frame[frame["left"]], frame[frame["right"]]
        if not len(x) or not len(y) or frame["comp"].nunique() < 2:
            return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
        gx, gy = list(x["grams"]), list(y["grams"])
        nx, ny = np.array([len(g) for g in gx])[:, None], np.array([len(g) for g in gy])[None, :]
        inter = multiply(gx, gy)
        i, j = np.nonzero(_linked(inter, nx, ny, percent) & (x["comp"].to_numpy()[:, None] != y["comp"].to_numpy()[None, :]))
        a, b = x["idx"].to_numpy()[i], y["idx"].to_numpy()[j]
        return _forest(a, b)

    return common.staged(dealt.groupBy("grp", "lo", "i", "hi", "j").applyInPandas(run, "a long, b long"), "product")


def _forest(a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
    """A spanning forest of the links: what components need of them, one less than their documents at most."""
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := above.get(x, x)) != x:
            above[x] = above.get(y, y)
            x = y
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = top(x), top(y)
        if p != q:
            above[max(p, q)] = min(p, q)
            out.append((x, y))
    return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)


def link_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, class_id for every row of docs.

    class_id is the signature of the row's set of n-grams. component_id is the smallest doc_id reachable by links, the
    row's own included. Null and empty texts, and those without words, have an empty set and link with nothing, not
    even each other. Very long texts take part whole. Repeated rows are of one class; a doc_id with several texts has a
    row for each. An empty table gives no rows. Other columns are ignored.
    """
    common.ready(docs.sparkSession)
    # a word and its white space are six bytes or so
    size = docs.agg(F.sum(F.octet_length(docs["text"]))).first()[0] or 0
    credits = _credits(docs, words, max(1, -(-size // (6 * BUCKET_GRAMS))))
    classes = credits.filter("n > 0").groupBy("sig").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"), F.max("credit").alias("credit"), F.count(F.lit(1)).alias("c"))
    classes = common.staged(classes, "classes")
    wanted = classes.filter(F.col("credit") * 100 >= F.col("n") * percent).select("doc_id", "sig")
    sets = _sets(docs, wanted, words)
    sets = common.staged(sets.dropDuplicates(["sig"]), "classes-sets") if sets.groupBy("sig").count().filter("count > 1").count() else sets
    keys = _keys(sets, percent)
    members, links = _candidates(keys, sets, percent)
    found = _product(members, sets, percent)
    links = found if links is None else links.unionByName(found)
    parts = connected_components(links)
    named = parts.join(sets.select(F.col("idx").alias("node"), "sig"), "node").join(classes.select("sig", "doc_id"), "sig")
    named = common.staged(named.select("component", "sig", "doc_id"), "named")
    common.drop_staged(sets, keys, found)
    lowest = named.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.min("sig").alias("group_id"))
    of = named.join(lowest, "component").select("sig", "component_id", "group_id")
    own = classes.join(of, "sig", "left").select("sig", "c", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("group_id", "sig").alias("group_id"))
    rows = common.join_spread(credits.filter("n > 0"), own, "sig", "c", classes.agg(F.sum("c")).first()[0] or 0, ("doc_id", "sig"))
    rows = rows.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("sig").alias("class_id"), "group_id")
    alone = credits.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.col("sig").alias("class_id"), F.lit(None).cast("string").alias("group_id"))
    return rows.unionByName(alone)


def keep_one(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of docs, with all their columns, without those that a kept one is linked with or equals in its n-grams.

    Of each component the row with the smallest doc_id stays, of several such the one of the smallest signature, of
    repeated rows one; rows without words, null and empty texts all stay. Very long texts take part whole; an empty
    table stays empty.
    """
    found = common.staged(link_components(docs, words, percent), "linked")
    stay = found.filter(F.col("group_id").isNotNull()).groupBy("group_id").agg(F.min(F.struct("doc_id", "class_id")).alias("s")).select("s.*")
    if found.groupBy("doc_id").count().filter("count > 1").limit(1).count():
        return _keep_rows(docs, stay, words)
    gone = found.filter(F.col("group_id").isNotNull()).join(stay, ["doc_id", "class_id"], "left_anti").select(F.col("doc_id").alias("gone_id"))
    gone = common.staged(gone, "gone")
    small = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    return docs.join(small, docs["doc_id"] == small["gone_id"], "left_anti")


def _keep_rows(docs: DataFrame, stay: DataFrame, words: int) -> DataFrame:
    """keep_one() where a doc_id has several rows: rows are told apart by their sets' signatures and a row number."""
    at, width = docs.columns.index("text"), len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [grams(t, words) for t in pa.compute.fill_null(batch.column(at), "").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([signature(g) if len(g) else None for g in sets], pa.string())], names=[*(f"c{i}" for i in range(width)), "class_id"])

    schema = StructType([*(StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.schema.fields)), StructField("class_id", StringType())])
    rows = common.staged(docs.mapInArrow(run, schema).withColumn("row_no", F.monotonically_increasing_id()), "signed")
    key = F.col(f"c{docs.columns.index('doc_id')}")
    first = rows.join(stay.select(F.col("doc_id").alias("s_id"), F.col("class_id").alias("s_class")), key.eqNullSafe(F.col("s_id")) & (F.col("class_id") == F.col("s_class")))
    first = first.groupBy("s_id", "s_class").agg(F.min("row_no").alias("row_no")).select("row_no")
    kept = rows.filter("class_id IS NULL").unionByName(rows.join(first, "row_no", "left_semi").select(rows.columns))
    return kept.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_components(common.documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 75 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, reached) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.reached = e.a)
SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.reached) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""
