import zlib
from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from sluice.llm import exact_dedup, jaccard_join, packing, queries, quality_net, toxicity

from .edges import sentences, words
from .test_operators import near_copies


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    """A small corpus with labels, junk, toxic texts, exact and near copies."""
    base = tmp_path_factory.mktemp("sf")
    good = [sentences(60 + i % 40, i) for i in range(150)]
    junk = [" | ".join(words(60, i)) for i in range(100)]
    toxic = [sentences(60, i + 500) + " You grobnik idiot moron." for i in range(100)]
    near = [t.capitalize() + "." for t in near_copies(20, 120, 2, 9)]
    rows = [(i, t) for i, t in enumerate(good + junk + toxic + near + good[:30] + ["", None])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([(i, int(not 150 <= i < 250), int(250 <= i < 350)) for i in range(350)], "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    return str(base)


def test_stages_equal_plain_steps(spark, sf):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "exact_dedup", "near_dedup", "packing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    net, lexicon = quality_net.train(docs, labels), None
    rows = {i: t for i, t in rows.items() if quality_net.score(net, [(t or "").encode()])[0] >= quality_net.THRESHOLD}
    left = docs.filter(docs["doc_id"].isin(list(rows)))
    lexicon = toxicity.learn(toxicity.sample(left, labels))
    rows = {i: t for i, t in rows.items() if lexicon.score(t or "") < toxicity.THRESHOLD}
    last = {t or "": i for i, t in sorted(rows.items())}
    rows = {i: t for i, t in rows.items() if last[t or ""] == i}
    sets = {i: set(jaccard_join.grams(t or "").tolist()) for i, t in rows.items()}
    above = {i: i for i in rows}

    def top(x):
        while above[x] != x:
            x = above[x]
        return x

    for a in rows:
        for b in rows:
            if a < b and 100 * len(sets[a] & sets[b]) >= 75 * max(1, len(sets[a] | sets[b])):
                x, y = sorted((top(a), top(b)))
                above[y] = x
    rows = {i: t for i, t in rows.items() if top(i) == i}
    got = corpus_pipeline.run(spark, sf).collect()
    assert {r["doc_id"] for r in got} == set(rows) and len(rows) < 250
    import public_tokenizers

    table = packing.Words(public_tokenizers.path("word_bpe_49k.json"))
    end = (1).to_bytes(4, "little")
    assert Counter((r["doc_id"], r["ids_crc32"]) for r in got) == Counter((i, zlib.crc32(table.encode([t or ""])[0] + end)) for i, t in rows.items())


def test_stages_keep_columns_and_bear_nothing(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for docs_in in (docs.limit(0), docs.limit(3)):
        left = docs_in
        for _, stage in corpus_pipeline.STAGES[:-1]:
            left = stage(spark, left, sf)
            assert left.columns == docs.columns and left.count() <= docs_in.count()
        corpus_pipeline.STAGES[-1][1](spark, left, sf).count()


def test_queries_equal_their_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet/*.parquet'")
    for name in ("op3_jaccard_join", "op7_exact_dedup"):
        got = Counter(tuple(r) for r in queries.QUERIES[name](spark, sf).collect())
        frame = con.sql(queries.ORACLES[name])
        assert got == Counter(frame.fetchall()), name
    assert exact_dedup.op7(spark, sf).columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert set(queries.ORACLES) <= set(queries.QUERIES) and len(queries.QUERIES) == 10
