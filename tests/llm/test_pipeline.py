"""The pipeline's stages on planted documents, against plain Python."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from sigframe.llm import pieces, pii

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.integers(400)) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A folder with documents and labels: clean ones, toxic ones, exact and near copies, a card number."""
    rng, rows, labels = np.random.default_rng(20), [], []
    for k in range(400):
        words = prose(rng, int(rng.integers(60, 200))).split()
        toxic = k % 8 == 0
        for _ in range(4 * toxic):
            words[int(rng.integers(len(words)))] = str(rng.choice(["scoundrel", "wretch"]))
        rows.append((k, " ".join(words), "en", f"s{k % 3}"))
        labels.append((k, 1, int(toxic)))
    clean = [r for r in rows if r[0] % 8]
    for n, r in enumerate(clean[:20]):
        rows.append((1000 + n, r[1], "en", "s0"))
        words = r[1].split()
        words[len(words) // 2] = "edited"
        rows.append((2000 + n, " ".join(words), "en", "s1"))
    rows += [(3000, "pay with 4111 1111 1111 1111 " + prose(rng, 40), "en", "s2"), (3001, None, "en", None), (3002, "", "en", "s1")]
    folder = f"file:{tmp_path_factory.mktemp('corpus')}"
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    docs.withColumn("score", F.lit("clash")).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, rows


def test_stages(spark, corpus):
    folder, rows = corpus
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in P.STAGES:
        out = stage(spark, docs, folder)
        if name != P.STAGES[-1][0]:
            assert tuple(out.columns) == P.COLUMNS
        out.write.parquet(f"{folder}/out-{name}")
        docs = spark.read.parquet(f"{folder}/out-{name}")
        seen.append({r["doc_id"]: r for r in docs.collect()})
    toxic, once, private, mixed, encoded = seen
    bad = {r[0] for r in rows if r[1] and ("scoundrel" in r[1] or "wretch" in r[1])}
    assert len(bad & set(toxic)) <= 2 and len({r[0] for r in rows} - bad - set(toxic)) <= 2
    assert not any(k in once for k in range(1000, 1020)) and sum(k in once for k in range(2000, 2020)) <= 1
    assert {k for k in toxic if k < 1000 or k >= 3000} - set(once) == {3002}
    text, kinds = pii.pseudonymise(next(r[1] for r in rows if r[0] == 3000), pii.Pseudonyms(pii.session_key(spark)))
    assert private[3000]["text"] == text and kinds == ["card"] and private[3000]["n_chars"] == len(text)
    assert set(mixed) <= set(private) and all(mixed[k]["text"] == private[k]["text"] for k in mixed)
    auto = pieces.PieceAutomaton(pieces.load_pieces())
    assert set(encoded) == set(mixed) and all(r["exact"] and auto.decode(r["piece_ids"]) == (mixed[k]["text"] or "") for k, r in encoded.items())


def test_only_similar_documents_are_copies(spark):
    """Pairs on both sides of 0.8, by the number of shared 5-word shingles; brute force decides."""
    rng, texts = np.random.default_rng(21), []
    for k in range(60):
        words = prose(rng, 200).split()
        other = list(words)
        cut = (15, 20, 24, 30, 36, 44)[k % 6]
        other[-cut:] = prose(rng, cut).split()
        texts += [" ".join(words), " ".join(other)]
    sets = [{tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for t in texts]
    near = [len(a & b) >= 0.8 * len(a | b) for a, b in zip(sets[::2], sets[1::2], strict=True)]
    assert 20 <= sum(near) <= 40
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    kept = {r["doc_id"] for r in P.copies_out(spark, docs, "").collect()}
    assert all(2 * k in kept for k in range(60))
    assert all(2 * k + 1 in kept for k in range(60) if not near[k])
    assert sum(2 * k + 1 not in kept for k in range(60) if near[k]) >= sum(near) - 1


def test_documents_without_an_id_of_their_own_stay(spark):
    """Repeated and null doc_ids: only copies go, whatever id they have."""
    rng = np.random.default_rng(22)
    texts = [prose(rng, 80) for _ in range(12)]
    ids = [None, None, 7, 7, 7, 8, None, 9, 10, 11, 12, 13]
    rows = [*zip(ids, texts, strict=True), (7, texts[2]), (None, texts[3]), (50, texts[0] + " end"), (51, None), (None, ""), (52, "  ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long"), "row": F.lit("clash")})
    kept = [r["text"] for r in P.copies_out(spark, docs, "").collect()]
    assert len(kept) == 13 and sum(not (t or "").strip() for t in kept) == 1
    assert all(any(k in (t, t + " end") for k in kept) for t in texts)
    assert P.copies_out(spark, docs.limit(0), "").count() == 0


def test_mixing_divides_equal_documents(spark):
    same = [(1, "a b c d e", "en", "hot", 9)] * 300
    docs = spark.createDataFrame(same + [(k, f"w{k} x", "en", "cold", 4) for k in range(2, 500)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["source"]: r["n"] for r in P.mixed(spark, docs, "").groupBy("source").agg(F.sum(F.size(F.split("text", " "))).alias("n")).collect()}
    total = 300 * 5 + 498 * 2
    assert abs(got["cold"] - total * 5 / 7) <= 2 and abs(got["hot"] - total * 2 / 7) <= 5


def test_mixing_takes_whole_copies(spark, corpus):
    folder, _ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = P.mixed(spark, docs, folder)
    words = {r["source"]: r["n"] for r in docs.groupBy("source").agg(F.sum(F.size(F.split(F.trim("text"), " "))).alias("n")).collect()}
    taken = {r["source"]: r["n"] for r in got.groupBy("source").agg(F.sum(F.size(F.split(F.trim("text"), " "))).alias("n")).collect()}
    total = sum(n for s, n in words.items() if s)
    want = {s: total * w / 8 for s, w in zip(("s0", "s1", "s2"), (5, 2, 1), strict=True)}
    assert all(abs(taken[s] - want[s]) < 0.01 * want[s] for s in want)
    assert got.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3


def test_run_and_empty(spark, corpus, tmp_path):
    folder, _ = corpus
    assert P.run(spark, folder).where("exact").count() > 100
    empty = f"file:{tmp_path}"
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{empty}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").limit(0).write.parquet(f"{empty}/labels.parquet")
    assert P.run(spark, empty).count() == 0
