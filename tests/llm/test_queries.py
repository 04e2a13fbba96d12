"""The registered queries at a small size: contracts, digests and the SQL side."""

import hashlib
import os

import duckdb
import pytest

import __spark_entry__ as entry
from sigframe.llm import queries as Q
from sigframe.llm import simhash


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in ("documents", "pages", "labels", "conversations"):
        path = f"{sf}/{t}.parquet"
        if os.path.exists(path):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return c


def rows_of(spark, sf, name):
    df = entry.queries()[name](spark, sf)
    return dict(df.dtypes), {r[0]: r for r in df.collect()}


@pytest.fixture(scope="module")
def docs(duck):
    return dict(duck.execute("SELECT doc_id, coalesce(text, '') FROM documents").fetchall())


def test_all_are_registered():
    assert set(Q.QUERIES) <= set(entry.queries()) and set(Q.ORACLE_SQL) <= set(entry.oracle_sql()) and "pipeline" in entry.queries()


def test_op1(spark, sf, docs):
    kinds, got = rows_of(spark, sf, "op1_chroma_align")
    assert set(got) == set(docs)
    by_text = {}
    for k, t in docs.items():
        by_text.setdefault(t, []).append(k)
    for same in by_text.values():
        assert {got[k]["class_id"] for k in same} == {got[min(same)]["class_id"]}
    assert all(r["group_id"] <= r["class_id"] <= r["doc_id"] for r in got.values())


def test_op2(spark, sf, duck):
    kinds, got = rows_of(spark, sf, "op2_source_mix")
    assert [kinds[c] for c in ("doc_id", "size", "source_size", "target", "taken")] == ["bigint", "bigint", "bigint", "double", "bigint"]
    sizes = dict(duck.execute(r"SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) FROM documents").fetchall())
    source = dict(duck.execute("SELECT doc_id, source FROM documents").fetchall())
    assert {k: r["size"] for k, r in got.items()} == sizes
    total, by, taken = sum(sizes.values()), {}, {}
    for k, r in got.items():
        by[source[k]] = by.get(source[k], 0) + sizes[k]
        taken[source[k]] = taken.get(source[k], 0) + r["taken"]
        assert r["taken"] <= 3 * r["size"]
    assert all(r["source_size"] == by[source[k]] for k, r in got.items())
    target = {source[k]: r["target"] for k, r in got.items()}
    assert sum(target.values()) == pytest.approx(total) and all(target[s] <= 3 * by[s] + 1e-6 for s in by)
    assert all(abs(taken[s] - target[s]) <= max(sizes.values()) for s in by)


def test_op3(spark, sf, duck):
    kinds, got = rows_of(spark, sf, "op3_url_filter")
    assert len(got) == duck.execute("SELECT count(*) FROM pages").fetchone()[0] and {r["verdict"] for r in got.values()} <= {"allow", "block"}
    for k, url in duck.execute("SELECT page_id, url FROM pages").fetchall():
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = rest.split("/")[0].split("?")[0].split("#")[0].lower()
        path = rest[len(host) :].split("?")[0].split("#")[0]
        assert (got[k]["host"], got[k]["path"]) == (host, path)


def test_op4(spark, sf, docs):
    import zlib

    kinds, got = rows_of(spark, sf, "op4_toxicity")
    assert [kinds[c] for c in ("held_out", "score", "predicted")] == ["boolean", "double", "int"] and set(got) == set(docs)
    for k, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(k).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)


def test_op5(spark, sf, docs):
    kinds, got = rows_of(spark, sf, "op5_weighted_fingerprint")
    order = sorted(docs, reverse=True)
    for k, after in zip(order, order[1:] + order[:1], strict=True):
        t, n = docs[k], len(docs[k]) // 3
        assert got[k]["n_chars"] == len(t) and got[k]["edited_sha256"] == hashlib.sha256((t[: len(t) - n] + docs[after][:n]).encode()).hexdigest()
        if got[k]["fingerprint"] == got[after]["fingerprint"]:
            assert got[k]["near_next"] == 1.0


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_equals_sql(spark, sf, duck, name):
    df = entry.queries()[name](spark, sf)
    cur = duck.execute(entry.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(repr, (tuple(r) for r in df.select(*names).collect()))) == sorted(map(repr, cur.fetchall()))


def test_op7(spark, sf, docs):
    kinds, got = rows_of(spark, sf, "op7_repeated_bytes")
    raws, seen = {k: t.encode() for k, t in docs.items()}, {}
    for k, b in raws.items():
        for at in range(len(b) - 199):
            h = hash(b[at : at + 200])
            seen[h] = seen.get(h, 0) + 1
    for k, b in raws.items():
        mask = bytearray(len(b))
        for at in range(len(b) - 199):
            if seen[hash(b[at : at + 200])] > 1:
                mask[at : at + 200] = b"\1" * 200
        left = bytes(x for x, m in zip(b, mask, strict=True) if not m)
        spans = sum(1 for x in bytes(mask).split(b"\0") if x)
        assert (got[k]["n_bytes"], got[k]["n_removed"], got[k]["n_spans"], got[k]["kept_sha256"]) == (len(b), sum(mask), spans, hashlib.sha256(left).hexdigest())


def test_op8(spark, sf, docs):
    kinds, got = rows_of(spark, sf, "op8_pseudonyms")
    assert set(got) == set(docs) and any(r["n_values"] for r in got.values())
    assert all(r["n_values"] == len(r["pii_kinds"]) and (r["n_values"] or (r["text"] or "") == docs[k]) for k, r in got.items())


def test_op9(spark, sf, docs):
    kinds, got = rows_of(spark, sf, "op9_simhash")
    value = {k: int.from_bytes(simhash.fingerprint(t), "little") for k, t in docs.items()}
    assert {k: r["fingerprint"] for k, r in got.items()} == {k: f"{v:016x}" for k, v in value.items()}
    root = {k: k for k in value}
    while True:
        new = {a: min(root[b] for b in value if (value[a] ^ value[b]).bit_count() <= 3) for a in value}
        if new == root:
            break
        root = new
    assert {k: r["component_id"] for k, r in got.items()} == root


def test_op10(spark, sf, docs):
    kinds, got = rows_of(spark, sf, "op10_sentencepiece")
    assert set(got) == set(docs) and all(r["exact"] and r["n_pieces"] == len(r["piece_ids"]) for r in got.values())


def test_pipeline(spark, sf, docs):
    rows = entry.queries()["pipeline"](spark, sf).collect()
    assert 0 < len(rows) and {r["doc_id"] for r in rows} <= set(docs) and all(r["exact"] for r in rows)
