"""The training-data operators against brute force, round trips and held-out rows, with odd inputs."""

import hashlib
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sigframe.llm import chat, chroma, common, cws, feistel, linkgraph, mixing, pieces, pii, repeats, simhash, toxicity

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.integers(50)) for _ in range(n))


def docs_of(spark, texts, extra=False):
    rows = [(k if t is not ... else None, None if t is ... else t) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({c: F.lit("clash") for c in ("score", "row", "fp", "part", "node")}) if extra else df


@pytest.fixture(scope="module")
def odd():
    rng = np.random.default_rng(0)
    base = prose(rng, 120)
    return ["", None, base, base, base + " end", "x" * 3000, prose(rng, 6000), "one", "two words", "  \n\t ", "Ünïcödé ▁ mark </s> 漢字", prose(rng, 80)]


# Components.


def test_components(spark):
    rng = np.random.default_rng(1)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 120, (90, 2))] + [(k, k + 1) for k in range(200, 260)] + [(300, k) for k in range(301, 400)]
    got = {r["node"]: r["root"] for r in common.components(spark.createDataFrame(pairs, "a long, b long"), common.Cuts(spark, "t")).collect()}
    parent = {}

    def top(k):
        while parent.setdefault(k, k) != k:
            k = parent[k]
        return k

    for a, b in pairs:
        x, y = sorted((top(a), top(b)))
        parent[y] = x
    linked = {k for a, b in pairs if a != b for k in (a, b)}
    assert got == {k: top(k) for k in linked}


# 1. Chroma.


def tune(rng, seconds, rate=8000):
    t = np.arange(int(0.125 * rate)) / rate
    notes = rng.integers(0, 36, int(seconds / 0.125))
    return np.concatenate([np.sin(2 * np.pi * 220 * 2 ** (n / 12) * t) + 0.4 * np.sin(4 * np.pi * 220 * 2 ** (n / 12) * t) for n in notes])


def test_recordings_align(spark):
    rng = np.random.default_rng(2)
    a, b = tune(rng, 8), tune(rng, 8)
    pcm = lambda x: (x * 9000).astype("<i2").tobytes()
    cut = a[64 * 100 :] + 0.002 * rng.normal(size=len(a) - 6400)
    rows = [(0, pcm(a)), (1, pcm(cut)), (2, pcm(b)), (3, pcm(a)), (4, b""), (5, None), (6, pcm(a[:10]))]
    got = {r["id"]: r for r in chroma.align(spark.createDataFrame(rows, "id long, audio binary"), kind="pcm16").collect()}
    assert got[1]["other"] == 0 and got[1]["shift"] == -100 and got[1]["same"] and got[1]["group_id"] == 0
    assert got[3]["class_id"] == 0 and got[2]["group_id"] == 2 and got[4]["n_ints"] == 0 and got[6]["n_ints"] >= chroma.RUN
    assert got[1]["bit_errors"] < 0.05 * got[1]["bits"] and chroma.align(spark.createDataFrame([], "id long, audio binary")).count() == 0


def plain_alignment(x, y):
    """All matches of all runs that are landmarks, and the bit errors at the commonest offset."""
    votes = {}
    for p, h in zip(*chroma.landmarks(x), strict=True):
        for q, g in zip(*chroma.landmarks(y), strict=True):
            if h == g:
                votes[int(p - q)] = votes.get(int(p - q), 0) + 1
    if not votes:
        return None
    shift = max(votes, key=lambda s: (votes[s], -abs(s), s))
    pairs = [(int(x[k]), int(y[k - shift])) for k in range(len(x)) if 0 <= k - shift < len(y)]
    errors = sum((a ^ b).bit_count() for a, b in pairs)
    return shift, votes[shift], errors, 32 * len(pairs), errors <= 0.15 * 32 * len(pairs) and 2 * len(pairs) >= min(len(x), len(y))


@pytest.mark.parametrize("many", [1 << 14, 0])
def test_offsets_equal_brute_force(many, monkeypatch):
    monkeypatch.setattr(chroma, "MANY_MATCHES", many)
    rng = np.random.default_rng(30)
    for k in range(20):
        alphabet = (2, 50, 1 << 31)[k % 3]
        x = rng.integers(0, alphabet, int(rng.integers(8, 120))).astype(np.uint32)
        y = np.concatenate([x[int(rng.integers(len(x) - 6)) :], rng.integers(0, alphabet, int(rng.integers(0, 40))).astype(np.uint32)])
        want = plain_alignment(x, y)
        if want:
            assert chroma.best_offset(x, y) == want[:2]


def test_unrelated_tunes_stay_apart(spark):
    """Forty tunes, cuts and noisy copies of some, and a medley that holds the beginnings of others."""
    rng = np.random.default_rng(31)
    tunes = [tune(rng, 4) for _ in range(40)]
    pcm = lambda x: (x * 9000).astype("<i2").tobytes()
    medley = np.concatenate([t[: 64 * 120] for t in tunes[10:20]])
    rows = [(0, pcm(medley))] + [(100 + k, pcm(t)) for k, t in enumerate(tunes)]
    rows += [(200 + k, pcm(t[64 * 90 :])) for k, t in enumerate(tunes[:10])]
    rows += [(300 + k, pcm(t + 0.002 * rng.normal(size=len(t)))) for k, t in enumerate(tunes[10:20])]
    rows += [(100, pcm(tunes[5])), (None, pcm(tunes[6])), (None, None), (400, b"")]
    df = spark.createDataFrame(rows, "id long, audio binary").withColumn("ints", F.lit("clash"))
    got = chroma.align(df, kind="pcm16").collect()
    assert len(got) == len(rows)
    by = {r["id"]: r for r in got if r["id"] not in (100, None)}
    want = {**{100 + k: 100 + k for k in range(40)}, **{200 + k: 100 + k for k in range(10)}, **{300 + k: 110 + k for k in range(10)}}
    want = {k: 100 if v == 105 else v for k, v in want.items()}  # id 100 stands for two tunes
    wrong = [k for k, v in want.items() if k != 100 and by[k]["group_id"] != v]
    assert not wrong, wrong
    assert {r["group_id"] for r in got if r["id"] is None} == {106, 400}
    ints = {k: chroma.fingerprint(a, "pcm16") for k, a in rows if k not in (100, None) and a}
    aligned = [r for r in by.values() if r["other"] is not None and r["other"] in ints and r["id"] in ints]
    assert len(aligned) > 20
    for r in aligned:
        assert (r["shift"], r["votes"], r["bit_errors"], r["bits"], r["same"]) == plain_alignment(ints[r["id"]], ints[r["other"]])


def test_every_pair_that_shares_a_landmark_is_aligned(spark, monkeypatch):
    """Takes of one tune, each with its own noise in half of it, and tunes that only share a passage: links, groups and
    best alignments equal those of all pairs, also where a landmark's holders take several blocks."""
    monkeypatch.setattr(chroma, "BLOCK", 3)
    monkeypatch.setattr(chroma, "TILE_PAIRS", 16)
    rng = np.random.default_rng(32)
    base, passage = tune(rng, 4), tune(rng, 1)
    takes = []
    for _ in range(14):
        noise = rng.normal(size=len(base)) * 0.05 * (rng.random(len(base) // 2000 + 1) < 0.4).repeat(2000)[: len(base)]
        takes.append(base + noise)
    takes += [np.concatenate([tune(rng, 3), np.zeros(0), passage]) for _ in range(8)]
    rows = [(k, (x * 9000).astype("<i2").tobytes()) for k, x in enumerate(takes)]
    got = {r["id"]: r for r in chroma.align(spark.createDataFrame(rows, "id long, audio binary"), kind="pcm16").collect()}
    ints = {k: chroma.fingerprint(a, "pcm16") for k, a in rows}
    found = {(k, o): plain_alignment(ints[k], ints[o]) for k in ints for o in ints if o < k}
    found = {p: x for p, x in found.items() if x}
    root = {k: k for k in ints}
    for (k, o), x in sorted(found.items()):
        if x[4]:
            a, b = sorted((root[k], root[o]))
            root = {n: a if r == b else r for n, r in root.items()}
    for k in ints:
        best = max(((x[4], x[1], -o, o, x) for (n, o), x in found.items() if n == k), default=None)
        assert got[k]["links"] == sum(x[4] for p, x in found.items() if k in p), k
        assert got[k]["group_id"] == root[k]
        assert got[k]["other"] == (best and best[3])
        if best:
            assert tuple(got[k][c] for c in ("shift", "votes", "bit_errors", "bits", "same")) == best[4]
    assert sum(x[4] for x in found.values()) > 20


def test_links_need_no_row_for_each_pair(spark, monkeypatch):
    """A large group of takes of one short tune: all links are counted, and no table on the way holds as many rows as there are pairs."""
    sizes, write = [], common.Cuts.write
    monkeypatch.setattr(common.Cuts, "write", lambda self, df: sizes.append((out := write(self, df)).count()) or out)
    rng = np.random.default_rng(34)
    base, n = tune(rng, 0.5), 130
    takes = [base + 0.004 * rng.normal(size=len(base)) for _ in range(n)]
    rows = [(k, (x * 9000).astype("<i2").tobytes()) for k, x in enumerate(takes)]
    got = {r["id"]: r for r in chroma.align(spark.createDataFrame(rows, "id long, audio binary"), kind="pcm16").collect()}
    ints = {k: chroma.fingerprint(a, "pcm16") for k, a in rows}
    found = {(k, o): plain_alignment(ints[k], ints[o]) for k in ints for o in ints if o < k}
    found = {p: x for p, x in found.items() if x}
    links = {p for p, x in found.items() if x[4]}
    assert len({r["mark"] for r in got.values()}) == n and len(links) > 0.9 * n * (n - 1) / 2
    for k in ints:
        assert got[k]["links"] == sum(k in p for p in links)
        best = max(((x[4], x[1], -o, o, x) for (i, o), x in found.items() if i == k), default=None)
        assert got[k]["other"] == (best and best[3]) and (not best or tuple(got[k][c] for c in ("shift", "votes", "bit_errors", "bits", "same")) == best[4])
    assert max(sizes) < len(links) / 2


def test_a_group_is_dealt_in_less_than_its_square(spark):
    """Of 16 times the recordings, each goes to 4 times the tiles."""
    held = lambda n: spark.range(n).select(F.lit(1).alias("landmark"), F.col("id").alias("node"), F.lit(n).alias("n"))
    assert chroma._sorts(held(64_000)) / chroma._sorts(held(4_000)) == pytest.approx(4, rel=0.05)


@pytest.mark.parametrize("at_once", [1, 300, 1 << 20])
def test_a_tile_aligns_as_pairs_do(at_once, monkeypatch):
    """Repeated places, runs of silence and recordings of many lengths, in one sort and in two, whatever is held at once."""
    monkeypatch.setattr(chroma, "AT_ONCE", at_once)
    monkeypatch.setattr(chroma, "MANY_MATCHES", 200)
    rng = np.random.default_rng(35)
    base = rng.integers(0, 1 << 31, 90).astype(np.uint32)
    base[30:60] = base[:30]
    ints = []
    for k in range(24):
        x = base[int(rng.integers(0, 40)) :].copy()
        x[rng.random(len(x)) < 0.08] ^= np.uint32(1 << int(rng.integers(32)))
        ints.append(np.concatenate([x, np.zeros(int(rng.integers(4, 30)) * (k % 4 == 0), np.uint32), rng.integers(0, 1 << 31, int(rng.integers(0, 60))).astype(np.uint32)]))
    nodes = np.sort(rng.choice(1000, 24, replace=False)).astype(np.int64)
    for own in (np.zeros(24, np.int32), (np.arange(24) % 3 == 0).astype(np.int32)):
        facing = 1 - own if own.any() else own
        got = chroma.Tile(nodes, own, facing, ints)
        met = 0
        for a in range(24):
            want = {o: x for o in range(a) if own[o] == facing[a] and (x := plain_alignment(ints[a], ints[o]))}
            found = got.aligned(a)
            assert {int(o): (int(s), int(v), int(e), int(b), bool(y)) for o, s, v, e, b, y in zip(*found, strict=True)} == want if want else found is None
            met += len(want)
        assert met > 60


def test_integral_image_sums(spark):
    rng = np.random.default_rng(3)
    rows = rng.random((40, 12))
    got = chroma.pack(rows)
    for t in (0, 7, 32):
        bits = 0
        for kind, y, h, w in chroma.filters():
            cell = rows[t : t + w, y : y + h]
            if kind == 0:
                a, b = cell[:, : h // 2].sum(), cell[:, h // 2 :].sum()
            elif kind == 1:
                a, b = cell[: w // 2].sum(), cell[w // 2 :].sum()
            elif kind == 2:
                a = cell[: w // 2, : h // 2].sum() + cell[w // 2 :, h // 2 :].sum()
                b = cell.sum() - a
            else:
                a, b = cell.sum(), rows[t : t + w].sum() * h / 12
            level = np.log((a + 0.05) / (b + 0.05))
            code = int(level > -0.3) + int(level > 0) + int(level > 0.3)
            bits = bits << 2 | (code ^ code >> 1)
        assert got[t] == bits


# 2. Mixing.


def test_targets():
    t = mixing.targets_of({"b": 100, "a": 10, None: 100, "c": 1000})
    assert t["a"] == 30 and sum(t.values()) == pytest.approx(1210) and all(t[s] <= 3 * n + 1e-9 for s, n in {"b": 100, "a": 10, None: 100, "c": 1000}.items())
    assert list(mixing.targets_of({"a": 6, "b": 6, "c": 6}).values()) == pytest.approx([11.25, 4.5, 2.25])


def test_flow_is_cheapest():
    cost = lambda n, size: sum(c * min(size, max(0, n - k * size)) for k, c in enumerate(mixing.PASS_COST))
    for targets in ({"a": 20.0, "b": 10.0}, {"a": 20.0, "b": 0.0}, {"a": 5.0, "b": 24.0}, {"a": 30.0, "b": 1.0}):
        sizes = {("a",): 10, ("a", "b"): 7, ("b",): 3}
        got = mixing.route(sizes, targets)
        assert {s: sum(x.get(s, 0) for x in got.values()) for s in targets} == targets
        spent = sum(cost(sum(x.values()), sizes[p]) for p, x in got.items())
        a, b = int(targets["a"]), int(targets["b"])
        best = min(cost(a - x, 10) + cost(x + y, 7) + cost(b - y, 3) for x in range(a + 1) for y in range(b + 1) if a - x <= 30 and x + y <= 21 and b - y <= 9)
        assert spent == best


def test_flow_of_many_patterns():
    rng, patterns = np.random.default_rng(40), {}
    while len(patterns) < 20_000:
        patterns[tuple(sorted({f"s{k}" for k in rng.integers(0, 500, int(rng.integers(1, 5)))}))] = int(rng.integers(1, 900))
    sizes = {}
    for p, words in patterns.items():
        for s in p:
            sizes[s] = sizes.get(s, 0) + words
    scale = sum(patterns.values()) / sum(sizes.values())
    targets = {s: t * scale for s, t in mixing.targets_of(sizes).items()}
    got = mixing.route(patterns, targets)
    given = {s: 0 for s in targets}
    for p, x in got.items():
        assert sum(x.values()) <= 3 * patterns[p]
        for s, n in x.items():
            given[s] += n
    assert sum(abs(given[s] - round(targets[s])) for s in targets) <= 0.001 * sum(targets.values())


@pytest.mark.parametrize("copies", [1, 40, 3000])
def test_mix_divides_repeated_rows(spark, copies):
    """Rows of one doc_id and size: as many as fit are taken, not all or none."""
    rows = [(1, 10, ["hot"])] * copies + [(2, 10, ["b"])] * 40 + [(k, 7, ["c"]) for k in range(100, 400)] + [(None, 9, ["c"]), (None, None, ["c"]), (None, 9, ["c"])]
    df = spark.createDataFrame(rows, "doc_id long, size long, sources array<string>").withColumn("edge", F.lit("clash")).withColumn("h", F.lit(1))
    got = mixing.mix(df).collect()
    assert len(got) == len(rows) and all(r["taken"] <= 3 * r["size"] for r in got)
    by = {}
    for r in got:
        by.setdefault(r["sources"][0], [0, r["target"]])[0] += r["taken"]
    assert all(abs(taken - target) <= 10 for taken, target in by.values()), by


def test_taken_carries_columns(spark):
    rows = [(k % 3, f"text {k}", k % 5, ["a" if k % 2 else "b"]) for k in range(200)] + [(0, "same", 4, ["a"])] * 50
    df = spark.createDataFrame(rows, "doc_id long, text string, size long, sources array<string>").withColumn("rest", F.lit("mine"))
    got = mixing.taken(df.withColumnRenamed("rest", "own"), ["doc_id", "text"]).collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == sorted((r[0], r[1]) for r in rows) and got[0]["own"] == "mine"


def test_mix_meets_targets(spark):
    rng = np.random.default_rng(4)
    rows = [(k, int(rng.integers(1, 400)) if k % 50 else 0, [None if k % 7 == 0 else f"s{k % 7}"]) for k in range(3000)] + [(9000, 50, []), (9001, 60, None), (9002, 10, ["solo"])]
    df = spark.createDataFrame(rows, "doc_id long, size long, sources array<string>")
    got = mixing.mix(df).collect()
    again = mixing.mix(df.repartition(7)).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in got) == sorted((r["doc_id"], r["taken"]) for r in again)
    assert len(got) == len(rows) and all(r["taken"] <= 3 * r["size"] and r["taken"] % max(1, r["size"]) == 0 for r in got)
    by = {}
    for r in got:
        by.setdefault(tuple(r["sources"]), [0, r["target"]])[0] += r["taken"]
    for s, (taken, target) in by.items():
        assert abs(taken - target) <= 20, (s, taken, target)
    assert mixing.mix(df.limit(0)).count() == 0


# 3. URLs.


def test_rules(spark):
    urls = ["https://WWW.Example.com/en/1?x", "http://a.example.com/en/", "http://example.com/fr/", "http://x.net/es/1", "http://x.net/fr", "http://netes/es/", None, "nothing", "http://x.com", "ftp://x.com/#/en/", "a://b://c.com/"]
    df = spark.createDataFrame([(k, u, None) for k, u in enumerate(urls)], "page_id long, url string, html string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in linkgraph.judge_pages(df).collect()}
    assert got[0] == ("www.example.com", "/en/1", "www.example.com/en/", "allow")
    assert got[1] == ("a.example.com", "/en/", "example.com/en/", "block")
    assert got[2] == ("example.com", "/fr/", "com/", "allow")
    assert got[3][2:] == ("net/es/", "block") and got[4][1:3] == ("/fr", None) and got[5][2] is None
    assert got[6] == ("", "", None, "allow") == got[7] and got[8] == ("x.com", "", None, "allow") and got[9][1:3] == ("/", "com/") and got[10][0] == "b:"
    assert linkgraph.judge_pages(df.limit(0)).count() == 0


def test_distrust_flows_against_links(spark):
    link = lambda h: f'<a href="http://{h}/">x</a>'
    pages = [(0, "http://bad.net/es/", ""), (1, "http://fan.org/x", link("bad.net") * 2), (2, "http://good.com/", link("liked.org")), (3, "http://liked.org/", ""), (4, "http://lone.org/", "")]
    got = {r["host"]: r for r in linkgraph.judge_pages(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got["fan.org"]["verdict"] == "block" and got["liked.org"]["verdict"] == "allow" and got["lone.org"]["verdict"] == "allow"
    # dense power iteration
    hosts = sorted(got)
    out = {"fan.org": ["bad.net"], "good.com": ["liked.org"]}
    trust = np.array([float(h == "good.com") for h in hosts])
    seed = trust.copy()
    for _ in range(linkgraph.ROUNDS):
        new = 0.15 * seed
        for h, to in out.items():
            for x in to:
                new[hosts.index(x)] += 0.85 * trust[hosts.index(h)] / len(to)
        trust = new
    assert [got[h]["trust"] for h in hosts] == pytest.approx(trust.tolist())


def verdicts(spark, pages):
    return {r["page_id"]: r["verdict"] for r in linkgraph.judge_pages(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}


def test_distrust_does_not_thin_out(spark):
    fans = [(k, f"http://fan{k}.org/", '<a href="http://bad.net/">x</a>') for k in range(40)]
    got = verdicts(spark, [(100, "http://bad.net/es/", ""), (101, "http://bad.net/", ""), *fans])
    assert got[101] == "block" and all(got[k] == "block" for k in range(40))
    hot = [(k, f"http://hot.net/es/{k}", "") for k in range(200)]
    tail = [row for k in range(20) for row in ((1000 + k, f"http://tail{k}.net/es/", ""), (2000 + k, f"http://tail{k}.net/", ""))]
    got = verdicts(spark, hot + tail)
    assert all(got[2000 + k] == "block" for k in range(20))


def test_distrust_rises_but_spares_the_siblings(spark):
    pages = [(0, "http://bad.big.net/es/", ""), (1, "http://big.net/", '<a href="http://bad.big.net/">x</a>'), (2, "http://own.net/es/", ""), (3, "http://a.own.net/", "")]
    got = verdicts(spark, pages + [(10 + k, f"http://s{k}.big.net/", '<a href="http://big.net/">x</a>') for k in range(5)])
    assert got[1] == "block" and got[3] == "block" and all(got[10 + k] == "allow" for k in range(5))


def test_strangers_under_a_registry_stay_apart(spark):
    pages = [(0, "http://bad.co.uk/", '<a href="http://evil.net/">x</a>'), (1, "http://evil.net/es/", ""), (2, "http://own.co.uk/", ""), (3, "http://a.own.co.uk/", ""), (4, "http://co.uk/", ""), (5, "http://a.b.c.d.com.au/", "")]
    rows = spark.createDataFrame(pages * 2 + [(6, "http://own.co.uk/", "<a href='http://long.org/'>" * 20_000)], "page_id long, url string, html string").withColumn("score", F.lit("clash"))
    got = linkgraph.judge_pages(rows).collect()
    assert len(got) == 13 and {r["distrust"] for r in got if r["page_id"] in (2, 3, 4, 6)} == {0.0}
    assert {r["verdict"] for r in got if r["page_id"] == 0} == {"block"}
    edges = {(r["src"], r["dst"]) for r in linkgraph.host_edges(rows.withColumn("host", linkgraph.host_of(F.col("url")))).collect()}
    assert ("a.own.co.uk", "own.co.uk") in edges and ("own.co.uk", "co.uk") not in edges and ("d.com.au", "com.au") not in edges and ("c.d.com.au", "d.com.au") in edges


def plain_spread(edges, seeds, rounds=linkgraph.ROUNDS, damping=linkgraph.DAMPING):
    """The same iteration over dicts: (host, rose) to score."""
    down = lambda a, b: b.endswith("." + a)
    total, beside = {}, {}
    for (a, b), w in edges.items():
        total[a] = total.get(a, 0) + w
        beside[a] = beside.get(a, 0) + (0 if down(a, b) else w)
    now = {(h, False): s for h, s in seeds.items()}
    for _ in range(rounds):
        new = {(h, False): (1 - damping) * s for h, s in seeds.items()}
        for (h, rose), s in now.items():
            for (a, b), w in edges.items():
                if a == h and (not rose or (not down(a, b) and beside[a])):
                    k = (b, down(b, a))
                    new[k] = new.get(k, 0) + damping * s * w / (beside[a] if rose else total[a])
        now = new
    out = {}
    for (h, _), s in now.items():
        out[h] = out.get(h, 0) + s
    return out


def test_verdicts_equal_brute_force(spark):
    rng = np.random.default_rng(43)
    hosts = [f"{a}{b}" for a in ("", "x.", "y.x.") for b in ("p.org", "q.com", "r.net", "s.co.uk", "t.org", "u.net", "v.info")]
    urls = [f"http://{h}/{p}" for h in hosts for p in ("", "es/1", "en/")]
    pages = [(k, u, "".join(f'<a href="{urls[int(j)]}">z</a>' for j in rng.integers(0, len(urls), int(rng.integers(0, 4))))) for k, u in enumerate(urls)]
    got = {r["page_id"]: r for r in linkgraph.judge_pages(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    host = lambda u: u.split("/")[2]
    edges, ups, allow, block = {}, set(), {}, {}
    for k, u, html in pages:
        for v in re.findall('href="([^"]+)"', html):
            if host(u) != host(v):
                edges[host(u), host(v)] = edges.get((host(u), host(v)), 0) + 1
        if got[k]["rule"]:
            side = allow if got[k]["verdict"] == "allow" else block
            side[host(u)] = side.get(host(u), 0) + 1
    for h in hosts:
        while h.count(".") > (2 if h.endswith(".co.uk") else 1):
            ups.add((h, h.split(".", 1)[1]))
            h = h.split(".", 1)[1]
    for a, b in [*ups, *[(b, a) for a, b in ups]]:
        edges[a, b] = edges.get((a, b), 0) + 1
    norm = lambda x: {h: n / sum(x.values()) for h, n in x.items()}
    trust, distrust = plain_spread(edges, norm(allow)), plain_spread({(b, a): w for (a, b), w in edges.items()}, norm(block))
    for k, u, _ in pages:
        t, d = trust.get(host(u), 0.0), distrust.get(host(u), 0.0)
        assert (got[k]["trust"], got[k]["distrust"]) == (pytest.approx(t, abs=1e-12), pytest.approx(d, abs=1e-12))
        if not got[k]["rule"] and abs(d - t) > 1e-9:
            assert got[k]["verdict"] == ("block" if d > t else "allow")
    assert {r["verdict"] for r in got.values() if not r["rule"]} == {"allow", "block"}


# 4. Toxicity.


def test_marginals_equal_brute_force():
    rng = np.random.default_rng(5)
    sizes, moves = np.array([3, 0, 200, 65, 64, 1]), (0.3, 0.7, 2.0)
    e = rng.normal(size=sizes.sum()) * 3
    got, at, a = toxicity.log_odds(e, sizes, moves), 0, np.array([[1, moves[0]], [moves[1], moves[2]]])
    for n in sizes:
        x, ahead, v = np.exp(e[at : at + n]), [], np.array([1.0, 0.0])
        for t in range(n):
            v = (v @ a) * np.array([1, x[t]])
            v /= v.sum()
            ahead.append(v)
        b = np.ones(2)
        for t in range(n - 1, -1, -1):
            p = ahead[t] * b
            assert np.log(p[1] / p[0]) == pytest.approx(got[at + t])
            b = a @ (np.array([1, x[t]]) * b)
            b /= b.sum()
        at += n


def test_expected_pairs_are_the_gradient_of_an_enumerated_likelihood():
    from itertools import product

    rng = np.random.default_rng(41)
    for sizes, logs in (([5], (-1.0, 0.4, 2.5)), ([3, 0, 1, 4], (0.2, -0.5, 1.0))):
        sizes, e = np.array(sizes), rng.normal(size=sum(sizes)) * 2

        def partition(e, logs, sizes=sizes):
            total, at = 0.0, 0
            for n in sizes:
                score = [sum(e[at + t] * s[t] for t in range(n)) + sum({(0, 1): logs[0], (1, 0): logs[1], (1, 1): logs[2]}.get(p, 0.0) for p in zip((0, *s), s, strict=False)) for s in product((0, 1), repeat=int(n))]
                total += np.log(np.exp(score).sum())
                at += n
            return total

        p, pairs = toxicity.expected_counts(e, sizes, tuple(np.exp(logs)))
        step = 1e-5
        slope = lambda f: (f(step) - f(-step)) / (2 * step)
        assert pairs == pytest.approx([slope(lambda d, k=k: partition(e, [x + d * (j == k) for j, x in enumerate(logs)])) for k in range(3)], abs=1e-6)
        assert p == pytest.approx([slope(lambda d, k=k: partition(e + d * (np.arange(len(e)) == k), logs)) for k in range(len(e))], abs=1e-6)


def test_toxicity_of_odd_tables(spark):
    rows = toxic_corpus(300)
    df = spark.createDataFrame([(k, t) for k, t, _ in rows] + [(4, "another text of four"), (4, rows[4][1]), (None, "none")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, x) for k, _, x in rows] + [(k, x) for k, _, x in rows[:50]] + [(7, 1), (None, 1), (8, None)], "doc_id long, toxic int")
    model = toxicity.fit(df, labels)
    assert model.base is None and toxicity.fit(df.limit(0), labels).base == 0.0
    assert toxicity.score_documents(df.limit(0), model).count() == 0
    long = " ".join([rows[1][1]] * 300)
    got = toxicity.score_documents(spark.createDataFrame([(1, long), (2, long), (3, long + " vileone viletwo scoundrel Wretched! vileone")], "doc_id long, text string"), model).collect()
    assert got[0]["score"] == got[1]["score"] <= got[2]["score"] and all(s["start"] > len(long) for s in got[2]["toxic_spans"][-1:])


def toxic_corpus(n):
    rng = np.random.default_rng(6)
    out = []
    for k in range(n):
        words, toxic = prose(rng, int(rng.integers(20, 120))).split(), k % 5 == 0
        for _ in range(4 * toxic):
            words[int(rng.integers(len(words)))] = str(rng.choice(["vileone", "Wretched!", "VILETWO", "scoundrel,"]))
        out.append((k, " ".join(words), int(toxic)))
    return out


def test_toxicity_on_held_out_rows(spark):
    rows = toxic_corpus(900)
    df = spark.createDataFrame([(k, t) for k, t, _ in rows] + [(5000, None), (5001, "")], "doc_id long, text string").withColumn("score", F.lit("mine"))
    labels = spark.createDataFrame([(k, x) for k, _, x in rows], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score_documents(df, toxicity.fit(df, labels)).withColumn("held", toxicity.held_out()).collect()}
    held = [(got[k], x, t) for k, t, x in rows if got[k]["held"]]
    assert len(held) > 100 and np.mean([r["predicted"] == x for r, x, _ in held]) > 0.97
    spans = [t[s["start"] : s["end"]] for r, x, t in held if x for s in r["toxic_spans"]]
    assert spans and sum(bool(re.search("vile|wretched|scoundrel", s, re.I)) for s in spans) > 0.95 * len(spans)
    assert got[5000]["predicted"] == got[5001]["predicted"] == 0 and got[5000]["score"] == got[5001]["score"]
    assert toxicity.score_documents(df, toxicity.fit(df, labels.limit(0))).where("score <> 0").count() == 0


# 5. Weighted sampling.


def test_collision_rate_is_generalised_jaccard():
    sampler, rng = cws.Sampler(1024), np.random.default_rng(7)
    for _ in range(4):
        a = [str(rng.choice(WORDS)) for _ in range(60)]
        b = a[:35] + [str(rng.choice(WORDS)) for _ in range(25)]
        words = set(a) | set(b)
        want = sum(min(a.count(w), b.count(w)) for w in words) / sum(max(a.count(w), b.count(w)) for w in words)
        assert cws.likeness(sampler.fingerprint(" ".join(a)), sampler.fingerprint(" ".join(b))) == pytest.approx(want, abs=0.06)
    assert (sampler.fingerprint("B a a") == sampler.fingerprint("a b A")).all() and not sampler.fingerprint(" \n").any()


@pytest.mark.parametrize("per", [2_000, 3])
def test_edits_follow_descending_ids(spark, odd, per, monkeypatch):
    monkeypatch.setattr(cws, "CHUNK", 4)
    rng = np.random.default_rng(42)
    rows = [(k, t) for k, t in enumerate(odd)] + [(3, "twin")] + [(None, prose(rng, 5)) for _ in range(9)] + [(5, prose(rng, 4)) for _ in range(9)] + [(6, "hot")] * 11 + [(None, None)] * 9 + [(None, "")] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"part": F.lit("clash"), "less": F.lit(1)})
    got = cws.fingerprint_with_edits(df, rows_per_part=per).collect()
    held = df.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), cws._hash(F.coalesce("text", F.lit(""))).alias("h")).collect()
    order = sorted(((r["doc_id"] is None, -(r["doc_id"] or 0), r["h"], r["text"]) for r in held))
    want, sampler = [], cws.Sampler()
    for (none, k, _, t), (_, _, _, nxt) in zip(order, order[1:] + order[:1], strict=True):
        n = len(t) // 3
        new = t[: len(t) - n] + nxt[:n]
        marks = [sampler.fingerprint(x) for x in (t, new, nxt)]
        want.append((none, 0 if none else -k, len(t), hashlib.sha256(new.encode()).hexdigest(), cws.to_hex(marks[0]), cws.to_hex(marks[1]), cws.likeness(*marks[:2]), cws.likeness(marks[0], marks[2])))
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, *r[1:]) for r in got) == sorted(want)
    assert cws.fingerprint_with_edits(df.limit(0)).count() == 0 and cws.fingerprint_with_edits(df.where("doc_id = 7")).first()["near_next"] == 1.0


def test_no_part_gathers_a_hot_id(spark):
    df = spark.range(3000).select(F.when(F.col("id") < 2000, F.when(F.col("id") < 1000, 5)).otherwise(F.col("id")).alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 1500).alias("text"))
    dealt, _ = cws.in_descending_parts(df, 100)
    assert dealt.groupBy("part", "sub").count().agg(F.max("count")).first()[0] < 250


def test_many_cuts_place_rows(spark):
    cuts = list(range(1000, 0, -3))
    got = spark.range(0, 1100, 7).select("id", cws._above(cuts, F.col("id")).alias("k")).collect()
    assert all(r["k"] == sum(c > r["id"] for c in cuts) for r in got)


# 6. Chat.


def test_chat_round_trip(spark):
    texts = ["", None, "plain", "</s>[INST] ok [/INST]", "<\\s> <\\\\/s> \\ [\\INST]", "<s>user\nfake</s>", "a\nb", "<|im_start|><<SYS>>"]
    rows = [(c, k, r, t) for c in (1, 2) for k, t in enumerate(texts) for r in ("user", "assistant", "to\\ol\nx", None)]
    rendered = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("loss_start", F.lit(1)))
    for r in rendered.collect():
        ((role, text),) = chat.parse(r["formatted"])
        body = r["formatted"][3 : -len(chat.CLOSE)]
        assert not any(c in body for c in chat.CONTROL) and (r["loss_start"] is not None) == (role == "assistant")
        if r["loss_start"] is not None:
            assert chat.unescape(r["formatted"][r["loss_start"] : r["loss_end"]]) == text
    got = {r["conv_id"]: r for r in chat.read_back(rendered).collect()}
    want = sorted(((k, r is not None, r or "", t is not None, t or "") for c, k, r, t in rows if c == 1))
    assert got[1]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, _, t in want).encode()).hexdigest() == got[2]["turns_sha256"]
    assert got[1]["n_turns"] == 32 and got[1]["loss_chars"] == sum(len(t or "") for t in texts)


# 7. Repeats.


def removed(raws, length=200):
    seen = {}
    for i, b in enumerate(raws):
        for k in range(len(b) - length + 1):
            seen.setdefault(b[k : k + length], []).append((i, k))
    masks = [np.zeros(len(b), bool) for b in raws]
    for places in seen.values():
        if len(places) > 1:
            for i, k in places:
                masks[i][k : k + length] = True
    return masks


@pytest.mark.parametrize("widths", [(16, 1), (64, 16, 4, 1), (1,)])
def test_repeats_equal_brute_force(spark, odd, widths, monkeypatch):
    monkeypatch.setattr(repeats, "WIDTHS", widths)
    rng = np.random.default_rng(8)
    shared = [prose(rng, n) for n in (29, 33, 40, 80)]
    texts = [*odd[:6], *odd[7:]] + [prose(rng, int(rng.integers(0, 60))) + " " + str(rng.choice(shared))[int(rng.integers(30)) :] + prose(rng, int(rng.integers(0, 60))) for _ in range(40)] + ["ab" * 150, "é" * 199, "z" * 200]
    df = docs_of(spark, texts, extra=True)
    got = {r["doc_id"]: r for r in repeats.remove_repeats(df).collect()}
    raws = [(t or "").encode() for t in texts]
    for k, (raw, mask) in enumerate(zip(raws, removed(raws), strict=True)):
        r = got[k]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"]) == (len(raw), int(mask.sum()), int((np.diff(np.r_[0, mask.astype(int)]) == 1).sum())), k
        assert bytes(r["kept"]) == np.frombuffer(raw, np.uint8)[~mask].tobytes()
    assert repeats.remove_repeats(df.limit(0)).count() == 0


def test_repeats_of_equal_ids_and_pieces(spark, monkeypatch):
    rng = np.random.default_rng(9)
    text = prose(rng, 60)
    df = spark.createDataFrame([(1, text), (1, text + " tail"), (None, text[5:]), (2, prose(rng, 50))], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["n_bytes"] - r["n_removed"]) for r in repeats.remove_repeats(df).collect())
    assert [x[1] for x in got[:3]] == [0, 0, 5] and got[3][1] > 0
    raw = prose(rng, 900).encode()
    whole = repeats.anchors(raw)
    monkeypatch.setattr(repeats, "PIECE", 1000)
    cut = repeats.anchors(raw)
    pick = lambda x: {(int(s), int(a)) for a, f, e in zip(*x[:3], strict=True) for s in range(int(f), int(e) + 1)}
    assert pick(whole) == pick(cut)


# 8. Pseudonyms.


def test_feistel_is_a_permutation():
    assert sorted(feistel.permute(v, 7, 9, b"k", b"t") for v in range(63)) == list(range(63))
    assert sorted(feistel.permute_range(v, 50, b"k", b"t") for v in range(50)) == list(range(50))
    assert all(feistel.permute_range(feistel.permute_range(v, 50, b"k", b"t"), 50, b"k", b"t", back=True) == v for v in range(50))


SAMPLES = {
    "card": ["4111 1111 1111 1111", "4111111111111111", "378282246310005", "5500-0000-0000-0004"],
    "iban": ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"],
    "phone": ["+1 (017) 555-7713", "+49 30 1234567", "(555) 123-4567", "555-123-4567"],
    "ssn": ["123-45-6789"],
    "ip": ["192.168.0.1", "8.8.8.8"],
    "date": ["1984-02-29", "31.12.2001", "12/31/2001", "3/4/1999", "25/12/2010", "2020/01/05", "12.31.2001"],
    "email": ["jane.doe+x99@mail.example.com"],
    "secret": ["908038b7daaf91e730d2f64001c52934d43d9336", "A" * 20 + "0123456789AB"],
}


@pytest.mark.parametrize("kind", SAMPLES)
def test_pseudonyms_keep_the_format_and_come_back(kind):
    names, back = pii.Pseudonyms(b"key"), pii.Pseudonyms(b"key", back=True)
    same = lambda a, b: a == b or kind == "date" and names.date(a)[:4] and re.split("[-/.]", a) == re.split("[-/.]", b)
    for value in SAMPLES[kind]:
        text, kinds = pii.pseudonymise(f"see {value}, and {value}.", names)
        new = names.of(kind, value)
        assert kinds == [kind, kind] and text == f"see {new}, and {new}." and new != value
        assert same(back.of(kind, new), value)
        shape = lambda s: re.sub("[A-Za-z]", "a", re.sub(r"\d", "0", s))
        if kind not in ("ip", "date", "secret"):
            assert shape(new) == shape(value)
        if kind == "card":
            assert pii.luhn_ok([int(c) for c in new if c.isdigit()])
        if kind == "iban":
            assert pii.iban_ok(new)
    assert pii.pseudonymise(SAMPLES[kind][0], pii.Pseudonyms(b"other"))[0] != pii.pseudonymise(SAMPLES[kind][0], names)[0]


NOTATIONS = {
    "date": (["1999-06-13", "13.06.1999", "13/06/1999", "06/13/1999", "6/13/1999", "1999/6/13", "13-06-1999", "06.13.1999"], lambda s: day_of(s)),
    "phone": (["555-123-4567", "(555) 123-4567", "+1 555-123-4567", "+15551234567", "+1 (555) 123.4567", "555 123 4567"], lambda s: re.sub(r"\D", "", s)[-10:]),
    "phone 49": (["+49 30 1234567", "+49301234567", "+49 (30) 123-4567", "+49 (0)30 1234567"], lambda s: re.sub(r"\D", "", s.replace("(0)", ""))),
    "card": (["4111 1111 1111 1111", "4111111111111111", "4111-1111-1111-1111"], lambda s: re.sub(r"\D", "", s)),
    "iban": (["DE89 3704 0044 0532 0130 00", "DE89370400440532013000"], lambda s: s.replace(" ", "")),
    "email": (["Bob.Smith@x.com", "bob.smith@x.com", "BOB.SMITH@X.COM"], lambda s: s.lower()),
    "secret": (["908038b7daaf91e730d2f64001c52934d43d9336", "908038B7DAAF91E730D2F64001C52934D43D9336"], lambda s: s.lower()),
}


def day_of(text):
    a, b, c = (int(x) for x in re.split("[-/.]", text))
    if a > 31:
        return a, b, c
    return (c, a, b) if a <= 12 and (b > 12 or "/" in text) else (c, b, a)


@pytest.mark.parametrize("kind", NOTATIONS)
def test_all_notations_of_a_value_stay_linked(spark, kind):
    values, normal = NOTATIONS[kind]
    for key in (b"one", b"two", b"three", b"four"):
        df = spark.createDataFrame([(k, f"see {v} now") for k, v in enumerate([*values, *values[:1]])], "doc_id long, text string")
        got = [r["text"][4:-4] for r in pii.pseudonymise_texts(df, key).orderBy("doc_id").collect()]
        assert len({normal(x) for x in got}) == 1 and len({normal(v) for v in values}) == 1, got
        assert normal(got[0]) != normal(values[0])
        back = pii.Pseudonyms(key, back=True)
        assert all(normal(back.of(kind.split()[0], x)) == normal(values[0]) for x in got)


def test_keys_come_from_the_caller(spark):
    with pytest.raises(ValueError):
        pii.Pseudonyms(b"")
    drawn = pii.session_key(spark)
    assert len(drawn) == 32 and drawn == pii.session_key(spark)
    spark.conf.set(pii.KEY_SETTING, "given")
    try:
        assert pii.session_key(spark) == b"given"
    finally:
        spark.conf.unset(pii.KEY_SETTING)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pii.pseudonymise_texts(empty, b"k").count() == 0
    twice = spark.createDataFrame([(1, "8.8.8.8", "x")] * 2, "doc_id long, text string, pii_kinds string")
    assert len({r["text"] for r in pii.pseudonymise_texts(twice, b"k").collect()}) == 1


PLANTED = [  # text, the values in it
    ("mail a.b@c.org, or +44 20 7946 0958; born 1970-01-31.", ["a.b@c.org", "+44 20 7946 0958", "1970-01-31"]),
    ("4111 1111 1111 1111/4111 1111 1111 1112", ["4111 1111 1111 1111"]),
    ("version 1.2.3.4, 1.2.3.4 release, host 1.2.3.4", ["1.2.3.4"]),
    ("123-45-6789 12-34-56 000-00", ["123-45-6789"]),
    ("2001-02-30 31/04/2000 29.02.2000", ["29.02.2000"]),
    ("x@y z@@w.com .q@r.net", ["q@r.net"]),
    ("", []),
]


@pytest.mark.parametrize(("text", "values"), PLANTED)
def test_values_are_found(text, values):
    names = pii.Pseudonyms(b"k")
    assert [text[a:b] for a, b, kind in pii.find_values(text) if names.of(kind, text[a:b])] == values


@pytest.mark.parametrize("text", ["DE89370400440532013000 GB82WEST12345698765432", "AB12 CODE XYZ DE89370400440532013000", "DE89370400440532013000 " * 4])
def test_every_iban_is_found(text):
    want = re.findall(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{18}", text)
    assert [text[a:b] for a, b, kind in pii.find_values(text) if kind == "iban"] == want


def test_pseudonyms_leave_the_rest(spark):
    clean = ["", "4111111111111112 fails", "300.1.2.3 and 2001-02-30", "version 1.2.3.4.5", "a@b, 12-34 plain 1234567", "deadbeef", "x" * 50_000 + " 8.8.8.8"]
    df = docs_of(spark, [*clean, None], extra=True)
    got = {r["doc_id"]: r for r in pii.pseudonymise_texts(df, b"k").collect()}
    assert all(got[k]["text"] == t and not got[k]["pii_kinds"] for k, t in enumerate(clean[:-1])) and got[len(clean)]["text"] is None
    assert got[6]["pii_kinds"] == ["ip"] and got[6]["score"] == "clash"


# 9. SimHash.


def plain_fingerprint(text, n=3):
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[k : k + n]) for k in range(len(w) - n + 1)] if len(w) >= n else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps, radius):
    root = {k: k for k in fps}
    for _ in fps:
        new = {a: min(root[b] for b in fps if (fps[a] ^ fps[b]).bit_count() <= radius) for a in fps}
        if new == root:
            return root
        root = {a: new[new[a]] for a in fps}
    return root


def test_simhash_equals_brute_force(spark, odd):
    rng = np.random.default_rng(10)
    texts = list(odd)
    for _ in range(15):
        words = prose(rng, int(rng.integers(60, 300))).split()
        for _ in range(4):
            copy = list(words)
            copy[int(rng.integers(len(copy)))] = "changed"
            texts.append(" ".join(copy))
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs_of(spark, texts, extra=True)).withColumn("hex", simhash.hex_of()).collect()}
    fps = {k: plain_fingerprint(t) for k, t in enumerate(texts)}
    assert {k: r["hex"] for k, r in got.items()} == {k: f"{f:016x}" for k, f in fps.items()}
    assert {k: r["component_id"] for k, r in got.items()} == plain_components(fps, 3)
    assert simhash.near_duplicates(docs_of(spark, texts).limit(0)).count() == 0
    same = docs_of(spark, texts).select("doc_id", F.lit(None).cast("long").alias("x")).selectExpr("x AS doc_id", "'t' AS text")
    assert {r["component_id"] for r in simhash.near_duplicates(same).collect()} == {None}


@pytest.mark.parametrize(("block", "crowd"), [(2048, 8), (16, 100), (8, 2)])
def test_crowded_buckets_lose_no_link(spark, block, crowd, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "CROWD", crowd)
    rng = np.random.default_rng(11)
    centres = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    values = {int(c) ^ sum(1 << int(b) for b in rng.choice(64, int(rng.integers(0, 5)), replace=False)) for c in centres for _ in range(60)}
    fps = dict(enumerate(sorted(values)))
    classes = spark.createDataFrame([(k, bytearray(int(v).to_bytes(8, "little"))) for k, v in fps.items()], "node long, fp binary")
    cuts, want = common.Cuts(spark, "t"), plain_components(fps, 3)
    for masks in (simhash.exact_masks(64, 3, 10), simhash.exact_masks(64, 3, 1 << 30)):
        deeper = lambda rows, level, masks=masks: simhash._rekeyed(rows, masks, 3) if level == 1 else None
        found = simhash.links(simhash._keyed(classes, masks), 3, cuts, deeper)
        roots = {r["node"]: r["root"] for r in common.components(found, cuts).collect()}
        assert {k: roots.get(k, k) for k in fps} == want


@pytest.mark.parametrize(("bits", "radius"), [(64, 3), (256, 45), (64, 0)])
def test_bit_sliced_pairs(bits, radius):
    rng = np.random.default_rng(12)
    base = rng.integers(0, 256, (40, bits // 8), dtype=np.uint8)
    rows = np.repeat(base, 8, axis=0)
    flips = np.packbits(rng.random((len(rows), bits)) < radius / bits / 2, axis=1, bitorder="little")
    rows ^= flips
    far = np.bitwise_count(rows[:, None, :] ^ rows[None, :, :]).sum(axis=2)
    want = {(i, j) for i, j in zip(*np.nonzero(far <= radius), strict=True) if i < j}
    i, j = simhash.near_in_group(rows, radius)
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == want
    group = np.repeat(np.arange(64), 5)
    i, j = simhash.near_in_small_groups(rows, group, radius)
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == {(a, b) for a, b in want if group[a] == group[b]}


def test_long_texts_are_read_in_pieces(monkeypatch):
    rng = np.random.default_rng(13)
    text = prose(rng, 900)
    whole = np.concatenate(list(simhash.shingle_hashes(text, 3)))
    monkeypatch.setattr(simhash, "_LONG", 10)
    assert (np.concatenate(list(simhash.shingle_hashes(text, 3))) == whole).all()


@pytest.mark.parametrize("n", [1, 3, 5])
def test_long_texts_of_few_words(n, monkeypatch):
    texts = ["x" * 50, " " * 50, *(" ".join(f"{'y' * 20}{j}" for j in range(k)) for k in range(1, 7))]
    whole = [simhash.fingerprint(t, n) for t in texts]
    monkeypatch.setattr(simhash, "_LONG", 10)
    assert [simhash.fingerprint(t, n) for t in texts] == whole


def jaccard_sets(rng, size, similarity):
    both = round(2 * size * similarity / (1 + similarity))
    drawn = rng.integers(0, 1 << 63, 2 * size - both, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return np.unique(drawn[:size]), np.unique(drawn[size - both :])


@pytest.mark.parametrize("similarity", [0.8, 0.85, 0.95])
@pytest.mark.parametrize("size", [40, 300])
def test_similar_sets_become_candidates(size, similarity):
    """A shared least hash doesn't hang on how many other sets there are, nor does the distance: this recall holds at any count."""
    rng, found = np.random.default_rng(14), 0
    for _ in range(300):
        a, b = jaccard_sets(rng, size, similarity)
        x, y = (np.frombuffer(simhash._majority([s], 4), np.uint8) for s in (a, b))
        shared = (simhash.least_hashes(a, simhash.KEYS) == simhash.least_hashes(b, simhash.KEYS)).any()
        found += bool(shared) and int(np.bitwise_count(x ^ y).sum()) <= 57
    assert found >= 0.97 * 300


def test_least_hashes_agree_as_often_as_sets():
    rng, same = np.random.default_rng(15), []
    for _ in range(200):
        a, b = jaccard_sets(rng, 200, 0.8)
        same.append((simhash.least_hashes(a, 18) == simhash.least_hashes(b, 18)).mean())
    assert np.mean(same) == pytest.approx(0.8, abs=0.02) and not simhash.least_hashes(np.zeros(0, np.uint64), 6).any()


@pytest.mark.parametrize(("block", "crowd", "hashes"), [(2048, 8, 1 << 21), (4, 2, 1 << 21), (8, 1, 500)])
def test_similar_documents_equal_brute_force(spark, odd, block, crowd, hashes, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "CROWD", crowd)
    monkeypatch.setattr(simhash, "GATHER_HASHES", hashes)
    rng, texts = np.random.default_rng(16), [*odd, "", "  ", *odd[:3]]
    shared = prose(rng, 60)
    for k in range(12):
        words = prose(rng, 100).split()
        texts += [" ".join(words), " ".join([*words[: 100 - 4 * k], *prose(rng, 4 * k).split()]), f"{prose(rng, 50)} {shared} {k}"]
    sets = [{tuple((t or "").lower().split()[j : j + 5]) for j in range(max(1, len((t or "").split()) - 4))} if (t or "").split() else set() for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) > 0:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    df = spark.createDataFrame(list(enumerate(texts)), "row long, text string")
    got = {r["row"]: r["component_row"] for r in simhash.similar_documents(df, 5, 4, 57, (4, 5), common.Cuts(spark, "t")).collect()}
    assert got == dict(enumerate(root))


def test_sieve_and_among(spark):
    ids = spark.range(0, 4000, 7).select(F.col("id").alias("k"))
    rows = spark.range(-50, 5000).select(F.col("id").alias("k"), F.lit("t").alias("text"))
    test = common.sieve(ids)
    passed = {r["k"] for r in rows.where(test("k")).collect()}
    inside = set(range(0, 4000, 7))
    assert inside <= passed and len(passed) < 900 and common.sieve(ids, 5) is None
    for bits in (26, 5):
        monkey = common.sieve
        common.sieve = lambda x, bits=bits, f=monkey: f(x, bits)
        try:
            assert {r["k"] for r in common.among(rows, ids, "k").collect()} == inside
            assert {r["k"] for r in common.among(rows, ids, "k", "left_anti").collect()} == set(range(-50, 5000)) - inside
            assert common.among(rows, ids.limit(0), "k").count() == 0 and common.among(rows, ids.limit(0), "k", "left_anti").count() == 5050
        finally:
            common.sieve = monkey


# 10. Pieces.


def test_viterbi_equals_brute_force_and_sentencepiece(odd):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as proto

    vocabulary = pieces.load_pieces()
    auto = pieces.PieceAutomaton(vocabulary)
    model = proto.ModelProto()
    with open(pieces.MODEL, "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1
    score = dict(zip(vocabulary["ids"], vocabulary["scores"], strict=True))
    for i, p in enumerate(model.pieces):
        p.score = score.get(i, p.score)
    peer = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    total = lambda ids: sum(score.get(i, auto.unknown / 3) for i in ids)
    texts = [t for t in odd if t and "▁" not in t] + ["The quick brown fox", "a  b   c", "tab\tand\nline", "naïve café über"]
    for t in texts:
        ids = auto.encode(t).tolist()
        assert auto.decode(ids) == t
        assert len(ids) == len(peer.encode(t)) and total(ids) == pytest.approx(total(peer.encode(t)), rel=1e-5)
    text = {vocabulary["text"][i]: s for i, s in score.items()}
    word = "▁unbelievable"
    best = [0.0] + [-1e9] * len(word)
    for k in range(1, len(word) + 1):
        best[k] = max(best[j] + text.get(word[j:k], -1e9) for j in range(k))
    assert total(auto.viterbi(word)) == pytest.approx(best[-1])


def test_encoding_round_trips(spark, odd):
    df = docs_of(spark, odd, extra=True).withColumn("n_pieces", F.lit("mine"))
    rows = pieces.encode_texts(df)
    got = {r["doc_id"]: r for r in pieces.decode_pieces(rows).collect()}
    assert all(got[k]["decoded"] == (t or "") and got[k]["exact"] and got[k]["n_pieces"] == len(got[k]["piece_ids"]) for k, t in enumerate(odd))
    assert got[0]["n_pieces"] == 0 and pieces.encode_texts(df.limit(0)).count() == 0
