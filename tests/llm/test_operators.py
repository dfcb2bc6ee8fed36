import collections
import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from xylem.llm import _graph as G
from xylem.llm import bpe, decontaminate, line_dedup, pii, token_shards, toxicity, warc
from xylem.llm.exact_dedup import exact_dedup
from xylem.llm.license_scan import Matcher, license_scan, order_templates, words_of
from xylem.llm.queries import tokenizer_file
from xylem.llm.simhash_dedup import near_duplicates

ODD = [(1, "a b c d e f", 9), (2, None, 9), (3, "", None), (4, "a b c d e f", 9), (4, "a b c d e f", 9), (None, "x " * 5000, 9), (None, None, 1), (7, "A  b\nc d e\tf", 2)]


@pytest.fixture
def odd(spark):
    """Nulls, empty and long texts, repeated rows and ids, and a column with a clashing name."""
    return spark.createDataFrame(ODD, "doc_id long, text string, _id long")


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, _id long")


def test_exact_dedup(odd, none):
    rows = exact_dedup(odd, digest_all=True).collect()
    assert len(rows) == len(ODD)
    groups = collections.defaultdict(list)
    for i, t, _ in ODD:
        groups[t or ""].append(i)
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): v for t, v in groups.items()}
    for r in rows:
        own = by_sha[r["text_sha256"]]
        assert r["group_size"] == len(own) and r["keep_id"] == max(own, key=lambda x: (x is not None, x or 0))
    assert collections.Counter(r["text_sha256"] for r in rows if r["kept"]) == dict.fromkeys(by_sha, 1)
    assert exact_dedup(none).count() == 0


def test_warc_round_trip(spark, tmp_path):
    big = "é" * 300_000
    rows = [(1, "http://a/ b", big), (2, None, big), (3, "u", "small"), (4, "u", "small"), (5, "u", None), (None, "u", big), (6, "u", big)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    archives = warc.archives_of(warc.write_warc(df, f"file://{tmp_path}/w"))
    chunks = warc.read_warc(spark, archives).collect()
    last = {r["record_id"]: r for r in chunks if r["is_last"]}
    assert all(r["error"] is None for r in chunks) and len(last) == 7
    data = collections.defaultdict(bytes)
    for r in sorted(chunks, key=lambda r: r["chunk_no"]):
        data[r["record_id"]] += bytes(r["data"] or b"")
    assert data["<urn:page:6>"] == big.encode() and max(len(r["data"] or b"") for r in chunks) <= warc.CHUNK_BYTES
    sha = hashlib.sha1(big.encode()).hexdigest()
    for k in (1, 2):
        r = last[f"<urn:page:{k}>"]
        assert (r["record_type"], r["refers_to"], r["running_sha1"], r["running_bytes"]) == ("revisit", "<urn:page:6>", sha, 600_000)
    assert [last[f"<urn:page:{k}>"]["record_type"] for k in (3, 4, 5, 6, "")] == ["response"] * 5
    assert warc.read_warc(spark, []).count() == 0


def test_decontamination_is_the_brute_force(spark, none):
    item = "the quick brown fox jumps over the lazy dog while the old grey cat looks on from the garden wall today"
    rng = np.random.default_rng(5)
    texts = ["", None, item.upper().replace(" ", " -\n")]
    for _ in range(25):
        s = list(item)
        for _ in range(rng.integers(0, 10)):
            s[rng.integers(1, len(s) - 1)] = "x"
        texts.append("before it " + "".join(s) + " and after")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["edits"] for r in decontaminate.contamination(docs, spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string")).collect()}
    k = int(decontaminate.PassageIndex.build([(1, item)]).budget[0])
    norm = lambda t: " ".join(re.findall(r"\w+", (t or "").lower()))
    for i, t in enumerate(texts):
        e = _best(norm(item), norm(t))
        assert got.get(i) == (e if e <= k else None)
    assert decontaminate.contamination(none, docs.withColumnRenamed("doc_id", "item_id")).count() == 0


def _best(p: str, t: str) -> int:
    """Edit distance of p to its best place in t."""
    row = [0] * (len(t) + 1)
    for i, c in enumerate(p, 1):
        new = [i]
        for j, d in enumerate(t, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_line_dedup(spark, odd, none):
    base = "this is the first line of a longer text with enough different words to have a fingerprint of its own"
    docs = [(1, base + "\nunique here"), (2, base.upper() + "!\n\nalso unique"), (3, base.replace("longer", "larger")), (4, "something else entirely stands in here")]
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert [got[k]["n_dropped"] for k in (1, 2, 3, 4)] == [0, 1, 1, 0] and got[2]["clean_text"] == "\nalso unique"
    assert line_dedup.dedup_lines(odd).count() == len(ODD) and line_dedup.dedup_lines(none).count() == 0


def test_line_dedup_of_null_and_repeated_ids(spark):
    line = lambda k: f"line number {k} has words of its own such as {'abcdefghij'[k] * 9} and {'klmnopqrst'[k] * 9}"
    rows = [(None, line(0) + "\n" + line(1)), (None, line(1) + "\n" + line(2)), (3, line(3)), (3, line(3)), (3, line(3)), (4, ""), (4, None), (5, "--\n" + line(0))]
    got = [tuple(r) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sum(r[2] for r in got) == 1 + 2 + 1 and sum(r[1] for r in got) == 8 and len(got) == 8
    assert sorted(r[3] for r in got if r[0] == 3) == ["", "", line(3)] and (5, 1, 1, "--") in got
    assert sorted(line for r in got for line in r[3].split("\n") if "has" in line) == [line(k) for k in range(4)]


def test_lines_hold_what_the_texts_have(spark):
    texts = ["a  B\n--\nc", "", "\n\n", "É_1 日本\r\n x", "z" * 500 + "\n" + "y z " * 400]
    x = line_dedup.Lines(texts)
    want = [(i, k, " ".join(w)) for i, t in enumerate(texts) for k, l in enumerate(t.split("\n")) if (w := re.findall(r"\w+", l.lower()))]
    assert [(int(a), int(b), x.normal(k)) for k, (a, b) in enumerate(zip(x.text, x.number, strict=True))] == want
    assert x.size.tolist() == [len(w[2]) for w in want]
    same = line_dedup.Lines(["A b\nc d", "a   b!\nC-d"])
    assert same.k0[:2].tolist() == same.k0[2:].tolist() and same.k1[:2].tolist() == same.k1[2:].tolist() and len(set(same.k0.tolist())) == 2
    for t in ("--", "a", "٣", "…", "é", "日", "\u0301", "\U0001f600"):
        assert bool(line_dedup.has_word().search(t)) == (len(line_dedup.Lines([t]).text) == 1)


def test_edit_distances_are_the_brute_force():
    from xylem.llm import _edits

    rng = np.random.default_rng(9)
    x, y = [], []
    for _ in range(600):
        a = list("".join(rng.choice(list("abcd é日"), int(rng.integers(0, 200)))))
        b = list(a)
        for _ in range(int(rng.integers(0, 30))):
            i = int(rng.integers(0, len(b) + 1))
            b[i : i + int(rng.integers(0, 2))] = ["z"] * int(rng.integers(0, 2))
        x, y = [*x, "".join(a)], [*y, "".join(b)]
    want = np.array([_plain(a, b) for a, b in zip(x, y, strict=True)])
    assert [_edits.distance(a, b) for a, b in zip(x, y, strict=True)] == want.tolist()
    assert all(_edits.by_words(a, b, 10**9) >= d for a, b, d in zip(x, y, want, strict=True))
    for k in (-1, 0, 1):
        most = np.maximum(want + k, 0)
        assert (_edits.distances_within(x, y, most) == (want <= most)).all()


def test_distances_take_as_long_as_the_edits_allowed():
    """Long strings whose distance is far beyond the limit, or near it: the verdicts are exact, and a small limit spares most of the work."""
    import time

    from xylem.llm import _edits

    rng, n = np.random.default_rng(3), 300
    x = ["".join(rng.choice(list("abcdefgh"), 2500)) for _ in range(n)]
    y = ["z" + a[1:-1] + "z" for a in x]
    for k in range(0, n, 2):  # edits throughout in every other pair; the rest is another text
        b = list(y[k])
        for i in sorted(rng.integers(1, 2400, 40 + k // 8).tolist(), reverse=True):
            b[i : i + int(rng.integers(0, 2))] = ["q"] * int(rng.integers(0, 2))
        y[k] = "".join(b)
    y = [b if k % 2 == 0 else "".join(rng.permutation(list(b))) for k, b in enumerate(y)]
    want = np.array([_edits.distance(a, b) for a, b in zip(x, y, strict=True)])
    assert want[0] == _plain(x[0], y[0]) and want[1] == _plain(x[1], y[1])
    for k in (-1, 0, 60):
        assert (_edits.distances_within(x, y, want + k) == (want <= want + k)).all()
    took = []
    for most in (100, 1900):
        began = time.process_time()
        assert (_edits.distances_within(x, y, np.full(n, most)) == (want <= most)).all()
        took.append(time.process_time() - began)
    assert took[0] < took[1] / 2


def test_simhashes_are_counted_bit_by_bit():
    from xylem.llm._words import simhashes

    rng = np.random.default_rng(8)
    for weighted, sizes in ((True, [1, 0, 17, 18, 4369, 4370, 9000, 0]), (False, [0, 255, 256, 65535, 65536, 3])):
        first = np.concatenate([[0], np.cumsum(sizes)])
        h = rng.integers(0, 1 << 63, first[-1], dtype=np.uint64) * np.uint64(2) | np.uint64(rng.integers(0, 1 << 40))
        weight = rng.integers(1, 16, len(h)) if weighted else np.ones(len(h), np.int64)
        got = simhashes(h, first, 1, weight if weighted else None)[:, 0]
        for k, (a, z) in enumerate(zip(first[:-1], first[1:], strict=True)):
            w = weight[a:z]
            assert int(got[k]) == sum(1 << b for b in range(64) if 2 * int(w[(h[a:z] >> np.uint64(b)) & np.uint64(1) == 1].sum()) > int(w.sum()))


def test_line_texts_are_those_of_their_places(spark):
    """Of a line that many texts hold, the first occurrence alone is read again; other separators than line feeds end no line."""
    line = lambda k: f"Line {k}\r of \u2028 its\x0b own\x85 words"
    rows = [(k, "\n".join(["", line(k), "the same line", line(k + 100), "--", ""])) for k in range(30)] + [(None, None), (99, "")]
    docs = line_dedup.keyed(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    nodes = line_dedup.line_nodes(docs)
    got = {r["node"]: r["line_text"] for r in line_dedup._line_texts(docs, nodes).collect()}
    want = {r["node"]: r["_at"] for r in nodes.collect()}
    texts = dict(rows)
    assert len(got) == 61 and got == {n: " ".join(re.findall(r"\w+", texts[at["_id"]].split("\n")[at["line"]].lower())) for n, at in want.items()}


def _plain(a, b):
    row = np.arange(len(b) + 1)
    codes = np.array([ord(c) for c in b], dtype=np.int64)
    for i, c in enumerate(a, 1):
        new = np.minimum(row[1:] + 1, row[:-1] + (codes != ord(c)))
        new = np.concatenate([[i], new])
        row = np.minimum.accumulate(new - np.arange(len(new))) + np.arange(len(new))
    return int(row[-1])


def test_line_recall_is_measured_against_brute_force(spark):
    """Lines of sf0.001 with some words replaced: of all that brute force finds similar, by length, how many share a class."""
    from xylem.llm.queries import table

    rng = np.random.default_rng(4)
    lines = sorted({l for r in table(spark, "/root/testdata/sf0.001", "documents").collect() for l in (r["text"] or "").split("\n") if 8 <= len(re.findall(r"\w+", l)) <= 120})
    rows = []
    for k, l in enumerate(lines):
        words = re.findall(r"\w+", l.lower())
        for i in rng.choice(len(words), max(1, len(words) // 25), replace=False):
            words[i] = "q" * len(words[i])
        rows += [(2 * k, l), (2 * k + 1, " ".join(words))]
    df = line_dedup.line_nodes(line_dedup.keyed(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text"))
    nodes = {r["_at"]["_id"]: r["node"] for r in df.collect()}
    pairs = {(r["a"], r["b"]) for r in line_dedup.near_lines(df).collect()}
    own = [tuple(sorted((nodes[2 * k], nodes[2 * k + 1]))) for k in range(len(lines)) if 2 * k in nodes and 2 * k + 1 in nodes]
    assert len(own) > 500 and sum(p in pairs for p in own) >= 0.95 * len(own)


def test_pii(spark, odd, none):
    text = 'a.b@c.example.org 10.0.0.1 300.1.1.1 4111 1111 1111 1111 +49 (030) 123-4567 token = "9f86d081884c7d659a2feaa0c55ad015"'
    r = pii.find_pii(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [r["n_email"], r["n_ip"], r["n_phone"]] == [1, 1, 1]
    kinds = [s.split(":") for s in r["spans"].split(",")]
    assert [text[int(s) : int(e)] for k, s, e in kinds if k == "secret"] == ["9f86d081884c7d659a2feaa0c55ad015"]
    base = ",".join(":".join(s) for s in kinds if s[0] in pii.KINDS[:4])
    assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
    assert pii.find_pii(odd).count() == len(ODD) and pii.find_pii(none).count() == 0


def test_viterbi_is_the_brute_force():
    import itertools

    rng = np.random.default_rng(0)
    score, pair, first = rng.normal(size=(5, 1, 4)), rng.normal(size=(4, 4)), rng.normal(size=4)
    best = max(itertools.product(range(4), repeat=5), key=lambda y: first[y[0]] + sum(score[i, 0, y[i]] for i in range(5)) + sum(pair[y[i - 1], y[i]] for i in range(1, 5)))
    assert tuple(pii.viterbi(score, np.array([5]), pair, first)[:, 0]) == best


def test_near_duplicates(spark, odd, none):
    rng = np.random.default_rng(1)
    words = [f"w{k}" for k in rng.integers(0, 5000, 400)]
    docs = [(i, " ".join(f"w{k}" for k in rng.integers(0, 5000, 400))) for i in range(60)]
    for i in range(60, 80):
        own = list(words)
        own[int(rng.integers(0, 400))] = "changed"
        docs.append((i, " ".join(own)))
    rows = near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r["class_id"] for r in rows if r["doc_id"] >= 60} == {79} and sum(r["kept"] for r in rows) == 61
    odd_rows = near_duplicates(odd).collect()
    assert len(odd_rows) == len(ODD) and {r["class_id"] for r in odd_rows if r["doc_id"] in (1, 4, 7)} == {7} and near_duplicates(none).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(6)] + [(20, 21), (21, 22), (30, 30)]
    for local in (100, 3):
        comp = {r["node"]: r["comp"] for r in G.components(spark.createDataFrame(edges, "a long, b long"), local).collect()}
        assert len({comp[k] for k in range(7)}) == 1 and len({comp[k] for k in (20, 21, 22)}) == 1 and comp[0] != comp[20] and set(comp) == {*range(7), 20, 21, 22}


def one_bucket():
    """Rows whose lowest bits of f1 agree are in one bucket."""

    class Lowest(G.Buckets):
        masks = np.array([[0, 7]], np.uint64)

        def of(self, prints):
            return prints[:, 1:2] & np.uint64(7)

        def key(self, bucket):
            return np.zeros(len(bucket), np.int64)

    return Lowest()


def _near_rows(n, labels, seed=4):
    """Nodes of ``labels`` buckets, whose near pairs stand far apart, and all pairs of a bucket that are near."""
    rng = np.random.default_rng(seed)
    base = rng.integers(-(2**63), 2**63 - 1, n // 2)
    prints = np.concatenate([base, base ^ 5])
    rows = [(k, int(rng.integers(8, 12)), int(prints[k]), (k % (n // 2)) % labels) for k in range(n)]
    u = prints.view(np.uint64)
    near = lambda i, j: min(rows[i][1], rows[j][1]) >= 0.8 * max(rows[i][1], rows[j][1])
    want = {(i, j) for i in range(n) for j in range(i + 1, n) if rows[i][3] == rows[j][3] and near(i, j) and bin(int(u[i] ^ u[j])).count("1") <= 8}
    return rows, want


@pytest.mark.parametrize("labels", [1, 5])
def test_groups_are_compared_wholly_whatever_the_tasks(spark, labels):
    rows, want = _near_rows(1200, labels)
    df = spark.createDataFrame(rows, "node long, size int, f0 long, f1 long")
    assert len(want) >= 300
    for kw in ({}, {"split": 100}, {"split": 700}, {"task_rows": 50}):
        got = G.near_pairs(df, one_bucket(), most=8, ratio=0.8, **kw).collect()
        assert {(r["a"], r["b"]) for r in got} == want and len(got) == len(want)


def _prints(df):
    return np.array([(r["f0"], r["f1"]) for r in df.collect()], np.int64).view(np.uint64).reshape(-1, 2)


def test_pigeonhole_blocks_lose_no_pair(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, (500, 2), dtype=np.uint64)
    other = base.copy()
    for row in other:
        for bit in rng.choice(128, 11, replace=False):
            row[bit // 64] ^= np.uint64(1 << int(bit % 64))
    for together in (1, 2):
        blocks = line_dedup.Blocks(together=together)
        assert (blocks.of(base) == blocks.of(other)).any(axis=1).all()
    blocks = line_dedup.Blocks()
    same = blocks.of(base) == blocks.of(other)
    for i in range(500):  # within a key's group, the finer keys lose none either
        k = int(np.flatnonzero(same[i])[0])
        bucket = int(blocks.of(base[i : i + 1])[0, k])
        assert (blocks.parts(base[i : i + 1], bucket) == blocks.parts(other[i : i + 1], bucket)).any()
    rows = [(k, 10, *map(int, p.view(np.int64))) for k, p in enumerate(np.concatenate([base, other]))]
    df = spark.createDataFrame(rows, "node long, size int, f0 long, f1 long")
    for kw in ({}, {"fine": 3}, {"split": 200}):
        got = {(r["a"], r["b"]) for r in G.near_pairs(df, blocks, most=11, ratio=0.8, **kw).collect()}
        assert got >= {(k, k + 500) for k in range(500)}


def test_near_within_takes_few_steps(monkeypatch):
    """The pairs are brute force's, and small groups are compared many at a time."""
    rng = np.random.default_rng(8)
    group, size = rng.integers(0, 40, 20_000).astype(np.uint64), rng.integers(1, 1000, 20_000).astype(np.int32)
    prints = rng.integers(0, 1 << 63, (5_000, 2), dtype=np.uint64)[rng.integers(0, 5_000, 20_000)] ^ (np.uint64(1) << rng.integers(0, 60, (20_000, 2)).astype(np.uint64))
    steps, count = [], np.bitwise_count
    monkeypatch.setattr(np, "bitwise_count", lambda *a, **kw: (steps.append(1), count(*a, **kw))[1])
    i, j, d = G.near_within(group, size, prints, 5, 0.8)
    assert len(steps) < 400  # two for each 64 rows before: over 600
    want = set()
    for k in range(40):
        own = np.flatnonzero(group == k)
        far = sum(count(prints[own, w][:, None] ^ prints[own, w][None, :]) for w in range(2))
        a, b = np.nonzero((far <= 5) & (np.minimum.outer(size[own], size[own]) >= 0.8 * np.maximum.outer(size[own], size[own]) - 1e-9))
        want |= {(int(own[x]), int(own[y]), int(far[x, y])) for x, y in zip(a, b, strict=True) if x < y}
    assert {(min(a, b), max(a, b), c) for a, b, c in zip(i.tolist(), j.tolist(), d.tolist(), strict=True)} == want and len(i) == len(want) > 100


def test_near_lines_do_not_depend_on_size(spark, monkeypatch):
    """Pairs of 12 to 28 bits that share a single block are found in large groups and among many lines, too."""
    rng = np.random.default_rng(6)
    blocks, two = line_dedup.Blocks(), line_dedup.Blocks(together=2)
    base, other = [], []
    while len(base) < 60:  # no two blocks and no finer key are the same
        x = rng.integers(0, 1 << 63, (1, 2), dtype=np.uint64)
        y = x.copy()
        for bit in rng.choice(np.setdiff1d(np.arange(128), blocks.places[len(base) % 12]), 26, replace=False):
            y[0, bit // 64] ^= np.uint64(1 << int(bit % 64))
        bucket = int(blocks.of(x)[0, len(base) % 12])
        if not (two.of(x) == two.of(y)).any() and not (blocks.parts(x, bucket) == blocks.parts(y, bucket)).any():
            base.append(x[0]), other.append(y[0])
    rows = [(k, 10, *map(int, p.view(np.int64))) for k, p in enumerate(base + other)]
    df = spark.createDataFrame(rows, "node long, size int, f0 long, f1 long")
    monkeypatch.setattr(line_dedup, "ONE_BLOCK", 1, raising=False)
    want = {(k, k + 60) for k in range(60)}
    found = line_dedup.near_lines(df).collect()
    assert {(r["a"], r["b"]) for r in found} >= want and len({(r["a"], r["b"]) for r in found}) == len(found)
    for kw in ({"fine": 1}, {"split": 20}, {"fine": 1, "split": 20}):
        got = G.near_pairs(df, blocks, most=line_dedup.MAX_BITS, ratio=0.8, **kw).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, found))


def test_forest_prefixes_follow_density():
    from xylem.llm.simhash_dedup import Forest, agreement

    rng = np.random.default_rng(2)
    one = rng.integers(0, 1 << 63, 2, dtype=np.uint64)
    dense = np.repeat(one[None], 3000, axis=0) ^ (np.uint64(1) << rng.integers(0, 64, (3000, 2)).astype(np.uint64))
    sparse = rng.integers(0, 1 << 63, (60, 2), dtype=np.uint64)
    prints = np.concatenate([dense, sparse])
    forest = Forest(12, 9, leaf=16)
    bucket = forest.of(prints)[:, 0]
    order = np.argsort(bucket, kind="stable")
    group = np.empty(len(prints), np.uint64)
    group[order] = forest.groups(bucket[order], prints[order], True)
    depth = forest.above + (group & np.uint64(15)).astype(int)
    assert depth[:3000].max() == 9 and (depth <= 9).all() and depth[3000:].min() < 9
    for g in np.unique(group[depth < 9]):  # a shorter prefix is that of a leaf; all that share it are in it
        assert (group == g).sum() <= 16
    x = prints[:, None] ^ prints[None, :]
    assert ((x & forest.masks[0]).any(axis=2) | (group[:, None] == group[None, :])).all()  # rows that agree in the longest prefix share a group
    assert 1 - (1 - agreement(0.8) ** 9) ** 14 >= 0.95


def test_bpe_is_the_library(odd, none):
    from tokenizers import Tokenizer

    path = tokenizer_file("byte_bpe_50k.json")
    own, library = bpe.Bpe(path), Tokenizer.from_file(path)
    texts = ["", " ", "aaaaaaa", "Hello<|endoftext|> world\n\n  it's 12'34", "日本語 é \x1c\x85 ٣", "՘a\U00010940 b", "x" * 3000, "ab" * 2000 + " ", "🤷🏽‍♀️"]
    for t, (ids, decimal) in zip(texts, own.encode(texts), strict=True):
        want = library.encode(t, add_special_tokens=False).ids
        assert ids.tolist() == want and decimal == ",".join(map(str, want)) and own.decode(ids) == t
    got = bpe.token_digests(odd, path).collect()
    assert sorted((r["doc_id"] or 0, r["decoded_sha256"]) for r in got) == sorted((i or 0, hashlib.sha256((t or "").encode()).hexdigest()) for i, t, _ in ODD)
    ids = bpe.encode_documents(odd, path)
    assert sorted(r["text"] for r in bpe.decode_documents(ids, path).collect()) == sorted(t or "" for _, t, _ in ODD) and bpe.encode_documents(none, path).count() == 0


def test_license_join_is_the_brute_force(spark, odd, none):
    from xylem.llm.license_scan import CONTAINMENT, TEMPLATES

    templates = order_templates(TEMPLATES, {b"license": 9, b"the": 99})
    m, rng = Matcher(templates), np.random.default_rng(2)
    vocabulary = sorted({w for t in templates for w in t.tokens})
    for t in templates * 20:
        block = {w for w in t.tokens if rng.random() < 0.85} | set(rng.choice(vocabulary, 5).tolist())
        want = {(k, len(block.intersection(x.tokens))) for k, x in enumerate(templates) if len(block.intersection(x.tokens)) >= CONTAINMENT * len(x.tokens) - 1e-9}
        assert set(m.match(block)) == want
    text = "ALL rights  RESERVED all rights reserved\nReleased under the MIT License."
    r = license_scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"], r["score"]) == (len(words_of(text)), 2, 0, 3, "reserved", "mit,reserved", 1.0)
    assert license_scan(odd).count() == len(ODD) and license_scan(none).count() == 0


def test_license_notices_may_be_wrapped(spark):
    import textwrap

    from xylem.llm.license_scan import TEMPLATES

    rows = [(k, "int main;\n\n" + textwrap.fill(t, width, initial_indent=" * ", subsequent_indent=" * ") + "\nint x;") for k, (_, t) in enumerate(TEMPLATES) for width in (40, 75)]
    for r in license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert TEMPLATES[r["doc_id"]][0] in r["labels"].split(",") and any(b["label"] == TEMPLATES[r["doc_id"]][0] and b["score"] == 1 and b["line"] == 2 for b in r["blocks"])
    apart = "\n".join(w + " filler" * 3 for w in TEMPLATES[1][1].split())  # all its words, but far apart
    r = license_scan(spark.createDataFrame([(1, apart), (2, "Released under\nthe MIT License.\n\nReleased under the\nMIT License.")], "doc_id long, text string")).orderBy("doc_id").collect()
    assert r[0]["blocks"] == [] and [(b["line"], b["score"]) for b in r[1]["blocks"]] == [(0, 1.0), (3, 1.0)]


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000, 4097])
def test_feistel_is_a_permutation(n):
    f = token_shards.Feistel(n)
    slots = f.slots(np.arange(n))
    assert sorted(slots.tolist()) == list(range(n)) and (f.indexes(slots) == np.arange(n)).all()


def _documents_of(folder):
    """The ids of each piece's document, put together by offset."""
    got, slots = collections.defaultdict(dict), []
    for slot, pieces, ids in token_shards.read_sequences(folder, 0, 10**6):
        slots.append(slot)
        for k, p in enumerate(pieces):
            end = int(pieces[k + 1]["start"]) if k + 1 < len(pieces) else len(ids)
            got[None if p["null"] else int(p["doc"])].setdefault(int(p["offset"]), []).append(ids[int(p["start"]) : end].tolist())
    return got, slots


def test_shards(spark, tmp_path):
    import public_tokenizers as P

    ranks = P.path("byte_bpe_50k.tiktoken")
    docs = spark.createDataFrame([(k, f"text number {k} " * (k * 40)) for k in range(40)] + [(40, None), (-1, "minus one"), (None, "no id")], "doc_id long, text string").repartition(3)
    rows = token_shards.token_rows(docs, ranks)
    where = f"file://{tmp_path}/s"
    m = token_shards.write_shards(rows, where, sequence=256, shard_slots=16)
    want = {r["_id"]: np.frombuffer(r["tokens"], "<u4").tolist() for r in rows.collect() if r["n_tokens"]}
    got, slots = _documents_of(where)
    assert {d: [x for k in sorted(s) for x in s[k][0]] for d, s in got.items()} == want and slots == list(range(len(slots)))
    assert len(slots) <= sum(map(len, want.values())) // 256 + 3  # only a task's last sequence is padded
    assert [s[0] for s in token_shards.read_sequences(where, 20, 5)] == list(range(20, 25))
    back = token_shards.read_shards(spark, m, shard_slots=16).collect()
    digest = lambda x: hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()
    assert {r["slot"] for r in back} == set(slots) and all(r["shard"] == r["slot"] // 16 for r in back)
    assert collections.Counter((r["doc_id"], r["token_offset"], r["ids_sha256"]) for r in back) == collections.Counter((d, o, digest(x)) for d, s in got.items() for o, xs in s.items() for x in xs)
    again = token_shards.materialise(docs, ranks).filter("n_tokens > 0").collect()
    total = collections.Counter()
    for r in again:
        total[r["doc_id"]] += r["n_tokens"]
    assert total == {d: len(x) for d, x in want.items()}


def test_shards_of_odd_tables(spark, tmp_path, odd, none):
    import public_tokenizers as P

    ranks = P.path("byte_bpe_50k.tiktoken")
    assert token_shards.materialise(none, ranks, folder=f"file://{tmp_path}/none").count() == 0 and list(token_shards.read_sequences(f"file://{tmp_path}/none", 0, 9)) == []
    rows = token_shards.materialise(odd, ranks).collect()
    have = collections.Counter({i: 0 for i in ()})
    for i, t, _ in ODD:
        have[i] += len(token_shards._encoder(ranks).encode_ordinary(t or ""))
    got = collections.Counter()
    for r in rows:
        got[r["doc_id"]] += r["n_tokens"]
    assert got == +have
    big = spark.createDataFrame([(1, np.array([70_000, 5], "<u4").tobytes()), (2, None)], "_id long, tokens binary")
    token_shards.write_shards(big, f"file://{tmp_path}/big", sequence=4, vocabulary=100_000)
    assert [x.tolist() for _, _, x in token_shards.read_sequences(f"file://{tmp_path}/big", 0, 9)] == [[70_000, 5]]
    with pytest.raises(Exception, match="beyond the vocabulary"):
        token_shards.write_shards(big, f"file://{tmp_path}/narrow")
    with pytest.raises(TypeError):
        token_shards.materialise(spark.createDataFrame([("a", "b")], "doc_id string, text string"), ranks)


def test_toxicity(spark, odd, none):
    rng = np.random.default_rng(3)
    word = lambda: f"w{rng.integers(0, 300)}"
    rows = [(i, " ".join([word() for _ in range(60)] + (["idiot", "trash"] if i % 5 == 0 else []))) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(300)], "doc_id long, toxic int")
    model = toxicity.train_toxicity(docs, labels)
    held_out = toxicity.score_toxicity(docs, model).filter("doc_id >= 300")
    assert held_out.filter((F.col("doc_id") % 5 == 0) != F.col("is_toxic")).count() <= 6  # accuracy of 0.98 on rows it hasn't seen
    assert toxicity.score_toxicity(odd, model).count() == len(ODD) and toxicity.score_toxicity(none, model).count() == 0
    assert toxicity.score_toxicity(docs, toxicity.train_toxicity(docs, labels.limit(0))).filter("is_toxic").count() == 0


def test_pipeline_like_brute_force(spark, tmp_path):
    import corpus_pipeline
    from xylem.llm.queries import table

    sf = "/root/testdata/sf0.001"
    norm = lambda t: re.findall(r"\w+", t.lower())
    after = {}
    docs = table(spark, sf, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        after[name] = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    every = {r["doc_id"]: r["text"] or "" for r in table(spark, sf, "documents").collect()}
    assert len(after["toxicity"]) > 0.7 * len(every) and all(every[i] == t for i, t in after["toxicity"].items())
    groups = collections.defaultdict(list)
    for i, t in after["toxicity"].items():
        groups[t].append(i)
    assert set(after["exact dedup"]) == {max(g) for g in groups.values()}
    texts = after["exact dedup"]
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := norm(t)) else {t} for i, t in texts.items()}
    up = {i: i for i in texts}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                x, y = root(i), root(j)
                up[min(x, y)] = max(x, y)
    assert set(after["near duplicates"]) == {i for i in texts if root(i) == i} and len(after["near duplicates"]) < len(texts)
    passages = [" ".join(norm(r["text"])) for r in table(spark, sf, "benchmark").collect()]
    held = {i for i, t in after["near duplicates"].items() if any(p in " ".join(norm(t)) for p in passages)}
    gone = set(after["near duplicates"]) - set(after["decontamination"])
    assert held and held <= gone and len(gone) <= 2 * len(held)
    got = {r["doc_id"]: r["decoded_sha256"] for r in corpus_pipeline.run(spark, sf).collect()}
    assert got == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in after["decontamination"].items()}


def test_pipeline_decides_by_row(spark, tmp_path):
    import corpus_pipeline

    rng = np.random.default_rng(6)
    text = lambda: [f"w{k}" for k in rng.integers(0, 5000, 300)]
    a, b, c, d = text(), text(), text(), text()
    near = lambda w: " ".join([*w[:150], "changed", *w[151:]])
    rows = [(5, " ".join(a)), (5, near(a)), (None, " ".join(b)), (None, near(b)), (7, " ".join(c)), (7, " ".join(d)), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = collections.Counter((r["doc_id"], (r["text"] or "")[:20]) for r in corpus_pipeline.near(spark, docs, "").collect())
    assert got == {(5, rows[0][1][:20]): 1, (None, rows[2][1][:20]): 1, (7, rows[4][1][:20]): 1, (7, rows[5][1][:20]): 1, (None, ""): 1}
    spark.createDataFrame([(1, " ".join(b[20:60])), (2, " ".join(c[20:60]))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = corpus_pipeline.decontaminate(spark, docs, str(tmp_path)).collect()
    assert collections.Counter((r["doc_id"], r["text"]) for r in left) == collections.Counter([rows[0], rows[1], rows[5], rows[6]])
