"""Operators 11 to 13 against brute-force versions: nulls, empty and long texts, ties,
repeated rows, empty tables and a caller's columns of clashing names."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import permutations
from zlib import crc32

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from graphloom.llm import audit, fim, packing
from graphloom.llm.tokenfiles import tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, key string, piece int, part string, mask int, u long, length int, ids string, start long, n int"


def made(seed=1, n=150):
    r = random.Random(seed)
    words = ["".join(r.choice("abcDEé#ß漢") for _ in range(r.randint(1, 7))) for _ in range(90)]
    rows = []
    for i in range(n):
        text = "".join(r.choice(words) + r.choice([" ", " ", "\n", "\t ", "  ", " "]) for _ in range(r.choice([1, 5, 40, 60, 200])))
        if r.random() < 0.3:
            text = text.strip()
        if r.random() < 0.1:
            text += r.choice(["<P>", "<S> x", "<M>", "<", "<<P"])
        rows.append((i, text, f"s{r.choice([0, 0, 1])}"))
    rows += [(n, None, None), (n + 1, "", ""), (n + 2, " \t\n ", "s1"), (n + 3, "x y " * 30000, "s0"), (n + 4, "x" * 50000, "s1"), (n + 5, "$ A" * 9, "s0")]
    rows += [(n + 10 + i, "the hot text, of which there are many copies", f"s{i % 2}") for i in range(80)]
    rows += [rows[3], rows[3], (None, rows[4][1], "s0"), (None, rows[4][1], "s0"), (None, None, None)]
    r.shuffle(rows)
    return [(*x, "own", 1, "own", 2, 3, 4, "own", 5, 6) for x in rows]


@pytest.fixture(scope="module")
def rows():
    return made()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# fill-in-middle


def test_boundaries():
    r = random.Random(5)
    for _ in range(300):
        text = "".join(r.choice("ab é漢\n\t  ") for _ in range(r.choice([0, 1, 3, 30, 300])))
        ends, chars = fim.boundaries(text.encode())
        assert chars == len(text)
        assert ends.tolist() == [m.end() for m in TOKEN.finditer(text)]
        width, low, high = fim.elias_fano(ends, chars)
        assert [fim.select(k, width, low, high) for k in range(len(ends) + 1)] == [0, *ends.tolist()]
        assert 8 * (len(low) + len(high)) <= len(ends) * (2 + width) + chars // 2**width % 2 + 2 * len(ends) + 32


def test_boundaries_across_blocks(monkeypatch):
    monkeypatch.setattr(fim, "BLOCK", 5)
    r = random.Random(6)
    for _ in range(300):
        text = "".join(r.choice("ab é漢 ") for _ in range(r.randint(0, 60)))
        assert fim.boundaries(text.encode())[0].tolist() == [m.end() for m in TOKEN.finditer(text)]


def brute_fim(doc_id, text, rate=50):
    text = text or ""
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    w = TOKEN.findall(text)
    a, b = sorted((h[0] % (len(w) + 1), h[1] % (len(w) + 1)))
    p, m, s = "".join(w[:a]), "".join(w[a:b]), "".join(w[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return doc_id, len(w), "plain", None, None, text, text
    if h[3] % 100 < 80:
        return doc_id, len(w), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}", text
    return doc_id, len(w), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}", text


@pytest.mark.parametrize("rate", [50, 100])
def test_infilled(docs, rows, rate):
    found = fim.infilled(docs, rate=rate).withColumn("back", fim.restored(fim.F.col("output"), fim.F.col("form")))
    got = Counter(map(tuple, found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "back").collect()))
    assert got == Counter(brute_fim(x[0], x[1], rate) for x in rows)
    if rate == 100:
        assert {k[2] for k in got} == {"plain", "spm", "psm"}


def test_infilled_tables(spark, docs, rows, empty, tmp_path):
    assert fim.infilled(empty).count() == 0
    docs.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    frame = fim.op11_fill_in_middle(spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(fim.SQL)
    assert [c[0] for c in want.description] == frame.columns
    assert Counter(map(tuple, frame.collect())) == Counter(want.fetchall())


# filter audit


def brute_counts(text):
    w = WORD.findall(text)
    return len(w), len(set(w)), sum("A" <= c <= "Z" for c in text), sum(c in "#$%&*|" for c in text), len(text)


def counted(texts, array=pa.string()):
    c = audit.Scanner()(pa.array(texts, array))
    return list(zip(*(c[k].tolist() for k in ("words", "distinct", "capitals", "signs", "chars"))))


def test_scanner(monkeypatch):
    r = random.Random(7)
    texts = ["".join(r.choice("abA é漢#|\n   ") for _ in range(r.choice([0, 1, 5, 90, 700]))) for _ in range(200)] + ["", "", " ", "ab"]
    want = [brute_counts(t) for t in texts]
    assert counted(texts) == want and counted(texts, pa.large_string()) == want
    assert audit.Scanner()(pa.array(["x", *texts]).slice(1))["words"].tolist() == [x[0] for x in want]
    for block in (1, 7, 64):  # long texts in parts, few texts at once
        monkeypatch.setattr(audit, "BLOCK", block)
        assert counted(texts) == want
    monkeypatch.setattr(audit.RunHashes, "over", lambda self, x: lambda low, high: (high - low).astype(np.uint64) // np.uint64(2))
    assert counted(texts) == want  # clashes of hashes do not count


def brute_audit(rows, labels):
    first = {}
    for i, t, *_ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    known = defaultdict(lambda: [False, False])
    for i, q, x in labels:
        if i is not None:
            known[i][0] |= q == 1
            known[i][1] |= x == 1
    parts = defaultdict(list)
    for i, t, s, *_ in rows:
        t = t or ""
        n, d, c, g, chars = brute_counts(t)
        failed = (n < 50, 100 * d < 65 * n, 100 * c > 5 * chars, g > 0, i is not None and first[t] < i)
        parts[s or ""].append(({f for f, x in zip("ABCDE", failed) if x}, *known[i]))
    out = []
    for part, found in parts.items():
        steps, shapley = [], Counter()
        for order in permutations("ABCDE"):
            left = list(found)
            for k, f in enumerate(order):
                gone = [x for x in left if f in x[0]]
                left = [x for x in left if f not in x[0]]
                fails = sum(f in x[0] for x in found)
                steps.append((part, "".join(order), k + 1, len(left), len(gone), fails - len(gone), sum(x[0] == {f} for x in found), sum(x[1] for x in gone), sum(x[2] for x in gone), f))
                shapley[f] += len(gone)
        out += [(*x[:-1], shapley[x[-1]]) for x in steps]
    return out


def test_audit(spark, docs, rows, empty, tmp_path):
    r = random.Random(8)
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1, 1, None])) for i in range(0, 240, 2)] + [(4, 1, 0), (4, 0, 0), (None, 1, 1), (99999, 1, 1)]
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    frame = audit.audit(docs, known)
    got = sorted(map(tuple, frame.collect()))
    assert got == sorted(brute_audit(rows, labels))
    assert len(got) == 3 * 600
    assert audit.audit(empty, known).count() == 0
    assert audit.audit(docs, known.limit(0)).agg({"good_lost": "sum"}).first()[0] == 0
    docs.select("doc_id", "source", "text").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    con.execute("CREATE TABLE labels (doc_id BIGINT, quality INT, toxic INT)")
    con.executemany("INSERT INTO labels VALUES (?, ?, ?)", labels)
    want = con.execute(audit.SQL)
    assert [c[0] for c in want.description] == frame.columns
    assert got == sorted(want.fetchall())


# packing


def test_best_pattern():
    r = np.random.default_rng(0)
    for _ in range(50):
        size = np.unique(r.integers(1, 9, 4))
        value = r.random(len(size)).round(2)
        best, pattern = packing.best_pattern(value, size, 17)

        def most(k, room):
            return 0 if k == len(size) else max(n * value[k] + most(k + 1, room - n * size[k]) for n in range(room // size[k] + 1))

        assert best == pytest.approx(most(0, 17)) and best == pytest.approx(pattern @ value) and pattern @ size <= 17


def test_patterns():
    r = np.random.default_rng(1)
    for k in range(30):
        size = np.unique(r.integers(1, 65, r.integers(1, 20)))
        demand = r.integers(0, [5, 1000][k % 2], len(size))
        found, counts = packing.patterns(size, demand, 64)
        assert (found.T @ counts == demand).all() and (found @ size <= 64).all() and (counts >= 0).all()
        # the linear program's bound, and a sequence at most for each pattern that was rounded down
        assert counts.sum() >= (size * demand).sum() / 64
    # 20 of 44 and 60 of 10 fit in 20 sequences of 64 (44 + 10 + 10), 20 of 10 are left for 4
    found, counts = packing.patterns(np.array([10, 44]), np.array([60, 20]), 64)
    assert counts.sum() == 24


def tokens_of(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    return [[*e.ids, 2] for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def check_packing(pieces, rows, length):
    """Every id in one piece, sequences gapless and without padding, few documents cut."""
    want = Counter((x[0], tuple(ids)) for x, ids in zip(rows, tokens_of([x[1] for x in rows])))
    sequences = defaultdict(list)
    held = defaultdict(list)
    for p in pieces:
        assert p["length"] == len(p["ids"]) > 0 and p["ids_crc32"] == crc32(np.array(p["ids"], "<u4").tobytes())
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
        held[p["doc_id"], p["doc_tokens"]].append((p["start"], tuple(p["ids"])))
    fills = []
    for s in sequences.values():
        at = 0
        for offset, size in sorted(s):
            assert offset == at
            at += size
        assert at == length or at & (at - 1) == 0
        fills.append(at)
    assert sum(fills) == sum(len(k[1]) * n for k, n in want.items())
    assert sum(f < length for f in fills) <= length.bit_length() and sorted(sequences) == list(range(len(sequences)))
    for (doc, size), found in held.items():
        same = [ids for (d, ids), n in want.items() if d == doc and len(ids) == size for _ in range(n)]
        # each start as often as there are such documents, and the ids that stand there
        assert sum(len(x[1]) for x in found) == size * len(same)
        cover = np.zeros(size, int)
        for start, ids in found:
            assert any(x[start : start + len(ids)] == ids for x in same)
            cover[start : start + len(ids)] += 1
        assert (cover == len(same)).all()


@pytest.mark.parametrize("length", [4096, 64])
def test_packed(docs, rows, length):
    found = packing.packed(docs, length=length).collect()
    check_packing(found, rows, length)


def test_packed_small_tables(spark, empty):
    assert packing.packed(empty).count() == 0
    one = [(7, "a few words in one document", *[None] * 10)]
    check_packing(packing.packed(spark.createDataFrame(one, SCHEMA)).collect(), one, 4096)
    blank = [(None, None, *[None] * 10)] * 5
    check_packing(packing.packed(spark.createDataFrame(blank, SCHEMA)).collect(), blank, 4096)


def test_packing_query(spark):
    """Whole documents where they fit: few of the test table's are cut."""
    sf = "/root/testdata/sf0.001"
    frame = packing.op13_packing(spark, sf)
    assert frame.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    found = frame.toPandas()
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    ids = {d: np.array(x, "<u4") for (d, _), x in zip(docs, tokens_of([t for _, t in docs]))}
    for p in found.itertuples():
        assert p.doc_tokens == len(ids[p.doc_id]) and p.ids_crc32 == crc32(ids[p.doc_id][p.start : p.start + p.length].tobytes())
    assert found["length"].sum() == sum(map(len, ids.values()))
    fills = found.groupby("sequence_id")["length"].sum()
    assert ((fills == 4096) | (fills & (fills - 1) == 0)).all()
    per = found.groupby("doc_id").agg(n=("length", "size"), tokens=("doc_tokens", "first"))
    assert (per[per.tokens <= 4096].n > 1).mean() < 0.2
