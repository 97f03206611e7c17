"""Vector codes, importance resampling and byte-level BPE against brute force, a library and SQL."""

import hashlib
import math
import random
import zlib
from collections import Counter

import duckdb
import pytest

from duoscope.llm import byte_bpe, queries, resampling, vectorcodes

SF = "/root/testdata/sf0.001"


def plain_lloyd(rows, parts, entries, rounds, scale):
    """rows: (id, vector) in order of id, all valid. Whole numbers of any size."""
    q = [[math.floor(x * scale) for x in v] for _, v in rows]
    w = len(q[0]) // parts
    books = [[row[p * w : (p + 1) * w] for row in q[:entries]] for p in range(parts)]

    def assign():
        out = []
        for row in q:
            line = []
            for p in range(parts):
                x = row[p * w : (p + 1) * w]
                line.append(min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(books[p])))
            out.append(line)
        return out

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                own = [q[i][p * w : (p + 1) * w] for i in range(len(q)) if found[i][p][1] == e]
                if own:
                    books[p][e] = [sum(col) // len(own) for col in zip(*own)]
    found = assign()
    text = ",".join(str(x) for b in books for c in b for x in c)
    return [("".join(f"{e:02x}" for _, e in line), sum(d for d, _ in line)) for line in found], hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("size", [1.0, 1e9])
def test_vector_codes_equal_brute_force(spark, size):
    rnd = random.Random(3)
    rows = [(i, [rnd.choice([-1, 1]) * rnd.random() * size for _ in range(6)]) for i in range(60)] + [(60 + i, [0.25 * size] * 6) for i in range(30)]
    bad = [(100, None), (101, []), (102, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (103, [float("nan")] * 6), (104, [float("inf")] * 6), (105, [1.0] * 4), (106, [1.0] * 5)]
    df = spark.createDataFrame([(i, v, i % 3 or None, "x") for i, v in rows + bad], "vec_id long, embedding array<double>, label int, row_ string").repartition(5)
    got = vectorcodes.digest(vectorcodes.compress(df, parts=2, entries=5, rounds=4, scale=4096)).collect()
    want, sha = plain_lloyd(rows, 2, 5, 4, 4096)
    assert {r["codebooks_sha256"] for r in got} == {sha}
    long = (1 << 63) - 1
    assert {r["vec_id"]: (r["code"], r["error"]) for r in got} == {i: (c, min(e, long)) for (i, _), (c, e) in zip(rows, want)}
    sums = Counter()
    for (i, _), (_, e) in zip(rows, want):
        sums[i % 3] += min(e, long)
    assert all(r["label_error"] == min(sums[r["vec_id"] % 3], long) for r in got)


def test_vector_codes_of_few_repeated_and_no_rows(spark):
    kind = "vec_id long, embedding array<float>, label string"
    assert vectorcodes.digest(vectorcodes.compress(spark.createDataFrame([], kind))).count() == 0
    assert vectorcodes.digest(vectorcodes.compress(spark.createDataFrame([(1, None, "a")], kind))).count() == 0
    rows = [(1, [0.5] * 8, "a"), (1, [0.5] * 8, "a"), (None, [0.0] * 8, None)]
    got = vectorcodes.digest(vectorcodes.compress(spark.createDataFrame(rows, kind))).collect()
    assert sorted((r["vec_id"] or 0, r["code"], r["error"]) for r in got) == [(0, "02" * 8, 0), (1, "00" * 8, 0), (1, "00" * 8, 0)]


def test_vector_codes_leave_no_tables(spark):
    vectorcodes.digest(vectorcodes.compress(spark.createDataFrame([(i, [float(i)] * 8, i) for i in range(40)], "vec_id long, embedding array<double>, label int"))).count()
    assert [t.name for t in spark.catalog.listTables() if t.name.startswith("codes_")] == []


def test_rounds_join_without_a_shuffle(spark):
    df = spark.range(100).selectExpr("id as row_", "cast(cast(id as string) as binary) as codes")
    tables = [vectorcodes.bucketed(df.repartition(4, "row_"), 4) for _ in range(2)]
    plan = tables[0].frame.join(tables[1].frame.hint("merge"), "row_")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    for t in tables:
        t.drop()


def plain_resampling(docs, target, n, buckets, percent, least, seed="2024"):
    def features(text):
        words, word = [], ""
        for c in (text or "") + " ":
            if "A" <= c <= "Z":
                c = chr(ord(c) + 32)
            if "0" <= c <= "9" or "a" <= c <= "z" or ord(c) > 127:
                word += c
            elif word:
                words.append(word)
                word = ""
        return len(words), [" ".join(words[i : i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)]

    crc = lambda f: zlib.crc32(f.encode()) % buckets
    own = [(i, *features(t)) for i, t in docs]
    s, t = Counter(crc(f) for _, _, fs in own for f in fs), Counter(crc(f) for x in target for f in features(x)[1])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    out = []
    for i, words, fs in own:
        weight = sum(gain(crc(f)) for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, words, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    may = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2], r[3]))
    for k, r in enumerate(may[: percent * len(may) // 100]):
        r[5] = k + 1
    return out


@pytest.mark.parametrize("n", [1, 2, 3])
def test_resampling_equals_brute_force(spark, monkeypatch, n):
    monkeypatch.setattr(resampling, "PIECE", 50)
    rnd = random.Random(n)
    word = lambda: rnd.choice(["Aa", "b1", "ÉTÉ", "x_y", "z", "中文", "q" * 70])
    docs = [(i, rnd.choice([" ", "\n", ", "]).join(word() for _ in range(rnd.randint(0, 60)))) for i in range(150)] + [(7, "same id"), (None, "b1 " * 30), (200, None), (201, ""), (202, "?!"), (203, "b1 z " * 400)]
    docs += [(300 + i, "z b1 " * 20) for i in range(30)] + [(300, "z b1 " * 20)]
    target = ["b1 z b1", None, "中文 Aa"]
    df = spark.createDataFrame([(i, t, "c") for i, t in docs], "doc_id long, text string, rank string").repartition(4)
    got = resampling.resample(df, spark.createDataFrame([(str(i), t) for i, t in enumerate(target)], "item_id string, text string"), ngrams=n, buckets=97, percent=30, least_words=10)
    key = lambda r: repr(r)
    assert sorted((list(r) for r in got.collect()), key=key) == sorted(plain_resampling(docs, target, n, 97, 30, 10), key=key)


def test_a_row_of_the_matrix_is_one_document(spark):
    """A reader decodes thousands of rows at once: no row may grow with the number of documents."""
    docs = spark.createDataFrame([(i, "a b c d " * 5) for i in range(500)], "doc_id long, text string").coalesce(1)
    rows = resampling.count_matrix(docs, "doc_id", "text", 1, 97).select("columns").collect()
    assert len(rows) == 500 and max(len(r["columns"]) for r in rows) <= 4


def test_resampling_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id string, text string")
    assert resampling.resample(none, items).count() == 0
    got = resampling.resample(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), items, least_words=1, percent=100).collect()
    assert [(r["doc_id"], r["n_features"], r["rank"]) for r in got] == [(1, 2, 1)]


@pytest.fixture(scope="module")
def library():
    import base64

    import public_tokenizers
    import tiktoken

    with open(byte_bpe.ranks_path(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def hostile(n, seed=5):
    rnd = random.Random(seed)
    signs = "''' \n\t    abstdmrvel'LLRE0123٣²!?.,é中😀́\x1c\x85 ᲊ"
    return ["".join(rnd.choice(signs) for _ in range(rnd.randint(0, 40))) for _ in range(n)] + ["", "'", "'ll", "'lx", "it's 'tis''s", "  x", "x  ", " \n y", "<|endoftext|>", "a" * 3000, " " * 500 + "b", "é" * 900]


def test_byte_bpe_equals_the_library(library):
    own, texts = byte_bpe.vocabulary(byte_bpe.ranks_path()), hostile(5000)
    got = own.encode_many([*texts, None])
    assert [x.tolist() for x in got] == [library.encode_ordinary(t) for t in texts] + [[]]
    assert all(own.decode(x.tolist()) == t.encode() for x, t in zip(got, texts))


def test_byte_bpe_windows_change_nothing(library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "WINDOW", 32)
    monkeypatch.setattr(byte_bpe, "CACHE_ENTRIES", 50)
    own = byte_bpe.vocabulary(byte_bpe.ranks_path())
    texts = ["".join(hostile(40, k)) for k in range(20)]
    assert [own.encode_one(t).tolist() for t in texts] == [library.encode_ordinary(t) for t in texts]


def test_transitions_compose(library):
    number, at_done, table = byte_bpe.monoid()
    rnd = random.Random(1)
    kinds = [rnd.randrange(16) for _ in range(5000)]
    state, want = byte_bpe.DONE, []
    for k in kinds:
        state = byte_bpe.step(byte_bpe.DONE if k > 7 else state, k % 8)[0]
        want.append(state)
    assert at_done[byte_bpe.prefixes(number[kinds], table)].tolist() == want


def test_byte_bpe_tables_and_parts_of_texts(spark, library):
    texts = [*hostile(60), "word " * 3000]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, None, "x"), (3, "twice", "x")], "doc_id long, text string, ids string")
    found = byte_bpe.encode(df)
    got = {r["doc_id"]: r for r in found.filter("doc_id <> 3").collect()}
    for i, t in enumerate(texts):
        if i != 3:
            assert got[i]["ids"] == library.encode_ordinary(t) and (got[i]["ends"][-1:] or [0])[-1] == len(t.encode())
    for first, last in ((0, None), (2, 9), (5, 6), (3, 3), (10**6, None)):
        part = {r["doc_id"]: bytes(r["data"]) for r in byte_bpe.decode(found, first=first, last=last).filter("doc_id <> 3").collect()}
        assert all(part[i] == texts[i].encode()[first:last] for i in got if i is not None)
    digest = byte_bpe.round_trip(df).filter("doc_id is null").first()
    assert (digest["n_tokens"], digest["ids_sha256"]) == (0, hashlib.sha256(b"").hexdigest())
    assert byte_bpe.round_trip(df.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["op11_vector_codes", "op12_resampling"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "embeddings"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    found = con.sql(queries.ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(found.columns)
    at = [found.columns.index(c) for c in columns]
    assert sorted(map(repr, (tuple(r) for r in df.select(*columns).collect()))) == sorted(repr(tuple(r[i] for i in at)) for r in found.fetchall())


def test_byte_bpe_query_equals_the_library(spark, library):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = {r[0]: library.encode_ordinary(r[1] or "") for r in rows}
    for r in queries.op13_byte_bpe(spark, SF).collect():
        assert r["n_tokens"] == len(want[r["doc_id"]]) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, want[r["doc_id"]])).encode()).hexdigest()
