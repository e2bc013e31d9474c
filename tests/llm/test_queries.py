"""Every registered query of the subpackage on the smallest tables, against a plain version of its contract."""

import hashlib
import os
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow.parquet as pq
import pytest

from spandrel.llm import decontamination, queries

from .test_operators import check_shards, plain_groups, plain_matches

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def texts():
    t = pq.read_table(f"{DATA}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    return dict(sorted(zip(t["doc_id"], t["text"], strict=True)))


def rows(spark, query):
    return query(spark, DATA).collect()


def library(name, texts, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path(name))
    return {i: [*t.encode(x or "", add_special_tokens=False).ids, end] for i, x in texts.items()}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_op1(spark, texts):
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    want = {i: (len((x or "").encode()), len(m.encode(x or ""))) for i, x in texts.items()}
    got = rows(spark, queries.op1_token_counts)
    assert len(got) == len(want) and {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in got} == want
    assert all(r["over_limit"] == (r["n_tokens"] > 4096) for r in got)


def test_op2(spark, texts):
    ids = library("byte_bpe_50k.json", texts, 2)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows(spark, queries.op2_best_fit_packing):
        assert r["ids_crc32"] == crc(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]])
        pieces[r["doc_id"]].append((r["piece"], r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, x in ids.items():
        own = sorted(pieces[i])
        assert [p for p, _, _ in own] == list(range(len(own))) and [s for _, s, _ in own] == np.cumsum([0, *[n for _, _, n in own]])[:-1].tolist()
        assert sum(n for _, _, n in own) == len(x) and (len(x) > 1024) == (len(own) > 1) and all(n == 1024 for _, _, n in own[1:])
    for places in sequences.values():
        ends = np.cumsum([0, *[n for _, n in sorted(places)]])
        assert [o for o, _ in sorted(places)] == ends[:-1].tolist() and ends[-1] <= 1024
    # Plain best fit, without a bound on open sequences, needs no fewer than the sum of tokens.
    assert len(sequences) <= 1.1 * sum(map(len, ids.values())) / 1024 + 12


def test_op3(spark, texts):
    got = rows(spark, queries.op3_sharding)
    check_shards([{**r.asDict(), "text": texts[r["doc_id"]]} for r in got], texts.items(), 40)
    for r in got:
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 16, zlib.crc32(raw), "rows", None)


def test_op4(spark, texts):
    want, start = {}, 0
    for i, ids in library("word_bpe_49k.json", texts, 1).items():
        want[i] = start, len(ids), crc(ids)
        start += len(ids)
    got = rows(spark, queries.op4_token_files)
    assert len(got) == len(want) and {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in got} == want


def test_op7(spark, texts):
    got = {r["doc_id"]: r for r in rows(spark, queries.op7_toxicity)}
    assert got.keys() == texts.keys()
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)


def test_op8(spark, texts):
    keys = list(texts)
    want = {keys[i]: (n, keys[c]) for i, (n, c) in plain_groups([texts[k] for k in keys]).items()}
    got = rows(spark, queries.op8_jaccard_join)
    assert len(got) == len(want) and {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want


def paragraphs(text):
    found = {line[k : k + 256] for line in text.split("\n") for k in range(0, len(line), 256)}
    return found or {""}


@pytest.mark.parametrize("name, table", [("op5_url_filters", "pages"), ("op8_jaccard_join", "documents")])
def test_sql(spark, name, table):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    got = queries.QUERIES[name](spark, DATA)
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    assert Counter(map(tuple, got.collect())) == Counter(want)


def test_op8_sql_odd_texts():
    """Case, few words, none, control characters, null and repeated texts, as the contract has them."""
    import duckdb

    con = duckdb.connect()
    con.sql(
        "CREATE TABLE documents AS SELECT * FROM (VALUES (5, 'One tWo'), (3, 'one' || chr(9) || 'two '), (4, 'one'), (7, ''), (8, NULL), (9, chr(32) || chr(13)), "
        "(10, 'a b c d e f'), (11, 'a b c d e'), (12, 'a b c d e' || chr(160) || ' f'), (13, 'É b'), (14, 'é b')) AS v(doc_id, text)"
    )
    found = {d: (n, c) for d, n, c in con.sql(f"SELECT doc_id, n_shingles, component_id FROM ({queries.ORACLE_SQL['op8_jaccard_join']})").fetchall()}
    assert found == {5: (1, 3), 3: (1, 3), 4: (1, 4), 7: (0, 7), 8: (0, 8), 9: (0, 9), 10: (2, 10), 11: (1, 11), 12: (2, 12), 13: (1, 13), 14: (1, 14)}


def test_op9(spark, texts):
    keys = list(texts)
    got = {r["doc_id"]: r for r in rows(spark, queries.op9_fingerprints)}
    assert got.keys() == texts.keys()
    prints = {}
    for i, k in enumerate(keys):
        own, after = texts[k] or "", texts[keys[(i + 1) % len(keys)]] or ""
        half = len(own) // 2
        edited = own[: len(own) - half] + after[:half]
        a, r = paragraphs(own), got[k]
        likeness = lambda b: len(a & b) / len(a | b)  # noqa: E731, B023
        assert (r["n_chars"], r["edited_sha256"]) == (len(own), hashlib.sha256(edited.encode()).hexdigest())
        assert abs(r["near_edited"] - likeness(paragraphs(edited))) < 1e-12 and abs(r["near_next"] - likeness(paragraphs(after))) < 1e-12
        assert prints.setdefault(frozenset(a), r["fingerprint"]) == r["fingerprint"] and prints.setdefault(frozenset(paragraphs(edited)), r["edited_fingerprint"]) == r["edited_fingerprint"]
    assert len(set(prints.values())) == len(prints)


def plain_leaks(texts):
    """(document, item) of the benchmark, by every stretch; documents with too few of an item's words are passed over."""
    t = pq.read_table(f"{DATA}/benchmark.parquet", columns=["item_id", "text"]).to_pydict()
    words = {i: decontamination.normal_words(x) for i, x in texts.items()}
    df = Counter(w for ws in words.values() for w in set(ws))
    for i, ws in words.items():
        there = set(ws)
        items = [(k, x) for k, x in zip(t["item_id"], t["text"], strict=True) if x and 0.6 * len(n := decontamination.normal_words(x)) <= sum(w in there for w in n)]
        for key, _ in plain_matches(texts[i] or "", items, df, len(texts)):
            yield i, key


def test_op10(spark, texts):
    got = rows(spark, queries.op10_decontamination)
    pairs, want = [(r["doc_id"], r["item_id"]) for r in got], set(plain_leaks(texts))
    assert len(pairs) == len(set(pairs)) and set(pairs) <= want and len(pairs) >= 0.9 * len(want) and want


def test_pipeline(spark, texts):
    import corpus_pipeline

    toxic = {r["doc_id"] for r in rows(spark, queries.op7_toxicity) if r["predicted"]}
    left = {i: x for i, x in texts.items() if i not in toxic}
    keys = list(left)
    groups = plain_groups([left[k] for k in keys])
    left = {k: left[k] for i, k in enumerate(keys) if groups[i][1] == i}
    held = {i for i, _ in plain_leaks(left)}
    got = {r["doc_id"] for r in corpus_pipeline.run(spark, DATA).collect()}
    assert toxic and held and got == set(left) - held
