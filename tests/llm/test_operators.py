"""The operators against plain versions, and on odd tables: nulls, empty and long texts, repeats, no rows, clashing columns."""

import hashlib
import json
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spandrel.llm import components, decontamination, fingerprints, jaccard_join, license_scan, packing, sharding, token_counts, token_files, token_ids, toxicity, url_filters
from spandrel.runtime import new_path

BYTE, WORD, PIECE = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json"), P.path("piece_bpe_32k.model")
WORDS = "the of and on er ing thint oned anble reston tion heat wonder erly lyst motes carn".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", ".", ","]) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    out = [sentence(rng, rng.randrange(1, 120)) for _ in range(60)]
    out += [None, "", " ", "\n", "a", "  two  spaces \n\n x ", "é ÉCOLE ½ 12'll", "<|endoftext|> x</s> <s>", "x" * 5000, "long " * 9000, out[0], out[1], out[0].upper()]
    words = out[2].split() + out[3].split()
    return [*out, " ".join(words), " ".join([*words[:-1], "changed"]), " ".join(words[3:])]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "x", "s", i, 7) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint, size bigint").repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("doc_id < 0")


def test_token_counts(docs, none, texts):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in token_counts.count_tokens(docs, PIECE, frequent=16).collect()}
    assert got == {i: (len((t or "").encode()), len(model.encode(t or ""))) for i, t in enumerate(texts)}
    assert token_counts.count_tokens(none, PIECE).count() == 0
    twice = docs.unionByName(docs).repartition(9).withColumnRenamed("size", "n_tokens")
    got = Counter((r["doc_id"], r["n_tokens"]) for r in token_counts.count_tokens(twice, PIECE, frequent=3).collect())
    assert got == Counter({(i, len(model.encode(t or ""))): 2 for i, t in enumerate(texts)})
    with pytest.raises(ValueError, match="n_tokens"):
        token_counts.count_tokens(twice, PIECE, keep=("doc_id", "n_tokens"))


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.characters(codec="utf-8"), max_size=60) | st.text(alphabet=" \n\ta'sZéß1▁<|endoftx>", max_size=60))
def test_ids_of_any_text(text):
    import sentencepiece
    from tokenizers import Tokenizer

    for path in (BYTE, WORD):
        want = Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids if path not in _libraries else _libraries[path].encode(text, add_special_tokens=False).ids
        assert np.frombuffer(token_ids.worker(path).ids([text])[0], "<u4").tolist() == want
    model = _libraries.setdefault("piece", sentencepiece.SentencePieceProcessor(model_file=PIECE))
    assert token_counts._counter(PIECE).count(text) == len(model.encode(text))


_libraries: dict = {}


def test_packing(docs, none, texts):
    packed = packing.pack(docs, BYTE, 2, capacity=64, open_bins=4).collect()
    encoder = token_ids.worker(BYTE)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in packed:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, t in enumerate(texts):
        ids = encoder.ids([t])[0] + np.array([2], "<u4").tobytes()
        own = sorted(by_doc[i], key=lambda r: r["piece"])
        assert b"".join(r["ids"] for r in own) == ids and [r["start"] for r in own] == np.cumsum([0, *[r["length"] for r in own]])[:-1].tolist()
        assert len(own) == 1 or all(r["length"] == 64 for r in own[1:])
    for places in by_sequence.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 64
    total = sum(r["length"] for r in packed)
    assert len(by_sequence) <= 1.5 * total / 64 + 12
    assert packing.pack(none, BYTE, 2).count() == 0


def check_shards(rows, want, shards):
    """Whole rows, counts at most one apart, slots without gaps."""
    assert Counter((r["doc_id"], r["text"]) for r in rows) == Counter(want)
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    sizes = [len(slots[s]) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1 and set(slots) <= set(range(shards)) and all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_sharding(spark, docs, none, texts):
    both = docs.unionByName(docs.where("doc_id = 0"))
    want = [*enumerate(texts), (0, texts[0])]
    for shards in (1, 7, 40):
        got = sharding.shard(both, shards, bucket_bytes=4000).collect()
        check_shards(got, want, shards)
    again = sharding.shard(both.repartition(5), 40, bucket_bytes=4000).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) or len(got) == len(again)
    assert [r["doc_id"] for r in sorted(got, key=lambda r: (r["shard"], r["slot"]))] != sorted(r["doc_id"] for r in got)
    assert sharding.shard(none, 40).count() == 0
    odd = both.withColumns({"shard": sharding.F.lit(1), "law": sharding.F.lit("x")})
    dealt, path = sharding.shard(odd, 40, bucket_bytes=4000), new_path(spark, "shards")
    sharding.write_shards(dealt, path)
    read = sharding.read_shards(spark, path, dealt)
    assert read.columns == dealt.columns and {r["law"] for r in read.collect()} == {"rows"}
    check_shards(read.collect(), want, 40)


def test_sharding_of_equal_rows(spark):
    """Rows equal in key and text fill a bucket, which is scattered again."""
    rows = [(5, "copy " * 40)] * 300 + [(i, f"text {i}") for i in range(100, 150)] + [(None, None)] * 20
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    dealt = sharding.shard(df, 7, bucket_bytes=4000)
    check_shards(dealt.collect(), rows, 7)
    name = "spark.sql.adaptive.enabled"
    spark.conf.set(name, "false")  # it would put small partitions together
    try:
        parts = dealt.select(sharding.F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    finally:
        spark.conf.unset(name)
    assert max(r["count"] for r in parts) < 150


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 70_000) | st.integers(0, 3), max_size=300))
def test_words_round_trip(values):
    words, offsets = token_files.encode(np.array(values, np.uint64), 64)
    assert token_files.decode(words, offsets, len(values), 64).tolist() == values


def test_token_files(spark, docs, none, texts):
    path = new_path(spark, "files")
    token_files.write(docs, path, WORD, 1)
    got = sorted(token_files.read(spark, path).collect(), key=lambda r: r["doc_id"])
    encoder, start = token_ids.worker(WORD), 0
    for i, t in enumerate(texts):
        ids = encoder.ids([t])[0] + np.array([1], "<u4").tobytes()
        r = got[i]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"], bytes(r["ids"])) == (i, start, len(ids) // 4, zlib.crc32(ids), ids)
        start += len(ids) // 4
    path = new_path(spark, "files")
    token_files.write(none, path, WORD, 1)
    assert token_files.read(spark, path).count() == 0


def test_token_file_pages(spark):
    """A page is written when it is full, not after 100 rows of half a MB; the ids are those of the texts. Rows of one key are in one file."""
    rng = random.Random(8)
    texts = [" ".join(rng.choice(WORDS) for _ in range(260_000)) for _ in range(8)]
    path = new_path(spark, "files")
    token_files.write(spark.createDataFrame([(7, t) for t in texts], "doc_id bigint, text string"), path, WORD, 1)
    hadoop, conf, pages = spark._jvm.org.apache, spark.sparkContext._jsc.hadoopConfiguration(), []
    for file in spark.read.parquet(path).inputFiles():
        reader = hadoop.parquet.hadoop.ParquetFileReader.open(hadoop.parquet.hadoop.util.HadoopInputFile.fromPath(hadoop.hadoop.fs.Path(file), conf))
        for block in reader.getFooter().getBlocks():
            words = next(c for c in block.getColumns() if c.getPath().toDotString() == "words")
            pages.append((words.getTotalUncompressedSize(), reader.readOffsetIndex(words).getPageCount()))
        reader.close()
    assert sum(size for size, _ in pages) > 3 << 20 and all(size / count < 2 << 20 for size, count in pages)
    encoder = token_ids.worker(WORD)
    got = [bytes(r["ids"]) for r in sorted(token_files.read(spark, path).collect(), key=lambda r: r["start"])]
    assert got == [encoder.ids([t])[0] + np.array([1], "<u4").tobytes() for t in sorted(texts)]


def test_words_in_any_case():
    """Words of letters and signs need no library; texts with other letters or special strings keep their case."""
    from tokenizers import Tokenizer

    library, encoder = Tokenizer.from_file(WORD), token_ids.WordEndIds(WORD, json.loads(open(WORD, encoding="utf-8").read()))
    for t in ["The THE the. THE!! éCOLE École?", "DON'T it's I'LL' x'", "a:b C-d) (E 12.5 `Q^"]:
        assert np.frombuffer(encoder.ids([t])[0], "<u4").tolist() == library.encode(t, add_special_tokens=False).ids
    assert "tokenizer" not in vars(encoder)
    for t in ["<|ENDOFTEXT|> The <|endoftext|>THE", "µ ª º ß ÿ Ÿ Σ ΟΔΟΣ İ", "A<|b|>", *map(chr, range(256)), *(f"Ab{chr(i)}'S" for i in range(256))]:
        assert np.frombuffer(encoder.ids([t])[0], "<u4").tolist() == library.encode(t, add_special_tokens=False).ids


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(500, i) for i in range(300, 500)] + [(i, i + 1) for i in range(600, 640)] + [(None, 3), (5, 5)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert {r["node"]: r["component"] for r in got} == {x: find(x) for x in parent} and len(got) == len(parent)
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/")]


@pytest.mark.parametrize("inline", [64, 0])
def test_url_filters(spark, monkeypatch, inline):
    monkeypatch.setattr(url_filters, "INLINE_RULES", inline)
    link = '<LINK href="{}" rel=canonical>'.format
    pages = [
        (1, "http://a.Example.com/en/x?q#f", ""), (2, "https://www.example.com/en/", ""), (3, "http://example.com", ""), (4, "http://x.net/es/1", ""), (5, "http://y.org/p", link("https://x.net/es/1")),
        (6, "http://z.org/q", '<meta http-equiv="refresh" content="0; url=http://y.org/p">'), (7, None, link("http://x.net/es/1")), (8, "no scheme", ""), (9, "http://notexample.com/en/", ""), (10, "http://w.org/", link("//example.com/")),
        (11, "http://w.org/", ""), (12, "http://q.org/d/e", link("f")), (13, "http://q.org/d/f", link("/g")), (14, "http://q.org/g", link("http://v.net/es/")), (1, "http://a.Example.com/en/x?q#f", ""),
    ]
    df = spark.createDataFrame([(i, u, h, "c") for i, u, h in pages], "page_id bigint, url string, html string, rule string")
    got = sorted(tuple(r) for r in url_filters.judge(df, url_filters.rules_frame(spark, RULES)).select("page_id", "host", "path", "rule", "verdict", "inherited").na.fill("-", ["rule"]).collect())
    one = (1, "a.example.com", "/en/x", "example.com/en/", "block", False)
    assert got == [
        one, one, (2, "www.example.com", "/en/", "www.example.com/en/", "allow", False), (3, "example.com", "", "-", "allow", False), (4, "x.net", "/es/1", "net/es/", "block", False), (5, "y.org", "/p", "-", "block", True),
        (6, "z.org", "/q", "-", "block", True), (7, "", "", "-", "allow", False), (8, "", "", "-", "allow", False), (9, "notexample.com", "/en/", "com/", "allow", False), (10, "w.org", "/", "-", "allow", True), (11, "w.org", "/", "-", "allow", True),
        (12, "q.org", "/d/e", "-", "block", True), (13, "q.org", "/d/f", "-", "block", True), (14, "q.org", "/g", "-", "block", True),
    ]
    assert url_filters.judge(df.where("page_id < 0"), url_filters.rules_frame(spark, RULES)).count() == 0
    moved = spark.createDataFrame([("http://r.org/1", "http://x.net/es/9")], "src string, dst string")
    extra = spark.createDataFrame([(1, "http://r.org/1", None)], "page_id bigint, url string, html string")
    assert url_filters.judge(extra, url_filters.rules_frame(spark, RULES), moved).first()["verdict"] == "block"


def test_licenses(docs, none, spark):
    rng = random.Random(2)
    mit = dict(reversed(license_scan.TEMPLATES))["MIT"]
    changed = " ".join(w for i, w in enumerate(license_scan._MIT.split()) if i % 40)
    rows = [(1, sentence(rng, 50) + " " + license_scan._MIT.lower() + " " + sentence(rng, 50), "MIT"), (2, changed, "MIT"), (3, "x. Licensed under CC BY-NC 4.0. y", "CC-BY-NC-4.0"), (4, sentence(rng, 400), None), (5, None, None), (6, license_scan._BSD_HEAD + license_scan._BSD_THIRD + license_scan._BSD_TAIL, "BSD-3-Clause"), (7, " ".join(license_scan._MIT.split()[:60]), None)]
    got = license_scan.scan(spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")).collect()
    assert {r["doc_id"]: r["license"] for r in got} == {i: n for i, _, n in rows} and mit
    scanner = license_scan.Scanner()
    for _, text, _ in rows:
        for name, d, first, n in scanner.scan(text):
            stretch = license_scan.bigrams(license_scan.normal_words(text)[first : first + n])
            best = max(license_scan.dice(stretch, license_scan.bigrams(license_scan.normal_words(t))) for m, t in license_scan.TEMPLATES if m == name)
            assert d <= best + 1e-9 and best >= license_scan.LEAST
    assert license_scan.scan(docs).count() == docs.count() and license_scan.scan(none).count() == 0


def test_url_rules_of_one_length(spark, monkeypatch):
    """Many rules of one domain, and ties, by both ways of looking rules up."""
    rules = [("block", "a.com", "/x/"), ("allow", "b.a.com", "/"), ("block", "b.a.com", "/"), ("block", "c.a.com", "/"), ("allow", "a.com", "/xy"), *(("block", "z.org", f"/p{i}") for i in range(90))]
    urls = ["http://b.a.com/x/1", "http://c.a.com/x/1", "http://a.com/xyz", "http://z.org/p7/q", "http://z.org/p77", "http://z.org/", "http://q.z.org/p", None]
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate([*urls, *urls])], "page_id bigint, url string, html string")
    got = []
    for inline in (64, 10_000):
        monkeypatch.setattr(url_filters, "INLINE_RULES", inline)
        got.append(sorted((r["page_id"], r["rule"] or "", r["verdict"]) for r in url_filters.judge(pages, url_filters.rules_frame(spark, rules)).collect()))
    assert got[0] == got[1] and [r[1:] for r in got[0][:8]] == [("b.a.com/", "allow"), ("c.a.com/", "block"), ("a.com/xy", "allow"), ("z.org/p7", "block"), ("z.org/p77", "block"), ("", "allow"), ("", "allow"), ("", "allow")]


def test_licenses_against_every_stretch(spark):
    """A licence is found where some stretch of the text is close enough, and nowhere else."""
    rng = random.Random(17)
    templates = tuple((f"L{k}", " ".join(f"t{k}w{rng.randrange(12)}" for _ in range(n))) for k, n in enumerate((9, 14, 22)))
    sets = [license_scan.bigrams(license_scan.normal_words(t)) for _, t in templates]
    rows, want = [], {}
    for i in range(120):
        words = templates[i % 3][1].split()
        for _ in range(rng.randrange(0, 6)):
            words[rng.randrange(len(words))] = rng.choice([f"o{i}", words[0], "x"])
        text = [f"a{j}" for j in range(rng.randrange(4))] + words + [f"b{j}" for j in range(rng.randrange(4))]
        best = 0.0
        for a in range(len(text)):
            for b in range(a + 2, len(text) + 1):
                stretch = license_scan.bigrams(text[a:b])
                best = max(best, *(license_scan.dice(stretch, s) for s in sets))
        rows.append((i, " ".join(text)))
        want[i] = best
    got = {r["doc_id"]: r["dice"] for r in license_scan.scan(spark.createDataFrame([*rows, (0, rows[0][1]), (None, None)], "doc_id bigint, text string"), templates).collect() if r["doc_id"] is not None}
    found = {i for i, x in want.items() if x >= license_scan.LEAST}
    assert {i for i, x in got.items() if x is not None} == found and 30 < len(found) < 120
    assert all(got[i] <= want[i] + 1e-9 for i in found)


def test_kernel_is_the_subsequence_kernel():
    """Look-ups of the collapsed features give the kernel by its definition."""
    def plain(s, t):
        def features(w):
            out = Counter()
            for i in range(len(w)):
                for j in range(i + 1, len(w)):
                    for k in range(j + 1, min(len(w), i + toxicity.SPAN)):
                        out[w[i], w[j], w[k]] += toxicity.DECAY ** (k - i + 1)
            norm = sum(x * x for x in out.values()) ** 0.5
            return {u: x / norm for u, x in out.items()}
        a, b = features(s), features(t)
        return sum(x * b.get(u, 0) for u, x in a.items())

    words = [toxicity._windows(toxicity._letters(w))[0] for w in ("idiot", "idxiot", "banana", "motion")]
    codes, weights = toxicity.features(words)
    dense = np.zeros((4, toxicity._BASE**3))
    for i in range(4):
        np.add.at(dense[i], codes[i], weights[i])
    for i in range(4):
        for j in range(4):
            assert abs(dense[i] @ dense[j] - plain(words[i], words[j])) < 1e-4


def test_toxicity(spark, none):
    rng = random.Random(4)
    bad = ["idiot", "moron", "scum", "worthless"]
    rows = []
    for i in range(400):
        words = sentence(rng, 60).split()
        if i % 4 == 0:
            words[rng.randrange(60)] = rng.choice(bad)
        rows.append((i, " ".join(words), int(i % 4 == 0)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    model = toxicity.fit(docs.drop("toxic"), docs.select("doc_id", "toxic"))
    tests = ["you idiot", "you i.d.i.o.t now", "an i d i o t here", "an idi-ot", "some moron", "the of and tion", "", None, "x" * 100, "heat wonder erly"]
    got = {r["doc_id"]: r["score"] for r in toxicity.score(spark.createDataFrame(list(enumerate(tests)), "doc_id bigint, text string"), model).collect()}
    assert [got[i] >= 0.5 for i in range(len(tests))] == [True] * 5 + [False] * 5 and all(0 <= x <= 1 for x in got.values())
    assert toxicity.score(none, model).count() == 0
    empty = toxicity.train(toxicity._PARTS.empty_table())
    assert toxicity.Scorer(empty).highest(["idiot"])[0] < 0
    odd = docs.drop("toxic").unionByName(spark.createDataFrame([(0, None), (None, "an idiot"), (1, ""), (4, "zzz")], "doc_id bigint, text string")).withColumns({"score": toxicity.F.lit(1), "key": toxicity.F.lit("k")})
    again = toxicity.fit(odd.unionByName(odd.where("doc_id % 7 = 0")), docs.select("doc_id", "toxic").unionByName(spark.createDataFrame([(None, 1), (3, None)], "doc_id bigint, toxic int")))
    scores = toxicity.score(odd, again, keep=("doc_id", "key")).collect()
    assert len(scores) == odd.count() and all(0 <= r["score"] <= 1 for r in scores)
    assert toxicity.Scorer(toxicity.fit(none, docs.select("doc_id", "toxic"))).highest(["idiot"])[0] < 0


def plain_groups(texts):
    sets = []
    for t in texts:
        w = [x.decode() for x in (t or "").encode().lower().split()]
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in range(len(texts))}


def test_jaccard_join(spark, docs, none, texts):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(docs).collect()}
    assert got == plain_groups(texts)
    rng = random.Random(8)
    seeds = [sentence(rng, n).split() for n in (6, 8, 9, 12, 20, 40, 80, 200)]
    near = []
    for s in seeds:
        for _ in range(14):
            w = list(s)
            for _ in range(rng.randrange(0, max(2, len(w) // 16))):
                w[rng.randrange(len(w))] = f"new{rng.randrange(9)}"
            near.append(" ".join(w[: len(w) - rng.randrange(0, 3)]))
    df = spark.createDataFrame(list(enumerate(near)), "doc_id bigint, text string").repartition(4)
    for boundary in (0, 12, jaccard_join.LIGHT_MOST, None):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(df, boundary=boundary).collect()}
        assert got == plain_groups(near)
    assert jaccard_join.jaccard_components(none).count() == 0


@pytest.mark.parametrize("boundary", [0, None])
def test_jaccard_join_of_hot_lists(spark, monkeypatch, boundary):
    """Lists that unlike sets share by the hundred, among them a large group of near copies; every list is dealt by a salt."""
    monkeypatch.setattr(jaccard_join, "SALT_ROWS", 32)
    rng = random.Random(21)
    passage = [f"p{i}" for i in range(60)]
    near = [f"n{i}" for i in range(150)]
    texts = []
    for i in range(300):  # a passage of two thirds to four fifths of the text
        own = [f"o{i}x{j}" for j in range(rng.randrange(14, 28))]
        texts.append(" ".join(passage + own))
    for _ in range(200):  # changed here and there, so that many copies are unlike each other
        w = list(near)
        for _ in range(rng.randrange(0, 9)):
            w[rng.randrange(len(w))] = f"c{rng.randrange(40)}"
        texts.append(" ".join(w))
    rng.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(df, boundary=boundary).collect()}
    want = plain_groups(texts)
    assert got == want and len({c for _, c in want.values()}) > 20


def test_jaccard_join_of_odd_keys(spark):
    """Null and repeated keys: each text is a node of its own, and a component has its smallest key."""
    a, b = "one two three four five six seven eight", "quite other words than those of the first text here"
    rows = [(1, a), (None, a), (1, b), (0, b), (None, "a text that only a row without a key has"), (7, None), (None, ""), (7, None), (3, a), (3, a)]
    df = spark.createDataFrame([(i, t, "z", 1) for i, t in rows], "doc_id bigint, text string, node string, n int").repartition(3)
    got = Counter(tuple(r) for r in jaccard_join.jaccard_components(df).collect())
    assert got == Counter({(1, 4, 1): 1, (None, 4, 1): 1, (1, 6, 0): 1, (0, 6, 0): 1, (None, 6, None): 1, (7, 0, 7): 2, (None, 0, None): 1, (3, 4, 1): 2})
    kept = Counter(tuple(r) for r in jaccard_join.one_of_each(df).select("doc_id", "text").collect())
    assert kept == Counter({(1, a): 1, (0, b): 1, rows[4]: 1, (7, None): 2, (None, ""): 1})
    again = jaccard_join.one_of_each(spark.createDataFrame([(2, a, "x"), (2, a, "y"), (2, b, "x"), (None, a, "x")], "doc_id bigint, text string, lang string"))
    assert again.columns == ["doc_id", "text", "lang"] and sorted((r["doc_id"], r["text"]) for r in again.collect()) == sorted([(2, a), (2, b)])


def test_fingerprints(spark, texts):
    rng = random.Random(6)
    many = [*texts, "\n".join(sentence(rng, 5) for _ in range(300)), "\n".join(sentence(rng, 5) for _ in range(3))]
    df = spark.createDataFrame([(10 * i, t) for i, t in enumerate(many)], "doc_id bigint, text string").repartition(3)
    near = fingerprints.with_next(df)
    sets = near.select("doc_id", "text", "next_text", fingerprints.paragraphs(near["text"]).alias("a"), fingerprints.paragraphs(near["next_text"]).alias("b"))
    cells = sets.withColumns({"ca": fingerprints.sketch(sets["a"]), "cb": fingerprints.sketch(sets["b"])})
    got = sorted(fingerprints.with_differences(cells, {"d": ("a", "b", "ca", "cb")}).select("doc_id", "text", "next_text", "a", "b", "d").collect())
    for i, r in enumerate(got):
        assert (r["text"], r["next_text"]) == (many[i] or "", many[(i + 1) % len(many)] or "")
        assert r["d"] == len(set(r["a"]) ^ set(r["b"]))
    prints = {r["text"]: r["fingerprint"] for r in fingerprints.fingerprint(df).collect()}
    assert len(set(prints.values())) == len({frozenset(r["a"]) for r in got})
    assert fingerprints.with_next(df.where("doc_id < 0")).count() == 0


def differences(spark, pairs):
    df = spark.createDataFrame(pairs, "a array<bigint>, b array<bigint>")
    df = df.withColumns({"ca": fingerprints.sketch(df["a"]), "cb": fingerprints.sketch(df["b"])})
    return [(set(r["a"]) ^ set(r["b"]), r["d"]) for r in fingerprints.with_differences(df, {"d": ("a", "b", "ca", "cb")}).collect()]


def test_fingerprints_of_like_digests(spark):
    """Digests with the same first cells and the same class in every split."""
    x = "xxhash64(id)"
    cells = [f"pmod(shiftrightunsigned(x, {20 * t + 3}), 10)" for t in range(3)]
    classes = [f"pmod(xxhash64(x, {level}), 8)" for level in range(1, 7)]
    alike = spark.range(60_000).selectExpr(f"{x} AS x").selectExpr("x", f"struct({', '.join(cells + classes)}) AS k").groupBy("k").agg({"x": "collect_list"}).where("size(`collect_list(x)`) > 1")
    pairs = [(r[1], [7]) for r in alike.collect()]
    assert pairs
    assert all(d == len(want) for want, d in differences(spark, pairs))


def test_fingerprints_beyond_the_last_split(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "LEVELS", 1)
    rng = random.Random(8)
    a, b = ([rng.randrange(-(1 << 63), 1 << 63) for _ in range(n)] for n in (2000, 900))
    assert all(d == len(want) for want, d in differences(spark, [(a, b), (a, a[:50]), (a, [*a[1:], 5])]))


def test_decontamination(spark, docs, none):
    rng = random.Random(9)
    items = [(i, " ".join(f"w{rng.randrange(4000)}x" if rng.random() < 0.7 else rng.choice(WORDS) for _ in range(rng.randrange(12, 60)))) for i in range(30)] + [(90, None), (91, ""), (92, "too short")]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    rows, want = [], set()
    for i in range(120):
        words = [f"u{rng.randrange(9000)}y" if rng.random() < 0.5 else rng.choice(WORDS) for _ in range(rng.randrange(30, 300))]
        if i % 4 == 0:
            item, text = items[rng.randrange(30)]
            held = text.split()
            if i % 8 == 0:  # a paraphrase: one word in seven is another, capitals and commas
                held = [f"z{k}" if k % 7 == 3 else w.upper() + "," for k, w in enumerate(held)]
            at = rng.randrange(len(words))
            words = words[:at] + held + words[at:]
            want.add((i, item))
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame([*rows, (500, None), (501, "")], "doc_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(df, benchmark).collect()}
    assert got == want
    assert decontamination.contaminated(none, benchmark).count() == 0 and decontamination.contaminated(df, benchmark.where("item_id < 0")).count() == 0


def test_decontamination_of_common_words(spark):
    """Items of words that half of the documents have, among words that no item has."""
    rng = random.Random(12)
    common = [f"b{k}" for k in range(60)]
    items = [(i, " ".join(rng.sample(common, 17))) for i in range(12)]
    rows, want = [], set()
    for i in range(200):
        words = [w for k in rng.sample(range(60), 30) for w in (common[k], *(f"u{rng.randrange(500)}" for _ in range(9)))]
        if i % 4 == 0:
            words += [*(f"u{rng.randrange(500)}" for _ in range(40)), *items[i % 12][1].split(), *(f"u{rng.randrange(500)}" for _ in range(40))]
            want.add((i, i % 12))
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]): r["common"] for r in decontamination.contaminated(df, spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    assert {k for k, common in got.items() if common == 1.0} == want


def plain_matches(text, items, df, n_docs):
    """Every stretch of a document against every item: the words in order, and the answer words."""
    ids = decontamination.normal_words(text)
    for key, item in items:
        words = decontamination.normal_words(item)
        there = [w for w in words if df[w]] or words
        rare = sorted(there, key=lambda w: -max(1e-3, np.log((n_docs + 1) / (df[w] + 0.5))))  # stable
        answer = set(rare[: max(1, -(-len(words) // 4))])
        span, best = int(np.ceil(1.3 * len(words))), 0
        for at in range(len(ids)):
            stretch = ids[at : at + span]
            if len(answer & set(stretch)) / len(answer) >= 0.3 and (common := decontamination.common_subsequence(words, stretch) / len(words)) >= 0.6:
                best = max(best, common)
        if best:
            yield key, best


def test_decontamination_recall(spark, monkeypatch):
    """A benchmark of many spaces and blocks against every stretch of every document."""
    monkeypatch.setattr(decontamination, "RANK", 16)
    monkeypatch.setattr(decontamination, "BLOCK_ITEMS", 50)
    rng = random.Random(31)
    common = [f"b{k}" for k in range(300)]
    items = [(i, " ".join(rng.choice(common) if rng.random() < 0.5 else f"r{rng.randrange(3000)}" for _ in range(rng.randrange(8, 40)))) for i in range(120)]
    rows = []
    for i in range(90):
        words = [rng.choice(common) if rng.random() < 0.6 else f"r{rng.randrange(3000)}" for _ in range(rng.randrange(10, 120))]
        for _ in range(rng.randrange(3)):
            held = [w if rng.random() < rng.choice([1, 0.85, 0.7]) else f"z{rng.randrange(99)}" for w in items[rng.randrange(120)][1].split()]
            at = rng.randrange(len(words))
            words = words[:at] + held + words[at:]
        rows.append((i, " ".join(words)))
    df = Counter(w for _, t in rows for w in set(t.split()))
    # Document frequencies and answer words do not depend on the block.
    want = {(i, key): best for i, t in rows for key, best in plain_matches(t, items, df, len(rows))}
    found = decontamination.contaminated(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), spark.createDataFrame(items, "item_id bigint, text string"))
    got = {(r["doc_id"], r["item_id"]): r["common"] for r in found.collect()}
    assert set(got) <= set(want) and len(want) > 60 and len(got) >= 0.9 * len(want)
    assert sum(abs(got[k] - want[k]) < 1e-9 for k in got) >= 0.9 * len(got) and {k for k, x in want.items() if x == 1} <= set(got)


def test_decontamination_of_short_items_and_odd_rows(spark):
    """Items of fewer words match whole and in a row; null and repeated keys and clashing columns."""
    benchmark = spark.createDataFrame([(1, "Alpha beta"), (2, "gamma"), (3, "beta, alpha beta!"), (4, "..."), (1, "alpha beta"), (None, "delta epsilon")], "item_id bigint, text string")
    rows = [(1, "x ALPHA, beta y"), (1, "x ALPHA, beta y"), (None, "gamma delta . epsilon"), (2, "alpha x beta"), (3, "beta alpha beta"), (4, None)]
    df = spark.createDataFrame([(i, t, 0.5, 7) for i, t in rows], "doc_id bigint, text string, cosine double, item_id bigint").repartition(2)
    got = Counter((r["doc_id"], r["item_id"], r["common"]) for r in decontamination.contaminated(df, benchmark).collect())
    assert got == Counter({(1, 1, 1.0): 4, (None, 2, 1.0): 1, (None, None, 1.0): 1, (3, 3, 1.0): 1, (3, 1, 1.0): 2})


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=20), st.lists(st.integers(0, 5), max_size=20))
def test_common_subsequence(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert decontamination.common_subsequence(a, b) == table[-1][-1]


def test_sha(spark):
    assert hashlib.sha256(b"").hexdigest() == spark.sql("SELECT sha2(cast('' AS binary), 256)").first()[0]
