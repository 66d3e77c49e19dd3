"""Small tests of the ten operators: brute force, round trips, and the cases that each docstring defines."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from sparkloom.llm import bpe, bwt, common, cws, flat_graph, html_blocks, html_main, langid, packing, queries, simhash, simhash_groups, suffix_dedup, url_rules, warc

rng = random.Random(5)
WORDS = ["".join(rng.choice("abcdefghijk") for _ in range(rng.randrange(2, 8))) for _ in range(400)]
say = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
PASSAGE = say(150)
TEXTS = [None, "", " \n", "é 日本 \U0001f600 mañana", say(30), say(300) + PASSAGE + say(40), say(20) + PASSAGE, "ab" * 900, say(60), "x" * 5000, say(3000)]
TEXTS += [TEXTS[4], TEXTS[5], TEXTS[8] + " tail"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "src", 7, 1, b"x") for i, t in enumerate(TEXTS)] + [(4, TEXTS[4], "src", 7, 1, b"x")]
    return spark.createDataFrame(rows, "doc_id long, text string, fp string, kind int, part int, v binary")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def by_id(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def reference_encoder():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_is_tiktoken_and_comes_back(spark, docs, empty):
    enc = reference_encoder()
    got = by_id(bpe.round_trip_digests(docs), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    want = []
    for i, t in [*enumerate(TEXTS), (4, TEXTS[4])]:
        ids = np.array(enc.encode_ordinary(t or ""), "<u4").tobytes()
        want.append((i, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want)
    assert bpe.round_trip_digests(empty).count() == 0
    back = bpe.decode(bpe.encode(docs))
    assert by_id(back, "doc_id", "text") == sorted((i, t or "") for i, t in [*enumerate(TEXTS), (4, TEXTS[4])])
    c = bpe.codec("byte_bpe_50k.tiktoken")
    odd = [" 's it's  x", "\n\n x", "a \n b", "x\u0085y᠎z", "　a b", "-----" * 9, "<|endoftext|>"]
    odd += ["".join(rng.choice(" \n\tab's1,é日́\u001f\u0085") for _ in range(20)) for _ in range(300)]
    for t in odd:
        assert np.frombuffer(c.encode(t), "<u4").tolist() == enc.encode_ordinary(t)


def test_bpe_offsets_cover_split_characters():
    c = bpe.codec("byte_bpe_50k.tiktoken")
    a, z = c.offsets("a日b")
    assert a[0] == 0 and z[-1] == 3 and all(x < y for x, y in zip(a, z))
    step = bpe.incremental_decoder()
    ids = np.frombuffer(c.encode("日\U0001f600é"), "<u4").tolist()
    assert "".join(step(i) for i in ids) + step(None, True) == "日\U0001f600é"


def test_merged_transforms_find_repeated_windows():
    for _ in range(40):
        al = rng.choice([b"ab", b"abc\x00", bytes(range(256))])
        strings = [bytes(rng.choice(al) for _ in range(rng.randrange(0, 50))) for _ in range(rng.randrange(1, 10))]
        strings += [rng.choice(strings)[2:] for _ in range(3)]
        span = rng.choice([1, 2, 5, 8, 13])
        seen = Counter(s[i : i + span] for s in strings for i in range(len(s) - span + 1))
        want = [[seen[s[i : i + span]] > 1 for i in range(len(s) - span + 1)] for s in strings]
        assert [x.tolist() for x in suffix_dedup.repeated_windows(strings, span, rng.choice([20, 100, 10000]))] == want


def test_a_transform_is_that_of_the_sorted_suffixes():
    strings = [b"banana", b"ananas", b""]
    text = bwt.symbols(strings).tolist()
    order = sorted(range(len(text)), key=lambda i: text[i:] + text[:i])
    assert bwt.transform(strings).start.tolist() == order


def test_suffix_dedup_is_brute_force(docs, empty):
    texts = [*TEXTS, TEXTS[4]]
    want = sorted((i, *d) for i, d in zip([*range(len(TEXTS)), 4], suffix_dedup.brute_force(texts)))
    assert by_id(suffix_dedup.digests(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want
    assert suffix_dedup.digests(empty).count() == 0


def test_url_rules_are_brute_force(spark):
    urls = [None, "", "x", "http://", "http://example.org", "http://EXAMPLE.org/es/x?y", "https://a.example.org/en/1#z", "http://b.org//", "http://fr.com/fr/", "http://com/de/1", "http://xcom/de/", "ftp://..com/fr/x", "http://example.org/en/2", "http://é.org/\U0010ffff"]
    pages = spark.createDataFrame([(i % 12, u, "h", 1) for i, u in enumerate(urls)], "page_id long, url string, host string, pos int")
    rules = spark.createDataFrame(queries.RULES, "rule string, verdict string")
    want = []
    for i, u in enumerate(urls):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        h, p = (m[1].translate(str.maketrans(url_rules.UPPER, url_rules.LOWER)), m[2]) if m else ("", "")
        fit = [(r, v) for r, v in queries.RULES for rh, rp in [(r.split("/")[0], r[r.index("/") :])] if (h == rh or h.endswith("." + rh)) and p.startswith(rp)]
        want.append((i % 12, h, p, *max(fit, key=lambda x: len(x[0]), default=(None, "allow"))))
    got = [tuple(r) for r in url_rules.judge(pages, rules).select("page_id", "host", "path", "rule", "verdict").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert url_rules.judge(pages.where("false"), rules).count() == 0
    assert {r["verdict"] for r in url_rules.judge(pages, rules.where("false")).collect()} == {"allow"}


def jaccard(a, b):
    a, b = Counter(a.lower().split()), Counter(b.lower().split())
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def test_fingerprints(docs, empty):
    got = sorted(cws.fingerprint_with_next(docs).collect(), key=lambda r: -r["doc_id"])
    texts = sorted([*((i, t or "") for i, t in enumerate(TEXTS)), (4, TEXTS[4])], reverse=True)
    assert [r["doc_id"] for r in got] == [i for i, _ in texts]
    for k, (r, (_, t)) in enumerate(zip(got, texts)):
        following = texts[(k + 1) % len(texts)][1]
        h = len(t) // 2
        edited = t[: len(t) - h] + following[:h]
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and r["n_chars"] == len(t)
        if t.split():
            assert abs(r["near_edited"] - jaccard(t, edited)) < 0.45
    by_text = {}
    for r, (_, t) in zip(got, texts):
        assert by_text.setdefault(t, r["fingerprint"]) == r["fingerprint"]
    assert cws.fingerprint_with_next(empty).count() == 0


def test_signatures_of_two_texts_equal_those_of_each_alone(spark):
    texts = {(1, 0): "a b b c", (1, 1): "b c c d", (2, 0): None, (2, 1): "a a a", (3, 0): "x y", (4, 0): None, (4, 1): None}
    rows = [(key, kind, term) for (key, kind), text in texts.items() for term in (text.split() if text else [None])]
    terms = spark.createDataFrame(rows, "key int, kind int, term string")
    both = {r["key"]: r for r in cws.signatures(terms, ["key"], 2).collect()}
    for kind in (0, 1):
        alone = {r["key"]: r["sig"] for r in cws.signature(terms.where(F.col("kind") == kind), ["key"]).collect()}
        assert {k: r[f"sig_{kind}"] for k, r in both.items() if (k, kind) in texts} == alone
    assert len(both[3]["sig_0"]) == cws.SAMPLES and not any(both[4]["sig_0"]) and not any(both[3]["sig_1"])


def test_packing(docs, empty):
    rows = packing.pack(docs).collect()
    c = bpe.codec(packing.FILE)
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
    for i, t in enumerate(TEXTS):
        ids = np.frombuffer(c.encode(t or "") + np.array([2], "<u4").tobytes(), "<u4")
        assert sum(r["length"] for r in by_doc[i]) == len(ids) * (2 if i == 4 else 1)
        for r in by_doc[i]:
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
            assert r["length"] == 1024 or r["piece"] == 0
    for sequence in {r["sequence_id"] for r in rows}:
        own = sorted((r["offset"], r["length"]) for r in rows if r["sequence_id"] == sequence)
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 1024
    assert packing.pack(empty).count() == 0
    lengths, counts = np.unique(np.random.default_rng(1).integers(1, 1025, 5000), return_counts=True)
    made, bound = packing.plan(lengths, counts)
    held = Counter()
    for config, n in made:
        assert sum(config) <= 1024 and n > 0
        for x in config:
            held[x] += n
    assert held == Counter(dict(zip(lengths.tolist(), counts.tolist())))
    sequences = sum(n for _, n in made)
    assert (lengths * counts).sum() / 1024 <= bound <= sequences <= bound + len(lengths) / 2 and sequences <= 1.01 * bound + 1


def test_the_fractional_solution_covers_and_the_bound_holds():
    demand = np.zeros(13, np.int64)
    demand[[5, 4, 3, 7]] = [12, 8, 10, 6]
    found = packing.solve(demand, 400)
    cover = Counter()
    for config, amount in found.amounts.items():
        assert sum(config) <= 12
        for x in config:
            cover[x] += amount
    scale = found.value / sum(found.amounts.values())
    assert all(cover[x] * scale >= demand[x] * (1 - 1e-9) for x in cover) and set(cover) == {3, 4, 5, 7}
    # twelve tokens: 7+5 six times, 5+4+3 six times, 4+4+4 and 3+3+3+3 for the rest: 13 and two thirds
    assert (np.arange(13) * demand).sum() / 12 <= found.bound <= 13.67 <= found.value + 0.01 and found.value < 14.2
    best, last = packing.knapsack(np.array([-np.inf, -np.inf, -np.inf, 3.0, 4.2, 5.0]))
    assert best.tolist() == [0, 0, 0, 3, 4.2, 5.0]


def test_packing_of_documents_is_near_the_bound(spark):
    rows = packing.pack(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).select("length", "sequence_id").toPandas()
    lengths, counts = np.unique(rows["length"], return_counts=True)
    made, bound = packing.plan(lengths, counts)
    assert rows["sequence_id"].nunique() == sum(n for _, n in made) <= min(964, bound + len(lengths) / 2)
    assert rows.groupby("sequence_id")["length"].sum().max() <= 1024


def test_flat_graph_is_brute_force(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(400, 16)).astype(np.float32)
    x[100:160] = x[0] + 0.05 * r.normal(size=(60, 16))
    x[200:220] = x[1]
    rows = [(i, v.tolist(), 1, 2) for i, v in enumerate(x)]
    rows += [(500, None, 1, 2), (501, [0.0] * 16, 1, 2), (502, [float("nan")] * 16, 1, 2), (503, [None] * 16, 1, 2), (504, [1.0, 2.0], 1, 2), (0, x[0].tolist(), 1, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, node int, weight int")
    unit = flat_graph.unit([v for _, v, _, _ in rows if v and len(v) == 16 and all(k is not None and k == k for k in v) and any(v)])
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    got = flat_graph.near_duplicates(df).collect()
    assert len(got) == len(rows)
    by = {r["vec_id"]: r for r in got}
    assert sum(by[i]["n_links"] for i in range(400)) + by[0]["n_links"] >= 0.98 * near.sum()
    assert all(by[i]["n_links"] == 0 and by[i]["component_id"] == i and by[i]["kept"] for i in range(500, 505))
    assert by[210]["component_id"] == 1 and not by[210]["kept"] and by[150]["component_id"] == 0
    assert flat_graph.near_duplicates(df.where("false")).count() == 0


def test_hot_clusters_are_dealt_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(flat_graph, "SHARD", 60)
    r = np.random.default_rng(6)
    x = (r.normal(size=16) + 0.02 * r.normal(size=(200, 16))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = flat_graph.near_duplicates(df).collect()
    assert {r["n_links"] for r in got} == {199} and {r["component_id"] for r in got} == {0}


HTML = """<html><head><title>T</title><script>x="</p>"</script></head><body><nav><ul><li><a href="/a">menu</a></ul></nav><div class="ad-12">buy</div>
<article class=post-7><h1>Head &amp; line</h1><p>one  two<br>three <b>four<p>five &eacute;</p><aside>side</aside></article><div id="comments"><p>me too</p></div><footer>end</footer></body></html>"""


def test_main_text(spark):
    rows = [(1, "http://a/1", HTML), (2, "http://a/2", HTML.replace("post-7", "post-88")), (3, None, None), (4, "x", ""), (5, "http://b/", "<p>alone</p>"), (1, "http://a/1", HTML)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("z")).withColumn("path", F.lit(1))
    got = by_id(html_main.extract(df), "page_id", "text", "n_chars")
    main = "Head & line\none two three four\nfive é"
    assert got == [(1, main, len(main)), (1, main, len(main)), (2, main, len(main)), (3, "", 0), (4, "", 0), (5, "alone", 5)]
    assert html_main.extract(df.where("false")).count() == 0
    assert html_blocks.read("<div hidden><p>a</div><p>b").blocks[1].text == "b"


def test_language_id_on_held_out_rows(spark, docs):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("held_out", langid.held_out())
    model = langid.train(d.where("not held_out"))
    got = langid.predict(d.where("held_out"), model, keep=("lang",)).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.97 * len(got) and all(0 <= r["score"] <= 1 for r in got)
    odd = {r["doc_id"]: r for r in langid.predict(spark.createDataFrame([(1, None), (2, ""), (3, "12 ..."), (4, "the and for")], "doc_id long, text string"), model).collect()}
    assert [odd[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and odd[1]["score"] == 0
    nothing = langid.train(docs.select("text", F.lit(None).cast("string").alias("lang")))
    assert {r["lang_pred"] for r in langid.predict(docs, nothing).collect()} == {"und"}


def test_simhash_is_brute_force(docs, empty):
    got = simhash.near_duplicates(docs).collect()
    fps = {r["doc_id"]: r["fp"] & (2**64 - 1) for r in got}
    for i, t in enumerate(TEXTS):
        assert fps[i] == simhash.fingerprint(t or "")
    least = {i: i for i in fps}
    for _ in fps:
        for a in fps:
            for b in fps:
                if bin(fps[a] ^ fps[b]).count("1") <= 2:
                    least[a] = least[b] = min(least[a], least[b])
    assert {r["doc_id"]: r["component_id"] for r in got} == least and len(got) == len(TEXTS) + 1
    assert simhash.near_duplicates(empty).count() == 0


def test_simhash_links_all_pairs_within_two_bits(spark):
    base = [rng.getrandbits(64) for _ in range(30)]
    fps = set(base)
    for f in base:
        for _ in range(6):
            fps.add(f ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    fps = [f - (f >> 63 << 64) for f in fps]
    want = {(a, b) for a in fps for b in fps if a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= 2}
    assert {(r["a"], r["b"]) for r in simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()} == want


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7), (None, 3)], "src long, dst long")
    got = {r["node"]: r["component"] for r in common.connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_warc_records(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/", HTML), (2, None, None), (1, "http://a/", HTML)], "page_id long, url string, html string").withColumn("block", F.lit(1))
    rows = warc.derivatives(warc.responses_of_pages(pages)).collect()
    assert Counter(r["record_type"] for r in rows) == {"metadata": 3, "conversion": 3}
    one = next(r for r in rows if r["page_id"] == 1 and r["record_type"] == "conversion")
    meta = next(r for r in rows if r["page_id"] == 1 and r["record_type"] == "metadata")
    assert one["refers_to"] == meta["refers_to"] and one["record_id"] != meta["record_id"]
    assert one["source_payload_digest"] == warc.digest(HTML.encode()) and one["block_digest"] == warc.digest(one["block"].encode())
    assert "outlink: /a" in meta["block"] and "five é" in one["block"]
    data = warc.serialize("conversion", one["record_id"], one["refers_to"], one["target_uri"], one["warc_date"], "text/plain", one["block"].encode())
    z = zlib.compressobj(wbits=31)
    (tmp_path / "a.warc.gz").write_bytes((z.compress(data) + z.flush()) * 2)
    back = warc.read_warc(spark, str(tmp_path)).collect()
    assert len(back) == 2 and bytes(back[0]["block"]).decode() == one["block"] and back[0]["warc_type"] == "conversion"
    assert warc.derivatives(warc.responses_of_pages(pages.where("false"))).count() == 0


def test_sql_of_url_filters(spark):
    from tests import oracle

    got = queries.op4_url_filters(spark, oracle.SF).toPandas()
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM '{oracle.SF}/pages.parquet'")
    assert oracle.rows(got) == oracle.rows(c.execute(queries.ORACLE_SQL["op4_url_filters"]).df())


def test_pipeline_keeps_clean_documents(spark, tmp_path):
    import corpus_pipeline

    rows = [(1, "clean words of one document", "en", "s", 27), (2, "clean words of one document", "en", "s", 27), (3, "123 ...", None, "s", 7), (4, None, None, None, None), (5, say(200), "en", "s", 1), (6, PASSAGE + say(50), "en", "s", 1), (7, say(90) + PASSAGE, "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    docs = common.read_table(spark, str(tmp_path), "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.write_shared(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == list(corpus_pipeline.COLUMNS)
    kept = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert {5, 6, 7} <= set(kept) and 4 not in kept and 3 not in kept and PASSAGE not in kept[6] and len(kept[6]) > 100
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == set(kept)


def test_pipeline_packs_documents_without_text(spark):
    import corpus_pipeline

    docs = spark.createDataFrame([(1, "some words", "en", "s", 10), (2, "", "en", "s", 0), (3, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r["length"] for r in corpus_pipeline.best_fit_packing(spark, docs, "").collect()}
    assert set(got) == {1, 2, 3} and got[2] == got[3] == 1 and got[1] > 1


def shingle_jaccard(a, b):
    a, b = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.split(), b.split()))
    return len(a & b) / len(a | b)


def test_near_dedup_stage_is_brute_force(spark):
    import corpus_pipeline

    base = [say(200) for _ in range(12)]
    rows = list(enumerate(base))
    for i, t in enumerate(base):
        for share in (2, 3, 4, 5, 6):
            words = t.split()
            for k in rng.sample(range(200), share):
                words[k] = "changed"
            rows.append((100 + len(rows), " ".join(words)))
    near = {a: {b for b, y in rows if shingle_jaccard(x, y) >= 0.8} for a, x in rows}
    assert sum(map(len, near.values())) > 2 * len(rows)
    want, seen = set(), set()
    for i, _ in rows:
        if i not in seen:
            want.add(i)
            todo = [i]
            while todo:
                if (k := todo.pop()) not in seen:
                    seen.add(k)
                    todo += near[k]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["doc_id"] for r in corpus_pipeline.simhash_near_dedup(spark, docs, "").collect()} == want
    assert corpus_pipeline.simhash_near_dedup(spark, docs.where("false"), "").count() == 0


def test_pipeline_keeps_one_of_repeated_and_null_id_rows(spark, tmp_path):
    import corpus_pipeline

    a, b, c, d = (say(200) for _ in range(4))
    rows = [(1, a), (1, a), (2, b), (3, b), (None, c), (None, c), (5, d), (5, a), (None, d)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    near = corpus_pipeline.simhash_near_dedup(spark, docs, "").collect()
    assert sorted(r["text"] for r in near) == sorted([a, b, c, d])
    assert {r["text"]: r["doc_id"] for r in near} == {a: 1, b: 2, c: None, d: 5}
    packed = corpus_pipeline.run(spark, str(tmp_path)).where("piece = 0").collect()
    assert sorted(str(r["doc_id"]) for r in packed) == ["1", "2", "5", "None"] and all(r["length"] > 1 for r in packed)


def test_likeness_within_three_errors(docs):
    assert cws.SAMPLES >= 64
    got = {r["doc_id"]: r for r in cws.fingerprint_with_next(docs.where("doc_id <> 4")).collect()}
    texts = {i: t or "" for i, t in enumerate(TEXTS) if i != 4}
    order = sorted(texts, reverse=True)
    for i, k in zip(order, order[1:] + order[:1]):
        t, h = texts[i], len(texts[i]) // 2
        assert len(got[i]["fingerprint"]) == cws.SAMPLES * cws.SAMPLE_BITS // 4
        if t.split():
            assert abs(got[i]["near_edited"] - jaccard(t, t[: len(t) - h] + texts[k][:h])) < 3 / (4 * cws.SAMPLES) ** 0.5
            assert abs(got[i]["near_next"] - jaccard(t, texts[k])) < 3 / (4 * cws.SAMPLES) ** 0.5


def test_only_texts_without_a_letter_are_und(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(d.where(~langid.held_out()))
    cases = [None, "", "12 ...", "_", "A.", "a", "I", "qzxj", "\u16a0", "x " * 3, "the and for"]
    for rows in (cases, ["A."], ["\u16a0"], ["..."]):
        lang, score = model.predict([x or "" for x in rows])
        for text, k, x in zip(rows, lang, score):
            has = any(c.isalpha() for c in text or "")
            assert (k == langid.UNKNOWN) == (not has) and (x > 0) == has and x <= 1
    one = spark.createDataFrame([(4616, "A.", "en", "s", 2), (1, "12", None, "s", 2)], "doc_id long, text string, lang string, source string, n_chars long")
    assert [r["doc_id"] for r in langid.keep_known(one, model).collect()] == [4616]


def test_main_text_of_split_containers_and_class_names(spark):
    body = "words of the body " * 40
    pages = [
        f"<body class=has-sidebar><article class='post tag-sports'><h1>Head</h1><p>lead</p><div class=body><p>{body}</p></div></article></body>",
        f"<body class=no-sidebar><main><div class=entry-header><h1>Head</h1></div><p>lead</p><ul>{'<li>an item of a long list' * 40}</ul></main></body>",
        f"<body><div class=menu><p>go</p></div><div class=one><p>{body}</p></div><div class=two><p>{body}</p></div><div class=cookie-banner><p>eat</p></div></body>",
    ]
    df = spark.createDataFrame([(i, f"http://h{i}/", x) for i, x in enumerate(pages)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"].split("\n") for r in html_main.extract(df).collect()}
    assert got[0] == ["Head", "lead", body.strip()]
    assert got[1] == ["Head", "lead"] + ["an item of a long list"] * 40
    assert got[2] == [body.strip()] * 2


def test_suffix_dedup_divides_groups_of_many_surroundings(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "GROUP_STRINGS", 3)
    texts = [say(20) + PASSAGE[:330] + say(30) for _ in range(12)] + [say(9) + PASSAGE + say(9) for _ in range(8)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for span in (400, 200):
        want = [(i, *d) for i, d in enumerate(suffix_dedup.brute_force(texts, span))]
        assert sum(d[2] for d in want) > 300
        assert by_id(suffix_dedup.digests(df, span=span), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want


def test_wide_fingerprints_meet_near_copies():
    found = 0
    for _ in range(60):
        words = say(260).split()
        other = list(words)
        for k in rng.sample(range(len(words)), 5):
            other[k] = "changed"
        a, b = (simhash_groups.shingles(" ".join(x)) for x in (words, other))
        assert simhash_groups.jaccard(a, b) > 0.8
        z = np.stack([simhash_groups.sums(a), simhash_groups.sums(b)])
        values, keys = simhash_groups.probes(z)
        stored = [{(s << simhash_groups.BITS) + int(v) for s, v in enumerate(row)} for row in values]
        found += bool(stored[0] & set(keys[1].tolist()) or stored[1] & set(keys[0].tolist()))
        differ = int(np.bitwise_count(values[0] ^ values[1]).sum())
        assert abs(differ / z.shape[1] - simhash_groups.distance_of(simhash_groups.jaccard(a, b))) < 0.06
    assert found >= 59


def test_one_of_a_large_group_round_an_original(spark):
    words = say(200).split()
    rows = [(0, " ".join(words), "x", 1)]
    for i in range(1, 60):
        other = list(words)
        for k in rng.sample(range(200), 3):
            other[k] = f"own{i}"
        rows.append((i, " ".join(other), "x", 1))
    rows += [(100, say(200), "y", 2), (101, None, None, None), (None, "", "z", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string, node int").withColumn("r1", F.lit(1))
    kept = simhash_groups.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 100, 101]


def test_pipeline_cuts_passages_of_little_over_fifty_words(spark):
    import corpus_pipeline

    passages = [say(n) for n in (51, 55, 60)]
    texts = [say(80) + " " + p + " " + say(70) for p in passages for _ in range(3)] + [say(150) for _ in range(4)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.suffix_array_dedup(spark, docs, "").collect()}
    for i, t in enumerate(texts):
        assert got[i] == t if i >= 9 else passages[i // 3] not in got[i] and len(got[i]) >= len(t) - len(passages[i // 3]) - 4


@pytest.mark.parametrize("places, width", [(16, 12), (20, 22)])
def test_gamma_draws(spark, places, width):
    x = spark.range(200_000).select(F.xxhash64("id").alias("x"))
    parts = x.select(*[c.alias(n) for c, n in zip(cws.coins("x", places, width), "abc")])
    got = np.sort([r[0] for r in parts.select(cws.gamma("a", "b", "c")).collect()])
    # the distribution function of Gamma(2, 1), and the bound of a test at one in 10,000
    assert np.abs(1 - np.exp(-got) * (1 + got) - (np.arange(len(got)) + 0.5) / len(got)).max() < 2.23 / len(got) ** 0.5
    v = (np.arange(4096) + 0.5) / 4096
    assert np.abs(np.polyval(cws._LOG, v) * v / -np.log1p(-v / 2) - 1).max() < 2e-6


def test_fingerprints_of_null_and_extreme_ids(spark):
    rows = [(None, "a b c d", 1), (None, "a b c e", 2), (-(1 << 63), "x y", 3), ((1 << 63) - 1, "u v w", 4), (3, None, 5)]
    got = cws.fingerprint_with_next(spark.createDataFrame(rows, "doc_id long, text string, note int")).collect()
    assert sorted((str(r["doc_id"]), r["n_chars"]) for r in got) == sorted((str(i), len(t or "")) for i, t, _ in rows)
    top = next(r for r in got if r["doc_id"] == (1 << 63) - 1)
    assert top["edited_sha256"] == hashlib.sha256(b"u v").hexdigest() and top["near_next"] == 0.0


def test_warc_files_of_many_members_are_read_and_derived(spark, tmp_path):
    out = b""
    for i in range(1000):
        body = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset={'idna' if i % 3 else 'utf-8'}\r\n\r\n<p>page {i}</p>".encode()
        kind = "request" if i % 10 == 9 else "response"
        record = f"WARC/1.0\r\nwarc-type: {kind}\r\nWarc-Record-Id: <urn:uuid:{i}>\r\nWARC-DATE: {warc.DATE}\r\ncontent-length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"
        z = zlib.compressobj(wbits=31)
        out += z.compress(record) + z.flush()
    (tmp_path / "many.warc.gz").write_bytes(out)
    rows = warc.derivatives(warc.read_warc(spark, str(tmp_path)), "record_id").collect()
    assert Counter(r["record_type"] for r in rows) == {"metadata": 900, "conversion": 900}
    assert {r["refers_to"]: r["block"] for r in rows if r["record_type"] == "conversion"} == {f"<urn:uuid:{i}>": f"page {i}" for i in range(1000) if i % 10 != 9}


def test_pages_that_never_end_are_read_once():
    import time

    began = time.time()
    for page in ("<p>kept</p>" + "<a '" * 16000, "<p>kept</p>" + '<a "' * 16001, "<p>kept</p><script>" + "<" * 60000, "<p>kept</p>" + "<!-- " * 16000):
        assert [b.text for b in html_blocks.read(page).blocks] == ["kept"]
    assert time.time() - began < 2
    assert [b.text for b in html_blocks.read('<div class="a>b" title=\'x>y\'>one<br/>two</div><div/>three').blocks] == ["one two", "three"]


def test_language_id_of_more_languages_than_a_word_has_bits(spark):
    names = [f"l{i:02d}" for i in range(70)]
    draw = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz"
    stems = {k: ["".join(draw.choice(letters) for _ in range(6)) for _ in range(12)] for k in names}
    rows = [(j, " ".join(draw.choice(stems[k]) for _ in range(30)), k) for j, k in enumerate(names * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.predict(df, langid.train(df), keep=("lang",)).collect()
    assert all(r["lang"] == r["lang_pred"] for r in got)
    assert not langid.has_letter("² ½ 7 _") and langid.has_letter("²a")


def test_vectors_of_doubles_are_compared_in_double_precision(spark):
    a, b = 1.0, (1 / 0.95**2 - 1) ** 0.5
    rows = [(0, [a, 0.0]), (1, [a, b * (1 - 1e-12)]), (2, [a, -b * (1 + 1e-12)]), (3, [0.0, -1.0])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in flat_graph.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {0: (1, 0), 1: (1, 0), 2: (0, 2), 3: (0, 3)}


@pytest.mark.parametrize("entries", [1, simhash_groups.CENTRES + 2])
def test_all_nodes_of_large_entries_are_met(spark, monkeypatch, entries):
    monkeypatch.setattr(simhash_groups, "BLOCK", 4)
    draw = np.random.default_rng(entries)
    fingerprint = lambda: draw.integers(0, 1 << simhash_groups.BITS, simhash_groups.SEGMENTS)
    one = fingerprint()
    other = one ^ 1  # near, and no segment is equal
    nodes = {1: one, 2: other}
    # strangers share segments with the first: more of them the earlier the segment, so that they are its large entries' centres
    for s in range(entries):
        for _ in range(4 + 2 * (entries - s)):
            nodes[len(nodes) + 1] = np.where(np.arange(simhash_groups.SEGMENTS) == s, one, fingerprint())
    last = entries - 1
    own = lambda x: [int(s << simhash_groups.BITS) + int(v) for s, v in enumerate(x)]
    # the second asks for large entries without standing in them; the first stands in one (the last) among strangers
    keys = {n: own(x) for n, x in nodes.items()} | {2: own(one)[:entries]}
    for s in range(last):
        nodes[1] = np.where(np.arange(simhash_groups.SEGMENTS) == s, other, nodes[1])
    keys[1] = own(fingerprint())
    rows = [(n, n, n, n, x.tolist(), keys[n]) for n, x in nodes.items()]
    marks = spark.createDataFrame(rows, "r1 long, r2 long, id long, node long, segments array<int>, keys array<int>")
    df = spark.createDataFrame([], "doc_id long, text string")
    assert by_id(simhash_groups.groups(df, marks), "node", "component") == [(1, 1), (2, 1)]


def changed(words, n, own, draw):
    """``words`` with n of them, over a shingle apart, in other words."""
    out = list(words)
    for k in draw.sample(range(5, len(words) - 5, 6), n):
        out[k] = f"{own}x{k}"
    return out


@pytest.mark.parametrize("shingles", [1 << 20, 1000])
def test_texts_round_a_large_group_meet_it_as_one(spark, monkeypatch, shingles):
    monkeypatch.setattr(simhash_groups, "BLOCK_SHINGLES", shingles)
    draw, made, write = random.Random(7), [], simhash_groups.write_shared

    def counted(df, name):
        out = write(df, name)
        made.append(out.count() if name in ("near-pairs", "near-apart", "near-crowds") else 0)
        return out

    monkeypatch.setattr(simhash_groups, "write_shared", counted)
    words = [f"w{k}" for k in range(200)]
    texts = [words, *[changed(words, 1, f"m{i}", draw) for i in range(60)]]
    # near no member, but hardly further than a near-copy
    texts += [changed(words, 5, f"f{i}", draw) for i in range(20)]
    # near one member only
    one = [*words[:2], "last", *words[3:]]
    texts += [one, changed(one, 4, "g", draw)]
    near = [[shingle_jaccard(" ".join(x), " ".join(y)) >= 0.8 for y in texts] for x in texts]
    assert [sum(x) for x in near[61:81]] == [1] * 20 and sum(near[82]) == 2
    df = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(texts)], "doc_id long, text string")
    assert {r["doc_id"] for r in simhash_groups.keep_one(df).collect()} == {0, *range(61, 81)}
    assert sum(made) < 10 * len(texts)


def test_nodes_join_crowds_as_brute_force_has_it(spark, monkeypatch):
    monkeypatch.setattr(simhash_groups, "BLOCK_SHINGLES", 2000)
    draw = random.Random(3)
    centres = [[f"a{k}" for k in range(150)]]
    centres.append(changed(centres[0], 6, "b", draw))
    crowds = [[c, *[changed(c, draw.randint(1, 3), f"{j}m{i}", draw)[: draw.randint(135, 150)] for i in range(30 - 5 * j)]] for j, c in enumerate(centres)]
    askers = [changed(draw.choice(crowds[0]), draw.randint(1, 4), f"q{i}", draw)[: draw.randint(125, 150)] for i in range(60)] + [[], ["a1"]]
    rows = [*[(x, j) for j, c in enumerate(crowds) for x in c], *[(x, None) for x in askers]]
    df = spark.createDataFrame([(i, " ".join(x)) for i, (x, _) in enumerate(rows)], "doc_id long, text string")
    marks = simhash_groups.marked(df)
    node = {r["id"]: r["node"] for r in marks.collect()}
    assert len(set(node.values())) == len(rows)
    first = {0: node[0], 1: node[len(crowds[0])]}
    units = spark.createDataFrame([(node[i], first[j], first[j], len(crowds[j])) for i, (_, j) in enumerate(rows) if j is not None], "node long, component long, unit long, n long")
    met = [(first[0], first[1], True, True), *[(node[i], first[0], False, True) for i, (_, j) in enumerate(rows) if j is None]]
    met = [(a, b, x, y) if a < b else (b, a, y, x) for a, b, x, y in met]
    pairs = spark.createDataFrame(met, "a long, b long, crowd_a boolean, crowd_b boolean")
    text = {node[i]: " ".join(x) for i, (x, _) in enumerate(rows)}
    ask = [node[i] for i, (_, j) in enumerate(rows) if j != 0]
    members = [node[i] for i, (_, j) in enumerate(rows) if j == 0]
    want = {a for a in ask if any(shingle_jaccard(text[a], text[b]) >= 0.8 for b in members)}
    got = [(r["a"], r["b"]) for r in simhash_groups._joining(df, pairs, units, marks, "text", 5, 0.8).collect()]
    assert {a for a, _ in got} == want and 10 < len(want) < len(ask) - 10
    assert all(b in members and shingle_jaccard(text[a], text[b]) >= 0.8 for a, b in got)
