"""Small cases for each corpus operator: nulls, empty and long texts, ties, repeats, empty tables, extra columns."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.llm import exact_dedup, extraction, hilbert, langid, media, mixing, neardup, packing, quality, urlfilter
from weftgraph.llm.components import connected_components
from weftgraph.llm.oddsketch import estimate, most_xor
from weftgraph.llm.registry import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, keys int, shard int"


def docs(spark, *texts, ids=None):
    rows = [(i, t, "en", f"s{k % 2}" if k % 5 else None, None, "x", 1, 2) for k, (i, t) in enumerate(zip(ids or range(len(texts)), texts, strict=True))]
    return spark.createDataFrame(rows, SCHEMA)


ODD = [None, "", "   ", "a", "A", "word " * 9000, "word " * 9000, "x\ty\nz", "ünï çödé 漢字", "1 2 3"]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text):
    w = words(text)
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute_components(rows, percent):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}, {i: len(s) for i, s in sets.items()}


def near_copies(n, seed=3, length=120):
    """A text and copies with a few changed words each: many are alike, many just aren't."""
    rng = np.random.default_rng(seed)
    base = [f"w{v}" for v in rng.integers(0, 5000, length)]
    out = []
    for _ in range(n):
        w = list(base)
        for at in rng.integers(0, length, rng.integers(0, 5)):
            w[at] = f"e{rng.integers(0, 10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("percent", [80, 85])
def test_near_dedup_equals_brute_force(spark, percent, monkeypatch):
    texts = [*ODD, *near_copies(60), *near_copies(30, 8, 40), "one two three four", "one two three four", "One TWO three  four"]
    d = docs(spark, *texts)
    want, sizes = brute_components(list(enumerate(texts)), percent)
    got = neardup.near_dedup(d, percent).collect()
    assert {r.doc_id: r.component_id for r in got} == want and {r.doc_id: r.n_shingles for r in got} == sizes
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    kept = neardup.keep_one_of_each(d, percent)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {i for i, c in want.items() if i == c}


def test_near_dedup_finishes_large_buckets_in_blocks(spark):
    """With blocks of eight, the bucket is cut up; a texts-only chain that leaders don't settle is still found."""
    texts = near_copies(50, 21, 60)
    d = docs(spark, *texts)
    rows = neardup.signatures(d)
    reps = rows.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch"))
    links = neardup.near_links(reps.select("doc_id", "keys", "sketch"), d, 85, block=8)
    roots = {r.node: r.root for r in connected_components(links).collect()}
    want, _ = brute_components(list(enumerate(texts)), 85)
    ids = {r.doc_id for r in reps.collect()}
    assert all(roots.get(i, i) == min(j for j in ids if want[j] == want[i]) for i in ids)


def test_near_dedup_of_nothing_repeats_and_null_ids(spark):
    assert neardup.near_dedup(docs(spark)).count() == 0
    got = neardup.near_dedup(docs(spark, "a b c", "a b c", "z", "z", ids=[5, 5, None, 7])).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in got if r.doc_id == 5) == [(5, 5, True)] * 2


def test_odd_sketch_estimates_and_never_drops_links():
    assert abs(estimate(np.array([0]))[0] - 1) < 1e-9 and most_xor(0.85) < most_xor(0.8) < 128


def test_components_of_chain_star_and_loop(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 140)] + [(7, 7), (None, 3)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 140), 100)}


def brute_exact(texts):
    groups = defaultdict(list)
    norm = {i: re.sub("[A-Z]", lambda m: m[0].lower(), t or "") for i, t in enumerate(texts)}
    for i, t in norm.items():
        groups[t].append(i)
    return {i: (max(groups[t]), len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in norm.items()}


@pytest.mark.parametrize("digest", [exact_dedup.sha256_digest, lambda t: F.length(t)])
def test_exact_dedup_even_with_a_digest_that_collides(spark, digest):
    texts = [*ODD, "a", "b", "B", "Ä", "ä", "c"]
    got = exact_dedup.exact_dedup(docs(spark, *texts).repartition(5), digest=digest, files_per_trigger=1).collect()
    assert {r.doc_id: (r.keep_id, r.group_size, r.text_sha256) for r in got} == brute_exact(texts)
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)


def test_exact_dedup_keeps_one_row_with_all_columns(spark):
    d = docs(spark, "a", "A", "b", "b", ids=[1, 2, 3, 3])
    kept = exact_dedup.keep_one(d)
    assert kept.columns == d.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3]
    assert exact_dedup.keep_one(docs(spark)).count() == 0


def test_packing_places_every_token_once(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    texts = [*ODD, "Don't stop-it, 12.5% é́", *["same text"] * 40, "long " * 500]
    rows = packing.packed_documents(docs(spark, *texts), tokenizer_path(), 64).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append((r.offset, r.length))
    for i, t in enumerate(texts):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for r in by_doc[i]:
            assert r.start == 64 * r.piece and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
        assert sum(r.length for r in by_doc[i]) == len(ids)
    for places in by_seq.values():
        places.sort()
        assert places[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(places, places[1:], strict=False)) and sum(places[-1]) <= 64
    assert len(by_seq) <= -(-sum(r.length for r in rows) // 64) + 1
    assert packing.packed_documents(docs(spark), tokenizer_path()).count() == 0


def test_packing_gives_the_sequences_themselves(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    texts = [*ODD, *["same text"] * 20]
    packed = packing.packed_documents(docs(spark, *texts), tokenizer_path(), 64)
    whole = {r.sequence_id: np.frombuffer(r.ids, "<u4") for r in packing.sequences(packed).collect()}
    assert all(0 < len(ids) <= 64 for ids in whole.values())
    got = defaultdict(list)
    for r in sorted(packed.collect(), key=lambda r: (r.doc_id, r.piece)):
        got[r.doc_id] += whole[r.sequence_id][r.offset : r.offset + r.length].tolist()
    assert got == {i: [*tok.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}


def test_best_fit_plan_equals_best_fit_decreasing():
    rng = np.random.default_rng(4)
    for _ in range(30):
        sizes = sorted(rng.integers(1, 40, rng.integers(1, 200)).tolist(), reverse=True)
        bins: list[int] = []
        for s in sizes:
            fit = [b for b in bins if b >= s]
            if fit:
                bins[bins.index(min(fit))] -= s
            else:
                bins.append(40 - s)
        plan = packing.best_fit_plan(Counter(sizes), 40)
        used = {q for _, _, _, first, n, _ in plan for q in range(first, first + n)}
        assert len(used) == len(bins)


def test_mixing_is_repeatable_and_meets_weights(spark):
    d = docs(spark, *[f"text {i}" for i in range(600)], None, "")
    a = sorted((r.doc_id, r.copy) for r in mixing.poisson_mix(d, {"s0": 3.0, "s1": 1.0, None: 1.0}).collect())
    assert a == sorted((r.doc_id, r.copy) for r in mixing.poisson_mix(d.repartition(3), {"s0": 3.0, "s1": 1.0, None: 1.0}).collect())
    shares = {r.source: r.n for r in mixing.poisson_mix(d, {"s0": 3.0, "s1": 1.0, None: 1.0}).groupBy("source").agg(F.sum(F.octet_length("text")).alias("n")).collect()}
    assert 2.2 < shares["s0"] / shares["s1"] < 4.0
    assert mixing.poisson_mix(docs(spark)).count() == 0 and mixing.poisson_mix(d).columns[:8] == d.columns


def test_mixing_repeats_a_tiny_source_as_often_as_its_weight_asks(spark):
    d = spark.createDataFrame([(1, "x", None), (2, "y", None), (3, "z" * 19_992, "big")], "doc_id long, text string, source string")
    # 19,997 bytes in total, 4 of them without a source: a rate of 2499.6, in four parts
    counts = {r.doc_id: r["count"] for r in mixing.poisson_mix(d).groupBy("doc_id").count().collect()}
    assert all(abs(counts[i] - 2499.6) < 6 * 2499.6**0.5 for i in (1, 2)) and counts[1] != counts[2]
    copies = [r.copy for r in mixing.poisson_mix(d.repartition(3)).where("doc_id = 1").collect()]
    assert sorted(copies) == list(range(counts[1]))
    many = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.lit(None).cast("string").alias("source"))
    got = mixing.poisson_mix(many.union(spark.createDataFrame([(-1, "z" * 1_600_000, "big")], "doc_id long, text string, source string")))
    n = [r["count"] for r in got.where("source is null").groupBy("doc_id").count().collect()]
    rate = (1_600_001 + 800) / 2 / 800
    assert len(n) == 400 and abs(np.mean(n) - rate) < 5 * (rate / 400) ** 0.5 and 0.75 < np.var(n) / rate < 1.3


def test_hilbert_neighbours_touch_and_shards_are_even(spark):
    grid = spark.range(4096).select(F.col("id"), *[F.shiftright("id", 4 * k).bitwiseAND(F.lit(15).cast("long")).alias(f"c{k}") for k in range(3)])
    cells = [tuple(r) for r in grid.select("c0", "c1", "c2", hilbert.hilbert_index([F.col("c0"), F.col("c1"), F.col("c2")]).alias("h")).orderBy("h").collect()]
    assert [c[3] for c in cells] == list(range(4096))
    assert all(sum(abs(x - y) for x, y in zip(a[:3], b[:3], strict=True)) == 1 for a, b in zip(cells, cells[1:], strict=False))
    texts = [*ODD, *["same"] * 50]
    got = hilbert.hilbert_shards(docs(spark, *texts)).collect()
    count = Counter(r.shard for r in got)
    assert max(count.values()) - min(count.values()) <= 1 and set(count) == set(range(16))
    for s in count:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(count[s]))
    assert all(r.size == len((texts[r.doc_id] or "").encode()) + 1 and r.text_crc32 == zlib.crc32((texts[r.doc_id] or "").encode()) for r in got)
    assert hilbert.hilbert_shards(docs(spark)).count() == 0


def test_hilbert_shards_hold_the_rows_and_are_written_with_bounds(spark, tmp_path):
    import pyarrow.parquet as pq

    d = docs(spark, *[f"text {'x' * (i % 40)}" for i in range(400)])
    hilbert.write_shards(d, str(tmp_path / "out"), 8, 16)
    got = spark.read.parquet(str(tmp_path / "out"))
    kept = ["doc_id", "text", "lang", "source", "n_chars", "digest", "keys"]
    assert sorted(map(str, got.select(*kept).collect())) == sorted(map(str, d.select(*kept).collect())) and got.groupBy("shard").count().count() == 8
    spans = defaultdict(list)
    for f in (tmp_path / "out").rglob("*.parquet"):
        meta = pq.read_metadata(f)
        stats = {meta.row_group(0).column(k).path_in_schema: meta.row_group(0).column(k).statistics for k in range(meta.num_columns)}
        assert stats["size"].has_min_max
        spans[f.parent.name].append((stats["slot"].min, stats["slot"].max))
    for own in spans.values():
        own.sort()
        assert all(a[1] < b[0] for a, b in zip(own, own[1:], strict=False))


def test_media_round_trip(spark):
    texts = [*ODD, "\xff" * 600, "q" * 576]
    rows = media.media_digests(media.encode_documents(docs(spark, *texts))).collect()
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        payload = media.payload_of(raw)
        assert r.n_bytes == len(raw) and r.payload_bytes == len(payload) and len(payload) % 576 == 0
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-32:])
    assert media.clip_rows(media.encode_documents(docs(spark, *texts))).groupBy("doc_id").count().count() == len(texts)
    assert media.media_digests(media.encode_documents(docs(spark))).count() == 0


def test_shots_find_a_planted_cut():
    film = np.concatenate([np.full((20, 24, 24), 30, np.uint8), np.full((15, 24, 24), 200, np.uint8)])
    assert [c[:2] for c in media.shots(film, 25.0)] == [(0, 19), (20, 34)]


PAGE = """<html><head><title>T</title><script>var a="</p>"</script></head><body><nav><a href=x>menu</a></nav><div class="ad big">buy</div>
<article><h1>Head &amp; line</h1><p><b>One  two<br><p>three &copy</article><div>Shared footer text</div><footer>&copy; me</footer>"""


def test_extraction_keeps_the_article(spark):
    assert extraction.read_page(PAGE)[0] == ["Head & line", "One two", "three ©"]
    assert extraction.read_page("")[0] == [] and extraction.read_page("plain & text <b")[0] == ["plain & text"]
    assert extraction.read_page("<ul><li>a<li>b</ul><p>c<div class=comments>d</div>e")[0] == ["a", "b", "c", "e"]


def test_extraction_drops_what_a_site_repeats(spark):
    rows = [(i, f"http://h/{i}", f"<body><div><p>own text {i}</p></div><div><p>same on all</p></div></body>") for i in range(20)] + [(99, None, None), (98, "x", "")]
    got = {r.page_id: r.text for r in extraction.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {**{i: f"own text {i}" for i in range(20)}, 99: "", 98: ""}
    assert extraction.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def extracted(spark, htmls):
    rows = [(i, f"http://h/{i}", h) for i, h in enumerate(htmls)]
    got = extraction.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    return [r.text for r in sorted(got, key=lambda r: r.page_id)]


def test_extraction_counts_decide_inside_articles_and_beside_teasers(spark):
    shared = "<p>a passage that a third of the pages share</p>"
    htmls = [f"<body><article><h1>the head of page {i}</h1><p>long own text of page number {i}</p>{shared if i % 3 == 0 else ''}<div><p>share this page now</p></div></article></body>" for i in range(30)]
    passage = "\na passage that a third of the pages share"
    assert extracted(spark, htmls) == [f"the head of page {i}\nlong own text of page number {i}{passage if i % 3 == 0 else ''}" for i in range(30)]
    # main text in a div beside article teasers, on a host with and without enough pages to count
    for n in (30, 1):
        got = extracted(spark, [f"<body><div><p>the main text of page {i}</p></div><article>teaser {i} a</article><article>teaser {i} b</article></body>" for i in range(n)])
        assert got == [f"the main text of page {i}\nteaser {i} a\nteaser {i} b" for i in range(n)]


def test_extraction_keeps_copies_and_finds_template_on_small_hosts_and_inline(spark):
    notice = "<div><p>this notice is on all</p></div>"
    texts = [f"main text of the page {0 if i < 20 else i}" for i in range(40)]
    assert extracted(spark, [f"<body><div><p>{t}</p></div>{notice}</body>" for t in texts]) == texts
    few = [f"main text of the page {i}" for i in range(4)]
    assert extracted(spark, [f"<body><div><p>{t}</p></div>{notice}</body>" for t in few]) == few
    many = [f"main text of the page {i}" for i in range(20)]
    inline = [f"<body><div><p>{t} <b>page</b> it is</p></div><a>Home</a> <span>Log in</span><a>{k}</a></body>" for k, t in enumerate(many)]
    assert extracted(spark, inline) == [f"{t} page it is\n{k}" for k, t in enumerate(many)]


def test_url_rules_and_redirects(spark):
    link = '<link rel="canonical" href="{}">'
    rows = [
        (1, "http://a.com/en/1", None), (2, "http://EXAMPLE.com/en/7x?q#f", ""), (3, "http://x.net/de/1", ""), (4, "http://b.example.net/de/8", ""), (5, "http://org/es/", ""),
        (6, "http://xcom/en/", ""), (7, None, ""), (8, "no scheme", ""), (9, "https://free.net/x", link.format("http://bad.org/es/1")), (10, "https://other.net/y", link.format("https://free.net/x")),
        (11, "https://ok.net/z", '<meta http-equiv="refresh" content="0; url=http://bad.com/en/2">'), (12, "https://ok.net/w", link.format("/z")), (13, "http://up.net/de/3", link.format("https://ok.net/z")),
    ]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == ("a.com", "/en/1", "com/en/", "block") and got[2] == ("example.com", "/en/7x", "example.com/en/7", "allow")
    assert got[3][2:] == ("net/de/", "allow") and got[4][2:] == ("example.net/de/8", "block") and got[5][2:] == ("org/es/", "block")
    assert got[6][2:] == (None, "allow") and got[7] == ("", "", None, "allow") and got[8] == ("", "", None, "allow")
    assert got[9][3] == got[10][3] == "block"
    assert got[11][3] == got[12][3] == "allow" and got[13][3] == "allow"  # an allowed member takes precedence
    assert urlfilter.judge_urls(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_language_and_quality_on_odd_rows(spark):
    d = docs(spark, *ODD)
    got = {r.doc_id: r for r in langid.identify_documents(d).collect()}
    assert [i for i in got if got[i].lang_pred == "und"] == [0, 1, 2, 9] and all(0 <= r.score <= 1 for r in got.values())
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(10)], "doc_id long, quality int, toxic int")
    got = quality.score_quality(d, labels).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert all(r.score == 0.5 for r in quality.score_quality(d, labels.where("false")).collect())
    assert langid.identify_documents(docs(spark)).count() == 0 and quality.score_quality(docs(spark), labels).count() == 0


def test_language_stage_rests_on_language_and_score_and_keeps_letters_without_a_model(spark):
    d = docs(spark, *ODD)
    kept = langid.keep_identified(d.withColumn("lang", F.lit(None).cast("string")))
    assert kept.columns == d.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 6, 7, 8]
    texts = [("the cat and the dog went to the house", "en"), ("le chat et le chien sont dans la maison", "fr")] * 10
    d = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(texts)], "doc_id long, text string, lang string")
    assert langid.keep_identified(d).count() == 20 and langid.keep_identified(d, min_score=1.01).count() == 0
    assert {r.lang for r in langid.keep_identified(d, ["fr"]).collect()} == {"fr"}
    own = langid.keep_identified(d.withColumn("score", F.lit(7)))
    assert own.columns == ["doc_id", "text", "lang", "score"] and {r.score for r in own.collect()} == {7}


def test_held_out_accuracy(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    r = langid.identify_documents(d).join(d.select("doc_id", "lang"), "doc_id").where("held_out").agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()[0]
    assert r > 0.97
    q = quality.score_quality(d, labels).join(labels, "doc_id").where("held_out").agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0]
    assert q > 0.95


def test_pipeline_stages_keep_columns(spark):
    import corpus_pipeline

    d = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(["", "1 2", "hello there my good old friend", "Hello there my good old friend", "something else is here now ok", None])], "doc_id long, text string, lang string, source string, n_chars long")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "exact_dedup", "near_dedup", "source_mixing", "best_fit_packing"]
    kept = []
    for _, stage in corpus_pipeline.STAGES[:3]:
        d = stage(spark, d, "")
        assert d.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept.append(sorted(r.doc_id for r in d.collect()))
    assert kept == [[2, 3, 4], [3, 4], [3, 4]]
