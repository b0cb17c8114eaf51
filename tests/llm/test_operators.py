"""The ten operators and the pipeline against brute force on small tables with odd rows."""

import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from factloom.llm import classifier, exact_dedup, graph, licenses, mixing, packing, quality_rules, simhash, token_counts, token_output, tokens, url_filters
from factloom.llm.license_full_texts import FULL_TEXTS
from factloom.llm.license_texts import LICENSE_TEXTS
from factloom.session import ship_package

BYTE, WORD = (tokens.vocabulary_path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
DOCS = "doc_id long, text string, lang string, source string, n_chars long, digest string, bucket int, kept boolean, key long, salt int"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(300)]

    def prose(n):
        return " ".join(rng.choice(words) for _ in range(n)) + "."

    base = [prose(rng.randint(55, 400)) for _ in range(60)]
    out = list(base)
    out += [base[0], base[0].upper(), base[1].title(), base[0]]
    for k in range(12):  # near copies of one long text
        w = base[2].split() * 6
        w[5 + 9 * k] = "changed"
        out.append(" ".join(w))
    out += ["", None, " ", "\n\t", "İß ümlaut ÀÉ $$$ ###", "tok tok tok tok " * 60, "one\none\ntwo\none\n", "x" * 3000, "<|endoftext|> mid <|endoftext|>", "a  b\u00a0c\n\n d\t"]
    out += [prose(9000), " ".join(f"w{k}" for k in range(2500))]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    """Documents with nulls, ties, repeated rows and columns whose names clash with the operators' own."""
    ship_package(spark)
    rows = [(k * 3, t, ["en", "de", None][k % 3], f"s{k % 4}" if k % 7 else None, len(t or ""), "d", 1, False, 5, 2) for k, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, texts[5], "en", "s0", 1, None, None, None, None, None), (None, "no id here", None, None, None, None, None, None, None, None), (-5, texts[0], "en", "s1", 1, "d", 1, True, 1, 1)]
    return spark.createDataFrame(rows, DOCS).repartition(5).persist()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_encoder_equals_the_library(path, texts):
    rng = random.Random(1)
    signs = [" ", "\n", "a", "'s", "é", "\u0301", "1", "$", "Σ", "\t", "<|endoftext|>", "B", ".", "。", "\u00a0", "\u3000", "한", "##", "ü", "İ", "K", "ab"]
    enc = tokens.Encoder(path)
    for text in [t or "" for t in texts] + ["".join(rng.choice(signs) for _ in range(rng.randint(0, 12))) for _ in range(6000)]:
        assert enc.encode(text) == enc.whole(text), repr(text)
    many = [None, *texts, *("".join(rng.choice(signs) for _ in range(rng.randint(0, 12))) for _ in range(6000))]
    for end in (None, 2):
        at, tail = 0, b"" if end is None else np.array([end], enc.dtype).tobytes()
        for ids, offsets in enc.encode_column(pa.array(many), end):
            for low, high in zip(offsets, offsets[1:]):
                assert ids[low:high].tobytes() == enc.whole(many[at] or "") + tail, repr(many[at])
                at += 1
        assert at == len(many)
    plain = [t for t in many if t and "  " not in t]
    lean = tokens.Encoder(path, lean=True)
    for e in (enc, lean):
        counts = np.concatenate([np.diff(o) for _, o in e.encode_column(pa.array(plain), counts_only=True)])
        assert counts.tolist() == [len(enc.whole(t)) // enc.dtype.itemsize for t in plain]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_counting_keeps_no_ids(path):
    enc = tokens.Encoder(path)
    some = ["plain words, and more words.", "two  spaces\tand a tab", "", "line\nline Words", "\u3000odd\u3000", "x" * 90]
    for end in (None, 2):
        for counting in (True, False, True):  # a change of use forgets the other's words
            offsets = np.concatenate([o for _, o in enc.encode_column(pa.array(some), end, counting)])
            assert np.diff(offsets).tolist() == [len(enc._tokenizer.encode(t, add_special_tokens=False).ids) + (end is not None) for t in some]
            kept = [v for words in (enc._bare, enc._led, *enc._sizes) for v in words.values()]
            assert kept and all(isinstance(v, int) == counting for v in kept)


def test_token_output_round_trip(spark, docs, empty):
    dataset = token_output.write_tokens(docs, BYTE, 2)
    got = dataset.documents(spark).orderBy("position").collect()
    enc = tokens.Encoder(BYTE)
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()
    rows.sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.h))
    start = 0
    for position, (r, g) in enumerate(zip(rows, got, strict=True)):
        ids = np.append(np.frombuffer(enc.whole(r.text or ""), enc.dtype), 2).astype("<u4")
        assert (g.doc_id, g.start, g.n_tokens, g.ids_crc32, g.position) == (r.doc_id, start, len(ids), zlib.crc32(ids.tobytes()), position)
        start += len(ids)
    assert (dataset.document(10) == np.append(np.frombuffer(enc.whole(rows[10].text or ""), enc.dtype), 2)).all()
    assert isinstance(dataset.open(dataset.shards[0])[0], np.ndarray) and dataset.dtype == "<u2"
    assert token_output.write_tokens(empty, BYTE, 2).documents(spark).count() == 0


def brute_rules(text):
    raw = (text or "").encode()
    words = [w for w in __import__("re").split(rb"[\x20\x09-\x0D]+", raw) if w]
    lines, seen, dup = raw.split(b"\n"), set(), 0
    for line in lines:
        if line.strip():
            dup += line in seen
            seen.add(line)
    windows = defaultdict(list)
    for k in range(len(words) - 2):
        windows[tuple(words[k : k + 3])].append(k)
    covered = {p for at in windows.values() if len(at) > 1 for k in at for p in (k, k + 1, k + 2)}
    return len(words), sum(len(w.decode()) for w in words), sum(raw.count(bytes([c])) for c in b"#*$%&|<>"), dup, len(covered)


def test_quality_rules_test_the_end_of_a_text():
    import zstandard

    rng = random.Random(13)
    prose = " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(2000))
    compressor, bands = zstandard.ZstdCompressor(level=3, write_content_size=False, write_checksum=False), quality_rules.Bands()
    assert quality_rules.compression_verdict(prose[:8100].encode(), compressor, bands)[::2] == (True, 2)
    junk = " ".join(w + rng.choice(["######", "$$$$$$", "%%%%%%", "&&&&&&", "******"]) for w in prose.split())  # no window of three words repeats, so the base rule keeps it
    assert not quality_rules.compression_verdict(junk[:3000].encode(), compressor, bands)[0]
    good, ratio, chunks, bad = quality_rules.compression_verdict((prose[:5000] + ("the same phrase once more " * 200)[:3000]).encode(), compressor, bands)
    assert not good and (chunks, bad) == (2, 1)
    assert quality_rules.compression_verdict(prose[:8192].encode(), compressor, bands)[2] == 2
    assert quality_rules.compression_verdict(prose[:4095].encode(), compressor, bands)[2] == 0


def test_quality_rules(spark, docs, empty, texts):
    import zstandard

    got = quality_rules.judge(docs).collect()
    text_of = {r.doc_id: r.text for r in docs.collect() if r.doc_id is not None}
    assert len(got) == docs.count()
    for g in got:
        if g.doc_id is not None:
            want = brute_rules(text_of[g.doc_id])
            assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == want
            assert g.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
            assert not (g.base_failed and g.kept)
    assert quality_rules.keep_clean(docs).count() == sum(g.kept for g in got)
    assert quality_rules.keep_clean(docs).columns == docs.columns
    compressor, bands = zstandard.ZstdCompressor(level=3, write_content_size=False, write_checksum=False), quality_rules.Bands()
    assert not quality_rules.compression_verdict(os.urandom(5000), compressor, bands)[0]
    assert not quality_rules.compression_verdict(b"word " * 2000, compressor, bands)[0]
    half = (" ".join(texts[:12])[:8192] + "again and again " * 900).encode()
    assert not quality_rules.compression_verdict(half, compressor, bands)[0]
    assert quality_rules.judge(empty).count() == 0 and quality_rules.keep_clean(empty).count() == 0


def test_token_counts(spark, docs, empty):
    enc = tokens.Encoder(BYTE)
    lengths = [len(enc.whole(r.text or "")) // 2 + 1 for r in docs.collect()]
    histogram = token_counts.length_histogram(docs, BYTE).persist()
    assert {r.n_tokens: r.n_docs for r in histogram.collect()} == Counter(lengths)
    for r in token_counts.suffix_sums(histogram).collect():
        longer = [x for x in lengths if x >= r.n_tokens]
        assert (r.docs_from, r.tokens_from, r.docs_total, r.tokens_total) == (len(longer), sum(longer), len(lengths), sum(lengths))
        assert r.truncated_total == sum(min(x, r.n_tokens) for x in lengths) and r.rank_from == len(lengths) - len(longer)
    cut = token_counts.truncated_totals(histogram, [1, 100, 2048, 1 << 40, max(lengths)]).collect()
    assert len(cut) == 5
    for r in cut:
        assert (r.kept_tokens, r.cut_docs) == (sum(min(x, r.context_limit) for x in lengths), sum(x > r.context_limit for x in lengths))
    assert token_counts.quantile(token_counts.suffix_sums(histogram), 0.5).first().n_tokens == sorted(lengths)[-(-len(lengths) // 2) - 1]
    flat = token_counts.suffix_sums(spark.createDataFrame([(k, 1) for k in range(1, 101)], "n_tokens long, n_docs long")).persist()
    for share in range(0, 101):  # of 100 documents of lengths 1 to 100
        assert token_counts.quantile(flat, share / 100).first().n_tokens == max(1, share)
    assert token_counts.suffix_sums(token_counts.length_histogram(empty, BYTE)).count() == 0
    assert token_counts.truncated_totals(token_counts.length_histogram(empty, BYTE), [5]).first().kept_tokens == 0


PAGES = "page_id long, url string, html string, host string, salt int, verdict string"


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], PAGES)


def brute_pagerank(edges, seeds, damping, tolerance=0.02):
    out = defaultdict(dict)
    for a, b, w in edges:
        out[a][b] = out[a].get(b, 0) + w
    moving = {s: 1 / len(seeds) for s in seeds}
    total = defaultdict(float)
    while True:
        for h, m in moving.items():
            total[h] += m
        if sum(moving.values()) <= tolerance:
            break
        following = defaultdict(float)
        for h, m in moving.items():
            for t, w in out.get(h, {}).items():
                following[t] += damping * m * w / sum(out[h].values())
        moving = following
    whole = sum(total.values())
    return defaultdict(float, {h: m / whole for h, m in total.items()})


def test_token_counts_are_lean(monkeypatch):
    asked = []
    monkeypatch.setattr(token_counts, "encoder", lambda path, lean=False: asked.append(lean) or tokens.Encoder(path, lean))
    batch = pa.RecordBatch.from_arrays([pa.array(["one two", None, "one two"])], names=["text"])
    (got,) = token_counts._counter(BYTE, 1)(iter([batch]))
    assert sorted(got.column("n_docs").to_pylist()) == [1, 2] and asked == [True]


def test_url_rules_and_hosts(spark):
    rows = [
        (1, "HTTP://A.Net/x?y#z", None),
        (2, "http://example.net/en/a", ""),
        (3, "http://m.Example.NET/de", "x"),
        (4, "https://shop.example.com/de/1?q", None),
        (5, "https://example.com/en", None),
        (6, "http://x.org/fr/", None),
        (7, "no scheme here", None),
        (8, None, None),
        (9, "http://net", None),
        (10, "http://notexample.com/de/", None),
        (11, "a://b://c/d", None),
        (12, "http://org?u://v/fr/", None),
        (12, "http://org?u://v/fr/", None),
    ]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.judge(pages_of(spark, rows)).collect()}
    assert got[1] == ("a.net", "/x", "net/", "block") and got[2] == ("example.net", "/en/a", "example.net/en/", "allow")
    assert got[3] == ("m.example.net", "/de", "net/", "block") and got[4] == ("shop.example.com", "/de/1", "example.com/de/", "block")
    assert got[5] == ("example.com", "/en", None, "allow") and got[6] == ("x.org", "/fr/", "org/fr/", "allow")
    assert got[7] == ("", "", None, "allow") and got[8] == ("", "", None, "allow") and got[9] == ("net", "", None, "allow")
    assert got[10][2] is None and got[11][0] == "b:" and got[12] == ("org", "", None, "allow")
    assert url_filters.judge(pages_of(spark, [])).count() == 0


def test_url_graph_against_brute_pagerank(spark):
    rng = random.Random(3)
    hosts = [f"h{k}.com" for k in range(12)] + ["bad.net", "worse.net", "ok.org"]
    rows, edges = [], Counter()
    for k in range(120):
        source = rng.choice(hosts)
        targets = set(rng.sample(hosts, rng.randint(0, 3)))
        html = "".join(f'<a href="{rng.choice(["http:", "https:", ""])}//{t.upper() if k % 2 else t}/p">t</a>' for t in targets) + '<a href="/local">l</a>'
        rows.append((k, f"http://{source}/{'fr/' if source == 'ok.org' else 'p'}", html))
        for t in targets - {source}:
            edges[source, t] += 1
    pages = pages_of(spark, rows)
    assert {(r.source, r.target): r.weight for r in url_filters.host_edges(pages).collect()} == edges
    present = {r[1].split("/")[2] for r in rows}
    flat = [(a, b, w) for (a, b), w in edges.items()]
    trust = brute_pagerank(flat, [h for h in ["ok.org"] if h in present], 0.85)
    distrust = brute_pagerank([(b, a, w) for a, b, w in flat], [h for h in ("bad.net", "worse.net") if h in present], 0.85)
    for r in url_filters.host_scores(pages).collect():
        assert abs(r.trust / url_filters.MASS - trust[r.host]) < 1e-6 and abs(r.distrust / url_filters.MASS - distrust[r.host]) < 1e-6
    suspect = {h for h in hosts if distrust[h] > trust[h] and distrust[h] > 0.5 / len(present)}
    for r in url_filters.judge(pages).collect():
        assert r.by_graph == (r.rule is None and r.host in suspect)
    assert suspect - {"bad.net", "worse.net"}


def brute_fingerprint(text, width):
    words = (text or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))).split()
    shingles = [b" ".join(words[k : k + width]) for k in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values, max_bits):
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    ordered = sorted(values)
    for i, a in enumerate(ordered):
        for b in ordered[:i]:
            if (a ^ b).bit_count() <= max_bits:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {v: find(v) for v in ordered}


@pytest.mark.parametrize("long_list", [simhash.LONG_LIST, 3])
def test_simhash_groups(spark, docs, empty, long_list):
    got = simhash.near_groups(docs, 4, 4, long_list).collect()
    rows = docs.select("doc_id", "text").collect()
    prints = {r.doc_id: brute_fingerprint(r.text, 4) for r in rows if r.doc_id is not None}
    roots = brute_components({brute_fingerprint(r.text, 4) for r in rows}, 4)
    low = {}
    for d, p in prints.items():
        low[roots[p]] = min(d, low.get(roots[p], d))
    assert len(got) == len(rows)
    for g in got:
        if g.doc_id is not None:
            assert g.fingerprint == f"{prints[g.doc_id]:016x}" and g.component_id == low[roots[prints[g.doc_id]]]
    assert max(Counter(g.component_id for g in got).values()) > 8
    assert simhash.near_groups(empty).count() == 0


@pytest.mark.parametrize("long_list", [simhash.LONG_LIST, 4])
def test_simhash_links_lose_nothing(spark, long_list):
    from itertools import combinations

    for size in range(8):  # every pair that shares the guaranteed minimum shares a choice of index positions
        for apart in combinations(range(8), size):
            assert any(not set(chosen) & set(apart) for chosen in simhash._choices(size))
    rng = random.Random(5)
    values = {rng.getrandbits(64) for _ in range(150)}
    for v in list(values)[:40]:  # chains and clouds at the very limit, spread over four bytes
        for _ in range(6):
            v ^= sum(1 << (8 * byte + rng.randrange(8)) for byte in rng.sample(range(8), 4))
            values.add(v)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    edges = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), 4, long_list)
    roots = {r.node: r.root for r in graph.components(edges).collect()}
    want = brute_components(values, 4)
    groups, found = defaultdict(set), defaultdict(set)
    for v, s in zip(values, signed):
        groups[want[v]].add(v)
        found[roots.get(s, s)].add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, found.values()))


def test_components_of_paths_and_stars(spark):
    edges = [(k, k + 1) for k in range(100, 180)] + [(7, k) for k in range(1000, 1040)] + [(5, 5)]
    roots = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(roots[k] == 100 for k in range(100, 181)) and all(roots[k] == 7 for k in range(1000, 1040)) and 5 not in roots


def test_similar_groups(spark, docs, empty):
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(500)]
    rows, family = [], {}
    for f in range(30):
        base = [rng.choice(vocabulary) for _ in range(400)]
        for k in range(rng.choice([1, 2, 5, 90 if f == 3 else 3])):
            words = list(base)
            for _ in range(2):  # two of 400 words: at least 0.95 of all windows stay
                words[rng.randrange(400)] = rng.choice(vocabulary)
            family[len(rows)] = f
            rows.append((len(rows), " ".join(words)))
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    first = {}
    for d, f in family.items():
        first[f] = min(d, first.get(f, d))
    assert got == {d: first[f] for d, f in family.items()}
    odd = simhash.similar_groups(docs).collect()
    assert len(odd) == docs.count() and simhash.similar_groups(empty).count() == 0


def test_similar_groups_against_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(150):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice((60, 150, 400)))]
        for _ in range(3):
            words = list(base)
            for _ in range(rng.randint(0, len(base) // 30)):  # similarities of 0.6 to 1
                words[rng.randrange(len(words))] = f"w{rng.randrange(3000)}"
            rows.append((len(rows), " ".join(words)))
    line = [f"s{k}" for k in range(70)]
    rows += [(len(rows) + k, " ".join([*line, *(f"w{rng.randrange(3000)}" for _ in range(rng.randint(5, 60)))])) for k in range(60)]  # share one passage
    rows += [(len(rows) + k, x) for k, x in enumerate(("", None, " ", "one two", "One  two", "one two three"))]
    sets = [{" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for w in ((t or "").lower().split() for _, t in rows)]
    root = list(range(len(rows)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    pairs = {}
    for a in range(len(rows)):
        for b in range(a):
            shared = len(sets[a] & sets[b])
            union = len(sets[a]) + len(sets[b]) - shared
            if 10 * shared >= 7 * union:
                pairs[b, a] = shared / union if union else 1.0
            if 10 * shared >= 8 * union:
                x, y = sorted((top(a), top(b)))
                root[y] = x
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for low, high in ((0.8, 0.85), (0.85, 0.95), (0.95, 1.01)):  # recall by band, of links
        band = [p for p, s in pairs.items() if low <= s < high]
        assert len(band) > 25 and sum(got[a] == got[b] for a, b in band) >= 0.9 * len(band)
    assert any(0.75 <= s < 0.8 and top(a) != top(b) for (a, b), s in pairs.items())
    assert all(top(k) == top(got[k]) for k in got)  # no link that isn't there


def test_a_group_of_near_copies_makes_no_pairs(spark):
    import numpy as np
    import pyarrow as pa

    rng, index = random.Random(3), simhash.Index()
    base = [f"w{rng.randrange(5000)}" for _ in range(300)]
    rows = []
    for k in range(120):  # similarities of 0.6 to 1 between any two, so many candidates aren't links
        words = list(base)
        for _ in range(rng.randint(0, 9)):
            words[rng.randrange(300)] = f"x{rng.randrange(5000)}"
        rows.append((k, " ".join(words)))
    hashes = [np.unique(simhash.shingle_hashes(t.encode(), 5)) for _, t in rows]
    words = np.array([simhash.wide_fingerprint(simhash.shingle_hashes(t.encode(), 5), 4) for _, t in rows]).view(np.int64)
    words[:, 0] = words[0, 0]  # all meet in the list of the first two bytes
    key = int(words[0, :1].view(np.uint8)[0]) << 8 | int(words[0, :1].view(np.uint8)[1])
    columns = [np.full(120, key), np.arange(120), np.array([len(h) for h in hashes]), *words.T]
    names = ["key", "node", "n", "w0", "w1", "w2", "w3"]
    batch = pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=names)
    edges = [tuple(e.values()) for b in simhash._candidates(index, 0.8)(iter([batch])) for e in b.to_pylist()]
    assert 60 < len(edges) < 120 and all(a < b for a, b in edges)

    frame = spark.createDataFrame(rows, "doc_id long, text string")
    root = list(range(len(rows)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    links = [(a, b) for b in range(len(rows)) for a in range(b) if 10 * len(np.intersect1d(hashes[a], hashes[b])) >= 8 * len(np.union1d(hashes[a], hashes[b]))]
    assert 100 < len(links) < 120 * 119 // 2 - 100
    for a, b in links:
        x, y = sorted((top(a), top(b)))
        root[y] = x
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(frame, members=16).collect()}  # many tiles
    assert sum(got[k] == top(k) for k in got) >= 0.97 * len(got) and all(top(k) == top(got[k]) for k in got)


def test_components_get_fewer_edges_than_nodes(spark, monkeypatch):
    rng = random.Random(8)
    base = [f"w{rng.randrange(5000)}" for _ in range(300)]
    rows = []
    for k in range(200):  # near copies, which meet in many lists
        words = list(base)
        for _ in range(rng.randint(0, 9)):
            words[rng.randrange(300)] = f"x{rng.randrange(5000)}"
        rows.append((k, " ".join(words)))
    seen, real = [], simhash.components

    def counted(edges):
        seen.append(edges.count())
        return real(edges)

    monkeypatch.setattr(simhash, "components", counted)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    one, many = ({r.doc_id: r.component_id for r in simhash.similar_groups(frame, members=m).collect()} for m in (simhash.TILE_MEMBERS, 16))
    assert len(one) == 200 and one == many and max(Counter(one.values()).values()) > 100
    assert len(seen) == 5 and 100 < max(seen) < 200


@pytest.mark.parametrize("most", [1 << 20, 60])
def test_sparse_edges_keep_components(spark, most):
    rng = random.Random(4)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(90)] * 4 + [(k, k + 1) for k in range(-300, -200)] + [(5, 5)]
    table = simhash.written(spark.createDataFrame(edges, "a long, b long").repartition(6), "edges")
    thin = simhash.sparse(table, most)
    want, got = ({r.node: r.root for r in graph.components(x).collect()} for x in (table, thin))
    assert got == want and (most < 100 or thin.count() < len(want))
    assert simhash.sparse(table.where("a > 500")).count() == 0


def test_spanning_forest():
    import numpy as np

    rng = np.random.default_rng(1)
    low, high, bits = rng.integers(0, 80, 300), rng.integers(80, 200, 300), rng.integers(0, 9, 300)
    a, b, w = simhash.spanning(low, high, bits)
    root = list(range(200))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    weight, edges = 0, 0
    for k in np.argsort(bits, kind="stable"):
        x, y = top(low[k]), top(high[k])
        if x != y:
            root[x], weight, edges = y, weight + int(bits[k]), edges + 1
    assert len(a) == edges and int(w.sum()) == weight and all(top(x) == top(y) for x, y in zip(a, b))
    assert len(simhash.spanning(low[:0], high[:0], bits[:0])[0]) == 0


def test_keep_one(spark, docs, empty):
    kept = simhash.keep_one(docs)
    groups = {r.doc_id: r.component_id for r in simhash.similar_groups(docs).collect() if r.doc_id is not None}
    ids = {r.doc_id for r in kept.collect()}
    assert ids - {None} == set(groups.values()) and kept.columns == docs.columns
    assert simhash.keep_one(empty).count() == 0


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


@pytest.mark.parametrize(("bits", "ranges"), [(None, None), (64, 3)])
def test_exact_dedup(spark, docs, empty, bits, ranges):
    import hashlib

    got = exact_dedup.groups(docs, bits, ranges).collect()
    rows = docs.select("doc_id", "text").collect()
    groups = defaultdict(list)
    for r in rows:
        groups[hashlib.sha256(lowered(r.text).encode()).hexdigest()].append(r.doc_id)
    assert len(got) == len(rows)
    for g in got:
        ids = groups[g.text_sha256]
        assert g.group_size == len(ids) and g.keep_id == max((d for d in ids if d is not None), default=None)
    kept = Counter(g.text_sha256 for g in got if g.kept)
    assert kept == Counter(dict.fromkeys(groups, 1))
    alone = exact_dedup.drop_repeats(docs, bits, ranges)
    assert Counter(hashlib.sha256(lowered(r.text).encode()).hexdigest() for r in alone.collect()) == kept and alone.columns == docs.columns
    assert {r.doc_id for r in alone.collect()} == {g.doc_id for g in got if g.kept}
    assert exact_dedup.groups(empty).count() == 0 and exact_dedup.drop_repeats(empty).count() == 0


def test_exact_dedup_stays_in_the_jvm(spark, docs):
    plan = exact_dedup.groups(docs)._jdf.queryExecution().toString() + url_filters.judge(pages_of(spark, [(1, "http://a.net/", "")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_mixing(spark, docs, empty):
    mix = mixing.Mix(keep=0.5, lang={"en": 0.5, "de": 0.3, "": 0.2}, source=0.5, topic=1.0)
    got = mixing.draw(docs, BYTE, mix).collect()
    enc = tokens.Encoder(BYTE)
    text_of = {r.doc_id: r.text for r in docs.collect() if r.doc_id is not None}
    assert len(got) == docs.count() and all(0 <= g.probability <= 1 for g in got)
    for g in got:
        if g.doc_id is not None:
            assert g.n_tokens == len(enc.whole(text_of[g.doc_id] or "")) // 2 + 1 and g.topic == mixing.topic_of(text_of[g.doc_id] or "")
    sampled = mixing.sample(docs, BYTE, mix)
    assert sampled.columns == docs.columns and sampled.count() == sum(g.drawn for g in got)
    assert mixing.draw(empty, BYTE).count() == 0 and mixing.sample(empty, BYTE).count() == 0
    spread = {(g.source, g.lang, g.topic): g.probability for g in mixing.draw(docs, BYTE, mix, max_cells=0).collect()}
    assert all(abs(spread[g.source, g.lang, g.topic] - g.probability) < 1e-9 for g in got)


def test_topics_against_a_plain_sort():
    def plain(text):
        common = sorted(((n, w) for w, n in Counter(text.split()).items() if len(w) > 3), reverse=True)[:24]
        sums = [sum(n if zlib.crc32(w.encode()) >> k & 1 else -n for n, w in common) for k in range(3)]
        return sum(1 << k for k, x in enumerate(sums) if x > 0)

    rng = random.Random(9)
    for words in (0, 3, 20, 24, 25, 40, 400):
        for spread in (1, 8, 30, 500):
            text = " ".join(f"word{rng.randint(0, spread)}" if rng.random() < 0.8 else "the" for _ in range(words))
            assert mixing.topic_of(text) == plain(text), text


def test_raking_meets_reachable_margins():
    rng = np.random.default_rng(2)
    cells = [(s, lang, t) for s in "abc" for lang in "xy" for t in range(3)]
    have = rng.integers(500, 1500, len(cells)).astype(float)
    mix = mixing.Mix(keep=0.3, source={"a": 0.5, "b": 0.3, "c": 0.2}, lang={"x": 0.4, "y": 0.6}, topic=0.5, rounds=200)
    weight = mixing.rake(cells, have, mix)
    drawn = have * weight
    for name, share in mix.source.items():
        assert abs(drawn[[c[0] == name for c in cells]].sum() / drawn.sum() - share) < 1e-6
    assert abs(drawn[[c[1] == "x" for c in cells]].sum() / drawn.sum() - 0.4) < 1e-6 and abs(drawn.sum() - 0.3 * have.sum()) < 1e-3


def test_packing(spark, docs, empty):
    got = packing.pack(docs, WORD, 0, 2048).collect()
    enc = tokens.Encoder(WORD)
    text_of = {r.doc_id: r.text for r in docs.collect() if r.doc_id is not None}
    for g in got:
        if g.doc_id is not None:
            ids = np.append(np.frombuffer(enc.whole(text_of[g.doc_id] or ""), enc.dtype), 0).astype("<u4")
            part = ids[g.start : g.start + 2048]
            assert g.start == 2048 * g.piece and g.length == len(part) and g.ids_crc32 == zlib.crc32(part.tobytes())
    sequences = defaultdict(list)
    for g in got:
        sequences[g.sequence_id].append((g.offset, g.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= -(-sum(g.length for g in got) // 2048) + 1
    assert packing.pack(empty, WORD).count() == 0


def test_packing_plans_hold_all_pieces():
    rng = random.Random(4)
    for capacity in (7, 50, 2048):
        for n in (1, 3, 40, 900):
            counts = Counter(min(capacity, max(1, int(rng.lognormvariate(np.log(capacity / 3), 0.8)))) for _ in range(n))
            patterns = packing.plan(dict(counts), capacity)
            got = Counter()
            for runs, times in patterns:
                assert sum(a * b for a, b in runs) <= capacity and times > 0
                for a, b in runs:
                    got[a] += b * times
            assert got == counts
            slots = packing.Slots.of(patterns)
            used = set()
            for length, k in counts.items():
                seq, off = slots.place(np.full(k, length), np.arange(k))
                used |= {(int(s), int(o)) for s, o in zip(seq, off)}
            assert len(used) == n and slots.n_sequences == sum(t for _, t in patterns)
    sizes, prices = np.array([3, 5, 7]), np.array([3.0, 5.5, 7.2])
    best = max(((a, b, c) for a in range(7) for b in range(5) for c in range(3) if 3 * a + 5 * b + 7 * c <= 20), key=lambda p: float(np.dot(p, prices)))
    assert np.dot(packing.price_pattern(sizes, prices, 20), prices) == pytest.approx(np.dot(best, prices))
    lp = packing.configuration_lp(np.array([4, 6]), np.array([10.0, 10.0]), 10)
    assert sum(lp.values()) == pytest.approx(10, rel=0.05)


def test_licenses(spark, docs, empty):
    name, text = LICENSE_TEXTS[5]
    copy = "Copyright (c) 2021 Some Body\n\n" + text.upper().replace(", ", " ,\n * ").replace("LICENSE", "LICENCE")
    curly = "/* © 1999 x\n" + text.replace('"', "“").replace(" ", "  ") + "\nAll rights reserved.\n*/"
    rows = [(1, copy), (2, curly), (3, text + " and more"), (4, None), (5, ""), (None, text)]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].license == got[2].license == got[None].license == "MIT" and got[3].license is None
    assert got[4].canonical_sha256 == got[5].canonical_sha256 and got[4].n_bytes == 0 and got[4].license is None
    for spdx, full in LICENSE_TEXTS:
        assert licenses.known_digests()[licenses.digest(full.replace("\n", "\n  ").encode())] == spdx
    assert licenses.scan(docs).count() == docs.count() and licenses.scan(empty).count() == 0
    with pytest.raises(ValueError):
        licenses.known_digests((("A", "same text"), ("B", "Same, text.")))


def test_full_license_texts():
    known = licenses.known_digests()
    for name, spdx in (("Apache-2.0", "Apache-2.0"), ("GPL-2", "GPL-2.0"), ("GPL-3", "GPL-3.0"), ("LGPL-2.1", "LGPL-2.1"), ("MPL-2.0", "MPL-2.0")):
        path = f"/usr/share/common-licenses/{name}"
        if os.path.exists(path):
            with open(path, "rb") as file:
                assert known[licenses.digest(file.read())] == spdx
    assert {"Apache-2.0", "GPL-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "MPL-1.1", "MPL-2.0"} <= set(known.values())


def test_licenses_of_any_wrapping():
    import textwrap

    known = licenses.known_digests()
    short = [x for x in LICENSE_TEXTS if x not in FULL_TEXTS]  # those without copyright lines inside a paragraph
    assert len(short) > 8
    for name, text in short:
        parts = [" ".join(part.split()) for part in text.split("\n\n")]
        for width in range(40, 100, 7):
            wrapped = "\n\n".join("\n".join(textwrap.wrap(part, width, break_long_words=False, break_on_hyphens=False)) for part in parts)
            assert known[licenses.digest(wrapped.encode())] == name, (name, width)
    assert licenses.digest(b"wilful acts") == licenses.digest(b"willful acts")


def test_licenses_of_any_size():
    text = dict(LICENSE_TEXTS)["BSD-3-Clause"]
    assert licenses.known_digests()[licenses.digest(b"\n#" * 600_000 + text.encode())] == "BSD-3-Clause"
    lines = [f"{k % 90}) point of plain words" for k in range(8000)]
    assert licenses.canonical("\n".join(lines).encode()) == b" ".join([b"point of plain words"] * 8000)
    assert licenses.canonical(b"(a) one\n b) two iv. three 12. four a 5") == b"one two three four a 5"


def test_classifier(spark, docs, empty):
    rng = random.Random(9)
    rows = []
    for k in range(400):
        good = k % 3 != 0
        words = [rng.choice(["fine", "plain", "prose", "text", "words", "flow"]) for _ in range(60)]
        rows.append((k, " ".join(words if good else [w.upper() + "!!" for w in words]), int(good)))
    table = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    model = classifier.fit(table.drop("quality"), table.select("doc_id", "quality"))
    got = classifier.score(table.select("doc_id", "text"), model).collect()
    label = {r[0]: r[2] for r in rows}
    for g in got:
        assert g.held_out == (zlib.crc32(str(g.doc_id).encode()) % 5 == 0) and 0 <= g.score <= 1 and g.predicted == (g.score >= 0.3)
        assert g.predicted == label[g.doc_id]
    again = classifier.fit(table.drop("quality").repartition(3), table.select("doc_id", "quality"))
    assert (again.weights == model.weights).all() and again.bias == model.bias
    odd = classifier.score(docs, model).collect()
    assert len(odd) == docs.count() and all(0 <= g.score <= 1 for g in odd)
    none = classifier.fit(docs, spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int"))
    assert {g.score for g in classifier.score(docs, none).collect()} == {0.5}
    assert classifier.score(empty, model).count() == 0


def test_ftrl_matches_a_plain_loop():
    rng = np.random.default_rng(1)
    examples = [(np.sort(rng.choice(32, 5, replace=False)), rng.random(5), int(rng.integers(2))) for _ in range(50)]
    s = classifier.Settings(bits=5, epochs=2)
    z, n = [0.0] * 33, [0.0] * 33

    def weight(i):
        if abs(z[i]) <= s.l1:
            return 0.0
        return (np.sign(z[i]) * s.l1 - z[i]) / ((s.beta + n[i] ** 0.5) / s.alpha + s.l2)

    for _ in range(2):
        for ids, values, y in examples:
            full = [*zip(ids.tolist(), values.tolist()), (32, 1.0)]
            w = {i: weight(i) for i, _ in full}
            p = 1 / (1 + np.exp(-sum(w[i] * v for i, v in full)))
            for i, v in full:
                g = (p - y) * v
                z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / s.alpha * w[i]
                n[i] += g * g
    model = classifier.train(examples, s)
    assert np.allclose(model.weights, [weight(i) for i in range(32)], atol=1e-6) and model.bias == pytest.approx(weight(32))


def test_held_out_quality(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = classifier.score(docs, classifier.fit(docs, labels)).join(labels, "doc_id").where("held_out").collect()
    assert sum(g.predicted == g.quality for g in got) / len(got) > 0.95


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, seen[-1], sf_dir)
        assert out.columns == docs.columns, name
        seen.append(out.persist())
    ids = [{r.doc_id for r in d.select("doc_id").collect()} for d in seen]
    assert ids[1] == {r.doc_id for r in quality_rules.judge(docs).collect() if r.kept}
    assert ids[2] == {r.doc_id for r in exact_dedup.groups(seen[1]).collect() if r.kept}
    assert ids[3] == {r.component_id for r in simhash.similar_groups(seen[2]).collect()}
    assert ids[4] <= ids[3] and len(ids[4]) > 0.7 * len(ids[3])
    packed = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id for r in packed} == ids[4]
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "simhash_near_dedup", "mixing", "best_fit_packing"]


def test_nulls_become_empty_texts():
    from factloom.llm.common import blobs, strings

    assert strings(pa.array(["a", None])) == ["a", ""] and blobs(pa.array(["é", None])) == ["é".encode(), b""]
    broken = pa.Array.from_buffers(pa.string(), 1, [None, pa.py_buffer(np.array([0, 2], "<i4").tobytes()), pa.py_buffer(b"\xffa")])
    assert strings(broken) == ["\ufffda"]
