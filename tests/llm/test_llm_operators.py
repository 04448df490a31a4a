"""The ten operators and the pipeline against brute force, and on awkward tables."""

import hashlib
import math
import random
import re
import textwrap
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tabulae.llm import queries as registered
from tabulae.llm import decontaminate as decontaminate_module
from tabulae.llm.components import components
from tabulae.llm.decontaminate import ItemIndex, contaminated, decontaminate, shingles, split_item
from tabulae.llm.fingerprint_index import FingerprintIndex, remove_earlier_windows
from tabulae.llm.license_scan import TEMPLATES, TemplateIndex, scan_licenses
from tabulae.llm.line_templates import HOT, HotLeaf, _signed, cluster, drop_template_lines, generalise, leaf_of, line_dedup
from tabulae.llm.quality_rules import clean_documents, quality_rules
from tabulae.llm.sentencepiece_codec import MergeEncoder, encode_documents
from tabulae.llm.separator_scan import scan_tokens, token_counts
from tabulae.llm.simhash_groups import fingerprint, keep_one_of_each, keep_one_of_near_copies, near_pairs, simhash_components
from tabulae.llm.suffix_repeats import EnhancedSuffixArray, remove_repeats, repeat_groups
from tabulae.llm.url_trust import ITERATIONS, ONE, host_edges, judge_urls, propagate

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
DOCUMENT = "doc_id long, text string, key string, words string, marks int, leaf string, _text string"


def frame(spark, rows, parts=3):
    """Documents with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "k", "w", 1, "l", "x") for i, t in rows], DOCUMENT).repartition(parts)


def messy(seed=0):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randint(1, 2)))
    base = [" ".join(word() for _ in range(rng.choice([0, 1, 4, 30, 60]))) for _ in range(25)]
    rows = [(k if seed % 2 else rng.randint(0, 20), t) for k, t in enumerate(base)]
    rows += [(100 + k, rng.choice(base) + " x") for k in range(5)]
    return rows + [(200, "a" * 90), (201, "a b " * 40), (202, None), (203, ""), (204, " \n\t"), (None, base[3]), rows[4], rows[4], (205, "Z\n" * 50), (206, "word " * 30_000)]


def brute_bytes(rows, size):
    data = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[k : k + size] for _, b in data for k in range(len(b) - size + 1))
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        for k in range(len(b) - size + 1):
            if seen[b[k : k + size]] > 1:
                gone[k : k + size] = b"\1" * size
        out.append((i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def brute_words(rows, size):
    data = [(i, WORD.findall(t or "")) for i, t in rows]
    first = {}
    order = lambda i: float("inf") if i is None else i
    for i, w in data:
        for k in range(len(w) - size + 1):
            s = tuple(w[k : k + size])
            first[s] = min(first.get(s, float("inf")), order(i))
    out = []
    for i, w in data:
        gone = {p for k in range(len(w) - size + 1) if first[tuple(w[k : k + size])] < order(i) for p in range(k, k + size)}
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for p, x in enumerate(w) if p not in gone).encode()).hexdigest()))
    return sorted(out, key=str)


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# -- 1 -------------------------------------------------------------------------------------
@pytest.mark.parametrize("seed", [0, 1])
def test_suffix_repeats_equal_brute_force(spark, seed):
    rows = messy(seed)[:-1]
    assert collected(remove_repeats(frame(spark, rows), 14, 5).drop("spans")) == brute_bytes(rows, 14)


def test_suffix_array_and_its_maximal_repeats():
    rng = random.Random(3)
    for _ in range(60):
        bodies = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 25))) for _ in range(rng.randint(1, 5))]
        array = EnhancedSuffixArray(bodies)
        text = b"".join(bodies)
        suffix = lambda p: text[p : p + int(array.left[p])]
        order = [suffix(p) for p in array.suffixes]
        assert order == sorted(order) and len(order) == len(text)
        got = {(size, tuple(sorted(p.tolist()))) for size, p in array.maximal_repeats(2)}
        places = defaultdict(set)
        for p in range(len(text)):
            for n in range(2, len(suffix(p)) + 1):
                places[suffix(p)[:n]].add(p)
        want = set()
        for s, ps in places.items():
            right = {suffix(p)[len(s) : len(s) + 1] or p for p in ps}
            left = {text[p - 1] if p > array.begin[p] else -1 - p for p in ps}
            if len(ps) > 1 and len(right) > 1 and len(left) > 1:
                want.add((len(s), tuple(sorted(ps))))
        assert got == want


def test_repeat_groups_list_all_occurrences(spark):
    shared = "the quick brown fox jumps over it"
    rows = [(k, f"{'xyz'[k]} {k} {shared} {'uvw'[k]}") for k in range(3)]
    groups = defaultdict(set)
    for r in repeat_groups(frame(spark, rows), 14, 5).collect():
        groups[r.group, r["size"]].add(r.doc_id)
    assert any(docs == {0, 1, 2} and size >= 14 for (_, size), docs in groups.items())


def test_repeat_groups_equal_brute_force(spark):
    rng = random.Random(14)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage, copy = text(70), text(40)
    rows = [(k, f"{text(9)}{passage}{text(6)}") for k in range(25)] + [(30, copy), (31, copy), (32, copy), (33, "x" + copy[5:30] + "y"), (34, passage[10:50]), (35, text(60)), (36, ""), (37, None)]
    rows += [(40, "ab" * 20), (41, copy[:20] + passage[:20] + copy[:20])]
    data = {i: (t or "").encode() for i, t in rows}
    places = defaultdict(set)
    for i, b in data.items():
        for k in range(len(b)):
            for n in range(14, len(b) - k + 1):
                places[b[k : k + n]].add((i, k))
    want = set()
    for x, ps in places.items():
        right = {data[i][k + len(x) : k + len(x) + 1] or (i, k) for i, k in ps}
        left = {data[i][k - 1 : k] or (i, k) for i, k in ps}
        if len(ps) > 1 and len(right) > 1 and len(left) > 1:
            want |= {(hashlib.sha256(x).hexdigest(), len(x), i, k) for i, k in ps}
    assert collected(repeat_groups(frame(spark, rows), 14, 5)) == sorted(want, key=str)


# -- 2 -------------------------------------------------------------------------------------
def test_encoder_is_the_library():
    ours, lib = MergeEncoder(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rng = random.Random(5)
    signs = "ab thein  er\n\t ▁é😀\x00x,.'̀日本<>0123"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    texts += ["".join(rng.choice(ours.pieces[259:]).replace("▁", " ") for _ in range(rng.randint(1, 5))) for _ in range(3000)]
    texts += ["", " ", "  ", "a" * 3000, " a" * 50, "\n\n", "▁", "x" * 600 + "日"]
    for t in texts:
        ids = lib.encode(t)
        assert ours.encode(t) == ids
        assert ours.both(t)[1] == ours.decode(ids) == lib.decode(ids)


def test_encode_documents(spark):
    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = messy(1)
    want = []
    for i, t in rows:
        ids = lib.encode(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest()))
    assert collected(encode_documents(frame(spark, rows), PIECES)) == sorted(want, key=str)
    assert encode_documents(frame(spark, rows[:3]), PIECES, keep_ids=True).columns[-2:] == ["ids", "decoded"]


# -- 3 -------------------------------------------------------------------------------------
def test_quality_counts(spark):
    rows = messy(1) + [(300, "A line that ends well. " * 8), (301, "Buy | now | cheap | here\nx x x x x\nFine words stand here, and all of them differ."), (302, "#$%& " * 20)]
    want = {}
    for i, t in rows:
        t = t or ""
        w = WORD.findall(t)
        windows = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        seen = Counter(windows)
        repeats = len({p for k, x in enumerate(windows) if seen[x] > 1 for p in range(k, k + 5)})
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want.setdefault(i, set()).add((len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), repeats, len(w) < 10 or 100 * repeats > 20 * len(w)))
    for r in quality_rules(frame(spark, rows)).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) in want[r.doc_id]
        assert not (r.kept and r.base_failed)


def test_quality_lines_go_first(spark):
    good = "This line says something new and ends with a stop.\nAnother one follows here, with other words in it."
    rows = [(1, good), (2, good + "\nHome | News | About | Contact"), (3, "no stop at the end of this line of eleven words\n" * 1 + "Short but fine."), (4, good + "\nWe use cookies on this site.")]
    kept = {r.doc_id: r.text for r in clean_documents(frame(spark, rows)).collect()}
    assert kept == {1: good, 2: good, 4: good}
    assert clean_documents(frame(spark, rows)).columns == frame(spark, rows).columns


# -- 4 -------------------------------------------------------------------------------------
def pages(spark, rows):
    return spark.createDataFrame([(k, u, h, "x", "y", 1) for k, (u, h) in enumerate(rows)], "page_id long, url string, html string, host string, rule string, rank int")


def test_url_rules_longest_wins_and_awkward_urls(spark):
    urls = ["http://A.Example.NET/en/x?q", "http://example.net/de/", "https://q.org/fr/1#x", "http://example.com/de/1", "http://notexample.com/de/1", None, "", "nothing", "http://x.org", "http://h.com?a/b", "HTTP://U.COM://v/w"]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge_urls(pages(spark, [(u, None) for u in urls])).collect()}
    assert got[0] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert got[1][2:] == ("net/", "block") and got[2][2:] == ("org/fr/", "allow") and got[3][2:] == ("example.com/de/", "block")
    assert got[4] == ("notexample.com", "/de/1", None, "allow")
    assert got[5] == got[6] == got[7] == ("", "", None, "allow")
    assert got[9][:2] == ("h.com", "") and got[10][:2] == ("u.com:", "//v/w")


def test_distrust_flows_against_links(spark):
    rows = [("http://farm.com/a", '<a href="http://spam.net/">'), ("http://spam.net/a", ""), ("http://far.com/", "<a href='//farm.com/z'>"), ("http://plain.com/", '<a href="/x">'), ("http://farm.com/b", None), ("http://good.org/fr/", "<a href='//linked.com'>"), ("http://linked.com/", '<a href="//unseen.net">')]
    got = {r.host: (r.verdict, r.trust, r.distrust) for r in judge_urls(pages(spark, rows)).collect()}
    assert got["farm.com"][0] == got["spam.net"][0] == got["far.com"][0] == "block" and got["plain.com"][0] == "allow"
    assert got["spam.net"][2] >= got["farm.com"][2] > got["far.com"][2] > 0
    # links to a blocked host without pages count, and trust outweighs them
    assert got["linked.com"][1] > 0 < got["linked.com"][2]
    edges = host_edges(pages(spark, rows))
    assert sorted((r.src, r.dst, r.n) for r in edges.collect()) == [("far.com", "farm.com", 1), ("farm.com", "spam.net", 1), ("good.org", "linked.com", 1), ("linked.com", "unseen.net", 1)]
    seeds = spark.createDataFrame([(0, "a", ONE)], "kind int, host string, rank long")
    links = spark.createDataFrame([("a", "b", 3), ("a", "c", 1), ("b", "a", 1)], "src string, dst string, n long")
    rank = {h: 1e9 if h == "a" else 0.0 for h in "abc"}
    for _ in range(ITERATIONS):
        rank = {"a": 0.15e9 + 0.85 * rank["b"], "b": 0.85 * rank["a"] * 0.75, "c": 0.85 * rank["a"] * 0.25}
    for r in propagate(seeds, links).collect():
        assert abs(r.trust - rank[r.host]) < 40 and r.distrust == 0


def test_url_query_equals_its_sql_on_a_linked_graph(spark, tmp_path):
    import duckdb

    rng = random.Random(4)
    hosts = [f"h{k}.{rng.choice(['com', 'net', 'org'])}" for k in range(40)] + ["example.net", "a.example.com"]
    rows = [(f"http://{rng.choice(hosts)}/{rng.choice(['', 'fr/', 'de/', 'en/'])}x?q", "".join(f'<a href="//{rng.choice(hosts)}/y">' for _ in range(rng.randint(0, 4)))) for _ in range(300)]
    pages(spark, rows).coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.sql(registered.oracle_sql()["op4_url_trust"])
    got = registered.queries()["op4_url_trust"](spark, str(tmp_path)).select(*want.columns)
    assert collected(got) == sorted(want.fetchall(), key=str) and {r.verdict for r in got.filter("rule IS NULL").collect()} == {"allow", "block"}


# -- 5 -------------------------------------------------------------------------------------
def slow_fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    parts = [" ".join(words)] if len(words) < 4 else [" ".join(words[k : k + 4]) for k in range(len(words) - 3)]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(n, pairs):
    parent = list(range(n))
    for a, b in pairs:
        while parent[a] != a:
            a = parent[a]
        while parent[b] != b:
            b = parent[b]
        parent[max(a, b)] = min(a, b)
    out = []
    for i in range(n):
        while parent[i] != i:
            i = parent[i]
        out.append(i)
    return out


def test_simhash_groups_equal_brute_force(spark):
    rng = random.Random(2)
    long = " ".join(f"w{rng.randint(0, 9999)}" for _ in range(900))
    rows = [(i, t) for i, t in messy(1) if i is not None]
    rows += [(400 + k, " ".join(x if rng.random() > 0.004 else "Zz" for x in long.split())) for k in range(12)]
    rows = list({(i): t for i, t in rows}.items())
    fps = np.array([slow_fingerprint(t) for _, t in rows], np.uint64)
    assert [fingerprint(t or "") for _, t in rows] == fps.tolist()
    near = np.argwhere(np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4, 1))
    group = roots(len(rows), near.tolist())
    least = defaultdict(lambda: 1 << 60)
    for (i, _), g in zip(rows, group):
        least[g] = min(least[g], i)
    want = sorted((i, format(int(f), "016x"), least[g]) for (i, _), f, g in zip(rows, fps, group))
    assert collected(simhash_components(frame(spark, rows))) == sorted(want, key=str)
    assert len({w[2] for w in want}) < len(want)
    kept = keep_one_of_each(frame(spark, rows), shingle=4)
    assert kept.columns == frame(spark, rows).columns and {r.doc_id for r in kept.collect()} == {w[2] for w in want}


def word_jaccard(a, b):
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)} for w in (a.lower().split(), b.lower().split())]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_near_copies_of_similarity_080_are_found(spark):
    rng = random.Random(12)
    rows = []
    for g in range(12):
        base = [f"v{rng.randint(0, 99999)}" for _ in range(rng.choice([40, 120, 400]))]
        rows.append((10 * g, " ".join(base)))
        for k, share in enumerate((0.80, 0.85, 0.95, 0.70), 1):
            # each changed word costs five shingles on each side
            n, copy = len(base) - 4, list(base)
            for j in range(int(n * (1 - share) / (1 + share) / 5)):
                copy[7 + j * 7] = f"new{g}x{k}x{j}"
            rows.append((10 * g + k, " ".join(copy)))
    rows += [(500, ""), (501, None), (502, "one two"), (503, "One  two"), (504, rows[0][1]), (None, rows[0][1])]
    texts = [(i, t or "") for i, t in rows if i is not None]
    near = [(x, y) for x in range(len(texts)) for y in range(x) if word_jaccard(texts[x][1], texts[y][1]) >= 0.8]
    # the plants must need more than the fingerprint's radius
    fps = [fingerprint(t, 5) for _, t in texts]
    assert sum((fps[x] ^ fps[y]).bit_count() > 4 for x, y in near) > 10
    least = {}
    for (i, _), g in zip(texts, roots(len(texts), near)):
        least[g] = min(least.get(g, i), i)
    kept = keep_one_of_near_copies(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(least.values())


def test_tiles_lose_no_link():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 64, 40, np.uint64)
    fps = np.unique(np.concatenate([base, *[base ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) for _ in range(40)]]))
    near = np.argwhere(np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4, 1))
    want = roots(len(fps), near.tolist())
    a, b = near_pairs(fps, 4)
    assert len(a) == len(fps) - len(set(want)) and roots(len(fps), zip(a.tolist(), b.tolist())) == want
    cross = [(i, j) for i, j in near.tolist() if i < 500 <= j]
    a, b = near_pairs(fps, 4, 500)
    assert roots(len(fps), zip(a.tolist(), b.tolist())) == roots(len(fps), cross)


def test_components_of_paths_and_hubs(spark):
    edges = [(k, k + 1) for k in range(20)] + [(100, k) for k in range(101, 150)] + [(7, 7), (100, 101)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {**{k: 0 for k in range(21)}, **{k: 100 for k in range(100, 150)}}


# -- 6 -------------------------------------------------------------------------------------
def test_wand_retrieves_all_above_threshold():
    rng = random.Random(4)
    vocabulary = [f"t{k}" for k in range(60)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(3, 15)))) for k in range(150)]
    index = ItemIndex(items, 0.6, 0.8)
    for _ in range(150):
        terms = set(rng.sample(vocabulary, rng.randint(1, 30)))
        scores = defaultdict(float)
        for t in terms:
            for k, s in zip(*index.postings.get(t, ((), (), ()))[:2]):
                scores[k] += s
        assert sorted(k for k, _ in index.retrieve(terms)) == sorted(k for k, s in scores.items() if s >= 0.6 - 1e-9)


def test_decontamination_finds_items_and_leaves_the_rest(spark):
    rng = random.Random(6)
    text = lambda n: " ".join(f"w{rng.randint(0, 3000)}" for _ in range(n))
    items = [(k, f"{text(25)}. {text(12)}.") for k in range(30)] + [(50, None), (51, ""), (52, "one")]
    rows = [(k, text(400)) for k in range(20)] + [(100 + k, f"{text(150)} {items[k][1].upper()} {text(90)}") for k in range(10)]
    rows += [(120, f"{text(80)} {items[3][1].split('. ')[0]}. {text(80)}"), (121, None), (122, ""), rows[20]]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    got = sorted((r.doc_id, r.item_id) for r in contaminated(frame(spark, rows), bench).collect() if r.item_id != 52)
    assert got == [(100 + k, k) for k in range(10)]
    left = {r.doc_id for r in decontaminate(frame(spark, rows), bench).collect()}
    assert left == {i for i, _ in rows} - set(range(100, 110))
    assert contaminated(frame(spark, rows), bench.limit(0)).count() == 0
    # documents without an id go like others; short items are compared by words in one place
    nameless = frame(spark, [(None, rows[20][1]), (None, rows[0][1]), (7, rows[21][1])])
    assert [(r.doc_id, r.text) for r in decontaminate(nameless, bench).collect()] == [(None, rows[0][1])]
    short = spark.createDataFrame([(1, "kappa lambda mu nu xi omicron pi rho")], "item_id long, text string")
    odd = [(1, text(60) + " kappa lambda mu nu XX omicron pi rho " + text(60)), (2, " ".join("kappa lambda mu nu xi omicron pi rho".split()[k] + text(9) for k in range(8)))]
    assert [r.doc_id for r in contaminated(frame(spark, odd), short).collect()] == [1]
    question, answer = split_item("What is it? Answer: that")
    assert (question, answer) == (["what", "is", "it"], ["that"]) and shingles([], 5) == set()


def test_hits_and_scores_equal_all_pairs_for_any_block_size(spark, monkeypatch):
    """BM25 of every passage and item, counted without an index."""
    rng = random.Random(12)
    vocabulary = [f"t{k}" for k in range(60)]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.randint(6, 18)))) for k in range(40)]
    rows = [(k, " ".join(rng.choices(vocabulary, k=70) + (items[k % 40][1].split() if k % 2 else [])) + rng.choice(["", " a b c"])) for k in range(40)] + [(90, None), (91, "")]
    bags = [Counter(t.split()) for _, t in items]
    df, mean = Counter(w for b in bags for w in b), sum(sum(b.values()) for b in bags) / len(bags)
    impact = lambda b, w: math.log(1 + (len(bags) - df[w] + 0.5) / (df[w] + 0.5)) * b[w] * 2.2 / (b[w] + 1.2 * (0.25 + 0.75 * sum(b.values()) / mean))
    longest, want = max(sum(b.values()) for b in bags), {}
    for i, t in rows:
        words = (t or "").split()
        for at in range(0, max(1, len(words) - longest), longest):
            passage = words[at : at + 2 * longest]
            for (item, text), b in zip(items, bags):
                own = text.split()
                score = sum(impact(b, w) for w in b if w in set(passage)) / sum(impact(b, w) for w in b)
                if len(own) < 10:
                    span = math.ceil(len(own) * 1.25)
                    share = max((sum((Counter(passage[k : k + span]) & b).values()) for k in range(len(passage))), default=0) / len(own)
                else:
                    share = len(shingles(own, 5) & shingles(passage, 5)) / len(shingles(own, 5))
                if score >= 0.6 and share >= 0.8 - 1e-9:
                    want[i, item] = max(want.get((i, item), (0, 0)), (round(score, 9), round(share, 9)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    for size in (20_000, 9):
        monkeypatch.setattr(decontaminate_module, "MAX_ITEMS", size)
        got = {(r.doc_id, r.item_id): (r.score, r.overlap) for r in contaminated(frame(spark, rows), bench).collect()}
        assert len(got) >= 20 and got == want


# -- 7 -------------------------------------------------------------------------------------
@pytest.mark.parametrize("seed", [0, 1])
def test_fingerprint_index_equals_brute_force(spark, seed):
    rows = messy(seed)
    assert collected(remove_earlier_windows(frame(spark, rows), 5, 2)) == brute_words(rows, 5)


def test_batches_and_compaction_change_nothing(spark):
    rows = [(k, t) for k, (_, t) in enumerate(messy(1))]
    df = frame(spark, rows)
    index = FingerprintIndex(spark, length=5, gram=2)
    got = []
    for low, high in ((0, 9), (9, 22), (22, 1000)):
        got += [tuple(r) for r in index.add(df.filter((F.col("doc_id") >= low) & (F.col("doc_id") < high))).collect()]
        index.compact()
        index = FingerprintIndex(spark, index.path)
    assert sorted(got, key=str) == brute_words(rows, 5) and len(index.runs) == 1
    with pytest.raises(ValueError):
        index.add(df.filter("doc_id < 9"))


def test_an_index_survives_as_its_folder(spark):
    text = " ".join(f"w{k}" for k in range(60))
    first = FingerprintIndex(spark, length=5, gram=2, bits=2)
    first.add(frame(spark, [(1, text)]))
    again = FingerprintIndex(spark, first.path)
    assert sorted(tuple(r)[:3] for r in again.add(frame(spark, [(2, "x " + text), (3, None)])).collect()) == [(2, 61, 60), (3, 0, 0)]
    assert (len(FingerprintIndex(spark, first.path).runs), again.state["bits"]) == (2, 2)
    # windows that agree in part only are verified word by word against the files of the first batch
    half = " ".join(text.split()[:20] + ["y"] * 9 + text.split()[40:])
    assert [r.n_removed for r in FingerprintIndex(spark, first.path).add(frame(spark, [(4, half)]), keep=False).collect()] == [40]


def test_texts_that_only_share_an_anchor_are_not_compared(spark, monkeypatch):
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(10**9)}"
    phrases = [[word() for _ in range(5)] for _ in range(20)]
    strangers = [" ".join(w for p in rng.sample(phrases, 12) for w in [*p, *(word() for _ in range(rng.randint(8, 12)))]) for _ in range(40)]
    long = [word() for _ in range(200)]
    # a word changed at each place, so that repeats end at each distance before and after their anchors
    near = [" ".join(long[:k] + ["x", f"y{k}"][k % 2 :][:1] + long[k + 1 :]) for k in range(0, 200, 3)]
    asked = []
    verified = FingerprintIndex._verified
    monkeypatch.setattr(FingerprintIndex, "_verified", lambda self, files, rows, length: asked.append(rows.count()) or verified(self, files, rows, length))
    rows = list(enumerate(strangers))
    assert collected(remove_earlier_windows(frame(spark, rows))) == brute_words(rows, 13) and asked == [0, 0, 0]
    rows = list(enumerate(strangers + near))
    rng.shuffle(rows)
    for gram in (5, 6, 13):
        assert collected(remove_earlier_windows(frame(spark, rows), 13, gram)) == brute_words(rows, 13)


def test_an_index_without_sides_is_refused(spark):
    index = FingerprintIndex(spark, length=5, gram=2, bits=2)
    index.add(frame(spark, [(1, "a b c d e f")]))
    del index.state["sides"]
    index._commit()
    with pytest.raises(ValueError):
        FingerprintIndex(spark, index.path)


def test_batches_of_null_and_last_doc_ids(spark):
    text = " ".join(f"w{k}" for k in range(40))
    rows = [(None, text), (None, text + " x"), (1, text), (None, "a " + text), (2, "b"), ((1 << 63) - 1, text)]
    assert collected(remove_earlier_windows(frame(spark, rows), 5, 2)) == brute_words(rows, 5)


# -- 8 -------------------------------------------------------------------------------------
def test_token_counts_equal_the_tokenizer(spark):
    import base64

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    lib = tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = messy(0) + [(900, "<|endoftext|> is text")]
    want = sorted((i, len(lib.encode_ordinary(t or ""))) for i, t in rows if i is not None)
    for size in (2, 64, 4 << 20):
        got = token_counts(frame(spark, rows), RANKS, block_bytes=size if size > 2 else 4096)
        assert sorted(tuple(r) for r in got.filter("doc_id IS NOT NULL").collect()) == want


def test_separators_are_stitched_across_blocks(spark, tmp_path):
    rng = random.Random(1)
    want = []
    for f in range(4):
        lengths = [rng.choice([0, 0, 1, 5, 40]) for _ in range(rng.randint(0, 12))]
        tail = [0, 7, 0, 30][f]
        ids = [x for n in lengths for x in [*[1] * n, 9]] + [1] * tail
        np.array(ids, np.uint16).tofile(tmp_path / f"{f}.bin")
        want += [(str(tmp_path / f"{f}.bin"), k, n) for k, n in enumerate(lengths + [tail] * bool(tail))]
    for block in (2, 6, 22, 1000):
        got = scan_tokens(spark, [str(p) for p in tmp_path.glob("*.bin")], 9, block)
        assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_ids_that_do_not_fit_are_refused(spark):
    with pytest.raises(ValueError):
        token_counts(frame(spark, [(1, "a")]), RANKS, separator=1 << 16)
    with pytest.raises(ValueError):
        token_counts(frame(spark, [(1, "a")]), RANKS, separator=7)


# -- 9 -------------------------------------------------------------------------------------
def test_set_join_equals_all_pairs():
    rng = random.Random(8)
    vocabulary = sorted({w for _, t in TEMPLATES for w in t.split()})
    index = TemplateIndex(TEMPLATES, {w: rng.randint(0, 50) for w in vocabulary}, 0.8)
    for _ in range(3000):
        template = set(rng.choice(TEMPLATES)[1].split())
        block = [w for w in template if rng.random() < 0.85] + rng.sample(vocabulary, 3) + ["zzz"] * rng.randint(0, 2)
        want = {t: len(set(text.split()) & set(block)) / len(set(text.split())) for t, (_, text) in enumerate(TEMPLATES)}
        assert index.matches([w.encode() for w in block]) == {t: c for t, c in want.items() if c >= 0.8 - 1e-9}


def test_license_places_and_labels(spark):
    rows = [(1, "MIT-License and mit license, Apache\nLicense"), (2, "Released under the MIT terms license"), (3, None), (4, ""), (5, "general public licenses"), (6, "x GENERAL Public license"), (7, "Licensed under CC BY-NC 4.0."), (8, "Élicense mité license")]
    got = {r.doc_id: r for r in scan_licenses(frame(spark, rows)).collect()}
    r = got[1]
    assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (7, 3, 0, 5, "apache,mit")
    assert (got[2].base_labels, got[2].labels, got[2].score) == ("", "mit", 1.0)
    assert (got[3].n_words, got[3].n_base, got[3].first_word, got[3].labels, got[3].score) == (0, 0, None, "", 0.0)
    assert got[5].n_base == 0 and got[6].n_base == 1 and got[7].labels == "cc-by-nc" and got[8].n_base == 0
    lines = scan_licenses(frame(spark, rows), blocks=True).filter("doc_id = 2").collect()
    assert [(x.line, x.label, x.containment) for x in lines] == [(0, "mit", 1.0)]


def test_license_query_equals_brute_force_on_lines(spark):
    rng = random.Random(3)
    words = [w for _, t in TEMPLATES for w in t.split()]
    rows = []
    for k in range(250):
        part = [w for w in rng.choice(TEMPLATES)[1].split() if rng.random() < 0.93] if k % 3 else []
        extra = rng.sample(words, rng.randint(0, 4)) + rng.choice([[], ["MIT", "license"], ["Général"], ["general", "public", "license"]])
        rows.append((k, rng.choice([" ", ", ", "-"]).join([*extra[:2], *part, *extra[2:]])))
    sets = [(label, set(t.split()), len(set(t.split()))) for label, t in TEMPLATES]
    want = []
    for i, text in rows:
        own = re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", text.translate({c: c + 32 for c in range(65, 91)}))
        phrases = {"mit": ["mit", "license"], "apache": ["apache", "license"], "gpl": ["general", "public", "license"]}
        places = [(k, label) for label, p in phrases.items() for k in range(len(own)) if own[k : k + len(p)] == p]
        met = [(len(s & set(own)) / n, n, s & set(own), label) for label, s, n in sets if len(s & set(own)) >= 0.8 * n - 1e-9]
        seen = [x for x in met if not any(x[2] <= y[2] and y[:2] > x[:2] for y in met)]
        base = sorted({label for _, label in places})
        score = max([1.0 if base else 0.0, *(x[0] for x in seen)])
        at = [k for k, _ in places]
        want.append((i, len(own), len(at), min(at, default=None), max(at, default=None), ",".join(base), ",".join(sorted({*base, *(x[3] for x in seen)})), score))
    assert collected(scan_licenses(frame(spark, rows))) == sorted(want, key=str)


def test_wrapped_templates_keep_their_labels(spark):
    rows, want = [], {}
    for k, (label, text) in enumerate(TEMPLATES):
        for width in (60, 72, 20):
            i = len(rows)
            rows.append((i, "Some words before it.\n\n# " + "\n# ".join(textwrap.wrap(text.capitalize() + ".", width)) + "\n\nand then others after it"))
            # the base phrase of the GPL stands in the LGPL's line
            want[i] = f"gpl,{label}" if label in ("lgpl", "agpl") else label
            want[i] = ",".join(sorted({*want[i].split(","), "gpl"})) if "general public license" in text else want[i]
    got = {r.doc_id: r for r in scan_licenses(frame(spark, rows)).collect()}
    assert {i: r.labels for i, r in got.items()} == want
    assert all(r.score == 1.0 for r in got.values())
    lines = scan_licenses(frame(spark, rows[24:25]), blocks=True).collect()
    assert [(x.line, x.label, x.containment) for x in lines] == [(2, "bsd", 1.0)]


def test_all_templates_of_a_line_keep_their_labels(spark):
    text = dict((label, t) for label, t in reversed(TEMPLATES))
    rows = [(1, f"{text['bsd']} {text['mpl']}"), (2, text["bsd"] + "\n" + text["mpl"]), (3, text["cc-by-sa"]), (4, text["cc-by-sa"] + "\n" + text["cc-by"]), (5, text["cc-by-sa"] + "\nLicensed under something else"), (6, "all rights of\nothers are here, and some are kept in a place\nreserved for them")]
    got = {r.doc_id: r.labels for r in scan_licenses(frame(spark, rows)).collect()}
    assert got == {1: "bsd,mpl", 2: "bsd,mpl", 3: "cc-by-sa", 4: "cc-by,cc-by-sa", 5: "cc-by-sa", 6: ""}


# -- 10 ------------------------------------------------------------------------------------
def slow_lines(rows, min_docs):
    leaves = defaultdict(Counter)
    for _, t in rows:
        for g in {generalise(x) for x in (t or "").split("\n")} - {""}:
            leaves[leaf_of(g, 3)][g] += 1
    template = {}
    for leaf, lines in leaves.items():
        for name, own, _ in cluster(list(lines.items()), 0.8):
            template.update((g, (leaf, name)) for g in own)
    uses = defaultdict(set)
    for i, t in rows:
        for k, x in enumerate((t or "").split("\n")):
            if g := generalise(x):
                uses[template[g]].add((i, k))
    gone = defaultdict(set)
    for places in uses.values():
        if len({i for i, _ in places}) >= min_docs:
            for i, k in places - {min(places)}:
                gone[i].add(k)
    return gone


def test_line_templates(spark):
    rng = random.Random(9)
    rows = [(k, "\n".join([f"User {rng.randint(0, 99)} logged in from 10.0.0.{k}", f"only line number of {'abcdefghij'[k % 10]}{k}x here", rng.choice(["Share this page with all of your friends today", "Share this page with all of your friends now"]), "words " * k + "of my own"])) for k in range(9)]
    rows += [(20, None), (21, ""), (22, "\n\n"), (23, "twice\ntwice")]
    gone = slow_lines(rows, 5)
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in line_dedup(frame(spark, rows)).collect()}
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = "\n".join(x for k, x in enumerate(lines) if k not in gone[i])
        assert got[i] == (sum(1 for x in lines if x.strip()), len(gone[i]), hashlib.sha256(kept.encode()).hexdigest())
    assert not gone[0] and len(gone[8]) >= 2
    out = drop_template_lines(frame(spark, rows))
    assert out.columns == frame(spark, rows).columns and {r.doc_id for r in out.collect()} == {i for i, _ in rows}


def test_clusters_generalise_differing_tokens():
    (name, own, n), (other, _, _) = cluster([("a b c d e", 3), ("a b c d f", 2), ("z z z z z", 1)], 0.8)
    assert (name, sorted(own), n) == ("a b c d <*>", ["a b c d e", "a b c d f"], 5) and other == "z z z z z"


@pytest.mark.parametrize("n", [HOT, HOT + 1])
def test_large_leaves_generalise_too(spark, n):
    rows = [(k, f"Posted by user name{'abcdefghij'[k % 10]}{''.join(chr(97 + int(c)) for c in str(k))} on the main board today") for k in range(n)]
    assert [r.n_dropped for r in line_dedup(frame(spark, rows)).orderBy("doc_id").collect()] == [0] + [1] * (n - 1)


def test_hot_leaves_cluster_as_small_ones():
    rng = random.Random(13)
    for _ in range(150):
        width, size, depth = rng.randint(1, 14), rng.randint(1, 5), rng.randint(0, 3)
        head = [rng.choice(["h", "<*>"]) for _ in range(min(depth, width))]
        lines = Counter()
        base = [[rng.choice("abcdef"[:size]) for _ in range(width)] for _ in range(4)]
        for _ in range(rng.randint(1, 150)):
            tail = [rng.choice(["x", "y", "z", "<*>"]) if rng.random() < 0.2 else t for t in rng.choice(base)]
            lines[" ".join(head + tail[len(head) :])] += rng.randint(1, 3)
        for similarity in (0.8, 0.5, 1.0):
            hot = HotLeaf(width, similarity, len(head))
            for x, n in sorted(lines.items(), key=lambda x: (-x[1], x[0])):
                hot.add(x, n)
            want = [(t, sorted(_signed(x) for x in own), n) for t, own, n in cluster(list(lines.items()), similarity)]
            assert [(t, sorted(own.tolist()), n) for (t, own), n in zip(hot.groups(0), hot.docs, strict=True)] == want


# -- all -----------------------------------------------------------------------------------
@pytest.mark.parametrize("name", sorted(registered.queries()))
def test_empty_tables(spark, tmp_path, name):
    for t in ("documents", "pages", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert registered.queries()[name](spark, str(tmp_path)).count() == 0


def test_stages_one_by_one_equal_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, before, SF).cache()
        ids, had = [r.doc_id for r in out.select("doc_id").collect()], {r.doc_id for r in before.select("doc_id").collect()}
        assert set(ids) <= had and len(ids) == len(set(ids)) > 0
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == columns
        before = out
    assert collected(before) == collected(corpus_pipeline.run(spark, SF))


def test_stages_take_awkward_documents(spark, tmp_path):
    """Nulls in any column, empty, repeated and very long rows, and no rows: every stage works, and
    keeps the clean documents."""
    rng = random.Random(5)
    clean = lambda: "\n".join(" ".join(rng.choice(["alpha", "beta", "gamma", "delta", f"w{rng.randint(0, 9999)}"]) for _ in range(14)) + "." for _ in range(6))
    texts = [clean() for _ in range(12)]
    rows = [(k, t, "en", "s", 1) for k, t in enumerate(texts)]
    rows += [(20, None, None, None, None), (21, "", "en", "s", 0), (None, clean(), "en", None, 2), (22, texts[3], "en", "s", 1), (23, "long enough words here to be kept, surely. " * 4000, "en", "s", 1), rows[0], (24, " \n\n ", "fr", "s", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
        got = Counter(r.doc_id for r in stage(spark, docs, str(tmp_path)).select("doc_id").collect())
        assert set(range(1, 12)) <= set(got), name
        assert (name != "SimHash near-dedup") or (22 not in got and got[0] == 1 and got[None] == 1)
