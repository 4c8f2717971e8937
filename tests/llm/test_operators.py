"""Each operator against brute force on small rows, the odd rows and an empty table."""

import math
import random
import re
import zlib
from collections import defaultdict
from hashlib import sha256
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from factloom.llm import chat, mixing, packing, quality, queries, shards, shinglesets, simhash, substring, tokenfile, topk, urlfilter
from factloom.llm.components import components
from tests.llm.odd import ROWS, SCHEMA, no_docs, odd_docs, words


def rows_of(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


# ---- 1 mixing ----


def test_mix_targets_copies_and_reruns(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * rng.randint(1, 60)), None, rng.choice(["a", "a", "a", "b", "c", None]), 0) for i in range(3000)]
    docs = odd_docs(spark, rows, clashing=False)
    got = mixing.mix(docs).collect()
    assert sorted(got) == sorted(mixing.mix(docs.repartition(5)).collect())
    size, taken, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        assert r.taken == r.copies * r.size and r.copies <= 3
        size[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    total, weight, fixed = sum(size.values()), {"a": 5, "b": 2, "c": 1, None: 5}, {}
    while True:
        free = {s: w for s, w in weight.items() if s not in fixed}
        level = (total - sum(fixed.values())) / sum(free.values())
        over = [s for s in free if free[s] * level > 3 * size[s]]
        if not over:
            break
        fixed |= {s: 3.0 * size[s] for s in over}
    for s in size:
        assert target[s] == pytest.approx(fixed.get(s, weight[s] * level))
        assert abs(taken[s] - target[s]) <= 60


def test_mix_takes_the_head_of_the_pareto_order(spark):
    """Copies of every row against the order of odds(u) / odds(p), worked out in Python."""
    rng = random.Random(3)
    rows = [(i, " ".join(["w"] * rng.randint(1, 300)), None, rng.choice("aaab"), 0) for i in range(400)]
    docs = spark.createDataFrame(rows, SCHEMA)
    weights = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "source string, weight double")
    got = {r.doc_id: r for r in mixing.mix(docs, weights).collect()}
    items = mixing._items(docs, None, 100.0, F.col("doc_id"))
    drawn = items.select("doc_id", "source", "size", "w", mixing._uniform(F.col("key"), F.lit(0).cast("long"), F.lit(1)).alias("u")).collect()
    for source in "ab":
        mine = [r for r in drawn if r.source == source]
        goal = got[mine[0].doc_id].target
        low, high = 0.0, 1e6
        for _ in range(200):  # the ratio at which expected words are the target
            ratio = (low + high) / 2
            low, high = (ratio, high) if sum(r.size * min(3.0, ratio * r.w) for r in mine) < goal else (low, ratio)
        ranked, copies = [], {}
        for r in mine:
            e = min(3.0, ratio * r.w)
            copies[r.doc_id] = int(e + 1e-6)
            p = e - copies[r.doc_id]
            if p > 1e-6:
                ranked.append(((r.u / (1 - r.u)) / (p / (1 - p)), r.doc_id, r.size))
        rest = goal - sum(got[i].size * n for i, n in copies.items())
        assert len({round(e, 6) for e, *_ in ranked}) > 50
        for _, i, size in sorted(ranked):
            if size / 2 >= rest:
                break
            copies[i], rest = copies[i] + 1, rest - size
        assert {i: got[i].copies for i in copies} == copies


def test_repeated_rows_and_null_ids_draw_apart(spark):
    rows = [(None, "one two three four five six seven eight nine ten", None, "a", 0)] * 300
    rows += [(None, f"{i} two three four five six seven eight nine ten", None, "b", 0) for i in range(300)]
    weights = spark.createDataFrame([("a", 2.0), ("b", 5.0)], "source string, weight double")
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA).repartition(7), weights).groupBy("source").agg(F.sum("taken"), F.max("target"), F.countDistinct("copies")).collect()
    assert len(got) == 2
    for _, taken, target, kinds in got:
        assert abs(taken - target) <= 10 and kinds == 2


def test_inclusion_follows_the_weights(spark):
    rows = [(i, "x y", None, "a" if i < 400 else "b", 0) for i in range(1200)]
    docs = odd_docs(spark, rows, clashing=False).withColumn("weight", F.when(F.col("doc_id") % 2 == 0, 3.0).otherwise(1.0))
    weights = spark.createDataFrame([("a", 1.0), ("b", 5.0)], "source string, weight double")
    often = defaultdict(list)
    for seed in range(4):
        for r in mixing.mix(docs, weights, seed=seed, weight_col="weight").where("source = 'a'").collect():
            often[r.doc_id % 2].append(r.copies)
    even, odd = np.mean(often[0]), np.mean(often[1])
    assert even / odd == pytest.approx(3, rel=0.25)


def test_mix_takes_odd_rows(spark):
    got = mixing.mix(odd_docs(spark)).collect()
    assert len(got) == len(ROWS) and all(r.taken == 0 for r in got if r.size == 0)
    assert mixing.mix(no_docs(spark)).count() == 0
    mixed = mixing.mixed_documents(odd_docs(spark))
    assert mixed.columns == odd_docs(spark).columns
    assert mixed.count() == sum(r.copies for r in got)


# ---- 2 quality ----


def test_counts_match_brute_force(spark):
    def brute(t):
        t, w, seen, dup = t or "", words(t), set(), 0
        for line in t.split("\n"):
            if words(line):
                dup += line in seen
                seen.add(line)
        at = defaultdict(list)
        for i in range(len(w) - 2):
            at[tuple(w[i : i + 3])].append(i)
        covered = {j for v in at.values() if len(v) > 1 for i in v for j in (i, i + 1, i + 2)}
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered)

    texts = ["a b c a b c", "x x x x x", "\n a\n a\na\n\n", "#é* | <b>", "a b c d a b c d e f g a b", "a\x0bb\x0cc\rd", *[r[1] for r in ROWS]]
    docs = odd_docs(spark, [(i, t, None, None, None) for i, t in enumerate(texts)])
    got = {r.doc_id: r for r in quality.judge(docs).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(t)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_expectation_maximisation_matches_brute_force(spark):
    rng, rules = random.Random(3), ["x", "y", "z"]
    votes = []
    for _ in range(500):
        good = rng.random() < 0.8
        votes.append(tuple(rng.choices([1, -1, 0], [0.9, 0.02, 0.08] if good else [0.5, 0.4, 0.1])[0] for _ in rules))
    prior, on_good, on_bad = quality.fit(spark.createDataFrame(votes, "x int, y int, z int"), rules)
    p, g, b = quality.START["prior"][0], [quality.START["on_good"][0]] * 3, [quality.START["on_bad"][0]] * 3
    clip = lambda v, kind: min(max(v, quality.START[kind][1]), quality.START[kind][2])
    for _ in range(30):
        post = []
        for v in votes:
            odds = p / (1 - p)
            for j, x in enumerate(v):
                odds *= g[j] / (1 - b[j]) if x == 1 else (1 - g[j]) / b[j] if x == -1 else 1
            post.append(odds / (1 + odds))
        old = [p, *g, *b]
        p = clip(sum(post) / len(votes), "prior")
        for j in range(3):
            said = [(q, v[j]) for q, v in zip(post, votes, strict=True) if v[j]]
            g[j] = clip(sum(q for q, x in said if x == 1) / sum(q for q, _ in said), "on_good")
            b[j] = clip(sum(1 - q for q, x in said if x == -1) / sum(1 - q for q, _ in said), "on_bad")
        if max(abs(x - y) for x, y in zip(old, [p, *g, *b], strict=True)) < 1e-4:
            break
    assert prior == pytest.approx(p) and on_good == pytest.approx(g) and on_bad == pytest.approx(b)


def test_good_documents_are_what_judge_keeps(spark):
    docs = odd_docs(spark)
    kept = sum(r.kept for r in quality.judge(docs).collect())
    good = quality.good_documents(docs)
    assert good.count() == kept > 0 and good.columns == docs.columns
    assert quality.judge(no_docs(spark)).count() == 0 and quality.good_documents(no_docs(spark)).count() == 0


# ---- 3 substring dedup ----


def brute_repeats(rows, w=20):
    seen, out = set(), {}
    for i, t in sorted(rows):
        ws = words(t)
        cut = [False] * len(ws)
        for s in range(len(ws) - w + 1):
            k = tuple(ws[s : s + w])
            if k in seen:
                cut[s : s + w] = [True] * w
            else:
                seen.add(k)
        out[i] = (len(ws), sum(cut), " ".join(x for x, c in zip(ws, cut, strict=True) if not c))
    return out


@pytest.mark.parametrize("vocabulary", [2, 400])
def test_repeats_match_brute_force(spark, vocabulary):
    rng = random.Random(vocabulary)
    vocab = [f"w{i}é" for i in range(vocabulary)]
    base = [[rng.choice(vocab) for _ in range(rng.choice([5, 19, 20, 21, 60, 300]))] for _ in range(6)]
    rows = []
    for i in range(120):
        ws = []
        for _ in range(rng.randint(0, 5)):
            b = rng.choice(base)
            a = rng.randint(0, len(b))
            ws += b[a : rng.randint(a, len(b))] + [rng.choice(vocab) for _ in range(rng.randint(0, 6))]
        rows.append((i * 3 - 20, rng.choice([" ", "\n", "  \t"]).join(ws)))
    want = brute_repeats(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for n in (1, 5):
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring.remove_repeats(df.repartition(n)).collect()}
        assert got == want


def test_repeats_take_odd_rows(spark):
    got = substring.remove_repeats(odd_docs(spark)).collect()
    assert len(got) == len(ROWS)
    assert {r.n_removed for r in got if r.doc_id == 8} == {0}
    docs = odd_docs(spark)
    out = substring.without_repeats(docs)
    assert out.columns == docs.columns and out.count() == len(ROWS)
    assert out.where("text is null").count() == 2
    assert substring.remove_repeats(no_docs(spark)).count() == 0


# ---- 4 top-k ----


def test_top_k_matches_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=12)]) for i in range(400)]
    rows += [(400 + i, rows[0][1]) for i in range(60)]  # copies
    rows += [(500, None), (501, [1.0, None] + [0.0] * 10), (502, [float("nan")] * 12), (503, [float("inf")] * 12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("x"))
    v = {i: [math.floor(1024 * float(np.float32(x))) for x in e] for i, e in rows if e and all(x is not None and math.isfinite(x) for x in e)}
    want = set()
    for q in (i for i in v if i % 100 == 0):
        best = sorted((-sum(a * b for a, b in zip(v[q], v[c], strict=True)), c) for c in v if c != q)[:10]
        want |= {(q, n, c, -s) for n, (s, c) in enumerate(best, 1)}
    vectors = df.select("vec_id", topk.quantised(F.col("embedding")).alias("v"))
    got = topk.top_k(vectors, F.col("vec_id") % 100 == 0, item_block=90, query_block=2)
    assert set(rows_of(got, "query_id", "rank", "vec_id", "score")) == want


def test_top_k_of_a_row_repeated_often(spark):
    """The query's own row occurs more often than k; others with its vector still come."""
    rows = [(0, [3, 4])] * 12 + [(7, [3, 4]), (9, [3, 4]), (8, [0, 1])] + [(i, [1, 0]) for i in range(20, 40)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, v array<long>"), F.col("vec_id") == 0, k=3)
    assert set(rows_of(got, "query_id", "rank", "vec_id", "score")) == {(0, 1, 7, 25), (0, 2, 9, 25), (0, 3, 8, 4)}


def test_top_k_of_few_rows(spark):
    rows = spark.createDataFrame([(0, [1, 2]), (0, [1, 2]), (7, [3]), (None, [1, 1]), (9, None)], "vec_id long, v array<bigint>")
    got = set(rows_of(topk.top_k(rows, F.col("vec_id") == 0), "query_id", "rank", "vec_id", "score"))
    assert got == {(0, 1, 7, 3), (0, 2, None, 3)}
    assert topk.top_k(rows.limit(0), F.lit(True)).count() == 0


def test_op4_takes_every_row_but_the_querys_own(spark, tmp_path):
    """Rows that share a query's id are candidates, and queries with ranks of their own; large scores don't wrap round."""
    rows = [(100, [1.0, 0.5]), (100, [1.0, 0.5]), (100, [-1.0, 2.0]), (7, [0.25, 0.25]), (None, [0.0, 1.0]), (9, [-3e12, -3e12]), (8, [2e6, -3e6])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    v = [(i, [math.floor(1024 * float(np.float32(x))) for x in e]) for i, e in rows]
    want = []
    for n, (q, e) in enumerate(v):
        if q == 100:
            others = [(-sum(a * b for a, b in zip(e, f, strict=True)), c is None, c) for m, (c, f) in enumerate(v) if m != n]
            want += [(q, rank, c, -s) for rank, (s, _, c) in enumerate(sorted(others), 1)]
    got = rows_of(queries.QUERIES["op4_topk_uniform_threshold"](spark, str(tmp_path)), "query_id", "rank", "vec_id", "score")
    key = lambda r: (r[1], r[3], r[2] is None, r[2] or 0)
    assert sorted(got, key=key) == sorted(want, key=key)


def test_top_k_of_scores_at_the_end_of_a_long(spark):
    """A score that fits is exact though others, and its own terms, don't."""
    rng = np.random.default_rng(8)
    v = {i: [int(x) for x in rng.integers(-(10**9), 10**9, 8)] for i in range(300)} | {900: [2**62, -(2**62), 3] + [0] * 5, 0: [5, 5, 7, 0, 0, 0, 0, 10**9]}
    got = topk.top_k(spark.createDataFrame(list(v.items()), "vec_id long, v array<long>"), F.col("vec_id") % 100 == 0, item_block=40)
    want = set()
    for q in (0, 100, 200, 900):
        fit = {c: min(max(sum(a * b for a, b in zip(v[q], v[c], strict=True)), -(2**63)), 2**63 - 1) for c in v if c != q}
        want |= {(q, n, c, s) for n, (c, s) in enumerate(sorted(fit.items(), key=lambda r: (-r[1], r[0]))[:10], 1)}
    assert set(rows_of(got, "query_id", "rank", "vec_id", "score")) == want


# ---- 5 token files ----


def test_token_files_round_trip(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    rows = [(20, "Hello, World... can't DON'T. éÉ <|endoftext|>. <|ENDOFTEXT|> a...,, x!? 3.14, foo*. İstanbul ΣΑΣ. 'tis", "", "", 0), (21, "Σ. ﬁ, ½, 中文。 x.é!", "", "", 0)]
    rows += [(22, "J\u030cX H\u0331. T\u0308, W\u030aA Y\u030a É E\u0301A", "", "", 0)]  # composed in one case only
    docs = odd_docs(spark, [*ROWS, *rows])
    folder = tokenfile.dataset_folder(spark, "test")
    tokenfile.write_tokens(docs, folder, path, segment_tokens=500)
    files = spark.read.parquet(folder)
    got = sorted(rows_of(tokenfile.read_documents(files), "start", "doc_id", "n_tokens", "ids_crc32"))
    digest = dict(rows_of(docs.select("text", F.xxhash64(F.coalesce("text", F.lit("")))).distinct(), "*"))
    order = sorted([*ROWS, *rows], key=lambda r: (r[0] is not None, r[0] or 0, digest[r[1]]))
    at = 0
    for r, g in zip(order, got, strict=True):
        ids = [*plain.encode(r[1] or "", add_special_tokens=False).ids, 1]
        assert g == (at, r[0], len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    stream = [i for r in order for i in [*plain.encode(r[1] or "", add_special_tokens=False).ids, 1]]
    asked = spark.createDataFrame([(p,) for p in (0, 1, len(stream) // 2, len(stream) - 1, len(stream), -1, None, 1)], "position long")
    assert dict(rows_of(tokenfile.tokens_at(files, asked), "position", "token")) == {p: stream[p] for p in (0, 1, len(stream) // 2, len(stream) - 1)}
    s = tokenfile.Segment(files.first().payload)
    assert [s.token(i) for i in range(s.n_tokens)] == s.tokens().tolist()


def test_other_tokenizers_take_whole_texts(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    rows = [(i, t, "", "", 0) for i, t in enumerate(["Hello  World\n\nIt's 3.14", " a b", "", None, "tabs\tand lines\n"])]
    folder = tokenfile.dataset_folder(spark, "test")
    tokenfile.write_tokens(odd_docs(spark, rows), folder, path)
    got = dict(rows_of(tokenfile.read_documents(spark.read.parquet(folder)), "doc_id", "ids_crc32"))
    for i, text, *_ in rows:
        assert got[i] == zlib.crc32(np.array([*plain.encode(text or "", add_special_tokens=False).ids, 1], "<u4").tobytes())


def test_codes_of_any_width():
    ids = np.array([0, 255, 256, 65535, 65536, 1 << 24, (1 << 32) - 1] * 300)
    s = tokenfile.Segment(tokenfile.pack([5, None], np.array([7, len(ids) - 7]), ids))
    assert s.doc_ids == [5, None] and len(s.levels) == 4
    assert s.tokens().tolist() == ids.tolist() == [s.token(i) for i in range(len(ids))]


# ---- 6 URL rules ----


def test_url_rules_match_brute_force(spark):
    rng = random.Random(6)
    hosts = ["com", "a.com", "b.a.com", "xa.com", "net", "c.net", "", "A.com"]
    paths = ["", "/", "/en/", "/en/7", "/e"]
    rules = [(rng.choice(hosts).lower(), rng.choice(paths), rng.choice(["allow", "block"])) for _ in range(14)] + [(None, "/", "block")]
    urls = [None, "", "no scheme", "http://", "http://a.com", "ftp://B.A.com/en/7?x#y", "x://y://z/en/"]
    urls += ["http://com\x01evil/en/", "http://a.com\x02/en/", "http://\x01.com/en/7", "http://com\x03\x031/en/"]
    urls += [f"http://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', '?q=://e', '#f', '8/z'])}" for _ in range(200)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("x"))
    unique = {}
    for h, p, verdict in rules:
        if h is not None:
            unique[h, p] = min(verdict, unique.get((h, p), verdict))
    want = set()
    for i, u in enumerate(urls):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fits = [(len(h + p), -len(h), h + p, x) for (h, p), x in unique.items() if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=None)
        want.add((i, host, path, best[2] if best else None, best[3] if best else "allow"))
    got = urlfilter.filter_urls(pages, spark.createDataFrame(rules, "host string, path string, verdict string"), ranges=7)
    assert set(rows_of(got, "page_id", "host", "path", "rule", "verdict")) == want
    assert urlfilter.filter_urls(pages.limit(0), spark.createDataFrame(rules, "host string, path string, verdict string")).count() == 0


# ---- 7 chat ----


def test_rotation_matches_brute_force(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 2, " ", "tie"), (1, None, "ann", "last"), (None, 0, "ann", "x"), (None, 0, "ann", "x"), (2, 0, "system", "alone")]
    rows += [(3, i, ["ann", "bob", "cid"][i % 3], f"t{i}") for i in range(500)]
    rows += [(-(1 << 63), (1 << 63) - 1, "ann", "far"), (-(1 << 63), None, "bob", "farther"), (4, 1, "ann", "first")]
    rows += [(4, None, ["ann", "bob"][i % 2], f"unnumbered text {i % 7}") for i in range(60)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segment", F.lit("clash")).repartition(4)
    got = defaultdict(list)
    for r in chat.rotate(df).collect():
        got[r.conv_id, r.perspective].append(r)
    talks = defaultdict(list)
    for c, t, who, text in rows:
        talks[c].append((t if t is not None else math.inf, (who or "").strip() or "unknown", text or ""))
    assert set(got) == {(c, w) for c, ts in talks.items() for _, w, _ in ts if w != "system"}
    for (c, me), out in got.items():
        whole = ""
        for (_, who, text), r in zip(sorted(talks[c]), sorted(out, key=lambda r: (r.char_start, r.char_end)), strict=True):
            role = "system" if who == "system" else "assistant" if who == me else "user"
            head = f"<|im_start|>{role}{' name=' + who if role == 'user' else ''}\n"
            assert (r.role, r.segment, r.char_start) == (role, f"{head}{text}<|im_end|>\n", len(whole))
            whole += r.segment
            assert r.char_end == len(whole)
            assert whole[r.loss_start : r.loss_end] == f"{text}<|im_end|>" if role == "assistant" else r.loss_start is None
    assert chat.rotate(df.limit(0)).count() == 0


# ---- 8 packing ----


def brute_fit(sizes, sources, clusters, capacity):
    bins, out = [], []
    for size, s, c in zip(sizes, sources, clusters, strict=True):
        fits = [(b["room"], i) for i, b in enumerate(bins) if b["room"] >= size and b["room"] > 0 and s not in b["s"] and c not in b["c"]]
        i = min(fits)[1] if fits else len(bins)
        if not fits:
            bins.append({"room": capacity, "s": set(), "c": set()})
        out.append((i, capacity - bins[i]["room"]))
        bins[i]["room"] -= size
        bins[i]["s"] |= {s} - {None}
        bins[i]["c"] |= {c} - {None}
    return out


def test_best_fit_matches_brute_force():
    rng = random.Random(8)
    for _ in range(30):
        n = rng.randint(0, 80)
        sizes = sorted((rng.randint(1, 100) for _ in range(n)), reverse=True)
        sources, clusters = ([rng.choice([None, "a", "b", "c", "d", "e"]) for _ in range(n)] for _ in range(2))
        assert list(zip(*packing.best_fit(sizes, sources, clusters, 100), strict=True)) == brute_fit(sizes, sources, clusters, 100)


def test_bins_keep_their_limits(spark):
    docs = odd_docs(spark)
    got = packing.pack_documents(docs, capacity=64).collect()
    assert sorted(map(str, got)) == sorted(map(str, packing.pack_documents(docs.repartition(7), capacity=64).collect()))
    bins = defaultdict(list)
    for r in got:
        assert (r.bin_id is None) == (r.size == 0)
        if r.bin_id is not None:
            bins[r.bin_id].append(r)
    for b in bins.values():
        b.sort(key=lambda r: r.bin_offset)
        assert sum(r.size for r in b) <= 64 and all(x.bin_offset + x.size == y.bin_offset for x, y in zip(b, b[1:], strict=False))
        named = [r.source for r in b if r.source is not None]
        assert len(named) == len(set(named))
    assert sum(r.size for r in got) == sum(len(words(r[1])) for r in ROWS)
    assert packing.pack_documents(no_docs(spark)).count() == 0


# ---- 9 shards ----


def test_shards_compact_and_commit(spark):
    store = shards.Shards(spark, tokenfile.dataset_folder(spark, "shards"), target_bytes=60_000, least_bytes=2000, fanout=3)
    docs = odd_docs(spark)
    assert store.version() == 0 and store.compact() == 0
    for part in shards.arrivals(docs, "doc_id", 5):
        store.append(part)
        before = store.version()
        old = store.read(before).count()
        store.compact()
        assert store.read().count() == old and store.read(before).count() == old  # an older version still reads
    assert sorted(map(str, store.read().collect())) == sorted(map(str, docs.collect()))
    tiers = {r.tier: r.n for r in store.manifest().groupBy("tier").agg(F.count("*").alias("n")).collect()}
    assert all(n < 3 for tier, n in tiers.items() if tier >= 0)
    total = store.manifest().agg(F.sum("rows")).first()[0]
    assert total == len(ROWS)
    store.vacuum()
    assert store.read().count() == len(ROWS)


def test_two_writers_cannot_make_one_version(spark):
    store = shards.Shards(spark, tokenfile.dataset_folder(spark, "shards"))
    store.append(odd_docs(spark))
    # both have looked and found version 1; the second may not replace what the first makes
    assert store._publish(2, store._changes(1)) and not store._publish(2, []) and store.version() == 2
    assert store.read().count() == len(ROWS)
    store.append(odd_docs(spark))  # on top of it
    assert store.version() == 3 and store.read().count() == 2 * len(ROWS)
    runs = [r.run for r in store.manifest().collect()]
    store._new_run(odd_docs(spark), store.manifest(), runs)
    with pytest.raises(RuntimeError, match="another writer"):
        store._new_run(odd_docs(spark), store.manifest(3), runs)
    assert store.read().count() == len(ROWS)
    # data of a writer that hasn't committed stays, unless it died long ago
    odd_docs(spark).write.parquet(f"{store.root}/data/underway")
    store._fs.create(store._path(f"{store.root}/pending/underway"), False).close()
    assert store.vacuum() == 2 and "underway" in store._listed("data")
    assert store.vacuum(grace_hours=0) == 2 and set(store._listed("data")) == {r.run for r in store.manifest().collect()}
    for _ in range(20):  # past the point where changes become a base
        store.append(odd_docs(spark))
    assert store.read().count() == 21 * len(ROWS) and len(store._changes(store.version())) <= shards.CHANGES
    empty = shards.Shards(spark, tokenfile.dataset_folder(spark, "shards"))
    empty.append(no_docs(spark))
    assert empty.manifest().agg(F.sum("rows")).first()[0] in (0, None)


# ---- 10 SimHash ----


def brute_print(text):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    g = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in g]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_golay_keys_never_miss():
    rng = random.Random(10)
    assert np.bincount(simhash.golay_index(np.arange(1 << 23))).tolist() == [2048] * 4096  # a perfect code
    for _ in range(400):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), rng.randint(0, 3)):
            y ^= 1 << b
        row, key, side = map(np.concatenate, simhash._keys(np.array([x, y], np.uint64)))
        of = lambda r, s: set(key[(row == r) & (side == s)].tolist())
        assert of(0, 0) & of(1, 1) and of(1, 0) & of(0, 1)


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(11)
    base = [rng.choice("abcdefghij") * rng.randint(1, 4) for _ in range(400)]
    rows = [(i, " ".join(base[:-1] + [f"v{i}"]) if i % 3 else " ".join(rng.choice(base) for _ in range(40)), "", "", 0) for i in range(90)]
    rows += [(100, rows[1][1], "", "", 0), *ROWS]
    got = simhash.near_duplicates(odd_docs(spark, rows)).collect()
    prints = [(r[0], brute_print(r[1])) for r in rows]
    root = {p: p for _, p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for a, b in combinations(list(root), 2):
        if bin(a ^ b).count("1") <= 3:
            root[find(a)] = find(b)
    least = {}
    for i, p in prints:
        if i is not None:
            least[find(p)] = min(i, least.get(find(p), i))
    want = sorted((str(i), f"{p:016x}", str(least.get(find(p)))) for i, p in prints)
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == want
    kept = simhash.one_of_each(odd_docs(spark, rows))
    assert kept.count() == len({find(p) for _, p in prints}) and kept.columns == odd_docs(spark).columns
    assert simhash.near_duplicates(no_docs(spark)).count() == 0 and simhash.one_of_each(no_docs(spark)).count() == 0


def test_near_copies_match_brute_force(spark):
    """The pipeline's stage: all pairs of documents at 0.8 and over are linked, and none below."""
    import corpus_pipeline

    rng = random.Random(12)
    rows = []
    for n in (3, 5, 6, 9, 13, 14, 29, 60, 200):
        base = [f"w{rng.randint(0, 10**6)}" for _ in range(n)]
        for edits in (0, 0, 1, 1, 2, 3, 4, 6):
            text = list(base)
            for _ in range(edits):
                text[rng.randrange(n)] = f"x{rng.randint(0, 10**6)}"
            rows.append((len(rows), " ".join(text).upper() if edits == 1 else " ".join(text), "", "", 0))
            rows.append((len(rows), " ".join(text[: max(1, n - edits)]), "", "", 0))
    common = " ".join(f"common{i}" for i in range(12))
    rows += [(1000 + i, f"{common} own{i} of{i} this{i} text{i} here{i} and{i}", "", "", 0) for i in range(40)]
    rows += ROWS
    rng.shuffle(rows)

    def shingles(text):
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return frozenset(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, min(len(w), 1))))

    sets = {s: s for s in (shingles(r[1]) for r in rows)}

    def find(s):
        while sets[s] != s:
            s = sets[s]
        return s

    linked = 0
    for a, b in combinations(list(sets), 2):
        if 9 * len(a & b) >= 4 * (len(a) + len(b)):
            linked += 1
            sets[find(a)] = find(b)
    assert linked > 40
    order = lambda r: (r[0] is not None, r[0] or 0)
    first = {}
    for r in rows:
        s = find(shingles(r[1]))
        first[s] = min(order(r), first.get(s, order(r)))
    for stage in (lambda d: shinglesets.one_of_each(d), lambda d: corpus_pipeline.near_dedup(spark, d, "")):
        kept = stage(odd_docs(spark, rows))
        assert sorted(order(r) for r in kept.collect()) == sorted(first.values()) and kept.columns == odd_docs(spark).columns
    assert shinglesets.one_of_each(no_docs(spark)).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    got = dict(rows_of(components(spark.createDataFrame(edges, "a long, b long")), "node", "root"))
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)}


def test_kept_texts_have_the_digest_of_their_words(spark):
    df = spark.createDataFrame([(1, " a\tb \n c ")], "doc_id long, text string")
    row = substring.remove_repeats(df).select(F.sha2("kept_text", 256).alias("h")).first()
    assert row.h == sha256(b"a b c").hexdigest()


def test_equal_rows_in_bulk_are_spread(spark):
    """Rows without an id that are equal in everything: a third of the table in no one group or range."""
    rows = [(None, "one two three four", None, "s", 0)] * 12_000 + [(i, f"own text {i}", None, "t", 0) for i in range(100)]
    got = packing.pack_documents(spark.createDataFrame(rows, SCHEMA).repartition(4), distinct_sources=False)
    groups = got.groupBy(F.substring_index("bin_id", "-", 1).alias("g")).count().collect()
    assert sum(r["count"] for r in groups) == 12_100 and max(r["count"] for r in groups) < 6_000
    urls = [(None, "http://www.example.com/en/7")] * 6_000 + [(i, f"http://h{i}.org/es/x") for i in range(12_000)]
    rules = spark.createDataFrame([("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("org", "/es/", "block")], "host string, path string, verdict string")
    judged = urlfilter.filter_urls(spark.createDataFrame(urls, "page_id long, url string"), rules, ranges=12)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    tasks = [r["count"] for r in judged.where("page_id is null").groupBy(F.spark_partition_id()).count().collect()]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(tasks) == 6_000 and max(tasks) < 5_000
    assert judged.groupBy("rule", "verdict").count().orderBy("rule").collect() == [("example.com/en/7", "allow", 6_000), ("org/es/", "block", 12_000)]
