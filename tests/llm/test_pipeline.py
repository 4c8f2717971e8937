"""The pipeline from end to end against brute force, stage by stage, and the verdict of its first stage."""

import math
import random
import re
from collections import Counter, defaultdict
from itertools import combinations
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from factloom.llm import mixing, quality, shinglesets
from tests.llm.odd import CLASHING, ROWS, SCHEMA, odd_docs, words
from tests.llm.test_operators import brute_repeats


def brute_votes(text):
    w = words(text)
    n, at, seen, dup, lines = len(w), defaultdict(list), set(), 0, 0
    for line in (text or "").split("\n"):
        if words(line):
            lines, dup = lines + 1, dup + (line in seen)
            seen.add(line)
    for i in range(n - 2):
        at[tuple(w[i : i + 3])].append(i)
    repeated = len({j for v in at.values() if len(v) > 1 for i in v for j in (i, i + 1, i + 2)})
    chars, symbols = sum(map(len, w)) / max(n, 1), len(re.findall(r"[#*$%&|<>]", text or ""))
    ends = len(re.findall(r"[.!?。！？][\"'”’)\]]*[\x20\x09-\x0D]*(?:\n|\Z)", text or ""))
    bare = sum(not re.search(r"[A-Za-zÀ-￿]", x) for x in w)
    vote = lambda good, bad: -1 if bad else 1 if good else 0
    per = max(lines, 1)
    votes = (
        vote(3 <= chars <= 10, chars < 2 or chars > 14),
        vote(symbols <= 0.02 * n, symbols > 0.1 * n),
        vote(dup <= 0.05 * per, dup > 0.3 * per and dup > 2),
        vote(repeated <= 0.1 * n, repeated > 0.3 * n),
        vote(ends >= 0.6 * per, ends < 0.1 * per),
        vote(bare <= 0.1 * n, bare > 0.4 * n),
    )
    return votes, n < 50 or 100 * repeated > 50 * n


def brute_posteriors(votes):
    """Expectation-maximisation over the rows themselves."""
    m = len(votes[0])
    clip = lambda v, kind: min(max(v, quality.START[kind][1]), quality.START[kind][2])
    p, g, b = quality.START["prior"][0], [quality.START["on_good"][0]] * m, [quality.START["on_bad"][0]] * m

    def posteriors():
        out = []
        for v in votes:
            score = math.log(p / (1 - p))
            for j, x in enumerate(v):
                score += math.log(g[j] / (1 - b[j])) if x == 1 else math.log((1 - g[j]) / b[j]) if x == -1 else 0
            out.append(1 / (1 + math.exp(-score)))
        return out

    for _ in range(30):
        post, old = posteriors(), [p, *g, *b]
        p = clip(sum(post) / len(votes), "prior")
        for j in range(m):
            said = [(q, v[j]) for q, v in zip(post, votes, strict=True) if v[j]]
            good, bad = sum(q for q, _ in said), sum(1 - q for q, _ in said)
            g[j] = clip(sum(q for q, x in said if x == 1) / good, "on_good") if good else g[j]
            b[j] = clip(sum(1 - q for q, x in said if x == -1) / bad, "on_bad") if bad else b[j]
        if max(abs(x - y) for x, y in zip(old, [p, *g, *b], strict=True)) < 1e-4:
            break
    return posteriors()


def shingles(text):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, min(len(w), 1))))


def brute_copies(spark, rows):
    """Copies of each id by the order of odds(u) / odds(p); only the random numbers come from the operator."""
    items = mixing._items(spark.createDataFrame(rows, SCHEMA), None, 100.0, F.col("doc_id"))
    drawn = items.select("doc_id", "source", "size", "w", mixing._uniform(F.col("key"), F.lit(0).cast("long"), F.lit(1)).alias("u")).collect()
    size = Counter()
    for r in drawn:
        size[r.source] += r.size
    weight = dict(zip(sorted(size), [5, 2, 1] * len(size), strict=False))
    fixed = {}
    while True:
        free = {s: w for s, w in weight.items() if s not in fixed}
        level = (sum(size.values()) - sum(fixed.values())) / sum(free.values()) if free else 0
        over = [s for s in free if free[s] * level > 3 * size[s]]
        if not over:
            break
        fixed |= {s: 3.0 * size[s] for s in over}
    copies = {}
    for source in size:
        mine, goal, ranked = [r for r in drawn if r.source == source and r.size], fixed.get(source, weight[source] * level), []
        low, high = 0.0, 1e9
        for _ in range(300):
            ratio = (low + high) / 2
            low, high = (ratio, high) if sum(r.size * min(3.0, ratio * r.w) for r in mine) < goal - 1e-9 else (low, ratio)
        for r in mine:
            e = min(3.0, ratio * r.w)
            copies[r.doc_id] = int(e + 1e-6)
            p = e - copies[r.doc_id]
            if p > 1e-6:
                ranked.append(((r.u / (1 - r.u)) / (p / (1 - p)), r.doc_id, r.size))
        rest = goal - sum(r.size * copies[r.doc_id] for r in mine)
        for _, i, n in sorted(ranked):
            if n / 2 >= rest:
                break
            copies[i], rest = copies[i] + 1, rest - n
    return {i: n for i, n in copies.items() if n}


def corpus():
    rng = random.Random(5)
    prose = lambda n: " ".join(f"{rng.choice('abcdefgh')}{rng.randint(0, 10**5)}word" + rng.choice(["", "", ".", ".\n"]) for _ in range(n)) + "."
    passage = " ".join(f"shared{i}" for i in range(60))
    rows = []

    def add(text, source):
        rows.append((len(rows), text, "en", source, len(text)))

    for i in range(40):
        add(prose(rng.randint(60, 300)), "abbcccc"[i % 7])
    for i in range(8):  # near copies: one word in about a hundred is another
        w = rows[i * 3][1].split(" ")
        w[len(w) // 2] = f"edited{i}"
        add(" ".join(w), "c")
    for i in range(6):
        add(f"{prose(70)} {passage} {prose(50)}", "ab"[i % 2])
    add(rows[1][1], "b")
    add("# $ % " * 40 + "| " * 60, "a")
    add("12 34 5 6 7 8 9 " * 20, "c")
    add("same line here\n" * 30, "b")
    add("too short", "a")
    return rows


def test_verdict_matches_brute_force(spark):
    rows = [*corpus(), *[(1000 + i, *r[1:]) for i, r in enumerate(ROWS)]]
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, SCHEMA)).collect()}
    told = [brute_votes(r[1]) for r in rows]
    for r, (_, failed), good in zip(rows, told, brute_posteriors([v for v, _ in told]), strict=True):
        assert got[r[0]].base_failed == failed and got[r[0]].quality == pytest.approx(good, abs=1e-9)
        assert got[r[0]].kept == (not failed and good >= 0.8)


def test_run_matches_brute_force(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    told = [brute_votes(r[1]) for r in rows]
    kept = [r for r, (_, failed), good in zip(rows, told, brute_posteriors([v for v, _ in told]), strict=True) if not failed and good >= 0.8]
    assert 40 <= len(kept) < len(rows) - 2

    root = {r[0]: r[0] for r in kept}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    sets = {r[0]: shingles(r[1]) for r in kept}
    for a, b in combinations(root, 2):
        if 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b])):
            low, high = sorted((find(a), find(b)))
            root[high] = low
    single = [r for r in kept if find(r[0]) == r[0]]
    assert len(kept) - len(single) >= 6

    cut = brute_repeats([(r[0], r[1]) for r in single])
    assert sum(n for _, n, _ in cut.values()) >= 200
    left = [(r[0], cut[r[0]][2] if cut[r[0]][1] else r[1], *r[2:]) for r in single]
    copies = brute_copies(spark, left)

    got = defaultdict(list)
    bins = defaultdict(list)
    scratch = Path(spark.conf.get("spark.checkpoint.dir")) / "factloom"
    there = set(scratch.glob("*"))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {p.name.split("-")[0] for p in set(scratch.glob("*")) - there} == {"pipeline"}  # no scratch table stays
    for r in rows:
        got[r.doc_id].append((r.piece, r.size))
        bins[r.bin_id].append(r)
    size = {r[0]: len(words(r[1])) for r in left}
    assert {i: Counter(p) for i, p in got.items()} == {
        i: Counter({(k, min(2048, size[i] - 2048 * k)): n for k in range(-(-size[i] // 2048))}) for i, n in copies.items()
    }
    for b in bins.values():
        assert sum(r.size for r in b) <= 2048 and len({r.source for r in b}) == len(b)
    assert not corpus_pipeline._scratch.get()


def test_stages_take_odd_rows_and_none(spark):
    for docs, rows in ((odd_docs(spark), ROWS), (odd_docs(spark, []), [])):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, "").collect()
            assert len(out) <= 3 * len(rows) and all(set(r.asDict()) == set(docs.columns) for r in out)
            assert all(r[c] == "other" for r in out for c in CLASHING)
        assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() >= len(rows)


@pytest.mark.parametrize("edits,places,kept,block", [(9, 40, 219, 1 << 20), (8, 60, 258, 1 << 20), (9, 40, 219, 20_000)])
def test_near_dedup_in_large_groups_below_the_threshold(spark, monkeypatch, edits, places, kept, block):
    """300 documents with some words changed: keys of hundreds of documents, few pairs of which reach 0.8."""
    monkeypatch.setattr(shinglesets, "BLOCK", block)
    rng = random.Random({9: 1, 8: 2}[edits])
    base = [f"b{i}" for i in range(300)]
    where, texts = rng.sample(range(300), places), []
    for _ in range(300):
        text = base[:]
        for p in rng.sample(where, edits):
            text[p] = f"e{p}"
        texts.append(" ".join(text))
    sets = [{tuple(w[k : k + 5]) for k in range(296)} for w in map(str.split, texts)]
    root = list(range(300))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(300):
        for j in range(i):
            if 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j])):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert len({find(i) for i in range(300)}) == kept
    got = shinglesets.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert dict(got.select("doc_id", "component_id").collect()) == {i: find(i) for i in range(300)}
