"""Divergence audit, embedding near-dedup and phrase mining against brute force, on odd rows and on empty tables."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

import __spark_entry__
from factloom.llm import audit, neargraph, phrases
from tests.llm.odd import ROWS, SCHEMA, no_docs, odd_docs

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def prose(rng, n, langs=("en", "fr", None), sources=("a", "b", "c", None)):
    """Documents with frequent phrases, punctuation, capitals and letters beyond ASCII."""
    stock = ["the", "of", "New York City", "state of the art", "naïve", "Über alles", "x_y2z", "ÉTÉ", "la la la", "end.", "so, on"]
    rare = [f"w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}" for i in range(100)]
    text = lambda: " ".join(rng.choice(stock if rng.random() < 0.6 else rare) for _ in range(rng.randint(0, 60)))
    return [(i, text() if rng.random() > 0.02 else None, rng.choice(langs), rng.choice(sources), 0) for i in range(n)]


# ---- 11 divergence ----


def brute_divergence(rows, least, most):
    terms = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    docs = [(lang or "", source or "", terms.findall((text or "").translate(LOWER))) for _, text, lang, source, _ in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(t for *_, ts in own for t in set(ts))
        kept = {t for t, n in df.items() if n >= least}
        counts = defaultdict(Counter)
        for _, source, ts in own:
            counts[source].update(t for t in ts if t in kept)
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}  # noqa: B023, E731
        p, q = {s: share(c) for s, c in counts.items()}, share(sum(counts.values(), Counter()))
        for s in counts:
            pair = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in counts if o != s]
            term = [(p[s][t] - q[t], t) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, found, n in (("pair", pair, None), ("term", term, most)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, i) for i, (v, item) in enumerate(found[:n], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [audit.BLOCK_TERMS, 40])
def test_divergence_is_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(audit, "BLOCK_TERMS", block)
    monkeypatch.setattr(audit, "PASS_BYTES", 4000 if block == 40 else audit.PASS_BYTES)  # several blocks and passes
    rows = prose(random.Random(11), 300) + ROWS
    assert rows_of(audit.divergence(odd_docs(spark, rows), 5, 6)) == brute_divergence(rows, 5, 6)


def test_divergence_of_groups_without_terms_and_of_nothing(spark):
    rows = [(1, None, "en", "a", 0), (2, "12 34", "en", None, 0), (3, "", None, "b", 0)]
    got = rows_of(audit.divergence(odd_docs(spark, rows)))
    assert got == [("en", "", "pair", "a", 0, 1), ("en", "a", "pair", "", 0, 1)]
    assert audit.divergence(no_docs(spark)).count() == 0


def test_transducer_is_minimal_and_ordered():
    rng = random.Random(5)
    terms = sorted({"".join(rng.choice("abcß日") for _ in range(rng.randint(1, 7))).encode() for _ in range(500)})
    t = audit.Transducer.of(terms)
    asked = terms + [w + b"a" for w in terms] + [w[:-1] for w in terms if len(w) > 1]
    data = np.frombuffer(b"".join(asked), np.uint8)
    end = np.cumsum([len(w) for w in asked])
    at, ordinal = t.ordinals(data, end - [len(w) for w in asked], end)
    told = dict(zip(at.tolist(), ordinal.tolist(), strict=True))
    assert {i: told.get(i) for i in range(len(asked))} == {i: terms.index(w) if w in terms else None for i, w in enumerate(asked)}
    # as many states as different sets of endings
    endings = {frozenset(w[len(p) :] for w in terms if w.startswith(p)) for p in {w[:i] for w in terms for i in range(len(w) + 1)}}
    assert len(t.ends) == len(endings)


# ---- 12 embeddings ----


def brute_links(rows, least):
    usable = []
    for i, (_, label, v) in enumerate(rows):
        ok = label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)
        usable.append(np.array(v, float) / np.abs(v).max() if ok else None)
        if ok:
            usable[i] /= np.linalg.norm(usable[i])
    n = len(rows)
    alike = lambda i, j: usable[i] is not None and usable[j] is not None and rows[i][1] == rows[j][1] and len(usable[i]) == len(usable[j]) and usable[i] @ usable[j] >= least
    links = [[j for j in range(n) if j != i and alike(i, j)] for i in range(n)]
    root = list(range(n))
    changed = True
    while changed:
        changed = False
        for i in range(n):
            low = min([root[i], *(root[j] for j in links[i])])
            changed |= low < root[i]
            root[i] = low
    smallest = defaultdict(list)
    for i in range(n):
        smallest[root[i]] += [rows[i][0]] if rows[i][0] is not None else []
    out = []
    for i in range(n):
        component = min(smallest[root[i]], default=None)
        out.append((rows[i][0], len(links[i]), component, rows[i][0] == component))
    return sorted(out, key=repr)


def vectors(rng, n):
    rows, base = [], rng.normal(size=(6, 16))
    for i in range(n):
        v = base[i % 6] + rng.normal(size=16) * 0.12 if rng.random() < 0.5 else rng.normal(size=16)
        rows.append((i, int(rng.integers(0, 2)), v.tolist()))
    copy = [(n + i, 0, rows[0][2]) for i in range(40)]
    return rows + copy


@pytest.mark.parametrize("shard,part", [(500, 2000), (60, 40)])
def test_links_are_brute_force(spark, monkeypatch, shard, part):
    monkeypatch.setattr(neargraph, "SHARD", shard)
    monkeypatch.setattr(neargraph, "PART", part)
    rows = vectors(np.random.default_rng(12), 500)
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").selectExpr("*", "1 as node", "2 as v", "3 as rep", "'x' as part")
    assert rows_of(neargraph.near_vectors(df)) == brute_links(rows, 0.93)


def test_links_of_odd_vectors(spark):
    v, nan, inf = [1.0, 2.0, 3.0], float("nan"), float("inf")
    rows = [
        (1, 0, v), (1, 0, v), (2, 0, [2.0, 4.0, 6.0]), (3, 1, v), (4, None, v), (None, 0, v), (5, 0, None), (6, 0, [0.0, 0.0, 0.0]), (7, 0, [1.0, None, 3.0]),
        (8, 0, [nan, 2.0, 3.0]), (9, 0, [inf, 2.0, 3.0]), (None, 2, [1.0, 0.0]), (10, 0, [1e300, 2e300, 3e300]), (11, 0, [1e-300, 2e-300, 3e-300]),
        (12, 0, [1.0, 2.0]), (13, 0, []), (None, None, None), (-3, 0, [-0.0, 1.0, 0.0]), (-4, 0, [0.0, 1.0, 0.0]),
    ]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    expected = brute_links([r if r[2] != [] else (r[0], None, None) for r in rows], 0.93)
    expected = sorted([(i, n, c, True) if i is None and c is None else (i, n, c, k) for i, n, c, k in expected], key=repr)
    assert rows_of(neargraph.near_vectors(df)) == expected
    assert neargraph.near_vectors(df.limit(0)).count() == 0


# ---- 13 phrases ----


def brute_phrases(rows, least, best):
    f, total = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            ws = [w for w in re.split(r"[ \t]+", piece) if w]
            total[lang] += len(ws)
            for m in range(1, 6):
                f[lang].update(tuple(ws[i : i + m]) for i in range(len(ws) - m + 1))
    out = []
    for lang, counts in f.items():
        some = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        inside = lambda p, q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
        found = []
        for p, a in some.items():
            if any(len(q) > len(p) and b >= a and inside(p, q) for q, b in some.items()):
                continue
            n = total[lang]
            score, k = min((1000 * a * n // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]], n))
        for i, (score, a, phrase, left, right, n) in enumerate(sorted(found)[:best], 1):
            out.append((lang, i, phrase.decode(), -a, left, right, n, -score))
    return sorted(out, key=repr)


@pytest.mark.parametrize("partition_rows", [1 << 20, 40])
def test_phrases_are_brute_force(spark, partition_rows):
    rows = prose(random.Random(13), 500) + ROWS
    got = phrases.collocations(odd_docs(spark, rows), 12, 30, partition_rows=partition_rows)
    assert rows_of(got) == brute_phrases(rows, 12, 30)
    assert phrases.collocations(no_docs(spark)).count() == 0


def test_quicksort_counts_prefixes():
    rng = np.random.default_rng(3)
    words = rng.integers(1, 4, (400, 5)).astype(np.uint64)
    for row in words[:100]:
        row[rng.integers(2, 5) :] = 0
    weight = rng.integers(1, 4, 400)
    counts = Counter()
    for row, n in zip(words.tolist(), weight.tolist(), strict=True):
        for m in range(2, 6):
            if row[m - 1]:
                counts[tuple(row[:m])] += n
    got = {tuple(words[row, :m].tolist()): n for row, m, n in phrases.frequent_prefixes(words, weight, 9)}
    assert got == {p: n for p, n in counts.items() if n >= 9}


@pytest.mark.parametrize("name", ["op11_source_divergence", "op12_embedding_near_dedup", "op13_phrase_collocations"])
def test_registered_queries_and_sql(spark, tmp_path, name):
    """The registered query and its SQL over one small folder."""
    import duckdb

    rng = random.Random(7)
    tables = {
        "documents": spark.createDataFrame(prose(rng, 900) + ROWS, SCHEMA),
        "embeddings": spark.createDataFrame(vectors(np.random.default_rng(1), 200), "vec_id long, label int, embedding array<float>"),
    }
    con = duckdb.connect()
    for table, df in tables.items():
        df.coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{tmp_path}/{table}.parquet/*.parquet')")
    got = __spark_entry__.queries()[name](spark, str(tmp_path))
    expected = con.execute(__spark_entry__.oracle_sql()[name])
    names = [d[0] for d in expected.description]
    assert rows_of(got.select(*names)) == sorted(expected.fetchall(), key=repr)
