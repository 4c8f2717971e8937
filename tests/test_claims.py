from pyspark.sql import functions as F

from factloom.operators import claims as C
from factloom.plans import evaluation as E

REPORT = """# Report

## 1. Summary

Apples are grown in many
| a table line |
cold places [1.1].

- a list item is dropped

## Key Findings

- **Pears** ripen after picking [1.2]
- short
Plain line of a list section

## Discussion

No citation here so it is not a claim.
Cited body line about quinces [9.9][1.1] and [1.1]

## 主要来源

- [1.1] skipped
"""
SOURCES = [
    ("r", 1, 1, "Apples", "http://a", "Apples are grown in cold places", None, None, "web", "ok"),
    ("r", 1, 2, "Pears", "", "pears ripen", None, "  ", "other", None),
]
SCHEMA = "run_id string, finding_index int, source_index int, title string, url string, snippet string, content string, summary string, engine string, fetch_status string"


def reports(spark, text=REPORT):
    return spark.createDataFrame([("r", text)], "run_id string, report string")


def texts(spark, *values):
    rows = [("r", i, v) for i, v in enumerate(values, 1)]
    return spark.createDataFrame(rows, "run_id string, claim_index int, text string")


def keys(spark, text):
    rows = C.parse_citations(texts(spark, text)).orderBy("position").collect()
    return [f"{r.finding_index}.{r.source_index}" for r in rows]


def test_claims_of_each_kind_of_section(spark):
    got = [(r.section, r.text) for r in C.extract_claims(reports(spark)).orderBy("claim_index").collect()]
    assert got == [
        ("1. Summary", "Apples are grown in many cold places [1.1]."),
        ("Key Findings", "Pears ripen after picking [1.2]"),
        ("Key Findings", "Plain line of a list section"),
        ("Discussion", "Cited body line about quinces [9.9][1.1] and [1.1]"),
    ]


def test_citations_in_order_once_each_with_ranges(spark):
    assert keys(spark, "a [1.1][9.9] b [01.1]") == ["1.1", "9.9"]
    assert keys(spark, "[6.1-6.3]") == ["6.1", "6.2", "6.3"]
    assert keys(spark, "[1.1-2.2]") == ["1.1", "1.2", "2.1", "2.2"]
    assert keys(spark, "[5.3-5.1] [x.y]") == []
    assert len(keys(spark, "[1.1-1.20000]")) == 20_000 and len(keys(spark, "[1.1-150.150]")) == 22_500


def test_long_ranges_stay_ranges(spark):
    """Three thousand million citations cost as much as the sources that are there."""
    many = [("r", 1, i, f"Apples {i}", "http://a", "Apples are grown in cold places", None, None, "web", "ok") for i in range(1, 4)]
    sources = spark.createDataFrame([*many, ("r", 7, 5, "Pears", "", "pears", None, None, "web", "ok"), ("s", 1, 9, "Other", "", "x", None, None, "web", "ok")], SCHEMA)
    claims = texts(spark, "Apples [1.2] and [1.1-1.3000000000] or [1.2]", "[1.1-2000.2000][1500.1-3000.4000] pears [9.9]", "[1.2-1.3]", "[0.0-9000000000000000000.9000000000000000000]")
    for given in (None, claims.withColumn("section", F.lit("s")).withColumn("line_start", F.lit(1))):
        rows = C.resolve_citations(C.parse_citations(claims), sources, given)
        got = [(r.claim_index, r.key, r.resolved, r.n) for r in rows.orderBy("claim_index", "position", "finding_index", "source_index", "key").collect()]
        assert got[:4] == [(1, "1.2", True, 1.0), (1, "1.1", True, 1.0), (1, "1.1-1.3000000000", False, 3e9 - 3), (1, "1.3", True, 1.0)]
        assert [g for g in got if g[0] == 2] == [
            (2, "1.1", True, 1.0), (2, "1.1-2000.2000", False, 2000 * 2000 + 1501 * 4000 - 501 * 2000 - 4 - 1), (2, "1.2", True, 1.0), (2, "1.3", True, 1.0),
            (2, "7.5", True, 1.0), (2, "1500.1-3000.4000", False, 0.0), (2, "9.9", False, 1.0),
        ]
        assert [g for g in got if g[0] == 3] == [(3, "1.2", True, 1.0), (3, "1.3", True, 1.0)]
        assert [g[1:3] for g in got if g[0] == 4 and g[2]] == [("1.1", True), ("1.2", True), ("1.3", True), ("7.5", True)]
    scores = {r.claim_index: r for r in C.score_claims(given, rows).collect()}
    assert scores[1].citation_keys == ["1.2", "1.1", "1.1-1.3000000000", "1.3"] and scores[1].n_citations == 3e9 and scores[1].n_resolved == 3
    assert scores[1].unresolved == ["1.1-1.3000000000"] and not scores[1].citations_resolved and scores[1].overlap == 0.5  # apples, of apples and 3000000000
    assert scores[3].citations_resolved


def test_link_text_takes_a_citation_with_it(spark):
    one = spark.createDataFrame([("r", "## Key Findings\n- [1.1] text of it [x](y)")], "run_id string, report string")
    assert C.extract_claims(one).first().text == "1.1] text of it [x"


def test_scores_and_flags(spark):
    claims = C.extract_claims(reports(spark))
    resolved = C.resolve_citations(C.parse_citations(claims), spark.createDataFrame(SOURCES, SCHEMA))
    got = {r.claim_index: r for r in C.score_claims(claims, resolved, platform="web").collect()}
    assert got[1].flags == [] and got[1].overlap > 0.2
    assert set(got[2].flags) >= {"missing_source_fields", "platform_mismatch"}
    assert got[3].flags == ["no_citation"]
    assert got[4].unresolved == ["9.9"] and "citation_unresolved" in got[4].flags


def test_verdicts(spark):
    rows = [(1, 'x {"verdict": "supported", "confidence": 1.4, "reason": " r "} y'), (2, '{"verdict": "odd"}'), (3, "none"), (4, '{"verdict": "unsupported", "confidence": "n"}')]
    got = {r.i: r for r in C.parse_verdicts(spark.createDataFrame(rows, "i int, response string")).collect()}
    assert (got[1].verdict, got[1].confidence, got[1].reason) == ("supported", 1.0, "r")
    assert got[2].parse_error == "no known verdict" and got[3].parse_error == "no JSON"
    assert got[4].confidence == 0.0


def test_health_and_metrics(spark):
    findings = spark.createDataFrame([("r", 1, "q", None), ("s", 1, "q", "boom")], "run_id string, finding_index int, question string, error string")
    found = E.evaluate_runs(reports(spark), findings, spark.createDataFrame(SOURCES, SCHEMA))
    health = {r.run_id: r for r in found["health"].collect()}
    assert health["s"].flags == "empty_sources,all_findings_failed,no_finding_sources"
    assert health["r"].ok_rate == 1.0 and health["r"].n_evidence == 2
    m = found["metrics"].first()
    assert (m.claim_count, m.claims_with_citations_rate, m.citation_resolution_rate, m.source_presence_rate) == (4, 0.75, 0.75, 0.6667)
    assert [r.claim_index for r in found["risks"].orderBy("rank").collect()] == [2, 3, 4]


def test_bullets(spark):
    text = "intro\n## One\n- a bullet that is long enough [1.1]\n* too short\n### Sub\n- another bullet of enough length"
    got = [(r.section, r.has_citation) for r in C.extract_bullet_claims(reports(spark, text)).orderBy("claim_index").collect()]
    assert got == [("One", True), ("One", False)]


def test_partitions_do_not_matter(spark):
    claims = C.extract_claims(reports(spark))
    one = claims.collect()
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    assert sorted(C.extract_claims(reports(spark)).collect()) == sorted(one)
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert claims.where(F.col("text").isNull()).isEmpty()
