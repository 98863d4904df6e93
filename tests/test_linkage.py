"""Blocking, policies, metrics, validation, sources and sinks on literal cases."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from linkweave.operators import audit, blocking, features, metrics, models, policy, sampling, sets, tfidf
from linkweave.operators.records import enrich, load_with_distractors, queries_of, targets_of
from linkweave.sources import sinks, tsv

REC = "entity_id string, business_name string, business_address string, country string"
ROWS = [
    ("S2-001", "Orelee Barbershop Inc", "1795 Westchester Dr 27262", "US"),
    ("S2-002", "Tata Motors Private Limited", "Bombay House 400001", "India"),
    ("S3-001", "Barbershop Orelee", "Westchester Dr 27262", "US"),
    ("S3-002", "Boulangerie Paris SARL", "63 Rue De Dieppe 59000", "France"),
    ("S3-003", "Unknown Corp", "", "US"),
    ("S1-101", "Orelee's Barbershop", "1795 Westchester Drive, High Point 27262", "US"),
    ("S1-102", "Tata Motors Ltd", "Mumbai 400001", "India"),
    ("S1-103", "Boulangerie Paris", "Lille 59000", "France"),
    ("S1-104", "Singleton Shop", "100 Main St", "US"),
]
LINKS = [("S1-101", "S2-001"), ("S1-101", "S3-001"), ("S1-102", "S2-002"), ("S1-103", "S3-002")]


@pytest.fixture(scope="module")
def rec(spark):
    return enrich(spark.createDataFrame(ROWS, REC)).cache()


@pytest.fixture(scope="module")
def links(spark):
    return spark.createDataFrame(LINKS, "s1_id string, target_id string")


@pytest.fixture(scope="module")
def spine(rec):
    return queries_of(rec).select(F.col("entity_id").alias("s1_id"))


def found(df):
    out: dict = {}
    for r in df.collect():
        out.setdefault(r.s1_id, set()).add(r.target_id)
    return out


def test_blocks(rec):
    q, t = queries_of(rec), targets_of(rec)
    get = lambda *b: found(blocking.candidates(q, t, list(b)))
    assert get(blocking.exact_name()) == {"S1-101": {"S2-001"}, "S1-102": {"S2-002"}, "S1-103": {"S3-002"}}
    assert "S3-001" in get(blocking.sorted_name())["S1-101"]
    assert get(blocking.postal_code())["S1-101"] >= {"S2-001", "S3-001"}
    both = get(*blocking.ensemble_blocks())
    assert all(t in both[s] for s, t in LINKS) and "S1-104" not in both
    assert found(blocking.rare_token_pairs(q, t))["S1-102"] == {"S2-002"}
    assert found(blocking.candidates(q, t, blocking.arm_c_blocks(), per_query=1))["S1-101"] == {"S2-001"}


def test_caps_and_skips(spark):
    rows = [(f"S2-{k:03}", "Same Name", "", "US") for k in range(20)] + [(f"S1-{k}", "Same Name", "", "US") for k in range(5)]
    r = enrich(spark.createDataFrame(rows, REC))
    q, t = queries_of(r), targets_of(r)
    assert found(blocking.candidates(q, t, [blocking.exact_name(3)]))["S1-0"] == {"S2-000", "S2-001", "S2-002"}
    assert blocking.candidates(q, t, blocking.capped_blocks(4)).count() == 0
    plan = blocking.candidates(q, t, [blocking.exact_name(3)])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_first_targets_of_a_query(spark):
    rows = [(f"S2-{k:03}", f"Same Name {k % 2}", "", "US") for k in range(20)] + [(f"S1-{k}", f"Same Name {k % 2}", "", "US") for k in range(5)]
    r = enrich(spark.createDataFrame(rows + rows[:3], REC))  # some targets twice
    q, t = queries_of(r), targets_of(r)
    got = blocking.candidates(q, t, blocking.engine_blocks(), per_query=3)
    assert found(got)["S1-1"] == {"S2-001", "S2-003", "S2-005"} and got.count() == 15
    assert found(blocking.candidates(q, t, [blocking.exact_name(2)]))["S1-0"] == {"S2-000", "S2-002"}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "WindowGroupLimit" in plan[plan.index("Join Inner") :]  # a hot key's targets are cut before they meet its queries


def test_pairs_meet_once(spark, rec, monkeypatch):
    """As many rows as from all hits, however cells are cut, and no shuffle of pairs."""
    rows = [(f"S{1 + k % 3}-{k}", f"Na{k % 5}me Wo{k % 7}rd", f"{k % 4} Road {10 + k % 6}/{k % 3} 27262", "US") for k in range(90)]
    r = enrich(spark.createDataFrame(rows + rows[:4], REC))
    q, t = queries_of(r), targets_of(r)
    k = tfidf.top_k(q, t, tfidf.TfidfParams(k=3)).localCheckpoint()
    monkeypatch.setattr(blocking, "SIDE", 2)
    as_set = lambda df: sorted(map(str, df.select(sorted(df.columns)).collect()))
    for blocks in (blocking.arm_c_blocks(), blocking.arm_b_blocks(2)):
        for found_too in (None, k):
            assert as_set(blocking.provenance(q, t, blocks, found_too)) == as_set(blocking.with_provenance(blocking.hits(q, t, blocks), found_too))
    plan = blocking.candidates(q, t, [blocking.exact_name(None), blocking.informative_number()])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("Join")] and "Aggregate" not in plan[: plan.index("Join")]


def test_cross_script_and_leetspeak(spark):
    rows = [("S1-1", "Kamal Rama", "12 x 110059", "India"), ("S2-1", "कमल राम", "12 x 110059", "India"), ("S1-2", "Fa5t P0int", "", "US"), ("S3-2", "Fast Point", "", "US")]
    r = enrich(spark.createDataFrame(rows, REC))
    q, t = queries_of(r), targets_of(r)
    assert found(blocking.candidates(q, t, blocking.cross_script()))["S1-1"] == {"S2-1"}
    assert found(blocking.candidates(q, t, [blocking.leetspeak_block()]))["S1-2"] == {"S3-2"}


def test_provenance_and_features(rec, links):
    q, t = queries_of(rec), targets_of(rec)
    k = tfidf.top_k(q, t, tfidf.TfidfParams(k=3))
    pairs = blocking.with_provenance(blocking.hits(q, t, blocking.arm_b_blocks()), k)
    f = {(r.s1_id, r.target_id): r for r in features.pair_features(pairs, rec).collect()}
    r = f["S1-101", "S2-001"]
    assert len(features.FEATURES) == 43 and len(features.inventory()) == 43
    assert r.name_exact_clean == 1 and r.addr_postal_match == 1 and r.source_is_s2 == 1 and r.retrieved_by_tfidf == 1 and r.tfidf_rank >= 1
    assert r.name_token_jaccard == 1 and r.country_exact_match == 1 and 0 < r.addr_token_jaccard < 1
    assert abs(r.inter_name_x_addr_jaccard - r.addr_token_jaccard) < 1e-12
    assert f["S1-101", "S3-001"].addr_numeric_exact_match == 0
    scored = models.DeterministicMatcher().transform(features.pair_features(pairs, rec))
    assert all(0 <= x.score <= 1 for x in scored.collect())
    same = features.max_difference(features.pair_features(pairs, rec), features.pair_features(pairs.repartition(7), rec)).first()
    assert same.max_abs_diff == 0.0


SCORED = "s1_id string, target_id string, score double"


def decided(spark, rows, p):
    df = spark.createDataFrame([("S1-1", t, s) for t, s in rows], SCORED)
    return [r.target_id for r in policy.decide(df, p).orderBy("rank").collect()]


def test_policies(spark):
    nan, inf = float("nan"), float("inf")
    rows = [("S2-1", 0.95), ("S2-1", 0.5), ("S3-1", 0.95), ("S1-9", 0.99), ("S2-2", nan), ("S3-2", inf), ("S3-3", 0.9)]
    assert decided(spark, rows, policy.GlobalThreshold(0.7)) == ["S2-1", "S3-1", "S3-3"]
    assert decided(spark, rows, policy.TopKThreshold(0.7, 2)) == ["S2-1", "S3-1"]
    assert decided(spark, rows, policy.TopKThreshold(0.7, 0)) == ["S2-1"]
    margin = policy.RelativeMargin(0.75, 0.80, 0.08, 3)
    assert decided(spark, [("S2-1", 0.7)], margin) == []
    assert decided(spark, [("S2-1", 0.75)], margin) == ["S2-1"]
    assert decided(spark, [("S2-1", 0.95), ("S3-1", 0.86)], margin) == ["S2-1"]
    assert decided(spark, [("S2-1", 0.95), ("S3-1", 0.90)], margin) == ["S2-1", "S3-1"]
    assert decided(spark, [(f"S2-{k}", 0.9) for k in range(6)], margin) == ["S2-0", "S2-1", "S2-2"]
    assert decided(spark, [("S2-1", 1.0), ("S2-2", 0.91), ("S2-3", 0.85)], policy.AdaptiveRatio(0.7, 0.9, 5)) == ["S2-1", "S2-2"]


def test_rescue(spark):
    spine = spark.createDataFrame([(f"S1-{k}",) for k in range(5)], "s1_id string")
    rows = [("S1-1", "S2-1", 0.6), ("S1-2", "S2-1", 0.8), ("S1-2", "S2-2", 0.77), ("S1-3", "S2-1", 0.9), ("S1-3", "S2-2", 0.89), ("S1-4", "S2-1", 0.8)]
    scored = spark.createDataFrame(rows, SCORED)
    assert {r.s1_id for r in policy.RescueTrigger().uncertain(spine, scored).collect()} == {"S1-0", "S1-1", "S1-2"}
    merged = policy.merge_rescue(scored, spark.createDataFrame([("S1-1", "S2-1", 0.9), ("S1-1", "S3-1", 0.8)], SCORED))
    got = {(r.s1_id, r.target_id): (r.score, r.origin) for r in merged.collect()}
    assert got["S1-1", "S2-1"] == (0.9, "primary") and got["S1-1", "S3-1"] == (0.8, "rescue")


@pytest.mark.parametrize("true,pred,f05", [(["a", "b"], ["a", "b", "c"], 5 / 7), (["a", "b"], ["a"], 5 / 6), (["a"], ["a", "b"], 5 / 9), (["a", "b", "c"], ["a", "d"], 5 / 11), ([], [], 1.0), ([], ["a"], 0.0)])
def test_entity_f05(spark, true, pred, f05):
    frame = lambda x: spark.createDataFrame([("S1-1", t) for t in x], "s1_id string, target_id string")
    spine = spark.createDataFrame([("S1-1",)], "s1_id string")
    assert abs(metrics.entity_scores(spine, frame(true), frame(pred)).first().f05 - f05) < 1e-9


def test_metrics(spark, rec, links, spine):
    pairs = spark.createDataFrame([("S1-101", "S2-001"), ("S1-102", "S2-002"), ("S1-102", "S3-003")], "s1_id string, target_id string")
    r = metrics.blocking_recall(links, pairs).first()
    assert (r.captured, r.recall) == (2, 0.5)
    v = metrics.blocking_volume(spine, pairs, 5).first()
    assert (v.queries, v.total, v.most, v.without, v.median) == (4, 3, 2, 2, 0.5)
    with pytest.raises(Exception, match="duplicate prediction"):
        metrics.require_unique(pairs.union(pairs)).collect()
    a = spark.createDataFrame([("S1-1", "S2-1"), ("S1-2", "S2-2")], "s1_id string, target_id string")
    b = spark.createDataFrame([("S1-1", "S2-1"), ("S1-1", "S3-1")], "s1_id string, target_id string")
    c = sets.complementarity(sets.union(a, b), a, b).first()
    assert (c.a_only, c.b_only, c.both_sets, c.missed) == (1, 1, 1, 0)
    lab = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.7, 1), (0.1, 0)], "score double, label int")
    p = metrics.pair_quality(lab).first()
    assert abs(p.average_precision - (1 / 2 + 1 / 2 * 2 / 3)) < 1e-6 and p.roc_auc == 0.75
    scores = metrics.entity_scores(spine, links, pairs)
    boot = metrics.paired_bootstrap(scores, metrics.entity_scores(spine, links, links), 50).first()
    assert boot.mean_delta > 0 and boot.low <= boot.mean_delta <= boot.high and boot.improved == 3


def test_sampling(spark):
    rows = [("S1-1", f"S2-{k}", int(k < 2), 1000, 0.0, 1 + k % 2, k % 3 == 0, False, False) for k in range(12)]
    df = spark.createDataFrame(rows, "s1_id string, target_id string, label int, tfidf_rank int, tfidf_score double, support_count int, exact_name boolean, sorted_name boolean, name_numeric boolean")
    got = sampling.sample_negatives(df, ratio=4).collect()
    assert sum(r.label == 0 for r in got) == 8 and sum(r.label for r in got) == 2
    ids = spark.createDataFrame([(f"S1-{k}",) for k in range(100)], "entity_id string")
    split = {r.entity_id: r.part for r in sampling.entity_split(ids).collect()}
    assert list(split.values()).count("validation") == 20
    assert split == {r.entity_id: r.part for r in sampling.entity_split(ids.repartition(7)).collect()}
    assert split != {r.entity_id: r.part for r in sampling.entity_split(ids, seed=1).collect()}
    small, large = ({r.entity_id for r in sampling.cohort(ids, n).collect()} for n in (10, 30))
    assert small < large
    assert sampling.id_digest(ids).first() == sampling.id_digest(ids.repartition(5)).first()
    parts = sampling.entity_split(ids)
    assert audit.leakage(parts.where("part='train'"), parts.where("part='validation'"), ids).first().clean
    with pytest.raises(Exception, match="not in the split"):
        sampling.partition_truth(spark.createDataFrame([("S1-x",)], "s1_id string"), parts).collect()


def test_models(spark):
    import random

    random.seed(0)
    rows = [(f"S1-{k // 10}", f"S2-{k}", float(y), y * 0.6 + random.random() * 0.4, random.random()) for k in range(200) for y in [k % 2]]
    df = spark.createDataFrame(rows, "s1_id string, target_id string, label double, a double, b double").cache()
    for model in (models.LogisticMatcher(rounds=20), models.BoostedMatcher(depth=3, trees=5), models.PairwiseRanker()):
        got = model.fit(df, ["a", "b"])(df)
        pos, neg = (got.where(f"label = {y}").agg(F.avg("score")).first()[0] for y in (1, 0))
        assert pos > neg
    raw = df.select(F.col("a").alias("score"), "label")
    for method in ("none", "platt", "isotonic"):
        out = models.calibrate(raw, method)(raw.select("score"))
        assert out.where("score < 0 OR score > 1").count() == 0
    s = spark.createDataFrame([(0.0,), (float("inf"),), (float("nan"),)], "x double").select(models.sigmoid(F.col("x")))
    assert [round(r[0], 4) for r in s.collect()] == [0.5, 1.0, 0.5]


def test_sources(spark, tmp_path):
    def write(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    head = "entity_id\tbusiness_name\tbusiness_address\tcountry\n"
    good = write("good.tsv", head + 'S1-001\tAcme "Corp\t123 Main St\tUS\nS1-002\tGlobex Inc\t\tIndia\n')
    assert [tuple(r) for r in tsv.read_source(spark, good, "S1-").orderBy("entity_id").collect()] == [("S1-001", 'Acme "Corp', "123 Main St", "US"), ("S1-002", "Globex Inc", "", "India")]
    for name, text, message in (
        ("comma", "entity_id,business_name\n", "comma"), ("one", "entity_id\n", "single-column"), ("cols", "a\tb\n", "mismatch"), ("empty", "", "empty"),
        ("blank", head + " \tA\tB\tC\n", "blank"), ("dup", head + "S1-1\tA\tB\tC\nS1-1\tA\tB\tC\n", "duplicate"), ("prefix", head + "S9-1\tA\tB\tC\n", "prefix"),
    ):
        with pytest.raises(tsv.SourceError, match=message):
            tsv.read_source(spark, write(name, text), "S1-")
    with pytest.raises(tsv.SourceError, match="missing"):
        tsv.read_source(spark, str(tmp_path / "none.tsv"))
    truth = write("t.tsv", "source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1, S3-1\nS1-2\t\nS1-3\tS2-2\n")
    rows = tsv.read_truth(spark, truth)
    assert {r.s1_id: r.matches for r in rows.collect()} == {"S1-1": ["S2-1", "S3-1"], "S1-2": [], "S1-3": ["S2-2"]}
    assert tsv.links_of(rows).count() == 3 and tsv.spine_of(rows).count() == 3
    for bad, message in (("S2-1,,S3-1", "empty"), ("S1-9", "first source"), ("X-1", "unknown"), ("S2-1,S2-1", "repeated")):
        with pytest.raises(Exception, match=message):
            tsv.read_truth(spark, write("b.tsv", f"source1_entity_id\tmatched_entity_ids\nS1-1\t{bad}\n")).collect()
    assert tsv.resolve_folder(["/nowhere", str(tmp_path)]) == str(tmp_path)


def test_sinks(spark, tmp_path):
    spine = spark.createDataFrame([("S1-1", 2), ("S1-2", 1), ("S1-3", 0)], "s1_id string, pos int")
    accepted = spark.createDataFrame([("S1-1", "S2-100", 0.9, 1), ("S1-1", "S3-200", 0.8, 2), ("S1-2", "S2-300", 0.7, 1)], "s1_id string, target_id string, score double, rank int")
    rows = sinks.prediction_rows(spine, accepted, "pos")
    assert [tuple(r) for r in rows.collect()] == [("S1-3", ""), ("S1-2", "S2-300"), ("S1-1", "S2-100,S3-200")]
    sinks.write_predictions(rows, str(tmp_path / "p"), files=1)
    text = next((tmp_path / "p").glob("part-*")).read_text()
    assert text.splitlines() == ["source1_entity_id\tmatched_entity_ids", "S1-3\t", "S1-2\tS2-300", "S1-1\tS2-100,S3-200"]
    profile = metrics.submission_profile(spine, accepted).first()
    assert (profile.n_0, profile.n_1, profile.n_2, profile.s2_targets, profile.s3_targets, profile.verdict) == (1, 1, 1, 2, 1, "NORMAL")
    assert audit.submission_violations(rows.toDF("s1_id", "matches"), spine).count() == 0
    bad = spark.createDataFrame([("S1-1", "S2-1,S2-1"), ("S1-1", ""), ("S1-2", "S1-1"), ("S1-9", "Q-1"), ("", "")], "s1_id string, matches string")
    assert {r.rule for r in audit.submission_violations(bad, spine).collect()} == {"blank_id", "duplicate_row", "duplicate_match", "self_match", "wrong_prefix", "missing_entity", "unknown_entity"}
    queries, path = sinks.with_chunk(spine, 3), str(tmp_path / "chunks")
    assert sinks.pending(queries, path).count() == 3
    sinks.write_chunks(queries.where("s1_id = 'S1-1'"), path)
    sinks.write_chunks(queries.where("s1_id = 'S1-1'"), path)
    assert spark.read.parquet(path).count() == 1 and sinks.pending(queries, path).count() < 3
    registry = str(tmp_path / "registry")
    for score in (0.5, 0.7):
        sinks.register(spark, registry, "run", {"k": 1}, {"f05": score})
    assert sinks.leaderboard(sinks.registered(spark, registry), "f05").first().f05 == 0.7
    assert len(sinks.file_digests(spark, str(tmp_path / "p")).first().sha256) == 64
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert {tuple(r) for r in sinks.upsert(old, spark.createDataFrame([(2, "c")], "k int, v string"), ["k"]).collect()} == {(1, "a"), (2, "c")}


def test_audits(spark, rec, links, spine):
    raw = rec.select("entity_id", "business_name", "business_address", "country")
    p = {r.source: r for r in audit.source_profile(raw).collect()}
    assert p["all"].n_rows == 9 and p["S3"].blank_addresses == 1 and p["S1"].repeated_ids == 0
    assert audit.truth_profile(spine, links).first().asDict() == {"entities": 4, "singletons": 1, "one_match": 2, "multi_match": 1, "s2_only": 1, "s3_only": 1, "both_sources": 1, "links": 4, "mean_links": 1.0}
    assert audit.link_agreement(links, raw).first().same_country == 4
    assert audit.verify_output(spine, links, targets_of(raw)).first().verdict == "PASS"
    assert audit.verify_output(spine, links.union(spark.createDataFrame([("S1-1", "S2-x")], links.schema)), targets_of(raw)).first().verdict == "FAIL"
    assert load_with_distractors(raw, spine, links.select("target_id"), 1).count() == 9
    assert [r.country for r in audit.unseen_countries(raw.where("country <> 'France'"), raw).collect()] == ["France"]


def test_stream(spark, rec, tmp_path):
    from linkweave.streaming.retrieval import run_once, stream_pairs

    (tmp_path / "in").mkdir()
    body = "".join("\t".join(r) + "\n" for r in ROWS if not r[0].startswith("S1-"))
    (tmp_path / "in" / "a.tsv").write_text("entity_id\tbusiness_name\tbusiness_address\tcountry\n" + body)
    raw = spark.createDataFrame(ROWS, REC)
    pairs = stream_pairs(queries_of(raw), tsv.stream_source(spark, str(tmp_path / "in")), [blocking.exact_name(None)])
    for _ in range(2):
        run_once(pairs, str(tmp_path / "out"), str(tmp_path / "cp"))
    assert found(spark.read.parquet(str(tmp_path / "out"))) == {"S1-101": {"S2-001"}, "S1-102": {"S2-002"}, "S1-103": {"S3-002"}}


def test_queries_are_the_same_at_any_partitioning(spark):
    from linkweave.plans import queries

    out = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        out.append(sorted(map(tuple, queries.QUERIES["g4_macro_f05"](spark, "/root/testdata/sf0.001").collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    assert out[0] == out[1]


def test_running_top_k_over_batches(spark, tmp_path):
    from linkweave.streaming.retrieval import best_so_far, running_top_k

    rng, rows = __import__("random").Random(1), []
    for part in range(3):
        some = [(f"S1-{rng.randrange(4)}", f"S2-{rng.randrange(30)}", rng.randrange(20) / 20 + 0.05) for _ in range(40)]
        spark.createDataFrame(some, "s1_id string, target_id string, score double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        rows += some
        stream = spark.readStream.schema("s1_id string, target_id string, score double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        running_top_k(stream, str(tmp_path / "out"), str(tmp_path / "cp"), 5)
    best: dict = {}
    for q, t, s in rows:
        best.setdefault(q, {})[t] = max(s, best.get(q, {}).get(t, 0))
    want = {(q, t, r + 1) for q, found in best.items() for r, (t, s) in enumerate(sorted(found.items(), key=lambda x: (-x[1], x[0]))[:5])}
    assert {(r.s1_id, r.target_id, r["rank"]) for r in best_so_far(spark, str(tmp_path / "out")).collect()} == want


def test_blocks_rank_like_the_term_join(spark):
    import random

    rng = random.Random(2)
    words = [f"w{k}" for k in range(40)]
    rows = [(f"S{1 + k % 3}-{k}", " ".join(rng.choices(words, k=5)), "", "x") for k in range(240)]
    records = enrich(spark.createDataFrame(rows, "entity_id string, business_name string, business_address string, country string"))
    q, t = queries_of(records), targets_of(records)
    p = tfidf.TfidfParams(k=7, max_df=0.5)
    vocab, tv = tfidf.fit(t, p)
    qv = tfidf.vectors(tfidf.document_terms(q, tfidf.retrieval_text()), vocab)
    old = tfidf.TARGET_BLOCK, tfidf.QUERY_BLOCK
    tfidf.TARGET_BLOCK, tfidf.QUERY_BLOCK = 16, 8
    try:
        got = sorted(map(tuple, tfidf.best_pairs(qv, tv, vocab, 7).collect()))
    finally:
        tfidf.TARGET_BLOCK, tfidf.QUERY_BLOCK = old
    assert got == sorted(map(tuple, tfidf.ranked(tfidf.similarities(qv, tv), 7).select("s1_id", "target_id", "score", "rank").collect()))


def test_cut_off_and_running_sums(spark):
    from pyspark.sql import functions as F

    from linkweave.operators import tables

    ids = [f"S2-{k}" for k in range(500)]
    df = spark.createDataFrame([(i,) for i in ids], "i string")
    old, tables.FEW = tables.FEW, 10
    try:
        for n in (1, 7, 250, 500):
            assert tables.cut_off(df, "i", n) == sorted(ids)[n - 1]
        assert tables.cut_off(df, "i", 501) is None
    finally:
        tables.FEW = old
    rows = spark.range(1000).select((F.col("id") / 7).alias("v"), F.col("id").alias("a"))
    for r in tables.running_down(rows, "v", ["a"]).collect():
        assert r.run_a == sum(range(r.a, 1000)) and r.all_a == sum(range(1000))


def test_reports_and_chunk_checks(spark, tmp_path):
    from linkweave.sources import sinks
    from linkweave.sources.tsv import SOURCE_COLUMNS, stream_source

    df = spark.createDataFrame([("a|b", 1.5), (None, None)], "name string, value double")
    sinks.write_report(df, str(tmp_path / "md"), "md")
    (file,) = (tmp_path / "md").glob("*.txt")
    assert file.read_text().splitlines() == ["| name | value |", "| - | - |", "| a\\|b | 1.5 |", "|  |  |"]
    for name, score in (("x", 0.5), ("y", 0.7)):
        sinks.register(spark, str(tmp_path / "runs"), name, {}, {"f": score, "r": 1 - score})
    matrix = {r.name: (r.rank_f, r.rank_r) for r in sinks.leaderboard_matrix(sinks.registered(spark, str(tmp_path / "runs")), ["f", "r"]).collect()}
    assert matrix == {"x": (2, 1), "y": (1, 2)}
    sinks.hypothesise(spark, str(tmp_path / "h"), "x", "more blocks help")
    sinks.hypothesise(spark, str(tmp_path / "h"), "x", "more blocks help", "confirmed")
    assert sinks.registered(spark, str(tmp_path / "h")).first().status == "confirmed"
    folder = tmp_path / "source"
    folder.mkdir()
    (folder / "a.tsv").write_text("\t".join(SOURCE_COLUMNS) + "\nS2-1\tn\ta\tc\nS3-1\tn\ta\tc\n")
    for prefix, fails in (("S", False), ("S2-", True)):
        stream = stream_source(spark, str(folder), prefix=prefix).writeStream.format("noop").option("checkpointLocation", str(tmp_path / f"c{fails}")).trigger(availableNow=True).start()
        try:
            stream.awaitTermination()
            assert not fails
        except Exception as e:
            assert fails and "without its prefix" in str(e)
