"""Each stage on its own input, against plain versions; and the whole run."""

import random
from collections import Counter

import pytest

import corpus_pipeline
from siltstone.llm import decontam, mixing, near_dup, sharding
from siltstone.llm.queries import ORACLES, QUERIES

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(500)}"
    leaked = " ".join(word() for _ in range(14))
    rows, labels = [], []
    for i in range(240):
        body = [word() for _ in range(rng.randint(20, 90))]
        if i % 6 == 0:
            body = [w.upper() + "!!" for w in body[:6]] * 8
        if i % 11 == 1:
            body[5:5] = leaked.split()
        rows.append((i, " ".join(body), "en", f"s{i % 4}", None))
        if i % 3:
            labels.append((i, int(i % 6 != 0), 0))
        elif i % 6 == 0:
            labels.append((i, 0, 0))
    for i in range(240, 270):
        body = rows[i - 240][1].split()
        if i % 2:
            body[len(body) // 2] = "changed"
        rows.append((i, " ".join(body), "en", "s1", None))
    rows += [(300, None, None, None, None), (301, "", "en", "s1", 0), (None, rows[7][1], "en", "s2", 1), (8, rows[8][1], "en", "s0", None)]
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, leaked), (2, "never there at all")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """(input, output) of each stage."""
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, sf_dir).cache()
        out[name] = (docs, after)
        docs = after
    return out


def rows(df):
    return Counter(tuple(r) for r in df.select(*COLUMNS).collect())


def test_columns_and_order(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dup", "decontaminate", "mix", "shard"]
    for name, (_, after) in stages.items():
        assert after.columns == (COLUMNS if name != "shard" else [*COLUMNS, "slot", "shard"])


def test_quality_keeps_clean_documents(stages):
    before, after = stages["quality"]
    kept = {r["doc_id"] for r in after.collect()}
    good = [i for i in range(240) if i % 6]
    assert sum(i in kept for i in good) / len(good) > 0.98
    assert sum(i in kept for i in range(0, 240, 6)) <= 2
    assert not rows(after) - rows(before)


def test_one_of_each_class_stays(stages):
    before, after = stages["near_dup"]
    member = {}
    for r in near_dup.label(before).collect():
        member.setdefault(r["class_id"], set()).add(r["doc_id"])
    left = Counter(r["doc_id"] for r in after.collect())
    assert max(left.values()) == 1 and sum(left.values()) == len(member)
    for name, ids in member.items():
        assert sum(left[i] for i in ids) == 1 and left[min(i for i in ids if i is not None)] == 1


def test_leaks_go_and_nothing_else(spark, sf_dir, stages):
    before, after = stages["decontaminate"]
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").filter("item_id = 1").first()["text"].split()
    grams = {tuple(item[k : k + 10]) for k in range(len(item) - 9)}
    want = Counter()
    for r in rows(before).elements():
        w = (r[1] or "").lower().split()
        if not any(tuple(w[k : k + 10]) in grams for k in range(len(w) - 9)):
            want[r] += 1
    assert rows(after) == want and sum(want.values()) < before.count()


def test_mix_repeats_what_it_takes(stages):
    before, after = stages["mix"]
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(before).collect()}
    assert Counter(r["doc_id"] for r in after.collect()) == Counter({i: n for i, n in copies.items() if n})


def test_shards(stages):
    before, after = stages["shard"]
    assert rows(after) == rows(before)
    assert all(r["shard"] == sharding.lookup()[r["slot"]] for r in after.collect())


def test_run_is_the_chain(spark, sf_dir, stages):
    assert rows(corpus_pipeline.run(spark, sf_dir)) == rows(stages["shard"][1])
    assert corpus_pipeline.ORACLE_SQL is None and "pipeline" not in ORACLES


def test_registered_names():
    assert {f"op{n}_" for n in range(1, 14)} == {n.split("_")[0] + "_" for n in QUERIES if n != "pipeline"}


def test_stages_take_clashing_and_extra_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("*", "1 as score", "'x' as row", "2 as k1", "'y' as _text", "3 as id", "4 as copies", "5 as n_words")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and out.count() > 0, name
        assert not out.filter("score <> 1 or row <> 'x' or k1 <> 2 or _text <> 'y' or id <> 3 or copies <> 4 or n_words <> 5").count(), name
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0, name


def test_decontaminate_can_cut_spans(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    out = decontam.decontaminate(docs, bench, remove="spans")
    assert out.count() == docs.count() and decontam.scan(out, bench).filter("n_hit > 0").count() == 0
