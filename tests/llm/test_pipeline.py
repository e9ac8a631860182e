import os

import duckdb
import pytest

import corpus_pipeline
from lithos.llm import queries
from tests.llm.test_dedup import exact_by_force, near_by_force, norm
from tests.llm.test_text import contaminated_by_force
from tests.test_queries import SF, TABLES

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_classifier", "exact_dedup", "minhash_near_dedup", "benchmark_decontamination", "best_fit_packing"]
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    quality = {r.doc_id: r.predicted for r in queries.op4_quality_classifier(spark, SF).collect()}
    wanted = {
        "quality_classifier": lambda rows: {i for i, _ in rows if quality[i]},
        "exact_dedup": lambda rows: {x[0] for x in exact_by_force(rows) if x[3]},
        "minhash_near_dedup": lambda rows: {x[0] for x in near_by_force(rows, 4) if x[3]},
        "benchmark_decontamination": lambda rows: {x[0] for x in contaminated_by_force(rows, bench) if not x[5]},
    }
    for name, stage in list(stages.items())[:-1]:
        before = rows_of(docs)
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        docs = out.cache()
        assert {i for i, _ in rows_of(docs)} == wanted[name](before), name
        assert 0 < docs.count() <= len(before)
    packed = stages["best_fit_packing"](spark, docs, SF)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {i for i, _ in rows_of(docs)}


def odd_rows(rows):
    """Rows with null and repeated ids, null and empty texts, repeats and clashing columns; the last ones are equal but for ids."""
    good = [r for r in rows if len(r[1] or "") > 300][:12]
    out = [(i, t) for i, t in good] + [(good[0][0], good[1][1]), (good[2][0], good[3][1] + " more"), (None, good[4][1]), (None, good[5][1] + " x"), (None, good[6][1]), (None, None), (10**9, None), (10**9 + 1, ""), (None, "")]
    return out + [(10**9 + 2, "v" * 300_000)]


@pytest.mark.parametrize("stage", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_judge_rows_one_by_one(spark, stage):
    """Odd rows: a stage keeps what brute force over rows, numbered apart, keeps."""
    all_rows = rows_of(spark.read.parquet(f"{SF}/documents.parquet"))
    rows = odd_rows(sorted(all_rows))
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows.append((7, bench[0][1]))
    rows.append((7, "clean words only"))
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string, predicted int, kept string, n long, id string, _rest int, _number string"
    docs = spark.createDataFrame([(i, t, "en", "s", k, "clash", 0, "clash", 0, "clash", 0, "clash") for k, (i, t) in enumerate(rows)], schema)
    out = dict(corpus_pipeline.STAGES)[stage](spark, docs, SF)
    assert out.columns == docs.columns
    got = sorted(r.n_chars for r in out.collect())
    single = {i for i, _ in rows if i is not None and sum(j == i for j, _ in rows) == 1}
    keys = [i if i in single else 2 * 10**9 + k for k, (i, _) in enumerate(rows)]
    keyed = [(i, t) for i, (_, t) in zip(keys, rows, strict=True)]
    if stage == "quality_classifier":
        scored = queries.score_quality(docs.select("doc_id", "text", "n_chars"), spark.read.parquet(f"{SF}/labels.parquet"), keep=("n_chars",))
        assert got == sorted(r.n_chars for r in scored.collect() if r.predicted)
        return
    if stage == "exact_dedup":
        groups = {}
        for k, (i, t) in enumerate(keyed):
            groups.setdefault(norm(t), []).append((i, k))
        assert len(got) == len(groups) and {norm(rows[k][1]) for k in got} == set(groups)
        assert all(min(groups[norm(rows[k][1])])[0] in single or k in [x for _, x in groups[norm(rows[k][1])]] for k in got)
    elif stage == "minhash_near_dedup":
        comp = {x[0]: x[2] for x in near_by_force(keyed, 4)}
        assert sorted(comp[keys[k]] for k in got) == sorted(set(comp.values()))
    else:
        bad = {x[0] for x in contaminated_by_force(keyed, bench) if x[5]}
        assert got == [k for k, i in enumerate(keys) if i not in bad] and keys[-2] in bad


def test_stages_of_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rel = con.execute(queries.ORACLES[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == columns
    want = sorted(repr([dict(zip(names, r, strict=True))[c] for c in columns]) for r in rel.fetchall())
    assert sorted(repr([r[c] for c in columns]) for r in df.collect()) == want


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES) - {"pipeline"}))
def test_other_queries_run(spark, name):
    table = "pages" if name.startswith("op8") else "documents"
    n = spark.read.parquet(f"{SF}/{table}.parquet").count()
    assert queries.QUERIES[name](spark, SF).count() >= n
