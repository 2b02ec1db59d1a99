"""The pipeline against its stages done by brute force."""

import json
import os
import shutil
import subprocess
import sys

import corpus_pipeline
from idiomill.llm import decontam
from tests.llm.test_models import check_packing
from tests.llm.test_nearcopies import slow_groups

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def slow_lines(docs):
    seen, out = set(), []
    for i, t in sorted(docs):
        lines = t.split("\n")
        full = [k for k, x in enumerate(lines) if x.strip(" \t\r\f\v")]
        keys = [lines[k].strip(" \t\r\f\v") for k in full]
        gone = set()
        for k in range(len(keys) - 2):
            w = tuple(keys[k : k + 3])
            if w in seen:
                gone |= {full[j] for j in range(k, k + 3)}
            seen.add(w)
        out.append((i, "\n".join(x for k, x in enumerate(lines) if k not in gone)))
    return out


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    identified = {r.doc_id for r in corpus_pipeline.identify_language(spark, docs, sf_dir).collect()}
    left = slow_lines([(r.doc_id, r.text) for r in docs.collect() if r.doc_id in identified])
    group = slow_groups(dict(left))
    left = [(i, t) for i, t in left if group[i] == i]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    index = decontam.Index(items)
    texts = {i: t for i, t in left if not index.find(t)}
    assert {r.doc_id for r in rows} == set(texts)
    used, least = check_packing(rows, texts)
    assert used <= least + 2
    assert len(identified) >= 0.95 * docs.count()


def test_odd_rows(spark, sf_dir, tmp_path):
    """Nulls, empty tables, repeated rows and columns with the operators' own names."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, n_removed long, block string, fp long, item_id long"
    text = "the cat sat\nand the dog ran\nover the hill\n" * 3
    schema += ", `a.b` string, __id long, __t long, __gone long, __lines long, lang_pred string, t long, node long, `_0` long"
    rows = [(i, text, "en", None, 9, 0.5, 1, "b", 2, 3) for i in (1, 1, 2, None)]
    rows += [(3, None, None, None, None, None, None, None, None, None), (4, "", "en", "s", 0, None, None, None, None, None), (5, "der Hund und die Katze", "de", "s", 22, None, None, None, None, None)]
    rows = [(*r, *[None] * 9) for r in rows]
    for name, data in (("some", rows), ("none", [])):
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.read.parquet(f"{sf_dir}/benchmark.parquet").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    got = corpus_pipeline.run(spark, f"{tmp_path}/some").collect()
    assert sorted(r.doc_id for r in got) == [1, 2, 5]  # of document 2 no line is left
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    docs = spark.read.parquet(f"{tmp_path}/some/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, f"{tmp_path}/some").dtypes == docs.dtypes


def test_stage_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(50)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash", "decontamination", "packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).dtypes == docs.dtypes


def test_the_rest_imports_without_these(tmp_path):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py"))
    code = "import __spark_entry__ as e, json; print(json.dumps([sorted(e.queries()), sorted(e.oracle_sql())]))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(tmp_path / "repo")}, check=True)
    names, sql = json.loads(out.stdout.strip().splitlines()[-1])
    assert "idiom_doc_counts" in names and not [n for n in names if n.startswith("op") and n[2].isdigit()] and "pipeline" not in names
    assert set(sql) <= set(names)
