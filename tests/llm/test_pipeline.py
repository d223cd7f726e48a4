import os
import subprocess
import sys

import pytest

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_stages(spark, tmp_path):
    import corpus_pipeline as c
    from nestwell.llm import decontaminate, exact_dedup, near_dedup, quality

    docs, names = spark.read.parquet(f"{SF}/documents.parquet"), [n for n, _ in c.STAGES]
    assert names == ["quality", "exact", "near", "decontamination", "packing"] and c.ORACLE_SQL is None
    columns = docs.columns
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    kept = {
        "quality": lambda d: ids(quality.classify(d).where("accepted")),
        "exact": lambda d: ids(exact_dedup.exact_groups(d).where("kept")),
        "near": lambda d: ids(near_dedup.link_near(d, 0.8, 5).where("kept")),
        "decontamination": lambda d: ids(decontaminate.decontaminate(d, spark.read.parquet(f"{SF}/benchmark.parquet")).where("not contaminated")),
    }
    for name, stage in c.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if name == "packing":
            assert sorted({r.doc_id for r in out.select("doc_id").collect()}) == ids(docs)
            break
        assert out.columns == columns and ids(out) == kept[name](docs)
        docs = out
    last = c.run(spark, SF)
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, out.collect()))


def test_everything_else_works_without_the_subpackage(tmp_path):
    import shutil

    for name in ("nestwell", "__spark_entry__.py"):
        src = os.path.join(ROOT, name)
        (shutil.copytree if os.path.isdir(src) else shutil.copy)(src, tmp_path / name)
    shutil.rmtree(tmp_path / "nestwell" / "llm")
    code = "import __spark_entry__ as e; q = e.queries(); assert 'typed_range' in q and not any(k.startswith('op1') for k in q) and 'pipeline' not in q; assert set(e.oracle_sql()) == set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


def test_every_operator_is_registered():
    import __spark_entry__ as e

    names = list(e.queries())
    for n in range(1, 11):
        assert sum(k.startswith(f"op{n}_") for k in names) == 1
