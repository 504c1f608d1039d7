"""The corpus pipeline: every stage on what the one before kept, with its decisions in effect."""

import re
import subprocess
import sys
from pathlib import Path

import corpus_pipeline as CP
from regtext.llm import decontam, quality
from regtext.session import materialize

from ..conftest import SF_SMALL
from .data import table
from .test_decontam import brute as leaks
from .test_linededup import brute as without_runs
from .test_mixing import brute as mixed
from .test_quality import brute as base_counts
from .test_simhash import brute_classes, brute_print


def test_stages_in_order_against_brute_force(spark):
    assert [n for n, _ in CP.STAGES] == ["quality_rules", "line_dedup", "simhash_dedup", "decontamination", "source_mix"]
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    columns, outputs = docs.columns, []
    for name, stage in CP.STAGES:
        rows = [tuple(r) for r in docs.collect()]
        out = materialize(stage(spark, docs, SF_SMALL), f"test-{name}")
        if name != "source_mix":
            assert out.columns == columns
        got = table(out)
        if name == "quality_rules":
            labels = spark.read.parquet(f"{SF_SMALL}/labels.parquet")
            cuts = quality.calibrate(quality.features(docs, ["doc_id", "lang"]), labels).collect()
            assert all(c is None for r in cuts for c in r.cut)  # too few labels here: the base rule alone decides
            assert got == sorted(repr(r) for r in rows if not base_counts(r[1])[-1])
        elif name == "line_dedup":
            texts = [t for _, t in without_runs([(r[0], r[1]) for r in rows])]
            assert got == sorted(repr((r[0], t, r[2], r[3], len(t))) for r, t in zip(rows, texts))
        elif name == "simhash_dedup":
            cls = brute_classes([brute_print(r[1]) for r in rows])
            least = {}
            for r in rows:
                c = cls[brute_print(r[1])]
                least[c] = min(r[0], least.get(c, r[0]))
            assert got == sorted(repr(r) for r in rows if least[cls[brute_print(r[1])]] == r[0])
        elif name == "decontamination":
            hit = {eval(x)[0] for x in leaks([(r[0], r[1]) for r in rows], items)}
            assert got == sorted(repr(r) for r in rows if r[0] not in hit)
        else:
            assert got == sorted(map(repr, mixed([(r[0], r[3], r[1]) for r in rows])))
        outputs.append(got)
        docs = out
    assert table(CP.run(spark, SF_SMALL)) == outputs[-1]


def test_leaks_and_junk_do_not_reach_the_mix(spark):
    kept = {r.doc_id for r in CP.run(spark, SF_SMALL).select("doc_id").distinct().collect()}
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    items = spark.read.parquet(f"{SF_SMALL}/benchmark.parquet")
    assert not kept & {r.doc_id for r in decontam.contained_items(docs, items).collect()}


def test_nothing_else_needs_this_subpackage(tmp_path):
    """With the subpackage and the pipeline away, the entry point still imports and lists the other queries."""
    root = Path(__file__).resolve().parents[2]
    for f in root.rglob("*.py"):
        rel = f.relative_to(root).as_posix()
        if not rel.startswith(("regtext/llm/", "tests/llm/")) and rel not in ("corpus_pipeline.py", "__spark_entry__.py"):
            assert not re.search(r"regtext\.llm|from \.+llm|corpus_pipeline", f.read_text()), rel
    for part in ("regtext", "__spark_entry__.py"):
        subprocess.run(["cp", "-r", str(root / part), str(tmp_path / part)], check=True)
    code = "import shutil; shutil.rmtree('regtext/llm'); import __spark_entry__ as e; q = e.queries(); " \
           "assert 'pipeline' not in q and not any(k.startswith('op') for k in q) and len(q) > 90 and e.oracle_sql()"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, timeout=120)
