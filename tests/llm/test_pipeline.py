"""The stages of the pipeline, each against brute force on its own input."""

from collections import Counter

import corpus_pipeline
import numpy as np
import pytest

from trailweave.llm import exact_dedup, mixing, near_dedup, quality
from trailweave.llm.common import materialise, table


@pytest.fixture(scope="module")
def outputs(spark, sf):
    docs = table(spark, sf, "documents")
    found = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, sf), f"test-{name}")
        found[name] = docs
    return found


def rows(df):
    return Counter(tuple(r) for r in df.collect())


def test_columns_and_order(outputs):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "mixing", "packing"]
    for name in ("quality", "exact_dedup", "near_dedup", "mixing"):
        assert outputs[name].columns == outputs["documents"].columns


def test_quality_stage(spark, sf, outputs):
    scores = {r.doc_id: r.score for r in quality.op5(spark, sf).collect()}
    assert rows(outputs["quality"]) == Counter({r: n for r, n in rows(outputs["documents"]).items() if scores[r[0]] >= 0.5})


def test_exact_stage(outputs):
    last = {}
    for r in sorted(outputs["quality"].collect(), key=lambda r: r.doc_id):
        last[r.text or ""] = tuple(r)
    assert rows(outputs["exact_dedup"]) == Counter(last.values())


def test_near_stage(outputs):
    own = sorted(outputs["exact_dedup"].collect(), key=lambda r: r.doc_id)
    lists = [(r.text or "").lower().split() for r in own]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)) if w} for w in lists]
    label = list(range(len(own)))
    changed = True
    while changed:
        changed = False
        for a in range(len(own)):
            for b in range(a):
                if label[a] != label[b] and (sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])):
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    assert rows(outputs["near_dedup"]) == Counter(tuple(r) for k, r in enumerate(own) if label[k] == k)


def test_mixing_stage(spark, outputs):
    """By DuckDB's version of the mixture, over the rows of the stage before."""
    import duckdb

    con = duckdb.connect()
    near = outputs["near_dedup"].toArrow()  # noqa: F841
    con.sql("CREATE TABLE documents AS SELECT * FROM near")
    drawn = Counter(d for (d,) in con.sql(f"SELECT doc_id FROM ({mixing.mix_sql()})").fetchall())
    assert sum(drawn.values()) > len(drawn) > 0
    assert rows(outputs["mixing"]) == Counter({r: drawn[r[0]] for r in rows(outputs["near_dedup"]) if r[0] in drawn})


def test_packing_stage(outputs):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for r in outputs["mixing"].collect():
        ids = np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        want.update((r.doc_id, i) for i in range(len(ids)))
    got, sequences = Counter(), {}
    for r in outputs["packing"].collect():
        got.update((r.doc_id, i) for i in range(r.start, r.start + r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert got == want
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048 and at & (at - 1) == 0


def test_odd_rows_pass(spark, sf, clashing, empty, monkeypatch):
    """Nothing but what each stage decides changes odd rows; extra columns stay."""
    for stage in (exact_dedup.stage, near_dedup.stage):
        own = materialise(stage(spark, clashing, sf), "odd")
        assert own.columns == clashing.columns and not rows(own) - rows(clashing)
        texts = [r.text or "" for r in own.collect()]
        assert len(texts) == len(set(texts)) and set(texts) <= {r.text or "" for r in clashing.collect()}
    assert len(rows(materialise(exact_dedup.stage(spark, clashing, sf), "odd"))) == len({r.text or "" for r in clashing.collect()})
    mixed = materialise(mixing.stage(spark, clashing, sf), "odd")
    assert mixed.columns == clashing.columns and set(rows(mixed)) <= {tuple(r) for r in clashing.collect() if r.text}


def test_stages_pass_odd_and_empty_tables(spark, sf, clashing, empty):
    for docs in (clashing, empty):
        for name, stage in corpus_pipeline.STAGES:
            docs = materialise(stage(spark, docs, sf), f"odd-{name}")
