"""The pipeline stage by stage against brute force."""

from __future__ import annotations

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm import DOCS, SF, brute_hits, brute_similar, check_packed, docs, empty, lower
from tokenizers import Tokenizer

from sentrylake.llm import langid, packing
from sentrylake.llm.util import crc_mod, land, table, work_dir

JUNK = ["Съешь же ещё этих мягких французских булок да выпей чаю", "int main(void) { return x[3] << 2; } /* */ #define Q(x) ((x)+1)", "@@##$$ a %% ^^&& ~~ || \\\\ q", "天地玄黄宇宙洪荒日月盈昃"]


def has_letter(t):
    return bool(t) and any(map(str.isalpha, t))


def test_stages(spark):
    """Every stage on what its predecessor kept: the table, with junk and foreign texts among it."""
    path = work_dir(spark, "pipeline-test")
    given = table(spark, SF, "documents").unionByName(docs(spark, JUNK, range(900_000, 900_000 + len(JUNK))).withColumn("lang", F.lit(None).cast("string")))
    frame = land(given, f"{path}/given")
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in frame.collect()}
        after = land(stage(spark, frame, SF), f"{path}/{name}")
        if name == "packing":
            check_packing(after.collect(), before)
            break
        assert after.columns == frame.columns
        kept = {r.doc_id for r in after.collect()}
        ids, texts = sorted(before), [before[i] for i in sorted(before)]
        if name == "language_id":
            model = langid.fit(frame, training=crc_mod(F.col("doc_id"), 4) != 2)
            assert kept == {i for i, t in before.items() if has_letter(t) and not model.predict(t)[2]}
            lettered = {i for i, t in before.items() if has_letter(t) and i < 900_000}
            assert not any(i >= 900_000 for i in kept) and len(kept) >= 0.98 * len(lettered)
        elif name == "exact_dedup":
            assert kept == {max(i for i, t in before.items() if lower(t) == x) for x in set(map(lower, before.values()))}
        elif name == "simhash":
            assert kept == {ids[k] for k in brute_similar(texts)[0]} and len(kept) < len(ids)
        elif name == "decontaminate":
            assert kept == {ids[k] for k, x in brute_hits(texts, items).items() if not x[3]} and len(kept) < len(ids)
        frame = after


def check_packing(rows, before):
    """The pieces of every document hold the ids of the tokenizers library and lie gapless in few sequences."""
    assert {r.doc_id for r in rows} == set(before)
    check_packed(rows, sum(r.length for r in rows), 1.02)  # of some 180 sequences, two more than the tokens fill
    tok, got = Tokenizer.from_file(packing.byte_bpe()[0]), {}
    for r in sorted(rows, key=lambda r: r.piece):
        got.setdefault(r.doc_id, []).extend(r.ids)
    for i, t in before.items():
        assert got[i] == [*tok.encode(t or "", add_special_tokens=False).ids, packing.END_ID]


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and sum(r.length for r in out.collect()) == sum(len(r.ids) for r in out.collect())


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_stage_edges(spark, name, stage):
    """Nulls, empty and very long texts, repeated rows, ties, an empty table, and columns with the names of helpers."""
    known = table(spark, SF, "documents").select("doc_id", "text", "lang", "source", "n_chars").filter("length(text) > 200").limit(60).collect()
    long = " ".join(r.text for r in known) * 20
    rows = [tuple(r) for r in known] + [tuple(known[0])] + [(None, known[1].text, None, None, None), (7_000_001, None, None, "s", 0), (7_000_002, "", "en", None, 0), (7_000_003, long, "en", "s", None)]
    extra = ["row", "packed", "place", "file", "digest", "gone", "group_id", "print", "bad", "hit", "spans", "order", "key", "block", "rejected", "score", "__id", "__text"]
    frame = spark.createDataFrame(rows, DOCS)
    if name != "packing":
        for c in extra:
            frame = frame.withColumn(c, F.concat(F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))))
    out = stage(spark, frame, SF)
    got = out.collect()
    if name == "packing":
        by_row = sum(r.piece == 0 for r in got)
        assert by_row == len(rows) and sum(r.length for r in got if r.doc_id == 7_000_001) == 1
        assert np.all([0 < r.length <= 1024 for r in got])
    else:
        assert out.columns == frame.columns
        assert all(r[c] == f"{c}{'-' if r.doc_id is None else r.doc_id}" for r in got for c in extra)
        kept = {r.doc_id for r in got}
        assert (7_000_001 in kept) == (name in ("simhash", "decontaminate")) and 7_000_003 in kept
        if name == "exact_dedup":
            assert len({lower(r.text) for r in got}) == len(got) and 7_000_002 in kept
        if name == "simhash":
            assert None in kept and 7_000_002 not in kept
    assert stage(spark, empty(spark), SF).count() == 0
