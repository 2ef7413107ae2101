import collections
import os

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from graphloom.llm import language_backoff, ngram_quality
from graphloom.llm.covering_simhash import fingerprint
from graphloom.llm.queries import TOKENIZER, id_crc

SF = "/root/testdata/sf0.001"


def test_stages_keep_their_contract(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("*", "'x' as dropped_id", "1.5D as score")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language", "quality", "near_dedup", "mix", "pack"]
    before = docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if name != "pack":
            assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString()
        out.write.parquet(str(tmp_path / str(k)))
        after = spark.read.parquet(str(tmp_path / str(k)))
        if name in ("language", "quality", "near_dedup"):
            assert 0.5 * before < after.count() <= before
            before = after.count()
        if name == "near_dedup":
            fps = [fingerprint(r["text"]) for r in after.collect()]
            assert all(bin(a ^ b).count("1") > 2 for i, a in enumerate(fps) for b in fps[:i])
        docs = after
    assert docs.count() > 0 and docs.groupBy("sequence_id").sum("length").where("`sum(length)` > 1024").count() == 0


def test_stages_take_odd_rows(spark, tmp_path):
    rows = [(1, None, None, None, 0), (2, "", "en", "a", None), (None, "word " * 60, "en", None, 1), (3, "word two three four " * 20, "xx", "a", 1), (3, "word two three four " * 20, "xx", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for table in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, table, SF).collect()


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 100


def test_columns_of_any_name_keep_their_values(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("*", "doc_id + 0.5D as score", "concat('v', doc_id) as lang_pred", "-doc_id as m_lang", "doc_id as copy", "doc_id as size", "doc_id as `row`")
    for name, stage in corpus_pipeline.STAGES[:4]:
        for r in stage(spark, docs, SF).collect():
            assert (r["score"], r["lang_pred"], r["m_lang"], r["copy"], r["size"], r["row"]) == (r["doc_id"] + 0.5, f"v{r['doc_id']}", -r["doc_id"], *[r["doc_id"]] * 3), name


def test_language_and_quality_stages_equal_their_rules_row_by_row(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_backoff.fit(docs, id_crc() % 3 != 1)
    want = []
    for r in docs.collect():
        letters = [w for w in (r["text"] or "").split() if language_backoff.letters(w.encode())]
        if letters:
            total = language_backoff.word_scores(model, [w.encode() for w in letters]).astype(float).sum(axis=0)
            if 1 / np.exp(total - total.max()).sum() >= 0.5:
                want.append(r["doc_id"])
    assert sorted(r["doc_id"] for r in corpus_pipeline.language_stage(spark, docs, SF).collect()) == sorted(want)

    arrays, found = ngram_quality.Meter(ngram_quality.fit(docs)).model, {}
    from tests.llm.test_quality import brute

    for r in docs.collect():
        words = ngram_quality.read_text((r["text"] or "").encode().split())
        logs, n = ngram_quality.text_logs(arrays[f"={r['lang']}"], [words]) if words else ([0.0], [1])
        found[r["doc_id"]] = (r["lang"], brute(r["text"])[-1], -logs[0] / n[0])
    kept = []
    every = [p for _, failed, p in found.values() if not failed]
    for i, (lang, failed, p) in found.items():
        own = [q for x, bad, q in found.values() if x == lang and not bad]
        own = sorted(own if len(own) >= 30 else every)
        low, mid, high = (own[max(-(-len(own) * k // 4) - 1, 0)] for k in (1, 2, 3))
        if not failed and abs(p - mid) <= 2 * max(high - low, 0.01):
            kept.append(i)
    assert sorted(r["doc_id"] for r in corpus_pipeline.quality_stage(spark, docs, SF).collect()) == sorted(kept)


def test_mix_stage_meets_the_targets_of_the_contract(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    size = lambda t: len((t or "").encode().split())
    sizes, taken, copies = collections.Counter(), collections.Counter(), collections.Counter()
    for r in docs.collect():
        sizes[r["source"]] += size(r["text"])
    for r in corpus_pipeline.mix_stage(spark, docs, SF).collect():
        taken[r["source"]] += size(r["text"])
        copies[tuple(r)] += 1
    names = sorted(sizes)
    weight = dict(zip(names, [5, 2, 1] * len(names)))
    target, open_, left = {}, set(names), 1.5 * sum(sizes.values())
    while True:
        share = {x: left * weight[x] / sum(weight[y] for y in open_) for x in open_}
        full = {x for x in open_ if share[x] >= 2 * sizes[x]}
        if not full:
            target |= share
            break
        target |= {x: 2 * sizes[x] for x in full}
        left -= sum(2 * sizes[x] for x in full)
        open_ -= full
    largest = max(size(r["text"]) for r in docs.collect())
    assert max(copies.values()) <= 2 and all(abs(taken[x] - target[x]) <= largest for x in names)


def test_pack_stage_holds_every_id_once(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    library = Tokenizer.from_file(TOKENIZER)
    want = collections.Counter()
    for r in docs.collect():
        want[r["doc_id"]] += len(library.encode(r["text"] or "", add_special_tokens=False).ids) + 1
    got = collections.Counter()
    out = corpus_pipeline.pack_stage(spark, docs, SF).collect()
    for r in out:
        got[r["doc_id"]] += r["length"]
    assert got == want and len({r["sequence_id"] for r in out}) <= -(-sum(want.values()) // 1024) + docs.rdd.getNumPartitions()


def test_run_leaves_only_its_last_result(spark):
    top = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    before = set(os.listdir(top))
    assert corpus_pipeline.run(spark, SF).count() > 0
    new = {x for x in set(os.listdir(top)) - before if x.startswith(("pipeline-", "table-"))}
    assert len(new) == 1 and os.listdir(f"{top}/{new.pop()}") == ["4"]


def test_columns_with_dots_ticks_and_maps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr(
        "*", "concat('v', doc_id) as `a.b`", "doc_id as `c``d`", "named_struct('b', -doc_id) as a", "map('k', doc_id, 'j', 1L) as m", "array(map(doc_id, 'x')) as deep", "map('k', map('i', doc_id)) as mm"
    )
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert rows, name
        for r in rows:
            i = r["doc_id"]
            assert (r["a.b"], r["c`d"], r["a"]["b"], r["m"], r["deep"], r["mm"]) == (f"v{i}", i, -i, {"k": i, "j": 1}, [{i: "x"}], {"k": {"i": i}}), name
    assert corpus_pipeline.STAGES[4][1](spark, docs, SF).count() > 0


def test_rows_with_equal_maps_are_equal(spark):
    from graphloom.llm.shared import row_hash

    df = spark.sql("select map('a', 1, 'b', 2) as m, 1 as `x.y` union all select map('b', 2, 'a', 1), 1 union all select map('b', 2, 'a', 3), 1 union all select null, 1")
    assert df.select(row_hash(df).alias("h")).distinct().count() == 3
