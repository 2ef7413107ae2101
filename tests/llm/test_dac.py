import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from graphloom.llm.dac_tokens import RunTokenizer, TokenFile, encode_file, level_widths, read_docs, write_tokens
from graphloom.llm.queries import WORD_TOKENIZER, op12_dac_tokens

SF = "/root/testdata/sf0.001"


def plain(rows, end=2):
    """(doc_id, start, tokens, crc) by the library alone; rows of one id in any order."""
    library, at, out = Tokenizer.from_file(WORD_TOKENIZER), 0, []
    for doc, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, end]
        out.append((doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


@pytest.mark.parametrize("top", [1, 2, 300, 49408, 2**24, 2**32 - 1])
def test_any_token_of_any_level(top):
    rng = np.random.default_rng(top)
    ids = ((rng.pareto(0.7, 3000) * 3).astype(np.uint64) % top).astype(np.uint32)
    file = TokenFile(encode_file([(3, ids[:10]), (None, ids[10:10]), (5, ids[10:])], 2))
    assert file.tokens().tolist() == ids.tolist() and file.docs()[0] == [3, None, 5] and file.docs()[1].tolist() == [0, 10, 10, 3000]
    assert all(file.token(int(i)) == ids[i] for i in [0, 2999, *rng.integers(0, 3000, 100)])
    for a, b in np.sort(rng.integers(0, 3001, (40, 2)), axis=1).tolist():
        assert file.tokens(a, b).tolist() == ids[a:b].tolist()
    with pytest.raises(IndexError):
        file.token(3000)


def test_a_token_costs_few_bytes_whatever_the_file():
    ids = np.random.default_rng(4).integers(0, 49408, 400_000).astype(np.uint32)
    file, read = TokenFile(encode_file([(1, ids)], 2)), []
    part = file._part
    file._part = lambda *a: (lambda x: read.append(len(x)) or x)(part(*a))
    assert file.token(399_999) == ids[-1] and sum(read) < 100 * len(file.levels)


def test_widths_are_the_best():
    ids = np.array([1] * 900 + [5000] * 90 + [40000] * 10, np.uint32)

    def cost(widths):
        rest, bits = ids.astype(np.int64), 0.0
        for k, w in enumerate(widths):
            bits += len(rest) * (w + (k + 1 < len(widths)) * (1 + 1 / 16))
            rest = rest[rest >> w > 0] >> w
        return bits

    ways = [(16,)] + [(a, 16 - a) for a in range(1, 16)] + [(a, b, 16 - a - b) for a in range(1, 15) for b in range(1, 16 - a)]
    assert cost(level_widths(ids)) <= min(map(cost, ways))


def test_runs_equal_the_library():
    tokens, library = RunTokenizer(WORD_TOKENIZER), Tokenizer.from_file(WORD_TOKENIZER)
    rng = random.Random(12)
    chars = "aabcdeehinorstTHE'  ''..,!?12½²_-#|<>\t\n\r\x0b\x0cÉéßÿŸİſŉ×÷ªº„“—…\x1c\x1f\x85\xa0\xad 　̸́ȺΣσς漢字🙂🇫🇷‍٣Ⅻ①ﬁ\x00"
    texts = ["".join(rng.choices(chars, k=rng.randint(0, 60))) for _ in range(4000)]
    texts += ["".join(rng.choices("etaoinshrdlucmf'sd .", k=80)) for _ in range(2000)]
    texts += ["a<|endoftext|>b", "<|startoftext|> <|endoftext|>", "x <|endoftext |>", "'s's't 're'LL", "", " \n", "a" * 20000, "é" * 3000 + " " * 20000 + "b", "é ́e"]
    for text in texts:
        assert np.frombuffer(tokens.ids(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text[:80]
    assert tokens.engine is not None and tokens.ids(None) == b""


def test_files_that_keep_white_space_are_refused():
    with pytest.raises(ValueError, match="white space"):
        RunTokenizer(public_tokenizers.path("byte_bpe_50k.json"))


def test_equals_the_library_over_files_and_back(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i * 3 - 50, " ".join(rng.choices(["The", "order", "Zähler", "x1", "?!", "漢字"], k=rng.randint(0, 40)))) for i in range(60)]
    rows += [(7, None), (8, ""), (11, "long " * 40_000), (None, "no id"), (14, "same"), (14, "same")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as order", "'x' as tie", "2 as name").repartition(5)
    manifest = write_tokens(df, WORD_TOKENIZER, str(tmp_path / "out"), file_tokens=300)
    assert manifest.count() > 4
    got = sorted(tuple(r)[:4] for r in read_docs(spark, str(tmp_path / "out")).collect() if r["doc_id"] is not None)
    want = plain(sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] or "")))
    by = lambda x: (x[0], x[2], x[3])  # noqa: E731  rows of one id may come in another order
    assert sorted(map(by, got)) == sorted(map(by, want))
    assert [x for x in got if x[0] not in (7, 8, 14)] == [x for x in want if x[0] not in (7, 8, 14)]
    every = read_docs(spark, str(tmp_path / "out")).orderBy("start").collect()
    assert every[-1]["doc_id"] is None and all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(every, every[1:])) and every[0]["start"] == 0


def test_many_rows_of_one_id_lie_in_several_tasks(spark, tmp_path):
    df = spark.range(4000).selectExpr("5L as doc_id", "'the same text' as text").repartition(4)
    manifest = write_tokens(df, WORD_TOKENIZER, str(tmp_path / "out"))
    assert manifest.count() >= 3
    out = read_docs(spark, str(tmp_path / "out"))
    assert out.selectExpr("count(*)", "count(distinct start)", "max(start)").head()[:] == (4000, 4000, 3999 * 4)


def test_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert write_tokens(df, WORD_TOKENIZER, str(tmp_path / "out")).count() == 0 and read_docs(spark, str(tmp_path / "out")).count() == 0


def test_query_equals_the_library(spark):
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    got = sorted(tuple(r)[:4] for r in op12_dac_tokens(spark, SF).collect())
    assert got == plain(docs)
