"""The pipeline's stages against brute-force versions on a small fixture."""

import random

import pytest

import corpus_pipeline
from millrace.llm import line_dedup, mixing, quality_rules
from millrace.llm.common import settle

from .test_line_dedup import brute as brute_lines

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8))) for _ in range(400)]
    sentence = lambda: " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(6, 20))) + "."
    rows = []
    for k in range(120):
        lines = [sentence() for _ in range(rng.randrange(3, 6))]
        if k % 10 == 3 and rows:
            lines[0] = rows[0][1].split("\n")[0]
        text = "\n".join(lines)
        if k % 15 == 7:
            text = " ".join(w + "###" for w in text.split())
        if k % 12 == 5:
            text = rows[-1][1]
        rows.append((k, text, "en", f"s{k % 4}", len(text)))
    where = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{where}/documents.parquet")
    return f"file://{where}"


def test_stages(spark, folder):
    stages = dict(corpus_pipeline.STAGES)
    assert len(stages) == 5
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    first = settle(stages["quality rules"](spark, docs, folder), "t1")
    assert first.columns == COLUMNS
    kept = {r["doc_id"] for r in quality_rules.score_quality(docs).where("kept").collect()}
    assert {r["doc_id"] for r in first.collect()} == kept and not any(k % 15 == 7 and k % 12 != 5 for k in kept)

    second = settle(stages["line dedup"](spark, first, folder), "t2")
    want = {d: t for d, t in brute_lines([(r["doc_id"], r["text"]) for r in first.collect()]).items() if t.strip()}
    assert {r["doc_id"]: r["text"] for r in second.collect()} == want and second.columns == COLUMNS
    assert all(r["n_chars"] == len(r["text"]) for r in second.collect())

    third = settle(stages["MinHash near-dedup"](spark, second, folder), "t3")
    assert third.columns == COLUMNS
    from .test_minhash import brute as brute_groups

    rows = [(r["doc_id"], r["text"]) for r in second.collect()]
    assert {r["doc_id"] for r in third.collect()} == {int(d) for d, _, c in brute_groups(rows, 5, 80) if int(d) == c}

    fourth = settle(stages["mixing sources"](spark, third, folder), "t4")
    assert fourth.columns == COLUMNS
    turns = {r["doc_id"]: int(r["taken"] / r["size"] + 0.5) for r in mixing.mix(mixing.sizes(third)).collect()}
    have = {r["doc_id"]: r["count"] for r in fourth.groupBy("doc_id").count().collect()}
    assert have == {d: n for d, n in turns.items() if n}

    last = stages["SentencePiece"](spark, fourth, folder)
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = {r["doc_id"]: r["text"] for r in fourth.collect()}
    rows = last.collect()
    assert len(rows) == fourth.count() and all(r["ids"] == sp.encode(texts[r["doc_id"]]) and r["exact"] for r in rows)


def test_run_and_empty(spark, folder, tmp_path):
    assert corpus_pipeline.run(spark, folder).count() > 0
    empty = f"file://{tmp_path}"
    spark.read.parquet(f"{folder}/documents.parquet").where("false").write.parquet(f"{empty}/documents.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0
    assert line_dedup.EDITS == 1
