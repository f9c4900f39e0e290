"""The pipeline's stages, each against brute force on its own input."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
corpus_pipeline = pytest.importorskip("corpus_pipeline")

import re  # noqa: E402

import public_tokenizers  # noqa: E402
from test_text_operators import brute_components, low  # noqa: E402

from tidemark.llm import line_dedup  # noqa: E402
from tidemark.llm.encoding import encoder  # noqa: E402

DATA = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    given, columns = docs.toPandas().sort_values("doc_id"), docs.columns
    outs = []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, DATA).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        outs.append(docs.toPandas())
    toxic, lines, near, clean, packed = outs
    assert all(list(x.columns) == columns for x in outs[:4])
    assert 0.7 * len(given) < len(toxic) < len(given)

    # Repeated lines, equal ones and those at distance 1, go.
    first, gone = {}, {}
    for r in toxic.sort_values("doc_id").itertuples():
        gone[r.doc_id] = set()
        for i, x in enumerate(r.text.split("\n")):
            form = line_dedup.normal_form(x.encode())
            # Deletions of forms of 20 characters or more, and each form itself.
            close = {form} | ({("-", form[:j] + form[j + 1 :]) for j in range(len(form))} | {("-", form)} if len(form) >= 20 else set())
            if form and close & first.keys():
                gone[r.doc_id].add(i)
            first |= dict.fromkeys(close)
    left = {r.doc_id: "\n".join(x for i, x in enumerate(r.text.split("\n")) if i not in gone[r.doc_id]) for r in toxic.itertuples()}
    assert {r.doc_id: r.text for r in lines.itertuples()} == {k: t for k, t in left.items() if not gone[k] or t.strip()}

    rows = lines.sort_values("doc_id").reset_index(drop=True)
    parts, _ = brute_components(rows.text.tolist())
    assert set(near.doc_id) == {rows.doc_id[i] for i in range(len(rows)) if parts[i] == i}

    words = lambda t: re.findall("[0-9a-z\x80-\U0010ffff]+", low(t))
    windows = set()
    for t in spark.read.parquet(f"{DATA}/benchmark.parquet").toPandas().text:
        w = words(t)
        windows |= {tuple(w[s : s + min(10, len(w))]) for s in range(max(1, len(w) - 9))} if w else set()
    hit = lambda w: any(tuple(w[s : s + n]) in windows for n in {len(x) for x in windows} for s in range(len(w) - n + 1))
    assert set(clean.doc_id) == {r.doc_id for r in near.itertuples() if not hit(words(r.text))}

    tokenizer = encoder(public_tokenizers.path("word_bpe_49k.json")).tokenizer
    total = sum(len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for t in clean.text)
    assert packed.length.sum() == total and packed.groupby("sequence_id").length.sum().max() <= 4096


def test_run(spark):
    assert corpus_pipeline.run(spark, DATA).count() > 0
