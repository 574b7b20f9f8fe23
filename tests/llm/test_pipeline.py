"""The corpus pipeline against a brute-force version of each of its stages, in their order."""

import hashlib
from collections import defaultdict

import corpus_pipeline
import numpy as np
import pytest
from test_operators import DOCS, SF, WORDS, components, documents, naive_groups, odd

from cladeworks.llm import language_id
from cladeworks.llm.queries import tokenizer_path


def naive_times(docs):
    """How often the mix takes each document: rows of a source by position until its target is met."""
    sizes, order = defaultdict(int), sorted({d["source"] for d in docs}, key=lambda s: (s is None, s or ""))
    for d in docs:
        sizes[d["source"]] += len(WORDS.findall(d["text"] or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, rest, open_ = {}, 1.5 * sum(sizes.values()), set(order)
    while open_:
        level = rest / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] >= 2 * sizes[s]}
        for s in over or open_:
            target[s] = 2 * sizes[s] if over else level * weight[s]
            rest -= target[s]
        open_ -= over or open_
    times = {}
    for s in order:
        whole = int(target[s] // sizes[s]) if sizes[s] else 0
        budget, total, full = target[s] - whole * sizes[s], 0, False
        place = lambda d: hashlib.md5((str(d["doc_id"]) + hashlib.md5((d["text"] or "").encode()).hexdigest()).encode()).hexdigest()[:15]
        for _, d in sorted((place(d), d["doc_id"]) for d in docs if d["source"] == s):
            n = len(WORDS.findall(next(x["text"] for x in docs if x["doc_id"] == d) or ""))
            extra = 0
            if not full and budget > 0:
                full = total + n > budget
                extra = int(not full or 2 * (budget - total) >= n)
                total += n
            times[d] = whole + extra
    return times


def naive_pipeline(spark, df):
    import sentencepiece

    model = language_id.train(df)
    docs = [r.asDict() for r in df.collect()]
    docs = [d for d in docs if (said := model.predict(d["text"]))[0] != "und" and said[1] >= 0.5]
    kept = {eval(x)[1] for x in naive_groups([(d["doc_id"], d["text"]) for d in docs])}
    docs = [d for d in docs if d["doc_id"] in kept]
    of = components([(d["doc_id"], d["text"]) for d in docs])
    docs = [d for d in docs if of[d["doc_id"]][1] == d["doc_id"]]
    times = naive_times(docs)
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    out = []
    for d in docs:
        ids = library.encode(d["text"], add_bos=True, add_eos=True)
        row = (d["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
        out += [row] * times[d["doc_id"]]
    return sorted(out)


def run_on(spark, df, folder):
    df.write.parquet(f"{folder}/documents.parquet")
    return corpus_pipeline.run(spark, str(folder))


def test_pipeline_matches_brute_force(spark):
    rows = corpus_pipeline.run(spark, SF).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert rows and sorted(map(tuple, rows)) == naive_pipeline(spark, documents(spark))


def test_pipeline_on_odd_rows(spark, tmp_path):
    rows = run_on(spark, odd(spark), tmp_path / "odd").collect()
    letters = {r.doc_id for r in odd(spark).collect() if r.text and any(c.isalpha() for c in r.text)}
    assert rows and {r.doc_id for r in rows} <= letters


@pytest.mark.parametrize("columns", [["doc_id", "text", "lang", "source", "n_chars"], DOCS.replace(" long", "").replace(" string", "").split(", ")])
def test_pipeline_on_an_empty_table(spark, tmp_path, columns):
    assert run_on(spark, odd(spark).limit(0).select(columns), tmp_path / "none").count() == 0


def test_all_but_the_last_stage_keep_the_columns(spark):
    docs = documents(spark).limit(60)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == corpus_pipeline.COLUMNS, name
