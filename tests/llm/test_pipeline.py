import hashlib
import os
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from test_duplicates import groups_by_hand
from tokenizers import Tokenizer

import corpus_pipeline
from lumirank.llm import mixing, quality, queries
from lumirank.llm.common import ASCII_LOWER, read_table
from lumirank.plans.scratch import scratch_table


def test_stages_of_awkward_rows(spark, docs, no_docs, tmp_path):
    spark.createDataFrame([(1, 1, 0), (3, 0, 0), (8, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for start in (docs, no_docs):
        table = start
        for name, stage in corpus_pipeline.STAGES:
            before = table
            table = scratch_table(stage(spark, table, str(tmp_path)), name)
            if name != "encoded":
                assert table.columns == before.columns
        assert table.select("doc_id", "n_tokens", "token_ids").count() <= 3 * start.count()


def test_every_operator_has_a_query():
    assert [int(n[2:].split("_")[0]) for n in queries.queries()] == list(range(1, 14))


FOLDER = "/root/testdata/sf0.001"


def plain(table):
    return [(r["doc_id"], r["text"], r["source"]) for r in table.select("doc_id", "text", "source").collect()]


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
def test_rows_of_every_stage(spark):
    """Each stage against plain Python over what the stage before it kept."""
    docs = read_table(spark, FOLDER, "documents")
    # Copies that differ in case, a near copy of a long text, and a text that is nothing but noise.
    rows = plain(docs)
    longest = max(rows, key=lambda r: len(r[1] or "") if len(r[1] or "") < 20_000 else 0)
    more = [(5000, longest[1].upper(), "web"), (5001, longest[1] + " one more word", "web"), (5002, None, None), (5003, "", "web")]
    docs = docs.unionByName(spark.createDataFrame([(i, t, None, s, None) for i, t, s in more], docs.schema))
    docs = scratch_table(docs, "start")
    kept, out = {"start": plain(docs)}, {"start": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = scratch_table(stage(spark, docs, FOLDER), name)
        out[name] = docs
        if name != "encoded":
            kept[name] = plain(docs)

    score = {r["doc_id"]: r["score"] for r in quality.quality_report(out["start"], read_table(spark, FOLDER, "labels")).collect()}
    good = [r for r in kept["start"] if score[r[0]] >= quality.KEEP_SCORE]
    assert Counter(kept["good_documents"]) == Counter(good) and 0.5 * len(score) < len(good) < len(score)

    of_text = defaultdict(list)
    for r in good:
        of_text[(r[1] or "").translate(ASCII_LOWER)].append(r)
    single = [max(group) for group in of_text.values()]
    assert Counter(kept["without_copies"]) == Counter(single) and len(single) < len(good)

    first = {doc_id for doc_id, _, component in groups_by_hand(single) if doc_id == component}
    apart = [r for r in single if r[0] in first]
    assert Counter(kept["without_near_copies"]) == Counter(apart) and len(apart) < len(single)

    mix = {r["doc_id"]: r for r in mixing.mix_sources(out["without_near_copies"]).collect()}
    assert set(mix) == {r[0] for r in apart}
    times = Counter(r[0] for r in kept["mixed_sources"])
    assert times == Counter({i: r["copies"] for i, r in mix.items() if r["copies"]}) and max(times.values()) <= 3
    taken, target, most = Counter(), {}, Counter()
    for doc_id, text, source in apart:
        size = len((text or "").split())
        taken[source] += size * times[doc_id]
        most[source] = max(most[source], size)
        target[source] = mix[doc_id]["target"]
    assert all(abs(taken[s] - t) <= most[s] for s, t in target.items())

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.no_truncation()
    library.no_padding()
    text_of = {r[0]: r[1] or "" for r in apart}
    ids = {i: np.array(library.encode(text_of[i], add_special_tokens=False).ids, "<u4").tobytes() for i in times}
    want = Counter({(i, len(ids[i]) // 4, hashlib.sha256(ids[i]).hexdigest()): n for i, n in times.items()})
    got = Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"]) for r in out["encoded"].drop("token_ids").collect())
    assert got == want
