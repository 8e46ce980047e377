import hashlib
import os
import re

import duckdb
import public_tokenizers
import pytest
import tiktoken
from test_mixing import plain_mix
from test_simhash import plain

import __spark_entry__ as entry
import corpus_pipeline
from nearloom.llm import bpe
from nearloom.llm.common import table

SF = "/root/testdata/sf0.001"
COLUMNS = {
    1: ["query_id", "rank", "vec_id", "score"], 2: ["vec_id", "n_links", "component_id", "kept"], 3: ["doc_id", "fingerprint", "component_id"],
    4: ["doc_id", "size", "source_size", "target", "taken"], 5: ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    6: ["doc_id", "held_out", "lang_pred", "score"], 7: ["doc_id", "held_out", "score", "predicted"], 8: ["doc_id", "held_out", "score", "predicted"],
    9: ["doc_id", "license", "dice"], 10: ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    11: ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    12: ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"],
    13: ["lang", "rank", "phrase", "a", "l", "r", "n", "score"],
}


def name_of(n):
    return next(q for q in entry.queries() if re.match(rf"op{n}_", q))


@pytest.mark.parametrize("n", COLUMNS)
def test_columns_and_rows(spark, n):
    found = entry.queries()[name_of(n)](spark, SF)
    assert set(COLUMNS[n]) <= set(found.columns)
    rows = {1: 50, 2: 500, 9: None, 12: None, 13: None}.get(n, 200)
    assert found.count() == rows if rows else found.count() > 0


@pytest.mark.parametrize("n", [4, 9, 12, 13])
def test_query_equals_sql(spark, n):
    name = name_of(n)
    con = duckdb.connect()
    for name_ in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {name_} AS SELECT * FROM '{SF}/{name_}.parquet'")
    got = entry.queries()[name](spark, SF).toPandas()
    want = con.execute(entry.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    got, want = (f[columns].sort_values(columns).reset_index(drop=True) for f in (got, want))
    assert len(got) == len(want)
    for c in columns:
        assert ((got[c] == want[c]) | (got[c].isna() & want[c].isna())).all(), c


def test_fingerprint_digits(spark):
    texts = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    for r in entry.queries()[name_of(3)](spark, SF).limit(30).collect():
        assert r.fingerprint == f"{plain(texts[r.doc_id]):016x}"


def test_pipeline_equals_plain_version(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    kept = corpus_pipeline.language_stage(spark, docs, SF)
    assert kept.columns == columns and kept.count() >= 0.97 * docs.count()
    good = corpus_pipeline.quality_stage(spark, kept, SF)
    labels = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    rows = {r.doc_id: r for r in good.collect()}
    clean = [r.doc_id for r in kept.collect() if labels.get(r.doc_id) == 1]
    assert good.columns == columns and sum(i in rows for i in clean) >= 0.97 * len(clean)
    prints = {i: plain(r.text) for i, r in rows.items()}
    place = {i: i for i in rows}
    for _ in range(10):
        place = {i: min([place[i], *(place[j] for j in rows if (prints[i] ^ prints[j]).bit_count() <= 2)]) for i in rows}
    first = [rows[i] for i in rows if place[i] == i]
    unique = corpus_pipeline.near_dedup_stage(spark, good, SF)
    assert unique.columns == columns and sorted(map(tuple, unique.collect())) == sorted(map(tuple, first))
    mixed = corpus_pipeline.mixing_stage(spark, unique, SF)
    _, taken, size, _ = plain_mix([(r.doc_id, r.text, r.lang, r.source) for r in first])
    copies = {r.doc_id: t // n + (2 * (t % n) >= n and t % n > 0) for r, t, n in zip(first, taken, size) if n}
    counted = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert mixed.columns == columns and counted == {k: v for k, v in copies.items() if v}
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    tokenizer = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for r in first:
        ids = tokenizer.encode_ordinary(r.text)
        digests = (hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest())
        want += [(r.doc_id, len(ids), *digests)] * copies.get(r.doc_id, 0)
    got = corpus_pipeline.run(spark, SF).select(*COLUMNS[5]).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_nothing_else_imports_the_subpackage():
    root = os.path.dirname(entry.__file__)
    for folder, _, names in os.walk(os.path.join(root, "nearloom")):
        if os.path.basename(folder) == "llm":
            continue
        for n in names:
            if n.endswith(".py"):
                with open(os.path.join(folder, n)) as f:
                    assert "nearloom.llm" not in f.read(), n
