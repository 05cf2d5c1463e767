"""The pipeline's stages against brute force on a small table."""

import hashlib

import corpus_pipeline
from terravane.llm import ngram_join, quality_rules, secret_scan
from terravane.llm.common import documents

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = documents(spark, SF)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    quality, dedup, secrets, mix, tokens = [f for _, f in corpus_pipeline.STAGES]

    kept = quality(spark, docs, SF).cache()
    want = {r["doc_id"] for r in quality_rules.judge(docs).where("kept").collect()}
    assert {r["doc_id"] for r in kept.collect()} == want and kept.columns == docs.columns

    rows = [(r["doc_id"], r["text"]) for r in kept.collect()]
    first = dedup(spark, kept, SF).cache()
    assert sorted(r["doc_id"] for r in first.collect()) == sorted({c for _, _, c in ngram_join.brute_force(rows)})

    clean = secrets(spark, first, SF).cache()
    assert clean.count() == first.count() and clean.columns == docs.columns
    assert not [r for r in clean.collect() if secret_scan.base_spans(r["text"]) or r["n_chars"] != len(r["text"])]

    mixed = mix(spark, clean, SF).cache()
    assert mixed.columns == docs.columns and {r["doc_id"] for r in mixed.collect()} <= {r["doc_id"] for r in clean.collect()}

    out = tokens(spark, mixed, SF)
    texts = {r["doc_id"]: r["text"] for r in mixed.collect()}
    assert out.count() == mixed.count()
    assert all(r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest() for r in out.collect())


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count()


AWKWARD = "doc_id long, text string, lang string, source string, n_chars long, _k string, _i1 string, k2 string, i2 string, c0 string, _row long, _size long, size string, taken string, repeats string, spans string, id string"


def awkward(spark, rows):
    extra = [None, "x", "y", "z", "c", 1, 2, "s", "t", "u", "v", "w"]
    return spark.createDataFrame([(*r, *extra) for r in rows], AWKWARD)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_stages_on_awkward_rows(spark):
    good = " ".join(f"the word{k} of" for k in range(40))
    other = " ".join(f"and thing{k} in" for k in range(40))
    rows = [
        (1, good, "en", "a", 9), (2, good, None, None, None), (2, good, None, None, None), (None, good + " more", "en", "b", 1), (3, None, None, None, None), (4, "", "en", "a", 0), (5, " \n", None, "a", 2),
        (6, other, "en", None, 3), (7, other + f" token=abcdefgh{'9' * 12}", "en", "c", 4), (8, "long " + " ".join(f"the item{k}" for k in range(30_000)), "en", "a", 5),
    ]
    df = awkward(spark, rows)
    quality, dedup, secrets, mix, tokens = [f for _, f in corpus_pipeline.STAGES]
    kept = quality(spark, df, SF)
    assert kept.columns == list(corpus_pipeline.COLUMNS)
    assert rows_of(kept) == sorted([r for r in rows if r[1] and r[1].strip()], key=str)
    first = dedup(spark, df, SF)
    assert rows_of(first) == sorted([rows[0], rows[4], rows[5], rows[6], rows[7], rows[9]], key=str)  # 7 differs from 6 by one shingle only
    clean = dict((r["doc_id"], (r["text"], r["n_chars"])) for r in secrets(spark, df, SF).collect())
    assert clean[3] == (None, None) and clean[4] == ("", 0) and clean[7] == (other + " [SECRET]", len(other) + 9) and clean[8] == (rows[9][1], len(rows[9][1]))
    mixed = mix(spark, df, SF)
    counts = {}
    for r in rows_of(mixed):
        counts[r] = counts.get(r, 0) + 1
    assert mixed.columns == list(corpus_pipeline.COLUMNS) and set(counts) <= set(rows) and max(counts.values()) <= 4
    out = tokens(spark, df, SF).collect()
    assert len(out) == len(rows) and {r["n_tokens"] for r in out if r["doc_id"] in (3, 4)} == {0}
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, df.limit(0), SF).count() == 0


def test_run_against_the_stages_definitions(spark):
    import duckdb
    import public_tokenizers
    import tiktoken

    from terravane.llm import bpe, mixing

    docs = documents(spark, SF)
    rows = {r["doc_id"]: r for r in docs.collect()}
    judged = duckdb.sql(quality_rules.oracle_sql(table=f"'{SF}/documents.parquet'")).df()
    kept = judged[judged["kept"]]["doc_id"].tolist()
    first = {c for _, _, c in ngram_join.brute_force([(i, rows[i]["text"]) for i in kept])}
    texts = {i: rows[i]["text"] for i in sorted(first)}
    limits = secret_scan.learn(spark.createDataFrame([(t,) for t in texts.values()], "text string"))
    for i, t in texts.items():
        at, out = 0, []
        for s, e, _ in secret_scan.spans_of(t, limits):
            if s >= at:
                out += [t[at:s], "[SECRET]"]
            at = max(at, e)
        texts[i] = "".join([*out, t[at:]])
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    found = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in found} <= set(texts)
    taken = {}
    for r in found:
        raw = b"".join(x.to_bytes(4, "little") for x in enc.encode_ordinary(texts[r["doc_id"]]))
        assert (r["n_tokens"], r["ids_sha256"]) == (len(raw) // 4, hashlib.sha256(raw).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + 1
    # which documents are drawn is the mix's choice; its targets are not
    words = {i: len(t.split()) for i, t in texts.items()}
    sources = sorted({rows[i]["source"] for i in texts}, key=lambda x: (x is None, (x or "").encode()))
    sizes = [sum(words[i] for i in texts if rows[i]["source"] == s) for s in sources]
    given = spark.createDataFrame([(s, n, 1) for s, n in zip(sources, sizes, strict=True)], "src string, total long, rows long")
    targets = {r["src"]: r["target"] for r in mixing.targets(given, (5, 2, 1), 1.5, 2).collect()}
    for s in sources:
        got = sum(words[i] * n for i, n in taken.items() if rows[i]["source"] == s)
        mine = [words[i] for i in texts if rows[i]["source"] == s]
        assert abs(got - targets[s]) <= (0.005 * targets[s] if len(mine) > 20 else max(mine) / 2)
