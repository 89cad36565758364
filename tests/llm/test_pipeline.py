"""The queries' contracts, their SQL, and the pipeline stage by stage against brute force."""

import hashlib
import itertools
import math
import re
import uuid
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidewater.llm import flac, linededup, queries, sharding

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(LOWER))


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_equal_their_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        db.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), db.sql(queries.ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    a, b = (x[columns].astype(str).sort_values(columns).reset_index(drop=True) for x in (got, want))
    assert a.equals(b)


def test_op3(spark, docs):
    rows = queries.QUERIES["op3_toxicity"](spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)


def test_op5(spark, docs):
    for r in queries.QUERIES["op5_flac"](spark, SF).collect():
        data = (docs[r.doc_id].text or "").encode()
        padded = data + bytes(-len(data) % 64 or (0 if data else 64))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        x = [b - 256 if b > 127 else b for b in padded]
        turns = sum((a >= 0) != (b >= 0) for a, b in itertools.pairwise(x))
        assert r.feature == f"samples={len(x)};peak={max(map(abs, x))};power={sum(b * b for b in x) // len(x)};crossings={turns}"
        (media,) = flac.encode([padded])
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())


def test_op6(spark, docs):
    rows = queries.QUERIES["op6_stratified_interleave"](spark, SF).collect()
    counts = Counter(r.shard for r in rows)
    assert set(counts) == set(range(24)) and max(counts.values()) - min(counts.values()) <= 1
    slots = defaultdict(set)
    for r in rows:
        data = (docs[r.doc_id].text or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 8, zlib.crc32(data), "rows", None)
        slots[r.shard].add(r.slot)
    assert all(s == set(range(counts[k])) for k, s in slots.items())


@pytest.mark.parametrize("bucket", [7, 10_000])
def test_op6_is_the_plain_ranking(spark, bucket):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    df = df.withColumn("source", F.when(F.col("doc_id") % 3 == 0, "hot").when(F.col("doc_id") % 17 > 0, F.col("source"))).unionAll(df.limit(20))
    text = F.coalesce("text", F.lit(""))
    seed, stratum = F.lit(sharding.SEED), F.when(F.col("source").isNull(), "-").otherwise(F.concat(F.lit("="), "source"))
    rows = df.select("doc_id", F.crc32(text.cast("binary")).alias("crc"), stratum.alias("s")).withColumns({"h": F.xxhash64(seed, "doc_id", "crc"), "shift": F.xxhash64(seed, F.lit("shift"), "s")}).collect()
    strata = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.h, r.doc_id, r.crc)):
        strata[r.s].append(r)
    placed = sorted(((k + min(r.shift / 2**64 + 0.5, 1 - 2**-53)) / len(own), s, r.h, r.doc_id, r.crc) for s, own in strata.items() for k, r in enumerate(own))
    want = Counter()
    for at, x in enumerate(placed):
        shard = at * 24 // len(rows)
        want[x[3], shard, at - (shard * len(rows) + 23) // 24] += 1
    assert Counter((r.doc_id, r.shard, r.slot) for r in sharding.interleave(df, bucket_rows=bucket).collect()) == want


def test_op3_on_held_out_labels(spark):
    """Of labelled rows that were not learned from, toxic ones are found and clean ones left."""
    top = "/root/testdata/sf0.01"
    label = {r.doc_id: r.toxic for r in spark.read.parquet(f"{top}/labels.parquet").where("toxic is not null").collect()}
    rows = [r for r in queries.QUERIES["op3_toxicity"](spark, top).collect() if r.held_out and r.doc_id in label]
    toxic, clean = [r.score for r in rows if label[r.doc_id] == 1], [r.score for r in rows if label[r.doc_id] == 0]
    assert len(toxic) >= 10 and sum(x >= 0.7 for x in toxic) >= 0.7 * len(toxic) and sum(x >= 0.7 for x in clean) <= 0.03 * len(clean)


def test_op8(spark, docs):
    tokens = {i: [*re.split(r"[\x20\x09-\x0D]+", (r.text or "").translate(LOWER).strip(" \t\n\x0b\x0c\r")), "\n"] for i, r in docs.items()}
    tokens = {i: [x for x in t if x] for i, t in tokens.items()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in docs}
    counts = Counter(x for i, t in tokens.items() if not held[i] for x in t)
    n, v = sum(counts.values()), len(counts)
    rows = queries.QUERIES["op8_maxent_lm"](spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        t = tokens[r.doc_id]
        base = sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in t)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(t), sum(counts[x] > 0 for x in t), n)
        assert abs(r.base_score - base) < 1e-6 * abs(base) and r.score < 0
    rows = [r for r in rows if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


@pytest.fixture(scope="module")
def token_ids(docs):
    """Of each document, as the tokenizer gives them, and the end id."""
    import numpy as np
    from tidewater.llm.common import tokenizer_path
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_path())
    return {i: np.array([*plain.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4") for i, r in docs.items()}


def test_op9(spark, token_ids):
    rows = queries.QUERIES["op9_swap_packing"](spark, SF).collect()
    by = defaultdict(list)
    for r in rows:
        own = token_ids[r.doc_id][r.start : r.start + r.length]
        assert r.start == 4096 * r.piece and len(own) == r.length == min(4096, len(token_ids[r.doc_id]) - r.start) and r.ids_crc32 == zlib.crc32(own.tobytes())
        by[r.sequence_id].append((r.offset, r.length))
    assert Counter(r.doc_id for r in rows) == {i: -(-len(x) // 4096) for i, x in token_ids.items()}
    for spans in by.values():
        assert all(a[0] + a[1] == b[0] for a, b in itertools.pairwise(sorted(spans))) and sorted(spans)[0][0] == 0 and sum(n for _, n in spans) <= 4096
    assert len(by) == -(-sum(map(len, token_ids.values())) // 4096)


def test_op10(spark, token_ids):
    import numpy as np
    from tidewater.llm import tokenfiles
    from tidewater.llm.common import shared_dir, table, tokenizer_path

    rows = queries.QUERIES["op10_feistel_token_files"](spark, SF).collect()
    assert sorted(r.slot for r in rows) == list(range(len(rows))) == sorted(r.sequence for r in rows)
    folder = shared_dir(spark).rstrip("/") + f"/token-all-{uuid.uuid4().hex}"
    made = tokenfiles.materialise(table(spark, SF, "documents").coalesce(1), folder, tokenizer_path()).collect()
    data = tokenfiles.read_slots(folder, 0, len(made))
    whole = np.concatenate([data[r.slot] for r in sorted(made, key=lambda r: r.sequence)])
    order = [r.doc_id for r in table(spark, SF, "documents").coalesce(1).collect()]
    assert (whole == np.concatenate([token_ids[i] for i in order])).all()
    assert Counter(i for r in made for i in r.doc_ids).keys() == token_ids.keys()


def windows(word_list, n=10):
    n = min(n, len(word_list))
    return {tuple(word_list[i : i + n]) for i in range(len(word_list) - n + 1)} if word_list else set()


def test_pipeline_stages(spark, docs, tmp_path):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    columns, out = df.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        df = stage(spark, df, SF)
        df.write.parquet(str(tmp_path / name))
        df = spark.read.parquet(str(tmp_path / name))
        out[name] = {r.doc_id: r for r in df.collect()} if name != "swap_packing" else df.collect()
        assert name == "swap_packing" or df.columns == columns
    # toxicity: what stays is unchanged
    kept = out["toxicity"]
    assert set(kept) < set(docs) and all(kept[i] == docs[i] for i in kept)
    # line dedup
    pages, seen = Counter(), Counter()
    for source, text in {(r.source, r.text) for r in kept.values()}:
        pages[source] += 1
        seen.update({(source, x.strip(" ")) for x in text.split("\n") if x.strip(" ")})
    drop = {k for k, n in seen.items() if n >= linededup.LEAST_PAGES and n > linededup.RATIO * pages[k[0]]}
    for i, r in kept.items():
        assert out["line_dedup"][i].text == "\n".join(x for x in r.text.split("\n") if (r.source, x.strip(" ")) not in drop)
        assert out["line_dedup"][i].n_chars in (r.n_chars, len(out["line_dedup"][i].text))
    # near copies: the least of each group stays
    stage, sets = out["line_dedup"], {}
    for i, r in stage.items():
        w = words(r.text)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    root = {i: i for i in stage}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(stage)
    for a in ids:
        for b in ids:
            if a < b and (sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) > 0):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert set(out["ngram_jaccard_join"]) == {find(i) for i in ids}
    # decontamination
    items = [words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = set().union(*(windows(w) for w in items))
    sizes = {len(w) for w in bad}

    def clean(text):
        w = words(text)
        return not any(tuple(w[k : k + n]) in bad for n in sizes for k in range(len(w) - n + 1))

    assert set(out["decontamination"]) == {i for i, r in out["ngram_jaccard_join"].items() if clean(r.text)}
    # packing
    last = out["swap_packing"]
    assert {r.doc_id for r in last} == set(out["decontamination"])
    bins = defaultdict(list)
    for r in last:
        bins[r.sequence_id].append((r.offset, r.length))
    for spans in bins.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(bins) == -(-sum(r.length for r in last) // 4096)


def test_copies_alone_are_no_boilerplate(spark):
    """On a site of 99 texts, 12 copies of one keep its lines; a line on 12 different pages goes."""
    texts = [f"footer\npage {i}" if i < 12 else f"page {i}" for i in range(98)] + ["copied one\ncopied two"] * 12
    rows = [(i, x, "en", "site", len(x)) for i, x in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.drop_lines(spark, df, SF).collect()}
    want = [x.removeprefix("footer\n") for x in texts]
    assert out == {i: (x, len(x)) for i, x in enumerate(want)}


def test_near_copies_with_repeated_and_null_ids(spark):
    base = [f"v{i}" for i in range(100)]
    a, near, b = " ".join(base), " ".join([*base, "more"]), "a text of its own that nothing else repeats"
    rows = [(3, a), (5, near), (5, b), (5, b), (None, near), (None, "another text of its own"), (8, None), (9, ""), (10, "...")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' as lang", "'s' as source", "'clash' as class_key", "'clash' as first")
    out = corpus_pipeline.drop_near_copies(spark, df, SF)
    assert out.columns == df.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in out.collect()) == [(0, "another text of its own"), (3, a), (5, b), (8, "")]
    assert corpus_pipeline.drop_near_copies(spark, df.limit(0), SF).count() == 0


def test_stages_on_odd_rows(spark):
    rows = [(1, None, None, None), (None, "no id here", "en", "s"), (2, "", "en", "s"), (2, "one\ntwo", None, "s"), (2, "one\ntwo", None, "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "cast(length(text) as bigint) as n_chars", "'clash' as score", "'clash' as node")
    for start in (df, df.limit(0)):
        stage_rows = start
        for name, stage in corpus_pipeline.STAGES:
            stage_rows = stage(spark, stage_rows, SF)
            if name != "swap_packing":
                assert stage_rows.columns == df.columns
        assert stage_rows.count() == (3 if start is df else 0)  # null and empty are copies, and so are the equal rows


def test_nothing_else_imports_the_subpackage():
    from pathlib import Path

    top = Path(corpus_pipeline.__file__).parent / "tidewater"
    for file in top.rglob("*.py"):
        if "llm" not in file.parts:
            assert not re.search(r"^\s*(from|import)\s.*\bllm\b", file.read_text(), re.M), file
