"""Every operator on small tables with nulls, empties, long texts, ties, repeats and clashing names."""

import random
import tracemalloc
import uuid
import zlib

import pytest
from pyspark.sql import functions as F

from tidewater.llm import decontaminate, flac, graphs, licenses, linededup, maxent, ngramjoin, packing, sharding, tokenfiles, toxicity
from tidewater.llm.common import shared_dir, tokenizer_path

DOC = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
ROWS = [
    (1, "One two three four five six seven eight nine ten eleven.", "en", "a", 1),
    (2, None, None, None, None),
    (3, "", "en", "a", 0),
    (4, LONG, "en", "b", len(LONG)),
    (5, "menu\nOne two three four five six seven eight nine ten eleven.\nÉté!", "fr", "a", 2),
    (5, "menu\nOne two three four five six seven eight nine ten eleven.\nÉté!", "fr", "a", 2),
    (6, " \n\t ", None, "b", 4),
    (7, "menu\nhome\nreleased under the MIT License. All rights reserved.", "en", "a", 5),
    (None, "menu\nno id here", "en", "a", 6),
]


@pytest.fixture(scope="module")
def docs(spark):
    """With columns whose names operators might use themselves."""
    df = spark.createDataFrame(ROWS, DOC)
    for name in ("word", "n", "uid", "rep", "node", "tile", "shard", "slot", "score", "host", "line", "c", "k", "bucket"):
        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="module")
def bench(spark):
    rows = [(10, "two three four five six seven eight nine ten eleven"), (9, "Été"), (8, None), (7, "..."), (6, "Two THREE four five six seven eight nine ten eleven, and more of it")]
    return spark.createDataFrame(rows, "item_id long, text string")


def by_id(rows, *names):
    return sorted(tuple(r[n] for n in names) for r in rows if r[names[0]] is not None)


@pytest.mark.parametrize("block", [10, 1_000_000])
def test_decontamination(docs, bench, none, block):
    out = decontaminate.decontaminate(docs, bench, keep=["doc_id", "word"], block_bytes=block).collect()
    assert len(out) == len(ROWS)
    found = {r.doc_id: (r._tw_n_words, [(s.start, s.end) for s in r._tw_spans], sorted(r._tw_items)) for r in out}
    assert found[1] == (11, [(1, 11)], ["10", "6"]) and found[2] == (0, [], []) and found[3][0] == 0 and found[4][1] == []
    assert found[5] == (13, [(2, 13)], ["10", "6", "9"])
    assert decontaminate.decontaminate(none, bench).count() == 0
    assert all(not r._tw_spans for r in decontaminate.decontaminate(docs, bench.limit(0), keep=["doc_id"]).collect())


def test_line_dedup(docs, none):
    out = linededup.drop_boilerplate(docs, ratio=0.3).collect()
    assert len(out) == len(ROWS) and out[0].asDict().keys() >= {"word", "host", "text"}
    found = {r.doc_id: (r.text, r._tw_lines, r._tw_dropped) for r in out}
    assert found[7] == ("home\nreleased under the MIT License. All rights reserved.", 3, 1)
    assert found[2] == (None, 0, 0) and found[3] == ("", 1, 0) and found[6] == (" \n\t ", 2, 0)
    assert found[1] == ("", 1, 1) and found[5] == ("Été!", 3, 2) and found[4][2] == 0
    assert linededup.drop_boilerplate(none).count() == 0


def test_the_ratio_alone_decides_on_boilerplate(spark):
    """A footer on all of four pages goes, whatever its line's end; copies are one page; a line of one page stays; hosts of URLs."""
    rows = [(i, f"https://Shop.example/{i}", f"Home\r\nitem {i}" if i % 2 else f"\tHome\nitem {i}") for i in range(4)]
    rows += [(10 + i, "http://one.example/x", "copied\ntwice") for i in range(5)] + [(20, "no url", "Home\nalone"), (21, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, url string, text string")
    out = {r.doc_id: r.text for r in linededup.drop_boilerplate(df, ratio=0.6, host=linededup.url_host("url")).collect()}
    assert out == {i: f"item {i}" for i in range(4)} | {10 + i: "copied\ntwice" for i in range(5)} | {20: "Home\nalone", 21: None}


def test_licenses(spark, docs, none):
    out = {r.doc_id: (r._tw_sentences, r._tw_licenses, r._tw_rest) for r in licenses.scan(docs).collect()}
    assert out[7] == (["mitName", "allRights"], ["MIT", "Proprietary"], []) and out[2] == ([], [], []) == out[3] == out[4]
    texts = [
        "Redistribution and use in source and binary forms, with or without modification, are permitted. Redistributions of source code must retain the notice. Redistributions in binary form must reproduce it. Neither the name of X nor others may be used to endorse products. This software is provided by X \"as is\".",
        "Licensed under the Apache License, Version 2.0. Licensed under the Apache License, Version 2.0. The software is provided \"as is\".",
        "either version 3 of the License, or (at your option) any later version",
    ]
    got = licenses.scan(spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    assert [r._tw_licenses for r in got] == [["BSD-3-Clause"], ["Apache-2.0"], ["GPL-or-later"]] and got[1]._tw_rest == ["asIs"]
    assert licenses.scan(none).count() == 0
    for _, pattern in licenses.RULES:
        assert "," not in pattern[:1]


def test_wrapped_licenses(spark):
    bsd = """Copyright (c) 2020 X

Redistribution and use in source and binary
forms, with or without modification, are permitted provided that the following conditions are met:
* Redistributions of source code must
  retain the above copyright notice and this list.
* Redistributions in binary form must reproduce the above copyright notice.
* Neither the name of X nor the names of its contributors
  may be used to endorse or promote products.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS
IS" AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED."""
    gpl = """it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version."""
    isc = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted."""
    texts = {
        bsd: ("copyright,bsdGrant,bsdSource,bsdBinary,bsdEndorse,asIs", "BSD-3-Clause"),
        "/*\n" + "\n".join(f" * {x}".rstrip() for x in bsd.split("\n")) + "\n */": ("copyright,bsdGrant,bsdSource,bsdBinary,bsdEndorse,asIs", "BSD-3-Clause"),
        "// " + gpl.replace("\n", "\n// "): ("gplLater", "GPL-or-later"),
        gpl.replace("\n", "\r\n"): ("gplLater", "GPL-or-later"),
        "; " + isc.replace("\n", "\n; "): ("iscGrant", "ISC"),
        "All\nrights  \n# reserved": ("allRights", "Proprietary"),
        "Licensed under the\nApache License, Version 2.0": ("apache2", "Apache-2.0"),
        "Licensed under the Apache\nLicense, Version 2.0": ("apache2", "Apache-2.0"),
        "GNU General Public License\nversion 2": ("gpl2", "GPL-2.0"),
        # What lines state each on its own stays, in order.
        "Apache License 2.0\nMIT License\nMIT License\nCopyright 2020 X\nAll rights reserved": ("apache2,mitName,mitName,copyright,allRights", "Apache-2.0,MIT,Proprietary"),
        # A blank line ends a sentence.
        "all\n\nrights reserved": ("", ""),
    }
    got = {r.text: (",".join(r._tw_sentences), ",".join(r._tw_licenses)) for r in licenses.scan(spark.createDataFrame([(t,) for t in texts], "text string")).collect()}
    assert got == texts


TAGS = [
    ("// SPDX-License-Identifier: MIT OR Apache-2.0", ["MIT", "Apache-2.0"]),
    ("/* SPDX-License-Identifier: GPL-2.0-only */\nint x;", ["GPL-2.0"]),
    ("# SPDX-License-Identifier: (GPL-2.0+ WITH Classpath-exception-2.0) AND BSD-3-Clause", ["GPL-or-later", "BSD-3-Clause"]),
    ("<!-- SPDX-License-Identifier: LGPL-2.1-or-later -->", ["LGPL"]),
    ("SPDX-License-Identifier: Zlib\nSPDX-License-Identifier: MIT\nReleased under the MIT License.", ["MIT", "zlib"]),
    ("Copyright (c) 2020 Ann. All rights reserved.", ["Proprietary"]),
    (
        "Copyright (c) 2020, Ann\nAll rights reserved.\n\nRedistribution and use in source and binary forms, with or without\nmodification, are permitted.\n\n1. Redistributions of source code must retain the\n   above notice.\n"
        "2. Redistributions in binary form must reproduce the above.\n3. Neither the name of Ann nor the names of its\n   contributors may be used to endorse products.\n\nTHIS SOFTWARE IS PROVIDED BY ANN \"AS IS\".",
        ["BSD-3-Clause"],
    ),
]


def test_tags_and_rights(spark):
    df = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(TAGS)], "doc_id long, text string")
    out = {r.doc_id: (r._tw_licenses, r._tw_rest) for r in licenses.scan(df).collect()}
    assert {i: sorted(x) for i, (x, _) in out.items()} == {i: sorted(want) for i, (_, want) in enumerate(TAGS)}
    assert all("spdx" not in rest for _, rest in out.values())


def test_the_plan_of_a_scan_is_small(spark):
    import time

    df = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    licenses.scan(df)
    began = time.monotonic()
    licenses.scan(df)
    assert time.monotonic() - began < 2


def test_flac(docs, none, tmp_path):
    out = flac.read_back(flac.store(docs, str(tmp_path / "flac"), keep=["doc_id", "word"])).collect()
    for r, row in zip(sorted(out, key=lambda r: r.doc_id or 0), sorted(ROWS, key=lambda r: r[0] or 0), strict=True):
        data = flac.payload((row[1] or "").encode())
        assert flac.decode([bytes(r._tw_media)]) == [data] and r._tw_payload_bytes == len(data) and r._tw_tail_crc32 == zlib.crc32(data[-64:])
        assert flac.seek(bytes(r._tw_media), 10, 50) == data[10:60] and flac.seek(bytes(r._tw_media), len(data) - 5, 50) == data[-5:]
    assert flac.read_back(flac.store(none, str(tmp_path / "none"))).count() == 0
    stream = bytearray(flac.encode([flac.payload(LONG.encode())])[0])
    for at in (len(stream) - 3, len(stream) // 2, 30):
        bad = bytes(stream[:at]) + bytes([stream[at] ^ 1]) + bytes(stream[at + 1 :])
        with pytest.raises(ValueError):
            flac.decode([bad])


def test_pcm_blocks(spark, docs, tmp_path):
    flac.write_pcm(flac.store(docs.where("doc_id = 4"), str(tmp_path / "flac"), keep=["doc_id"]), str(tmp_path / "pcm"))
    rows = sorted(spark.read.parquet(str(tmp_path / "pcm")).collect(), key=lambda r: r.block)
    assert b"".join(bytes(r.pcm) for r in rows) == flac.payload(LONG.encode()) and [r.first_sample for r in rows] == [k * flac.BLOCK for k in range(len(rows))]


def test_sharding(spark, docs, none):
    out = sharding.interleave(docs, shards=4, bucket_rows=3).collect()
    assert len(out) == len(ROWS) and sharding.interleave(none).count() == 0
    counts = [sum(r.shard == s for r in out) for s in range(4)]
    assert max(counts) - min(counts) <= 1 and all(sorted(r.slot for r in out if r.shard == s) == list(range(counts[s])) for s in range(4))
    many = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 20).cast("string")).alias("source"))
    for bucket in (50, 100_000):
        rows = sharding.interleave(many, shards=8, bucket_rows=bucket).collect()
        sources = {r.stratum for r in rows}
        for s in sources:
            shares = [sum(r.stratum == s and r.shard == k for r in rows) for k in range(8)]
            assert max(shares) - min(shares) <= 2
        exact = sorted(rows, key=lambda r: (r.shard, r.slot))
        assert [r.frac for r in exact] == sorted(r.frac for r in rows)
        assert sorted(r.doc_id for r in rows) == list(range(4000))


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def test_near_copies_equal_brute_force(spark, docs, none):
    import random

    random.seed(5)
    vocabulary = [f"v{i}" for i in range(300)]
    texts = {i: " ".join(random.choices(vocabulary, k=random.choice([1, 3, 5, 40, 80]))) for i in range(60)}
    base = [random.choices(vocabulary, k=120) for _ in range(2)]
    for i in range(60, 260):  # two groups of near copies at all distances
        words = list(base[i % 2])
        for _ in range(random.randrange(7)):
            words[random.randrange(120)] = random.choice(vocabulary)
        texts[i] = " ".join(words)
    for i in range(260, 275):
        texts[i] = texts[i - 200].upper() + "!"
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    sets = {}
    for i, t in texts.items():
        w = t.lower().replace("!", "").split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)}
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = dict.fromkeys(texts, 0)
    for a in texts:
        for b in texts:
            if a < b and jaccard(sets[a], sets[b]) >= 0.8 - 1e-12:
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    for tile in (16, 256):
        got = {r.doc_id: (r.class_id, r.n_links) for r in ngramjoin.join(df, tile=tile).collect()}
        assert got == {i: (find(i), links[i]) for i in texts}
    small = ngramjoin.join(docs).collect()
    assert len(small) == len(ROWS) and ngramjoin.join(none).count() == 0
    assert [(r.class_id, r.n_links) for r in small if r.doc_id == 5] == [(5, 1), (5, 1)]
    assert {r.class_id for r in small if r.doc_id in (2, 3, 6)} == {2}


def test_near_copies_without_ids(spark):
    words = [f"v{i}" for i in range(100)]
    rows = [(None, " ".join(words)), (None, " ".join([*words, "more"])), (7, " ".join([*words[:-1], "x"])), (None, "other words"), (7, "and again others")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.class_id or 0, r.n_links) for r in ngramjoin.join(df).collect())
    assert got == [(0, 0, 0), (0, 7, 2), (0, 7, 2), (7, 7, 0), (7, 7, 2)]


def test_components_equal_brute_force(spark):
    rng = random.Random(5)
    chain = [(i, i + 1) for i in range(1000, 1060)]
    star = [(2000, 2000 + i) for i in range(1, 50)]
    edges = [*chain, *star, *((rng.randrange(90), rng.randrange(90)) for _ in range(60)), (7, 7), (1030, 1010), (3001, -5), (3001, -5)]
    rng.shuffle(edges)
    want = {}
    for u, v in edges:
        if u != v:
            a, b = want.setdefault(u, {u}), want.setdefault(v, {v})
            a |= b
            for x in b:
                want[x] = a
    rows = graphs.components(spark.createDataFrame(edges, "u long, v long").repartition(3)).collect()
    assert sorted(map(tuple, rows)) == sorted((x, min(nodes)) for x, nodes in want.items())
    assert graphs.components(spark.createDataFrame([(4, 4)], "u long, v long")).count() == 0


def test_stars_need_no_round(spark, monkeypatch):
    """Rounds are many small tasks, whose ends all go through the driver's memory."""
    written = []
    monkeypatch.setattr(graphs, "checkpoint", lambda df, f=graphs.checkpoint: written.append(df) or f(df))
    stars = [(10 * k + i, 10 * k) for k in range(4) for i in range(1, 10)]
    graphs.components(spark.createDataFrame(stars, "u long, v long"))
    assert len(written) == 1
    graphs.components(spark.createDataFrame([*stars, (0, 10)], "u long, v long"))
    assert len(written) == 3


def test_pruning_bounds():
    least = ngramjoin.least_matches()
    assert len(least) == 6 and least == sorted(least) and least[-1] < 0.8 * 96


def test_packing(docs, none):
    parts = packing.pieces(docs, tokenizer_path())
    out = packing.pack_pieces(parts).collect()
    assert packing.pack_pieces(packing.pieces(none, tokenizer_path())).count() == 0
    by = {}
    for r in out:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 4096
    total = sum(r.length for r in out)
    assert len(by) == -(-total // 4096)
    assert sum(r.doc_id == 5 for r in out) == 2 and [r.length for r in out if r.doc_id in (2, 3, 6)] == [1, 1, 1]
    long = sorted((r.piece, r.start, r.length) for r in out if r.doc_id == 4)
    assert [s for _, s, _ in long] == [4096 * k for k in range(len(long))] and all(n == 4096 for *_, n in long[:-1])


def test_local_search_empties_bins():
    import random

    random.seed(3)
    for n in (1, 2, 7, 60, 300):
        lengths = [random.randrange(1, 101) for _ in range(n)]
        bins = packing.pack(lengths, 100)
        assert sorted(i for b in bins for i in b) == list(range(n)) and all(sum(lengths[i] for i in b) <= 100 for b in bins)
        assert len(bins) <= len(packing.best_fit(lengths, 100))
        search = packing.Search(packing.next_fit(lengths, 100), lengths, 100)
        squares, step = [sum(f * f for f in search.fill)], search._apply

        def counted(*args, search=search, squares=squares, step=step):
            step(*args)
            squares.append(sum(f * f for f in search.fill))

        search._apply = counted
        search.run()
        assert squares == sorted(set(squares)) and len(squares) == 1 + sum(search.steps.values())
        assert n < 60 or all(search.steps.values())
    # best fit needs three bins; an exchange brings them to two
    lengths = [44, 24, 24, 22, 21, 17, 8, 8, 6, 6, 10, 10]
    assert len(packing.pack(lengths, 100)) == -(-sum(lengths) // 100)


def test_groups_and_open_bins_keep_every_piece(spark):
    parts = spark.range(900).select(F.col("id").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), (1 + F.col("id") * 37 % 4096).cast("long").alias("length"), F.lit(0).cast("long").alias("ids_crc32"))
    out = packing.pack_pieces(parts, group_pieces=100).collect()
    assert sorted(r.doc_id for r in out) == list(range(900))
    fill = {}
    for r in out:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    assert max(fill.values()) <= 4096 and len(fill) <= 1.06 * sum(fill.values()) / 4096 + 1


def test_tokenizer_chunks(spark):
    from tidewater.llm.tokens import Encoder
    from tokenizers import Tokenizer

    texts = ["", "Don't. stop,now, ÉCOLE. A.b.c. x.. y., 3.14, <|endoftext|> z.", "a.\tb,\nC. d.\r\ne, f. É. İ. ΑΣ. ß.", "x" * 200 + ". y", "'s. 't, it's. 'RE, can't've.", LONG[:3000]]
    plain = Tokenizer.from_file(tokenizer_path()).encode_batch(texts, add_special_tokens=False)
    import numpy as np

    encoder = Encoder(tokenizer_path(), cache=100)
    for _ in range(2):
        assert encoder.encode([t.encode() for t in texts]) == [np.array(x.ids, "<u2").tobytes() for x in plain]


def test_token_files(spark, docs, none):
    import numpy as np

    for n in (1, 2, 3, 16, 17, 1000):
        s = tokenfiles.slots(np.arange(n), n)
        assert sorted(s.tolist()) == list(range(n)) and (tokenfiles.slots(s, n, inverse=True) == np.arange(n)).all()
    folder = shared_dir(spark).rstrip("/") + f"/token-test-{uuid.uuid4().hex}"
    rows = tokenfiles.materialise(docs, folder, tokenizer_path(), seq_len=64, shard_slots=100).collect()
    n = len(rows)
    assert sorted(r.slot for r in rows) == list(range(n)) and {r.shard for r in rows} == set(range(-(-n // 100)))
    ids = tokenfiles.read_slots(folder, 0, n)
    assert [zlib.crc32(x.tobytes()) for x in ids] == [r.ids_crc32 for r in sorted(rows, key=lambda r: r.slot)]
    assert [x.tobytes() for x in tokenfiles.read_slots(folder, n - 3, 10)] == [x.tobytes() for x in ids[n - 3 :]]
    pieces = packing.pieces(docs, tokenizer_path()).agg(F.sum("length")).first()[0]
    assert sum(len(x) for x in ids) == pieces
    with pytest.raises(FileExistsError):
        tokenfiles.materialise(docs, folder, tokenizer_path())
    # A shard's task that runs again leaves the same files and rows, and nothing else.
    from pathlib import Path

    top = Path(folder.removeprefix("file://")) / "shards"
    assert all(f.name.startswith("shard-") or f.name == "meta.json" or f.name.endswith(".crc") for f in top.iterdir())
    staged = tokenfiles._stage(docs.coalesce(1), tokenizer_path(), 64, 1, "doc_id", "text")
    again = shared_dir(spark).rstrip("/") + f"/token-again-{uuid.uuid4().hex}"
    Path(again.removeprefix("file://")).mkdir()
    frame = tokenfiles._shards(tokenfiles._bundles(staged, {0: 0}, -(-pieces // 64), 64, 100, 7), again, -(-pieces // 64), 64, 100)
    first, files = frame.collect(), {f.name: f.read_bytes() for f in Path(again.removeprefix("file://")).iterdir()}
    assert frame.collect() == first and {f.name: f.read_bytes() for f in Path(again.removeprefix("file://")).iterdir() if not f.name.endswith(".crc")} == files
    assert len(files) == -(-(-(-pieces // 64)) // 100)
    empty = shared_dir(spark).rstrip("/") + f"/token-none-{uuid.uuid4().hex}"
    assert tokenfiles.materialise(none, empty, tokenizer_path()).count() == 0 and tokenfiles.read_slots(empty, 0, 5) == []


def test_language_model(spark, docs, none):
    from collections import Counter
    from math import log10

    texts = [f"the {'red' if i % 2 else 'blue'} {'fox' if i % 2 else 'sky'} is rare{i} here" for i in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").unionByName(docs.select("doc_id", "text"))
    train = df.where("doc_id % 5 <> 0 or doc_id is null")
    out = maxent.score(df, train, lookup=40).collect()
    counts = Counter()
    for r in train.collect():
        counts.update(maxent.tokens((r.text or "").encode()))
    n, v = sum(counts.values()), len(counts)
    want = sorted((r.doc_id if r.doc_id is not None else -1, sum(log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in maxent.tokens((r.text or "").encode())), len(maxent.tokens((r.text or "").encode())), sum(counts[x] > 0 for x in maxent.tokens((r.text or "").encode()))) for r in df.collect())
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.base_score, r.n_tokens, r.n_known) for r in out)
    assert [x[0] for x in got] == [x[0] for x in want] and all(abs(a[1] - b[1]) < 1e-6 * abs(b[1]) and a[2:] == b[2:] for a, b in zip(got, want, strict=True))
    assert all(r.train_tokens == n and r.score < 0 for r in out)
    assert maxent.score(none, train).count() == 0
    assert [(r.score, r.base_score) for r in maxent.score(docs.where("doc_id = 1"), none).collect()] == [(0.0, 0.0)]


def test_codes_beyond_the_cache(monkeypatch):
    import numpy as np

    monkeypatch.setattr(maxent, "CACHE", 10)
    head = [(b"the", 50), (b"a", 30), (maxent.END, 20)]
    make = lambda: maxent.Classes(head, 3, np.zeros((3, maxent.CONTEXTS)))
    classes, want = make(), {}
    for at in range(0, 200, 7):
        batch = [b"the", *(b"w%d" % (i % 60) for i in range(max(at - 5, 0), at + 7)), b"a"]
        for x, code in zip(batch, classes.codes(batch).tolist(), strict=True):
            assert want.setdefault(x, make().codes([x])[0]) == code
        assert len(classes.known) <= 3 + 10 + len(batch)


def test_the_model_is_a_distribution():
    """Over all head words and tail classes the probabilities sum to 1, and the word factor's gradient is that of its logarithm."""
    import numpy as np

    rng = np.random.default_rng(1)
    head = [(b"the", 50), (b"a", 30), (maxent.END, 20), *((b"w%d" % i, 20 - i) for i in range(17))]
    classes = maxent.Classes(head, len(head), np.arange(len(head) * maxent.CONTEXTS).reshape(len(head), -1) % 7.0)
    outer = rng.normal(size=(1 << maxent.TABLE_BITS, classes.n)).astype(np.float32)
    inner = rng.normal(size=(1 << maxent.TABLE_BITS, 2 * maxent.SIDE)).astype(np.float32)
    bias, n = np.zeros(classes.n, np.float32), len(head)
    for past in ([], [4], [4, 7], [0, 3, 1]):
        total = 0.0
        for last in range(n + maxent.CLUSTERS):
            ids = np.array([*past, last])
            total += np.exp(maxent._logs(outer, inner, bias, classes, ids, np.zeros(len(ids), np.int64))[-1])
        assert abs(total - 1) < 1e-5
    word = next(i for i in range(n) if classes.place_of[i] > 0)
    rows = maxent.within(maxent.history(np.array([0, 3, word]), np.zeros(3, np.int64)), classes.class_of[[0, 3, word]])[2:]
    one = lambda: maxent.Inner(inner, classes.grid, rows, classes.class_of[[word]], classes.place_of[[word]])
    error, before = one().errors()[0], one().logs[0]
    for j in range(2 * maxent.SIDE):
        inner[rows[0, 0], j] += 1e-2
        assert abs((one().logs[0] - before) / 1e-2 - error[j]) < 2e-2
        inner[rows[0, 0], j] -= 1e-2


def test_toxicity(spark, docs, none):
    import random

    random.seed(2)
    clean = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(300):
        words = random.choices(clean, k=30)
        bad = i % 5 == 0
        for at in random.sample(range(30), 3) if bad else []:
            words[at] = random.choice(["vileish", "vileora", "nastyword"])
        rows.append((i, " ".join(words).capitalize(), int(bad)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    tagger = toxicity.train(df.where("doc_id % 3 <> 1").drop("toxic"), df.where("doc_id % 3 <> 1").select("doc_id", "toxic"))
    out = {r.doc_id: r for r in toxicity.score(df, tagger).collect()}
    assert all((out[i]._tw_score >= 0.7) == bool(bad) for i, _, bad in rows)
    for i, text, bad in rows:
        spans = [text[s.start : s.end].lower() for s in out[i]._tw_spans]
        assert not bad or spans and all(s[:4] in ("vile", "nast") for s in spans)
    small = toxicity.score(docs, tagger, keep=["doc_id", "score"]).collect()
    assert len(small) == len(ROWS) and all(r._tw_score == 0 for r in small if r.doc_id in (2, 3, 6)) and toxicity.score(none, tagger).count() == 0
    assert toxicity.train(docs, none.selectExpr("doc_id", "cast(null as int) as toxic")) is None
    assert all(r._tw_score == 0 for r in toxicity.score(docs, None).collect())


def test_copies_of_a_toxic_text_make_no_words_toxic(spark):
    import random

    random.seed(3)
    clean = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(random.choices(clean, k=30)), 0) for i in range(240)]
    rows += [(i, " ".join([*random.choices(clean, k=28), "nastyword", "vileora"]), 1) for i in range(240, 300)]
    rows += [(i, " ".join(f"plain{k}" for k in range(30)), 1) for i in range(300, 700)]  # one text, as often as it likes
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    tagger = toxicity.train(df.drop("toxic"), df.select("doc_id", "toxic"))
    asked = spark.createDataFrame([(1, " ".join(["plain3", "plain7", "plain9", *clean[:27]])), (2, " ".join([*clean[:28], "nastyword", "vileora"]))], "doc_id long, text string")
    out = {r.doc_id: r._tw_score for r in toxicity.score(asked, tagger).collect()}
    assert out[1] < 0.7 <= out[2]


def test_every_toxic_token_counts():
    import numpy as np

    tagger = toxicity.Tagger(np.zeros(4), np.ones((2, 2)), 0.0)
    few, many = (tagger.evidence(np.concatenate([np.full(n, 20.0), np.full(5000 - n, -20.0)])) for n in (8, 100))
    assert few[2] == many[2] and abs(few[1] - np.log1p(8)) < 1e-6 and abs(many[1] - np.log1p(100)) < 1e-6 and tagger.evidence(np.zeros(0))[1] == 0


def test_a_fit_holds_few_arrays_of_its_sample():
    """The driver has 1 GB or so: a gradient step goes through some windows at a time, with the same weights."""
    rng = random.Random(3)
    made = [(b" ".join(b"w%d" % (rng.random() ** 3 * 20_000) for _ in range(48)), bytes(int(k % 2 and rng.random() < 0.1) for _ in range(48))) for k in range(5000)]
    tracemalloc.start()
    toxicity.fit(((w.split(), list(m)) for w, m in made), rounds=1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30_000_000


def test_a_fit_in_steps_is_a_fit_at_once(monkeypatch):
    rng = random.Random(4)
    windows = [([b"w%d" % rng.randrange(400) for _ in range(n)], [int(k % 2 and rng.random() < 0.2) for _ in range(n)]) for k, n in enumerate(rng.choices(range(49), k=300))]
    found = []
    for at in (7, 1000):
        monkeypatch.setattr(toxicity, "FIT_WINDOWS", at)
        found.append(toxicity.fit(windows, rounds=20))
    a, b = found
    assert abs(a.weights - b.weights).max() < 1e-5 and abs(a.transitions - b.transitions).max() < 1e-9 and abs(a.first - b.first) < 1e-9


def test_forward_backward_is_exact():
    import itertools

    import numpy as np

    rng = np.random.default_rng(4)
    t = np.exp(rng.normal(size=(2, 2)))
    lengths = [1, 4, 7, 2]
    d, first, last = rng.normal(size=14), np.zeros(14, bool), np.zeros(14, bool)
    starts = np.cumsum([0, *lengths[:-1]])
    first[starts], last[starts + lengths - 1] = True, True
    for lanes in (1, 3, 1024):
        got = toxicity._scan(d, first, -0.7, t, lanes) + toxicity._scan(d[::-1], last[::-1], 0.0, t.T, lanes)[::-1] - d
        for s, n in zip(starts, lengths, strict=True):
            weight = np.zeros((n, 2))
            for y in itertools.product((0, 1), repeat=n):
                p = np.exp(sum(d[s + i] for i in range(n) if y[i]) + (-0.7 if y[0] else 0)) * np.prod([t[a, b] for a, b in itertools.pairwise(y)])
                for i in range(n):
                    weight[i, y[i]] += p
            assert np.allclose(got[s : s + n], np.log(weight[:, 1] / weight[:, 0]))
