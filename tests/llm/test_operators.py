"""The corpus operators against brute force, exact round trips, held-out labels, and awkward rows."""

from __future__ import annotations

import hashlib
import os
import re
import time
import zlib
from collections import Counter, defaultdict
from html import unescape

import duckdb
import numpy as np
import pandas as pd
import pytest

from assay.llm import common, components, decontaminate, html_extract, language_id, licenses, near_dedup, packing, quality_classifier, quality_rules, token_files, toxicity
from assay.llm import queries as Q
from assay.llm.tokens import PieceEncoder, default_tokenizer

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def vocabulary(n, seed=1):
    dice = np.random.default_rng(seed)
    return ["".join(dice.choice(list("abcdefghijklmno"), 4)) for _ in range(n)]


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, odd characters, extra columns with clashing names."""
    words = vocabulary(400)
    long = " ".join(words[i % 397] for i in range(30_000))
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "null id text", "en", None, 3), (3, long, "en", "a", len(long)), (4, "same words here again", "en", "a", 1), (4, "same words here again", "en", "a", 1), (5, "same words here again", None, "b", 1), (6, "  \n\t ", "de", "b", 4), (7, "été ça   naïve 中文 🙂 x" * 3, "fr", "b", 9), (8, "a b c d e f g h " * 40, "en", "a", 640), (9, "\x00 odd \x0b control", "en", "a", 5), (10, "<|endoftext|> token text", "en", "a", 5)]
    df = spark.createDataFrame(rows, DOCS)
    clash = ("kept", "score", "n_words", "component_id", "key", "id", "print", "signature", "length", "matches", "u", "v", "node", "held_out", "a.b", "row", "host", "shard", "tie", "j", "h", "__m", "__host", "__odds", "__failed", "__kept", "__base_failed", "__gone", "__key", "__contaminated", "__h", "__id", "__y", "__g")
    for c in clash:
        df = df.selectExpr("*", f"doc_id as `{c}`")
    return df


@pytest.fixture(scope="module")
def nothing(awkward):
    return awkward.where("1 = 0")


# --- tokens, packing, files ----------------------------------------------------------------------


def whole(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_tokenizer())
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_pieces_encode_like_whole_texts():
    odd = ["a  b", "  x", " a", "a ", "\n\n a b\r\n c", " ", "", "a\x00b c", "it's a 'll ok 12 3 x's don't'", "\x85 x\xa0y z", "中文 test", "<|endoftext|> x", "hello <|endoftext|> x", "a<|endoftext|>b <|endoftext", "a\n b", "x \n", "foo,\nBar baz's. ,, x...'' 'tis", "a '", "x² ½ ٣a ⅷb", "a é̃ à", "one\ntwo three\nfour", "e" * 200 + " f"]
    made = PieceEncoder(default_tokenizer())
    for _ in range(2):  # cold and warm
        assert [list(np.frombuffer(made.encode(t), "<u4")) for t in odd] == whole(odd)
    assert made.encode(None) == b""


def test_files_round_trip(awkward, nothing, spark, tmp_path):
    found = token_files.token_files(awkward, partitions=3).toPandas().sort_values("start", kind="stable")
    rows = awkward.select("doc_id", "text").toPandas()
    ids = [x + [2] for x in whole([t or "" for t in rows.text])]
    by = sorted(((-1 if pd.isna(d) else int(d)), zlib.crc32(np.asarray(x, "<u4").tobytes()), len(x)) for d, x in zip(rows.doc_id, ids, strict=True))
    seen = sorted(((-1 if pd.isna(d) else int(d)), c, n) for d, c, n in zip(found.doc_id, found.ids_crc32, found.n_tokens, strict=True))
    assert by == seen
    ordered = [-1 if pd.isna(d) else int(d) for d in found.doc_id]
    assert ordered == sorted(ordered) and found.start.tolist() == np.concatenate([[0], np.cumsum(found.n_tokens)[:-1]]).tolist()
    assert token_files.token_files(nothing).count() == 0
    with pytest.raises(ValueError):
        token_files.write(awkward, f"file://{tmp_path}/narrow", end_id=1 << 16)
    written = token_files.write(awkward, f"file://{tmp_path}/set", width=4, partitions=2)
    assert written.n_ids == sum(map(len, ids)) and [s[3] for s in written.shards] == np.concatenate([[0], np.cumsum([s[2] for s in written.shards])[:-1]]).tolist()


def test_a_common_id_fills_several_shards_in_order(spark, tmp_path):
    rows = [(None if i % 3 == 0 else i, f"text number {i} " * (1 + i % 7)) for i in range(3000)] + [(7, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    written = token_files.write(df, f"file://{tmp_path}/set", partitions=12)
    assert len(written.shards) == 12 and max(s[2] for s in written.shards) < 2 * written.n_ids / 12
    found = token_files.read(spark, written).toPandas().sort_values("start", kind="stable")
    order = [(-1 if pd.isna(d) else int(d), c) for d, c in zip(found.doc_id, found.ids_crc32, strict=True)]
    assert len(found) == len(rows) and order == sorted(order) and found.start.tolist() == np.concatenate([[0], np.cumsum(found.n_tokens)[:-1]]).tolist()


def best_fit(lengths, capacity):
    """One document at a time, the tightest open bin."""
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(bins) if r >= n]
        if fits:
            i = min(fits, key=bins.__getitem__)
            bins[i] -= n
        else:
            bins.append(capacity - n)
    return sorted(bins)


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_best_fit_decreasing(seed):
    dice = np.random.default_rng(seed)
    capacity = int(dice.integers(5, 70))
    lengths = dice.integers(1, capacity + 1, int(dice.integers(0, 300))).tolist()
    histogram = {n: lengths.count(n) for n in set(lengths)}
    fills, ranks = defaultdict(list), defaultdict(list)
    for n, rank, bins, first, offset in packing.plan(histogram, capacity):
        ranks[n] += range(rank, rank + bins)
        for k in range(bins):
            fills[first + k].append((offset, n))
    assert all(sorted(ranks[n]) == list(range(c)) for n, c in histogram.items())
    for f in fills.values():
        at = 0
        for offset, n in sorted(f):
            assert offset == at
            at += n
        assert at <= capacity
    assert sorted(capacity - sum(n for _, n in f) for f in fills.values()) == best_fit(lengths, capacity)


def test_packing(awkward, nothing, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_ROWS", 4)
    found = packing.best_fit_packing(awkward).toPandas()
    ids = [x + [2] for x in whole([t or "" for t in awkward.select("text").toPandas().text])]
    assert found.length.sum() == sum(map(len, ids)) and found.length.max() <= 1024
    for _, s in found.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s.offset.tolist() == np.concatenate([[0], np.cumsum(s.length)[:-1]]).tolist() and s.length.sum() <= 1024
    assert found.sequence_id.nunique() == len(best_fit(found.length.tolist(), 1024))
    long = found[found.doc_id == 3].sort_values("piece")
    text = next(x for x in ids if len(x) > 20_000)
    assert long.start.tolist() == [0, *range(len(text) % 1024 or 1024, len(text), 1024)] and all(long.length.iloc[1:] == 1024)
    assert [zlib.crc32(np.asarray(text[a : a + n], "<u4").tobytes()) for a, n in zip(long.start, long.length, strict=True)] == long.ids_crc32.tolist()
    assert packing.best_fit_packing(nothing).count() == 0


# --- near duplicates -----------------------------------------------------------------------------


def components_by_force(texts, width, percent):
    sets = {}
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def copies():
    """Groups of exact and near copies around and below the threshold, and a chain."""
    dice, words = np.random.default_rng(3), vocabulary(3000, 5)
    texts, n = [], 0
    for g in range(12):
        base = dice.choice(words, int(dice.integers(1, 120))).tolist()
        for k in range(8):
            own = list(base)
            for _ in range(k % 4 * max(1, len(own) // 60)):
                own[int(dice.integers(len(own)))] = words[int(dice.integers(3000))]
            texts.append((n * 7 % 997, " ".join(own).title() if k % 2 else " ".join(own)))
            n += 1
    chain = dice.choice(words, 200).tolist()
    for k in range(6):
        chain = chain[4:] + dice.choice(words, 4).tolist()
        texts.append((900 + k, " ".join(chain)))
    return texts


@pytest.mark.parametrize(("width", "percent", "block"), [(3, 85, 1024), (5, 80, 4)])
def test_near_duplicates(spark, monkeypatch, width, percent, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)  # small blocks: large groups meet in pairs of blocks
    if block == 4:
        monkeypatch.setattr(near_dedup, "BROADCAST_ROWS", 0)
        monkeypatch.setattr(common, "HOT_ROWS", 2)
    texts = copies()
    found = near_dedup.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), width, percent).collect()
    wanted = components_by_force(texts, width, percent)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == wanted
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)


@pytest.mark.parametrize(("width", "percent", "m"), [(3, 85, 10), (5, 80, 13)])
def test_pairs_on_the_threshold_pass_the_distance_cut(spark, width, percent, m):
    k, far = m * near_dedup.CHUNK, near_dedup.most_apart(percent / 100, m)
    apart = np.random.default_rng(2).binomial(k, 1 - percent / 100, 10**6)
    assert near_dedup.chunks_for(percent / 100) == m and (apart > far).sum() <= 3 and (apart > 2 * m - 1).sum() > 100
    # pairs right on the threshold whose signatures share a key and lie more than 2m - 1 apart
    dice, hashes, multipliers, texts = np.random.default_rng(6), near_dedup.WordHashes(), near_dedup._multipliers(k), []
    while len(texts) < 6:
        words = [f"w{x}" for x in dice.integers(0, 10**9, 100 + width - 1)]  # 100 shingles and the first of them: similarity percent / 100
        pair = [" ".join(words), " ".join(words[: percent + width - 1])]
        a, b = (near_dedup.signature(near_dedup.shingle_hashes(t, width, hashes), multipliers) for t in pair)
        if (a != b).sum() >= 2 * m and (near_dedup.signature_keys(a[None]) == near_dedup.signature_keys(b[None])).any():
            texts += [(len(texts), pair[0]), (len(texts) + 1, pair[1])]
    found = near_dedup.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), width, percent).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == {i: i // 2 * 2 for i in range(6)}


@pytest.mark.parametrize("percent", [85, 80])
def test_no_pair_on_the_threshold_is_lost(percent):
    m = near_dedup.chunks_for(percent / 100)
    multipliers, far = near_dedup._multipliers(m * near_dedup.CHUNK), near_dedup.most_apart(percent / 100, m)
    dice, n = np.random.default_rng(11), 100
    wholes = dice.integers(0, 2**63, (10_000, n), dtype=np.uint64)
    a, b = (np.stack([near_dedup.signature(s, multipliers) for s in sets]) for sets in (wholes, wholes[:, : n * percent // 100]))
    alike = (near_dedup.signature_keys(a) == near_dedup.signature_keys(b)).any(axis=1)
    assert alike.all() and ((a != b).sum(axis=1) <= far).all()


@pytest.mark.parametrize("classes", [1, 2])
def test_a_large_group_is_dealt_in_bounded_parts(spark, monkeypatch, tmp_path, classes):
    monkeypatch.setattr(near_dedup, "BLOCK", 64)
    n = 3000

    def forest(batches):
        for frame in near_dedup._groups(batches, ["group", "at"]):
            for _, own in frame.groupby("at"):
                assert len(own) < 6 * 64  # one block of some 64 sets and as many strays
                first = own.groupby("payload").id.transform("min")
                yield pd.DataFrame({"a": first, "b": own.id})

    rows = spark.range(n).selectExpr("1L as `group`", f"{-(-n // 64)} as blocks", f"{n}L as n", f"{1 / 64}D as weight", "id", f"id % 40 div 39 * {classes - 1} as payload")
    found = near_dedup._in_groups(rows, spark.createDataFrame([(1, -(-n // 64))], "group long, blocks int"), "payload", forest).collect()
    wanted = {i: 39 if classes == 2 and i % 40 == 39 else 0 for i in range(n)}
    assert {r["node"]: r["component"] for r in found} == wanted


def test_near_duplicates_of_awkward_rows(awkward, nothing):
    found = near_dedup.near_duplicates(awkward, 3, 85).collect()
    by = defaultdict(list)
    for r in found:
        by[r["doc_id"]].append(r)
    assert len(found) == 12 and [r["component_id"] for r in by[5]] == [4] and [r["kept"] for r in by[4]] == [True, True]
    assert by[1][0]["n_shingles"] == by[2][0]["n_shingles"] == by[6][0]["n_shingles"] == 0 and by[2][0]["component_id"] == 2
    assert by[None][0]["component_id"] is None and by[None][0]["kept"]
    assert near_dedup.near_duplicates(nothing).count() == 0
    kept = near_dedup.deduplicated(awkward)
    assert kept.columns == awkward.columns and sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == [1, 2, 3, 4, 4, 6, 7, 8, 9, 10]


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 50), (50, 75), (7, 7), (200, 201), (201, 200)]
    found = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(41)} | {50: 50, 75: 50, 100: 50, 200: 200, 201: 200}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("few", [0, 10**6])
def test_components_of_few_and_many_links(spark, monkeypatch, few):
    monkeypatch.setattr(components, "FEW_LINKS", few)
    dice, n = np.random.default_rng(4), 400
    edges = [(int(a), int(b)) for a, b in dice.integers(0, n, (240, 2))] + [(999, 600 + i) for i in range(50)] + [(2**62, -(2**62)), (5, None), (None, None)]
    order = dice.permutation(200).tolist()
    edges += [(1000 + a, 1000 + b) for a, b in zip(order[:-1], order[1:], strict=True)] * 2  # one long path in no order
    least = {x: x for e in edges if None not in e and e[0] != e[1] for x in e}
    for _ in least:
        for a, b in edges:
            if a in least and b in least:
                least[a] = least[b] = min(least[a], least[b])
    found = components.connected_components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()
    assert {r["node"]: r["component"] for r in found} == least and len(found) == len(least)


@pytest.mark.parametrize("few", [0, 10**6])
def test_near_duplicates_with_few_and_many_links(spark, monkeypatch, few):
    monkeypatch.setattr(components, "FEW_LINKS", few)
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    texts = copies()
    found = near_dedup.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), 3, 85).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == components_by_force(texts, 3, 85)


def test_few_links_in_many_partitions_take_few_tasks(spark):
    before, settings = {}, {"spark.sql.shuffle.partitions": "97", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("few-links", "")
    try:
        for key, value in settings.items():
            before[key] = spark.conf.get(key)
            spark.conf.set(key, value)
        links = spark.range(3000).selectExpr("id as a", "id - id % 3 as b").repartition("a")
        found = {r["node"]: r["component"] for r in components.connected_components(links).collect()}
        stages = {s for j in tracker.getJobIdsForGroup("few-links") for s in tracker.getJobInfo(j).stageIds}
        tasks = sum(info.numCompletedTasks for s in stages if (info := tracker.getStageInfo(s)))
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert found == {i: i - i % 3 for i in range(3000)} and 97 <= tasks < 4 * 97


# --- decontamination -----------------------------------------------------------------------------


def contamination_by_force(docs, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 12) if w else 0):
            windows[tuple(w[k : k + 13])].add(str(i))
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                own = windows.get(tuple(w[k : k + n]))
                if own:
                    found |= own
                    hit |= set(range(k, k + n))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [10**6, 30])
def test_contamination(spark, block):
    dice, words = np.random.default_rng(9), vocabulary(60, 2)
    items = [(i, " ".join(dice.choice(words, int(dice.integers(1, 40))))) for i in range(20)] + [(30, None), (31, "!!"), (32, "one"), (33, "Zwei Wörter"), (0, "again " * 15)]
    docs = [(1, None), (2, ""), (3, "ONE, two"), (4, "zwei wörter! zwei-Wörter"), (5, "again " * 30), (5, "again " * 30)]
    for i in range(30):
        body = dice.choice(words, int(dice.integers(1, 200))).tolist()
        if i % 2:
            own = items[int(dice.integers(20))][1].split()
            at = int(dice.integers(len(body)))
            body[at:at] = own[: int(dice.integers(10, 41))]
        docs.append((10 + i, " ".join(body).title()))
    found = decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block_windows=block).collect()
    assert sorted((tuple(r) for r in found), key=str) == contamination_by_force(docs, items)


def test_contamination_of_awkward_rows(spark, awkward, nothing):
    items = spark.createDataFrame([(1, "same words here again")], "item_id long, text string")
    kept = decontaminate.decontaminated(awkward, items)
    assert kept.columns == awkward.columns and {4, 5} & {r["doc_id"] for r in kept.collect()} == set() and kept.count() == 9
    two = items.union(spark.createDataFrame([(2, "not to be found")], items.schema))
    blocked = decontaminate.decontaminated(awkward, two, block_windows=1)
    assert blocked.columns == awkward.columns and sorted(map(repr, blocked.collect())) == sorted(map(repr, kept.collect()))
    assert decontaminate.contamination(nothing, items).count() == 0
    assert decontaminate.contamination(awkward, items.where("1 = 0")).where("contaminated").count() == 0


# --- quality rules -------------------------------------------------------------------------------


def test_quality_rules_equal_their_sql(spark, sf, awkward, nothing):
    crafted = [(100 + i, t, "en", s, 0) for i, (t, s) in enumerate([("x y z " * 30, "bad"), ("a\nb c\n\nb c\n b c\n" * 4, "bad"), (" ".join(vocabulary(60)), "bad"), ("é" * 30 + " b" * 25, "good"), ("A! " * 40, None), ("one two three four five six seven eight " * 2 + " ".join(vocabulary(50, 4)), "good")])]
    plain = awkward.select("doc_id", "text", "lang", "source", "n_chars").where("doc_id <> 9")  # DuckDB ends texts at a NUL
    docs = spark.read.parquet(f"{sf}/documents.parquet").union(plain).union(spark.createDataFrame(crafted, DOCS))
    found = quality_rules.quality_rules(docs).toPandas()
    con = duckdb.connect()
    con.register("documents", docs.toPandas().astype({"doc_id": "Int64", "n_chars": "Int64"}))
    wanted = con.execute(quality_rules.ORACLE_SQL).df()
    columns = sorted(wanted.columns)
    rows = lambda f: sorted((tuple(None if pd.isna(v) else v for v in r) for r in f[columns].astype(object).itertuples(index=False)), key=str)
    assert rows(found) == rows(wanted)
    assert quality_rules.quality_rules(nothing).count() == 0
    kept = quality_rules.passing(awkward)
    assert kept.columns == awkward.columns


def test_repeat_words_by_force(spark):
    dice = np.random.default_rng(4)
    texts = [" ".join(dice.choice(list("ab"), int(n))) for n in dice.integers(0, 60, 40)]
    found = [r["n"] for r in quality_rules.measured(spark.createDataFrame([(t,) for t in texts], "text string")).selectExpr("__m.n_repeat_words as n").collect()]
    for t, n in zip(texts, found, strict=True):
        w = t.split()
        windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        assert n == len({j for i, x in enumerate(windows) if windows.count(x) > 1 for j in range(i, i + 8)})


def test_bad_hosts_lower_the_bar(spark):
    clean, lapse = " ".join(vocabulary(60)), " ".join(vocabulary(60)) + " #*$%"
    docs = [(i, "short", "en", "bad", 0) for i in range(50)] + [(60, lapse, "en", "bad", 0), (61, lapse, "en", "good", 0)] + [(100 + i, clean, "en", "good", 0) for i in range(50)]
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.quality_rules(spark.createDataFrame(docs, DOCS)).collect()}
    assert not kept[60] and kept[61] and all(kept[100 + i] for i in range(50))


# --- extraction ----------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body><header><h1>Site</h1></header>
<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">About</a></li></ul></nav><div class="cookie-notice">We use cookies, accept them all now please</div>
<article><h1>Headline &amp; more</h1><p>First  paragraph of <b>the text&nbsp;with
lines.<br>Still first.<p>Second &lt;para&gt; &eacute; words here.<div class="ad">Buy this thing now</div><form><input><label>Mail</label></form><ul><li>point one<li>point two</ul>
<!-- hidden <p>comment</p> --><aside>Related: other story</aside><div id="comments"><p>I disagree with all of this, says a reader.</p></div></article><footer>&copy; 2020</footer></body></html>"""


def test_main_text(spark):
    text = "Headline & more\nFirst paragraph of the text with lines. Still first.\nSecond <para> é words here.\npoint one\npoint two"
    weights = html_extract.fit([PAGE] * 3)
    assert html_extract.main_text(PAGE, weights) == text
    assert html_extract.main_text(PAGE.replace("article", "div"), weights) == text  # by the region alone
    pages = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (None, "u", "plain words &amp; no tags"), (5, "u", "<p>a b c <scr"), (6, "u", "<nav>only menu</nav>"), (1, "u", PAGE)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "page_id as text", "page_id as k", "page_id as h")
    found = [(r["page_id"], r["text"], r["n_chars"]) for r in html_extract.html_extraction(df).collect()]
    wanted = [(1, text), (2, ""), (3, ""), (None, "plain words & no tags"), (5, "a b c"), (6, ""), (1, text)]
    assert sorted(found, key=str) == sorted(((i, t, len(t)) for i, t in wanted), key=str)
    assert html_extract.html_extraction(df.where("1 = 0")).count() == 0


def bared(html):
    """Without any name that tells the content: no <article>, no semantic elements, no classes, ids or roles."""
    html = re.sub(r"<(/?)(article|main|nav|header|footer|aside)\b", r"<\1div", html)
    return re.sub(r"\s(?:class|id|role)=(?:\"[^\"]*\"|'[^']*'|[^\s>]+)", "", html)


def token_f1(found, wanted):
    a, b = Counter(found.split()), Counter(wanted.split())
    return 2 * sum((a & b).values()) / max(1, sum(a.values()) + sum(b.values()))


def test_learned_weights_find_the_content_of_pages_without_names(spark, sf):
    pages = [r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect() if r["html"]]
    weights = html_extract.fit(pages[::2])
    held = [(bared(h), article_text(h)) for h in pages[1::2]]
    fitted, unfitted = ([token_f1(html_extract.main_text(h, w), t) for h, t in held] for w in (weights, html_extract.Weights()))
    exact = [html_extract.main_text(h, weights) == t for h, t in held]
    assert np.mean(fitted) > 0.99 and np.mean(exact) > 0.95 and np.mean(unfitted) < np.mean(fitted) - 0.01
    assert not any(html_extract.main_text(h, html_extract.Weights()) == t for h, t in held)


def test_the_scan_decides(spark, sf):
    pages = [r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect() if r["html"]]
    weights = html_extract.fit(pages)
    far = "<div>" * 40 + "</div>" * 40 + "<p>Read what others " + "wrote on this " * 12 + "</p>"
    for h in [h for h in pages if len(article_text(h).split()) > 60][:20]:
        page = bared(h) + far
        text = html_extract.main_text(page, weights)
        assert text == article_text(h)  # built like content, but too far from it
        parsed = html_extract.parse(page)
        odds = weights.judge(parsed)[1]
        every = {parsed.blocks[i] for i in range(len(odds)) if parsed.words[i] and odds[i] >= html_extract.LEAVE_OUT}
        unscanned = "\n".join(" ".join("".join(parsed.texts[k]).split()) for k in sorted(every))
        assert unscanned != text and "Read what others" in unscanned


def test_deep_and_unclosed_pages_take_linear_time():
    weights = html_extract.fit([PAGE] * 3)
    inner = "<p>Some words of text for everyone to read here.</p>"
    assert html_extract.main_text("<div>" * 5000 + inner + "</div>" * 5000, weights) == "Some words of text for everyone to read here."
    for html in ("<b>" * 100_000 + "one two three four", "<b>x " * 30_000 + "<p>y " * 30_000, "<ul>" + "<li><i>x y z" * 30_000, "<div class='a b'>w " * 30_000, "</b>" * 100_000 + "x", "<p>" * 100_000 + "x y z a b c"):
        start = time.time()
        assert isinstance(html_extract.main_text(html, weights), str) and time.time() - start < 20


def test_class_words_drop_no_content():
    weights = html_extract.fit([PAGE] * 3)
    text = html_extract.main_text(PAGE, weights)
    for bare in (PAGE, PAGE.replace("article", "div")):
        for attribute in ("class='site has-sidebar'", "id='page' class='no-sidebar'", "class='sidebar'", "class='sidebar-left widget'", "id=form"):
            wrapped = bare.replace("<header>", f"<div {attribute}><header>", 1).replace("</body>", "</div></body>")
            assert html_extract.main_text(wrapped, weights) == text, attribute
    for inside in ("<div class='post-header'>By the author</div>", "<section class='related-work'><p>Others wrote of it before us.</p></section>"):
        found = html_extract.main_text(PAGE.replace("<p>First", inside + "<p>First"), weights)
        assert found == text.replace("First paragraph", re.sub("<[^>]+>", "", inside) + "\nFirst paragraph")
    for inside in ("<div class='ad-slot'>Buy</div>", "<ul class='relatedPosts'><li>Other</ul>", "<div id='comment-list'><p>So wrong.</div>", "<div hidden>x</div>"):
        assert html_extract.main_text(PAGE.replace("<p>First", inside + "<p>First"), weights) == text


def test_region_is_the_best_of_all():
    dice = np.random.default_rng(8)
    for _ in range(50):
        scores = dice.integers(-5, 6, int(dice.integers(1, 20))).tolist()
        a, b = html_extract.best_region(scores)
        best = max([0] + [sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)])
        assert sum(scores[a:b]) == best


def article_text(html):
    body = re.search(r"<article>(.*?)</article>", html, re.S)[1]
    parts = [" ".join(unescape(re.sub(r"<[^>]+>", " ", re.sub(r"</?b>", "", x))).split()) for x in re.split(r"</?(?:p|h1)>", body)]
    return "\n".join(x for x in parts if x)


def test_driver_pages(spark, sf):
    found = html_extract.html_extraction(spark.read.parquet(f"{sf}/pages.parquet")).toPandas().set_index("page_id").text
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        assert found[r["page_id"]] == article_text(r["html"])


# --- language, quality, toxicity -----------------------------------------------------------------


def greedy_phrases(text, training):
    """Phrases of a greedy parse by the substrings of a text."""
    n = at = 0
    while at < len(text):
        k = 1
        while at + k < len(text) and text[at : at + k + 1] in training and text[at : at + k] in training:
            k += 1
        at += k
        n += 1
    return n


def test_cross_parsing_by_force():
    dice = np.random.default_rng(2)
    training = "".join(dice.choice(list("abc "), 300))
    texts = ["".join(dice.choice(list("abcd "), int(n))) for n in dice.integers(1, 500, 20)]
    model = language_id.LanguageModel({"x": [training]})
    codes = [model.letters.codes(t) for t in texts]
    own = model.letters.codes(training + " ")[: language_id.TRAIN_LETTERS]
    as_text = lambda c: "".join(chr(97 + x) for x in c)
    assert model.phrases(codes)[:, 0].tolist() == [greedy_phrases(as_text(c), as_text(own)) for c in codes]


def test_language_held_out(spark, sf, awkward, nothing):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = language_id.language_id(docs).toPandas().merge(docs.select("doc_id", "lang").toPandas(), on="doc_id")
    assert (found.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in found.doc_id]).all()
    assert (found.lang_pred == found.lang)[found.held_out].mean() > 0.95 and found.score.between(0, 1).all()
    odd = {r["doc_id"]: r["lang_pred"] for r in language_id.language_id(awkward).collect()}
    assert odd[1] == odd[2] == odd[6] == "und" and len(odd) == 11
    assert language_id.language_id(nothing).count() == 0
    assert {r["lang_pred"] for r in language_id.language_id(awkward.withColumn("lang", awkward["lang"].substr(9, 9)).where("doc_id < 3")).collect()} <= {"und", ""}


def test_quality_held_out(spark, sf, awkward, nothing):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    found = quality_classifier.quality_classifier(docs, labels).toPandas().merge(labels.toPandas(), on="doc_id")
    assert (found.predicted == found.quality).mean() > 0.9
    for d, n in ((awkward, 12), (nothing, 0)):
        out = quality_classifier.quality_classifier(d, labels).toPandas()
        assert len(out) == n and out.score.between(0, 1).all()
    assert quality_classifier.quality_classifier(awkward, labels.where("1 = 0")).toPandas().score.nunique() == 1


def test_views_teach_each_other():
    dice = np.random.default_rng(5)
    y, hidden = dice.integers(0, 2, 60).astype(float), dice.integers(0, 2, 600).astype(float)
    view = lambda t, noise: (t[:, None] * 2 - 1) * np.array([[1.0, -1.0, 0.0]]) + noise * dice.standard_normal((len(t), 3))
    model = quality_classifier.co_train([view(y, 0.3), view(y, 0.5)], y, [view(hidden, 0.3), view(hidden, 0.5)])
    assert sum(a + b for a, b in model.handed) > 100
    fresh = dice.integers(0, 2, 500).astype(float)
    assert ((model.score([view(fresh, 0.3), view(fresh, 0.5)])[0] >= 0.5) == fresh).mean() > 0.97


def paths_by_force(token, model):
    """Every path of a token's lattice and its score; the best."""
    best = (-np.inf, "")

    def walk(k, a, b, score, text):
        nonlocal best
        if k == len(lattice):
            best = max(best, (score + model.log[a, b, 0], text))
            return
        for letters, cost in lattice[k]:
            x, y, s = a, b, score - cost
            for ch in letters:
                s += model.log[x, y, toxicity.code_of(ch)]
                x, y = y, toxicity.code_of(ch)
            walk(k + 1, x, y, s, text + letters)

    lattice = toxicity._segments(token)
    walk(0, 0, 0, 0.0, "")
    return best[1]


def test_viterbi_by_force():
    model = toxicity.CharModel(toxicity.trigram_counts(["the idiot and the moron met a stupid loser in the trash " * 50]))
    for token in ("1d10t", "m0r0n", "5tup1d", "l-o-5-e-r", "trrra5h", "1diiiot", "x1y2z3"):
        assert toxicity.restore(token, model) == paths_by_force(token, model)
    words = toxicity.Restorer(model)
    assert [words[w] for w in ("1d10t", "M0R0N!!", "st000pid"[:2] + "upid", "l-o-s-e-r", "idiiiiot", "plain,")] == ["idiot", "moron", "stupid", "loser", "idiot", "plain"]
    assert words.spaced("a i d i o t, b") == ["aidiot"] or "idiot" in words.spaced("a i d i o t, b")[0]


def test_toxicity(spark, awkward, nothing):
    dice, words = np.random.default_rng(6), vocabulary(500, 8)
    bad = ["idiot", "moron", "scum", "loser"]
    rows, marks = [], []
    for i in range(600):
        body = dice.choice(words, 40).tolist()
        toxic = int(i % 4 == 0)
        if toxic:
            for w in dice.choice(bad, 2, replace=False):
                body.insert(int(dice.integers(40)), w)
        rows.append((i, " ".join(body), "en", "a", 0))
        marks.append((i, 1, toxic))
    masked = ["1d10t", "m o r o n", "l-o-s-e-r", "idiiiot", "iidiioott", "m  o\to \nr o n", "looser", "SCUUM!"]
    hidden = [(1000 + k, " ".join([*dice.choice(words, 15), w, *dice.choice(words, 15)]), "en", "a", 0) for k, w in enumerate(masked)]
    docs, labels = spark.createDataFrame(rows + hidden, DOCS), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    found = {r["doc_id"]: r for r in toxicity.toxicity(docs, labels).collect()}
    held = [i for i, _, _ in marks if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(found[i]["held_out"] for i in held) and np.mean([found[i]["predicted"] == (i % 4 == 0) for i in held]) == 1.0
    assert all(found[1000 + k]["predicted"] for k in range(8)), [found[1000 + k] for k in range(8)]
    kept = toxicity.clean(docs, labels)
    assert kept.columns == docs.columns and kept.where("doc_id < 600").count() == 450
    out = toxicity.toxicity(awkward, labels).toPandas()
    assert len(out) == 12 and out.score.between(0, 1).all() and toxicity.toxicity(nothing, labels).count() == 0
    assert toxicity.toxicity(docs, labels.where("1 = 0")).where("predicted = 1").count() == 0


def test_markers_by_force():
    dice, words = np.random.default_rng(12), vocabulary(40, 9)
    markers = toxicity.Markers({("abc", 1), (words[0], 0), (words[1][:3], 2), ("nom", 3)}, np.array([3.0, 1.0, 1.0, -2.0]), 0.1)
    for _ in range(50):
        own = set(dice.choice([*words, *(words[1][:3] + x for x in "xyz"), "abcd", "nomx", "nomy", "nomz", "aabbcc"], 12))
        hits = markers.hits({w: m for w in own if (m := markers.holds(w))})
        wanted = 0
        for w in own:
            for letters, times in markers.markers:
                if w == letters or times and len(w) >= len(letters) and w[: len(letters)] == letters and sum(x[: len(letters)] == letters for x in own) >= times:
                    wanted += 1
                    break
        assert len(hits) == wanted
    assert all(markers.may_hold(w) for w in ("aabbccc", "abbc", words[0] + words[0][-1])) and not markers.may_hold("acb")


@pytest.mark.parametrize(("scale", "recall", "precision"), [("sf0.01", 0.8, 0.95), ("sf0.1", 0.9, 0.95)])
def test_toxicity_held_out(spark, scale, recall, precision):
    folder = f"/root/testdata/{scale}"
    if not os.path.isdir(folder):
        pytest.skip("the driver's tables are not here")
    found = Q.op6_toxicity(spark, folder).where("held_out").join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").toPandas()
    caught = ((found.predicted == 1) & (found.toxic == 1)).sum()
    assert caught >= recall * found.toxic.sum() and caught >= precision * found.predicted.sum()


# --- licenses ------------------------------------------------------------------------------------


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = row
        row = [0]
        for j, y in enumerate(b):
            row.append(before[j] + 1 if x == y else max(before[j + 1], row[j]))
    return row[-1]


def test_license_scan(spark, awkward, nothing):
    dice, words = np.random.default_rng(7), vocabulary(300, 3)
    index, rows, wanted = licenses.Index(licenses.TEMPLATES), [], {}
    names = sorted(licenses.TEMPLATES)
    for i in range(60):
        body = dice.choice(words, int(dice.integers(0, 80))).tolist()
        name = names[i % len(names)]
        own = licenses.TEMPLATES[name].split()
        if len(own) > 20:
            for _ in range(i % 3):
                own[int(dice.integers(len(own)))] = words[int(dice.integers(300))]
        at = int(dice.integers(len(body) + 1))
        rows.append((i, " ".join(body[:at] + own + body[at:])))
        wanted[i] = name
    found = {r["doc_id"]: r["matches"] for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        spoken = licenses.words_of(text)
        mine = [m for m in found[i] if m["license"] == wanted[i]]
        full = longest_common(licenses.words_of(licenses.TEMPLATES[wanted[i]]), spoken)
        assert mine and mine[0]["matched"] <= full and mine[0]["matched"] >= full - 2, (wanted[i], mine, full)
        span = spoken[mine[0]["start"] : mine[0]["end"]]
        assert longest_common(licenses.words_of(licenses.TEMPLATES[wanted[i]]), span) == mine[0]["matched"]
    assert all(r["matches"] == [] for r in licenses.license_scan(awkward).collect()) and licenses.license_scan(nothing).count() == 0
    assert licenses.scan(None, index, near_dedup.WordHashes()) == []


@pytest.mark.parametrize("gap", [0, 1, 3])
def test_notices_side_by_side_are_reported_each(gap):
    hashes = near_dedup.WordHashes()
    for name, notice in [*licenses.TEMPLATES.items(), ("one", "mit"), ("two", "mit licensed")]:
        index, own = licenses.Index({name: notice}), licenses.words_of(notice)
        for copies in (1, 2, 3, 7):
            text = " ".join(["x y", *[notice + " z" * gap] * copies])
            spans = [(m[3], m[4]) for m in licenses.scan(text, index, hashes)]
            assert spans == [(2 + k * (len(own) + gap), 2 + k * (len(own) + gap) + len(own)) for k in range(copies)], (name, copies)
    index = licenses.Index({"MIT": "Released under the MIT License."})
    found = licenses.scan("Released under the MIT License. Under the MIT License. Released under the MIT.", index, hashes)
    assert [(m[2], m[3], m[4]) for m in found] == [(5, 0, 5), (4, 5, 9), (4, 9, 13)]
    assert len(licenses.scan("Released under the MIT License. " * 4000, index, hashes)) == 4000


def test_banded_alignment_equals_the_full_one_near_its_diagonal():
    dice = np.random.default_rng(1)
    for _ in range(30):
        a = dice.choice(list("abcde"), 12).tolist()
        b = list(a)
        del b[int(dice.integers(len(b)))]
        b.insert(int(dice.integers(len(b))), "z")
        assert licenses.align(a, ["q"] * 5 + b, 5)[0] == longest_common(a, b)


# --- queries and the pipeline --------------------------------------------------------------------


def test_every_operator_has_a_query(spark, sf):
    names = list(Q.queries())
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names) == list(range(1, 11)) and set(Q.oracle_sql()) <= set(names)


def test_pipeline(spark, sf):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stage = docs
    seen = [stage.count()]
    for name, f in P.STAGES[:-1]:
        stage = f(spark, stage, sf)
        assert stage.columns == docs.columns, name
        stage = spark.createDataFrame(stage.collect(), docs.schema)
        seen.append(stage.count())
    assert seen == sorted(seen, reverse=True) and seen[-1] > 0.5 * seen[0]
    left = [(r["doc_id"], r["text"]) for r in stage.collect()]
    assert all(root == i for i, (_, root) in components_by_force(left, 5, 80).items())
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert not any(r[-1] for r in contamination_by_force(left, items))
    packed = P.run(spark, sf).toPandas()
    assert set(packed.doc_id) == {i for i, _ in left} and packed.groupby("sequence_id").length.sum().max() <= 1024


def test_a_worker_keeps_the_caches_of_one_operator_only():
    from assay.llm import common, tokens, toxicity, words

    model = toxicity.CharModel(np.zeros(toxicity.ALPHABET**3))
    markers = toxicity.Markers(set(), np.zeros(4), 0.1)
    shown = toxicity._worker_words(model, markers)
    assert toxicity._worker_words(model, markers) is shown
    words._power_tables(8)
    assert list(common._kept) == ["words"]
    made = tokens.encoder(default_tokenizer())
    assert tokens.encoder(default_tokenizer()) is made and list(common._kept) == ["tokens"]
    assert toxicity._worker_words(model, markers) is not shown


def test_the_encoder_holds_a_piece_from_its_second_sight_on(monkeypatch):
    from assay.llm import tokens

    made = PieceEncoder(default_tokenizer())
    once, text = "a " + " ".join(f"w{i}x" for i in range(50)), "b twice1 c twice1 d twice1"
    assert made.encode(once) == made._whole(once) and len(made) < 5
    assert made.encode(text) == made._whole(text) and "twice1" in made
    monkeypatch.setattr(tokens, "CACHE_PIECES", 3)
    for _ in range(3):
        assert made.encode(once) == made._whole(once) and made.encode(text) == made._whole(text)
        assert len(made) <= 3 and len(made.older) <= 5
