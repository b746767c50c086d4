"""Null and repeated identifiers, one identifier with several texts, and other edge cases of the training-data operators."""

import hashlib
import math
import random
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import bpe_tree, common, exact_dedup, lm_scoring, minhash, mixing, quality_fm, repair, url_reputation

DOCS = "doc_id long, text string, lang string, source string, n_chars long, class string, row string"


def words(rng, n):
    return " ".join(f"w{rng.randrange(60)}" for _ in range(n))


@pytest.fixture(scope="module")
def odd_rows():
    """(doc_id, text) with null ids, one id with two texts, identical rows, and near copies among them."""
    rng = random.Random(21)
    base, other, third = words(rng, 90), words(rng, 90), words(rng, 90)
    return [(1, other), (1, base), (5, base + " more"), (None, third), (None, third + " x"), (None, words(rng, 40)), (7, "dup dup"), (7, "dup dup"), (None, None), (8, ""), (8, base.upper()), (9, other + " end"), (None, "dup dup"), (12, words(rng, 3000))]


@pytest.fixture(scope="module")
def odd(spark, odd_rows):
    return spark.createDataFrame([(i, t, "en", "s", 1, "c", "r") for i, t in odd_rows], DOCS)


def shingles(t):
    w = (t or "").encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def near_components(rows):
    """For each row its component's smallest doc_id (None: all null) and the row numbers of the component, by brute force."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            same = rows[a][0] is not None and rows[a][0] == rows[b][0]
            if sets[a] and sets[b] and (same or 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])):
                root[find(a)] = find(b)
    out = []
    for a in range(len(rows)):
        members = [b for b in range(len(rows)) if find(b) == find(a)]
        ids = [rows[b][0] for b in members if rows[b][0] is not None]
        out.append((min(ids) if ids else None, members))
    return out


def test_near_dedup_links_rows_that_share_an_id_and_keeps_null_ids_apart(odd, odd_rows):
    got = [tuple(r) for r in minhash.near_dedup(odd, key=odd.text).collect()]
    want = near_components(odd_rows)
    plain = sorted(((i, len(shingles(t)), c, t) for (i, t), (c, _) in zip(odd_rows, want)), key=str)
    assert sorted(((i, n, c, t) for i, n, c, _, t in got), key=str) == plain
    assert all(kept == (i == c) for i, _, c, kept, _ in got if c is not None)
    assert {i for i, _, c, _, _ in got if c == 1} == {1, 5, 8, 9}
    of_null = [(kept, t) for i, _, c, kept, t in got if c is None]
    assert sum(kept for kept, _ in of_null) == len({tuple(m) for c, m in want if c is None}) == 3


def test_three_rows_of_the_review(spark):
    rng = random.Random(1)
    base = words(rng, 80)
    df = spark.createDataFrame([(1, words(rng, 80)), (1, base), (5, base + " word")], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id, r.kept) for r in minhash.near_dedup(df).collect()) == [(1, 1, True), (1, 1, True), (5, 1, False)]


def test_a_cluster_without_a_shared_folder_is_refused(monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_dir(Session())


def test_exact_dedup_of_null_and_repeated_ids(spark, odd, odd_rows):
    got = sorted((tuple(r)[:4] for r in exact_dedup.exact_dedup(spark, odd, files_per_batch=2).collect()), key=str)
    norm = lambda t: "".join(c for c in t or "" if c not in common.WHITE)
    groups = {}
    for i, t in odd_rows:
        groups.setdefault(norm(t), []).append((-len(t or ""), i is None, i))
    want = []
    for i, t in odd_rows:
        group = groups[norm(t)]
        want.append((i, min(group, key=str if len(group) == 1 else lambda g: (g[0], g[1], g[2] or 0))[2], len(group)))
    assert sorted((g[:3] for g in got), key=str) == sorted(want, key=str)
    assert sum(g[3] for g in got) == len(groups)


def test_a_state_is_used_again(spark):
    """A later run meets the rows of earlier ones, whose bytes are found by their locators; a repeated run counts once."""
    state = common.new_path(spark, "test-state")
    df = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    first = exact_dedup.exact_dedup(spark, df([(1, "a b"), (2, "c")]), state=state, run="one").collect()
    assert sorted(tuple(r)[:4] for r in first) == [(1, 1, 1, True), (2, 2, 1, True)]
    for _ in range(2):
        second = exact_dedup.exact_dedup(spark, df([(3, "ab"), (4, "c "), (5, "new")]), state=state, run="two").collect()
        assert sorted(tuple(r)[:4] for r in second) == [(3, 1, 2, False), (4, 4, 2, True), (5, 5, 1, True)]
    third = exact_dedup.exact_dedup(spark, df([(6, "n e w")]), digits=64, state=state, run="three").collect()
    assert [tuple(r)[:4] for r in third] == [(6, 6, 2, True)]


def test_rows_of_files_are_located_where_they_are(spark, tmp_path):
    spark.createDataFrame([(i, f"t{i % 3} ") for i in range(30)], "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "d"))
    got = exact_dedup.exact_dedup(spark, spark.read.parquet(str(tmp_path / "d")), in_files=True).collect()
    assert {r.keep_id for r in got} == {0, 1, 2} and all(str(tmp_path) in r.locator.file for r in got)


def test_a_large_group_is_compared_salt_by_salt(spark):
    rows = spark.range(50).selectExpr("id as doc_id", "if(id = 49, 'other', 'same') as norm", "'d' as digest", "50L as group_size", "struct('f' as file, id as at) as locator", "struct('f' as file, 0L as at) as keep_at")
    rows = common.staged(rows, "test-tagged")
    assert exact_dedup.unequal(rows, rows, per_salt=7).collect()[0].digest == "d"
    assert exact_dedup.unequal(rows.filter("doc_id < 49"), rows, per_salt=7).count() == 0


def test_scores_of_null_and_repeated_ids(odd, odd_rows):
    split = [(i, (t or "").encode().lower().split()) for i, t in odd_rows]
    counts = Counter(tuple(w[j : j + k]) for _, w in split for k in (1, 2, 3) for j in range(len(w) - k + 1))
    total = sum(len(w) for _, w in split)

    def score(w):
        grams = [tuple(w[max(0, j - 2) : j + 1]) for j in range(len(w))]
        return round(sum(math.log(counts[g] / (counts[g[:-1]] if len(g) > 1 else total)) for g in grams), 6)

    want = sorted(((i, len(w), score(w)) for i, w in split), key=str)
    for every in (1, 64):
        got = lm_scoring.stupid_backoff(odd, sample_every=every).collect()
        assert sorted(((r.doc_id, r.n_words, round(r.log_score, 6)) for r in got), key=str) == want
        assert all((r.mean_log_score is None) == (r.n_words == 0) for r in got)


def test_token_files_of_null_and_repeated_ids(spark, odd, odd_rows):
    path, library = common.new_path(spark, "test-odd-ids"), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    repair.write_ids(odd, path, block_tokens=300, least=2)
    got = repair.read_ids(spark, path).orderBy("start").collect()
    ids = lambda t: [*library.encode(t or "", add_special_tokens=False).ids, 2]
    order = sorted(odd_rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    assert [r.doc_id for r in got] == [i for i, _ in order]
    assert sorted((str(r.doc_id), np.frombuffer(r.ids, "<u4").tolist()) for r in got) == sorted((str(i), ids(t)) for i, t in odd_rows)
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]


def test_bpe_of_null_and_repeated_ids(odd, odd_rows):
    got = sorted(((r.doc_id, bytes(r.decoded), r.n_tokens * 4 == len(r.ids)) for r in bpe_tree.bpe(odd).collect()), key=str)
    assert got == sorted(((i, (t or "").encode(), True) for i, t in odd_rows), key=str)


def test_quality_of_odd_rows(spark, odd, odd_rows):
    """Nulls, repeated rows, long texts and clashing names; fits agree between runs, and without labels all scores are about one half."""
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 0), (5, 1, 0), (7, 1, None), (8, None, 1), (None, 1, 0), (9, 0, 0), (12, 1, 0)], "doc_id long, quality int, toxic int")
    got, again = (sorted(map(tuple, quality_fm.quality(odd, labels).collect()), key=str) for _ in range(2))
    assert got == again and len(got) == len(odd_rows) and all(0 <= s <= 1 and p == int(s >= 0.7) for _, _, s, p in got)
    assert all(held == (i is not None and zlib.crc32(str(i).encode()) % 4 == 2) for i, held, _, _ in got)
    assert got.count(next(g for g in got if g[0] == 7)) == 2
    other = odd.withColumns({"lang": F.lit("x"), "source": F.lit(None).cast("string")})
    assert sorted(map(tuple, quality_fm.quality(other, labels).collect()), key=str) == got
    none = quality_fm.quality(odd, labels.limit(0)).collect()
    assert all(0.4 < r.score < 0.6 for r in none)
    assert quality_fm.accepted(odd, labels).columns == odd.columns


def test_a_quality_query_by_brute_force(spark):
    """The registered query against the formula of its own model, pair by pair, on whole texts of the smallest table."""
    sf = "/root/testdata/sf0.001"
    docs, labels = common.table(spark, sf, "documents"), common.table(spark, sf, "labels")
    model = quality_fm.train(docs, labels)
    some = [r for r in docs.collect() if len(r.text or "") < 400][:12]
    got = {r.doc_id: r.score for r in quality_fm.op4_quality(spark, sf).collect()}
    indptr, indices, values = quality_fm.features([r.text for r in some], [r.n_chars for r in some])
    for d, r in enumerate(some):
        i, x = indices[indptr[d] : indptr[d + 1]], values[indptr[d] : indptr[d + 1]]
        pairs = sum(float(model["v"][i[a]] @ model["v"][i[b]]) * x[a] * x[b] for a in range(len(i)) for b in range(a))
        assert got[r.doc_id] == pytest.approx(1 / (1 + math.exp(-(model["b"] + float(model["w"][i] @ x) + pairs))), abs=1e-6)


def test_mixing_of_null_and_repeated_ids(spark, odd, odd_rows):
    """Rows of one id are numbered salt by salt, and each takes as much as if they were ranked one by one."""
    many = odd.unionByName(odd.filter("doc_id = 7")).unionByName(odd.filter("doc_id is null"))
    results = [sorted(map(tuple, mixing.mix(many, shards=2, per_salt=n).select("doc_id", "size", "target", "taken").collect()), key=str) for n in (1, 2, 10_000)]
    assert results[0] == results[1] == results[2] and len(results[0]) == many.count()
    size = lambda t: len((t or "").encode().split())
    rows = many.collect()
    assert sorted(str((r.doc_id, size(r.text))) for r in rows) == sorted(str(r[:2]) for r in results[0])
    total = sum(size(r.text) for r in rows)
    assert abs(sum(r[3] for r in results[0]) - 1.5 * total) <= max(size(r.text) for r in rows) and all(r[3] <= 2 * r[1] for r in results[0])


def test_urls_of_odd_rows(spark):
    """Very long urls, an empty host that holds most rows, repeated rows and null ids."""
    long = "http://a.com/" + "x" * 200_000
    pages = [(i, None, "h") for i in range(50)] + [(None, long, "h"), (60, long + "?q", "h"), (60, long + "?q", "h"), (61, "://", "h"), (62, "http://" + "sub." * 5000 + "net/es/", "h")]
    got = url_reputation.url_filter(spark.createDataFrame(pages, "page_id long, url string, domain string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()
    assert len(got) == len(pages) and {(r.host, r.path, r.rule) for r in got if r.page_id is not None and r.page_id < 50} == {("", "", None)}
    by = {r.page_id: r for r in got}
    assert (by[None].host, len(by[None].path), by[None].rule) == ("a.com", 200_001, "com/") and by[60].path == by[None].path and (by[62].rule, by[62].verdict) == ("net/es/", "block") and by[61].host == ""


@pytest.fixture(scope="module")
def stage_input(spark, tmp_path_factory):
    rng = random.Random(8)
    base, other = words(rng, 120), words(rng, 120)
    rows = [(1, base), (2, base + " "), (3, base + " end"), (4, other), (4, other), (4, words(rng, 50)), (None, words(rng, 60)), (None, other + " y"), (None, None), (9, ""), (10, "  "), (11, words(rng, 2000)), (None, words(rng, 60))]
    path = str(tmp_path_factory.mktemp("stages") / "documents.parquet")
    spark.createDataFrame([(i, t, "en", "s" if i != 4 else None, len(t or ""), "left") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, `left` string").repartition(3).write.parquet(path)
    return spark.read.parquet(path), rows


def test_the_stages_that_drop_rows_by_brute_force(spark, stage_input):
    docs, rows = stage_input
    norm = lambda t: "".join(c for c in t or "" if c not in common.WHITE)
    key = lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0)
    groups = {}
    for r in rows:
        groups.setdefault(norm(r[1]), []).append(r)
    want = sorted(((min(g, key=key)[0], min(g, key=key)[1]) for g in groups.values()), key=str)
    kept = common.staged(corpus_pipeline.without_copies(spark, docs, ""), "test-stage")
    assert kept.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert [(i, norm(t)) for i, t in got] == [(i, norm(t)) for i, t in want]
    components = near_components(got)
    alone = {}
    for (i, t), (c, members) in zip(got, components):
        alone.setdefault(tuple(members), []).append((i, t, c))
    near = common.staged(corpus_pipeline.without_near_copies(spark, kept, ""), "test-stage")
    found = [(r.doc_id, r.text) for r in near.collect()]
    for members in alone.values():
        left = [(i, t) for i, t, _ in members if (i, t) in found]
        smallest = members[0][2]
        assert left and all(i == smallest for i, _ in left) and (smallest is not None or len(left) == 1)
    assert len(found) == len([r for r in got if r in found]) and near.columns == docs.columns


def test_the_last_stages_by_brute_force(spark, stage_input):
    docs, rows = stage_input
    mixed = common.staged(corpus_pipeline.mixed(spark, docs, ""), "test-stage")
    copies, plan = Counter((r.doc_id, r.text) for r in mixed.collect()), mixing.mix(docs).collect()
    assert mixed.columns == docs.columns and sum(copies.values()) == sum(r.copies for r in plan) and set(copies) <= set(rows)
    ranks = bpe_tree.TreeEncoder(public_tokenizers.path("byte_bpe_50k.tiktoken")).ranks
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = Counter((r.doc_id, r.n_tokens, bytes(r.ids), r.decoded_sha256) for r in corpus_pipeline.encoded(spark, mixed, "").collect())
    want = Counter()
    for (i, t), n in copies.items():
        ids = reference.encode_ordinary(t or "")
        want[i, len(ids), np.array(ids, "<u4").tobytes(), hashlib.sha256((t or "").encode()).hexdigest()] += n
    assert got == want


def test_the_stages_of_an_empty_table(spark, stage_input, tmp_path):
    stage_input[0].limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
